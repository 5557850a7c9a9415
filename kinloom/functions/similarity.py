"""String similarity by longest common subsequences, and the pair score built on it.

The kernel is a bit-parallel Arrow function; lcs_sql() is the same as a nested higher-order aggregate.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import let
from .tables import COMPANY_WEIGHT, ESCALATE_AT, INITIAL_SCORE, MERGE_AT, NAME_CAP, NAME_LEAST, NAME_WEIGHT, TITLE_BONUS, TITLE_PENALTY


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; one machine word operation a character."""
    if not a or not b:
        return 0
    full, where = (1 << len(a)) - 1, {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio_of(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / total if total else 100.0


def token_sort_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, dx, dy = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not dx or not dy):
        return 100.0
    n = len(" ".join(sorted(both)))
    gap = 1 if both else 0
    share = lambda distance, total: 100.0 * (1 - distance / total) if total else 100.0
    best = share(len(dx) + len(dy) - 2 * lcs_length(dx, dy), 2 * (n + gap) + len(dx) + len(dy))
    if both:
        best = max(best, share(gap + len(dx), 2 * n + gap + len(dx)), share(gap + len(dy), 2 * n + gap + len(dy)))
    return best


def _arrow(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    run.__name__ = f.__name__
    return F.pandas_udf(run, "double")


def ratio(a: Column, b: Column) -> Column:
    return _arrow(ratio_of)(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _arrow(token_sort_of)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _arrow(token_set_of)(a, b)


def lcs_sql(a: str, b: str) -> str:
    """The kernel as a Spark SQL expression over two string expressions."""
    start = f"transform(sequence(0, length({a})), i -> 0)"
    cell = f"greatest(element_at(row, -1), element_at(prev, j + 1), element_at(prev, j) + if(substr({a}, j, 1) = c, 1, 0))"
    row = f"aggregate(sequence(1, length({a})), array(0), (row, j) -> concat(row, array({cell})))"
    return f"if(length({a}) = 0 or length({b}) = 0, 0, element_at(aggregate(filter(split({b}, ''), c -> c != ''), {start}, (prev, c) -> {row}), -1))"


def initials_fit(short: Column, long: Column) -> Column:
    return (F.length(short) == 1) & long.startswith(short)


def name_score(a: str, b: str, base: Column) -> Column:
    """base (the set ratio of the names), lifted where first and last names differ by initials only; 0 without names."""
    x, y = F.col(f"{a}.name"), F.col(f"{b}.name")
    fits = lambda k: (x[k] == y[k]) | initials_fit(x[k], y[k]) | initials_fit(y[k], x[k])
    lifted = fits("first") & fits("last") & ~((x["first"] == y["first"]) & (x["last"] == y["last"]))
    return F.when(x.isNull() | y.isNull(), 0.0).when(F.coalesce(lifted, F.lit(False)), F.greatest(base, F.lit(INITIAL_SCORE))).otherwise(base)


def blend(name: Column, company: Column, title_agrees: Column) -> Column:
    """struct(score, title_vetoed) from the name and company scores (company null: can't be compared) and the titles' agreement (null: one is missing)."""
    given = F.struct(name.alias("n"), company.alias("c"), title_agrees.alias("t"))

    def raw(s: Column) -> Column:
        both = F.when(s["c"].isNull(), F.least(s["n"], F.lit(NAME_CAP))).otherwise(NAME_WEIGHT * s["n"] + COMPANY_WEIGHT * s["c"])
        return both + F.when(s["t"], TITLE_BONUS).when(~s["t"], -TITLE_PENALTY).otherwise(0.0)

    def final(s: Column, capped: Column) -> Column:
        vetoed = F.coalesce(~s["t"], F.lit(False)) & (capped >= MERGE_AT)
        score = F.when(vetoed, F.greatest(F.lit(ESCALATE_AT), F.least(capped, F.lit(NAME_CAP)))).otherwise(capped)
        return F.struct(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2).alias("score"), vetoed.alias("title_vetoed"))

    cap = lambda s, r: F.when(s["c"].isNull() | (s["n"] < NAME_LEAST), F.least(r, F.lit(NAME_CAP))).otherwise(r)
    return let(given, lambda s: let(let(raw(s), lambda r: cap(s, r)), lambda c: final(s, c)))
