"""Unicode folding in column expressions: compatibility decomposition with everything but ASCII dropped.

Two tables are built from the Unicode data of Python: characters that fold to one ASCII character, for one translate(),
and those that fold to several, looked up only in rows that hold one. All else outside ASCII is dropped.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def foldings(form: str) -> tuple[dict[str, str], dict[str, str]]:
    one, many = {}, {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))):
        norm = unicodedata.normalize(form, c)
        if norm == c:
            continue
        to = norm.encode("ascii", "ignore").decode() if form == "NFKD" else norm
        (one if len(to) == 1 else many)[c] = to
    return one, {c: to for c, to in many.items() if to}


def char_class(chars) -> str:
    """A pattern of the characters as ranges, which match much faster than a long list."""
    ranges: list[list[int]] = []
    for p in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


@functools.cache
def literal_map(items: tuple[tuple[str, str], ...]) -> Column:
    """A map of literals; built once, as every literal is a call into the JVM."""
    return F.create_map(*(F.lit(x) for kv in items for x in kv))


def _apply(c: Column, form: str) -> Column:
    one, many = foldings(form)
    table = literal_map(tuple(many.items()))
    spread = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    held = F.when(c.rlike(char_class(many)), spread).otherwise(c)
    return F.translate(held, "".join(one), "".join(one.values()))


def ascii_fold(c: Column) -> Column:
    """NFKD, then ASCII alone."""
    return let(c, lambda x: F.when(x.rlike(r"^[\x00-\x7F]*$"), x).otherwise(F.regexp_replace(_apply(x, "NFKD"), r"[^\x00-\x7F]", "")))


def compat_fold(c: Column) -> Column:
    """NFKC character by character (sequences of combining marks are left as they are)."""
    return let(c, lambda x: F.when(x.rlike(r"^[\x00-\x7F]*$"), x).otherwise(_apply(x, "NFKC")))


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)
