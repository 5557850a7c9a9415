"""Normalized records: raw columns and derived ones side by side, and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.fold import strip
from ..functions.tables import BLOCKED_BOTH, BLOCKED_COMPANY, BLOCKED_EMAIL, FIELD_LABELS, FIELD_WEIGHTS
from ..sources.layers import parse_lists


def present(field: str) -> Column:
    if field == "needs_offers":
        return (F.size("needs") > 0) | (F.size("offers") > 0)
    return F.coalesce(strip(F.col(field)) != "", F.lit(False))


def completeness() -> Column:
    """struct(score, missing, blocked, blocked_reason) of a record with parsed lists."""
    points = sum((F.when(present(f), w).otherwise(0) for f, w in FIELD_WEIGHTS.items()), F.lit(0))
    missing = F.filter(F.array(*(F.when(~present(f), f) for f in FIELD_WEIGHTS)), lambda x: x.isNotNull())
    reason = F.when(~present("email") & ~present("company"), BLOCKED_BOTH).when(~present("email"), BLOCKED_EMAIL).when(~present("company"), BLOCKED_COMPANY)
    return F.struct((points / 100.0).alias("score"), missing.alias("missing"), reason.isNotNull().alias("blocked"), reason.alias("blocked_reason"))


def describe_gaps(missing: Column) -> Column:
    named = F.transform(missing, lambda f: F.element_at(N.table(FIELD_LABELS), f))
    return F.when(F.size(missing) == 0, "Complete").otherwise(F.concat(F.lit("Missing "), F.array_join(named, ", ")))


def normalize_records(people: DataFrame) -> DataFrame:
    rows = parse_lists(people)
    canonical = N.company(F.col("company"))
    out = rows.select(
        "*",
        N.name(F.col("full_name")).alias("name"),
        N.email(F.col("email")).alias("mail"),
        N.profile_slug(F.col("linkedin_url")).alias("slug"),
        canonical.alias("company_canonical"),
        N.title(F.col("title")).alias("title_canonical"),
        N.clean_title(F.col("title")).alias("title_clean"),
        N.location(F.col("location")).alias("place"),
        completeness().alias("completeness"),
    )
    return out.withColumn("company_key", N.company_key(F.col("company_canonical")))


def histogram(records: DataFrame) -> DataFrame:
    """Records by range of completeness, all ranges listed."""
    s = F.col("completeness.score")
    label = F.when(s >= 1.0, "1.00").when(s >= 0.8, "0.80-0.99").when(s >= 0.6, "0.60-0.79").when(s >= 0.4, "0.40-0.59").otherwise("< 0.40")
    names = records.sparkSession.createDataFrame([(x,) for x in ("1.00", "0.80-0.99", "0.60-0.79", "0.40-0.59", "< 0.40")], "bucket string")
    return names.join(records.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
