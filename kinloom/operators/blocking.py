"""Candidate pairs by blocking keys with a cap on bucket sizes, which drops keys that say nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import MAX_BUCKET, PREFIX


def blocking_keys(records: DataFrame) -> DataFrame:
    """(id, key, type); keys of missing parts don't exist."""
    name, place = F.col("name"), F.col("place")
    keys = [
        F.concat(F.lit("li:"), F.col("slug")),
        F.concat(F.lit("em:"), F.col("mail.local")),
        F.concat(F.lit("co:"), F.col("company_key"), F.lit("|"), name["last"]),
        F.concat(F.lit("nl:"), F.substring(name["last"], 1, PREFIX), F.lit("|"), place["city"]),
        F.concat(F.lit("nm:"), name["first"]),
    ]
    rows = records.select("id", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("key"))
    return rows.withColumn("type", F.substring_index("key", ":", 1))


def bucket_sizes(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key", "type").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")


def candidates(records: DataFrame, cap: int = MAX_BUCKET) -> DataFrame:
    """(a, b, keys) with a < b: types of all keys that brought a pair together."""
    keys = blocking_keys(records)
    # the cap is applied to pre-aggregated sizes, so a hot key never meets its rows in one task
    good = bucket_sizes(keys).filter(F.col("size") <= cap).select("key")
    rows = keys.join(good, "key", "left_semi")
    pairs = rows.select("key", "type", F.col("id").alias("a")).join(rows.select("key", F.col("id").alias("b")), "key").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.sort_array(F.collect_set("type")).alias("keys"))


def key_counts(records: DataFrame, cap: int = MAX_BUCKET) -> DataFrame:
    """Pairs by key type, from bucket sizes alone."""
    sizes = bucket_sizes(blocking_keys(records)).filter(F.col("size") <= cap)
    return sizes.groupBy("type").agg(F.sum(F.expr("size * (size - 1) div 2")).alias("pairs"))


def skipped(records: DataFrame, cap: int = MAX_BUCKET) -> DataFrame:
    """Buckets beyond the cap."""
    return bucket_sizes(blocking_keys(records)).filter(F.col("size") > cap).select("key", "size")
