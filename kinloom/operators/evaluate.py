"""Quality of predicted pairs against known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of all members (id, cluster) of one cluster, a < b; for known pairs of small clusters (metrics use counts instead)."""
    return members.select("cluster", F.col("id").alias("a")).join(members.select("cluster", F.col("id").alias("b")), "cluster").filter("a < b").select("a", "b").distinct()


def same_group(pairs: DataFrame, members: DataFrame, group: str = "cluster") -> DataFrame:
    """The pairs (a, b, ...) of which both are members (id, group) of one group, with it; no pair of a group is made."""
    side = members.select("id", group)
    rows = pairs.join(side.select(F.col("id").alias("a"), F.col(group)), "a")
    return rows.join(side.select(F.col("id").alias("b"), F.col(group).alias("__other")), "b").filter(F.col(group) == F.col("__other")).drop("__other")


def group_metrics(truth: DataFrame, members: DataFrame, group: str = "cluster") -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of the pairs that merged groups imply, transitively: group sizes are counted, not listed."""
    true = truth.select("a", "b").distinct()
    hit = same_group(true, members, group).agg(F.count(F.lit(1)).alias("tp"))
    made = members.groupBy(group).agg(F.count(F.lit(1)).alias("m")).agg(F.coalesce(F.sum(F.expr("m * (m - 1) div 2")), F.lit(0)).alias("made"))
    n = {k: v for df in (hit, made, true.agg(F.count(F.lit(1)).alias("true"))) for k, v in df.first().asDict().items()}
    rows = truth.sparkSession.createDataFrame([(n["tp"], n["made"] - n["tp"], n["true"] - n["tp"])], "tp long, fp long, fn long")
    return scored(rows)


def scored(n: DataFrame) -> DataFrame:
    """Counts tp, fp and fn with precision, recall and f1, rounded to 4; nothing to find is 1."""
    share = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(1.0)
    n = n.withColumns({"precision": share("fp"), "recall": share("fn")})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return n.withColumn("f1", f1).withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


def as_metrics(row: DataFrame) -> DataFrame:
    """One row of figures as (metric, value)."""
    names = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in row.columns)
    return row.selectExpr(f"stack({len(row.columns)}, {names}) AS (metric, value)")


def pair_metrics(truth: DataFrame, predicted: DataFrame, unresolved: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 (rounded to 4); unresolved pairs are neither predicted nor missed. Nothing to find is 1."""
    mark = lambda df, c: df.select("a", "b").distinct().withColumn(c, F.lit(True))
    rows = mark(truth, "t").join(mark(predicted, "p"), ["a", "b"], "full").join(mark(unresolved, "u"), ["a", "b"], "left").na.fill(False, ["t", "p", "u"])
    said = F.col("p") & ~F.col("u")
    n = rows.agg(F.count_if(said & F.col("t")).alias("tp"), F.count_if(said & ~F.col("t")).alias("fp"), F.count_if(F.col("t") & ~said & ~F.col("u")).alias("fn"), F.count_if(F.col("t") & F.col("u")).alias("unresolved_truth"))
    return scored(n)


def near_miss_rate(near: DataFrame, asserted: DataFrame) -> DataFrame:
    """The share of near misses (a, b) that weren't asserted; 1 without any."""
    rows = near.select("a", "b").join(asserted.select("a", "b").distinct().withColumn("hit", F.lit(1)), ["a", "b"], "left")
    return rows.agg(F.count(F.lit(1)).alias("near_misses"), F.coalesce(F.round(F.avg(F.when(F.col("hit").isNull(), 1.0).otherwise(0.0)), 4), F.lit(1.0)).alias("rejection_rate"))


def split_predictions(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asserted, unresolved) of routed pairs, by what the pipeline said of them, whatever a person decided since."""
    return pairs.filter("verdict = 'same_person'").select("a", "b"), pairs.filter("method = 'escalated_not_adjudicated'").select("a", "b")


def compare_runs(tuned: DataFrame, held_out: DataFrame) -> DataFrame:
    """Metrics (metric, value) of two runs side by side; regressed where the held-out one is lower."""
    return tuned.withColumnRenamed("value", "tuned").join(held_out.withColumnRenamed("value", "held_out"), "metric", "full").withColumn("regressed", F.coalesce(F.col("held_out") < F.col("tuned"), F.lit(False)))
