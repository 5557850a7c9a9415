"""The decision log as a stream: each micro-batch is folded into the table of latest decisions.

A batch is written under its number, and states are folded from the newest complete one, so a batch that is delivered
again, or a driver lost between two steps, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decisions import latest_decisions
from ..sources.layers import DECISIONS


def read_stream(spark: SparkSession, directory: str) -> DataFrame:
    return spark.readStream.schema(DECISIONS).json(directory)


def state(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The latest decisions after the newest complete batch (before a number)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [f.getPath() for f in fs.listStatus(path)]
    done = [int(p.getName().split("=")[1]) for p in found if p.getName().startswith("batch=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    done = [n for n in done if before is None or n < before]
    return spark.read.schema(DECISIONS).parquet(f"{root}/batch={max(done)}") if done else None


def fold(stream: DataFrame, root: str, checkpoint: str):
    """Starts the query; state() reads what it keeps."""

    def step(batch: DataFrame, number: int) -> None:
        old = state(batch.sparkSession, root, number)
        rows = batch.select("a", "b", "decision", "note", "decided_at")
        latest_decisions(rows if old is None else old.unionByName(rows)).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Decisions by kind and hour, with late ones up to the watermark."""
    rows = stream.withColumn("ts", F.to_timestamp("decided_at")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size), "decision").agg(F.count(F.lit(1)).alias("n"))
