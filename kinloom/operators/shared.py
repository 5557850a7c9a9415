"""What the operators share: scratch tables, skew-safe joins and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join treats a key as hot when it holds more than one in so many rows; so there are at most so many hot keys.
HOT_KEYS = 1024
_made: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, an own one on a local master (tests), else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kinloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: a short lineage that outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Deletes the files behind a table made by materialize()."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rsplit("/", 1)[0])


def release(spark: SparkSession) -> int:
    """Deletes all scratch tables of this session that are left, and says how many; for when its results are written."""
    n = len(_made)
    while _made:
        _delete(spark, _made.pop())
    return n


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """rows with their place (from 0) by the order columns, which must tell rows apart.

    Rows are sorted by ranges, in as many tasks as there are; only the number of rows of each comes to the driver.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    held = materialize(ranged, "numbered")
    part = F.shiftright("__at", 33)
    offsets, total = [], 0
    for r in held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("m")).orderBy("p").collect():
        offsets.append((r.p, total))
        total += r.m
    starts = spark.createDataFrame(offsets, "__part long, __start long")
    out = held.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__start", "__at")


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins left, of many rows a key, to right, of one row a key, on columns that aren't null in left.

    Keys that hold more than 1/HOT_KEYS of left's rows, so at most HOT_KEYS of them, are found by a pre-aggregated
    count and joined by a broadcast of their rows of right; all others are joined by a shuffle. Both inputs should be
    tables: each is read twice.
    """
    total = left.count()
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > total / HOT_KEYS + 1)
    hot = [r.h for r in counts.select(F.xxhash64(*on).alias("h")).collect()]
    if not hot:
        return left.join(right, on, how)
    is_hot = F.xxhash64(*on).isin(hot)  # the same on both sides, whatever else has the hash
    warm = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), on, how)
    return warm.unionByName(left.filter(~is_hot).join(right.filter(~is_hot), on, how))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Contraction: every node hangs itself on its smallest neighbour, chains are shortened by pointer jumping, and the
    edges are rewritten between the roots until none is left. Nothing but counts comes to the driver, each round is a
    written table, and hot nodes are joined by broadcast.
    """
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels = None
    while not now.isEmpty():
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")).withColumnRenamed("a", "node"), "parent")
        while True:
            upper = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            higher = materialize(hot_join(parent, upper, ["up"]).select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parent")
            still = higher.filter("moved").isEmpty()
            drop_table(parent)
            parent = higher.select("node", "up")
            if still:
                break
        if labels is None:
            labels = materialize(parent.select("node", F.col("up").alias("component")), "labels")
        else:
            moved = hot_join(labels, parent.select(F.col("node").alias("component"), "up"), ["component"], "left")
            new = materialize(moved.select("node", F.coalesce("up", "component").alias("component")), "labels")
            drop_table(labels)
            labels = new
        half = materialize(hot_join(now, parent.select(F.col("node").alias("a"), F.col("up").alias("ra")), ["a"]).select("b", "ra"), "half")
        moved = hot_join(half, parent.select(F.col("node").alias("b"), F.col("up").alias("rb")), ["b"])
        new = materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a < b").distinct(), "edges")
        for table in (half, parent, now):
            drop_table(table)
        now = new
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
