"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a row number 0..n-1 that depends on the rows alone, never on files or partitions: rows are counted in
4096 fixed buckets by a mix of their id and checksum, a running total over the buckets gives each its first number, and
inside a bucket rows are ordered by id, size and checksum. The permutation sends number r to place p; the shard is
p mod shards and the slot p div shards, so counts are at most one apart and slots have no gaps. Either way is
computable without a table: place() and number() below.

Defined cases. A null text has no bytes (size 1, checksum 0). Rows with a null id sort first. Rows equal in id, size
and checksum are interchangeable: they are counted together before the shuffle and dealt out again in runs, so a third
of all rows may be the same. A text of any length is measured whole. An empty table gives an empty result. Other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .feistel import PRIME, ROUNDS, permute, round_keys

BUCKETS = 4096
RUN = 1000


def place(number: Column, n: Column, shards: int, seed: int) -> tuple[Column, Column]:
    """(shard, slot) of a row number."""
    p = permute(number, n, seed)
    return (p % shards).cast("int"), F.floor(p / shards).cast("long")


def number(shard: Column, slot: Column, n: Column, shards: int, seed: int) -> Column:
    """The row number at a shard's slot."""
    return permute(slot * shards + shard, n, seed, back=True)


def row_numbers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, number, n) for every row."""
    body = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"))
    groups = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    mixed = F.pmod(F.coalesce("doc_id", F.lit(-1)), F.lit(PRIME)) * 48271 + F.col("text_crc32") % PRIME
    groups = groups.withColumn("bucket", (mixed % PRIME * 69621 % PRIME % BUCKETS).cast("int"))
    groups = materialize(groups, "groups")  # small rows; the texts are read once
    every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.groupBy("bucket").agg(F.sum("copies").alias("held"))
    offsets = offsets.select("bucket", F.coalesce(F.sum("held").over(every), F.lit(0)).alias("offset"), F.sum("held").over(Window.partitionBy()).alias("n"))
    before = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("doc_id"), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(F.broadcast(offsets), "bucket")
    runs = first.select("doc_id", "size", "text_crc32", "n", "copies", (F.col("before") + F.col("offset")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN).cast("long"))).alias("run"))
    start = F.col("first") + F.col("run") * RUN
    runs = runs.select("doc_id", "size", "text_crc32", "n", start.alias("start"), F.least(F.lit(RUN), F.col("copies") - F.col("run") * RUN).alias("length")).repartition("start")
    return runs.select("doc_id", "size", "text_crc32", "n", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("number"))


def shard(docs: DataFrame, shards: int = 8, seed: int = 20240101, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, number, n, shard, slot) for every row; see the module."""
    rows = row_numbers(docs, id_col, text_col)
    s, t = place(F.col("number"), F.col("n"), shards, seed)
    return rows.withColumn("shard", s).withColumn("slot", t)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sql(shards: int = 8, seed: int = 20240101) -> str:
    """The same in DuckDB: checksum by table, numbers by windows, the walk by recursion."""
    turns = []
    for i, (add, mul) in enumerate(round_keys(seed)):
        v, w, m = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        t = f"(({v} + {add}) % {PRIME})"
        new = f"({w} + (({t} * {t} % {PRIME}) * {mul} + {v}) % {PRIME} % {m}) % {m}"
        keep = f"SELECT * EXCLUDE ({w}), {new} AS {w} FROM "
        turns.append(keep)
    inner = "(SELECT *, x // b AS l, x % b AS r FROM walk WHERE NOT done)"
    for keep in turns:
        inner = f"({keep}{inner})"
    assert len(turns) == ROUNDS
    return f"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0,1,2,3,4,5,6,7]::UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
keyed AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size,
    (SELECT xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, 2 * coalesce(strlen(text), 0), 2), lambda i: ('0x' || substr(h, i, 2))::UBIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT FROM tab) AS text_crc32
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents)),
bucketed AS (SELECT *, (((coalesce(doc_id, -1) % {PRIME} + {PRIME}) % {PRIME}) * 48271 + text_crc32 % {PRIME}) % {PRIME} * 69621 % {PRIME} % {BUCKETS} AS bucket FROM keyed),
numbered AS (
  SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS number, count(*) OVER () AS n FROM bucketed),
start AS (SELECT number, number AS x, n, ceil(n / ceil(sqrt(n)))::BIGINT AS a, ceil(sqrt(n))::BIGINT AS b, false AS done FROM numbered),
walk AS (
  SELECT * FROM start
  UNION ALL
  SELECT number, l * b + r, n, a, b, l * b + r < n FROM {inner}),
placed AS (SELECT number, x AS p FROM walk WHERE done)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INT AS shard, p // {shards} AS slot, NULL::INT AS grown_shard
FROM numbered JOIN placed USING (number)"""
