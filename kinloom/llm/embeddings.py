"""Near-duplicate vectors by an epsilon grid order join, within equal labels.

Unit vectors with a cosine of at least COSINE lie within eps = sqrt(2 - 2 * COSINE). Vectors are projected on their
leading principal directions (fitted on a bounded sample, FIT rows by order of a hash; any orthonormal directions give
the same links, only slower), laid on a grid of width eps and sorted by their cells, label by label. The sorted
sequence is cut into intervals of BLOCK rows. Two intervals are joined only where cells of theirs touch in the two
leading directions and their boxes in all kept directions are within eps; inside a task the join goes on recursively,
halving the longer interval and skipping halves whose boxes are farther apart, down to products of LEAF rows in double
precision. Each task returns link counts and a spanning forest of its links, never the links themselves.

Equal vectors of a label are one class first, counted with its copies. Defined cases: vectors that are null, empty,
zero or hold null or non-finite components, or whose label or id is null, link with nothing (n_links 0, their own
component, kept). Vectors of unlike lengths never link. A cosine of exactly COSINE links. Rows that share a vec_id are
vectors of their own, each counted and returned; equal ones of them link. An empty table gives no rows. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hot_join, materialize

COSINE = 0.98
FIT, DIRECTIONS = 4096, 6
BLOCK, LEAF = 1024, 128


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def directions(x: np.ndarray) -> np.ndarray:
    """The leading principal directions of unit rows, as columns."""
    x = x - x.mean(0)
    _, vectors = np.linalg.eigh(x.T @ x)
    return vectors[:, ::-1][:, :DIRECTIONS].copy()


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def join_intervals(u: np.ndarray, p: np.ndarray, m: np.ndarray, split: int, eps: float, cosine: float) -> tuple[np.ndarray, Forest]:
    """Weighted link counts and components between rows before and from split on; split 0: within all rows."""
    count, forest = np.zeros(len(u), np.int64), Forest(len(u))

    def walk(a0: int, a1: int, b0: int, b1: int) -> None:
        if a1 <= a0 or b1 <= b0:
            return
        a, b = p[a0:a1], p[b0:b1]
        if (a.min(0) - b.max(0) > eps).any() or (b.min(0) - a.max(0) > eps).any():
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            hit = u[a0:a1] @ u[b0:b1].T >= cosine
            if a0 == b0:
                hit = np.triu(hit, 1)
            if not hit.any():
                return
            count[a0:a1] += hit @ m[b0:b1]
            count[b0:b1] += hit.T @ m[a0:a1]
            first = np.where(hit.any(1), hit.argmax(1), -1)
            for i in np.flatnonzero(first >= 0):
                forest.join(a0 + i, b0 + first[i])
            # a further partner of a row joins it unless an earlier row has joined the two already
            rows, cols = np.nonzero(hit[:, :] & (np.arange(hit.shape[1]) != first[:, None]))
            if len(rows):
                key = np.array([forest.find(a0 + i) for i in range(a1 - a0)])[rows] * (len(u) + 1) + cols
                for k in np.unique(key, return_index=True)[1]:
                    forest.join(a0 + int(rows[k]), b0 + int(cols[k]))
            return
        if a0 == b0:
            mid = (a0 + a1) // 2
            walk(a0, mid, a0, mid)
            walk(a0, mid, mid, a1)
            walk(mid, a1, mid, a1)
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            walk(a0, mid, b0, b1)
            walk(mid, a1, b0, b1)
        else:
            mid = (b0 + b1) // 2
            walk(a0, a1, b0, mid)
            walk(a0, a1, mid, b1)

    walk(0, split or len(u), split, len(u))
    return count, forest


def links(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; see the module."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vectors[vec_col].cast("array<double>").alias("v"))
    fine = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    keys = materialize(rows.select("vec_id", "label", "fine", "h1", "h2"), "vectors")
    classes = rows.filter("fine").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("dim", F.size("v")), "classes")
    bases = {}
    fits = classes.orderBy(F.xxhash64("rep"), "rep").select("v", "dim").limit(FIT).collect()
    for dim in {r.dim for r in fits}:
        bases[dim] = directions(unit(np.array([r.v for r in fits if r.dim == dim])))

    def basis(dim: int) -> np.ndarray:
        return bases[dim] if dim in bases else np.eye(dim)[:, :DIRECTIONS]

    def project(batches):
        for batch in batches:
            cells = []
            for v in batch.column(3):
                x = unit(np.array([v.as_py()]))
                c = np.floor(x @ basis(x.shape[1]) / eps)[0].astype(int).tolist()
                cells.append((c + [0] * DIRECTIONS)[:DIRECTIONS])
            cols = [pa.array([c[k] for c in cells], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], ["label", "rep", "copies", "v", "dim", *(f"c{k}" for k in range(4))])

    label_type = classes.schema["label"].dataType.simpleString()
    placed = classes.select("label", "rep", "copies", "v", "dim").mapInArrow(project, f"label {label_type}, rep long, copies long, v array<double>, dim int, c0 int, c1 int, c2 int, c3 int")
    order = ["label", "dim", "c0", "c1", "c2", "c3", "rep"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        base, made, held = TaskContext.get().partitionId() << 32, 0, []

        def block():
            label, dim = held[0][0], held[0][4]
            x = np.array([r[3] for r in held])
            p = unit(x) @ basis(dim)
            cells = sorted({(r[5], r[6]) for r in held})
            data = [[base + made], [label], [dim], [np.array([r[1] for r in held], np.int64).tobytes()], [np.array([r[2] for r in held], np.int64).tobytes()], [x.tobytes()], [p.min(0).tolist()], [p.max(0).tolist()], [[{"x": a, "y": b} for a, b in cells]]]
            return pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, kinds, strict=True)], names)

        names = ["block", "label", "dim", "ids", "copies", "vecs", "lo", "hi", "cells"]
        kinds = None
        for batch in batches:
            kinds = [pa.int64(), batch.schema.field(0).type, pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))]
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == BLOCK or (held[0][0], held[0][4]) != (r[0], r[4])):
                    yield block()
                    made, held = made + 1, []
                held.append(r)
        if held:
            yield block()

    blocks = materialize(ordered.mapInArrow(cut, f"block long, label {label_type}, dim int, ids binary, copies binary, vecs binary, lo array<double>, hi array<double>, cells array<struct<x: int, y: int>>"), "blocks")
    one = blocks.select("label", "dim", F.col("block").alias("i"), F.col("lo").alias("ilo"), F.col("hi").alias("ihi"), F.explode("cells").alias("c")).select("label", "dim", "i", "ilo", "ihi", "c.x", "c.y")
    near = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    two = blocks.select("label", "dim", F.col("block").alias("j"), F.col("lo").alias("jlo"), F.col("hi").alias("jhi"), F.explode("cells").alias("c"))
    two = two.select("label", "dim", "j", "jlo", "jhi", "c", F.explode(near).alias("d")).select("label", "dim", "j", "jlo", "jhi", (F.col("c.x") + F.col("d.dx")).alias("x"), (F.col("c.y") + F.col("d.dy")).alias("y")).distinct()
    touch = F.forall(F.arrays_zip("ilo", "ihi", "jlo", "jhi"), lambda b: (b["ilo"] - b["jhi"] <= eps) & (b["jlo"] - b["ihi"] <= eps))
    pairs = one.join(two, ["label", "dim", "x", "y"]).filter("i <= j").filter(touch).select("i", "j", "dim").distinct()
    side = lambda k, x: blocks.select(F.col("block").alias(k), *(F.col(c).alias(x + c) for c in ("ids", "copies", "vecs")))
    work = pairs.join(side("i", "a"), "i").join(side("j", "b"), "j").select("i", "j", "dim", "aids", "acopies", "avecs", "bids", "bcopies", "bvecs")

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, dim, *data = (c[k].as_py() for c in batch.columns)
                ids, m, x = np.frombuffer(data[0], np.int64), np.frombuffer(data[1], np.int64), np.frombuffer(data[2]).reshape(-1, dim)
                split = 0
                if i != j:
                    split = len(ids)
                    ids, m, x = (np.concatenate(c) for c in ((ids, np.frombuffer(data[3], np.int64)), (m, np.frombuffer(data[4], np.int64)), (x, np.frombuffer(data[5]).reshape(-1, dim))))
                u = unit(x)
                count, forest = join_intervals(u, u @ basis(dim), m, split, eps, cosine)
                at = np.flatnonzero(count)
                if len(at):
                    roots = np.array([forest.find(int(t)) for t in at])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[roots]), pa.array(count[at])], ["a", "b", "n"])

    found = materialize(work.mapInArrow(compare, "a long, b long, n long"), "found")
    comps = connected_components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    done = classes.select("label", "h1", "h2", "rep", "copies").join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    done = materialize(done.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "done")
    linked = hot_join(keys.filter("fine"), done, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = keys.filter("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_sql() -> str:
    """The query's rows in DuckDB: all pairs of a label."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
  s AS (SELECT *, sqrt(list_dot_product(v, v)) AS size, len(v) AS dim FROM v),
  l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM s x JOIN s y ON x.label = y.label AND x.dim = y.dim AND x.vec_id != y.vec_id WHERE list_dot_product(x.v, y.v) / x.size / y.size >= {COSINE}),
  reach AS (SELECT a AS id, a AS r FROM l UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.r), c AS (SELECT id, min(r) AS r FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.r, e.vec_id) AS component_id, coalesce(c.r, e.vec_id) = e.vec_id AS kept FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.id = e.vec_id"""


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
