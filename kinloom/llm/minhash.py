"""Near-duplicate documents: one-permutation hashing, banded buckets, star-shaped candidates, exact confirmation.

A document's set holds the hashes (64 bits) of its distinct runs of five words, A-Z lower-cased; with fewer words, of
the whole run; without words it is empty. One permutation: the top bits of a hash name one of BINS bins, the least hash
of a bin is its value; empty bins borrow from a full one by optimal densification (each tries its own fixed sequence of
bins). ROWS bins make a band and each band a bucket; at a similarity of 0.75, 32 bands of 4 miss 5 pairs in a million.

Documents with equal sets are one class, represented by its least id, before anything is paired. In every bucket,
candidates are stars: each member with STARS centres, the bucket's most popular member (the one whose buckets hold most
members in all: of a group of near copies, the one most like the rest) and others drawn by a hash of the bucket; in
buckets of up to ALL members everyone is a centre in turn. So a bucket gives a number of edges linear in its members,
and two documents that could link meet a common centre, or each other, in about ten buckets. Members first meet one
popular centre each, then the others; last, in large buckets that still hold several components, the members outside of
the bucket's main component meet all members of others (untried()), so that no pair of a bucket stays unseen. Edges are
confirmed only where their ends are still in different components, and dropped unseen only where set sizes rule a link
out, or where the sketches (a byte of each bin) agree less than a similarity of 0.75 would make them by six standard
deviations. All links are confirmed on full sets: 100 * common >= 75 * union.

Skew: copies collapse in a pre-aggregation; joins on a bucket, a class or a centre treat hot keys apart (hot_join);
components are found by contraction over tables. The ends of the edges being confirmed are broadcast to the scan of
the documents only up to BROADCAST rows, and beyond that joined by a shuffle. The last step compares sketches, in blocks
of about MEET members, and puts out plausible pairs alone; its work in a bucket is the number of outside members times
that of all, so it is small where the stars have joined most and quadratic only in members that link with no centre.

Defined cases. Null or empty texts and texts without words have an empty set, no links and are kept. A null id has no
component and is kept. Rows that share an id are one node: what one of their texts links to belongs to all. Equally
popular members of a bucket are ordered by id, and a similarity of exactly 0.75 links. Very long texts are read whole. An
empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, connected_components, drop_table, hot_join, materialize
from .words import HASHES

SHINGLE, PERCENT = 5, 75
BINS, ROWS = 128, 4
STARS, ALL, MEET = 3, 8, 512
BROADCAST, SETS = 500_000, 32 << 20
AT_ONCE = 1000  # texts and sets in an Arrow batch
PROBES = 96
DEVIATIONS = 6
MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FACTORS = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, SHINGLE + 1, dtype=np.uint64)).astype(np.uint64)
_rng = np.random.default_rng(2017)
PROBE = _rng.integers(0, BINS, (BINS, PROBES))
BAND_FACTORS = _rng.integers(1, 1 << 63, (BINS // ROWS, ROWS + 1), dtype=np.uint64) | np.uint64(1)
EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's set."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    if n < 1:
        x = np.array([len(h)], np.uint64)
        for v in h:
            x = mix(x + v)
        return x
    x = h[:n] * FACTORS[0]
    for i in range(1, k):
        x = x + h[i : n + i] * FACTORS[i]
    x = np.sort(mix(x))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def values_of(s: np.ndarray) -> np.ndarray:
    """The values of the bins of a set that isn't empty."""
    at = np.searchsorted(s, EDGES)
    full = np.append(at[1:], len(s)) > at
    values = s[np.minimum(at, len(s) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        hit = full[PROBE[empty]]
        first = hit.argmax(1)
        source = PROBE[empty, first]
        for i in np.flatnonzero(~hit.any(1)):  # all probes empty: the next full bin
            e = empty[i]
            source[i] = (e + 1 + np.argmax(np.roll(full, -e - 1))) % BINS
        values[empty] = values[source]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """The bucket keys; a key holds its band's number."""
    v = values.reshape(-1, ROWS)
    return mix((v * BAND_FACTORS[:, :ROWS]).sum(1, dtype=np.uint64) + BAND_FACTORS[:, ROWS]).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, two checksums of the set, its bucket keys and a byte of each bin (none for an empty set)."""

    def run(batches):
        for batch in batches:
            n, k1, k2, keys, sketch = [], [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py())
                n.append(len(s))
                k1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                k2.append(int((s * MIX[1] ^ (s >> np.uint64(17))).sum(dtype=np.uint64).view(np.int64)))
                values = values_of(s) if len(s) else s
                keys.append(bands(values) if len(s) else [])
                sketch.append(values.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary")


def sketches(column) -> np.ndarray:
    """A row of bytes for each sketch."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def agree(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sketches agree in at least the share that a similarity of 0.75 gives, less DEVIATIONS deviations; n: the lesser set's size."""
    full = BINS * (1 - np.exp(-n / BINS))
    return (x == y).mean(1) >= PERCENT / 100 - DEVIATIONS * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / full)


def plausible(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """The edges whose sketches agree."""

    def run(batches):
        for batch in batches:
            ok = agree(sketches(batch.column(3)), sketches(batch.column(4)), batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    a = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("x"))
    b = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("m"), F.col("sketch").alias("y"))
    rows = hot_join(hot_join(edges, a, ["a"]), b, ["b"]).select("a", "b", F.least("n", "m").alias("n"), "x", "y")
    return rows.mapInArrow(run, "a long, b long")


def confirm(docs: DataFrame, edges: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the distinct edges (a, b), a table, those whose sets are similar enough; as a table.

    The sets of the documents involved are made once. Up to SETS bytes of them in all go to every worker; beyond that
    they are joined to the edges by shuffles.
    """
    ends = edges.select(F.col("a").alias("doc_id")).unionByName(edges.select(F.col("b").alias("doc_id"))).distinct()
    ends = materialize(ends, "ends")
    few = F.broadcast(ends) if ends.count() <= BROADCAST else ends
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(few, "doc_id")

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["doc_id", "s"])

    held = materialize(rows.mapInArrow(sets, "doc_id long, s binary").distinct(), "sets")  # rows of one id with other texts have several
    size = held.agg(F.coalesce(F.sum(F.octet_length("s") + 16), F.lit(0))).first()[0]

    def alike(s: np.ndarray, t: np.ndarray) -> bool:
        both = len(s) + len(t)
        if 100 * min(len(s), len(t)) < PERCENT * max(len(s), len(t)):
            return False
        x = np.sort(np.concatenate([s, t]), kind="stable")
        common = int((x[1:] == x[:-1]).sum())
        return 100 * common >= PERCENT * (both - common)

    if size <= SETS:
        found = held.toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(list(zip(found.column("doc_id").to_pylist(), found.column("s").to_pylist(), strict=True)))

        def compare(batches):
            known: dict[int, list] = {}
            for i, s in shared.value:
                known.setdefault(i, []).append(np.frombuffer(s, np.uint64))
            for batch in batches:
                ok = [any(alike(s, t) for s in known.get(a, ()) for t in known.get(b, ())) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield batch.filter(pa.array(ok, pa.bool_()))

        links = materialize(edges.select("a", "b").mapInArrow(compare, "a long, b long").distinct(), "links")
        shared.unpersist()
    else:
        half = materialize(hot_join(edges.select("a", "b"), held.select(F.col("doc_id").alias("a"), "s"), ["a"]), "half")
        pairs = hot_join(half, held.select(F.col("doc_id").alias("b"), F.col("s").alias("t")), ["b"])

        def compare(batches):
            for batch in batches:
                ok = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        links = materialize(pairs.select("a", "b", "s", "t").mapInArrow(compare, "a long, b long").distinct(), "links")
        drop_table(half)
    for table in (ends, held):
        drop_table(table)
    return links


def buckets(classes: DataFrame) -> DataFrame:
    """(key, rep, n, size, centers) for the members of every bucket of several classes; as a table. n: the set's size.

    centers: structs (c, cn) of the most popular member first, then of STARS - 1 drawn by hash; up to ALL members, of all.
    """
    members = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    held = materialize(hot_join(members, sizes, ["key"]), "members")
    pops = held.groupBy("rep").agg(F.sum("size").alias("pop"))
    known = materialize(held.join(pops, "rep"), "members")
    who = F.struct(F.col("rep").alias("c"), F.col("n").alias("cn"))
    drawn = [F.min_by(who, F.xxhash64("rep", "key", F.lit(i))).alias(f"r{i}") for i in range(1, STARS)]
    large = known.filter(F.col("size") > ALL).groupBy("key").agg(F.max_by(who, F.struct("pop", -F.col("rep"))).alias("r0"), *drawn)
    small = known.filter(F.col("size") <= ALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("pop")).alias("p"), who.alias("w")))).alias("ws"))
    centers = large.select("key", F.array(*(f"r{i}" for i in range(STARS))).alias("centers")).unionByName(small.select("key", F.transform("ws", lambda x: x["w"]).alias("centers")))
    out = materialize(hot_join(known.select("key", "rep", "n", "size"), materialize(centers, "centers"), ["key"]), "buckets")
    drop_table(held)
    drop_table(known)
    return out


def near(n: str, m: str):
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def pair(x, y):
    return F.greatest(x, y).alias("a"), F.least(x, y).alias("b")


def labelled(rows: DataFrame, labels: DataFrame, col: str, out: str) -> DataFrame:
    """rows with the component (out) of the node in col."""
    return rows.join(labels.select(F.col("node").alias(col), F.col("component").alias(out)), col, "left").withColumn(out, F.coalesce(out, col))


def one_id(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes that rows of one id belong to; as a table."""
    key = ["n_shingles", "k1", "k2"]
    several = sets.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).filter("x != y").select("doc_id")
    several = materialize(several, "several")
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    mine = sets.join(several, "doc_id", "left_semi").select("doc_id", *key).distinct().join(classes.select("rep", *key), key).groupBy("doc_id", "rep").agg(F.lit(1)).select("doc_id", "rep")
    mine = materialize(mine, "mine")
    least = mine.groupBy("doc_id").agg(F.min("rep").alias("least"))
    return materialize(mine.join(least, "doc_id").filter("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct(), "one-id")


class Outside:
    """Members (rep, n, comp, sketch) outside of their bucket's main component, by bucket key."""

    def __init__(self, rows: pa.Table):
        rep, keys = rows.column("rep").to_numpy(), rows.column("key").to_numpy()
        self.rep, first, at = np.unique(rep, return_index=True, return_inverse=True)
        self.n, self.comp = (rows.column(c).to_numpy()[first] for c in ("n", "comp"))
        self.sketch = sketches(rows.column("sketch").take(pa.array(first)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]

    def meet(self, rep: int, n: int, comp: int, keys: np.ndarray, sketch: bytes) -> np.ndarray:
        """The members of other components in these buckets that a member plausibly links with."""
        spans = zip(np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right"), strict=True)
        at = np.unique(np.concatenate([self.at[i:j] for i, j in spans]))
        m = self.n[at]
        least = np.minimum(m, n)
        ok = (self.comp[at] != comp) & (100 * least >= PERCENT * np.maximum(m, n))
        at, least = at[ok], least[ok]
        return self.rep[at[agree(self.sketch[at], np.frombuffer(sketch, np.uint8), least)]]


def untried(docs: DataFrame, held: DataFrame, classes: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between members of large buckets that are in different components; as a table.

    A bucket's main component is the one with most of its members; the members outside meet all others. If those outside
    and their sets are at most SETS bytes, they go to every worker, which scans the classes once: a member comes out with
    the list of those it plausibly links with, and its set is compared with theirs; one link to each component is enough.
    Beyond that, blocks of about MEET members meet by shuffles, and the plausible pairs are confirmed like other edges.
    """
    large = held.filter(F.col("size") > ALL).select("rep").distinct()
    known = labelled(classes.select("rep", F.col("n_shingles").alias("n"), "bands", "sketch").join(large, "rep", "left_semi"), labels, "rep", "comp")
    known = materialize(known.select("rep", "n", "comp", "bands", "sketch"), "known")
    parts = known.select("comp", F.explode("bands").alias("key")).groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    tops = parts.groupBy("key").agg(F.max_by("comp", F.struct("m", -F.col("comp"))).alias("main"), F.sum("m").alias("size"), (F.sum("m") - F.max("m")).alias("outside"))
    tops = materialize(tops.filter((F.col("size") > ALL) & (F.col("outside") > 0)), "main")
    whole = known.select("rep", "n", "comp", "sketch", F.explode("bands").alias("key"))
    cols = ["key", "rep", "n", "comp", "sketch"]
    outside = materialize(hot_join(whole, tops, ["key"]).filter("comp != main").select(*cols, "size", "outside"), "outside")
    sizes = outside.groupBy("rep").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n")).agg(F.sum(F.col("m") * (BINS + 64) + 8 * F.col("n"))).first()[0]
    if not sizes:
        links = materialize(known.select(F.col("rep").alias("a"), F.col("comp").alias("b")).limit(0), "links")
    elif sizes <= SETS:
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast(outside.select(*cols).toArrow())

        def run(batches):
            out = Outside(shared.value)
            for batch in batches:
                keys = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, BINS // ROWS)
                among = np.isin(keys, out.keys)
                rep, others = [], []
                for i in np.flatnonzero(among.any(1)).tolist():
                    met = out.meet(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), keys[i][among[i]], batch.column(4)[i].as_py())
                    if len(met):
                        rep.append(batch.column(0)[i].as_py())
                        others.append(met)
                yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(others, pa.list_(pa.int64()))], ["rep", "others"])

        met = materialize(known.mapInArrow(run, "rep long, others array<long>"), "met")
        rows = docs.select(docs[id_col].cast("long").alias("rep"), docs[text_col].alias("text"))

        def sets(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary()), batch.column(2)], ["rep", "s", "comp"])

        theirs = outside.select("rep", "comp").distinct()  # at most SETS bytes
        found = rows.join(F.broadcast(theirs), "rep").select("rep", "text", "comp").mapInArrow(sets, "rep long, s binary, comp long").distinct().toArrow()
        with_sets = spark.sparkContext.broadcast(found)
        few = rows.join(F.broadcast(met.select("rep")), "rep", "left_semi") if met.count() <= BROADCAST else rows

        def compare(batches):
            held_ = with_sets.value
            ids, comps = held_.column("rep").to_numpy(), held_.column("comp").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, comps = ids[order], comps[order]
            values = [np.frombuffer(held_.column("s")[i].as_py(), np.uint64) for i in order.tolist()]
            for batch in batches:
                a, b = [], []
                for rep, text, others in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    s, o = shingles(text.as_py()), others.values.to_numpy()
                    at = np.concatenate([np.arange(i, j) for i, j in zip(np.searchsorted(ids, o), np.searchsorted(ids, o, "right"), strict=True)])
                    sizes = np.array([len(values[i]) for i in at.tolist()])
                    at, sizes = at[sizes > 0], sizes[sizes > 0]
                    if not len(at) or not len(s):
                        continue
                    flat = np.concatenate([values[i] for i in at.tolist()])
                    same = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
                    common = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                    at = at[100 * common >= PERCENT * (len(s) + sizes - common)]
                    one = ids[at[np.unique(comps[at], return_index=True)[1]]]
                    a.extend(np.maximum(one, rep).tolist())
                    b.extend(np.minimum(one, rep).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        links = materialize(few.join(met, "rep").select("rep", "text", "others").mapInArrow(compare, "a long, b long").distinct(), "links")
        shared.unpersist()
        with_sets.unpersist()
        drop_table(met)
    else:
        blocks = lambda c: F.ceil(F.col(c) / MEET).cast("int")
        mine = lambda c: F.pmod(F.xxhash64("rep"), blocks(c)).cast("int")
        each = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
        left = outside.select(*cols, mine("outside").alias("i"), each("size").alias("j"))
        right = hot_join(whole, tops, ["key"]).select(*cols, mine("size").alias("j"), each("outside").alias("i"))

        def both(x: pa.Table, y: pa.Table) -> pa.Table:
            a, b = [], []
            if x.num_rows:
                out = Outside(x)
                for r in y.to_pylist():
                    met = out.meet(r["rep"], r["n"], r["comp"], np.array([r["key"]]), r["sketch"])
                    a.extend(np.maximum(met, r["rep"]).tolist())
                    b.extend(np.minimum(met, r["rep"]).tolist())
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        met = left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInArrow(both, "a long, b long")
        edges = materialize(met.distinct(), "edges")
        links = confirm(docs, edges, id_col, text_col)
        drop_table(edges)
    for table in (known, tops, outside):
        drop_table(table)
    return links


def widened(links: DataFrame, labels: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, labels) with a table of new links."""
    if new.isEmpty():
        return links, labels
    links = links.unionByName(new)
    return links, connected_components(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; see the module."""
    with arrow_rows(docs.sparkSession, AT_ONCE):
        return _near_duplicates(docs, id_col, text_col)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    sig = materialize(signatures(docs, id_col, text_col), "signatures")
    sets = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(sets.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    held = buckets(classes.select("rep", "n_shingles", "bands"))

    # each member with one popular centre, that of its largest bucket
    first = F.col("centers")[0]
    firsts = held.select("rep", "n", "size", first["c"].alias("c"), first["cn"].alias("cn")).filter("rep != c").filter(near("n", "cn"))
    tried = materialize(firsts.groupBy("rep").agg(F.max(F.struct("size", "c")).alias("x")).select(F.col("rep").alias("a"), F.col("x.c").alias("b")), "tried")
    links = confirm(docs, tried, id_col, text_col).unionByName(one_id(sets, classes))
    labels = connected_components(links)
    # all other edges of the stars whose ends are still apart
    stars = held.select("rep", "n", F.explode("centers").alias("x")).select("rep", "n", "x.c", "x.cn").filter("rep != c").filter(near("n", "cn"))
    apart = labelled(labelled(stars.select(*pair(F.col("rep"), F.col("c"))).distinct(), labels, "a", "ca"), labels, "b", "cb").filter("ca != cb").select("a", "b")
    first = materialize(apart.join(tried.select(*pair(F.col("a"), F.col("b"))), ["a", "b"], "left_anti"), "rest")
    likely = materialize(plausible(first, classes), "likely")
    drop_table(first)
    if not likely.isEmpty():
        links, labels = widened(links, labels, confirm(docs, likely, id_col, text_col))
    drop_table(likely)
    # and the pairs of large buckets that no star has
    _, labels = widened(links, labels, untried(docs, held, classes, labels, id_col, text_col))
    drop_table(held)
    tops = materialize(labelled(classes.select("n_shingles", "k1", "k2", "rep"), labels, "rep", "component_id"), "tops")
    ids = hot_join(sets.select("doc_id", "n_shingles", "k1", "k2"), tops.select("n_shingles", "k1", "k2", "component_id"), ["n_shingles", "k1", "k2"])
    ids = ids.select("doc_id", "n_shingles", "component_id")
    alone = sig.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return ids.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_sql() -> str:
    """The query's rows in DuckDB: all pairs that share a shingle, on full sets."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + {SHINGLE - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM sh x JOIN sh y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= {PERCENT} * (x.n + y.n - both_)),
  u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach AS (SELECT a AS id, a AS r FROM u UNION SELECT reach.id, u.b FROM reach JOIN u ON u.a = reach.r), c AS (SELECT id, min(r) AS r FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.r, d.doc_id) AS component_id, coalesce(c.r, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
