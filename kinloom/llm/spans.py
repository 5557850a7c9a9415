"""Substring deduplication by sliding sentence spans.

A text's words are the runs of characters other than space and the ASCII controls 9 to 13. A sentence ends after a
word that ends in a full stop, exclamation or question mark and, as passages are also pasted in the middle of sentences,
after the word of least hash of any WINDOW consecutive ones: so none is longer than WINDOW words, and where it ends
depends on fewer than WINDOW words around, wherever a passage stands and however its lines are broken. Every run of consecutive sentences that has at least
SENTENCES of them and MIN_WORDS words, and no shorter one from the same start, is a span. Spans are hashed (64 bits of
a polynomial over word hashes), brought together by hash, and of equal ones all but the first by (doc_id, place) are
repeats; sentences that a repeat covers are removed from the text.

Any 50 words in a row that two texts share hold a span of both. Ends from the 8th to the 43rd word are the same in
both, the first of them is at most the 15th, and a span from there takes 27 words at most. What is left of a repeated
passage is at its edges: at most 15 words before and 21 after.

Skew: each worker compares its own spans first, in blocks. A span that isn't the first of its block can't be the first
of all, so it is a repeat without any exchange, and a key comes to the exchange once a block at most. Keys that hold
more than 1/HOT of the rows even so, as a sample of about SAMPLE rows tells, get their first by a pre-aggregated minimum
that is broadcast (HOT rows at most); whether a key is found hot changes the way, not the result. Documents meet the
spans to remove by id, hot ids apart (hot_join).

Defined cases. A null text stays null and an empty one empty. Rows with a null id are left as they are, never leave
their partition and count for nothing. Rows that share an id count as one document: their equal spans at equal places
aren't repeats of each other, and a removal applies only where the row's own words carry the span's hash. Texts too
short for a span never change. Of equal spans that start at one place of one id all are first. An empty table gives no
rows. Texts are read whole, however long. Columns in carry of an added one's name, or the text's, are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T  # noqa: N812

from .common import drop_table, hot_join, materialize, passed, slices
from .words import HASHES

SENTENCES, MIN_WORDS, WINDOW = 3, 20, 8
BLOCK = 1 << 18
HOT, SAMPLE = 1024, 1 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
ADDED = ["n_sentences", "n_removed_sentences", "n_removed_words"]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1024
        while size < n:
            size *= 2
        have = np.empty(size, np.uint64)
        have[0] = 1
        at, step = 1, base
        while at < size:  # doubling
            have[at : 2 * at] = have[:at] * np.uint64(step & (1 << 64) - 1)
            at, step = at * 2, step * step % (1 << 64)
        _powers[base] = have
    return have[:n]


def sentences(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, word number after the end of each sentence) of a text."""
    words = data.split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, n)
    end = (h & np.uint64(1)).astype(bool)
    near = np.lib.stride_tricks.sliding_window_view(h, min(n, WINDOW))
    end[near.argmin(1) + np.arange(len(near))] = True
    end[-1] = True
    ends = np.flatnonzero(end) + 1
    return h, ends


def spans(h: np.ndarray, ends: np.ndarray, count: int = SENTENCES, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, hash) of every span."""
    starts = np.concatenate([[0], ends[:-1]])
    last = np.maximum(np.searchsorted(ends, starts + min_words), np.arange(len(ends)) + count - 1)
    ok = last < len(ends)
    i, j = starts[ok], ends[last[ok]]
    n = len(h)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(BASE, n), out=sums[1:])
    x = (sums[j] - sums[i]) * powers(UNBASE, n)[i] if n else sums[:0]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return i, j, (x ^ (x >> np.uint64(32))).view(np.int64)


def all_spans(docs: DataFrame, count: int = SENTENCES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, doc_id, start, stop, again) of every span; again: an equal one comes before it in its worker's block."""

    def block(parts: list[tuple]) -> pa.RecordBatch:
        doc, i, j, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((i, doc, h))
        order = order[np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(doc[order]) != 0) | (np.diff(i[order]) != 0)])]
        doc, i, j, h = doc[order], i[order], j[order], h[order]
        new = np.concatenate([[True], (h[1:] != h[:-1])])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = (doc != doc[lead]) | (i != i[lead])
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(again)], ["h", "doc_id", "start", "stop", "again"])

    def run(batches):
        parts, room = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                i, j, h = spans(*sentences(text.as_py().encode("utf-8", "replace")), count, min_words)
                if len(i):
                    parts.append((np.full(len(i), doc, np.int64), i, j, h))
                    room += len(i)
                if room >= BLOCK:
                    yield block(parts)
                    parts, room = [], 0
        if parts:
            yield block(parts)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "h long, doc_id long, start int, stop int, again boolean")


def hot_spans(spans_: DataFrame) -> list[int]:
    """The hashes that hold more than 1/HOT of a sample of the rows; fewer than HOT."""
    total = spans_.count()
    if not total:
        return []
    part = spans_.sample(min(1.0, SAMPLE / total), seed=11) if total > SAMPLE else spans_
    least = max(2, min(total, SAMPLE) / HOT)
    return [r.h for r in part.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).select("h").collect()]


def repeats(docs: DataFrame, count: int = SENTENCES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, removed) with the spans (start, stop, h) of a document that aren't the first of their kind; as a table."""
    found = materialize(all_spans(docs, count, min_words, id_col, text_col), "spans")
    alone = found.filter("NOT again").select("doc_id", "start", "stop", "h")
    hot = hot_spans(alone)
    place = F.rank().over(Window.partitionBy("h").orderBy("doc_id", "start"))
    cold = alone.filter(~F.col("h").isin(hot)) if hot else alone
    late = cold.withColumn("rank", place).filter("rank > 1").drop("rank")
    if hot:
        warm = alone.filter(F.col("h").isin(hot))
        first = warm.groupBy("h").agg(F.min(F.struct("doc_id", "start")).alias("first"))
        late = late.unionByName(warm.join(F.broadcast(first), "h").filter(F.struct("doc_id", "start") != F.col("first")).drop("first"))
    every = late.unionByName(found.filter("again").select("doc_id", "start", "stop", "h"))
    lists = every.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop", "h")).alias("removed"))
    out = materialize(lists, "repeats")
    drop_table(found)
    return out


def cleaned(text: str, removed: list[dict], count: int, min_words: int) -> tuple[str, int, int, int]:
    """The text without the sentences under removed spans; sentences, those removed, words removed."""
    data = text.encode("utf-8", "replace")
    h, ends = sentences(data)
    i, j, own = spans(h, ends, count, min_words)
    here = dict(zip(i.tolist(), zip(j.tolist(), own.tolist(), strict=True), strict=True))
    gone = np.zeros(len(h) + 1, np.int64)
    for r in removed:
        if here.get(r["start"]) == (r["stop"], r["h"]):
            gone[r["start"]] += 1
            gone[r["stop"]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    if not gone.any():
        return text, len(ends), 0, 0
    at = [m.start() for m in WORD.finditer(data)] + [len(data)]
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    out, last = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(data[last : at[a]])
        last = at[b]
    out.append(data[last:])
    return b"".join(out).decode("utf-8", "replace").rstrip() if last == len(data) else b"".join(out).decode("utf-8", "replace"), len(ends), int(gone[ends - 1].sum()), int(gone.sum())


def dedup(docs: DataFrame, carry: list[str], count: int = SENTENCES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns in carry, the text without repeats, and ADDED."""
    lists = repeats(docs, count, min_words, id_col, text_col)
    df, kept, _ = passed(docs, [c for c in carry if c.lower() != text_col.lower()], ADDED, text_col)
    own = docs.select(F.struct(*(docs[f"`{c}`"] for c in kept)).alias("row") if kept else F.lit(None).alias("row"), docs[text_col].alias("text"), docs[id_col].cast("long").alias("doc_id"))
    known = hot_join(own.filter("doc_id IS NOT NULL"), lists, ["doc_id"], "left").select("row", "text", "removed")
    rows = known.unionByName(own.filter("doc_id IS NULL").select("row", "text", F.lit(None).cast(lists.schema["removed"].dataType).alias("removed")))
    free = df.columns[-1] + "_"
    while free in kept:
        free += "_"
    rows = rows.select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("text").alias(df.columns[-1]), F.col("removed").alias(free))
    schema = T.StructType([*rows.schema.fields[: len(kept)], T.StructField(text_col, T.StringType()), *(T.StructField(c, T.LongType()) for c in ADDED)])
    names, at = schema.names, len(kept)

    def run(batches):
        for batch in slices(batches, at):
            texts, stats = [], []
            for text, removed in zip(batch.column(at), batch.column(at + 1), strict=True):
                t, r = text.as_py(), removed.as_py()
                if t and r:
                    t, *s = cleaned(t, r, count, min_words)
                else:
                    s = [len(sentences(t.encode("utf-8", "replace"))[1]) if t else 0, 0, 0]
                texts.append(t)
                stats.append(s)
            cols = zip(*stats, strict=True) if stats else [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names)

    return rows.mapInArrow(run, schema)


def op6_sql() -> str:
    """The query's rows in DuckDB; spans are compared as words, and only the order of hashed words is taken from the hash."""
    space = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]+"
    return f"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS w, regexp_extract_all(text, '{word}{space}*') AS parts, regexp_extract(text, '^{space}*') AS head FROM documents),
  w AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(parts) AS part, generate_subscripts(w, 1) AS i FROM d),
  m AS (SELECT *, min({{'h': md5_number_lower(word), 'i': i}}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS least FROM w),
  e AS (SELECT doc_id, i FROM w WHERE i = n OR regexp_matches(word, '[.!?]$') UNION SELECT doc_id, least.i FROM m WHERE i <= greatest(n - {WINDOW - 1}, 1)),
  s AS (SELECT doc_id, i AS stop, lag(i, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS start, lead(i, {SENTENCES - 1}) OVER (PARTITION BY doc_id ORDER BY i) AS least_stop FROM e),
  f AS (SELECT s.doc_id, s.start, e.i AS stop FROM (SELECT *, greatest(least_stop, start + {MIN_WORDS}) AS least FROM s WHERE least_stop IS NOT NULL) s ASOF JOIN e ON s.doc_id = e.doc_id AND s.least <= e.i),
  k AS (SELECT f.doc_id, start, stop, md5(array_to_string(w[start + 1 : stop], ' ')) AS key FROM f JOIN d USING (doc_id)),
  r AS (SELECT doc_id, start, stop FROM (SELECT *, min({{'d': doc_id, 's': start}}) OVER (PARTITION BY key) AS first FROM k) WHERE first.d != doc_id OR first.s != start),
  g AS (SELECT DISTINCT doc_id, unnest(range(start + 1, stop + 1)) AS i FROM r),
  c AS (SELECT doc_id, count(*) AS n_removed_words, max(i) AS last FROM g GROUP BY doc_id), rs AS (SELECT doc_id, count(*) AS n FROM g JOIN e USING (doc_id, i) GROUP BY doc_id), ns AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
  left_ AS (SELECT doc_id, string_agg(part, '' ORDER BY i) AS text FROM w WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = w.doc_id AND g.i = w.i) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN d.text WHEN c.last = len(d.w) THEN regexp_replace(head || coalesce(left_.text, ''), '{space}+$', '') ELSE head || left_.text END AS text,
  coalesce(ns.n, 0) AS n_sentences, coalesce(rs.n, 0) AS n_removed_sentences, coalesce(c.n_removed_words, 0) AS n_removed_words
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN rs ON rs.doc_id = d.doc_id LEFT JOIN ns ON ns.doc_id = d.doc_id LEFT JOIN left_ ON left_.doc_id = d.doc_id"""


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
