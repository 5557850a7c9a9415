"""Language identification by prediction by partial matching over bytes, with frozen statistics.

Each language has a tree of byte contexts of order 0 to 3. A byte seen in a context costs its count over total plus
distinct; a byte not seen there costs the escape, distinct over total plus distinct, and what the next shorter context
charges, down to a uniform order -1. The statistics never change while a text is scored, so the cost of a byte depends
on its context's node alone: the trees of all languages are compiled into one table (node, byte, language), and the
exact code length of a text is a sum of look-ups. The shortest code wins; the score is its share of two to the minus
code lengths.

Texts are read as UTF-8 with A-Z lower-cased and all other ASCII characters but letters and the apostrophe as one
symbol. The trees are fitted on a bounded sample of distinct labelled texts, alike at every size: by order of a hash of
the text, up to PER_LANGUAGE a language, and over all languages TEXTS texts and BYTES bytes, of which each has an equal
share. The table is bounded by TABLE bytes (and holds a node for each symbol in any case): of the contexts of two and
three symbols that occur, the most frequent have nodes, and the others are charged as the next shorter one. Every text
is scored whole.

Defined cases. A null text, or one without a letter (a character of Unicode category L), is "und" with score 0. A null
id is allowed (and not held out). If no row has a language, everything is "und". Ties go to the language that sorts
first. A text that occurs in several rows of one language is learned once; repeated rows, and rows that share an id, are
predicted one by one. Very long texts are scored in parts whose code lengths add up. An empty table gives no rows.
Other columns are not read; those named in carry go through, but for lang_pred and score, which are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T  # noqa: N812

from .common import drop_table, materialize, passed, slices

ORDER = 3
PER_LANGUAGE, TEXTS, BYTES = 512, 1 << 14, 1 << 24
TABLE = 48 << 20
SALTS = 64
CHUNK = 1 << 19
ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether a character is of Unicode category L."""
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def symbols(data: bytes) -> np.ndarray:
    """The bytes of a text, other ASCII characters as one."""
    return FOLD[np.frombuffer(data, np.uint8)]


FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
FOLD[ord("'")] = ord("'")
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


class Model:
    """Compiled trees; langs in order of name."""

    def __init__(self, langs: list[str], index: np.ndarray, size: int, nodes: np.ndarray, cost: np.ndarray):
        self.langs, self.index, self.size, self.nodes, self.cost = langs, index, size, nodes, cost

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of every text (row) by every language."""
        out = np.zeros((len(texts), len(self.langs)))
        held: list[tuple[int, np.ndarray]] = []
        room = 0
        for i, text in enumerate(texts):
            s = self.index[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
            for at in range(0, len(s), CHUNK):
                head = s[max(0, at - ORDER) : at]
                held.append((i, np.concatenate([np.zeros(ORDER - len(head), s.dtype), head, s[at : at + CHUNK]])))
                room += len(held[-1][1])
                if room >= CHUNK:
                    self._add(out, held)
                    held, room = [], 0
        if held:
            self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, np.ndarray]]) -> None:
        s = np.concatenate([x for _, x in held])
        ends = np.cumsum([len(x) for _, x in held])
        wide = s.astype(np.int32)
        context = (wide[:-3] * self.size + wide[1:-2]) * self.size + wide[2:-1]
        bits = self.cost[self.nodes[context] * self.size + wide[3:]]
        starts = np.concatenate([[0], ends[:-1]])
        for i in range(1, len(starts)):  # the first symbols of a text have no context in the text before it
            bits[starts[i] - ORDER : starts[i]] = 0
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
        np.add.at(out, [i for i, _ in held], sums)


def fit(samples: dict[str, list[str]], room: int = TABLE) -> Model:
    """Trees of each language from its texts, compiled into a table of up to room bytes."""
    langs = sorted(samples)
    coded = {x: [symbols(t.encode("utf-8", "replace")) for t in samples[x]] for x in langs}
    seen = np.zeros(256, bool)
    for parts in coded.values():
        for p in parts:
            seen[p] = True
    seen[32] = False
    present = np.flatnonzero(seen)
    size = len(present) + 2  # 0: other ASCII; the last: bytes not seen in training
    index = np.full(256, size - 1, np.uint8)
    index[present] = np.arange(1, len(present) + 1)
    index[32] = 0
    index = index[FOLD]
    grams = {}
    for x in langs:
        parts = [np.concatenate([np.zeros(ORDER, np.int64), index[p].astype(np.int64)]) for p in coded[x]]
        codes = [((p[:-3] * size + p[1:-2]) * size + p[2:-1]) * size + p[3:] for p in parts if len(p) > ORDER]
        grams[x] = np.unique(np.concatenate(codes) if codes else np.empty(0, np.int64), return_counts=True)
    # the contexts of two and three symbols by frequency, shorter ones first, so that a context's shorter one has a node too
    every = np.concatenate([g // size for g, _ in grams.values()]) if langs else np.empty(0, np.int64)
    times = np.concatenate([n for _, n in grams.values()]) if langs else np.empty(0, np.int64)
    found = []
    for order in (2, 3):
        codes, which = np.unique(every % size**order, return_inverse=True)
        found.append(np.stack([np.full(len(codes), order), codes, np.bincount(which, times, len(codes)).astype(np.int64)]))
    order, codes, n = np.concatenate(found, 1)
    most = max(0, room // (4 * size * max(1, len(langs))) - size)
    best = np.lexsort((codes, order, -n))[:most]
    two, three = (np.sort(codes[best][order[best] == k]) for k in (2, 3))
    nodes = np.tile(np.arange(size, dtype=np.int32), size)
    nodes[two] = size + np.arange(len(two), dtype=np.int32)
    nodes = np.tile(nodes, size)
    nodes[three] = size + len(two) + np.arange(len(three), dtype=np.int32)

    def charged(gram: np.ndarray, count: np.ndarray, kept: np.ndarray, k: int, lower: np.ndarray) -> np.ndarray:
        """Probabilities of all symbols in the kept contexts of k symbols, by those of the next shorter ones."""
        context = gram % size ** (k + 1) // size
        at = np.minimum(np.searchsorted(kept, context), max(len(kept) - 1, 0))
        here = kept[at] == context if len(kept) else np.zeros(len(gram), bool)
        table = np.bincount(at[here] * size + gram[here] % size, count[here], len(kept) * size).reshape(-1, size)
        total, distinct = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
        spread = np.maximum(total + distinct, 1)
        q = np.where(total == 0, lower, np.where(table > 0, table / spread, distinct / spread * lower))
        return np.where(distinct == size, table / np.maximum(total, 1), q)

    cost = np.empty(((size + len(two) + len(three)) * size, len(langs)), np.float32)
    for i, x in enumerate(langs):
        gram, count = grams[x]
        p0 = charged(gram, count, np.zeros(1, np.int64), 0, np.full((1, size), 1 / size))
        p1 = charged(gram, count, np.arange(size), 1, np.repeat(p0, size, 0))
        p2 = charged(gram, count, two, 2, p1[two % size])
        p3 = charged(gram, count, three, 3, p2[np.searchsorted(two, three % size**2)])
        cost[:, i] = -np.log2(np.concatenate([p1, p2, p3])).ravel()
    return Model(langs, index, size, nodes, cost)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Distinct texts of each language, of those that aren't held out, by order of a hash; bounds as the module says."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    known = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(~held_out("doc_id")).filter(F.octet_length("text") <= BYTES).withColumn("h", F.xxhash64("text"))
    texts = known.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"), F.max(F.octet_length("text")).alias("size"))
    rank = Window.partitionBy("lang", "salt").orderBy("h")
    least = texts.withColumn("salt", F.pmod("h", F.lit(SALTS))).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= max(1, per_language // SALTS))
    least = materialize(least.select("lang", "h", "doc_id", "size"), "texts")
    n = max(1, least.select("lang").distinct().count())
    upto = Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    fits = least.filter(F.col("size") <= BYTES // n).select("*", F.sum("size").over(upto).alias("upto"), F.count(F.lit(1)).over(upto).alias("place"))
    fits = fits.filter((F.col("upto") <= BYTES // n) & (F.col("place") <= max(1, TEXTS // n))).select("lang", "h", "doc_id")
    picked = known.join(F.broadcast(fits), ["lang", "h", "doc_id"], "left_semi").select("lang", "text").distinct()
    out: dict[str, list[str]] = {}
    for r in sorted(picked.collect()):
        out.setdefault(r.lang, []).append(r.text)
    drop_table(least)
    return out


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, **names) -> Model:
    return fit(sample(docs, **names))


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score; with carry: those columns of docs and lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if carry is None:
        docs = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), docs[text_col].alias("text"))
        carry, text_col = ["doc_id", "held_out"], "text"
    df, kept, at = passed(docs, carry, ["lang_pred", "score"], text_col)
    schema = T.StructType([*df.schema.fields[: len(kept)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            real = [i for i, t in enumerate(texts) if m.langs and has_letter(t)]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if real:
                bits = m.lengths([texts[i] for i in real])
                best = bits.argmin(1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                for i, b, s in zip(real, best, share, strict=True):
                    pred[i], score[i] = m.langs[b], s
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    return df.mapInArrow(run, schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs))
