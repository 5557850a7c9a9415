"""Quality rules: an isolation forest on rule statistics, with a threshold calibrated from labelled rows.

Every text is read whole: its words are the runs of characters other than space and the ASCII controls 9 to 13, its
lines end at line feeds. The counts of rule_counts() give the base rules (too few words, too much repetition) and,
as rates, the features of the forest. The forest is grown on documents labelled good that pass the base rules (a
bounded sample, SAMPLE rows by order of a hash of the id): trees of random splits over random subsets. Anomalous
documents are isolated by few splits, so a short mean path is a high anomaly score, 2 to the minus path over the
expected path. The threshold is the one that separates labelled rows best (Youden's index) among those that keep at
least KEEP_GOOD of the good ones, OUTLIERS (rows labelled wrongly) not counted.

Defined cases. A null or empty text has zero counts and fails the base rules. Without labelled good rows there is no
forest and the base rules alone decide; without bad ones the threshold is the KEEP_GOOD quantile of the good. Labels
that are null don't count, a document labelled twice is good if its highest label is. Repeated rows, and rows that share
an id, are judged one by one; of labelled ones that share an id, the least counts are the forest's sample, and all set
the threshold. A score equal to the threshold is kept. Very long texts are counted whole. An empty table gives no rows.
Columns named in carry go through, but for those of the result's names, which are replaced.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T  # noqa: N812

from .common import passed, slices

SAMPLE = 20_000
TREES, SUBSET = 200, 256
KEEP_GOOD, OUTLIERS = 0.995, 2
BINS = 1 << 16
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_caps_words"]
SYMBOLS = re.compile(r"[#*$%&|<>]")
LETTERS, DIGITS, MARKS = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"[!?;:\"()\[\]{}=_~^\\/@+]")
SPACES = " \t\n\x0b\x0c\r"
_KIND = np.zeros(256, np.int64)  # of UTF-8 bytes: 1 upper, 2 lower, 3 digit, 4 symbol, 5 mark, 6 lead byte of a longer character
for _kind, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!?;:\"()[]{}=_~^\\/@+", bytes(range(0xC2, 0xF5))), 1):
    _KIND[list(_chars)] = _kind


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three words that occurs twice or more, first occurrences included."""
    if len(ids) < 4:
        return 0
    wide = int(ids.max()) + 1
    pairs = np.unique(ids[:-2] * wide + ids[1:-1], return_inverse=True)[1] if wide > 1 << 21 else ids[:-2] * wide + ids[1:-1]
    keys = pairs * wide + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= again
    return int(covered.sum())


def rule_counts(text: str | None) -> list[int]:
    """COUNTS and MORE of a text."""
    if not text:
        return [0] * 11
    data = text.encode("utf-8", "replace")
    words = data.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = data.split(b"\n")
    full = [x for x in lines if not x.isspace() and x]
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    caps = sum(1 for w in number if w.isupper() and len(w) > 2)
    return [len(words), chars, int(kinds[4]), len(full) - len(set(full)), repeat_words(ids), len(full), int(kinds[1]), int(kinds[1] + kinds[2] + kinds[6]), int(kinds[3]), int(kinds[5]), caps]


def features(counts: np.ndarray) -> np.ndarray:
    """Rates from rows of counts: one column a statistic."""
    words, chars, symbols, dup, repeat, lines, upper, letters, digits, marks, caps = np.maximum(counts, 0).astype(np.float64).T
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack([np.minimum(chars / w, 40), np.minimum(symbols / w, 3), dup / np.maximum(lines, 1), repeat / w, upper / np.maximum(letters, 1), digits / c, np.minimum(marks / w, 3), 1 - letters / c, np.log1p(words / np.maximum(lines, 1)), caps / w], 1)


class Forest:
    """Trees as arrays: feature (-1 at leaves), split, left child (right is next to it), depth at leaves."""

    def __init__(self, trees: list[tuple], expected: float, threshold: float):
        self.trees, self.expected, self.threshold = trees, expected, threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        path = np.zeros(len(x))
        for feature, split, left, depth in self.trees:
            at = np.zeros(len(x), np.int32)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                i = at[inner]
                at[inner] = left[i] + (x[inner, f[inner]] >= split[i])
            path += depth[at]
        return np.exp2(-path / len(self.trees) / self.expected) if self.trees else np.zeros(len(x))


def expected_path(n: int) -> float:
    """Mean path of an unsuccessful search in a random tree of n rows."""
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else max(n - 1, 0)


def grow(x: np.ndarray, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(SUBSET, len(x))
    low, high = x.min(0), x.max(0)
    spread = np.where(high > low, high - low, np.maximum(np.abs(high), 1) * 0.05)
    low, high = low - 0.5 * spread, high + 0.5 * spread  # so that splits also fall beyond the range of good rows
    deepest = max(1, math.ceil(math.log2(max(size, 2)))) + 2
    trees = []
    for _ in range(TREES):
        feature, split, left, depth = [-1], [0.0], [0], [0.0]
        todo = [(0, x[rng.choice(len(x), size, replace=False)], low.copy(), high.copy(), 0)]
        while todo:
            at, rows, lo, hi, d = todo.pop()
            if len(rows) <= 1 or d >= deepest:
                depth[at] = d + expected_path(len(rows))
                continue
            f = int(rng.integers(x.shape[1]))
            s = float(rng.uniform(lo[f], hi[f]))
            feature[at], split[at], left[at] = f, s, len(feature)
            for side in (0, 1):
                part = rows[rows[:, f] >= s] if side else rows[rows[:, f] < s]
                a, b = lo.copy(), hi.copy()
                (a if side else b)[f] = s
                todo.append((len(feature), part, a, b, d + 1))
                feature.append(-1), split.append(0.0), left.append(0), depth.append(0.0)
        trees.append((np.array(feature), np.array(split), np.array(left, np.int32), np.array(depth)))
    return Forest(trees, max(expected_path(size), 1.0), 1.0)


def calibrate(forest: Forest, good: tuple[np.ndarray, np.ndarray], bad: tuple[np.ndarray, np.ndarray], keep_good: float = KEEP_GOOD) -> Forest:
    """Sets the threshold from (scores in ascending order, how often each occurs): scores above it are anomalous."""
    g, n = good
    upto = np.cumsum(n)
    total = int(upto[-1])
    least = float(g[np.searchsorted(upto, max(0, min(total - 1 - OUTLIERS, math.ceil(keep_good * total) - 1)), "right")])
    if len(bad[0]):
        b = np.concatenate([[0], np.cumsum(bad[1])])
        at = g[g >= least]
        gain = 1 - b[np.searchsorted(bad[0], at, "right")] / b[-1] - (total - upto[g >= least]) / total
        least = float(at[int(np.argmax(gain))])
    forest.threshold = least
    return forest


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """The forest grown from up to sample labelled documents, by order of a hash of their ids; its threshold comes from the scores of all, rounded up to 1 / BINS."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", F.col("quality").cast("long").alias("quality"), "text")

    def run(batches):
        for batch in batches:
            table = [rule_counts(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(table, pa.list_(pa.int64()))], ["doc_id", "quality", "counts"])

    counted = rows.mapInArrow(run, "doc_id long, quality long, counts array<long>")
    found = counted.groupBy("doc_id", "quality").agg(F.min("counts").alias("counts")).collect()  # up to sample rows, however often an id occurs
    counts = np.array([r.counts for r in found], np.int64).reshape(-1, len(COUNTS) + len(MORE))
    order = np.lexsort(counts.T)
    counts, good = counts[order], np.array([r.quality == 1 for r in found], bool)[order]
    ok = ~base_failed(counts)
    x = features(counts)
    if not (good & ok).any():
        return Forest([], 1.0, 1.0)
    forest = grow(x[good & ok], seed)
    scored = judge(docs, forest, id_col=id_col, text_col=text_col).filter("NOT base_failed").select("doc_id", F.ceil(F.col("anomaly") * BINS).alias("bin"))
    bins = scored.join(known, "doc_id").groupBy((F.col("quality") == 1).alias("good"), "bin").agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    sides = [(np.array([r.bin / BINS for r in bins if r.good == side], float), np.array([r.n for r in bins if r.good == side], np.int64)) for side in (True, False)]
    return calibrate(forest, *sides)


def judge(docs: DataFrame, forest: Forest, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (or the columns in carry), COUNTS, base_failed, kept and anomaly of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    if carry is None:
        docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
        carry, text_col = ["doc_id"], "text"
    added = [*COUNTS, "base_failed", "kept", "anomaly"]
    df, kept, at = passed(docs, carry, added, text_col)
    kinds = [*[T.LongType()] * len(COUNTS), T.BooleanType(), T.BooleanType(), T.DoubleType()]
    schema = T.StructType([*df.schema.fields[: len(kept)], *(T.StructField(c, k) for c, k in zip(added, kinds, strict=True))])

    def run(batches):
        f = shared.value
        for batch in slices(batches, at):
            if not batch.num_rows:
                continue
            counts = np.array([rule_counts(t.as_py()) for t in batch.column(at)], np.int64)
            failed, score = base_failed(counts), f.score(features(counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(~failed & (score <= f.threshold)), pa.array(score)], [*kept, *added])

    return df.mapInArrow(run, schema)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
