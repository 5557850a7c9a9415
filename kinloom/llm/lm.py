"""Language-model scoring by masked pseudo-likelihood: a bidirectional window network over subword ids.

A text's score is the sum of the conditional log-probabilities (natural) of its tokens, each predicted from both sides
without being seen; its mean is that over the number of tokens. The network is trained in numpy on every token of the
corpus, in shards of mini-batches.

Texts become the ids of the byte-level vocabulary (tokens.py), which spells every text without loss: no word shares a
class with another, and none is unknown. A token's probability given the ids on both sides (END before and after a
text) is that of its group times that within the group, both softmax layers over tanh(left + right), so it is
normalized over the whole vocabulary. Groups are runs of ids in order of their frequency in the corpus, short ones first
(EDGES), so that frequent ids cost less.

Every worker trains on all tokens of its rows: equal triples among up to FLUSH tokens are brought together with their
counts, which are what the loss depends on, and go through Adagrad in mini-batches. The shards' parameters are averaged
by the number of tokens behind each, so the result depends on how rows are dealt, within the spread of such training.
Ids, counts and triples come from all rows; the driver holds one set of parameters, whose size is the vocabulary's.

Defined cases. A null or empty text has n_tokens 0, sum 0 and a null mean. A null id stays null. Repeated rows, and rows
that share an id, count each time and are scored one by one. Texts are trained on and scored whole, however long. Ids of
equal frequency are ordered by their number. An empty table gives no rows. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, slices

VOCAB, HIDDEN = 50_257, 32
END, SIDE = VOCAB, VOCAB + 1
EDGES = np.array([*range(0, 2048, 64), *range(2048, VOCAB, 1024), VOCAB])
GROUPS = len(EDGES) - 1
FLUSH, BATCH, RATE, PASSES, DEALT = 1 << 22, 8192, 0.1, 1, 1024


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) with the ids of a text as 16-bit numbers."""
    vocab = tokens.default_vocab()

    def run(batches):
        for whole in batches:
            for batch in slices([whole], 1):
                ids = [tokens.encode(t.as_py(), vocab).astype("<u2").tobytes() for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids binary")


def counts_of(ids: DataFrame) -> np.ndarray:
    """How often each id occurs."""

    def run(batches):
        total = np.zeros(VOCAB, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                total += np.bincount(np.frombuffer(x.as_py(), "<u2"), minlength=VOCAB) if len(x.as_py()) > VOCAB else 0
            small = [x.as_py() for x in batch.column("ids") if len(x.as_py()) <= VOCAB]
            total += np.bincount(np.frombuffer(b"".join(small), "<u2"), minlength=VOCAB)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    found = ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(VOCAB, np.int64)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


def triples(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(left, id, right) of every token as one number, text by text, and the number of tokens of each text."""
    n = np.array([len(t) // 2 for t in texts], np.int64)
    x = np.frombuffer(b"".join(texts), "<u2").astype(np.int64)
    stops = np.cumsum(n)[n > 0]
    left, right = np.concatenate([[END], x[:-1]])[: len(x)], np.concatenate([x[1:], [END]])[: len(x)]
    left[stops[:-1]] = END
    right[stops - 1] = END
    return (left * SIDE + x) * SIDE + right, n


def gathered(batches, column: str = "ids"):
    """Lists of rows (batch, texts) with up to about FLUSH tokens."""
    for batch in batches:
        texts, room, start = [], 0, 0
        for i, x in enumerate(batch.column(column)):
            texts.append(x.as_py())
            room += len(texts[-1]) // 2
            if room >= FLUSH:
                yield batch.slice(start, i + 1 - start), texts
                texts, room, start = [], 0, i + 1
        if texts:
            yield batch.slice(start), texts


def group_of(place: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, place, "right") - 1


class Network:
    """Parameters and the log-probabilities and training steps on triples."""

    def __init__(self, counts: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        order = np.argsort(-counts, kind="stable")
        self.place = np.empty(VOCAB, np.int64)
        self.place[order] = np.arange(VOCAB)
        mass = counts[order] + 0.01
        whole = np.add.reduceat(mass, EDGES[:-1])
        group, inner = np.log(whole / whole.sum()), np.log(mass / np.repeat(whole, np.diff(EDGES)))
        # the last column of an output row is its bias
        self.p = {"left": f(SIDE, HIDDEN), "right": f(SIDE, HIDDEN), "group": np.hstack([f(GROUPS, HIDDEN), group[:, None].astype(np.float32)]), "inner": np.hstack([f(VOCAB, HIDDEN), inner[:, None].astype(np.float32)])}

    def hidden(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """With a last column of ones."""
        h = np.ones((len(left), HIDDEN + 1), np.float32)
        h[:, :-1] = np.tanh(self.p["left"][left] + self.p["right"][right])
        return h

    def parts(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Order by group, place within the group in that order, and (group, from, to)."""
        at = self.place[word]
        g = group_of(at)
        order = np.argsort(g, kind="stable")
        g = g[order]
        edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        return order, at[order] - EDGES[g], [(int(g[a]), a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]

    @staticmethod
    def softmax(h: np.ndarray, out: np.ndarray, at) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability of at, probabilities)."""
        z = h @ out.T
        z -= z.max(1, keepdims=True)
        one = np.arange(len(z))
        own = z[one, at].astype(np.float64)
        np.exp(z, out=z)
        total = z.sum(1, keepdims=True)
        z /= total
        return own - np.log(total[:, 0]), z

    def log_probs(self, code: np.ndarray) -> np.ndarray:
        """Natural logarithms of triples' probabilities."""
        out = np.empty(len(code))
        for a in range(0, len(code), BATCH):
            c = code[a : a + BATCH]
            left, word, right = c // SIDE // SIDE, c // SIDE % SIDE, c % SIDE
            order, at, groups = self.parts(word)
            h = self.hidden(left[order], right[order])
            got = np.empty(len(c))
            which = np.empty(len(c), np.int64)
            for g, i, j in groups:
                which[i:j] = g
                got[i:j] = self.softmax(h[i:j], self.p["inner"][EDGES[g] : EDGES[g + 1]], at[i:j])[0]
            got += self.softmax(h, self.p["group"], which)[0]
            out[a + order] = got
        return out

    def train(self, code: np.ndarray, n: np.ndarray, memory: dict, rng) -> None:
        """Passes over triples with counts, in mini-batches of random order; memory holds Adagrad's sums."""
        for _ in range(PASSES):
            deal = rng.permutation(len(code))
            for a in range(0, len(code), BATCH):
                self.step(code[deal[a : a + BATCH]], n[deal[a : a + BATCH]], memory)

    def step(self, c: np.ndarray, n: np.ndarray, memory: dict) -> None:
        left, word, right = c // SIDE // SIDE, c // SIDE % SIDE, c % SIDE
        order, at, groups = self.parts(word)
        left, right = left[order], right[order]
        n = (n[order] / n.sum()).astype(np.float32)[:, None]
        h = self.hidden(left, right)
        dh, which, moves = np.zeros_like(h), np.empty(len(c), np.int64), []
        for g, i, j in groups:
            which[i:j] = g
            d = self.softmax(h[i:j], self.p["inner"][EDGES[g] : EDGES[g + 1]], at[i:j])[1]
            d[np.arange(j - i), at[i:j]] -= 1
            d *= n[i:j]
            own = slice(EDGES[g], EDGES[g + 1])
            dh[i:j] = d @ self.p["inner"][own]
            moves.append(("inner", own, d.T @ h[i:j]))
        d = self.softmax(h, self.p["group"], which)[1]
        d[np.arange(len(c)), which] -= 1
        d *= n
        dh += d @ self.p["group"]
        moves.append(("group", slice(None), d.T @ h))
        dh = dh[:, :-1] * (1 - h[:, :-1] ** 2)
        for name, side in (("left", left), ("right", right)):
            by = np.argsort(side, kind="stable")
            s = side[by]
            first = np.flatnonzero(np.diff(s, prepend=-1))
            moves.append((name, s[first], np.add.reduceat(dh[by], first)))
        for name, at, g in moves:
            total = memory[name][at] + g * g
            memory[name][at] = total
            self.p[name][at] -= RATE * g / (np.sqrt(total) + 1e-6)


def learn(ids: DataFrame, seed: int = 0) -> Network:
    """The network trained on encoded texts."""
    network = Network(counts_of(ids), seed)
    shared = ids.sparkSession.sparkContext.broadcast(network)
    names = list(network.p)

    def shard(batches):
        net, rng = shared.value, np.random.default_rng(seed)
        net.p = {k: v.copy() for k, v in net.p.items()}
        memory = {k: np.zeros_like(v) for k, v in net.p.items()}
        seen = {k: np.zeros(SIDE if k in ("left", "right") else GROUPS, np.int64) for k in net.p}
        for _, texts in gathered(batches):
            code, n = np.unique(triples(texts)[0], return_counts=True)
            if not len(code):
                continue
            net.train(code, n, memory, rng)
            group = group_of(net.place[code // SIDE % SIDE])
            for k, at in (("left", code // SIDE // SIDE), ("right", code % SIDE), ("inner", group)):
                seen[k] += np.bincount(at, weights=n, minlength=len(seen[k])).astype(np.int64)
            seen["group"] += n.sum()
        for k, name in enumerate(names):
            own = (lambda i: slice(EDGES[i], EDGES[i + 1])) if name == "inner" else (lambda i: i)
            for part in np.array_split(np.flatnonzero(seen[name]), 8):
                rows = [pa.array([k] * len(part), pa.int32()), pa.array(part.astype(np.int32)), pa.array(seen[name][part]), pa.array([net.p[name][own(i)].tobytes() for i in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, ["part", "at", "n", "row"])

    def average(table):
        sums: dict = {}
        for k, at, n, row in zip(*(table.column(c).to_pylist() for c in ("part", "at", "n", "row")), strict=True):
            x = np.frombuffer(row, np.float32).astype(np.float64)
            s, total = sums.get((k, at), (0.0, 0))
            sums[k, at] = s + x * n, total + n
        cols = [pa.array([k for k, _ in sums], pa.int32()), pa.array([i for _, i in sums], pa.int32()), pa.array([(s / n).astype(np.float32).tobytes() for s, n in sums.values()], pa.binary())]
        return pa.Table.from_arrays(cols, ["part", "at", "row"])

    rows = ids.select("ids").mapInArrow(shard, "part int, at int, n long, row binary").groupBy(F.pmod(F.xxhash64("part", "at"), F.lit(DEALT))).applyInArrow(average, "part int, at int, row binary")
    found = rows.toArrow()
    for k, at, row in zip(*(found.column(c).to_pylist() for c in ("part", "at", "row")), strict=True):
        own = slice(EDGES[at], EDGES[at + 1]) if names[k] == "inner" else slice(at, at + 1)
        p = network.p[names[k]]
        p[own] = np.frombuffer(row, np.float32).reshape(-1, p.shape[1])
    shared.unpersist()
    return network


def score_ids(ids: DataFrame, network: Network) -> DataFrame:
    """doc_id, n_tokens, sum_logprob and mean_logprob of encoded texts."""
    shared = ids.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = shared.value
        for batch, texts in gathered(batches):
            code, n = triples(texts)
            kinds, which = np.unique(code, return_inverse=True)
            sums = np.bincount(np.repeat(np.arange(len(n)), n), weights=net.log_probs(kinds)[which], minlength=len(n)).astype(np.float64)
            mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sums), mean], ["doc_id", "n_tokens", "sum_logprob", "mean_logprob"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, sum_logprob double, mean_logprob double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts by the network trained on them."""
    ids = materialize(encoded(docs, id_col, text_col), "ids")
    return score_ids(ids, learn(ids))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
