"""SentencePiece encoding and decoding by a lattice over bounded-length substrings.

The stages are relational: (1) texts become words, the parts that no piece crosses, which are counted; (2) frequent
ones are exploded into their substrings of at most the longest piece's length; (3) these are joined to the piece table by
equality; (4) the edges found are grouped by word; (5) a higher-order aggregate folds each word's edges into its pieces.
The result is a dictionary from word to ids, which the texts' words are looked up in.

The fold depends on the model. viterbi_words() takes the path of greatest score, for unigram models. The model at hand
is a BPE model, whose result is not that path (see the README for how often they differ) but that of merging, as long
as one is left, the best-scored two neighbours, leftmost on ties. spell() folds the same edges for it in one pass, by
score and place: an edge is taken if it spans just two of the symbols so far. That is the same as merging one by one
wherever every piece comes out of the pass on itself: a merge better than the last one would be of a piece whose own
merges had all had their turn, so it would have been made. Pieces of which this doesn't hold are found when the model
is read (Pieces.late), and words that contain one aren't folded so.

The dictionary holds the most frequent words, DICTIONARY of them at most, so that it can be broadcast at any size of
the input. Which words are in it changes the time that encoding takes, not its result. All other words, rare ones, long ones and those with late pieces, are folded by merges over the same lattice where they occur, in numpy, each
batch's new words at once (by a heap beyond LONG characters); memory is bounded by the batch and a cache of CACHE words.

Defined cases. A null text has null ids and a null decoded text; an empty one has no ids. Characters without a piece
become the byte pieces of their UTF-8. A text of any length is encoded whole, and so is a word. Words of equal counts
are in the dictionary together or not at all. Decoding gives the text back, but for U+2581, which the model cannot tell
from a space. Repeated rows, and rows that share an id, are encoded alike and one by one; an empty table gives no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, slices

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
LONG, CHUNK, CACHE = 128, 10_000, 200_000
DICTIONARY, FLUSH, SLICE = 1 << 17, 200_000, 1 << 20
NONE = np.int32(2**31 - 1)
B1, B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Pieces:
    """The piece table: ids, ranks (0: best score; equal scores share one), hashes; byte pieces apart."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)]
        bytes_ = {i: int(names[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_ids = [i for i, _ in sorted(bytes_.items(), key=lambda x: x[1])]
        plain = [i for i in range(n) if i not in bytes_ and i not in set(special) and not sp.is_unused(i)]
        scores = np.array([sp.get_score(i) for i in plain])
        ranks = np.unique(-scores, return_inverse=True)[1]
        self.table = {names[i]: (int(r), i) for i, r in zip(plain, ranks, strict=True)}
        self.longest = max(map(len, self.table))
        hashes = np.array([piece_hash(p) for p in self.table], np.uint64)
        order = np.argsort(hashes[:, 0])
        self.h1, self.h2 = hashes[order, 0], hashes[order, 1]
        self.rank, self.id = (np.array([v[k] for v in self.table.values()], np.int32)[order] for k in (0, 1))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.h1 >> np.uint64(44)).astype(np.int64)] = True
        self.start = np.searchsorted(self.h1 >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
        self.begins = self.maybe.copy()  # slots of the hashes of pieces' beginnings
        self.begins[[piece_hash(x)[0] >> 44 for x in {x[:k] for x in self.table for k in range(1, len(x))}]] = True
        self.late = [x for x in self.table if one_pass(x, self) != [x]]
        self.texts = [b"" if i in set(special) else bytes([bytes_[i]]) if i in bytes_ else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.bytes = pa.array(self.texts, pa.large_binary())


def piece_hash(p: str) -> tuple[int, int]:
    """Polynomials of the code points, modulo 2**64."""
    return tuple(sum((ord(c) + 1) * pow(int(base), i, 1 << 64) for i, c in enumerate(p, 1)) % (1 << 64) for base in (B1, B2))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, in steps of a doubling."""
    if len(_powers.get(base, ())) < n:
        size = 1 << max(10, (n - 1).bit_length())
        steps = np.full(size, base & (1 << 64) - 1, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def looked_up(p: Pieces, slot: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the hashes are pieces', their places in the table), by the table's runs of equal upper bits."""
    found = np.full(len(h), -1, np.int32)
    j, left = p.start[slot], np.arange(len(h))
    while len(left):
        same = p.h1[j] == h[left]
        found[left[same]] = j[same]
        on = ~same & (j + 1 < p.start[slot[left] + 1])
        j, left = j[on] + 1, left[on]
    which = np.flatnonzero(found >= 0)
    return which, found[which]


def one_pass(word: str, p: Pieces) -> list[str]:
    """The symbols after one pass over the word's edges by (rank, place)."""
    n = len(word)
    length = [1] * n
    for _, b, k in sorted((p.table[word[b : b + k]][0], b, k) for b in range(n) for k in range(2, min(p.longest, n - b) + 1) if word[b : b + k] in p.table):
        if 0 < length[b] < k and length[b + length[b]] == k - length[b]:
            length[b + length[b]], length[b] = 0, k
    return [word[i : i + k] for i, k in enumerate(length) if k]


@functools.cache
def pieces(model: str) -> Pieces:
    return Pieces(model)


def lattice(words: list[str], p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word ends, end of each position's word, edge ranks, edge ids) of words: edges by (position, length - 1)."""
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum([len(w) for w in words])
    stop = np.repeat(ends, np.diff(ends, prepend=0))
    n = len(chars)
    rank, ids = np.full((n, p.longest), NONE), np.full((n, p.longest), -1, np.int32)
    sums, back = [], []
    for base in (B1, B2):
        sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars + np.uint64(1)) * powers(int(base), n), dtype=np.uint64)]))
        back.append(powers(pow(int(base), -1, 1 << 64), n) * base)
    at = np.arange(n)
    for k in range(p.longest):  # the substrings of length k + 1 that begin a piece, joined to the pieces
        at = at[at + k < stop[at]]
        h1 = (sums[0][at + k + 1] - sums[0][at]) * back[0][at]
        slot = (h1 >> np.uint64(44)).view(np.int64)
        alive = np.flatnonzero(p.begins[slot])
        at, h1, slot = at[alive], h1[alive], slot[alive]
        hit = np.flatnonzero(p.maybe[slot])
        own, j = looked_up(p, slot[hit], h1[hit])
        own = at[hit[own]]
        same = (sums[1][own + k + 1] - sums[1][own]) * back[1][own] == p.h2[j]
        rank[own[same], k], ids[own[same], k] = p.rank[j[same]], p.id[j[same]]
    return ends, stop, rank, ids


def fold_merges(ends: np.ndarray, stop: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Symbol lengths at their first positions (0 elsewhere) after all merges, every word in step."""
    n, longest = rank.shape
    length = np.ones(n, np.int64)
    live = np.arange(n)
    word = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    while len(live):
        after = live + length[live]
        inner = after < stop[live]
        total = np.where(inner, length[live] + length[np.minimum(after, n - 1)], 0)
        ok = inner & (total <= longest)
        key = np.where(ok, rank[live, np.where(ok, total - 1, 0)], NONE).astype(np.int64)
        w = word[live]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        best = np.minimum.reduceat(key * n + live, first)
        go = best < np.int64(NONE) * n
        s = best[go] % n
        t = s + length[s]
        length[s] += length[t]
        length[t] = 0
        active = np.zeros(len(ends), bool)
        active[w[first[go]]] = True
        live = live[active[w] & (length[live] > 0)]
    return length


def merge_heap(word: str, p: Pieces) -> list[str]:
    """The same for one long word."""
    parts, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple] = []

    def push(i: int, j: int) -> None:
        both = parts[i] + parts[j]
        if len(both) <= p.longest and both in p.table:
            heapq.heappush(heap, (p.table[both][0], i, j, both))

    for i in range(len(word) - 1):
        push(i, i + 1)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j], after[i] = both, "", after[j]
        if after[j] < len(parts):
            before[after[j]] = i
            push(i, after[j])
        if before[i] >= 0:
            push(before[i], i)
    return [x for x in parts if x]


def word_ids(words: list[str], p: Pieces) -> list[bytes]:
    """The ids of each word, as little-endian 32-bit integers."""
    out: list[bytes] = [b""] * len(words)
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for i in (i for i, w in enumerate(words) if len(w) > LONG):
        ids: list[int] = []
        for x in merge_heap(words[i], p):
            ids += [p.table[x][1]] if x in p.table else [p.byte_ids[b] for b in x.encode("utf-8", "replace")]
        out[i] = np.array(ids, "<i4").tobytes()
    for c in range(0, len(short), CHUNK):
        part = short[c : c + CHUNK]
        own = [words[i] for i in part]
        ends, stop, rank, edge = lattice(own, p)
        length = fold_merges(ends, stop, rank)
        at = np.flatnonzero(length)
        ids = edge[at, length[at] - 1]
        bounds = np.searchsorted(at, ends)
        odd = set(np.searchsorted(ends, at[ids < 0], "right").tolist())
        data, a = ids.astype("<i4").tobytes(), 0
        for k, b in enumerate(bounds.tolist()):
            if k in odd:
                base = int(ends[k] - len(own[k]))
                fixed: list[int] = []
                for s, x in zip(at[a:b].tolist(), ids[a:b].tolist(), strict=True):
                    fixed += [x] if x >= 0 else [p.byte_ids[y] for y in own[k][s - base].encode("utf-8", "replace")]
                out[part[k]] = np.array(fixed, "<i4").tobytes()
            else:
                out[part[k]] = data[4 * a : 4 * b]
            a = b
    return out


def split_words(text: str) -> list[str]:
    return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def decode_texts(ids: pa.ListArray, p: Pieces) -> list[bytes | None]:
    """The UTF-8 of rows of ids."""
    flat = p.bytes.take(ids.flatten())
    ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8) if len(flat) else np.zeros(1, np.int64)
    data, out, at = (flat.buffers()[2] or b"") if len(flat) else b"", [], 0
    view = memoryview(data)
    for n in ids.value_lengths().to_pylist():
        if n is None:
            out.append(None)
            continue
        raw = bytes(view[ends[at] : ends[at + n]])
        out.append(raw[1:] if raw[:1] == b" " else raw)
        at += n
    return out


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, brought together on each worker first.

    Words that occur but once among about FLUSH different ones are left out there: what is counted decides which words
    have a place in the dictionary, so the time that encoding takes, and not its result.
    """

    def run(batches):
        count: Counter = Counter()

        def out():
            often = {w: n for w, n in count.items() if n > 1}
            return pa.RecordBatch.from_arrays([pa.array(list(often), pa.string()), pa.array(list(often.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches, 0, SLICE):
            for text in batch.column(0).to_pylist():
                if text:
                    count.update(split_words(text))
            if len(count) > FLUSH:
                yield out()
                count = Counter()
        if count:
            yield out()

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """The words of at least the least count at which they are no more than most."""
    room, least = most, None
    for r in counts.groupBy(bin_of("n").alias("bin")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("bin")).collect():
        room -= r.words
        if room < 0:
            break
        least = r.bin
    return counts.filter(bin_of("n") >= least if least is not None else F.lit(False)).select("word")


def bin_of(n: str):
    """Counts to 16 a doubling, in order; so there are at most some thousand of them."""
    return F.floor(F.log2(F.col(n)) * 16)


def edges_of(words: DataFrame, table: DataFrame, longest: int, *values: str) -> DataFrame:
    """(word, b, k, *values): the substrings of distinct words that are pieces, by first character (from 1) and length; those of one character all."""
    w = words.select("word").filter("length(word) > 0").distinct()
    spots = w.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("b"))
    subs = spots.select("word", "b", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("b") + 1))).alias("k"))
    subs = subs.select("word", "b", "k", F.substr(F.col("word"), F.col("b"), F.col("k")).alias("piece"))
    return subs.join(F.broadcast(table), "piece", "left").filter(F.col(values[0]).isNotNull() | (F.col("k") == 1)).select("word", "b", "k", *values)


def spell(words: DataFrame, table: DataFrame, longest: int, byte_ids: list[int]) -> DataFrame:
    """(word, ids) of each distinct word by merges, in one pass over its edges; table: (piece, rank, id)."""
    edges = edges_of(words, table, longest, "rank", "id")
    one = F.when(F.col("k") == 1, F.struct("b", F.coalesce("id", F.lit(-1)).alias("id")))
    more = F.when(F.col("k") > 1, F.struct("rank", "b", "k", "id"))
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(one)).alias("ones"), F.array_sort(F.collect_list(more)).alias("merges"))
    symbol = lambda k, i: F.struct(k.alias("k"), i.alias("id"))

    def step(state, e):
        at = e["b"] - 1
        first = F.get(state, at)["k"]
        fits = (first > 0) & (first < e["k"]) & (F.get(state, at + first)["k"] == e["k"] - first)
        merged = F.transform(state, lambda x, i: F.when(i == at, symbol(e["k"], e["id"])).when(i == at + first, symbol(F.lit(0), F.lit(-1))).otherwise(x))
        return F.when(fits, merged).otherwise(state)

    spelt = grouped.select("word", F.aggregate("merges", F.transform("ones", lambda x: symbol(F.lit(1), x["id"])), step).alias("symbols"))
    own = F.array(*(F.lit(i) for i in byte_ids)) if byte_ids else F.array(F.lit(0))

    def bytes_of(c):
        return F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda j: F.element_at(own, F.conv(F.substr(F.hex(F.encode(c, "utf-8")), 2 * j - 1, F.lit(2)), 16, 10).cast("int") + 1))

    nothing = F.array().cast("array<int>")
    ids = F.transform("symbols", lambda x, i: F.when(x["k"] == 0, nothing).when(x["id"] >= 0, F.array(x["id"])).otherwise(bytes_of(F.substr(F.col("word"), i + 1, F.lit(1)))))
    return spelt.select("word", F.flatten(ids).alias("ids"))


def dictionary(docs: DataFrame, model: str | None = None, text_col: str = "text", most: int = DICTIONARY) -> DataFrame:
    """(word, ids) of the most frequent words of all texts, most of them at most; as a table."""
    spark = docs.sparkSession
    p = pieces(model or default_model())
    counts = materialize(word_counts(docs, text_col), "words")
    plain = F.length("word") <= LONG
    for x in p.late:
        plain = plain & ~F.col("word").contains(x)
    table = spark.createDataFrame([(x, rank, i) for x, (rank, i) in p.table.items()], "piece string, rank int, id int")
    out = materialize(spell(frequent(counts, most).filter(plain), table, p.longest, p.byte_ids), "dictionary")
    drop_table(counts)
    return out


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids of every text."""
    model = model or default_model()
    spelt = dictionary(docs, model, text_col)
    found = spelt.toArrow()  # up to DICTIONARY words
    drop_table(spelt)
    shared = docs.sparkSession.sparkContext.broadcast((found.column("word").combine_chunks(), found.column("ids").combine_chunks().cast(pa.list_(pa.int32()))))

    def run(batches):
        p, base = pieces(model), lookup(shared)
        known = dict(base)
        for batch in slices(batches, 1, SLICE):
            texts = [None if t is None else split_words(t) for t in batch.column(1).to_pylist()]
            if len(known) > CACHE + len(base):
                known = dict(base)
            new = list({w for ws in texts if ws for w in ws if w not in known})
            known.update(zip(new, word_ids(new, p), strict=True))
            data = [None if ws is None else b"".join(map(known.__getitem__, ws)) for ws in texts]
            sizes = np.array([len(d or b"") // 4 for d in data], np.int32)
            values = pa.array(np.frombuffer(b"".join(d for d in data if d), "<i4"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([d is None for d in data] + [False]))
            count = pa.array(sizes.astype(np.int64), mask=np.array([d is None for d in data], bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), count, pa.ListArray.from_arrays(offsets, values)], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


_dictionaries: dict[str, dict] = {}


def lookup(shared) -> dict[str, bytes]:
    """A broadcast dictionary as word to ids (little-endian 32-bit integers); the last one stays with the worker."""
    words, ids = shared.value
    key = f"{len(words)}-{words.nbytes}-{ids.nbytes}-{zlib.crc32(words.buffers()[2] or b'')}-{zlib.crc32(ids.values.buffers()[1] or b'')}"
    if key not in _dictionaries:
        _dictionaries.clear()
        data, at = ids.values.to_numpy().astype("<i4").tobytes(), ids.offsets.to_numpy().tolist()
        _dictionaries[key] = {w: data[4 * a : 4 * b] for w, a, b in zip(words.to_pylist(), at, at[1:], strict=False)}
    return _dictionaries[key]


def decode(coded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and text of encoded rows."""
    model = model or default_model()

    def run(batches):
        p = pieces(model)
        for batch in batches:
            texts = [None if x is None else x.decode("utf-8", "replace") for x in decode_texts(batch.column(2), p)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return coded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, text string")


def viterbi_words(words: DataFrame, table: DataFrame, longest: int, unknown: float = -1e6) -> DataFrame:
    """(word, pieces, score): the path of greatest score of each distinct word (column word) over table (piece, score).

    For unigram models. Characters without a piece cost `unknown`. Ties go to the longer last piece.
    """
    edges = edges_of(words, table, longest, "score").withColumn("score", F.coalesce("score", F.lit(unknown)))
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct((F.col("b") + F.col("k") - 1).alias("e"), (-F.col("k")).alias("k"), "score"))).alias("edges"))
    # state: for every end so far the best score and the length of its last piece; edges come by end, longest first
    start = F.expr("array(named_struct('s', 0D, 'k', 0))")

    def step(state, x):
        s = F.element_at(state, x["e"] + x["k"] + 1)["s"] + x["score"]
        new = F.struct(s.alias("s"), (-x["k"]).alias("k"))
        return F.when(F.size(state) == x["e"], F.concat(state, F.array(new))).when(F.element_at(state, -1)["s"] < s, F.concat(F.slice(state, 1, x["e"]), F.array(new))).otherwise(state)

    best = grouped.select("word", F.aggregate("edges", start, step).alias("best"))
    back = F.aggregate(F.sequence(F.lit(1), F.length("word")), F.struct(F.length("word").alias("at"), F.expr("cast(array() as array<string>)").alias("out")), lambda s, _: F.when(s["at"] > 0, F.struct((s["at"] - F.element_at(F.col("best"), s["at"] + 1)["k"]).alias("at"), F.concat(F.array(F.substr(F.col("word"), s["at"] - F.element_at(F.col("best"), s["at"] + 1)["k"] + 1, F.element_at(F.col("best"), s["at"] + 1)["k"])), s["out"]).alias("out"))).otherwise(s), lambda s: s["out"])
    return best.select("word", back.alias("pieces"), F.element_at("best", -1)["s"].alias("score"))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids' checksum, and that of the decoded text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = default_model()
    coded = encode(docs, model)

    def digest(batches):
        p = pieces(model)
        for batch in batches:
            ids = batch.column(2)
            crc = [zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)) if x.is_valid else None for x in ids]
            text = [None if x is None else zlib.crc32(x.decode("utf-8", "replace").encode()) for x in decode_texts(ids, p)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crc, pa.int64()), pa.array(text, pa.int64())], ["doc_id", "n_tokens", "ids", "ids_crc32", "decoded_crc32"])

    return coded.mapInArrow(digest, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, decoded_crc32 long")
