"""Harmonic packing of token streams into sequences of a power-of-two capacity.

A document is its ids and one end id. Whole multiples of the capacity become full sequences. The rest, by its length,
belongs to a class k: it is longer than capacity/(k+1) and not longer than capacity/k, and a bin of class k takes
exactly k pieces. Where k such pieces would leave more than capacity/LOSS of a bin empty, a piece of length
capacity/(k+1) is cut off first, which fills the bins of its class, and what remains is classed again; so most documents
are cut once or twice, and a bin loses little. Each worker fills its own bins, class by class, with no shuffle. What a
worker's open bins hold at its end is laid end to end and cut at the capacity; the last of it is cut into bins whose
lengths are powers of two, which need no padding.

Defined cases. A null or empty text is its end id alone. Null ids stay null. Repeated rows are packed one by one, and
rows that share an id are documents of their own. An empty table gives no rows. A text of any length is encoded whole.
Pieces of equal length are taken as they come. Sequence ids are unique (the partition's number in the high bits) and the
same whenever the input's partitions are. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokens

CAPACITY = 1024
END = 0
LOSS = 64  # a bin of a class is padded by about 1/LOSS of the capacity at most
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FLUSH = 50_000


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of n ids: whole sequences, then pieces that fill the bins of their classes."""
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        k = capacity // rest
        size = rest if capacity - k * rest <= capacity // LOSS else capacity // (k + 1)
        out.append(size)
        rest -= size
    return out


def digits(n: int, capacity: int = CAPACITY) -> list[int]:
    """Bin lengths that n ids fill exactly: whole sequences, then the binary digits of the rest."""
    return [capacity] * (n // capacity) + [1 << k for k in range(capacity.bit_length() - 2, -1, -1) if n % capacity >> k & 1]


class Bins:
    """The open bins of one worker, by class; full ones go to rows. A piece is (doc_id, start, ids, ids of its document)."""

    def __init__(self, capacity: int, base: int, with_ids: bool):
        self.capacity, self.next, self.with_ids = capacity, base, with_ids
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, data, n in pieces:
            size = len(data) // 4
            self.rows.append((doc, start, size, zlib.crc32(data), n, *[bytes(data)] * self.with_ids, self.next, at))
            at += size
        self.next += 1

    def add(self, doc, start: int, data, n: int) -> None:
        k = self.capacity // (len(data) // 4)
        if k == 1 and len(data) == 4 * self.capacity:
            self.close([(doc, start, data, n)])
            return
        held = self.open.setdefault(k, [])
        held.append((doc, start, bytes(data), n))
        if len(held) == k:
            self.close(held)
            self.open[k] = []

    def finish(self) -> None:
        """Lays the rest end to end into bins that it fills."""
        rest = [p for _, held in sorted(self.open.items()) for p in held]
        self.open, bin_ = {}, []
        sizes = iter(digits(sum(len(p[2]) // 4 for p in rest), self.capacity))
        room = next(sizes, 0)
        for doc, start, data, n in rest:
            at = 0
            while at < len(data) // 4:
                take = min(room, len(data) // 4 - at)
                bin_.append((doc, start + at, data[4 * at : 4 * (at + take)], n))
                at, room = at + take, room - take
                if not room:
                    self.close(bin_)
                    bin_, room = [], next(sizes, 0)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocab: str | None = None, end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece (SCHEMA; with_ids: and its ids, little-endian unsigned 32-bit, as binary); see the module."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    vocab = vocab or tokens.default_vocab()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "sequence_id", "offset"]
    kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids + [pa.int64()] * 2

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)

    def run(batches):
        bins = Bins(capacity, TaskContext.get().partitionId() << 40, with_ids)
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc, text in zip(ids_of, texts, strict=True):
                ids = np.append(tokens.encode(text.as_py(), vocab), np.uint32(end)).astype("<u4", copy=False)
                data, at, n = memoryview(ids).cast("B"), 0, len(ids)
                for size in cuts(n, capacity):
                    bins.add(doc, at, data[4 * at : 4 * (at + size)], n)
                    at += size
                if len(bins.rows) >= FLUSH:
                    yield batch_of(bins.rows)
                    bins.rows = []
        bins.finish()
        if bins.rows:
            yield batch_of(bins.rows)

    schema = SCHEMA.replace(", sequence_id", ", ids binary, sequence_id") if with_ids else SCHEMA
    df = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return df.mapInArrow(run, schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
