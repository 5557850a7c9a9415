"""Training-order materialisation: token sequences in shuffled order as fixed-stride binary shards.

1. Every input partition is encoded once; its documents, each with an end id, are cut into sequences of LENGTH ids
   (the partition's last one padded with end ids) and kept in a table as compressed blocks. Only the number of
   sequences of each partition comes to the driver.
2. Sequence number x, counted through the partitions, gets the global slot permute(x): a keyed Feistel permutation of
   0..n-1 with cycle walking. Shard k holds slots k*SHARD..(k+1)*SHARD-1.
3. Sequences go to their shard's partition, bundled and compressed, and each task writes one shard: slot s starts at
   byte (s mod SHARD) * stride of shard-(s div SHARD).bin. A file is written under another name and renamed, so a lost
   task is simply run again and a reader never sees half a shard.
4. The same job writes the manifest, one row a sequence, as a table beside the shards. meta.json, which has all a reader
   needs, comes last: where it is, all shards and the manifest are whole, and without it nothing is to be read. write()
   does all this before it returns the manifest, so reading the result in part or again writes nothing.

Ids are little-endian unsigned 16-bit (32-bit for vocabularies of more than 65,536 ids).

Defined cases. A null or empty text is its end id alone; null ids are kept as nulls; repeated rows are written one by
one; a text of any length is encoded whole; an empty table gives no shard and no rows. Writing under a root that holds
a finished corpus is an error. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokens
from .common import drop_table, materialize, scratch_path
from .feistel import permute_array

LENGTH, SHARD = 1024, 16_384
BLOCK = 4096  # sequences a block
LEVEL = 6
END = 0
SCHEMA = "slot long, shard int, position long, doc_ids array<long>, n_tokens int, ids_crc32 long, file string"


def width_of(vocab: str) -> str:
    return "<u2" if tokens.encoder(vocab).n_vocab <= 1 << 16 else "<u4"


def sequences(docs: DataFrame, vocab: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Blocks of sequences: (part, first, n, docs, sizes, data)."""
    kind = width_of(vocab)

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        room = np.full(BLOCK * length, end, kind)
        owners: list[list] = [[] for _ in range(BLOCK)]
        at = 0

        def flush(used: int):
            n = -(-used // length)
            blob = zstandard.ZstdCompressor(level=LEVEL).compress(room[: n * length].tobytes())
            sizes = [length] * (n - 1) + [used - (n - 1) * length]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made], pa.int64()), pa.array([n], pa.int32()), pa.array([owners[:n]], pa.list_(pa.list_(pa.int64()))), pa.array([sizes], pa.list_(pa.int32())), pa.array([blob], pa.binary())], ["part", "first", "n", "docs", "sizes", "data"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tokens.encode(text.as_py(), vocab), np.uint32(end)).astype(kind)
                while len(ids):
                    take = min(len(ids), len(room) - at)
                    room[at : at + take] = ids[:take]
                    for k in range(at // length, (at + take - 1) // length + 1):
                        owners[k].append(doc)
                    at, ids = at + take, ids[take:]
                    if at == len(room):
                        yield flush(at)
                        made += BLOCK
                        room[:] = end
                        owners, at = [[] for _ in range(BLOCK)], 0
        if at:
            yield flush(at)

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"])
    return rows.mapInArrow(run, "part int, first long, n int, docs array<array<long>>, sizes array<int>, data binary")


def write(docs: DataFrame, root: str, vocab: str | None = None, length: int = LENGTH, shard: int = SHARD, seed: int = 20240101, end: int = END) -> DataFrame:
    """Writes shards, manifest and meta.json under root (a URI that all workers reach); the manifest, one row a sequence."""
    spark = docs.sparkSession
    fs, path = pa.fs.FileSystem.from_uri(root)
    if fs.get_file_info(f"{path}/meta.json").type != pa.fs.FileType.NotFound:
        raise FileExistsError(f"{root} holds a finished corpus")
    vocab = vocab or tokens.default_vocab()
    kind = width_of(vocab)
    blocks = materialize(sequences(docs, vocab, length, end), "sequences")
    counts = dict(blocks.groupBy("part").agg({"n": "sum"}).collect())
    offsets, n = {}, 0
    for part in sorted(counts):
        offsets[part] = n
        n += counts[part]
    fs.create_dir(path, recursive=True)
    meta = {"sequences": n, "length": length, "shard": shard, "dtype": kind, "seed": seed, "end": end, "shards": -(-n // shard)}
    shared = spark.sparkContext.broadcast(offsets)
    kinds = [pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int32()), pa.binary()]
    names = ["shard", "slots", "docs", "sizes", "data"]

    def deal(batches):
        for batch in batches:
            for part, first, m, owners, sizes, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, m * length * np.dtype(kind).itemsize), kind).reshape(m, length)
                slots = permute_array(np.arange(m) + first + shared.value[part], n, seed)
                order = np.argsort(slots, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(slots[order] // shard)) + 1):
                    blob = zstandard.ZstdCompressor(level=LEVEL).compress(ids[own].tobytes())
                    row = [[int(slots[own[0]] // shard)], [slots[own].tobytes()], [[owners[i] for i in own]], [[sizes[i] for i in own]], [blob]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names)

    def save(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for k, slots, owners, sizes, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k not in held:
                    held[k] = (np.empty((min(shard, n - k * shard), length), kind), {})
                room, about = held[k]
                at = np.frombuffer(slots, np.int64) - k * shard
                room[at] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, len(at) * room[0].nbytes), kind).reshape(-1, length)
                about.update(zip(at.tolist(), zip(owners, sizes, strict=True), strict=True))
        store, base = pa.fs.FileSystem.from_uri(root)
        for k, (room, about) in sorted(held.items()):
            name = f"shard-{k:08d}.bin"
            own = f"{base}/.{name}-{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(own) as f:
                f.write(room.data)
            store.move(own, f"{base}/{name}")
            at = range(len(room))
            cols = [[k * shard + i for i in at], [k] * len(room), list(at), [about[i][0] for i in at], [about[i][1] for i in at], [zlib.crc32(room[i, : about[i][1]].astype("<u4").data) for i in at], [name] * len(room)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.string()], strict=True)], ["slot", "shard", "position", "doc_ids", "n_tokens", "ids_crc32", "file"])

    dealt = blocks.mapInArrow(deal, "shard int, slots binary, docs array<array<long>>, sizes array<int>, data binary")
    manifest = f"{root}/manifest"
    dealt.repartitionById(max(1, meta["shards"]), "shard").mapInArrow(save, SCHEMA).write.mode("overwrite").parquet(manifest)
    drop_table(blocks)
    with fs.open_output_stream(f"{path}/.meta.json") as f:
        f.write(json.dumps(meta).encode())
    fs.move(f"{path}/.meta.json", f"{path}/meta.json")
    return spark.read.schema(SCHEMA).parquet(manifest)


def read(root: str, start: int = 0, stop: int | None = None):
    """Yields (slot, ids) from slot start on: resuming is a seek."""
    fs, path = pa.fs.FileSystem.from_uri(root)
    with fs.open_input_stream(f"{path}/meta.json") as f:
        meta = json.loads(f.read())
    stride = meta["length"] * np.dtype(meta["dtype"]).itemsize
    stop = meta["sequences"] if stop is None else min(stop, meta["sequences"])
    while start < stop:
        k, at = divmod(start, meta["shard"])
        with fs.open_input_file(f"{path}/shard-{k:08d}.bin") as f:
            f.seek(at * stride)
            for _ in range(at, min(meta["shard"], stop - k * meta["shard"])):
                yield start, np.frombuffer(f.read(stride), meta["dtype"])
                start += 1


def op10_training_order(spark, sf_dir: str) -> DataFrame:
    return write(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "shards"))
