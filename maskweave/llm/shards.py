"""Token sequences in a keyed training order, as fixed-stride binary shards.

Each partition's ids form a stream cut into sequences of `length` (the last one is padded with `pad_id` and
carries its true count).  Sequence i of partition p has index p * 2^24 + i; a keyed Feistel network with
cycle-walking permutes that index space of P * 2^24, so the permuted indices fall evenly over any equal
ranges.  Ranges of it are the shards: a task sorts a shard's sequences by permuted index and writes them one
after another, `stride` bytes each.  The number of sequences in the shards before gives a shard's first
global slot; slots are dense, and slot s lies at (s - first) * stride in its shard, which makes reads
sequential and resumable from any slot.  Files are written under a temporary name and renamed, so a task that
is run again replaces its own output.

Cases: null text is the closing id alone; an empty table gives no shard; repeated rows are written once each; an
id that `id_bytes` cannot hold, or more than 2^24 sequences in a partition, is an error.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskweave.llm.common import chunks, cut, mix64, temporary, text_buffers
from maskweave.llm.tokens import Vocabulary

PER_PARTITION = 1 << 24
ROUNDS = 6


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Keyed bijection of [0, size): a balanced Feistel network over the next even power of two, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix64(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & low)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(index, np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


class Upload:
    """A file that grows under a temporary name and replaces any earlier attempt's when it is done."""

    def __init__(self, folder: str) -> None:
        self.store, self.base = _store(folder)
        self.store.create_dir(self.base, recursive=True)
        self.temporary = f"{self.base}/.{uuid.uuid4().hex}"
        self.file = self.store.open_output_stream(self.temporary, compression=None)

    def write(self, data) -> None:
        self.file.write(data)

    def done(self, name: str) -> None:
        self.file.close()
        self.store.move(self.temporary, f"{self.base}/{name}")


def materialise(
    docs: DataFrame,
    vocabulary: str,
    folder: str | None = None,
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 1,
    pad_id: int = 0,
    key: int = 20240229,
    shards: int | None = None,
    id_bytes: int = 2,
) -> DataFrame:
    """Rows (slot, shard, shard_offset, permuted, source_index, n_tokens, crc32, path), one per sequence.

    shards: as many as the input has partitions by default, so that a shard holds about a partition's ids.
    id_bytes: 2 for vocabularies of up to 65,536 ids, 4 for larger ones.
    """
    if id_bytes not in (2, 4) or max(end_id, pad_id) >> 8 * id_bytes:
        raise ValueError("ids take 2 or 4 bytes, and the closing and padding ids must fit")
    kind = np.dtype(f"<u{id_bytes}")
    folder = folder or temporary(docs.sparkSession, "shards")
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("__text"))
    parts = max(1, source.rdd.getNumPartitions())
    size, shards = parts * PER_PARTITION, shards or parts

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, number = Vocabulary(vocabulary), TaskContext.get().partitionId() * PER_PARTITION
        held, end = np.zeros(0, kind), np.array([end_id], kind)

        def rows(flat: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            if number % PER_PARTITION + len(counts) > PER_PARTITION:
                raise ValueError(f"over {PER_PARTITION} sequences in a partition: repartition the input")
            index = np.arange(number, number + len(counts), dtype=np.uint64)
            moved = permute(index, size, key)
            off = np.arange(len(counts) + 1, dtype=np.int32) * (length * id_bytes)
            ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat))])
            shard = (moved.astype(object) * shards // size).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), pa.array(moved.astype(np.int64)), pa.array(index.astype(np.int64)), pa.array(counts.astype(np.int32)), ids],
                names=["shard", "permuted", "source_index", "n_tokens", "ids"],
            )

        for batch in batches:
            data, off = text_buffers(batch.column(0))
            for a, b in chunks(off, 4 << 20):
                ids, at = vocab.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
                if len(ids) and int(ids.max()) >> 8 * id_bytes:
                    raise ValueError(f"the vocabulary has ids that {id_bytes} bytes cannot hold")
                closed = np.insert(ids.astype(kind), at[1:], end[0])
                held = np.concatenate([held, closed])
                whole = len(held) // length
                yield rows(held[: whole * length], np.full(whole, length))
                number += whole
                held = held[whole * length :]
        if len(held):
            yield rows(np.concatenate([held, np.full(length - len(held), pad_id, kind)]), np.array([len(held)]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard's rows all lie in this task and go to its file one by one."""
        now, file, notes = None, None, []

        def flush() -> pa.RecordBatch:
            path = f"shard-{now:06d}.bin"
            file.done(path)
            cols = list(zip(*notes, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip([*cols, range(len(notes)), [f"{folder}/{path}"] * len(notes)], [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()], strict=True)],
                names=["shard", "permuted", "source_index", "n_tokens", "crc32", "rank", "path"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if notes:
                        yield flush()
                    now, file, notes = row[0], Upload(folder), []
                file.write(row[4])
                notes.append((*row[:4], zlib.crc32(row[4])))
        if notes:
            yield flush()

    made = source.mapInArrow(sequences, "shard int, permuted long, source_index long, n_tokens int, ids binary")
    dealt = made.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "permuted")
    notes = cut(dealt.mapInArrow(write, "shard int, permuted long, source_index long, n_tokens int, crc32 long, rank long, path string"))
    # one row per shard, `shards` at most
    first = notes.groupBy("shard").agg(F.count("*").alias("n")).withColumn("first", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    return notes.join(F.broadcast(first.drop("n")), "shard").select(
        (F.col("first") + F.col("rank")).alias("slot"), "shard", (F.col("rank") * length * id_bytes).alias("shard_offset"), "permuted", "source_index", "n_tokens", "crc32", "path"
    )


def read_slot(path: str, offset: int, length: int = 2048, id_bytes: int = 2) -> np.ndarray:
    """The ids at one slot, by position alone."""
    folder, _, name = path.rpartition("/")
    store, base = _store(folder)
    with store.open_input_file(f"{base}/{name}") as f:
        f.seek(offset)
        return np.frombuffer(f.read(length * id_bytes), f"<u{id_bytes}")
