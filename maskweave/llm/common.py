"""Shared pieces: the cluster's shared folder, Arrow mapping over a text column, and byte-level word scans.

Word scans work on UTF-8 bytes.  Every separator class used here is ASCII, so a byte table
decides each byte and multi-byte characters never need decoding.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at once inside a Python worker; bounds its memory whatever the Arrow batch holds.
CHUNK_BYTES = 1 << 20

WHITESPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def byte_class(members: bytes, invert: bool = False) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return ~table if invert else table


#: `[^\x20\x09-\x0D]`
NON_SPACE = byte_class(WHITESPACE, invert=True)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` once A-Z are lower-cased
ALNUM = byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's; a temporary one only in local mode."""
    context = spark.sparkContext
    folder, current = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir is not set: executors of a cluster need a folder that all of them reach")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return (folder or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def temporary(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write a small derived table to the shared folder, so later reads do not repeat what made it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """Write a large derived table to the shared folder as Parquet, of which later reads take the columns they need."""
    path = f"{temporary(df.sparkSession, 'table')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """df under the column names c0, c1 and so on, so that no name of its own can clash with an operator's."""
    return df.select(*[F.col(f"`{f.name}`").cast("string" if isinstance(f.dataType, T.NullType) else f.dataType).alias(f"c{k}") for k, f in enumerate(df.schema)])


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of a numbered table under their own names."""
    return df.select(*[(F.lit(None) if isinstance(f.dataType, T.NullType) else F.col(f"c{k}").cast(f.dataType)).alias(f.name) for k, f in enumerate(like.schema)])


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """Input columns whose names an operator's own columns need are left out (names compare without case)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text stands alone."""
    n, first = len(off) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def map_text(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[np.ndarray, np.ndarray], list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append columns computed from whole texts, `CHUNK_BYTES` at a time.

    `make()` runs once per task and returns a function of (bytes, offsets) giving one array per field.
    Only `keep` (default: all columns) and the text column travel to Python.
    """
    names = [f.name for f in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([source.schema[i] for i in range(len(keep))] + fields)
    kinds = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            data, off = text_buffers(batch.column(len(keep)))
            for a, b in chunks(off):
                made = fn(data[off[a] : off[b]], off[a : b + 1] - off[a])
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(i) for i in range(len(keep))] + [x.cast(k) for x, k in zip(made, kinds, strict=True)],
                    names=[*keep, *names],
                )

    return source.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def runs(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes: (mask, starts, ends, first run of each row and the total)."""
    mask = member[data]
    n = len(mask)
    if not n:
        return mask, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(n, bool)
    edge[off[:-1][off[:-1] < n]] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge))
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, edge[1:] | ~mask[1:]
    ends = np.flatnonzero(mask & last) + 1
    return mask, starts, ends, np.searchsorted(starts, off)


def binary_array(data: np.ndarray, off: np.ndarray) -> pa.Array:
    off = np.ascontiguousarray(off, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated `arange(start, start + length)`."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return out + np.arange(total)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def list_array(values: pa.Array, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)
