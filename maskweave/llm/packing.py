"""Bounded-space online packing of token ids into sequences of at most `length`.

Each partition keeps at most `windows` open.  A document's full stretches of `length` ids become sequences
of their own; its remainder goes to the open window that it fits best.  When none fits and all windows are
open, the fullest is topped up from the remainder and emitted, so nothing emitted is padded.  At the end of
a partition its windows are merged, fullest from emptiest, until one tail is left; the tails of `merge`
neighbouring partitions are merged the same way, and what is left there is cut at powers of two, which
need no padding.

Cases: null or empty text is the closing id alone; repeated rows are packed once each; a null id is carried
as null; an empty table gives no rows; other columns of the input are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.llm.common import chunks, cut, table, text_buffers
from maskweave.llm.tokens import Vocabulary

#: Numbers of the second round's sequences start here, above any partition's own.
MERGED = 1 << 62


class Packer:
    """Pieces are [doc, start, ids, doc_tokens]; `out` gets one list of pieces per finished sequence."""

    def __init__(self, length: int, windows: int) -> None:
        self.length, self.windows, self.out = length, windows, []
        self.open: list[list] = []  # [free, pieces]

    def add(self, doc, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.length:
            self.out.append([[doc, at, ids[at : at + self.length], n]])
            at += self.length
        while at < n:
            rest = n - at
            best = None
            for w in self.open:
                if w[0] >= rest and (best is None or w[0] < best[0]):
                    best = w
            if best is None and len(self.open) < self.windows:
                best = [self.length, []]
                self.open.append(best)
            best = best or min(self.open, key=lambda w: w[0])
            take = min(rest, best[0])
            best[1].append([doc, at, ids[at : at + take], n])
            best[0] -= take
            at += take
            if not best[0]:
                self._emit(best)

    def _emit(self, window: list) -> None:
        self.out.append(window[1])
        self.open = [w for w in self.open if w is not window]

    def merge(self) -> list:
        """Fill the fullest window from the emptiest until at most one is left; its pieces are returned."""
        while len(self.open) > 1:
            self.open.sort(key=lambda w: w[0])
            full, low = self.open[0], self.open[-1]
            doc, start, ids, n = low[1].pop()
            low[0] += len(ids)
            take = min(len(ids), full[0])
            full[1].append([doc, start, ids[:take], n])
            full[0] -= take
            if take < len(ids):
                low[1].append([doc, start + take, ids[take:], n])
                low[0] -= len(ids) - take
            if not full[0]:
                self._emit(full)
            self.open = [w for w in self.open if w[1]]
        return self.open[0][1] if self.open else []


def halves(pieces: list, length: int) -> list[list]:
    """Cut a tail shorter than `length` into sequences whose sizes are powers of two."""
    out, size, room = [], 0, 0
    left = sum(len(p[2]) for p in pieces)
    for doc, start, ids, n in pieces:
        while len(ids):
            if not room:
                size = 1 << (left.bit_length() - 1)
                room, left = size, left - size
                out.append([])
            take = min(room, len(ids))
            out[-1].append([doc, start, ids[:take], n])
            room -= take
            start, ids = start + take, ids[take:]
    return out


def _rows(sequences: list[list], first: int) -> list[tuple]:
    rows = []
    for k, pieces in enumerate(sequences, first):
        at = 0
        for doc, start, ids, n in pieces:
            rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), n, k, at, ids))
            at += len(ids)
    return rows


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    windows: int = 32,
    end_id: int = 1,
    merge: int = 64,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, the ids.

    `ids` are little-endian unsigned 32-bit, as the checksum takes them.  Sequence numbers are unique, not dense.
    """
    kind = docs.schema[id_col].dataType
    fields = [(id_col, kind)] + [(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields += [("ids", T.BinaryType()), ("tail_of", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)

    def batch_of(rows: list[tuple], tail_of, keep: bool) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
        data = [*cols[:7], [x.astype("<u4").tobytes() for x in cols[7]] if keep else [None] * len(rows), [tail_of] * len(rows)]
        return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(data, shape, strict=True)], schema=shape)

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, packer, part = Vocabulary(vocabulary), Packer(length, windows), TaskContext.get().partitionId()
        number, end = part << 36, np.array([end_id], np.uint32)
        for batch in batches:
            keys = batch.column(0)
            data, off = text_buffers(batch.column(1))
            for a, b in chunks(off, 4 << 20):
                ids, at = vocab.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
                for k in range(b - a):
                    packer.add(keys[a + k].as_py(), np.concatenate([ids[at[k] : at[k + 1]], end]))
                yield batch_of(_rows(packer.out, number), None, with_ids)
                number += len(packer.out)
                packer.out = []
        tail = packer.merge()
        yield batch_of(_rows(packer.out, number), None, with_ids)
        if tail:
            yield batch_of(_rows([tail], number + len(packer.out)), part // merge, True)

    def second_round(key: tuple, tails: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(length, 1)
        tails = tails.sort_values(["sequence_id", "offset"])
        done, at, pieces = [], 0, []
        for doc, start, n, ids in zip(tails[id_col], tails["start"], tails["doc_tokens"], tails["ids"], strict=True):
            ids = np.frombuffer(ids, "<u4")
            while len(ids):
                take = min(length - at, len(ids))
                pieces.append([None if pd.isna(doc) else doc, start, ids[:take], n])
                start, ids, at = start + take, ids[take:], (at + take) % length
                if not at:
                    done.append(pieces)
                    pieces = []
        rows = _rows(done + halves(pieces, length), MERGED | (int(key[0]) << 24))
        made = pd.DataFrame(rows, columns=[f[0] for f in fields[:8]])
        made["ids"] = [x.astype("<u4").tobytes() if with_ids else None for x in made["ids"]]
        made["tail_of"] = pd.Series([None] * len(made), dtype="Int64")
        made[id_col] = made[id_col].astype("Int64") if isinstance(kind, (T.LongType, T.IntegerType)) else made[id_col]
        return made

    source = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    pieces = source.mapInArrow(first_round, schema)
    pieces = table(pieces) if with_ids else cut(pieces)  # texts are tokenised once
    merged = pieces.filter("tail_of is not null").groupBy("tail_of").applyInPandas(second_round, schema)
    out = pieces.filter("tail_of is null").unionByName(merged).drop("tail_of")
    return out if with_ids else out.drop("ids")
