"""Benchmark decontamination by winnowing.

An item's windows are its runs of `window` consecutive words; a shorter item is one window.  Words become
numbers of the items' vocabulary (exact; other words are -1), k-gram hashes of those are winnowed: each
stretch of `window - k + 1` k-grams keeps its minimum (every tie of it).  A window that a document shares
with an item holds one whole stretch, so both sides keep the same minimum there and the equi-join of
fingerprints finds it: every shared span of at least `window` words is met.  A hit is extended by testing the
windows around it, word number by word number, and marking all words inside those that match.  Items shorter
than a window lie below that guarantee; runs of their length are looked up directly.

Items travel in blocks of at most `block_bytes` of text (a longer item stands alone), sizes that are summed before
anything is collected; each block is one pass over the documents, so no document ever moves.  A worker builds a
block once.

Cases: null text has no words; items without words or null items never occur; a repeated item counts once per
item id; a null item id is left out; empty documents or items give zero hits; clashing columns are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.llm.common import ALNUM, CHUNK_BYTES, LOWER, binary_array, chunks, cut, drop_clashing, list_array, mix64, ranges, runs, text_buffers

NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all rows and the first word of each row, with the total."""
    mask, starts, ends, first = runs(data, off, ALNUM)
    return binary_array(LOWER[data[mask]], np.concatenate([[0], np.cumsum(ends - starts)])), first


def gram_hash(codes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k numbers from each position on; callers mask positions near a row's end."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = mix64(codes.astype(np.int64).astype(np.uint64) + np.uint64(salt << 40))
    out = base[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + base[j : j + n]
    return mix64(out) & np.uint64(0xFFFFFFFFFFFFFFFE)


def winnow(codes: np.ndarray, last: np.ndarray, k: int, window: int) -> np.ndarray:
    """Positions of the kept k-grams.  last: one past the row's end, per word."""
    stretch = window - k + 1
    grams = gram_hash(codes, k)
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(codes < 0)])
    grams[bad[k:] != bad[: len(bad) - k]] = NEVER
    inside = np.arange(n) + window <= last[:n]
    least = grams[:n].copy()
    for j in range(1, stretch):
        np.minimum(least, grams[j : j + n], out=least)
    inside &= least != NEVER
    keep = np.zeros(len(grams), bool)
    for j in range(stretch):
        keep[j : j + n] |= inside & (grams[j : j + n] == least)
    return np.flatnonzero(keep)


class Block:
    """A block of items, ready for lookups."""

    def __init__(self, items: list[tuple[str, str]], k: int, window: int) -> None:
        self.k, self.window = k, window
        data, off = text_buffers(pa.array([t for _, t in items], pa.large_string()))
        toks, first = words(data, off)
        self.vocab = pc.unique(toks)
        codes = self.codes = pc.index_in(toks, self.vocab).to_numpy(zero_copy_only=False).astype(np.int32)
        self.names = sorted({i for i, _ in items})
        rank = {x: j for j, x in enumerate(self.names)}
        owner = np.array([rank[i] for i, _ in items], np.int64)
        sizes = np.diff(first)
        last = np.repeat(first[1:], sizes)
        row = np.repeat(np.arange(len(items)), sizes)
        kept = winnow(codes, last, k, window)
        self.prints = np.unique(gram_hash(codes, k)[kept]) if len(kept) else np.zeros(0, np.uint64)
        self.tables = {}
        for size in sorted({int(s) for s in sizes if 0 < s < window} | {window}):
            if size == window:
                at = np.flatnonzero(np.arange(len(codes)) + window <= last)
            else:
                at = first[:-1][sizes == size]
            if len(at):
                self.tables[size] = self._table(codes, at, owner[row[at]], size)

    def _table(self, codes: np.ndarray, at: np.ndarray, owner: np.ndarray, size: int) -> tuple:
        """Distinct runs: salt, sorted hashes, a place of each, and the items of each as offsets and values.

        Another salt is taken where two runs share a hash, so a hash stands for one run.
        """
        salt = 0
        while True:
            hashes = gram_hash(codes, size, salt)[at]
            order = np.argsort(hashes, kind="stable")
            fresh = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
            lead = at[order][np.flatnonzero(fresh)]
            number = np.cumsum(fresh) - 1
            if all((codes[at[order] + j] == codes[lead[number] + j]).all() for j in range(size)):
                break
            salt += 1
        pairs = np.unique(number * np.int64(len(self.names)) + owner[order])
        offsets = np.searchsorted(pairs, np.arange(len(lead) + 1) * np.int64(len(self.names)))
        return salt, hashes[order][fresh], lead, offsets, pairs % len(self.names)

    def find(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word of each row, hit flag per word, rows and items of the distinct pairs found)."""
        toks, first = words(data, off)
        hit_edges = np.zeros(len(toks) + 1, np.int64)
        none = np.zeros(0, np.int64)
        if not len(toks) or not len(self.vocab):
            return first, hit_edges[:-1] > 0, none, none
        codes = pc.fill_null(pc.index_in(toks, self.vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(first)
        last = np.repeat(first[1:], sizes)
        owners, items = [], []
        for size, table in self.tables.items():
            if size == self.window:
                kept = winnow(codes, last, self.k, size)
                kept = kept[_member(gram_hash(codes, self.k)[kept], self.prints)] if len(kept) else kept
                at = np.unique((kept[:, None] - np.arange(size - self.k + 1)).reshape(-1))
                at = at[(at >= 0)]
            else:
                known = np.concatenate([[0], np.cumsum(codes < 0)])
                at = np.flatnonzero(known[size:] == known[: len(known) - size]) if len(codes) >= size else none
            at = at[at + size <= last[at]] if len(at) else at
            if not len(at):
                continue
            salt, hashes, lead, offsets, owned = table
            number = np.minimum(np.searchsorted(hashes, gram_hash(codes[at[:, None] + np.arange(size)].reshape(-1), size, salt)[::size]), len(hashes) - 1)
            for j in range(size):
                same = codes[at + j] == self.codes[lead[number] + j]
                at, number = at[same], number[same]
            np.add.at(hit_edges, at, 1)
            np.add.at(hit_edges, at + size, -1)
            row = np.searchsorted(first, at, "right") - 1
            both = np.unique(np.stack([row, number], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            many = offsets[both[:, 1] + 1] - offsets[both[:, 1]]
            owners.append(np.repeat(both[:, 0], many))
            items.append(owned[ranges(offsets[both[:, 1]], many)])
        hit = np.cumsum(hit_edges[:-1]) > 0
        if not owners:
            return first, hit, none, none
        pairs = np.unique(np.stack([np.concatenate(owners), np.concatenate(items)], 1), axis=0)
        return first, hit, pairs[:, 0], pairs[:, 1]


_KEPT: dict[str, Block] = {}


def _kept(name: str, make) -> Block:
    """The block of that name; a worker makes it once and keeps it over its tasks, one at a time."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks whose total text is checked to stay under block_bytes (a longer item stands alone)."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("i is not null and t is not null").distinct()
    size = F.sum(F.octet_length("t") + F.octet_length("i") + 64)
    total = items.agg(size).first()[0] or 0
    if total <= block_bytes:
        if total:
            yield [tuple(r) for r in items.collect()]  # at most block_bytes
        return
    number = int(2 * total // block_bytes) + 1
    while True:
        dealt = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(number)))
        most = dealt.groupBy("b").agg(size.alias("n"), F.count("*").alias("c")).filter("c > 1").agg(F.max("n")).first()[0] or 0
        if most <= block_bytes:
            break
        number *= 2
    for b in range(number):
        if rows := [tuple(r) for r in dealt.filter(F.col("b") == b).select("i", "t").toLocalIterator()]:
            yield rows


ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 5,
    window: int = 10,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (flat starts and ends of hit words, in words) and items (sorted strings)."""
    names = [f.name for f in ADDED]
    base = drop_clashing(docs, names)
    keep, schema = base.columns, T.StructType([*base.schema.fields, *ADDED])
    place = keep.index(text_col)
    blocks = list(_blocks(benchmark, item_col, item_text_col, block_bytes)) or [[]]

    def one(made, first_pass: bool, name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _kept(name, lambda: Block(made.value, k, window))
            for batch in batches:
                data, off = text_buffers(batch.column(place))
                for a, b in chunks(off, CHUNK_BYTES):
                    rows = batch.slice(a, b - a)
                    first, hit, owner, item = block.find(data[off[a] : off[b]], off[a : b + 1] - off[a])
                    if not first_pass:
                        hit = _union(hit, first, rows.column(len(keep) + 2))
                    counts = np.concatenate([[0], np.cumsum(hit)])[first]
                    spans, spanoff = _spans(hit, first)
                    found = [np.array(block.names, object)[item], np.searchsorted(owner, np.arange(b - a + 1))]
                    listed = list_array(pa.array(found[0], pa.string()), found[1])
                    if not first_pass:
                        listed = pa.array([sorted({*x, *y}) for x, y in zip(rows.column(len(keep) + 3).to_pylist(), listed.to_pylist(), strict=True)], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(i) for i in range(len(keep))] + [pa.array(np.diff(first)), pa.array(np.diff(counts)), list_array(pa.array(spans), spanoff), listed], names=[*keep, *names]
                    )

        return run

    out = base
    for i, items in enumerate(blocks):
        out = out.mapInArrow(one(docs.sparkSession.sparkContext.broadcast(items), not i, uuid.uuid4().hex), schema)
        if i + 1 < len(blocks):
            out = cut(out)  # one block's memory at a time
    return out


def _spans(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in words of the row, of runs of hit words; offsets per row."""
    mask, starts, ends, row = runs(hit.astype(np.uint8), first, np.arange(256) == 1)
    lead = first[np.searchsorted(first, starts, "right") - 1] if len(starts) else starts
    return np.stack([starts - lead, ends - lead], 1).reshape(-1), row * 2


def _union(hit: np.ndarray, first: np.ndarray, spans: pa.Array) -> np.ndarray:
    edges = np.zeros(len(hit) + 1, np.int64)
    for lead, flat in zip(first[:-1].tolist(), spans.to_pylist(), strict=True):
        for a, b in zip(flat[::2], flat[1::2], strict=True):
            edges[lead + a] += 1
            edges[lead + b] -= 1
    return hit | (np.cumsum(edges[:-1]) > 0)
