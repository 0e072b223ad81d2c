"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is 1 where more than half of the text's shingle hashes (XXH64, seed 42) have it.  Distinct
fingerprints are compared; equal ones are one row with the smallest id.  With `radius` r the 64 bits are cut
into r + 2 bands: two fingerprints within r agree on two bands at least, so pairs of bands are the blocks.  A
block above `block_rows` is cut again by pairs of bands of its remaining bits, level by level, which loses no
link and bounds every block without emitting pairs.  Inside blocks the fingerprints are held as 64 vertical
bit planes; a shifted copy is compared with 64 rows per word, differing bits go into a carry-save counter that
starts so that it overflows past the radius, and words whose lanes have all overflowed are abandoned.  A block
gives the edges of a spanning star per component, at most a row each; stars meet in a distributed
large-star / small-star contraction.

Cases: null or empty text has fingerprint zero, linked like any other; fewer words than a shingle are one
shingle; repeated rows share fingerprint and component; a null id is never a component's name unless all are
null; an empty table gives no rows; clashing columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.llm.common import LOWER, NON_SPACE, cut, map_text, runs

SEED = 42
WORD = np.uint64(64)


def shingle_digests(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every row's shingles as (n, 8) big-endian bytes, and the first shingle of each row."""
    import xxhash

    mask, starts, ends, first = runs(data, off, NON_SPACE)
    if not len(starts):
        return np.zeros((0, 8), np.uint8), np.zeros(len(off), np.int64)
    keep = mask.copy()
    keep[1:] |= mask[:-1]  # one separator after each word
    place = np.concatenate([[0], np.cumsum(keep)])
    flat = LOWER[data]
    flat[~mask] = 0x20
    body = flat[keep].tobytes()
    a, length = place[starts], ends - starts
    z = a + length
    count = np.diff(first)
    grams = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(grams)])
    row = np.repeat(np.arange(len(count)), grams)
    begin = first[:-1][row] + np.arange(out[-1]) - out[:-1][row]
    stop = begin + np.minimum(count[row], size) - 1
    digest = xxhash.xxh64_digest
    got = b"".join([digest(body[s:e], SEED) for s, e in zip(a[begin].tolist(), z[stop].tolist(), strict=True)])
    return np.frombuffer(got, np.uint8).reshape(-1, 8), out


def fingerprints(data: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    digests, first = shingle_digests(data, off, size)
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        ones = np.empty((len(some), 64), np.int64)
        for byte in range(8):
            bits = np.unpackbits(digests[:, byte : byte + 1], axis=1)
            ones[:, byte * 8 : byte * 8 + 8] = np.add.reduceat(bits, first[:-1][some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > n[some][:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3, keep: list[str] | None = None, name: str = "simhash") -> DataFrame:
    def make():
        return lambda data, off: [pa.array(fingerprints(data, off, shingle).view(np.int64))]

    return map_text(docs, text_col, [T.StructField(name, T.LongType())], make, keep)


# --- blocks -----------------------------------------------------------------


def bands(bits: list[int], number: int) -> list[int]:
    """Masks of `number` bands of nearly equal width over the given bit places."""
    edges = [round(i * len(bits) / number) for i in range(number + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]


def block_masks(free: list[int], radius: int) -> list[tuple[int, list[int]]]:
    """Agreeing bits of each way to choose two of radius + 2 bands, and the places left free."""
    parts = bands(free, radius + 2)
    return [(a | b, [x for x in free if not ((a | b) >> x) & 1]) for a, b in combinations(parts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# --- comparison ---------------------------------------------------------------


def planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit i of all values, 64 values to a word."""
    n = len(values)
    padded = np.zeros((n + 63) // 64 * 64, np.uint64)
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def shifted(plane: np.ndarray, by: int) -> np.ndarray:
    """The plane whose lane i is lane i + by."""
    whole, part = divmod(by, 64)
    out = np.zeros_like(plane)
    n = plane.shape[-1] - whole
    if n > 0:
        out[..., :n] = plane[..., whole:] >> np.uint64(part)
        if part and n > 1:
            out[..., : n - 1] |= plane[..., whole + 1 :] << np.uint64(64 - part)
    return out


def near_lanes(sliced: np.ndarray, by: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """Words whose lane i says whether values i and i + by differ in at most radius bits, among wanted lanes."""
    width = max(1, radius.bit_length())
    bias = (1 << width) - 1 - radius
    alive = np.flatnonzero(wanted)
    out = np.zeros_like(wanted)
    over = ~wanted[alive]
    counter = [np.full(len(alive), np.uint64(0xFFFFFFFFFFFFFFFF) if (bias >> i) & 1 else np.uint64(0)) for i in range(width)]
    whole, part = divmod(by, 64)
    padded = np.zeros((64, sliced.shape[1] + whole + 2), np.uint64)
    padded[:, : sliced.shape[1]] = sliced
    for group in range(0, 64, 8):
        for p in range(group, group + 8):
            moved = padded[p, alive + whole]
            if part:
                moved = (moved >> np.uint64(part)) | (padded[p, alive + whole + 1] << np.uint64(64 - part))
            carry = sliced[p, alive] ^ moved
            for i in range(width):
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            over |= carry
        left = over != np.uint64(0xFFFFFFFFFFFFFFFF)
        if not left.all():
            alive, over, counter = alive[left], over[left], [c[left] for c in counter]
            if not len(alive):
                return out
    out[alive] = ~over
    return out


def stars(values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, smallest row of its component) among rows of the same group, which lie together.

    For links that need no further check: rows joined already are not compared again.
    """
    n = len(values)
    label = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, n))
    floor = 1
    while floor < (size.max() if len(size) else 0):
        # groups of floor + 1 to 2 * floor rows, one behind the other
        pick = np.flatnonzero((size > floor) & (size <= 2 * floor))
        if len(pick):
            rows = np.concatenate([np.arange(s, s + k) for s, k in zip(starts[pick].tolist(), size[pick].tolist(), strict=True)])
            left = np.concatenate([np.arange(k, 0, -1) for k in size[pick].tolist()])  # rows of the group from here on
            sliced = planes(values[rows])
            for by in range(1, int(size[pick].max())):
                apart = label[rows[:-by]] != label[rows[by:]]  # lanes joined before need no comparison
                lanes = np.zeros(sliced.shape[1] * 64, bool)
                lanes[: len(rows) - by] = apart & (left[:-by] > by)
                if not lanes.any():
                    if by % 64 == 0 and not _open(label, starts[pick], size[pick]):
                        break
                    continue
                near = near_lanes(sliced, by, np.packbits(lanes, bitorder="little").view(np.uint64), radius)
                hits = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
                if len(hits):
                    _join(label, rows[hits], rows[hits + by])
        floor *= 2
    root = _roots(label)
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _open(label: np.ndarray, starts: np.ndarray, size: np.ndarray) -> bool:
    """Whether some group is not yet one component."""
    return any((label[s : s + k] != label[s]).any() for s, k in zip(starts.tolist(), size.tolist(), strict=True))


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the pairs into label, in place; a label points to a smaller row of its component."""
    root = _roots(label)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        root = _roots(root)
    label[:] = root


def block_edges(keyed: DataFrame, radius: int) -> DataFrame:
    """Star edges of every block as fingerprints; keyed: (way, key, fp).

    A block's rows meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            change = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
            group = np.concatenate([[0], np.cumsum(change)])
            a, b = stars(rows[:, 2].view(np.uint64), group, radius)
            return pa.RecordBatch.from_arrays([pa.array(rows[a, 2]), pa.array(rows[b, 2])], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1))
            rows = np.ascontiguousarray(np.concatenate(held))
            if not len(rows):
                continue
            same = (rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1])  # the last block may go on
            stop = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if stop:
                yield edges(np.ascontiguousarray(rows[:stop]))
            held = [rows[stop:]]
        if held and len(held[0]):
            yield edges(np.ascontiguousarray(held[0]))

    return keyed.select("way", "key", "fp").repartition("way", "key").sortWithinPartitions("way", "key", "fp").mapInArrow(run, "a long, b long")


#: Crowded blocks (way and key, 16 bytes each) are broadcast up to this number and joined by shuffle beyond it.
HOT_BLOCKS = 200_000


def links(prints: DataFrame, radius: int, block_rows: int) -> DataFrame:
    """Star edges over distinct fingerprints (column fp): every pair within radius ends up connected."""
    first = block_masks(list(range(63, -1, -1)), radius)
    level = dict(enumerate(first))
    made = F.array(*[F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, (m, _) in enumerate(first)])
    rows, edges = prints.select("fp", F.inline(made)), None

    def deeper(below: dict[int, list[tuple[int, int]]]):
        """Rows of a crowded way under each of the ways below it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                way = batch.column("way").to_numpy()
                for w in np.unique(way).tolist():
                    part = batch.filter(pa.array(way == w))
                    fp = part.column("fp").to_numpy()
                    for name, mask in below[w]:
                        ways = pa.array(np.full(len(fp), name, np.int32))
                        yield pa.RecordBatch.from_arrays([part.column("fp"), ways, pa.array(fp & np.int64(_signed(mask)))], names=["fp", "way", "key"])

        return run

    while True:
        hot = cut(rows.groupBy("way", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows).select("way", "key"))
        number = hot.count()
        if not number:
            more = block_edges(rows, radius)
            return more if edges is None else edges.unionByName(more)
        known = F.broadcast(hot) if number <= HOT_BLOCKS else hot
        more = block_edges(rows.join(known, ["way", "key"], "left_anti"), radius)
        edges = more if edges is None else edges.unionByName(more)
        below: dict[int, list[tuple[int, int]]] = {}
        under: dict[int, tuple[int, list[int]]] = {}
        name = max(level) + 1
        for (way,) in hot.select("way").distinct().collect():  # few: the ways of one level
            mask, free = level[way]
            below[way] = []
            for m, f in block_masks(free, radius) if len(free) >= radius + 2 else [(0, [])]:
                below[way].append((name, mask | m))
                under[name] = (mask | m, f)
                name += 1
        crowded = rows.join(known, ["way", "key"], "left_semi").select("fp", "way")
        rows, level = cut(crowded.mapInArrow(deeper(below), "fp long, way int, key long")), under
        if all(len(f) < radius + 2 for _, f in level.values()):
            return edges.unionByName(block_edges(rows, radius))  # at most 2^(radius + 1) rows a block


# --- components -----------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; root is the component's smallest node.  Large-star / small-star."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    now, before = cut(now), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.filter("u != v").distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, block_rows: int = 4096
) -> DataFrame:
    """(id, simhash, component_id): component_id is the smallest id reachable over links of at most radius bits."""
    marked = cut(with_fingerprint(docs, text_col, shingle, [id_col]))
    prints = marked.groupBy("simhash").agg(F.min(id_col).alias("least"))
    prints = cut(prints.withColumnRenamed("simhash", "fp"))
    roots = components(links(prints.select("fp"), radius, block_rows))
    grouped = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    grouped = cut(grouped)
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(named, "root").select(F.col("fp").alias("simhash"), "component_id")
    return marked.join(named, "simhash").select(F.col(f"`{id_col}`"), "simhash", "component_id")
