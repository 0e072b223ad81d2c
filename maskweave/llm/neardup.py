"""Near-duplicate groups: candidates by SimHash, the rest by an exact prefix filter on word shingles; pairs checked on whole texts.

Two texts are near copies if the Jaccard similarity of their sets of `shingle`-word shingles reaches `similarity`.
Candidates come first from the SimHash operator: fingerprints of all texts, linked by its bit-sliced comparison at `radius` bits.
A similarity bounds no distance of fingerprints, so pairs that it leaves open are met by an exact prefix filter.

All shingles have one order, the frequent ones last (any order is right; this one keeps blocks small).  How frequent
one is comes from a count over all texts, in a table of fixed size that shingles share by hash.  Near copies of n and m shingles share `similarity` x max(n, m) at least, so each one's first
n - ceil(similarity x n) + 1 shingles hold one of the other's, whatever the edit: no pair is missed.  Texts that share
such a shingle are a block.  The smaller text of a pair has the first shared shingle still earlier, so a block without a
text that has it that early, as those of a passage that makes up less than eight ninths of its texts, holds no pair.  Pairs whose sizes or whose places of the shared shingle rule the similarity out are
passed over; bit maps of the sets, which bound their difference from below, rule most others out before texts move.

Groups are the components of the pairs that pass, found in three steps, of which each takes only pairs that are not joined
by then.  First the links of SimHash are checked.  Then each text is checked with one text that
leads a block of it: the one with the fewest rarer shingles, which in a crowd of copies is the least changed one; this
joins such crowds.  Then every pair of a block that is still open is checked, so no link is lost.  A block's
leader comes from an aggregate and a join; shingles counted more than `split` times are joined in parts of that many rows.
In the third step blocks above `crowd` texts are dealt out: texts in the block's largest group go to one part each, the
few others to all parts.

Cases: null is the empty text; equal texts are one group; texts without words are one group; repeated rows are
in the group of their text; null ids come after all others; ids may be of any type that has an order, and may repeat;
an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.llm.common import CHUNK_BYTES, LOWER, NON_SPACE, chunks, cut, list_array, map_text, mix64, numbered, ranges, restored, runs, table, text_buffers
from maskweave.llm.quality import word_hashes
from maskweave.llm.simhash import components, fingerprints, links

#: Counters that all shingles share, and how many of them move as one row.
BUCKETS, SLICE = 1 << 18, 1 << 12
#: SimHash's own shingles are of so many words.
PRINT_WORDS = 3
#: Steps of a rank from one power of two of a count to the next.
STEPS = 4
#: Pairs handed on at once by a task.
PAIRS = 1 << 20
#: Keys that choose rows of texts are broadcast up to this number and joined by shuffle beyond it.
FEW = 200_000


def _chosen(rows: DataFrame, col: str, keys: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of rows with a one-column table of keys, which is broadcast if it is small."""
    keys = cut(keys.toDF("__chosen"))
    keys = F.broadcast(keys) if keys.count() <= FEW else keys
    return rows.join(keys, F.col(col) == F.col("__chosen"), how)


def every_shingle(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats included, and the row of each."""
    _, starts, ends, first = runs(data, off, NON_SPACE)
    count = np.diff(first)
    grams = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), grams)
    if not len(row):
        return np.zeros(0, np.uint64), row
    words = mix64(word_hashes(LOWER[data], starts, ends))
    begin = ranges(first[:-1], grams)
    length = np.minimum(count[row], size)
    values = length.astype(np.uint64)
    for k in range(size):
        values = np.where(length > k, mix64(values ^ words[np.minimum(begin + k, len(words) - 1)]), values)
    return values, row


def word_shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted, and the first of each row and the total."""
    values, row = every_shingle(data, off, size)
    if not len(row):
        return values, np.zeros(len(off), np.int64)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    fresh = np.concatenate([[True], (values[1:] != values[:-1]) | (row[1:] != row[:-1])])
    values, row = values[fresh], row[fresh]
    return values, np.searchsorted(row, np.arange(len(off)))


def prefixes(data: np.ndarray, off: np.ndarray, size: int, similarity: float, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every row's first shingles in the common order, their offsets, the row's number of shingles, its bit map and the maps' offsets.

    A shingle is given as its rank, in the highest 8 bits, and 56 bits of its hash.  Rows without words have one shingle of their own kind.
    """
    values, first = word_shingles(data, off, size)
    maps = parities(values, first)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    placed = rank[bucket(values)].astype(np.uint64) << np.uint64(56) | values >> np.uint64(8)
    placed = placed[np.lexsort((placed, row))]
    taken = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
    kept = placed[ranges(first[:-1], taken)]
    out = np.concatenate([[0], np.cumsum(np.maximum(taken, 1))])
    whole = np.zeros(out[-1], np.uint64)
    whole[ranges(out[:-1], taken)] = kept
    return whole, out, n, *maps


def parities(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit map of each row's shingles, of two to four bits for each, and the maps' offsets: a bit says whether an odd number falls on it.

    Maps of two sets differ in at most as many bits as the sets in shingles; a map folds to half its size by XOR.
    """
    n = np.diff(first)
    words = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64) >> 6)
    off = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(off[-1], np.uint64)
    place = values & np.repeat(words * 64 - 1, n).astype(np.uint64)
    np.bitwise_xor.at(out, np.repeat(off[:-1], n) + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out, off


def folded(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two maps differ, the larger one folded."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def bucket(values: np.ndarray) -> np.ndarray:
    """The counter of every shingle."""
    return (values & np.uint64(BUCKETS - 1)).astype(np.int64)


def counted(texts: DataFrame, shingle: int) -> np.ndarray:
    """How often shingles of each bucket occur in all texts: tasks add up their own, then `SLICE` counters at a time meet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, off = text_buffers(batch.column(0))
            for a, b in chunks(off):
                total += np.bincount(bucket(every_shingle(data[off[a] : off[b]], off[a : b + 1] - off[a], shingle)[0]), minlength=BUCKETS)
        if total.any():
            at = np.flatnonzero(total.reshape(-1, SLICE).any(1))
            numbers = pa.array(np.minimum(total.reshape(-1, SLICE)[at].ravel(), np.iinfo(np.int32).max).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), list_array(numbers, np.arange(len(at) + 1) * SLICE)], names=["slice", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            numbers, off = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            for k, at in enumerate(batch.column(0).to_pylist()):
                total[at] = total.get(at, 0) + numbers[off[k] : off[k + 1]].astype(np.int64)
        if total:
            at = list(total)
            numbers = np.concatenate([total[k] for k in at])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(at, np.int32)), list_array(pa.array(numbers), np.arange(len(at) + 1) * SLICE)], names=["slice", "n"])

    own = texts.select("t").mapInArrow(count, "slice int, n array<int>")
    out = np.zeros(BUCKETS, np.int64)
    for r in own.repartition("slice").mapInArrow(add, "slice int, n array<long>").collect():  # BUCKETS numbers at every size
        out[r.slice * SLICE : (r.slice + 1) * SLICE] = r.n
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * np.log2(np.maximum(counts, 1))).astype(np.uint8)


class _Wide:
    """Joins of rows (h, node, ...) with a table of one row for each h, where one h may be in very many rows.

    Shingles whose bucket counts more than `split`, and more than eight times the mean of all buckets, meet in parts.
    """

    def __init__(self, counts: np.ndarray, split: int) -> None:
        self.split = max(split, 8 * int(counts.sum()) // BUCKETS, 1)
        rank = F.shiftrightunsigned("h", 56)
        self.wide = rank >= int(np.ceil(STEPS * np.log2(self.split)))
        self.parts = F.ceil(F.pow(F.lit(2.0), (rank + 1) / STEPS) / self.split).cast("bigint")

    def join(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        plain = rows.filter(~self.wide).join(keys.filter(~self.wide).hint("shuffle_hash"), "h")
        dealt = rows.filter(self.wide).withColumn("salt", F.pmod(F.xxhash64("node"), self.parts))
        copies = keys.filter(self.wide).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), self.parts - 1)))
        return plain.unionByName(dealt.join(copies.hint("shuffle_hash"), ["h", "salt"]).drop("salt"))


def similarities(left: pa.Array, right: pa.Array, shingle: int) -> np.ndarray:
    """Jaccard similarity of two columns of texts, row by row; 1 where neither has a word."""
    a, ao = word_shingles(*text_buffers(left), shingle)
    b, bo = word_shingles(*text_buffers(right), shingle)
    out = np.ones(len(ao) - 1)
    for k in range(len(out)):
        x, y = a[ao[k] : ao[k + 1]], b[bo[k] : bo[k + 1]]
        if len(x) or len(y):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[k] = both / (len(x) + len(y) - both)
    return out


def _parts(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about `CHUNK_BYTES` over several text columns."""
    total = sum(text_buffers(c)[1] for c in columns)
    first = 0
    while first < len(total) - 1:
        last = max(first + 1, int(np.searchsorted(total, total[first] + CHUNK_BYTES, "right")) - 1)
        yield first, last
        first = last


def _checked(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop in _parts(batch.column(2), batch.column(3)):
                part = batch.slice(at, stop - at)
                good = pa.array(similarities(part.column(2), part.column(3), shingle) >= similarity)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], names=["a", "b"])

    return run


def _possible(similarity: float):
    """Pairs that the bit maps do not rule out; batches of (a, b, sizes, maps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = (1 - similarity) / (1 + similarity)
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            (x, xo), (y, yo) = [(c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (batch.column(4), batch.column(5))]
            differ = [folded(x[xo[k] : xo[k + 1]], y[yo[k] : yo[k + 1]]) for k in range(batch.num_rows)]
            good = pa.array(np.array(differ, np.int64) <= share * sizes + 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of whole blocks, sorted by the first two columns, as (rows, columns)."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
        same = (rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1])
        start = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1  # the last block may go on
        if start or (held and (held[0][0, :2] != rows[0, :2]).any()):
            yield np.concatenate([*held, rows[:start]])
            held = []
        held.append(rows[start:])
    if held:
        yield np.concatenate(held)


def could_pass(n, m, p, q, similarity: float):
    """Whether sizes n and m and the places p and q of a shared shingle allow the similarity, for columns and arrays alike."""
    least = similarity / (1 + similarity)
    return (n - p >= least * (n + m) - 1e-9) & (m - q >= least * (n + m) - 1e-9) & (n >= similarity * m - 1e-9) & (m >= similarity * n - 1e-9)


def leading(n, p, similarity: float):
    """Whether a shingle's place lets its text be the smaller one of a pair; every pair has such a text where its first shared shingle is."""
    return n - p >= 2 * similarity / (1 + similarity) * n - 1e-9


def open_pairs(rows: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """(a, b), a > b, of rows (h, part, node, n, pos, root, role), sorted by h and part: all pairs of a block that are not joined.

    A row of role 1 is in every part of its block: it meets the rows of role 0 here, and others of role 1 in one part only.
    """
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
    size = np.diff(np.append(starts, len(rows)))
    left = np.repeat(starts + size, size) - np.arange(len(rows)) - 1  # rows of the block behind a row

    def passing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        apart = rows[x, 5] != rows[y, 5]
        x, y = x[apart], y[apart]
        good = could_pass(rows[x, 3], rows[y, 3], rows[x, 4], rows[y, 4], similarity)
        good &= (rows[x, 6] == 0) | (rows[y, 6] == 0) | (rows[x, 1] == 0)
        a, b = rows[x[good], 2], rows[y[good], 2]
        return np.stack([np.maximum(a, b), np.minimum(a, b)], 1)

    x, by = np.arange(len(rows)), 1
    while len(x := x[left[x] >= by]):
        yield passing(x, x + by)
        by += 1


def _pairs(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            made = np.unique(np.concatenate(held), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

        held, number = [np.zeros((0, 2), np.int64)], 0
        for rows in _blocks(batches):
            for made in open_pairs(rows, similarity):
                if len(made):
                    held.append(made)
                    number += len(made)
                if number > PAIRS:
                    yield out(held)
                    held, number = [np.zeros((0, 2), np.int64)], 0
        yield out(held)

    return run


def alike(marked: DataFrame, radius: int, block_rows: int) -> DataFrame:
    """(a, b), a > b, of texts (node, fp) that SimHash links: each with the least text of its fingerprint, and those of linked fingerprints."""
    prints = cut(marked.groupBy("fp").agg(F.min("node").alias("b")))
    same = marked.select("fp", F.col("node").alias("a")).join(prints, "fp").select("a", "b")
    edges = links(prints.select("fp"), radius, block_rows).distinct()
    ends = edges.join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b")
    return same.unionByName(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).filter("a != b")


def still_open(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose texts are in two groups."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


class _Store:
    """docs in the shared folder under fixed column names, with a number and a text digest for each row."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        self.id, self.text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
        whole = F.coalesce(F.col(self.text).cast("string"), F.lit(""))
        self.rows = table(numbered(docs).withColumns({"row": F.monotonically_increasing_id(), "key": F.unhex(F.sha2(whole, 256))}))
        self.texts = self.rows.select(F.col("row").alias("node"), whole.alias("t"))


def _order(id_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))


def _grouped(store: _Store, shingle: int, similarity: float, crowd: int, split: int, radius: int, block_rows: int) -> DataFrame:
    """(key, none, id, node, root) of every distinct text: its least id, a row that has it, and the root of its group."""
    nodes = store.rows.groupBy("key").agg(F.min(F.struct(_order(store.id).alias("o"), F.col("row").alias("node"))).alias("m"))
    nodes = cut(nodes.select("key", "m.o.none", "m.o.id", "m.node"))
    copies = store.rows.select("row").join(nodes.select(F.col("node").alias("__n")), F.col("row") == F.col("__n"), "left_anti")
    texts = _chosen(store.texts, "node", copies, "left_anti")
    counts = counted(texts, shingle)
    rank, wide = ranks(counts), _Wide(counts, split)

    def make():
        def run(data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
            values, first, n, maps, at = prefixes(data, off, shingle, similarity, rank)
            return [list_array(pa.array(values.view(np.int64)), first), pa.array(n), list_array(pa.array(maps.view(np.int64)), at), pa.array(fingerprints(data, off, PRINT_WORDS).view(np.int64))]

        return run

    fields = [T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("n", T.LongType()), T.StructField("map", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())]
    marked = table(map_text(texts, "t", fields, make, ["node"]))
    rows = marked.select("node", "n", F.posexplode("prefix").alias("pos", "h"))
    fit = F.count_if(leading(F.col("n"), F.col("pos"), similarity))
    lead = rows.groupBy("h").agg(F.count("*").alias("total"), fit.alias("fit"), F.min(F.struct("pos", "node", "n")).alias("least")).filter("total > 1 and fit > 0")
    lead = lead.select("h", "total", F.col("least.node").alias("b"), F.col("least.n").alias("m"), F.col("least.pos").alias("q"))
    blocks = table(wide.join(rows, lead))

    def possible(pairs: DataFrame) -> DataFrame:
        maps = lambda c: marked.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("map").alias(f"m{c}"))
        both = pairs.join(maps("b"), "b").join(maps("a"), "a")
        return both.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(_possible(similarity), "a long, b long")

    def checked(pairs: DataFrame) -> DataFrame:
        # only texts with a pair move; the side that many pairs share meets narrow rows
        moved = _chosen(store.texts, "node", pairs.select(F.explode(F.array("a", "b"))).distinct(), "left_semi")
        both = pairs.join(moved.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").join(moved.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
        return cut(both.select("a", "b", "ta", "tb").mapInArrow(_checked(shingle, similarity), "a long, b long"))

    def grown(roots: DataFrame, more: DataFrame) -> DataFrame:
        return roots if more.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    roots = cut(components(checked(cut(possible(alike(marked, radius, block_rows))))))
    first = blocks.filter((F.col("node") != F.col("b")) & could_pass(F.col("n"), F.col("m"), F.col("pos"), F.col("q"), similarity))
    first = possible(still_open(first.select(F.col("node").alias("a"), "b").distinct(), roots)).groupBy("a").agg(F.min("b").alias("b"))
    roots = grown(roots, checked(cut(first)))
    joined = blocks.select("h", "node", "n", "pos", "total").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    few = joined.filter(F.col("total") <= crowd).withColumns({"part": F.lit(0).cast("bigint"), "role": F.lit(0)})
    many = joined.filter(F.col("total") > crowd)
    largest = many.groupBy("h", "root").count().groupBy("h").agg(F.max(F.struct("count", "root")).alias("x"), F.sum("count").alias("all")).filter("x.count < all")
    many = wide.join(many, largest.select("h", F.col("x.root").alias("largest"))).withColumn("parts", F.ceil(F.col("total") / crowd))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")))
    apart = F.col("root") != F.col("largest")
    many = many.withColumn("role", apart.cast("int")).withColumn("part", F.explode(F.when(apart, F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(own)))
    dealt = few.unionByName(many, allowMissingColumns=True).select("h", "part", "node", "n", "pos", "root", "role")
    rest = dealt.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(_pairs(similarity), "a long, b long").distinct()
    roots = grown(roots, checked(cut(possible(rest))))
    return nodes.join(roots, "node", "left").select("key", "none", "id", "node", F.coalesce("root", "node").alias("root"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, crowd: int = 512, split: int = 1 << 18, radius: int = 2, block_rows: int = 4096) -> DataFrame:
    """(id, digest of the text, group) of every row: group is the smallest id of the texts that checked links connect."""
    store = _Store(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col)
    found = cut(_grouped(store, shingle, similarity, crowd, split, radius, block_rows))
    least = found.groupBy("root").agg(F.min(F.struct("none", "id")).alias("m")).select("root", F.col("m.id").alias("group"))
    named = found.join(least, "root").select("key", "group")
    return store.rows.select(F.col(store.id).alias(id_col), "key").join(named, "key").select(F.col(f"`{id_col}`"), F.lower(F.hex("key")).alias("digest"), "group")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, crowd: int = 512, split: int = 1 << 18, radius: int = 2, block_rows: int = 4096) -> DataFrame:
    """docs with one row of each group: one with the smallest id, of those the text with the least digest."""
    store = _Store(docs, id_col, text_col)
    found = _grouped(store, shingle, similarity, crowd, split, radius, block_rows)
    kept = found.groupBy("root").agg(F.min(F.struct("none", "id", "key", "node")).alias("m")).select(F.col("m.node").alias("row"))
    gone = store.rows.select("row").join(kept.toDF("__n"), F.col("row") == F.col("__n"), "left_anti")
    return restored(_chosen(store.rows, "row", gone, "left_anti"), docs)
