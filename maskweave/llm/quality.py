"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features of a text are its lower-cased words, pairs of neighbouring words, word shapes (which kinds of
characters a word has, and whether it repeats the word before) and pairs of shapes, each hashed to one of
2^`bits` places and weighing 1 / sqrt(words).  Training takes at most about `max_train` labelled ids, chosen
by hash; `shards` learners see them in hash order, `epochs` times, and their weights are averaged over `rounds`
rounds.  A score is the logistic of a sparse dot product over the whole text.

Cases: null or empty text scores by the bias alone; unlabelled rows and null labels are not learnt from;
several labels of one id count once, the largest; ids may be of any type, and all rows that repeat a labelled id
are learnt from; with no labels every score is 0.5; an empty table gives no
rows; clashing columns are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.llm.common import LOWER, NON_SPACE, cut, list_array, map_text, mix64, ranges, runs

ODD = 0x9E3779B97F4A7C15 | 1

#: Kinds of bytes, as bits of a word's shape: lower case, upper case, digit, other printable ASCII, `!`, `#*$%&|<>`, above ASCII.
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x80] = 8
KINDS[0x61:0x7B] = 1
KINDS[0x41:0x5B] = 2
KINDS[0x30:0x3A] = 4
KINDS[ord("!")] = 16
KINDS[[ord(c) for c in "#*$%&|<>"]] = 32
KINDS[0x80:] = 64


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    up = np.full(n, np.uint64(ODD))
    up[0] = 1
    return np.multiply.accumulate(up)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte ranges, which follow each other; the table of powers is as long as the longest range."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    up = _powers(1 << max(10, int(length.max()).bit_length()))
    at = ranges(starts, length)
    place = at - np.repeat(starts, length)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * up[place]
    return mix64(np.add.reduceat(terms, np.concatenate([[0], np.cumsum(length)[:-1]])))


def features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of 4 features a word, first feature of each row and the total, weight per row)."""
    _, starts, ends, first = runs(data, off, NON_SPACE)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64), np.zeros(len(off) - 1)
    word = word_hashes(LOWER[data], starts, ends)
    kind = KINDS[data]
    edges = np.stack([starts, np.minimum(ends, len(data) - 1)], 1).reshape(-1)
    shape = np.bitwise_or.reduceat(kind, edges)[::2].astype(np.uint64)
    lead = np.zeros(n, bool)
    lead[first[:-1][np.diff(first) > 0]] = True
    same = np.concatenate([[False], word[1:] == word[:-1]]) & ~lead
    shape |= same.astype(np.uint64) << np.uint64(7)
    before = np.where(lead, np.uint64(0), np.roll(word, 1))
    shaped = np.where(lead, np.uint64(256), np.roll(shape, 1))
    all4 = np.stack([word, mix64(before + np.uint64(3) * word), mix64(shape + np.uint64(1 << 20)), mix64(shape * np.uint64(512) + shaped + np.uint64(1 << 40))], 1)
    places = (all4.reshape(-1) >> np.uint64(64 - bits)).astype(np.int32)
    words = np.diff(first)
    return places, first * 4, np.where(words > 0, 1 / np.sqrt(np.maximum(words, 1)), 0)


class Ftrl:
    """Per-coordinate FTRL-proximal on logistic loss; place 2^bits is the bias."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def start(self, w: np.ndarray, n: np.ndarray) -> None:
        """Go on from given weights and squared-gradient sums."""
        self.n = n.copy()
        self.z = -w * ((self.beta + np.sqrt(n)) / self.alpha + self.l2) - np.sign(w) * self.l1

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, trained: Column | None, bits: int, max_train: int, shards: int, rounds: int, epochs: int
) -> np.ndarray:
    """Weights, the bias last."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    marks = marks if trained is None else marks.filter(trained)
    marks = marks.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    total = marks.count()
    weights = np.zeros((1 << bits) + 1)
    if not total:
        return weights
    share = min(1.0, max_train / total)
    marks = marks.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    # about max_train rows of two numbers
    chosen = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__t")).join(F.broadcast(marks), "__id")

    def make():
        def fn(data, off):
            places, first, weight = features(data, off, bits)
            return [list_array(pa.array(places), first), pa.array(weight)]

        return fn

    fields = [T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("weight", T.DoubleType())]
    chosen = chosen.select("__label", "__t", F.xxhash64("__id", "__t", F.lit(2)).alias("order"), F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(shards)).alias("shard"))
    rows = cut(map_text(chosen, "__t", fields, make, ["__label", "order", "shard"]))
    sums = np.zeros((1 << bits) + 1)
    for _ in range(rounds):
        given = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), sums.astype(np.float32)))

        def learn(part: pd.DataFrame) -> pd.DataFrame:
            model = Ftrl(bits)
            model.start(given.value[0].astype(float), given.value[1].astype(float))
            part = part.sort_values(["order", "__label"])
            examples = []
            for places, weight, label in zip(part["places"], part["weight"], part["__label"], strict=True):
                at, count = np.unique(np.append(places, 1 << bits), return_counts=True)
                value = count * weight
                value[-1] = 1.0
                examples.append((at, value, float(label)))
            for _ in range(epochs):
                for example in examples:
                    model.learn(*example)
            w, n = model.weights().astype("<f4"), model.n.astype("<f4")
            at = np.flatnonzero(w).astype("<i4")
            return pd.DataFrame({"at": [at.tobytes()], "w": [w[at].tobytes()], "n": [n.tobytes()], "rows": [len(part)]})

        # `shards` rows of at most 12 * 2^bits bytes
        got = rows.groupBy("shard").applyInPandas(learn, "at binary, w binary, n binary, rows long").collect()
        given.unpersist()
        seen = sum(r.rows for r in got)
        weights, sums = np.zeros_like(weights), np.zeros_like(sums)
        for r in got:
            weights[np.frombuffer(r.at, "<i4")] += np.frombuffer(r.w, "<f4") * (r.rows / seen)
            sums += np.frombuffer(r.n, "<f4") * (r.rows / seen)
    return weights


def score(docs: DataFrame, weights: np.ndarray, bits: int, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append `score`."""
    given = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def make():
        w = given.value

        def fn(data, off):
            places, first, weight = features(data, off, bits)
            total = np.concatenate([[0.0], np.cumsum(w[places], dtype=np.float64)])
            return [pa.array(1 / (1 + np.exp(-((total[first[1:]] - total[first[:-1]]) * weight + float(w[-1])))))]

        return fn

    return map_text(docs, text_col, [T.StructField("score", T.DoubleType())], make, keep)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    trained: Column | None = None,
    threshold: float = 0.3,
    bits: int = 18,
    max_train: int = 16_000,
    shards: int = 8,
    rounds: int = 2,
    epochs: int = 4,
) -> DataFrame:
    """(id, score, predicted) of every document."""
    weights = train(docs, labels, id_col, text_col, label_col, trained, bits, max_train, shards, rounds, epochs)
    return score(docs, weights, bits, text_col, [id_col]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
