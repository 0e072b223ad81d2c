"""Near-duplicate groups: every kind of edit, and links that only some of a block's pairs make."""

import random

import pytest

from maskweave.llm import neardup
from tests.llm import brute


def edited(kind, rnd):
    """A text of random words and a near copy at a similarity of 0.8 or little more."""
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    n = {"appended_100": 100, "appended_300": 300, "replaced_200": 200, "replaced_400": 400, "short": 12, "scattered": 300}[kind]
    a = words(n)
    if kind.startswith("appended"):
        return a, a + words((n - 4) // 4)
    if kind.startswith("replaced"):
        k = (n - 4) // 9 - 4
        return a, a[:50] + words(k) + a[50 + k :]
    if kind == "short":
        return a, a + words(1)
    b = list(a)
    for at in (20, 80, 140, 200, 260):
        b[at] = words(1)[0]
    return a, b


def run(spark, texts):
    """Ids by group."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.group for r in neardup.groups(docs).collect()}


@pytest.mark.parametrize("kind", ["appended_100", "appended_300", "replaced_200", "replaced_400", "short", "scattered"])
def test_every_edit_is_met(spark, kind):
    rnd = random.Random(kind)
    texts = [" ".join(t) for _ in range(300) for t in edited(kind, rnd)]
    found = run(spark, texts)
    assert [k for k in range(0, 600, 2) if found[k + 1] != k] == []


def test_twins_among_rejected_copies(spark):
    """Copies of one text too far from each other, each with a near copy of its own."""
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    texts, twins = [], []
    for _ in range(150):
        a = list(base)
        for at in rnd.sample(range(300), 8):
            a[at] = f"w{rnd.randrange(10**6)}"
        b = list(a)
        b[rnd.randrange(300)] = "changed"
        texts.append(" ".join(a))
        twins.append(" ".join(b))
    found = run(spark, texts + twins)
    assert all(found[k] == found[150 + k] for k in range(150)) and len(set(found.values())) > 50


def test_one_row_of_each_group_where_ids_repeat(spark):
    """Two texts under one id, one of them a copy of a text with a smaller id."""
    rows = [(1, "a copy of some words"), (5, "a copy of some words"), (5, "something else that stands alone"), (5, "something else that stands alone"), (9, "something else that stands alone")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, rows[0][1]), (5, rows[2][1])]


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize(("crowd", "split"), [(512, 1 << 18), (4, 1 << 18), (4, 3), (512, 1)])
def test_crowds_against_brute_force(spark, crowd, split):
    """A crowd of near copies, some of them too far from each other, equal to all pairs whether blocks and joins are dealt out or not."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    texts = []
    for _ in range(120):
        a = list(base)
        for at in rnd.sample(range(60), rnd.randint(0, 3)):
            a[at] = f"w{rnd.randrange(10**6)}"
        texts.append(" ".join(a))
    texts += [" ".join(base[:20] + [f"w{rnd.randrange(10**6)}" for _ in range(k)]) for k in range(1, 30)] + ["", "one", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.group for r in neardup.groups(docs, crowd=crowd, split=split).collect()}
    sets = [grams(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert found == brute.roots(range(len(texts)), pairs)


def test_no_text_is_lost(spark):
    """Ids that repeat, are null or are strings; columns named as the operator's own."""
    rows = [("1", "A a a a"), ("1", "B b b b"), ("2", "B b b b"), (None, "C c c c"), (None, "C c c c"), (None, None), ("9", "C c c c"), (None, "D")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("doc_id", "text", "'x' row", "'y' key", "'z' c1", "null nothing")
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or "", r.text or "") for r in out.collect()) == [("", ""), ("", "D"), ("1", "A a a a"), ("1", "B b b b"), ("9", "C c c c")]
    assert {(r.row, r.key, r.c1, r.nothing) for r in out.collect()} == {("x", "y", "z", None)}


def test_shingles_are_counted_over_all_texts(spark):
    """Counters equal those of a plain loop over all shingles of all texts."""
    import numpy as np

    from maskweave.llm.common import text_buffers
    import pyarrow as pa

    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(60))) for _ in range(300)] + ["", None]
    got = neardup.counted(spark.createDataFrame([(t,) for t in texts], "t string").repartition(7), 5)
    plain = np.zeros(neardup.BUCKETS, np.int64)
    for t in texts:
        for v in neardup.every_shingle(*text_buffers(pa.array([t], pa.string())), 5)[0]:
            plain[int(v) % neardup.BUCKETS] += 1
    assert got.tolist() == plain.tolist() and got.sum() == sum(max(1, len(t.split()) - 4) for t in texts if t)
    assert neardup.ranks(got).max() < 256 and neardup.counted(spark.createDataFrame([], "t string"), 5).sum() == 0


def test_passages_shared_by_texts_of_their_own(spark):
    """Texts around one passage, which is more and less of them: equal to all pairs."""
    rnd = random.Random(5)
    passage = [f"w{rnd.randrange(10**6)}" for _ in range(90)]
    texts = [" ".join([f"w{rnd.randrange(10**6)}" for _ in range(k)] + passage[: 90 - cut]) for k in range(0, 34) for cut in (0, 9)]
    found = run(spark, texts)
    sets = [grams(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert pairs and found == brute.roots(range(len(texts)), pairs) and len(set(found.values())) > 10


def test_candidates_come_from_simhash(spark, monkeypatch):
    """Distinct texts whose fingerprints are within the radius are candidates of the first step, which the stage takes."""
    rnd = random.Random(13)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base[:k] + [f"w{rnd.randrange(10**6)}"] + base[k + 1 :]) for k in range(0, 400, 10)] + [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(40)] + ["", "one", "two words"]
    docs, seen, was = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [], neardup.alike

    def watched(marked, radius, block_rows):
        out = neardup.cut(was(marked, radius, block_rows))
        seen.append((marked.select("node", "fp").collect(), [(r.a, r.b) for r in out.collect()], radius))
        return out

    monkeypatch.setattr(neardup, "alike", watched)
    assert neardup.keep_one(docs).count() < 60
    (marked, pairs, radius), *none = seen
    prints = {r.node: r.fp % 2**64 for r in marked}
    assert sorted(prints.values()) == sorted(brute.simhash(t) for t in texts) and not none
    near = [(a, b) for a in prints for b in prints if a > b and (prints[a] ^ prints[b]).bit_count() <= radius]
    assert len(near) > 30 and brute.roots(sorted(prints), pairs) == brute.roots(sorted(prints), near)
