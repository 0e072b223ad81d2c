"""The pipeline's stages against plain versions, each on its own input."""

import re

import corpus_pipeline
import pytest

from tests.llm import brute


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stages")
    docs, made = spark.read.parquet(f"{folder}/documents.parquet"), []
    made.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        made.append(docs)
    return made


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality(steps):
    before, after = texts(steps[0]), texts(steps[1])
    for d, t in before.items():
        n, _, _, _, again = brute.statistics(t)
        if n < 10 or 100 * again > 20 * n:
            assert d not in after
    assert len(after) > 0.7 * len([t for t in before.values() if t and len(t.split()) >= 10])


def near_copies(before):
    """Ids, and the ids that stay when one of each group at a similarity of 0.8 over five words does."""

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(brute.LOWER))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, ids = {d: grams(t) for d, t in before.items()}, sorted(before)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    up = brute.roots(ids, pairs)
    return ids, {d for d in ids if up[d] == d}


def test_near_duplicates_keep_the_rest(steps):
    before, after = texts(steps[1]), texts(steps[2])
    assert near_copies(before)[1] <= set(after)  # nothing goes that has no near copy


def test_near_duplicates_are_found(steps):
    before, after = texts(steps[1]), texts(steps[2])
    ids, want = near_copies(before)
    assert len(set(after) - want) <= 0.1 * (len(ids) - len(want))


def test_decontamination(spark, steps, folder):
    before, after = texts(steps[2]), texts(steps[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert set(after) == {d for d, t in before.items() if not brute.decontaminate(t, items)[1]}


def test_secrets(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert set(before) == set(after)
    for d, t in before.items():
        want = brute.base_secrets(t)
        assert (after[d] == t) or "[SECRET]" in after[d]
        for s, _, e, _ in want:
            assert t[s:e] not in after[d] or e - s < 8
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())


def test_packing(steps):
    pieces = steps[5].collect()
    assert {r.doc_id for r in pieces} == set(texts(steps[4]))
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
