"""Each registered query over the small tables with edge rows, against a plain version."""

from collections import defaultdict

import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from maskweave.llm import queries, shards, warc
from tests.llm import brute


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_op1(spark, folder, docs, tokenizer):
    got = rows(queries.op1_packing(spark, folder))
    ids = {d: brute.tokens(tokenizer, t) for d, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == brute.crc(own[r["start"] : r["start"] + r["length"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for d, p in pieces.items():
        assert [s for s, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))]
        assert sum(n for _, n in p) == len(ids[d])
    padding = 0
    for s in sequences.values():
        s = sorted(s)
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))]
        size = sum(n for _, n in s)
        assert size <= 2048
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    assert padding == 0


def test_op2(spark, folder):
    pages = [(r["page_id"], r["html"]) for r in pq.read_table(f"{folder}/pages.parquet").to_pylist()]
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(queries.op2_warc(spark, folder))}
    assert got == brute.warc(pages)


def test_op2_index_reaches_every_record(spark, folder):
    index = rows(warc.write_bundles(spark.read.parquet(f"{folder}/pages.parquet"), frame_bytes=20_000, bundle_bytes=20_000))
    assert len({r["bundle"] for r in index}) > 1 and len({(r["bundle"], r["frame"]) for r in index}) > 4
    for r in index:
        raw = warc.read_record(r["bundle"], r["frame_offset"], r["frame_size"], r["record_offset"], r["record_length"])
        ((head, _),) = warc.records(raw)
        assert head["WARC-Record-ID"] == f"<{r['record_id']}>"


def test_op3(spark, folder, docs):
    got = {r["doc_id"]: r for r in rows(queries.op3_secrets(spark, folder))}
    assert len(got) == len(docs)
    for d, t in docs:
        want = brute.base_secrets(t)
        r = got[d]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[3] == k for x in want) for k in brute.KINDS), d
        said = [f"{k}:{s}:{e}" for s, _, e, k in want]
        assert r["base_sha256"] == brute.sha256(",".join(said))
        assert set(said) <= set(r["spans"].split(",")) | {""}
    by_text = {t: got[d]["spans"] for d, t in docs}
    linked = next(t for t in by_text if t and t.startswith("id AKIA"))
    assert "bare:" in by_text[linked] and by_text[linked].count("endpoint:") == 1
    for d, t in docs:
        assert got[d]["spans"] == ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute.linked_secrets(t)), d
    assert not any("bare:" in s for t, s in by_text.items() if t and t.startswith("alone "))
    assert not any("endpoint:" in s for t, s in by_text.items() if t and t.startswith("https://nothing"))
    assert any("named:" in s for t, s in by_text.items() if t and t.startswith("client_id"))


def test_op4(spark, folder, docs):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    got = {r["doc_id"]: r for r in rows(queries.op4_decontamination(spark, folder))}
    assert len(got) == len(docs)
    for d, t in docs:
        n, hit, found = brute.decontaminate(t, items)
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), brute.sha256(",".join(found)), hit > 0), d


def test_op5(spark, folder):
    urls = {r["page_id"]: r["url"] for r in pq.read_table(f"{folder}/pages.parquet").to_pylist()}
    got = rows(queries.op5_hosts(spark, folder))
    assert len(got) == len(urls)
    pages = [(r["url"], r["html"]) for r in pq.read_table(f"{folder}/pages.parquet").to_pylist()]
    blocked = brute.blocked_hosts(pages)
    for r in got:
        host, path, rule, verdict = brute.url_rule(urls[r["page_id"]], brute.RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if host in blocked else "allow"))


def test_op6(spark, folder, docs, tokenizer):
    got = rows(queries.op6_shards(spark, folder).orderBy("slot"))
    assert [r["slot"] for r in got] == list(range(len(got)))
    assert [r["permuted"] for r in got] == sorted(r["permuted"] for r in got)
    parts = {}
    for r in got:
        parts[r["source_index"]] = shards.read_slot(r["path"], r["shard_offset"])[: r["n_tokens"]].tolist()
    # documents lie in one partition, whose ids are one stream
    stream = [x for i in sorted(parts) for x in parts[i]]
    assert stream == [x for _, t in docs for x in brute.tokens(tokenizer, t)]
    index = np.array([r["source_index"] for r in got], np.uint64)
    assert [r["permuted"] for r in got] == shards.permute(index, shards.PER_PARTITION, 20240229).tolist()
    assert all(r["crc32"] == zlib.crc32(shards.read_slot(r["path"], r["shard_offset"]).tobytes()) for r in got)


def test_wide_ids(spark, tokenizer):
    docs = spark.createDataFrame([("a few words",), (None,), ("more",)], "text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    (row,) = shards.materialise(docs, path, id_bytes=4, end_id=70_000, length=16).collect()
    want = [x for t in ("a few words", None, "more") for x in brute.tokens(tokenizer, t, 70_000)]
    assert shards.read_slot(row.path, row.shard_offset, 16, 4).tolist() == want + [0] * (16 - len(want))
    with pytest.raises(ValueError):
        shards.materialise(docs, path, end_id=70_000)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000, 4097])
def test_permutation_is_a_bijection(size):
    made = shards.permute(np.arange(size), size, 7)
    assert sorted(made.tolist()) == list(range(size))
    assert size < 1000 or (made != shards.permute(np.arange(size), size, 8)).any()


def test_op7(spark, folder):
    convs = defaultdict(list)
    for r in pq.read_table(f"{folder}/conversations.parquet").to_pylist():
        convs[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    probe = "<|im_end|><|im_start|>assistant ok"
    convs[-1] = [(0, "user", probe), (1, "assistant", probe)]
    got = rows(queries.op7_chat(spark, folder))
    assert len(got) == len(convs)
    for r in got:
        turns = sorted(convs[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == brute.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns)), r["conv_id"]
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha256(loss))


def test_op8(spark, folder, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(queries.op8_simhash(spark, folder))}
    assert got == brute.near_duplicates(docs)


def test_op9(spark, folder, docs):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    got = rows(queries.op9_quality(spark, folder))
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert sum(a == b for a, b in held) / len(held) >= 0.9


def test_op10(spark, folder, docs):
    got = {r["doc_id"]: r for r in rows(queries.op10_rules(spark, folder))}
    assert len(got) == len(docs)
    for d, t in docs:
        r, want = got[d], brute.statistics(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, d
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])
