"""Review edits, sources and sinks on literal rows."""

import pytest
from pyspark.sql import functions as F

from maskweave.operators import export, redact, review
from maskweave.operators.pseudonym import ENTITY
from maskweave.sources import ingest


def frame(spark, text, entities):
    rows = [(s, s + len(t), t, c, p, on) for s, t, c, p, on in entities]
    return spark.createDataFrame([(text, rows)], f"text string, entities array<{ENTITY}>")


def shown(row):
    return [(e.start, e.text, e.category, e.pseudonym, e.enabled) for e in row.entities]


@pytest.mark.parametrize("needle, case, want", [("aa", False, [0, 1, 4]), ("AA", True, []), ("x\\E", False, []), ("b", False, [3]), ("", False, [])])
def test_occurrences(spark, needle, case, want):
    row = spark.createDataFrame([("aaabaa", needle)], "t string, n string").select(review.occurrences(F.col("t"), F.col("n"), case)).first()
    assert row[0] == want


def test_add(spark):
    df = frame(spark, "le Paris, PARIS et Paris-Nord", [(19, "Paris-Nord", "LIEU", "LIEU_001", True)])
    row = review.add_entity(df, F.lit(0), F.lit(8), F.lit("LIEU")).first()
    assert shown(row) == [(3, "Paris", "LIEU", "LIEU_002", True), (10, "PARIS", "LIEU", "LIEU_002", True), (19, "Paris-Nord", "LIEU", "LIEU_001", True)]
    assert (row.needle, row.skipped) == ("Paris", 1)
    assert shown(review.add_entity(df, F.lit(0), F.lit(2), F.lit("LIEU")).first()) == [(19, "Paris-Nord", "LIEU", "LIEU_001", True)]


def test_replace(spark):
    df = frame(spark, "Paris-Nord paris Paris", [(0, "Paris-Nord", "LIEU", "LIEU_001", True)])
    row = review.apply_replace(df, F.lit("Paris"), F.lit("LIEU"), F.lit("LIEU_002")).first()
    assert shown(row) == [(0, "Paris", "LIEU", "LIEU_002", True), (17, "Paris", "LIEU", "LIEU_002", True)]


def test_toggles(spark):
    df = frame(spark, "abcdef", [(0, "a", "LIEU", "LIEU_001", True), (2, "c", "LIEU", "LIEU_002", False), (4, "e", "TEL", "TEL_001", True)])
    on = df.withColumn("entities", review.toggle_category(F.col("entities"), F.lit("LIEU")))
    assert [e.enabled for e in on.first().entities] == [True, True, True]
    assert [e.enabled for e in on.withColumn("entities", review.toggle_category(F.col("entities"), F.lit("LIEU"))).first().entities] == [False, False, True]
    assert [e.enabled for e in df.withColumn("entities", review.toggle_entity(F.col("entities"), F.lit(1))).first().entities] == [True, True, True]
    assert len(df.withColumn("entities", review.remove_entity(F.col("entities"), F.lit(1))).first().entities) == 2


@pytest.mark.parametrize("gap, joins", [(" - ", True), (" " * 21, False), (" abc ", False), (" ab ", True)])
def test_merge(spark, gap, joins):
    text = "Jean" + gap + "ROY"
    df = frame(spark, text, [(0, "Jean", "PERSONNE", "PERSONNE_001", True), (4 + len(gap), "ROY", "PERSONNE", "PERSONNE_002", True)])
    row = review.merge(df, F.array(F.lit(0), F.lit(1)), F.lit("PERSONNE")).first()
    assert shown(row) == ([(0, text, "PERSONNE", "PERSONNE_003", True)] if joins else shown(df.first()))


def test_segments(spark):
    df = frame(spark, "ab😀cd", [(1, "b", "LIEU", "LIEU_001", True), (3, "c", "TEL", "TEL_001", False)])
    parts = df.select(review.segments(F.col("text"), F.col("entities"))).first()[0]
    assert [(p.start, p.text, p.category) for p in parts] == [(0, "a", None), (1, "b", "LIEU"), (2, "😀cd", None)]


@pytest.mark.parametrize("text, pages", [("a" * 3000, 1), ("a" * 3001, 2), ("a\n" * 5000, 4), ("é" * 1501, 2), ("", 1)])
def test_pages(text, pages):
    made = ingest.split_pages(text)
    assert len(made) == pages and "".join(made) == text and all(len(p.encode()) <= 3000 for p in made)


@pytest.mark.parametrize("raw, want", [(b"\xef\xbb\xbfa", "a"), ("é".encode("utf-16"), "é"), ("é".encode(), "é"), ("é".encode("latin-1"), "é"), (b"\x80", "€")])
def test_charsets(raw, want):
    assert ingest.decode(raw) == want


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("Bonjour M. Dupont")
    (tmp_path / "b.xyz").write_text("no")
    (tmp_path / "c.rtf").write_text(r"{\rtf1{\fonttbl x;}caf\'e9\par fin}")
    rows = {r.file: r for r in ingest.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.TXT"].text == "Bonjour M. Dupont" and rows["a.TXT"].page == 1
    assert rows["b.xyz"].error == "unsupported format" and rows["c.rtf"].text == "café\nfin"


def test_ocr_rule(spark):
    assert spark.createDataFrame([("  x  ",)], "t string").select(ingest.needs_ocr(F.col("t"))).first()[0]


def test_requests(spark):
    text = "\n\n=== f.pdf — page 1 ===\n\nJean ROY\n\n=== f.pdf — page 2 (OCR) ===\n\nAnne"
    df = frame(spark, text, [(text.index("Jean"), "Jean ROY", "PERSONNE", "PERSONNE_001", True), (text.index("Anne"), "Anne", "PERSONNE", "PERSONNE_002", True)]).withColumn("k", F.lit(1))
    assert sorted(map(tuple, export.redaction_requests(df, ["k"]).collect())) == [(1, "f.pdf", 1, "Jean ROY"), (1, "f.pdf", 2, "Anne")]
    pages = df.select("k", F.inline(export.page_spans(F.col("text"))))
    rows = df.select("k", F.inline("entities"))
    assert sorted(map(tuple, export.requests_by_rows(rows, pages, ["k"]).collect())) == [(1, "f.pdf", 1, "Jean ROY"), (1, "f.pdf", 2, "Anne")]


def test_vault(spark):
    payload = export.encrypt_mapping(spark, '{"TEL_001": "06"}', "long enough")
    assert export.decrypt_mapping(spark, payload, "long enough") == '{"TEL_001": "06"}'
    with pytest.raises(ValueError):
        export.encrypt_mapping(spark, "{}", "short")
    with pytest.raises(ValueError):
        export.decrypt_mapping(spark, payload | {"v": 2}, "long enough")


def test_snapshot(spark, tmp_path):
    export.save_snapshot(spark.range(3), str(tmp_path / "s"))
    assert export.load_snapshot(spark, str(tmp_path / "s")).count() == 3
    spark.range(1).withColumn("schema_version", F.lit(1)).write.parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError):
        export.load_snapshot(spark, str(tmp_path / "old"))


def test_boxes(spark):
    words = [("M.", 1, 5, 9, 15), ("JEAN,", 12, 5, 20, 15), ("Dup0nt", 24, 4, 33, 16)]
    df = spark.createDataFrame([("Jean Dupont", words), ("absent", words)], "e string, w array<struct<text:string,x1:int,y1:int,x2:int,y2:int>>")
    made = [r[0] for r in df.select(F.transform(redact.boxes(F.col("e"), F.col("w")), redact.padded)).collect()]
    assert [tuple(b) for b in made[0]] == [(10, 2, 25, 16)] and made[1] == []


def test_hocr(spark):
    hocr = "<span class='ocrx_word' id='w' title='bbox 1 2 3 4; x'><b>A&amp;B</b></span><span class='other'>no</span>"
    rows = redact.words_of(spark.createDataFrame([(1, hocr)], "k int, hocr string"), ["k"]).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "A&B", 1, 2, 3, 4)]
