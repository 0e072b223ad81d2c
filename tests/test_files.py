"""Files in and out: redacted PDFs with stand-ins for the programs, exported files, list edits, decoding."""

import io
import json
import os
import stat
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from maskweave.operators import export, redact, review
from maskweave.sources import ingest

# A stand-in "PDF" is pages of words between form feeds; its raster keeps the words in a comment, word k at x = 20 k.
PROGRAMS = {
    "pdfinfo": """
        body = open(sys.argv[1]).read()
        if "broken" in body: sys.exit(1)
        print("Title: x\\nPages:   %d" % (body.count("\\f") + 1 if body != "nothing" else 0))
    """,
    "pdftoppm": """
        a = sys.argv
        page = open(a[-2]).read().split("\\f")[int(a[a.index("-f") + 1]) - 1]
        open(a[-1] + ".ppm", "wb").write(b"P6\\n# " + page.encode() + b"\\n400 20\\n255\\n" + b"\\xff" * (400 * 20 * 3))
    """,
    "tesseract": """
        raw = open(sys.argv[1], "rb").read()
        head, body = raw[: len(raw) - 24000], raw[-24000:]
        words = head.split(b"\\n")[1][2:].decode().split()
        if sys.argv[-1] == "hocr":
            for k, w in enumerate(words):
                w = w.replace("&", "&amp;")
                print(f"<span class='ocrx_word' id='w{k}' title='bbox {20 * k + 4} 5 {20 * k + 14} 15; x_wconf 9'><strong>{w}</strong></span>")
        else:
            dark = lambda x: body[(10 * 400 + x) * 3] == 0
            open(sys.argv[2] + ".pdf", "w").write(" ".join("####" if dark(20 * k + 9) else w for k, w in enumerate(words)))
    """,
    "pdfunite": """
        open(sys.argv[-1], "w").write("\\f".join(open(p).read() for p in sys.argv[1:-1]))
    """,
}


@pytest.fixture(scope="module")
def programs(tmp_path_factory):
    import textwrap

    folder = tmp_path_factory.mktemp("programs")
    for name, body in PROGRAMS.items():
        path = folder / name
        path.write_text(f"#!{sys.executable}\nimport sys\n" + textwrap.dedent(body))
        path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return str(folder)


def test_redacted_pdfs(spark, programs, tmp_path):
    bodies = {"a.pdf": "M. Jean Dup0nt ici\frien de Jean\fR&D chez Dupont", "b.pdf": "Jean Dupont", "bad.pdf": "broken", "none.pdf": "nothing"}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.pdf"))
    asked = [("a.pdf", 1, "Jean Dupont"), ("a.pdf", 1, "Jean Dupont"), ("a.pdf", 3, "R&D"), ("a.pdf", 9, "Jean"), ("c.pdf", 1, "x")]
    requests = spark.createDataFrame(asked, "file string, page int, text string")
    made = redact.redact_pdf(files, requests, programs)
    rows = {os.path.basename(r.path): r for r in made.collect()}
    # one edit is forgiven; a page or file that no request names keeps its words
    assert bytes(rows["a.pdf"].content).decode() == "M. #### #### ici\frien de Jean\f#### chez Dupont" and rows["a.pdf"].pages == 3
    assert bytes(rows["b.pdf"].content) == b"Jean Dupont"
    assert rows["bad.pdf"].content is None and "CalledProcessError" in rows["bad.pdf"].error
    assert rows["none.pdf"].content is None and rows["none.pdf"].error == "no pages"

    order = made.select("path", F.when(F.col("path").endswith("/b.pdf"), 0).otherwise(1).alias("file_order"))
    good = order.filter("path like '%/a.pdf' or path like '%/b.pdf'")
    redact.unite(made, good, str(tmp_path / "all.out"), programs)
    assert (tmp_path / "all.out").read_text().split("\f")[:2] == ["Jean Dupont", "M. #### #### ici"]
    with pytest.raises(RuntimeError):
        redact.unite(made, order, str(tmp_path / "no.out"), programs)


def test_missing_programs_are_errors(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("x")
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.pdf"))
    row = redact.redact_pdf(files, spark.createDataFrame([], "file string, page int, text string"), str(tmp_path)).first()
    assert row.content is None and "not installed" in row.error


def test_paint_stays_inside_the_image():
    image = b"P6 3 2 255\n" + bytes([9] * 18)
    assert redact.paint(image, [(1, 1, 50, 50)]) == b"P6 3 2 255\n" + bytes([9] * 12 + [0] * 6)
    assert redact.paint(image, []) == image
    with pytest.raises(ValueError):
        redact.paint(b"\x89PNG", [])


@pytest.fixture
def texts(spark):
    rows = [("un", "à Jean", "à PERSONNE_001", json.dumps({"PERSONNE_001": "Jean é" * 40})), ("deux", None, None, None)]
    return spark.createDataFrame(rows, "k string, text string, text_anon string, mapping string")


def test_export_files(spark, texts, tmp_path):
    made = {r.file: r.bytes for r in export.write_files(texts, str(tmp_path), "k").collect()}
    assert set(made) == set(os.listdir(tmp_path)) == {f"{k}.{e}" for k in ("un", "deux") for e in ("txt", "mapping.json", "original.txt")}
    assert (tmp_path / "un.txt").read_text() == "à PERSONNE_001" and (tmp_path / "un.original.txt").read_text() == "à Jean"
    document = json.loads((tmp_path / "un.mapping.json").read_text())
    assert document["app"] == "maskweave" and document["entries"] == {"PERSONNE_001": "Jean é" * 40} and document["generated_at"].endswith("Z")
    assert (tmp_path / "deux.txt").read_text() == "" and json.loads((tmp_path / "deux.mapping.json").read_text())["entries"] == {}


def test_export_of_encrypted_mappings(spark, texts, tmp_path):
    export.write_files(texts, str(tmp_path), "k", "long passphrase").collect()
    payloads = [json.loads((tmp_path / f"{k}.mapping.enc.json").read_text()) for k in ("un", "deux")]
    assert payloads[0]["salt"] != payloads[1]["salt"] and payloads[0]["iv"] != payloads[1]["iv"]
    assert json.loads(export.decrypt_mapping(spark, payloads[0], "long passphrase"))["entries"] == {"PERSONNE_001": "Jean é" * 40}
    assert not [f for f in os.listdir(tmp_path) if f.endswith("mapping.json")]


def test_export_refuses(spark, texts, tmp_path):
    with pytest.raises(ValueError):
        export.write_files(texts, str(tmp_path), "k", "short")
    for names in (["a", "a"], ["a/b"], [None], [".."]):
        rows = spark.createDataFrame([(n, "", "", "{}") for n in names], "k string, text string, text_anon string, mapping string")
        with pytest.raises(ValueError):
            export.write_files(rows, str(tmp_path), "k")
    assert not os.listdir(tmp_path)


def test_file_list_edits(spark):
    listed = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "path string, file_order int")
    left = ingest.remove_file(listed, F.lit("a"))
    assert sorted(map(tuple, left.collect())) == [("b", 0), ("c", 1)] and left.dtypes == listed.dtypes
    assert ingest.remove_file(listed, F.lit("x")).count() == 3
    assert ingest.clear_files(listed).count() == 0


def test_dismissed_replacement(spark):
    df = spark.createDataFrame([(1, "x")], "k long, pending_replace string")
    assert review.dismiss_replace(df).first() == (1, None)


def test_files_to_pages(spark, tmp_path):
    """UTF-8 with and without a mark, UTF-16, two single-byte sets, RTF, DOCX, and a kind that is not read."""
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body><w:p><w:r><w:t>Né à</w:t><w:tab/><w:t>Nice</w:t></w:r></w:p><w:p><w:r><w:t>fin</w:t></w:r></w:p></w:body></w:document>")
    raw = {
        "a.txt": "é".encode(), "b.txt": b"\xef\xbb\xbf" + "é".encode(), "c.md": "é".encode("utf-16"), "d.csv": "é".encode("latin-1"), "e.TXT": "l’é".encode("cp1252"),
        "f.rtf": rb"{\rtf1{\fonttbl x}N\'e9 \u224? Nice\par fin}", "g.docx": docx.getvalue(), "h.html": b"x", "i.docx": b"no zip",
    }
    for name, body in raw.items():
        (tmp_path / name).write_bytes(body)
    rows = {r.file: r for r in ingest.read_files(spark, str(tmp_path)).collect()}
    got = {f: r.text for f, r in rows.items() if r.error is None}
    assert got == {"a.txt": "é", "b.txt": "é", "c.md": "é", "d.csv": "é", "e.TXT": "l’é", "f.rtf": "Né à Nice\nfin", "g.docx": "Né à\tNice\nfin"}
    assert rows["h.html"].error == "unsupported format" and "BadZipFile" in rows["i.docx"].error


def test_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "k long, t string")
    export.save_snapshot(rows, str(tmp_path / "s"))
    assert export.load_snapshot(spark, str(tmp_path / "s")).collect() == rows.collect()
    rows.withColumn("schema_version", F.lit(1)).write.parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError):
        export.load_snapshot(spark, str(tmp_path / "old"))
