"""Redacted PDFs: OCR words from hOCR, fuzzy matching of an entity's words, padded boxes, painted pages, PDF again.

Programs (pdfinfo, pdftoppm, tesseract, pdfunite) run per page inside tasks, in folders of their own; matching and
boxes are Spark expressions between them.  A file of which any page fails gives an error and no PDF at all.
"""

from __future__ import annotations

import html
import re
import shutil
import subprocess
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions.dialect import SPACE
from maskweave.functions.validators import trim
from maskweave.operators.patterns import HOCR_WORD
from maskweave.sources.ingest import OCR_LANGUAGE, name, page_count, tools

# Edits allowed in a word, padding of a box, raster density
TOLERANCE, PADDING, DPI = 1, 2, 200
PAGE_COLUMNS = ["path", "page", "image", "hocr", "wanted", "error"]
PAGE_IMAGES = "path string, page int, image binary, hocr string, wanted array<string>, error string"


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def hocr_words(hocr: Column) -> Column:
    """array<struct<text, x1, y1, x2, y2>>; tags are stripped; entities are decoded by `decoded` afterwards."""
    group = lambda k: F.regexp_extract_all(hocr, F.lit(HOCR_WORD), F.lit(k))
    zipped = F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"), group(4).alias("d"), group(5).alias("e"))
    number = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
    return F.transform(zipped, lambda z: F.struct(F.regexp_replace(z["e"], "<[^>]*>", "").alias("text"), number(z["a"]).alias("x1"), number(z["b"]).alias("y1"), number(z["c"]).alias("x2"), number(z["d"]).alias("y2")))


def words_of(pages, keys: list[str], hocr: str = "hocr"):
    """(keys, word_no, text, x1, y1, x2, y2) of pages' hOCR, entities decoded, empty words dropped."""
    rows = pages.select(*keys, F.posexplode(hocr_words(F.col(hocr))).alias("word_no", "w"))
    rows = rows.select(*keys, "word_no", trim(_unescape.asNondeterministic()(F.col("w.text"))).alias("text"), "w.x1", "w.y1", "w.x2", "w.y2")
    return rows.filter("text != ''")


def plain_word(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]", "")


def boxes(entity: Column, words: Column) -> Column:
    """array<struct<x1, y1, x2, y2>>: each run of OCR words that matches the entity's, word by word within one edit."""
    needle = F.filter(F.transform(F.split(trim(entity), f"[{SPACE}]+"), plain_word), lambda w: w != "")
    n = F.size(needle)
    plain = F.transform(words, lambda w: plain_word(w["text"]))
    alike = lambda a, b: F.levenshtein(a, b) <= TOLERANCE
    last = F.size(words) - n + 1
    starts = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.forall(F.zip_with(F.slice(plain, i, n), needle, alike), lambda x: F.coalesce(x, F.lit(False))))
    side = lambda run, c: F.transform(run, lambda w: w[c])
    box = lambda run: F.struct(F.array_min(side(run, "x1")).alias("x1"), F.array_min(side(run, "y1")).alias("y1"), F.array_max(side(run, "x2")).alias("x2"), F.array_max(side(run, "y2")).alias("y2"))
    none = F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>")
    return F.when((n > 0) & (last >= 1), F.transform(starts, lambda i: box(F.slice(words, i, n)))).otherwise(none)


def padded(box: Column) -> Column:
    """struct<x, y, width, height>: two pixels wider on each side, never below 0 or 1."""
    x, y = F.greatest(box["x1"] - PADDING, F.lit(0)), F.greatest(box["y1"] - PADDING, F.lit(0))
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(box["x2"] + PADDING - x, F.lit(1)).alias("width"), F.greatest(box["y2"] + PADDING - y, F.lit(1)).alias("height"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda words: None if words is None else [html.unescape(w) for w in words])


def _tool(folder: str | None, *names: str) -> dict[str, str]:
    have = tools(folder)
    if missing := [n for n in names if not have[n]]:
        raise RuntimeError(f"not installed: {', '.join(missing)}")
    return have


def raster(pdf: str, page: int, work: str, folder: str | None = None) -> bytes:
    """One page of a PDF file as a portable pixmap, which is painted without an image library."""
    program = _tool(folder, "pdftoppm")["pdftoppm"]
    subprocess.run([program, "-r", str(DPI), "-f", str(page), "-l", str(page), "-singlefile", pdf, f"{work}/page"], check=True, timeout=600, capture_output=True)
    with open(f"{work}/page.ppm", "rb") as f:
        return f.read()


def _tesseract(image: bytes, kind: str, folder: str | None) -> bytes:
    program = _tool(folder, "tesseract")["tesseract"]
    with tempfile.TemporaryDirectory() as work:
        with open(f"{work}/in.ppm", "wb") as f:
            f.write(image)
        target = "-" if kind == "hocr" else f"{work}/out"
        done = subprocess.run([program, f"{work}/in.ppm", target, "-l", OCR_LANGUAGE, kind], check=True, timeout=600, capture_output=True)
        if kind == "hocr":
            return done.stdout
        with open(f"{work}/out.{kind}", "rb") as f:
            return f.read()


def hocr(image: bytes, folder: str | None = None) -> str:
    return _tesseract(image, "hocr", folder).decode("utf-8", "replace")


def image_pdf(image: bytes, folder: str | None = None) -> bytes:
    return _tesseract(image, "pdf", folder)


def paint(image: bytes, places: Iterable[tuple[int, int, int, int]]) -> bytes:
    """A pixmap with black rectangles (x, y, width, height); what lies outside the image is cut off."""
    head = re.match(rb"P6(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+255\s", image)
    if not head:
        raise ValueError("not an 8-bit pixmap")
    pixels = np.frombuffer(image, np.uint8, offset=head.end()).reshape(int(head[2]), int(head[1]), 3).copy()
    for x, y, width, height in places:
        pixels[y : y + height, x : x + width] = 0
    return head[0] + pixels.tobytes()


def concatenate(pdfs: list[bytes], folder: str | None = None) -> bytes:
    if len(pdfs) == 1:
        return pdfs[0]
    program = _tool(folder, "pdfunite")["pdfunite"]
    with tempfile.TemporaryDirectory() as work:
        names = [f"{work}/{k:06d}.pdf" for k in range(len(pdfs))]
        for name, pdf in zip(names, pdfs, strict=True):
            with open(name, "wb") as f:
                f.write(pdf)
        subprocess.run([program, *names, f"{work}/all.pdf"], check=True, timeout=3600, capture_output=True)
        with open(f"{work}/all.pdf", "rb") as f:
            return f.read()


def _problem(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:200]


def page_images(files: DataFrame, requests: DataFrame, folder: str | None = None) -> DataFrame:
    """(path, page, image, hocr, wanted, error) of binaryFile rows; images are deflated, hOCR is made where a page is asked for."""
    asked = requests.select("file", "page", "text").distinct().groupBy("file").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("a"))
    asked = asked.select("file", F.col("a.page").alias("pages"), F.col("a.text").alias("texts"))
    rows = files.select("path", "content", name(F.col("path")).alias("file")).join(asked, "file", "left").select("path", "content", "pages", "texts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw, pages, texts in batch.itertuples(index=False):
                pairs = [] if pages is None else list(zip(pages, texts, strict=True))
                with tempfile.TemporaryDirectory() as work:
                    try:
                        source = f"{work}/in.pdf"
                        with open(source, "wb") as f:
                            f.write(raw)
                        for n in range(1, page_count(source, _tool(folder, "pdfinfo")) + 1):
                            wanted, image = [t for p, t in pairs if p == n], raster(source, n, work, folder)
                            made = (path, n, zlib.compress(image, 1), hocr(image, folder) if wanted else None, wanted, None)
                            yield pd.DataFrame([made], columns=PAGE_COLUMNS)
                    except Exception as e:  # noqa: BLE001  one bad file must not stop the others
                        yield pd.DataFrame([(path, 0, None, None, [], _problem(e))], columns=PAGE_COLUMNS)

    return rows.mapInPandas(run, PAGE_IMAGES)


def redact_pdf(files: DataFrame, requests: DataFrame, folder: str | None = None) -> DataFrame:
    """(path, pages, content, error): each PDF of binaryFile rows with the requested texts (file, page, text) painted over.

    Requests name files by base name, as corpus headers do, so equal base names share their requests.  A file without
    requests is turned to images all the same, so that no hidden text is handed on.  Files without pages give an error.
    """
    words = hocr_words(F.coalesce("hocr", F.lit("")))
    read = page_images(files, requests, folder).withColumn("words", words)
    read = read.withColumn("plain", _unescape_all.asNondeterministic()(F.col("words.text")))
    read = read.withColumn("words", F.filter(F.zip_with("words", "plain", lambda w, t: w.withField("text", trim(t))), lambda w: w["text"] != ""))
    places = F.transform(F.flatten(F.transform("wanted", lambda t: boxes(t, F.col("words")))), padded)
    read = read.withColumn("places", places).select("path", "page", "image", "error", *[F.col(f"places.{c}").alias(c) for c in ("x", "y", "width", "height")])

    def remake(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, page, image, error, *sides in batch.itertuples(index=False):
                pdf = None
                if error is None:
                    try:
                        pdf = image_pdf(paint(zlib.decompress(image), zip(*sides, strict=True)), folder)
                    except Exception as e:  # noqa: BLE001
                        error = _problem(e)
                yield pd.DataFrame([(path, page, pdf, error)], columns=["path", "page", "pdf", "error"])

    def whole(pages: pd.DataFrame) -> pd.DataFrame:
        pages = pages.sort_values("page")
        problems, pdf = [e for e in pages["error"] if e is not None], None
        if not problems:
            try:
                pdf = concatenate(list(pages["pdf"]), folder)
            except Exception as e:  # noqa: BLE001
                problems = [_problem(e)]
        return pd.DataFrame([(pages["path"].iloc[0], len(pages) if pdf else 0, pdf, problems[0] if problems else None)], columns=["path", "pages", "content", "error"])

    made = read.mapInPandas(remake, "path string, page int, pdf binary, error string")
    done = made.groupBy("path").applyInPandas(whole, "path string, pages int, content binary, error string")
    empty = F.when(F.col("d.path").isNull(), F.lit("no pages")).otherwise(F.col("d.error"))
    return files.select("path").alias("f").join(done.alias("d"), F.col("f.path") == F.col("d.path"), "left").select("f.path", F.coalesce("d.pages", F.lit(0)).alias("pages"), "d.content", empty.alias("error"))


def unite(redacted: DataFrame, listed: DataFrame, target: str, folder: str | None = None) -> None:
    """One PDF of all redacted files in list order (path, file_order), written at a local path; refused if any file failed."""
    rows = listed.select("path", "file_order").join(redacted, "path", "left").orderBy("file_order")
    if bad := rows.filter("content is null").select("path", "error").first():
        raise RuntimeError(f"{bad.path}: {bad.error}")
    # a document to be read by people; files come to the driver one at a time and wait on its disk
    with tempfile.TemporaryDirectory() as work:
        names = []
        for k, row in enumerate(rows.select("content").toLocalIterator()):
            names.append(f"{work}/{k:06d}.pdf")
            with open(names[-1], "wb") as f:
                f.write(row.content)
        if not names:
            raise ValueError("no files")
        if len(names) == 1:
            shutil.copyfile(names[0], target)
        else:
            subprocess.run([_tool(folder, "pdfunite")["pdfunite"], *names, target], check=True, timeout=3600, capture_output=True)
