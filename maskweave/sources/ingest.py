"""Files to pages to corpora: extension routing, charset decoding, virtual pages, OCR rule, corpus text, file list.

Bytes come through `binaryFile`, so any store that Spark reads will do.  External tools (PDF text, OCR, office
files) run only where they are installed; rows that need a missing tool are kept with an error, never lost.
"""

from __future__ import annotations

import io
import os
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions.dialect import SPACE

# Extensions by kind, the OCR threshold, the virtual page size, the external tools
KINDS = {"pdf": ["pdf"], "docx": ["docx"], "rtf": ["rtf"], "text": ["txt", "text", "md", "csv"]}
OCR_BELOW_BYTES = 20
PAGE_BYTES = 3000
TOOLS = ("pdftotext", "pdfinfo", "pdftoppm", "tesseract", "textutil", "pdfunite")
OCR_DPI, OCR_LANGUAGE = 300, "fra"
PAGES = "file string, page int, text string, used_ocr boolean, error string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind(path: Column) -> Column:
    """pdf, docx, rtf, text, or unsupported."""
    out = F.lit("unsupported")
    for name, exts in KINDS.items():
        out = F.when(extension(path).isin(*exts), F.lit(name)).otherwise(out)
    return out


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def needs_ocr(text: Column) -> Column:
    """Native text of fewer bytes than the threshold once trimmed."""
    return F.octet_length(F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+\\z", "")) < OCR_BELOW_BYTES


def decode(raw: bytes) -> str:
    """UTF-8 mark, UTF-16 marks, strict UTF-8, then the likeliest single-byte charset."""
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    # 0x80-0x9F are controls in Latin-1 and punctuation in Windows-1252
    return raw.decode("cp1252", "replace") if any(0x80 <= b <= 0x9F for b in raw) else raw.decode("latin-1")


def split_pages(text: str, size: int = PAGE_BYTES) -> list[str]:
    """Virtual pages of at most size bytes, cut after the last newline inside, else before a character that would not fit."""
    raw, out, at = text.encode(), [], 0
    if len(raw) <= size:
        return [text]
    while at < len(raw):
        stop = min(at + size, len(raw))
        if stop < len(raw):
            newline = raw.rfind(b"\n", at, stop)
            if newline >= at:
                stop = newline + 1
            else:
                while stop > at + 1 and raw[stop] & 0xC0 == 0x80:
                    stop -= 1
        out.append(raw[at:stop].decode())
        at = stop
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else split_pages(t))


def virtual_pages(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, page from 1, text); pages of a text join to the text."""
    made = df.select(*keys, _split.asNondeterministic()(F.col(text)).alias("pages"))
    return made.select(*keys, F.posexplode("pages").alias("page", "text")).withColumn("page", F.col("page") + 1)


def tools(folder: str | None = None) -> dict[str, str | None]:
    """External programs by name: the given folder or that named in MASKWEAVE_TOOLS first, then the path."""
    own = folder or os.environ.get("MASKWEAVE_TOOLS")
    return {t: (own and shutil.which(t, path=own)) or shutil.which(t) for t in TOOLS}


def _run(*args: str) -> str:
    return subprocess.run(args, capture_output=True, check=True, timeout=600).stdout.decode("utf-8", "replace")


def page_count(path: str, have: dict[str, str | None]) -> int:
    return int(re.search(r"^Pages:\s+(\d+)", _run(have["pdfinfo"], path), re.M)[1])


def _pdf(path: str) -> Iterator[tuple[int, str, bool]]:
    have = tools()
    if not have["pdftotext"] or not have["pdfinfo"]:
        raise RuntimeError("pdftotext and pdfinfo are not installed")
    for n in range(1, page_count(path, have) + 1):
        try:
            text = _run(have["pdftotext"], "-layout", "-f", str(n), "-l", str(n), path, "-")
        except subprocess.SubprocessError:
            text = ""
        used = False
        if len(text.strip().encode()) < OCR_BELOW_BYTES:
            if not have["pdftoppm"] or not have["tesseract"]:
                raise RuntimeError(f"page {n} needs OCR; pdftoppm and tesseract are not installed")
            with tempfile.TemporaryDirectory() as work:
                try:
                    _run(have["pdftoppm"], "-r", str(OCR_DPI), "-f", str(n), "-l", str(n), "-png", "-singlefile", path, f"{work}/p")
                    text, used = _run(have["tesseract"], f"{work}/p.png", "-", "-l", OCR_LANGUAGE), True
                except subprocess.SubprocessError:
                    pass  # the native text stays
        yield n, text, used


def _docx(raw: bytes) -> str:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    marks = {f"{w}tab": "\t", f"{w}br": "\n"}
    return "\n".join("".join(marks.get(x.tag, x.text or "" if x.tag == f"{w}t" else "") for x in p.iter()) for p in body.iter(f"{w}p"))


def _rtf(raw: bytes) -> str:
    out, skip, depth = [], None, 0
    for m in re.finditer(r"\\'([0-9a-f]{2})|\\u(-?\d+)\s?\??|\\([a-z]+)(-?\d+)? ?|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", raw.decode("latin-1"), re.I):
        code, uni, word, _, symbol, brace, plain = m.groups()
        if brace:
            depth += 1 if brace == "{" else -1
            skip = None if skip is not None and depth < skip else skip
        elif symbol == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict"):
            skip = depth if skip is None else skip
        elif skip is None:
            out.append(bytes([int(code, 16)]).decode("cp1252", "replace") if code else chr(int(uni) % 65536) if uni else {"par": "\n", "line": "\n", "tab": "\t"}.get(word, "") if word else plain or symbol or "")
    return "".join(out)


def _pages_of(path: str, raw: bytes) -> Iterator[tuple[int, str, bool]]:
    ext = path.rpartition(".")[2].lower()
    if ext in KINDS["pdf"]:
        with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
            f.write(raw)
            f.flush()
            yield from _pdf(f.name)
        return
    text = _docx(raw) if ext in KINDS["docx"] else _rtf(raw) if ext in KINDS["rtf"] else decode(raw)
    for n, page in enumerate(split_pages(text), 1):
        yield n, page, False


def extract(files: DataFrame) -> DataFrame:
    """Pages of binaryFile rows (path, content); a file that fails gives one row with its error instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                base, rows = re.split(r"[/\\]", path)[-1], []
                try:
                    rows = [(base, n, t, used, None) for n, t, used in _pages_of(path, raw)]
                except Exception as problem:  # noqa: BLE001  one bad file must not stop the others
                    rows = [(base, None, None, None, f"{type(problem).__name__}: {problem}"[:200])]
                yield pd.DataFrame(rows, columns=["file", "page", "text", "used_ocr", "error"]).astype({"page": "Int32", "used_ocr": "boolean"})

    supported = files.filter(kind(F.col("path")) != "unsupported").select("path", "content")
    refused = files.filter(kind(F.col("path")) == "unsupported")
    lost = refused.select(name(F.col("path")).alias("file"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("used_ocr"), F.lit("unsupported format").alias("error"))
    return supported.mapInPandas(run, PAGES).unionByName(lost)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all files below a path; Spark's reader passes over files of no bytes."""
    return extract(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def header(file: Column, page: Column, used_ocr: Column) -> Column:
    return F.concat(F.lit("\n\n=== "), file, F.lit(" — page "), page.cast("string"), F.when(used_ocr, F.lit(" (OCR)")).otherwise(F.lit("")), F.lit(" ===\n\n"))


def corpus(pages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, text): pages in order, each behind its header.  One row per corpus: for corpora that fit in a row."""
    whole = F.concat(header(F.col("file"), F.col("page"), F.col("used_ocr")), F.coalesce("text", F.lit("")))
    rows = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, whole.alias("__whole")))).alias("p"))
    return rows.select(*keys, F.array_join(F.transform("p", lambda x: x["__whole"]), "").alias("text"))


def with_offsets(pages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Pages as rows with the offset of their text in the corpus text: for corpora that do not fit in a row."""
    head = F.length(header(F.col("file"), F.col("page"), F.col("used_ocr")))
    size = head + F.length(F.coalesce("text", F.lit("")))
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("offset", before + head)


def add_files(listed: DataFrame, new: DataFrame) -> DataFrame:
    """A file list (path, file_order) with new paths behind it; a path is listed once, at its first place."""
    rows = listed.select("path", F.lit(0).alias("__late"), "file_order").unionByName(new.select("path", F.lit(1).alias("__late"), "file_order"))
    first = rows.groupBy("path").agg(F.min(F.struct("__late", "file_order")).alias("k"))
    return first.select("path", name(F.col("path")).alias("name"), (F.row_number().over(Window.orderBy("k")) - 1).alias("file_order"))


def move_file(listed: DataFrame, source: int, target: int) -> DataFrame:
    """The file at one place moved to another; those between shift by one."""
    at = F.col("file_order")
    low, high, step = (source + 1, target, -1) if source < target else (target, source - 1, 1)
    return listed.withColumn("file_order", F.when(at == source, target).when(at.between(low, high), at + step).otherwise(at))


def remove_file(listed: DataFrame, path: Column) -> DataFrame:
    """The list without a path; later files move up.  Text that was read from it stays until it is read anew."""
    left = listed.filter(~F.col("path").eqNullSafe(path))
    return left.withColumn("file_order", (F.row_number().over(Window.orderBy("file_order")) - 1).cast(listed.schema["file_order"].dataType))


def clear_files(listed: DataFrame) -> DataFrame:
    return listed.limit(0)
