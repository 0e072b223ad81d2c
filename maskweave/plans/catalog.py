"""The queries of the engine's own operators and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.functions import validators
from maskweave.operators import analyse, export, pseudonym, redact, refine, resolve, review, spans
from maskweave.operators.patterns import BY_NAME, CATEGORIES, PATTERNS
from maskweave.plans import oracle
from maskweave.plans.dossier import dossier
from maskweave.sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
ROW = ["doc_id", "start", "end", "text", "category"]
#: The patterns of the flagship query.
QUICK = ("email", "phone", "date_digits")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _rows(df: DataFrame, column: str = "spans") -> DataFrame:
    return spans.rows(df, ["doc_id"], column).select(*ROW)


def _once(df: DataFrame) -> DataFrame:
    """df by way of a folder that executors share, so that what reads it twice does not make it twice; it goes when the driver ends."""
    spark = df.sparkSession
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir is not set: executors of a cluster need a folder that all of them reach")
    at = f"{(folder or tempfile.mkdtemp(prefix='rows-')).rstrip('/')}/rows-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(f"{at}/rows")
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with e-mails, phones and dates replaced."""
    made = analyse.pseudonymise(_documents(spark, sf_dir), only=QUICK)
    return made.select("doc_id", "text_anon", F.size("entities").cast("bigint").alias("n_entities"))


def analysis_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis, with all patterns, of whole documents."""
    made = analyse.pseudonymise(_documents(spark, sf_dir))
    return made.select("doc_id", "text_anon", "mapping", F.size("entities").cast("bigint").alias("n_entities"))


def _scan(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(analyse.with_spans(dossier(spark, sf_dir), only=(name,)))


def _scan_table(name: str, table: str, key: str, text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return _rows(analyse.with_spans(source, only=(name,)))


def _steps(spark: SparkSession, sf_dir: str, upto: int) -> DataFrame:
    """Case files after the first `upto` refinement steps."""
    out = analyse.with_spans(dossier(spark, sf_dir))
    for name, step in refine.refine(F.col("text"), F.col("spans"))[:upto]:
        out = out.withColumn(name, step)
    return out


def _stage(upto: int, column: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_steps(spark, sf_dir, upto), column)


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_steps(spark, sf_dir, 9).withColumn("kept", resolve.resolve(F.col("spans"))), "kept")


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse.analyse(dossier(spark, sf_dir))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.rows(_analysed(spark, sf_dir), ["doc_id"], "entities")


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym.mapping_rows(_analysed(spark, sf_dir), ["doc_id"]).select("doc_id", "category", "norm_text", "original", "pseudonym")


def _mapping_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbering where a corpus's spans are rows."""
    return pseudonym.number_corpus(_resolved(spark, sf_dir), ["doc_id"]).select("doc_id", "category", "norm_text", "original", "pseudonym")


def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering of all resolved spans after that of the e-mails, phones and companies of even documents is known."""
    rows = _once(_resolved(spark, sf_dir).select("doc_id", "start", "text", "category"))
    first = pseudonym.number_corpus(rows.filter("doc_id % 2 = 0 and category in ('EMAIL', 'PERSONNE_MORALE') and start > 400"), ["doc_id"])
    return pseudonym.number_corpus(rows, ["doc_id"], first).select("doc_id", "category", "norm_text", "original", "pseudonym")


def _rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _analysed(spark, sf_dir)
    return made.select("doc_id", pseudonym.rewrite(F.col("text"), F.col("entities")).alias("text_anon"))


def _reidentified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten and turned back: equal to the text where each entity has one spelling."""
    made = analyse.pseudonymise(dossier(spark, sf_dir))
    back = pseudonym.reidentify(F.col("text_anon"), F.from_json("mapping", "map<string,string>"))
    return made.select("doc_id", back.alias("text_back"))


def _mapping_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON mapping parsed again."""
    made = analyse.pseudonymise(dossier(spark, sf_dir)).select("doc_id", F.inline(pseudonym.parse_mapping(F.col("mapping"))))
    return made.select("doc_id", "pseudonym", "category", F.col("number").cast("bigint").alias("number"), "original")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).groupBy("category").agg(F.count("*").alias("total"), F.count_if("enabled").alias("n_enabled"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _analysed(spark, sf_dir)
    return made.select("doc_id", F.size("entities").cast("bigint").alias("total"), "propagated", F.col("variant_count").alias("variants"), "procedural")


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.panel(_entities(spark, sf_dir), ["doc_id"])


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, label, colour, p, s) for n, label, colour, p, s in CATEGORIES], "category string, label string, color string, priority int, structured boolean")


def _validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate number with its checksum's verdict."""
    text, out = F.col("text"), None
    from maskweave.functions.dialect import java

    for name, check in (("nir", validators.valid_nir), ("iban", validators.valid_iban), ("siren", validators.valid_siren)):
        found = dossier(spark, sf_dir).select("doc_id", F.explode(spans.matches(text, java(BY_NAME[name].source))).alias("m"))
        part = found.select("doc_id", F.lit(name).alias("kind"), F.col("m.text").alias("number"), check(F.col("m.text")).alias("valid"))
        out = part if out is None else out.unionByName(part)
    return out


# --- review: edits on entities of a few categories, which SQL can follow ---


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = analyse.with_spans(dossier(spark, sf_dir), only=("email", "phone", "birth_digits", "lawyer_title"))
    return made.withColumn("entities", pseudonym.number_rows(resolve.resolve(F.col("spans"))))


def _entity_rows(df: DataFrame, column: str = "entities") -> DataFrame:
    return spans.rows(df, ["doc_id"], column)


def _review_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _reviewed(spark, sf_dir)
    start = (F.instr("text", "75011") - 1).cast("bigint")
    return _entity_rows(review.add_entity(df, start, start + 5, F.lit("LIEU")))


def _review_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _reviewed(spark, sf_dir)
    return _entity_rows(review.apply_replace(df, F.lit("example"), F.lit("LIEU"), F.lit("LIEU_001")))


def _review_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity_rows(_reviewed(spark, sf_dir).withColumn("entities", review.remove_entity(F.col("entities"), F.lit(0))))


def _review_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity_rows(_reviewed(spark, sf_dir).withColumn("entities", review.toggle_entity(F.col("entities"), F.lit(0))))


def _review_toggle_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _reviewed(spark, sf_dir).withColumn("entities", review.toggle_category(F.col("entities"), F.lit("EMAIL")))
    return _entity_rows(df.withColumn("entities", review.toggle_category(F.col("entities"), F.lit("AVOCAT"))))


def _review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last phone and the e-mail stand a few letters apart, which is refused; two made neighbours are merged."""
    df = _reviewed(spark, sf_dir).filter(F.size("entities") >= 2)
    mail = F.filter("entities", lambda e: e["category"] == "EMAIL")
    at = F.get(mail, F.lit(0))["start"]
    halves = F.array(*[F.struct((at + a).alias("start"), (at + b).alias("end"), F.substr("text", (at + a + 1).cast("int"), F.lit(b - a)).alias("text"), F.lit("EMAIL").alias("category"), F.lit(f"EMAIL_00{i}").alias("pseudonym"), F.lit(True).alias("enabled")) for i, (a, b) in enumerate(((0, 2), (3, 6)), 1)])
    df = df.withColumn("entities", halves.cast(f"array<{pseudonym.ENTITY}>"))
    return _entity_rows(review.merge(df, F.array(F.lit(0), F.lit(1)), F.lit("LIEU")))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _reviewed(spark, sf_dir)
    return spans.rows(df.withColumn("parts", review.segments(F.col("text"), F.col("entities"))), ["doc_id"], "parts")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _documents(spark, sf_dir)
    return df.select("doc_id", F.size(review.search(F.col("text"), F.lit(" The "))).cast("bigint").alias("any_case"), F.size(review.search(F.col("text"), F.lit("The"), True)).cast("bigint").alias("this_case"))


# --- sources and sinks ---


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files, turns as pages."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("file"), (F.col("turn") + 1).cast("int").alias("page"), "text", (F.col("turn") % 2 == 1).alias("used_ocr"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.corpus(_pages(spark, sf_dir), ["conv_id"], ["file", "page"])


def _page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ingest.with_offsets(_pages(spark, sf_dir), ["conv_id"], ["file", "page"])
    return made.select("conv_id", "file", "page", F.col("offset").cast("bigint").alias("offset"))


def _page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _corpus(spark, sf_dir).select("conv_id", F.inline(export.page_spans(F.col("text"))))
    return made.select("conv_id", "file", "page", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def _page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all documents; cuts by bytes, which SQL on characters cannot follow."""
    made = ingest.virtual_pages(_documents(spark, sf_dir), ["doc_id"])
    return made.select("doc_id", F.col("page").cast("bigint").alias("page"), F.md5("text").alias("digest"))


def _text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as text files in three encodings, read to pages and put together again."""
    text, n = F.coalesce("text", F.lit("")), F.pmod("doc_id", F.lit(3))
    utf8 = F.encode(text, "UTF-8")
    content = F.when(n == 0, utf8).when(n == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(F.encode(text, "UTF-16"))
    files = _documents(spark, sf_dir).select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), content.alias("content"))
    pages = ingest.extract(files).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return pages.select(F.regexp_extract("file", r"^(-?[0-9]+)\.txt$", 1).cast("bigint").alias("doc_id"), F.md5(F.array_join("p.text", "")).alias("digest"))


def _routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("in/f"), F.col("page_id").cast("string"), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in ("PDF", "txt", "csv", "html", "DOCX", "rtf", "md")]), (F.col("page_id") % 7 + 1).cast("int"))).alias("path"))
    return made.select("page_id", ingest.name(F.col("path")).alias("name"), ingest.extension(F.col("path")).alias("ext"), ingest.kind(F.col("path")).alias("kind"))


def _ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", ingest.needs_ocr(F.col("text")).alias("needs_ocr"))


def _ocr_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The OCR rule on the whole text of every virtual page of all documents."""
    made = ingest.virtual_pages(_documents(spark, sf_dir), ["doc_id"])
    return made.select("doc_id", F.col("page").cast("bigint").alias("page"), ingest.needs_ocr(F.col("text")).alias("needs_ocr"))


def _file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers as files: those of nations up to 14 are listed, those from 10 on are new, so 10 to 14 are both."""
    files = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_nationkey", F.concat(F.lit("d/"), "s_name").alias("path"), F.col("s_suppkey").cast("int").alias("file_order"))
    made = ingest.move_file(ingest.add_files(files.filter("s_nationkey <= 14"), files.filter("s_nationkey >= 10")), 1, 4)
    return made.select("path", "name", F.col("file_order").cast("bigint").alias("file_order"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redaction requests of corpora of three case files each, by in-row page lookup."""
    pages = dossier(spark, sf_dir).select((F.col("doc_id") % 500).alias("corpus_id"), F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string"), F.lit(".pdf")).alias("file"), F.col("doc_id").cast("int").alias("page"), "text", F.lit(False).alias("used_ocr"))
    whole = ingest.corpus(pages, ["corpus_id"], ["page"])
    made = analyse.with_spans(whole, only=("email", "nir")).withColumn("entities", pseudonym.number_rows(resolve.resolve(F.col("spans"))))
    return export.redaction_requests(made, ["corpus_id"])


HOCR = "concat('<p><span class=''ocrx_word'' id=''w1'' title=''bbox 10 20 ', cast(30 + s_suppkey as {s}), ' 40; x_wconf 9''><strong>', s_name, '</strong></span> <span class=\"ocrx_word\" id=\"w2\" title=\"bbox 50 21 90 41\">Dup0nt&amp;</span><span class=''ocrx_word'' title=''bbox 1 2 3 4''> </span></p>')"


def _hocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.expr(HOCR.format(s="string")).alias("hocr"))
    return redact.words_of(pages, ["s_suppkey"]).select("s_suppkey", "text", "x1", "y1", "x2", "y2")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.struct(t.alias("text"), F.lit(x).alias("x1"), F.lit(5).alias("y1"), F.lit(x + 9).alias("x2"), F.lit(15).alias("y2")) for t, x in ((F.lit("M."), 1), (F.split("p_name", " ")[0], 12), (F.lit("Dup0nt,"), 24), (F.lit("x"), 36))])
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", words.alias("w"), F.concat(F.upper(F.split("p_name", " ")[0]), F.lit(" Dupont")).alias("entity"))
    found = rows.select("p_partkey", F.explode(redact.boxes(F.col("entity"), F.col("w"))).alias("b"))
    return found.select("p_partkey", F.inline(F.array(redact.padded(F.col("b")))))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"flagship": flagship, "analysis_documents": analysis_documents}
    out |= {f"scan_{p.name}": partial(_scan, p.name) for p in PATTERNS}
    out |= {f"scan_{n}_documents": partial(_scan_table, n, "documents", "doc_id", "text") for n in QUICK}
    out |= {f"scan_{n}_pages": partial(_scan_table, n, "pages", "page_id", "html") for n in ("email", "phone")}
    out |= {
        "checksums": _validity, "categories": _categories, "detected": partial(_stage, 0, "spans"), "dates_reclassified": partial(_stage, 1, "spans"), "doubtful_dropped": partial(_stage, 2, "spans"),
        "persons_in_companies": partial(_stage, 3, "companies"), "propagated": partial(_stage, 5, "spread"), "spelling_variants": partial(_stage, 7, "variants"), "particles_trimmed": partial(_stage, 9, "spans"),
        "resolved": _resolved, "entities": _entities, "mapping": _mapping, "mapping_spread": _mapping_spread, "mapping_resumed": _resumed, "mapping_entries": _mapping_entries, "rewritten": _rewritten,
        "reidentified": _reidentified, "stats": _stats, "analysis_counts": _counts, "panel": _panel, "review_add": _review_add, "review_replace": _review_replace, "review_remove": _review_remove,
        "review_toggle": _review_toggle, "review_toggle_category": _review_toggle_category, "review_merge": _review_merge, "highlight_segments": _segments, "search": _search, "corpus_text": _corpus,
        "page_offsets": _page_offsets, "page_spans": _page_spans, "page_split": _page_split, "text_files": _text_files, "file_routing": _routing, "ocr_needed": _ocr, "ocr_needed_documents": _ocr_documents, "file_list": _file_list, "redaction_requests": _requests, "hocr_words": _hocr,
        "redaction_boxes": _boxes,
    }
    return out


def oracle_sql() -> dict[str, str]:
    from maskweave.plans.oracle_queries import oracle_queries

    return oracle_queries()
