"""Queries against their SQL, and the stream."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()
CHECKED = sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con



@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    key = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x or "") for x in r))
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    # the generated documents and pages hold no spans of some patterns
    assert sorted(got.columns) == sorted(want.columns) and (len(got) > 0 or name.endswith(("_documents", "_pages")))
    as_rows = lambda f: key([tuple(None if v is None or v != v else str(v) if isinstance(v, str) else str(int(v)) for v in r) for r in f[sorted(f.columns)].itertuples(index=False, name=None)])
    assert as_rows(got) == as_rows(want)


def test_analysis_of_documents_can_be_undone(spark):
    """All patterns over all documents: putting the originals back gives the texts."""
    from pyspark.sql import functions as F

    from maskweave.operators import pseudonym

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    made = entry.queries()["analysis_documents"](spark, SF)
    back = pseudonym.reidentify(F.col("text_anon"), F.from_json("mapping", "map<string,string>"))
    rows = docs.join(made.withColumn("back", back), "doc_id").select("text", "back", "n_entities").collect()
    assert len(rows) == docs.count() and sum(r.n_entities for r in rows) > 0
    # an original is one of the forms of its pseudonym, which differ in case and spaces only
    plain = lambda t: "".join((t or "").lower().split())
    assert all(plain(r.text) == plain(r.back) for r in rows)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "text_anon", "n_entities"] and df.count() > 0


def test_stream_numbers_go_on(spark, tmp_path):
    from maskweave.streaming import stream

    source, out = tmp_path / "in", tmp_path / "out"
    os.makedirs(source)
    schema = "corpus long, page long, text string"
    run = stream.corpus_sink("corpus", "page", str(out), only=("email",))
    batches = [[(1, 1, "a@b.fr and c@d.fr")], [(1, 2, "c@d.fr and e@f.fr"), (2, 1, "a@b.fr")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = spark.readStream.schema(schema).parquet(str(source)).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    texts = {(r.corpus, r.page): r.text_anon for r in spark.read.parquet(*[str(out / "texts" / f"batch={k}") for k in range(2)]).collect()}
    assert texts == {(1, 1): "EMAIL_001 and EMAIL_002", (1, 2): "EMAIL_002 and EMAIL_003", (2, 1): "EMAIL_001"}
