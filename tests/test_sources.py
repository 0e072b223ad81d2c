"""Queries on sources that cover whole tables, against plain versions."""

import hashlib

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plain_pages(text, size=3000):
    """Pages filled line by line; a line that does not fit an empty page is cut character by character."""
    if len(text.encode()) <= size:
        return [text]
    pages, rest = [], text
    while rest:
        whole, used = 0, 0
        for k, c in enumerate(rest):
            if used + len(c.encode()) > size:
                break
            used, whole = used + len(c.encode()), k + 1
        cut = rest.rfind("\n", 0, whole) + 1 if whole < len(rest) else whole
        pages.append(rest[: cut or whole])
        rest = rest[cut or whole :]
    return pages


def test_pages_of_all_documents(spark):
    docs = duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall()
    want = {(d, n, hashlib.md5(p.encode()).hexdigest()) for d, t in docs for n, p in enumerate(plain_pages(t), 1)}
    got = entry.queries()["page_split"](spark, SF).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(not t.isascii() and len(t.encode()) > 3000 for _, t in docs)


def test_ocr_rule_on_whole_pages_of_all_documents(spark):
    space = "\t\n\x0b\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
    docs = duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall()
    want = {(d, n, len(p.strip(space).encode()) < 20) for d, t in docs for n, p in enumerate(plain_pages(t), 1)}
    got = entry.queries()["ocr_needed_documents"](spark, SF).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len({w[2] for w in want}) == 2


def test_file_list_of_all_suppliers(spark):
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from read_parquet('{SF}/supplier.parquet')")
    want = con.execute(entry.oracle_sql()["file_list"]).fetchall()
    got = [tuple(r) for r in entry.queries()["file_list"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) == con.execute("select count(*) from supplier").fetchone()[0]
