"""DuckDB SQL by query name."""

from __future__ import annotations

from maskweave.operators.patterns import BY_NAME, CATEGORIES, PATTERNS
from maskweave.plans.oracle import STAGES, _check, chain, quoted, raw, scan, scan_query

ROWS = 'SELECT doc_id, "start", "end", text, category FROM {}'


def _reviewed(only: tuple[str, ...], doc: str) -> dict[str, str]:
    """The stages of a review's entities: detected spans of some patterns, resolved and numbered."""
    keep = {n: STAGES[n] for n in ("ordered", "sweep", "resolved", "forms", "mapping", "entities")}
    return {"doc": doc, "trimmed": raw("doc", [p for p in PATTERNS if p.name in only])} | keep


def _with(stages: dict[str, str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (\n{q}\n)" for n, q in stages.items()) + "\n" + select


REVIEW = _reviewed(("email", "phone", "birth_digits", "lawyer_title"), STAGES["doc"])
ENTITY = 'SELECT doc_id, "start", "end", text, category, pseudonym, enabled FROM '
FIRST = "row_number() OVER (PARTITION BY doc_id ORDER BY \"start\") AS rn"


def _copies(needle: str, case_sensitive: bool) -> str:
    """Starts of all copies of a needle in doc."""
    hay = "text" if case_sensitive else "lower(text)"
    return f"SELECT doc_id, text, CAST(i AS BIGINT) AS s FROM doc, unnest(range(0, greatest(length(text) - {len(needle)} + 1, 0))) AS u(i) WHERE contains({hay}, {quoted(needle)}) AND substr({hay}, i + 1, {len(needle)}) = {quoted(needle)}"


def _pages_sql() -> str:
    return """SELECT conv_id, 'conv' || conv_id || '.txt' AS file, CAST(turn + 1 AS INT) AS page, text,
  e'\\n\\n=== ' || 'conv' || conv_id || '.txt' || ' — page ' || (turn + 1) || CASE WHEN turn % 2 = 1 THEN ' (OCR)' ELSE '' END || e' ===\\n\\n' AS head FROM conversations"""


def _documents(name: str, table: str, key: str, text: str) -> str:
    return scan_query(name, f"SELECT {key} AS doc_id, {text} AS text FROM {table}")


def oracle_queries() -> dict[str, str]:
    out = {f"scan_{p.name}": scan_query(p.name) for p in PATTERNS}
    out |= {f"scan_{n}_documents": _documents(n, "documents", "doc_id", "text") for n in ("email", "phone", "date_digits")}
    out |= {f"scan_{n}_pages": _documents(n, "pages", "page_id", "html") for n in ("email", "phone")}
    quick = _reviewed(("email", "phone", "date_digits"), "SELECT doc_id, text FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    quick["doc"] = "SELECT doc_id, text FROM documents"
    quick["rewritten"] = STAGES["rewritten"]
    out["flagship"] = _with(quick, "SELECT r.doc_id, r.text_anon, (SELECT count(*) FROM entities e WHERE e.doc_id = r.doc_id) AS n_entities FROM rewritten r")
    out["categories"] = "SELECT * FROM (VALUES " + ", ".join(f"({quoted(n)}, {quoted(b)}, {quoted(c)}, {p}, {str(s).lower()})" for n, b, c, p, s in CATEGORIES) + ") AS t(category, label, color, priority, structured)"
    stage = {"detected": "found", "dates_reclassified": "dated", "doubtful_dropped": "sure", "persons_in_companies": "added", "propagated": "spread", "spelling_variants": "variants", "particles_trimmed": "trimmed", "resolved": "resolved"}
    out |= {q: chain(s, ROWS.format(s)) for q, s in stage.items()}
    numbers = []
    for kind in ("nir", "iban", "siren"):
        p = BY_NAME[kind]
        bare = type(p)(p.name, p.category, p.source)
        numbers.append(f"SELECT doc_id, {quoted(kind)} AS kind, text AS number, coalesce({_check(p).replace('(g,', '(text,').replace('length(g)', 'length(text)')}, false) AS valid FROM ({scan(bare, 'doc')})")
    out["checksums"] = f"WITH doc AS ({STAGES['doc']})\n" + "\nUNION ALL\n".join(numbers)
    out["entities"] = chain("entities", ENTITY + "entities")
    mapping = "SELECT doc_id, category, norm_text, original, pseudonym FROM mapping"
    out["mapping"] = out["mapping_spread"] = chain("mapping", mapping)
    out["mapping_entries"] = chain("mapping", "SELECT doc_id, pseudonym, category, CAST(regexp_extract(pseudonym, '([0-9]+)$', 1) AS BIGINT) AS number, original FROM mapping")
    first = {
        "early": r"""SELECT doc_id, category, norm_text, arg_min(text, "start") AS original, row_number() OVER (PARTITION BY doc_id, category ORDER BY min("start")) AS n FROM (
  SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm_text FROM resolved WHERE doc_id % 2 = 0 AND category IN ('EMAIL', 'PERSONNE_MORALE') AND "start" > 400) GROUP BY doc_id, category, norm_text""",
        "top": "SELECT doc_id, category, max(n) AS top FROM early GROUP BY doc_id, category",
        "late": "SELECT f.*, row_number() OVER (PARTITION BY f.doc_id, f.category ORDER BY f.n) AS k FROM forms f WHERE NOT EXISTS (SELECT 1 FROM early e WHERE e.doc_id = f.doc_id AND e.category = f.category AND e.norm_text = f.norm_text)",
    }
    out["mapping_resumed"] = chain(
        "forms",
        """SELECT f.doc_id, f.category, f.norm_text, f.original, f.category || '_' || printf('%03d', CASE WHEN e.n IS NOT NULL THEN e.n ELSE l.k + coalesce(t.top, 0) END) AS pseudonym FROM forms f
LEFT JOIN early e USING (doc_id, category, norm_text) LEFT JOIN late l USING (doc_id, category, norm_text) LEFT JOIN top t ON t.doc_id = f.doc_id AND t.category = f.category""",
        first,
    )
    out["rewritten"] = chain("rewritten", "SELECT doc_id, text_anon FROM rewritten")
    out["reidentified"] = chain(
        "entities",
        """SELECT d.doc_id, coalesce(string_agg(substr(d.text, e.before + 1, e."start" - e.before) || e.original, '' ORDER BY e."start"), '') || substr(any_value(d.text), CAST(coalesce(max(e."end"), 0) + 1 AS BIGINT)) AS text_back
FROM doc d LEFT JOIN (SELECT e.*, m.original, coalesce(lag("end") OVER (PARTITION BY e.doc_id ORDER BY "start"), 0) AS before FROM entities e JOIN mapping m USING (doc_id, pseudonym) WHERE enabled) e USING (doc_id) GROUP BY d.doc_id""",
    )
    out["stats"] = chain("entities", "SELECT category, count(*) AS total, count(*) FILTER (WHERE enabled) AS n_enabled FROM entities GROUP BY category")
    out["panel"] = chain("entities", "SELECT doc_id, category, count(*) AS total, count(*) FILTER (WHERE enabled) AS n_enabled, count(DISTINCT (text, pseudonym)) AS n_forms FROM entities GROUP BY doc_id, category")
    count = lambda t: f"(SELECT count(*) FROM {t} x WHERE x.doc_id = d.doc_id)"
    out["analysis_counts"] = chain("resolved", f"SELECT d.doc_id, {count('resolved')} AS total, {count('spread')} AS propagated, {count('variants')} AS variants, {count('found')} - {count('dated')} AS procedural FROM doc d")

    # review
    number = "coalesce((SELECT max(CAST(regexp_extract(x.pseudonym, '([0-9]+)$', 1) AS INT)) FROM entities x WHERE x.doc_id = c.doc_id AND x.category = 'LIEU'), 0) + 1"
    free = f"""SELECT c.doc_id, c.s AS "start", c.s + 5 AS "end", substr(c.text, c.s + 1, 5) AS text, 'LIEU' AS category, 'LIEU_' || printf('%03d', {number}) AS pseudonym, true AS enabled FROM ({_copies("75011", False)}) c
WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.doc_id = c.doc_id AND c.s < e."end" AND c.s + 5 > e."start")"""
    out["review_add"] = _with(REVIEW | {"free": free}, f"{ENTITY} entities UNION ALL {ENTITY} free")
    copies = {"place": _copies("example", True)}
    out["review_replace"] = _with(
        REVIEW | copies,
        f"""{ENTITY} entities e WHERE NOT EXISTS (SELECT 1 FROM place p WHERE p.doc_id = e.doc_id AND p.s < e."end" AND p.s + 7 > e."start") UNION ALL SELECT doc_id, s, s + 7, 'example', 'LIEU', 'LIEU_001', true FROM place""",
    )
    out["review_remove"] = _with(REVIEW, f"SELECT * EXCLUDE (rn) FROM (SELECT *, {FIRST} FROM entities) WHERE rn > 1")
    out["review_toggle"] = _with(REVIEW, f"SELECT * EXCLUDE (rn) REPLACE (CASE WHEN rn = 1 THEN NOT enabled ELSE enabled END AS enabled) FROM (SELECT *, {FIRST} FROM entities)")
    out["review_toggle_category"] = _with(REVIEW, f"{ENTITY.replace('enabled', 'CASE WHEN category IN (' + chr(39) + 'EMAIL' + chr(39) + ', ' + chr(39) + 'AVOCAT' + chr(39) + ') THEN NOT on_all ELSE enabled END AS enabled')} (SELECT *, bool_and(enabled) OVER (PARTITION BY doc_id, category) AS on_all FROM entities)")
    out["review_merge"] = _with(
        REVIEW,
        """SELECT doc_id, s AS "start", s + 6 AS "end", substr(text, s + 1, 6) AS text, 'LIEU' AS category, 'LIEU_001' AS pseudonym, true AS enabled FROM (
  SELECT d.doc_id, any_value(d.text) AS text, min(CASE WHEN e.category = 'EMAIL' THEN e."start" END) AS s FROM doc d JOIN entities e USING (doc_id) GROUP BY d.doc_id HAVING count(*) >= 2)""",
    )
    out["highlight_segments"] = _with(
        REVIEW
        | {
            "marked": 'SELECT doc_id, "start", "end", category, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS before FROM entities WHERE enabled',
            "tail": 'SELECT d.doc_id, d.text, coalesce(max(m."end"), 0) AS done FROM doc d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id, d.text',
        },
        """SELECT m.doc_id, m."start", substr(d.text, m."start" + 1, m."end" - m."start") AS text, m.category FROM marked m JOIN doc d USING (doc_id)
UNION ALL SELECT m.doc_id, m.before, substr(d.text, m.before + 1, m."start" - m.before), NULL FROM marked m JOIN doc d USING (doc_id) WHERE m."start" > m.before
UNION ALL SELECT doc_id, done, substr(text, done + 1), NULL FROM tail WHERE done < length(text)""",
    )
    out["search"] = """SELECT doc_id, CAST(len(string_split(lower(text), 'the')) - 1 AS BIGINT) AS any_case, CAST(len(string_split(text, 'The')) - 1 AS BIGINT) AS this_case FROM documents"""

    # sources and sinks
    out["corpus_text"] = f"SELECT conv_id, string_agg(head || text, '' ORDER BY page) AS text FROM ({_pages_sql()}) GROUP BY conv_id"
    offsets = f"SELECT conv_id, file, page, text, head, CAST(sum(length(head) + length(text)) OVER (PARTITION BY conv_id ORDER BY page) - length(text) AS BIGINT) AS \"offset\" FROM ({_pages_sql()})"
    out["page_offsets"] = f'SELECT conv_id, file, page, "offset" FROM ({offsets})'
    out["page_spans"] = f'''SELECT conv_id, file, page, "offset" AS "start", "offset" + length(text) + CASE WHEN lead(page) OVER (PARTITION BY conv_id ORDER BY page) IS NULL THEN 0 ELSE 2 END AS "end" FROM ({offsets})'''
    exts = "['PDF', 'txt', 'csv', 'html', 'DOCX', 'rtf', 'md'][page_id % 7 + 1]"
    out["file_routing"] = f"""SELECT page_id, 'f' || page_id || '.' || {exts} AS name, lower({exts}) AS ext, CASE lower({exts}) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'rtf' THEN 'rtf' WHEN 'html' THEN 'unsupported' ELSE 'text' END AS kind FROM pages"""
    out["ocr_needed"] = r"SELECT item_id, strlen(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 20 AS needs_ocr FROM benchmark"
    out["text_files"] = "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"
    out["file_list"] = """SELECT path, name, CAST(CASE WHEN o = 1 THEN 4 WHEN o BETWEEN 2 AND 4 THEN o - 1 ELSE o END AS BIGINT) AS file_order
FROM (SELECT 'd/' || s_name AS path, s_name AS name, row_number() OVER (ORDER BY s_nationkey > 14, s_suppkey) - 1 AS o FROM supplier)"""
    case_files = _reviewed(
        ("email", "nir"),
        f"""SELECT k AS doc_id, string_agg(e'\\n\\n=== ' || 'f' || (id % 3) || '.pdf — page ' || id || e' ===\\n\\n' || t, '' ORDER BY id) AS text FROM (SELECT doc_id AS id, doc_id % 500 AS k, text AS t FROM ({STAGES['doc']})) GROUP BY k""",
    )
    out["redaction_requests"] = _with(
        case_files | {"pagespan": f"SELECT doc_id AS id, doc_id % 500 AS k, 'f' || (doc_id % 3) || '.pdf' AS file, text FROM ({STAGES['doc']})"},
        f"""SELECT DISTINCT p.k AS corpus_id, p.file, CAST(p.id AS INT) AS page, e.text FROM (
  SELECT k, id, file, sum(n + length(text)) OVER (PARTITION BY k ORDER BY id) - length(text) AS s, sum(n + length(text)) OVER (PARTITION BY k ORDER BY id) AS t FROM (SELECT *, length(e'\\n\\n=== ' || file || ' — page ' || id || e' ===\\n\\n') AS n FROM pagespan)) p
JOIN entities e ON e.doc_id = p.k AND e.enabled AND e."start" >= p.s AND e."start" < p.t""",
    )
    out["hocr_words"] = """SELECT s_suppkey, s_name AS text, 10 AS x1, 20 AS y1, CAST(30 + s_suppkey AS INT) AS x2, 40 AS y2 FROM supplier UNION ALL SELECT s_suppkey, 'Dup0nt&', 50, 21, 90, 41 FROM supplier"""
    out["redaction_boxes"] = """SELECT p_partkey, 10 AS x, 3 AS y, 25 AS width, 14 AS height FROM part"""
    return out
