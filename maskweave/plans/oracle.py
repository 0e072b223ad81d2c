"""DuckDB SQL for the catalog's queries: the same operators over rows, written from their definitions."""

from __future__ import annotations

from maskweave.functions import dialect
from maskweave.operators.patterns import (
    BIRTH_BEFORE, BY_NAME, DEATH_BEFORE, LOW, NAME_RUN, NO_FIRST_NAMES, NUMBER, PARTICLES, PATTERNS, PRIORITY, PROCEDURE_BEFORE, PROFESSIONALS, STOPWORDS, STRUCTURED, UP, Pattern,
)
from maskweave.plans.dossier import DOSSIER

#: Look-around, which RE2 lacks, written without it; the group is the span.
REWRITTEN = {
    "siren": (r"\b\d{3}\s?\d{3}\s?\d{3}(?:\s?\d{5})?\b", 0),
    "street": (BY_NAME["street"].source.replace("(?=[,\\n]|$)", "(?:[,\\n]|$)").replace(r"\b\d{1,4}", r"\b(\d{1,4}", 1).replace("{3,60}?", "{3,60}?)"), 1),
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def within(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def _check(p: Pattern) -> str:
    bare = r"regexp_replace(g, '\s', '', 'g')"
    upper = r"upper(trim(g))"
    stop = f"(list_contains({listed(STOPWORDS)}, {upper}) OR len(list_filter(regexp_split_to_array({upper}, '\\s+'), lambda w: NOT list_contains({listed(STOPWORDS)}, w))) = 0)"
    words = r"regexp_split_to_array(g, '\s+')"
    first = f"list_filter({words}, lambda w: regexp_matches(w, '^[{UP}][{LOW}]'))[1]"
    digit = "CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 ELSE CAST(c AS INT) END"
    turned = f"concat(substr(upper({bare}), 5), substr(upper({bare}), 1, 4))"
    luhn = f"list_sum(list_transform(range(1, length({bare}) + 1), lambda i: CASE WHEN (length({bare}) - i) % 2 = 0 THEN CAST(substr({bare}, i, 1) AS INT) ELSE (CAST(substr({bare}, i, 1) AS INT) * 2 - CASE WHEN substr({bare}, i, 1) > '4' THEN 9 ELSE 0 END) END)) % 10 = 0"
    return {
        "": "true",
        "nir": f"length({bare}) = 15 AND 97 - CAST(substr({bare}, 1, 13) AS BIGINT) % 97 = CAST(substr({bare}, 14, 2) AS INT)",
        "iban": f"length({bare}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda c: {digit})), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1",
        "siren": f"length({bare}) IN (9, 14) AND {luhn} AND substr({bare}, 1, 1) <> '0' AND length(replace({bare}, substr({bare}, 1, 1), '')) > 0",
        "name": f"length(trim(g)) >= {p.least} AND NOT {stop}",
        "place": f"length(trim(g)) >= {p.least}",
        "caps": f"length(trim(g)) >= {p.least} AND NOT {stop} AND {first} IS NOT NULL AND len(list_filter({words}, lambda w: regexp_matches(w, '^[{UP}]{{2,}}(?:-[{UP}]{{2,}})*$'))) > 0"
        f" AND NOT list_contains({listed(NO_FIRST_NAMES)}, strip_accents({first})) AND len(list_filter({words}, lambda w: regexp_matches(w, '^[{UP}]{{2,}}') AND length(w) > 2)) > 0",
    }[p.check]


def scan(p: Pattern, source: str) -> str:
    """Rows (doc_id, start, end, text, category, seq) of one pattern over source(doc_id, text)."""
    body, group = REWRITTEN.get(p.name, (p.source, p.group))
    rx = quoted(dialect.re2(body, p.ignore_case))
    shown = "trim(g)" if p.trimmed else "g"
    at = "length(array_to_string(p[1:i], '')) + length(array_to_string(m[1:i - 1], '')) + instr(m[i], g) - 1"
    around = ""
    if p.name == "siren":
        around = r" AND NOT regexp_matches(substr(t, s + 1 - 2, 2), '^\d[-/.]$') AND NOT regexp_matches(substr(t, s + length(g) + 1, 2), '^[-/.]?\d')"
    return f"""SELECT doc_id, CAST(s AS BIGINT) AS "start", CAST(s + length(g) AS BIGINT) AS "end", {shown} AS text, {quoted(p.category)} AS category, CAST({NUMBER[p.name]} * 4294967296 + i AS BIGINT) AS seq
FROM (SELECT doc_id, t, i, g, {at} AS s FROM (
  SELECT doc_id, t, m, p, i, gs[i] AS g FROM (SELECT doc_id, text AS t, regexp_extract_all(text, {rx}, 0) AS m, regexp_extract_all(text, {rx}, {group}) AS gs, regexp_split_to_array(text, {rx}) AS p FROM {source}), unnest(range(1, len(m) + 1)) AS u(i)))
WHERE g IS NOT NULL AND g <> ''{around} AND {_check(p)}"""


def raw(source: str, patterns=PATTERNS) -> str:
    return "\nUNION ALL\n".join(f"SELECT * FROM ({scan(p, source)})" for p in patterns)


def _before(rx: str) -> str:
    return f"regexp_matches(substr(d.text, CAST(greatest(1, r.\"start\" - 59) AS BIGINT), CAST(least(r.\"start\", 60) AS BIGINT)), {quoted(dialect.re2(rx, True))})"


_ACCENTS = {"a": "aàáâãäå", "c": "cç", "e": "eèéêë", "i": "iìíîï", "n": "nñ", "o": "oòóôõö", "u": "uùúûü", "y": "yýÿ"}
_PARTICLE = "(?:" + "|".join("".join(f"[{_ACCENTS[c]}]" if c in _ACCENTS else c for c in w) for w in PARTICLES) + ")"
_PERSONS = within(("PERSONNE", *PROFESSIONALS))
_RUN = quoted(dialect.re2(NAME_RUN))

STAGES = {
    "doc": f"SELECT doc_id, text FROM ({DOSSIER})",
    "found": raw("doc"),
    "dated": f"""SELECT r.doc_id, r."start", r."end", r.text, CASE WHEN r.category = 'DATE' AND ({_before(BIRTH_BEFORE)} OR {_before(DEATH_BEFORE)}) THEN 'DATE_NAISSANCE' ELSE r.category END AS category, r.seq
FROM found r JOIN doc d USING (doc_id) WHERE r.category <> 'DATE' OR {_before(BIRTH_BEFORE)} OR {_before(DEATH_BEFORE)} OR NOT {_before(PROCEDURE_BEFORE)}""",
    "sure": rf"SELECT * FROM dated WHERE NOT (category IN {_PERSONS} AND regexp_matches(trim(text), '^\S{{0,2}}$'))",
    "inside": f"""SELECT s.doc_id, s."start" + instr(lower(s.text), lower(n.text)) - 1 AS "start", s."start" + instr(lower(s.text), lower(n.text)) - 1 + length(n.text) AS "end",
  substr(s.text, instr(lower(s.text), lower(n.text)), length(n.text)) AS text, 'PERSONNE' AS category, 1099511627776 + row_number() OVER (PARTITION BY s.doc_id ORDER BY s.seq, n.seq) AS seq, s."start" AS s0, s."end" AS e0
FROM sure s JOIN sure n ON s.doc_id = n.doc_id AND s.category = 'PERSONNE_MORALE' AND n.category IN {_PERSONS} AND length(n.text) >= 3 AND contains(lower(s.text), lower(n.text))""",
    "added": 'SELECT doc_id, "start", "end", text, category, seq FROM inside WHERE "start" <> s0 OR "end" <> e0',
    "crossed": "SELECT * FROM sure UNION ALL SELECT * FROM added",
    "needles": "SELECT doc_id, category, lower(text) AS needle, min(seq) AS seq FROM crossed GROUP BY doc_id, category, lower(text)",
    "copies": """SELECT doc_id, category, seq, needle, CAST(length(array_to_string(p[1:i], '')) + (i - 1) * length(needle) AS BIGINT) AS s FROM (
  SELECT n.doc_id, n.category, n.seq, n.needle, string_split(lower(d.text), n.needle) AS p FROM needles n JOIN doc d USING (doc_id)), unnest(range(1, len(p))) AS u(i)""",
    "spread": """SELECT doc_id, s AS "start", s + length(needle) AS "end", substr(text, s + 1, length(needle)) AS text, category, 2199023255552 + seq AS seq FROM (
  SELECT c.*, d.text, row_number() OVER (PARTITION BY c.doc_id, s, length(needle) ORDER BY seq) AS rank FROM copies c JOIN doc d USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM crossed x WHERE x.doc_id = c.doc_id AND x."start" = c.s AND x."end" = c.s + length(c.needle))) WHERE rank = 1""",
    "wide": "SELECT * FROM crossed UNION ALL SELECT * FROM spread",
    "known": "SELECT DISTINCT doc_id, lower(text) AS name FROM wide WHERE category = 'PERSONNE' AND length(text) >= 4",
    "runs": f"""SELECT doc_id, CAST(length(array_to_string(p[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS BIGINT) AS s, m[i] AS text FROM (
  SELECT doc_id, regexp_extract_all(text, {_RUN}) AS m, regexp_split_to_array(text, {_RUN}) AS p FROM doc), unnest(range(1, len(m) + 1)) AS u(i) WHERE length(m[i]) >= 4""",
    "variants": """SELECT doc_id, s AS "start", s + length(text) AS "end", text, 'PERSONNE' AS category, 3298534883328 + s AS seq FROM runs r
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.doc_id = r.doc_id AND k.name = lower(r.text)) AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.doc_id = r.doc_id AND w."start" = r.s AND w."end" = r.s + length(r.text))
AND EXISTS (SELECT 1 FROM known k WHERE k.doc_id = r.doc_id AND abs(length(k.name) - length(r.text)) <= 2 AND (substr(k.name, 1, 1) = substr(lower(r.text), 1, 1) OR substr(k.name, 2, 1) = substr(lower(r.text), 2, 1))
  AND levenshtein(k.name, lower(r.text)) BETWEEN 1 AND 2)""",
    "every": "SELECT * FROM wide UNION ALL SELECT * FROM variants",
    "cut": f"""SELECT doc_id, "end" - length(tail) + length(kept) - length(ltrim(kept, e' \\t\\n')) AS s, trim(kept, e' \\t\\n') AS t, category, seq FROM (
  SELECT *, regexp_replace(tail, {quoted(rf"(?i)(?:[\s,]+{_PARTICLE}['’]?)+$")}, '') AS kept FROM (
    SELECT e.*, regexp_replace(substr(d.text, e."start" + 1, e."end" - e."start"), {quoted(rf"(?i)^(?:{_PARTICLE}['’]?[\s,]+)+")}, '') AS tail FROM every e JOIN doc d USING (doc_id) WHERE category NOT IN {within(STRUCTURED)}))""",
    "trimmed": f"""SELECT * FROM every WHERE category IN {within(STRUCTURED)} UNION ALL SELECT doc_id, s, s + length(t), t, category, seq FROM cut
WHERE length(t) >= 2 AND (contains(t, ' ') OR strip_accents(lower(regexp_replace(t, '[''’]', '', 'g'))) NOT IN {within(PARTICLES)})""",
    "ordered": f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", -CASE category {' '.join(f"WHEN {quoted(c)} THEN {p}" for c, p in PRIORITY.items())} ELSE 0 END, "start" - "end", seq) AS rn FROM trimmed""",
    "sweep": """SELECT doc_id, rn, "start", "end", text, category, true AS kept, "end" AS last FROM ordered WHERE rn = 1
UNION ALL SELECT o.doc_id, o.rn, o."start", o."end", o.text, o.category, o."start" >= s.last, CASE WHEN o."start" >= s.last THEN o."end" ELSE s.last END FROM sweep s JOIN ordered o ON o.doc_id = s.doc_id AND o.rn = s.rn + 1""",
    "resolved": 'SELECT doc_id, "start", "end", text, category FROM sweep WHERE kept',
    "forms": r"""SELECT doc_id, category, norm_text, arg_min(text, "start") AS original, row_number() OVER (PARTITION BY doc_id, category ORDER BY min("start")) AS n FROM (
  SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm_text FROM resolved) GROUP BY doc_id, category, norm_text""",
    "mapping": "SELECT doc_id, category, norm_text, original, category || '_' || printf('%03d', n) AS pseudonym FROM forms",
    "entities": r"""SELECT r.doc_id, r."start", r."end", r.text, r.category, m.pseudonym, r.category NOT IN """ + within(PROFESSIONALS) + r""" AS enabled FROM resolved r
JOIN mapping m ON m.doc_id = r.doc_id AND m.category = r.category AND m.norm_text = lower(trim(regexp_replace(r.text, '\s+', ' ', 'g')))""",
    "rewritten": """SELECT d.doc_id, coalesce(string_agg(substr(d.text, e.before + 1, e."start" - e.before) || e.pseudonym, '' ORDER BY e."start"), '') || substr(any_value(d.text), CAST(coalesce(max(e."end"), 0) + 1 AS BIGINT)) AS text_anon
FROM doc d LEFT JOIN (SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS before FROM entities WHERE enabled) e USING (doc_id) GROUP BY d.doc_id""",
}


def chain(last: str, select: str, more: dict[str, str] | None = None) -> str:
    """A query over the stages up to one of them, and further ones of its own."""
    names = list(STAGES)
    used = names[: names.index(last) + 1]
    parts = [f"{n} AS (\n{STAGES[n]}\n)" for n in used] + [f"{n} AS (\n{q}\n)" for n, q in (more or {}).items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def scan_query(name: str, source: str | None = None) -> str:
    """One pattern over the case files, or over a table's text column."""
    given = STAGES["doc"] if source is None else source
    return f'WITH doc AS ({given})\nSELECT doc_id, "start", "end", text, category FROM ({scan(BY_NAME[name], "doc")})'
