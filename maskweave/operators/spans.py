"""Spans of a text: array<struct<start, end, text, category, seq>>, offsets in code points, end exclusive.

`seq` carries detection order (stage, pattern, ordinal) wherever the rows go, as ties are broken by it.  A
text's spans live in its own row, so that detection, refinement, resolution, numbering and rewriting are all
narrow: no shuffle, whatever the number of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions import dialect, validators
from maskweave.operators.patterns import CATEGORIES, NO_FIRST_NAMES, NUMBER, PATTERNS, STOPWORDS, Pattern

SPAN = "struct<start:bigint,end:bigint,text:string,category:string,seq:bigint>"
SPANS = f"array<{SPAN}>"
#: The same as a type object, which a UDF can hold where no session is.
SPANS_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n in ("text", "category") else T.LongType()) for n in ("start", "end", "text", "category", "seq")]))


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once: the only element of a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sweep(ordered: Column) -> Column:
    """Of spans in order, those that start at or after the end of the last one taken.

    The places taken are gathered in one string, which grows by a few bytes a span where an array would be copied whole.
    """

    def kept(spans: Column) -> Column:
        places = F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i")))
        zero = F.struct(F.lit(-1).cast("bigint").alias("last"), F.lit("").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            free = x["start"] >= acc["last"]
            return F.struct(F.when(free, x["end"]).otherwise(acc["last"]).alias("last"), F.when(free, F.concat(acc["out"], F.lit(","), x["i"].cast("string"))).otherwise(acc["out"]).alias("out"))

        out = F.aggregate(places, zero, step, lambda acc: F.substr(acc["out"], F.lit(2)))
        at = F.when(out == "", F.array().cast("array<string>")).otherwise(F.split(out, ","))
        return F.transform(at, lambda i: F.get(spans, i.cast("int")))

    return let(ordered, kept)


def pieces(text: Column, bounds: Column, made) -> Column:
    """made(cut, b) of every element b of bounds, where cut(start, end) is that stretch of the text.

    Stretches are cut from an encoding of equal width, so each costs its own length wherever it lies.
    """
    cut = lambda wide, a, b: F.decode(F.substr(wide, (a * 4 + 1).cast("int"), ((b - a) * 4).cast("int")), "UTF-32")
    return let(F.encode(text, "UTF-32"), lambda wide: F.transform(bounds, lambda b: made(lambda x, y: cut(wide, x, y), b)))


def rows(df, keys: list[str], column: str):
    """One row per span or entity.  The outer form keeps the optimiser from adding a filter that evaluates the array again."""
    made = df.select(*keys, F.inline_outer(column))
    return made.filter(F.col("start").isNotNull())


def empty() -> Column:
    return F.array().cast(SPANS)


def starts(gaps: Column, found: Column) -> Column:
    """Start of every match from the gaps before them: one pass over the lengths."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).cast("bigint").alias("g"), F.length(m).cast("bigint").alias("m")))
    step = lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["g"])).alias("out"))
    return F.aggregate(sizes, zero, step, lambda acc: acc["out"])


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, text>> of a Java pattern's matches; a group starts at its first copy inside the match."""
    rx = F.lit(pattern)
    gaps = F.split(text, rx, -1)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    inner = (lambda m: F.regexp_extract_all(text, rx, F.lit(group))) if group else (lambda m: m)
    none = F.array().cast("array<struct<start:bigint,text:string>>")

    def placed(m: Column) -> Column:
        places = F.zip_with(starts(gaps, m), m, lambda s, x: F.struct(s.alias("s"), x.alias("m")))
        made = F.zip_with(places, inner(m), lambda p, g: F.struct((p["s"] + F.instr(p["m"], g) - 1).cast("bigint").alias("start"), g.alias("text")))
        return F.filter(made, lambda x: x["text"] != "")

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none)


def _accepted(pattern: Pattern):
    check = {
        "nir": lambda x: validators.valid_nir(x),
        "iban": lambda x: validators.valid_iban(x),
        "siren": lambda x: validators.valid_siren(x),
        "name": lambda x: (F.length(validators.trim(x)) >= pattern.least) & ~validators.is_stopword(x, STOPWORDS),
        "place": lambda x: F.length(validators.trim(x)) >= pattern.least,
    }
    return check.get(pattern.check, check["place"] if pattern.least else lambda _: F.lit(True))


def catalyst_spans(text: Column, pattern: Pattern, number: int) -> Column:
    """One pattern's spans by built-in functions alone."""
    found = matches(text, dialect.java(pattern.source, pattern.ignore_case), pattern.group)
    kept = F.filter(found, lambda x: _accepted(pattern)(x["text"]))
    shown = (lambda t: validators.trim(t)) if pattern.trimmed else (lambda t: t)
    made = F.transform(
        kept,
        lambda x, i: F.struct(
            x["start"].alias("start"), (x["start"] + F.length(x["text"])).cast("bigint").alias("end"), shown(x["text"]).alias("text"), F.lit(pattern.category).alias("category"),
            (F.lit(number << 32).cast("bigint") + i).alias("seq"),
        ),
    )
    return made.cast(SPANS)


# --- patterns that loop over groups: Java's engine recurses on those and overflows its stack on long runs ---


@lru_cache(maxsize=None)
def _compiled(pattern: Pattern) -> re.Pattern:
    return re.compile(dialect.python(pattern.source, pattern.ignore_case))


@lru_cache(maxsize=None)
def _strip() -> re.Pattern:
    return re.compile(f"^[{dialect.SPACE}]+|[{dialect.SPACE}]+\\Z")


def _words(text: str) -> list[str]:
    return re.split(f"[{dialect.SPACE}]+", text)


def _stopword(text: str) -> bool:
    upper = _strip().sub("", text.upper())
    return upper in STOPWORDS or all(w in STOPWORDS for w in _words(upper))


_CAPS, _CAPS_WORD, _FIRST = (re.compile(p) for p in (r"[A-ZÀ-ÖØ-ÞŸ]{2,}", r"[A-ZÀ-ÖØ-ÞŸ]{2,}(?:-[A-ZÀ-ÖØ-ÞŸ]{2,})*\Z", r"[A-ZÀ-ÖØ-ÞŸ][a-zà-ÿ]"))


def _full_name(text: str) -> bool:
    """A first name in mixed case that is no common word, and a surname in capitals of over two letters."""
    import unicodedata

    words = _words(text)
    first = next((w for w in words if _FIRST.match(w)), None)
    if first is None or not any(_CAPS_WORD.match(w) for w in words):
        return False
    plain = "".join(c for c in unicodedata.normalize("NFD", first) if not 0x300 <= ord(c) <= 0x36F)
    return plain not in NO_FIRST_NAMES and not all(len(w) <= 2 for w in words if _CAPS.match(w))


def _nir(text: str) -> bool:
    d = "".join(_words(text))
    return len(d) == 15 and 97 - int(d[:13]) % 97 == int(d[13:])


def _iban(text: str) -> bool:
    clean = "".join(_words(text)).upper()
    return 15 <= len(clean) <= 34 and int("".join(str(int(c, 36)) for c in clean[4:] + clean[:4])) % 97 == 1


def _siren(text: str) -> bool:
    d = "".join(_words(text))
    luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return len(d) in (9, 14) and luhn and d[0] != "0" and len(set(d)) > 1


_CHECKS = {"nir": _nir, "iban": _iban, "siren": _siren, "name": lambda x: not _stopword(x), "caps": lambda x: not _stopword(x) and _full_name(x)}


def python_spans(text: str | None, pattern: Pattern, number: int) -> Iterator[tuple]:
    k = 0
    check = _CHECKS.get(pattern.check)
    for m in _compiled(pattern).finditer(text or ""):
        got = m[pattern.group]
        if not got or (pattern.least and len(_strip().sub("", got)) < pattern.least) or (check and not check(got)):
            continue
        start = m.start() + m[0].index(got)
        yield start, start + len(got), _strip().sub("", got) if pattern.trimmed else got, pattern.category, (number << 32) + k
        k += 1


def span_arrays(texts: Iterable[Iterable[tuple]]) -> pa.Array:
    """Spans of a batch of texts as one Arrow array, made from flat columns."""
    flat, offsets = [], [0]
    for found in texts:
        flat.extend(found)
        offsets.append(len(flat))
    columns = list(zip(*flat, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["start", "end", "text", "category", "seq"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


def span_tuples(spans: pa.Array) -> Iterator[list[tuple]]:
    """Spans of each text of a batch as (start, end, text, category, seq); none where the array is null."""
    flat, at = spans.flatten(), 0
    rows = list(zip(*(flat.field(c).to_pylist() for c in ("start", "end", "text", "category", "seq")), strict=True))
    for size in pc.list_value_length(spans).to_pylist():
        yield rows[at : at + (size or 0)]
        at += size or 0


def python_scan(numbered: tuple[tuple[Pattern, int], ...]):
    """An Arrow UDF: text to the spans of all given patterns, so that a text crosses once."""

    @F.arrow_udf(SPANS_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        return span_arrays((s for p, n in numbered for s in python_spans(t, p, n)) for t in texts.to_pylist())

    return scan.asNondeterministic()  # kept apart by the optimiser, so that it runs once


#: Up to so many patterns run as built-in functions; more go through one UDF, where a text with many hits
#: is scanned once a pattern and not once a gate, a split and an extraction (measured on one core: 5 times faster on
#: case files, twice on documents with few hits).
FEW = 4


def numbered(only: tuple[str, ...] | None = None, extra: tuple[Pattern, ...] = ()) -> tuple[tuple[Pattern, int], ...]:
    """The wanted patterns with their places in detection order; a user's own stand behind all others."""
    names = {c[0] for c in CATEGORIES}
    for k, p in enumerate(extra):
        if p.name in NUMBER or p.name in [x.name for x in extra[:k]]:
            raise ValueError(f"a pattern of this name exists: {p.name}")
        if p.category not in names:
            raise ValueError(f"unknown category: {p.category}")
        if _compiled(p).groups < p.group:
            raise ValueError(f"{p.name} has no group {p.group}")
    return tuple((p, n) for n, p in enumerate((*PATTERNS, *extra)) if only is None or p.name in only or p in extra)


def detect(text: Column, only: tuple[str, ...] | None = None, few: int = FEW, extra: tuple[Pattern, ...] = ()) -> Column:
    """All patterns' spans in detection order; only: names of the wanted patterns; extra: a user's own patterns."""
    chosen = numbered(only, tuple(extra))
    built_in = len(chosen) <= few
    here = [catalyst_spans(text, p, n) for p, n in chosen if p.engine == "catalyst" and built_in]
    there = tuple((p, n) for p, n in chosen if p.engine == "python" or not built_in)
    parts = here + ([python_scan(there)(text)] if there else [])
    return F.array_sort(F.concat(*parts), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)) if len(parts) > 1 else parts[0]
