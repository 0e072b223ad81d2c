"""Refinement passes over a text's spans, each in its own row.

Passes that search the text for strings (propagation, spelling variants) go through one Arrow UDF each; the
others are higher-order functions.  Order matters: dates, doubtful, companies, propagation, variants, trim.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from ahocorasick import Automaton
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskweave.functions import dialect
from maskweave.functions.validators import one_of, strip_accents, trim
from maskweave.operators.patterns import BIRTH_BEFORE, DEATH_BEFORE, NAME_RUN, PARTICLES, PROCEDURE_BEFORE, PROFESSIONALS, STRUCTURED
from maskweave.operators.spans import SPANS, SPANS_TYPE, empty, let, span_arrays, span_tuples

#: `seq` of spans that a pass adds begins here, behind all detected ones.
COMPANY_STAGE, SPREAD_STAGE, VARIANT_STAGE = 1 << 40, 2 << 40, 3 << 40
BEFORE = 60


def reclassify_dates(text: Column, spans: Column) -> Column:
    """Dates after a birth or death phrase become DATE_NAISSANCE; after a procedural phrase they go."""
    lead = lambda x: F.substr(text, F.greatest(F.lit(1), x["start"] + 1 - BEFORE).cast("int"), F.least(x["start"], F.lit(BEFORE)).cast("int"))
    sensitive = lambda x: lead(x).rlike(dialect.java(BIRTH_BEFORE, True)) | lead(x).rlike(dialect.java(DEATH_BEFORE, True))
    category = lambda x: F.when((x["category"] == "DATE") & sensitive(x), F.lit("DATE_NAISSANCE")).otherwise(x["category"])
    moved = F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["text"], category(x).alias("category"), x["seq"]))
    return F.filter(moved, lambda x: (x["category"] != "DATE") | ~lead(x).rlike(dialect.java(PROCEDURE_BEFORE, True))).cast(SPANS)


def drop_doubtful(spans: Column) -> Column:
    """Persons of one word of at most two characters go."""
    short = lambda x: trim(x["text"]).rlike(f"^[^{dialect.SPACE}]{{0,2}}\\z")
    return F.filter(spans, lambda x: ~(one_of(x["category"], ("PERSONNE", *PROFESSIONALS)) & short(x)))


def persons_in_companies(spans: Column) -> Column:
    """Added spans: a person's name inside a company's."""
    names = F.filter(spans, lambda x: one_of(x["category"], ("PERSONNE", *PROFESSIONALS)) & (F.length(x["text"]) >= 3))
    companies = F.filter(spans, lambda x: x["category"] == "PERSONNE_MORALE")

    def inside(c: Column, n: Column) -> Column:
        at = c["start"] + F.instr(F.lower(c["text"]), F.lower(n["text"])) - 1
        return F.struct(
            at.cast("bigint").alias("start"), (at + F.length(n["text"])).cast("bigint").alias("end"),
            F.substr(c["text"], (at - c["start"] + 1).cast("int"), F.length(n["text"])).alias("text"), F.lit("PERSONNE").alias("category"), F.lit(0).cast("bigint").alias("seq"),
        )

    held = lambda c: F.filter(names, lambda n: F.contains(F.lower(c["text"]), F.lower(n["text"])))
    added = F.flatten(F.transform(companies, lambda c: F.filter(F.transform(held(c), lambda n: inside(c, n)), lambda x: (x["start"] != c["start"]) | (x["end"] != c["end"]))))
    return F.transform(added, lambda x, i: x.withField("seq", F.lit(COMPANY_STAGE).cast("bigint") + i)).cast(SPANS)


def _copies(text: str | None, own: list[tuple]) -> Iterator[tuple]:
    """Places of all found strings, read off one pass of an automaton; where strings are equal, the first one's category counts."""
    automaton, places = Automaton(), {x[:2] for x in own}
    for rank, (_, _, string, category, _) in enumerate(sorted(own, key=lambda x: x[4])):
        needle = string.lower()
        if needle and needle not in automaton:
            automaton.add_word(needle, (rank, len(needle), category))
    if text is None or not len(automaton):
        return
    automaton.make_automaton()
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = sorted((rank, last + 1 - size, last + 1, category) for last, (rank, size, category) in automaton.iter(low))
    for k, (_, start, end, category) in enumerate(h for h in hits if h[1:3] not in places):
        yield start, end, text[start:end], category, SPREAD_STAGE + k


@F.arrow_udf(SPANS_TYPE)
def propagate(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Added spans: every further copy of a found string, ignoring case."""
    return span_arrays(_copies(t, own) for t, own in zip(texts.to_pylist(), span_tuples(spans), strict=True))


@lru_cache(maxsize=1)
def _name_runs() -> re.Pattern:
    return re.compile(dialect.python(NAME_RUN))


def _near(a: str, b: str) -> bool:
    """Between one and two edits apart, and alike in the first or the second character."""
    if a == b or abs(len(a) - len(b)) > 2 or (a[:1] != b[:1] and a[1:2] != b[1:2]):
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        if min(row) > 2:
            return False
    return row[-1] <= 2


def _thirds(size: int) -> list[tuple[int, int]]:
    return [(size * k // 3, size * (k + 1) // 3) for k in range(3)]


def _variants(text: str | None, own: list[tuple]) -> Iterator[tuple]:
    """Two edits leave one third of a name whole and move it by two places at most, so only names that share such a third are compared."""
    known = {x[2].lower() for x in own if x[3] == "PERSONNE" and len(x[2]) >= 4}
    if text is None or not known:
        return
    thirds, lengths = defaultdict(set), {len(name) for name in known}
    for name in known:
        for k, (a, b) in enumerate(_thirds(len(name))):
            thirds[len(name), k, name[a:b]].add(name)

    @cache
    def alike(run: str) -> bool:
        sizes = [n for n in range(len(run) - 2, len(run) + 3) if n in lengths]
        keys = ((n, k, run[a + d : b + d]) for n in sizes for k, (a, b) in enumerate(_thirds(n)) for d in range(-2, 3) if a + d >= 0)
        return any(_near(run, name) for name in set().union(*(thirds.get(x, ()) for x in keys)))

    places = {x[:2] for x in own}
    runs = (m for m in _name_runs().finditer(text) if len(m[0].lower()) >= 4 and m.span() not in places)
    new = (m for m in runs if m[0].lower() not in known and alike(m[0].lower()))
    for k, m in enumerate(new):
        yield *m.span(), m[0], "PERSONNE", VARIANT_STAGE + k


@F.arrow_udf(SPANS_TYPE)
def spelling_variants(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Added spans: runs of capitalised words within two edits of a person's name."""
    return span_arrays(_variants(t, own) for t, own in zip(texts.to_pylist(), span_tuples(spans), strict=True))


#: Letters that lose their marks to become one of a particle's.
_ACCENTED = {"a": "aàáâãäå", "c": "cç", "e": "eèéêë", "i": "iìíîï", "n": "nñ", "o": "oòóôõö", "u": "uùúûü", "y": "yýÿ"}
_PARTICLE = "(?:" + "|".join("".join(f"[{_ACCENTED[c]}]" if c in _ACCENTED else c for c in w) for w in PARTICLES) + ")"
LEADING = rf"(?iu)^(?:{_PARTICLE}['’]?[{dialect.SPACE},]+)+"
TRAILING = rf"(?iu)(?:[{dialect.SPACE},]+{_PARTICLE}['’]?)+\z"


def is_particle(text: Column) -> Column:
    return one_of(strip_accents(F.lower(trim(F.regexp_replace(text, "['’]", "")))), PARTICLES)


def trim_particles(text: Column, spans: Column) -> Column:
    """Cut particles and white space off both ends of unstructured spans; what is left must be two characters and no particle."""

    def cut(x: Column) -> Column:
        # each step is evaluated once for a span: written out, they would stand in one another eight times
        raw = F.substr(text, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
        ends = lambda tail, kept: F.struct(
            (x["end"] - F.length(tail) + F.length(kept) - F.length(F.regexp_replace(kept, rf"^[{dialect.SPACE}]+", ""))).cast("bigint").alias("start"), trim(kept).alias("text")
        )
        placed = let(F.regexp_replace(raw, LEADING, ""), lambda tail: let(F.regexp_replace(tail, TRAILING, ""), lambda kept: ends(tail, kept)))
        return let(placed, lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.length(p["text"])).cast("bigint").alias("end"), p["text"].alias("text"), x["category"], x["seq"]))

    moved = F.transform(spans, lambda x: F.when(one_of(x["category"], STRUCTURED), x).otherwise(cut(x).cast("struct<start:bigint,end:bigint,text:string,category:string,seq:bigint>")))
    wanted = lambda x: one_of(x["category"], STRUCTURED) | ((F.length(x["text"]) >= 2) & ~(~F.contains(x["text"], F.lit(" ")) & is_particle(x["text"])))
    return F.filter(moved, wanted).cast(SPANS)


# kept apart by the optimiser: merged into higher-order functions they could not be evaluated, or would run again
propagate, spelling_variants = propagate.asNondeterministic(), spelling_variants.asNondeterministic()


def refine(text: Column, spans: Column) -> list[tuple[str, Column]]:
    """The passes in order, as (column, expression) steps; each reads the columns before it."""
    col = F.col
    return [
        ("spans", reclassify_dates(text, spans)),
        ("spans", drop_doubtful(col("spans"))),
        ("companies", persons_in_companies(col("spans"))),
        ("spans", F.concat("spans", "companies")),
        ("spread", F.when(F.size("spans") > 0, propagate(text, col("spans"))).otherwise(empty())),
        ("spans", F.concat("spans", "spread")),
        ("variants", F.when(F.exists("spans", lambda x: x["category"] == "PERSONNE"), spelling_variants(text, col("spans"))).otherwise(empty())),
        ("spans", F.concat("spans", "variants")),
        ("spans", trim_particles(text, col("spans"))),
    ]
