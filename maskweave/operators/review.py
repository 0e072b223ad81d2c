"""Review edits as plans over (text, entities) rows; offsets are found in the text's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions.validators import trim
from maskweave.operators.pseudonym import ENTITY, key, label
from maskweave.operators.refine import trim_particles
from maskweave.operators.spans import SPANS, let, pieces, sweep

MAX_GAP = 20


def occurrences(text: Column, needle: Column, case_sensitive: bool = False) -> Column:
    """Starts of all copies of a needle, overlapping ones too, from 0: the text is cut ahead of each copy, in one pass."""
    hay = text if case_sensitive else F.lower(text)
    pin = needle if case_sensitive else F.lower(needle)
    ahead = F.concat(F.lit(r"(?=\Q"), F.replace(pin, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(x))).alias("out"))
    # every piece but the last ends where a copy begins; a copy at the very beginning cuts nothing
    ends = lambda p: F.aggregate(F.slice(p, 1, F.size(p) - 1), zero, step, lambda acc: acc["out"])
    none = F.array().cast("array<bigint>")
    found = F.concat(F.when(F.startswith(hay, pin), F.array(F.lit(0).cast("bigint"))).otherwise(none), let(F.split(hay, ahead, -1), ends))
    return F.when((F.length(pin) > 0) & F.contains(hay, pin), found).otherwise(none)


def search(text: Column, needle: Column, case_sensitive: bool = False) -> Column:
    """Occurrences of a trimmed needle of two characters or more."""
    wanted = trim(needle)
    return F.when(F.length(wanted) >= 2, occurrences(text, wanted, case_sensitive)).otherwise(F.array().cast("array<bigint>"))


def next_pseudonym(entities: Column, category: Column, text: Column) -> Column:
    """The pseudonym that a text has in its category, or the next free number."""
    own = F.filter(entities, lambda e: e["category"] == category)
    known = F.filter(own, lambda e: key(e["category"], e["text"]) == key(category, text))
    top = F.array_max(F.transform(own, lambda e: F.regexp_extract(e["pseudonym"], r"_([0-9]+)$", 1).try_cast("int")))
    return F.coalesce(F.get(known, F.lit(0))["pseudonym"], label(category, F.coalesce(top, F.lit(0)) + 1))


def _entity(start: Column, size: Column, text: Column, category: Column, pseudonym: Column) -> Column:
    return F.struct(start.alias("start"), (start + size).alias("end"), F.substr(text, (start + 1).cast("int"), size.cast("int")).alias("text"), category.alias("category"), pseudonym.alias("pseudonym"), F.lit(True).alias("enabled")).cast(ENTITY)


def _overlaps(e: Column, start: Column, end: Column) -> Column:
    return (start < e["end"]) & (end > e["start"])


def by_start(entities: Column) -> Column:
    return F.sort_array(entities)


def add_entity(df: DataFrame, start: Column, end: Column, category: Column, text: str = "text", entities: str = "entities") -> DataFrame:
    """df with entities grown and needle, pseudonym and skipped appended: particles are cut off the marked span; every
    copy that overlaps nothing is added, else the marked span itself.  Nothing changes where only particles were marked."""
    body, own = F.col(text), F.col(entities)
    marked = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.substr(body, (start + 1).cast("int"), (end - start).cast("int")).alias("text"), category.alias("category"), F.lit(0).cast("bigint").alias("seq"))
    # one column per step, so that each is evaluated once
    out = df.withColumn("__clean", F.get(trim_particles(body, F.array(marked).cast(SPANS)), F.lit(0))).withColumn("needle", F.col("__clean.text"))
    size = F.length("needle").cast("bigint")
    out = out.withColumn("pseudonym", F.when(F.col("needle").isNotNull(), next_pseudonym(own, category, F.col("needle")))).withColumn("__places", occurrences(body, F.col("needle")))
    out = out.withColumn("__copies", F.filter("__places", lambda s: ~F.exists(own, lambda e: (e["start"] == s) & (e["end"] == s + size))))
    out = out.withColumn("__free", F.filter("__copies", lambda s: ~F.exists(own, lambda e: _overlaps(e, s, s + size))))
    added = F.when(F.size("__free") > 0, F.col("__free")).otherwise(F.array("__clean.start"))
    new = F.transform(added, lambda s: _entity(s, size, body, category, F.col("pseudonym")))
    grown = F.when(F.col("needle").isNull(), own).otherwise(by_start(F.concat(own, new)))
    return out.withColumns({entities: grown, "skipped": F.size("__copies") - F.size("__free")}).drop("__clean", "__places", "__copies", "__free")


def apply_replace(df: DataFrame, needle: Column, category: Column, pseudonym: Column, text: str = "text", entities: str = "entities") -> DataFrame:
    """All copies of the needle (case counts) become entities; those they overlap go."""
    body, own, size = F.col(text), F.col(entities), F.length(needle).cast("bigint")
    out = df.withColumn("__places", occurrences(body, needle, True))
    kept = F.filter(own, lambda e: ~F.exists("__places", lambda s: _overlaps(e, s, s + size)))
    return out.withColumn(entities, by_start(F.concat(kept, F.transform("__places", lambda s: _entity(s, size, body, category, pseudonym))))).drop("__places")


def dismiss_replace(df: DataFrame, pending: str = "pending_replace") -> DataFrame:
    """An offered replacement is dropped; entities stay as they are."""
    return df.withColumn(pending, F.lit(None).cast(df.schema[pending].dataType))


def remove_entity(entities: Column, index: Column) -> Column:
    return F.filter(entities, lambda e, i: i != index)


def toggle_entity(entities: Column, index: Column) -> Column:
    return F.transform(entities, lambda e, i: F.when(i == index, e.withField("enabled", ~e["enabled"])).otherwise(e))


def toggle_category(entities: Column, category: Column) -> Column:
    """All on turns all off; anything else turns all on."""
    on = F.forall(F.filter(entities, lambda e: e["category"] == category), lambda e: e["enabled"])
    return F.transform(entities, lambda e: F.when(e["category"] == category, e.withField("enabled", ~on)).otherwise(e))


def merge(df: DataFrame, indices: Column, category: Column, text: str = "text", entities: str = "entities") -> DataFrame:
    """Selected neighbours become one entity; unchanged if fewer than two or a gap is too long or holds a word."""
    body, own = F.col(text), F.col(entities)
    out = df.withColumns({"__chosen": by_start(F.filter(own, lambda e, i: F.array_contains(indices, i))), "__rest": F.filter(own, lambda e, i: ~F.array_contains(indices, i))})
    chosen, pairs = F.col("__chosen"), F.greatest(F.size("__chosen") - 1, F.lit(0))
    gap = lambda a, b: F.when(b["start"] > a["end"], F.substr(body, (a["end"] + 1).cast("int"), (b["start"] - a["end"]).cast("int"))).otherwise(F.lit(""))
    out = out.withColumn("__gaps", F.zip_with(F.slice(chosen, 1, pairs), F.slice(chosen, 2, pairs), gap))
    joins = F.forall("__gaps", lambda g: (F.length(g) <= MAX_GAP) & ~g.rlike("[a-zA-ZÀ-ÿ]{3,}"))
    out = out.withColumns({"__ok": (F.size(chosen) >= 2) & joins, "__start": F.get(chosen, F.lit(0))["start"], "__end": F.get(chosen, F.size(chosen) - 1)["end"]})
    size = F.col("__end") - F.col("__start")
    out = out.withColumn("__whole", F.substr(body, (F.col("__start") + 1).cast("int"), size.cast("int"))).withColumn("__name", next_pseudonym(own, category, F.col("__whole")))
    made = by_start(F.concat("__rest", F.array(_entity(F.col("__start"), size, body, category, F.col("__name")))))
    return out.withColumn(entities, F.when(F.col("__ok"), made).otherwise(own)).drop("__chosen", "__rest", "__gaps", "__ok", "__start", "__end", "__whole", "__name")


def segments(text: Column, entities: Column) -> Column:
    """array<struct<start, text, category>>: plain (null category) and marked stretches, joining to the text."""
    end = F.length(text).cast("bigint")
    mark = lambda a, b, c: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), c.cast("string").alias("c"))
    none = F.lit(None)

    def bounds(kept: Column) -> Column:
        before = lambda e, i: mark(F.coalesce(F.get(kept, i - 1)["end"], F.lit(0)), e["start"], none)
        each = F.flatten(F.transform(kept, lambda e, i: F.array(before(e, i), mark(e["start"], e["end"], e["category"]))))
        rest = mark(F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0)), end, none)
        return F.filter(F.concat(each, F.array(rest)), lambda b: b["c"].isNotNull() | (b["b"] > b["a"]))

    chosen = let(sweep(F.filter(by_start(entities), lambda e: e["enabled"])), bounds)
    return pieces(text, chosen, lambda cut, b: F.struct(b["a"].alias("start"), cut(b["a"], b["b"]).alias("text"), b["c"].alias("category")))


def panel(rows, keys: list[str]):
    """Per category of exploded entities (keys, category, text, pseudonym, enabled): total, enabled and distinct forms."""
    return rows.groupBy(*keys, "category").agg(F.count("*").alias("total"), F.count_if("enabled").alias("n_enabled"), F.count_distinct(F.struct("text", "pseudonym")).alias("n_forms"))
