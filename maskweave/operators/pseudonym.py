"""Numbering, mapping, rewriting and re-identification.

Within a row (one text, one corpus) numbering is a higher-order function.  `number_corpus` does it for a corpus
spread over many rows: distinct forms are aggregated first, then ranked per corpus and category, so no span
rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskweave.functions.dialect import SPACE
from maskweave.functions.validators import one_of, trim
from maskweave.operators.patterns import CATEGORIES, PROFESSIONALS
from maskweave.operators.spans import let, pieces, rows, sweep

NAMES = tuple(c[0] for c in CATEGORIES)
ENTITY = "struct<start:bigint,end:bigint,text:string,category:string,pseudonym:string,enabled:boolean>"
TOKEN = "(?:" + "|".join(sorted(NAMES, key=len, reverse=True)) + ")_[0-9]{3,}"


def normal(text: Column) -> Column:
    return F.lower(trim(F.regexp_replace(text, f"[{SPACE}]+", " ")))


def label(category: Column, number: Column) -> Column:
    return F.format_string("%s_%03d", category, number)


def key(category: Column, text: Column) -> Column:
    return F.concat(category, F.lit("::"), normal(text))


def number_rows(spans: Column) -> Column:
    """Entities of one text: resolved spans, in order, with their pseudonyms; professionals are off."""
    keyed = F.transform(spans, lambda x: F.struct(x.alias("s"), x["category"].alias("c"), key(x["category"], x["text"]).alias("k")))
    forms = lambda rows: F.array_distinct(F.transform(rows, lambda x: F.struct(x["c"], x["k"])))
    by_category = lambda rows: F.map_from_entries(
        let(forms(rows), lambda f: F.transform(F.array_distinct(F.transform(f, lambda x: x["c"])), lambda c: F.struct(c, F.transform(F.filter(f, lambda x: x["c"] == c), lambda x: x["k"]))))
    )

    def named(rows: Column, keys: Column) -> Column:
        pseudonym = lambda x: label(x["c"], F.array_position(keys[x["c"]], x["k"]))
        return F.transform(
            rows,
            lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["text"].alias("text"), x["c"].alias("category"), pseudonym(x).alias("pseudonym"), (~one_of(x["c"], PROFESSIONALS)).alias("enabled")),
        )

    return let(keyed, lambda rows: let(by_category(rows), lambda keys: named(rows, keys))).cast(f"array<{ENTITY}>")


def mapping_rows(entities: DataFrame, corpus: list[str], col: str = "entities") -> DataFrame:
    """(corpus, pseudonym, category, norm_text, original): the first spelling of each distinct entity."""
    return rows(entities, corpus, col).groupBy(*corpus, "category", "pseudonym", normal(F.col("text")).alias("norm_text")).agg(F.min_by("text", "start").alias("original"))


def number_corpus(spans: DataFrame, corpus: list[str], known: DataFrame | None = None) -> DataFrame:
    """Mapping of a corpus whose resolved spans are rows (corpus..., start, text, category).

    known: a mapping to go on from (corpus..., category, norm_text, pseudonym); its numbers stay, new forms follow
    the largest number of their category.
    """
    forms = spans.groupBy(*corpus, "category", normal(F.col("text")).alias("norm_text")).agg(F.min("start").alias("first"), F.min_by("text", "start").alias("original"))
    if known is None:
        order = Window.partitionBy(*corpus, "category").orderBy("first", "norm_text")
        return forms.withColumn("pseudonym", label(F.col("category"), F.row_number().over(order))).drop("first")
    # spans and mapping are read once: known forms are rows beside the others, ranked first, so that the largest number comes before what follows it
    at, none = [*corpus, "category", "norm_text"], F.lit(None)
    numbers = known.filter(F.col("category").isin(*NAMES)).withColumn("n", F.regexp_extract("pseudonym", r"^[A-Z_]+_([0-9]+)$", 1).try_cast("int")).filter("n is not null")
    here = forms.select(*at, "first", "original", F.lit(True).alias("here"), none.cast("string").alias("pseudonym"), none.cast("int").alias("n"))
    there = numbers.select(*at, none.cast(forms.schema["first"].dataType).alias("first"), none.cast("string").alias("original"), F.lit(False).alias("here"), F.col("pseudonym").cast("string"), "n")
    met = here.unionByName(there).groupBy(*at).agg(F.max("first").alias("first"), F.max("original").alias("original"), F.max("here").alias("here"), F.collect_list("pseudonym").alias("old"), F.max("n").alias("n"))
    so_far = Window.partitionBy(*corpus, "category").orderBy("fresh", "first", "norm_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = met.withColumn("fresh", F.size("old") == 0).withColumn("number", F.count_if("fresh").over(so_far) + F.coalesce(F.max("n").over(so_far), F.lit(0)))
    made = F.when(F.col("fresh"), F.array(label(F.col("category"), F.col("number")))).otherwise(F.col("old"))
    keys = [F.col(f"`{c}`").cast(forms.schema[c].dataType).alias(c) for c in at]
    return ranked.filter("here").select(*keys, "original", F.explode(made).alias("pseudonym"))


def parse_mapping(entries: Column) -> Column:
    """array<struct<pseudonym, category, number, original>> of a pseudonym-to-original JSON object; unknown categories go."""
    rows = F.transform(
        F.map_entries(F.from_json(entries, "map<string,string>")),
        lambda e: F.struct(
            e["key"].alias("pseudonym"), F.regexp_extract(e["key"], r"^([A-Z_]+)_([0-9]+)$", 1).alias("category"),
            F.regexp_extract(e["key"], r"^([A-Z_]+)_([0-9]+)$", 2).try_cast("int").alias("number"), e["value"].alias("original"),
        ),
    )
    return F.filter(rows, lambda r: one_of(r["category"], NAMES))


def mapping_json(entities: Column) -> Column:
    """Pseudonym-to-original object in order of first appearance."""
    first = lambda names: F.filter(entities, lambda e, i: F.array_position(names, e["pseudonym"]) == i + 1)
    pairs = let(F.transform(entities, lambda x: x["pseudonym"]), lambda names: F.transform(first(names), lambda e: F.struct(e["pseudonym"], e["text"])))
    return F.to_json(F.map_from_entries(pairs))


def rewrite(text: Column, entities: Column) -> Column:
    """The text with enabled entities replaced, from the left; one that begins inside another is passed over."""
    on = F.sort_array(F.filter(entities, lambda e: e["enabled"]))
    last = F.struct(F.length(text).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"), F.lit("").alias("pseudonym"))
    ends = lambda kept: F.concat(F.transform(kept, lambda e: F.struct(e["start"], e["end"], e["pseudonym"])), F.array(last))
    gaps = lambda kept: F.transform(kept, lambda e, i: F.struct(F.coalesce(F.get(kept, i - 1)["end"], F.lit(0).cast("bigint")).alias("a"), e["start"].alias("b"), e["pseudonym"].alias("p")))
    done = F.array_join(pieces(text, let(ends(sweep(on)), gaps), lambda cut, g: F.concat(cut(g["a"], g["b"]), g["p"])), "")
    return F.when(F.size(on) > 0, done).otherwise(text)


def reidentify(text: Column, entries: Column) -> Column:
    """Pseudonym tokens replaced by their originals; entries: map<string,string>.  Unknown tokens stay.

    Digits of the text may follow a token; the longest start of it that the mapping knows is the token.
    """
    gaps = F.split(text, F.lit(TOKEN), -1)
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    known = lambda t, k: F.concat(F.try_element_at(entries, F.substr(t, F.lit(1), F.length(t) - k)), F.substr(t, F.length(t) - k + 1))
    back = F.transform(found, lambda t: F.coalesce(*[known(t, k) for k in range(9)], t))
    return F.when(text.rlike(TOKEN), F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(back)), back, lambda a, b: F.concat(a, b)), ""), F.element_at(gaps, -1))).otherwise(text)
