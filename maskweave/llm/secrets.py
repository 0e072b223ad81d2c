"""Multipart credential linking, with DataFrame operations only.

Strong parts are reported wherever they stand: assigned secrets, access identifiers and long hex runs.  Weak
parts (a bare 40-character token, a named identifier, an endpoint) are reported only together: parts are rows
keyed by a digest of their text and a cell of `reach` characters, and a weak part stays if an interval
semi-join finds its complement within `reach` characters: an identifier for a secret, a secret for an
identifier, both for an endpoint.  Cells bound what one part can meet, and semi-joins emit no pairs.  Spans
depend on the text alone, so equal texts are linked once.

Cases: null or empty text has no spans; repeated rows keep their own row; null ids are carried; an empty table
gives no rows; clashing columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import cut, drop_clashing, numbered, restored, table

#: Base kinds in the order that breaks ties of start: pattern, group whose length counts, least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Weak kinds: pattern and role.
WEAK = {
    "bare": (r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])", "secret"),
    "named": (r"""(?i)(?:access_?key_?id|client_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""", "identifier"),
    "endpoint": (r"(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|redis|amqp|mongodb)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", "endpoint"),
}
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret"} | {k: r for k, (_, r) in WEAK.items()}
ORDER = [*BASE, *WEAK]
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _starts(gaps: Column, found: Column) -> Column:
    """Starts of matches from the lengths of the gaps before them and of the matches."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["g"])).alias("out"))
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).cast("bigint").alias("g"), F.length(m).cast("bigint").alias("m")))
    return F.aggregate(lengths, zero, step, lambda acc: acc["out"])


def spans(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind that are long enough, as sorted spans in code points."""
    pattern, group, least = BASE[kind] if kind in BASE else (WEAK[kind][0], 0, 0)
    rx, rank = F.lit(pattern), ORDER.index(kind)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, rx, F.lit(group)), F.length) if group else F.transform(found, F.length)
    rows = F.zip_with(
        F.zip_with(_starts(F.split(text, rx, -1), found), found, lambda s, m: F.struct(s.alias("s"), F.length(m).cast("bigint").alias("n"))),
        sized,
        lambda x, n: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), (x["s"] + x["n"]).alias("end"), F.lit(kind).alias("kind"), n.alias("size")),
    )
    kept = F.transform(F.filter(rows, lambda x: x["size"] >= least), lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"]))
    quick = F.contains(text, F.lit("AKIA")) if kind == "access" else text.rlike(pattern)
    return F.when(quick, kept.cast(SPAN)).otherwise(F.array().cast(SPAN))


def joined(spans_: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans_), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _near(parts: DataFrame, others: DataFrame, reach: int) -> DataFrame:
    """Parts with another one that starts within reach characters; an interval semi-join over neighbouring cells."""
    spread = others.select(F.col("key").alias("k2"), F.col("start").alias("s2"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("c2"))
    return parts.join(spread, (F.col("key") == F.col("k2")) & (F.col("cell") == F.col("c2")) & (F.abs(F.col("start") - F.col("s2")) <= reach), "left_semi")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with its base spans, its weak candidates outside those, and the text's digest where there are any."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    made = docs.withColumns({"__base": F.sort_array(F.concat(*[spans(text, k) for k in BASE])), "__weak": F.concat(*[spans(text, k) for k in WEAK])})
    clear = F.filter("__weak", lambda w: ~F.exists("__base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    made = made.withColumn("__weak", F.when(F.size("__weak") > 0, clear).otherwise(F.col("__weak")))
    return made.withColumn("__key", F.when(F.size("__weak") > 0, F.sha2(text, 256)))


def link(scanned: DataFrame, reach: int) -> DataFrame:
    """(key, linked): the weak spans of each text that have their complement near."""
    texts = scanned.filter("__key is not null").select(F.col("__key").alias("key"), F.concat("__base", "__weak").alias("parts")).dropDuplicates(["key"])
    parts = texts.select("key", F.inline("parts")).withColumn("cell", F.floor(F.col("start") / reach))
    parts = cut(parts.withColumn("role", F.create_map(*[F.lit(x) for p in ROLES.items() for x in p])[F.col("kind")]))
    weak, of = parts.filter(F.col("kind").isin(*WEAK)), lambda role: parts.filter(F.col("role") == role)
    kept = _near(weak.filter("role = 'secret'"), of("identifier"), reach)
    kept = kept.unionByName(_near(weak.filter("role = 'identifier'"), of("secret"), reach))
    kept = kept.unionByName(_near(_near(weak.filter("role = 'endpoint'"), of("identifier"), reach), of("secret"), reach))
    return cut(kept.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("linked")))


def linked_rows(scanned: DataFrame, reach: int) -> DataFrame:
    """Scanned rows with `__linked`; only rows with weak candidates meet the links."""
    none = F.array().cast(SPAN)
    some = scanned.filter("__key is not null").join(link(scanned, reach), F.col("__key") == F.col("key"), "left").drop("key")
    some = some.withColumn("__linked", F.coalesce(F.col("linked").cast(SPAN), none)).drop("linked")
    return scanned.filter("__key is null").withColumn("__linked", none).unionByName(some)


def find_secrets(docs: DataFrame, text_col: str = "text", reach: int = 400, keep: list[str] | None = None) -> DataFrame:
    """Kept columns (by default all but the text) with base_spans, linked_spans and secret_spans (both), sorted."""
    names = ["base_spans", "linked_spans", "secret_spans"]
    keep = [c for c in drop_clashing(docs, names).columns if c != text_col] if keep is None else keep
    scanned = cut(scan(numbered(docs), f"c{docs.columns.index(text_col)}").select(*[f"c{docs.columns.index(c)}" for c in keep], "__base", "__weak", "__key"))
    out = linked_rows(scanned, reach)
    made = [F.col("__base").alias("base_spans"), F.col("__linked").alias("linked_spans"), F.sort_array(F.concat("__base", "__linked")).alias("secret_spans")]
    return out.select(*[F.col(f"c{docs.columns.index(c)}").alias(c) for c in keep], *made)


def replaced(text: Column, spans_: Column, marker: str) -> Column:
    """The text with a marker in place of each run of overlapping spans, which are sorted.

    Pieces are cut from an encoding of equal width, so each costs its own length wherever it lies.
    """
    gap = "struct<at:bigint,out:array<struct<a:bigint,b:bigint>>>"
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("out")).cast(gap)

    def step(acc: Column, x: Column) -> Column:
        before = F.array(F.struct(acc["at"].alias("a"), x["start"].alias("b")))
        out = F.when((x["start"] >= acc["at"]) & ((x["start"] > acc["at"]) | (x["start"] == 0)), F.concat(acc["out"], before)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out")).cast(gap)

    end = F.length(text).cast("bigint")
    gaps = F.aggregate(spans_, zero, step, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), end.alias("b")))))
    wide = F.encode(text, "UTF-32")
    piece = lambda w: F.transform(gaps, lambda g: F.decode(F.substr(w, (g["a"] * 4 + 1).cast("int"), ((g["b"] - g["a"]) * 4).cast("int")), "UTF-32"))
    # a one-element transform evaluates its argument once
    return F.array_join(F.get(F.transform(F.array(wide), piece), F.lit(0)), marker)


def mask(docs: DataFrame, text_col: str = "text", reach: int = 400, marker: str = "[SECRET]") -> DataFrame:
    """docs with every secret span of the text replaced by the marker; all columns and rows stay, in any number of copies.

    The scanned rows are stored once with their texts; only those with weak candidates are shuffled.
    """
    name = f"c{docs.columns.index(text_col)}"
    rows = linked_rows(table(scan(numbered(docs), name)), reach)
    found = F.sort_array(F.concat("__base", "__linked"))
    masked = F.when(F.size("__base") + F.size("__linked") > 0, replaced(F.col(name).cast("string"), found, marker)).otherwise(F.col(name))
    return restored(rows.withColumn(name, masked), docs)
