"""Quality rules: text statistics as Spark expressions, and a decision list learnt from labelled statistics.

Sequential covering: a rule is a conjunction of thresholds, grown by information gain on one part of the
labelled rows and pruned on the other; accepted rules become an ordered conditional expression.  Every step of
growth is one aggregation of counts by (statistic, bin), of bounded size, so labelled rows never leave the
executors.  Learning uses about `max_labelled` labelled rows at most, chosen by hash; their statistics alone are
stored.  The rules then judge every row by its whole text in one narrow pass.

Cases: null or empty text has no words (ratios are 0); unlabelled rows, null labels and null ids are not learnt
from; several labels of one id count once, the smallest; rows that repeat an id are judged each by its own text; with no labels the list is empty; an empty table
gives no rows; clashing columns are replaced.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import cut, drop_clashing, numbered, restored

SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks"]
#: Statistics that rules may test.
RATIOS = ["r_symbols", "r_dup_lines", "r_repeat", "r_distinct", "r_word_length", "r_upper", "r_marks", "n_words"]
WINDOW = 5


def repeated_words(hashes: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more; hashes: 64-bit word hashes in order."""
    count = F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))
    return F.transform(F.slice(hashes, 1, count), lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, WINDOW)]))


def covered(windows: Column) -> Column:
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    # a one-element transform evaluates its argument once
    at = F.transform(F.array(F.get(F.transform(F.array(ordered), places), F.lit(0))), lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b))
    return F.get(at, F.lit(0))


def statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns with COUNTS and RATIOS of the whole text."""
    keep = drop_clashing(docs, [*COUNTS, *RATIOS]).columns if keep is None else keep
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    here = [F.col(f"`{c}`") for c in keep]
    step = docs.select(*here, text.alias("__t"), F.filter(F.split(text, F.lit(SPACE), -1), lambda x: x != "").alias("__w"), F.split(text, F.lit("\n"), -1).alias("__l"))
    step = step.select(
        *here,
        F.size("__w").cast("bigint").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[A-Z]+", ""))).cast("bigint").alias("n_upper"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[!?]+", ""))).cast("bigint").alias("n_marks"),
        F.filter("__l", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
        F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"),
    )
    step = step.select(
        *here, "n_words", "word_chars", "n_symbols", "n_upper", "n_marks",
        F.size("__l").cast("bigint").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct("__h")).cast("bigint").alias("n_distinct"), repeated_words(F.col("__h")).alias("__g"),
    )
    step = step.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), covered(F.col("__g"))).otherwise(F.lit(0).cast("bigint"))).drop("__g")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    ratios = {
        "r_symbols": per("n_symbols", "n_words"), "r_dup_lines": per("n_dup_lines", "n_lines"), "r_repeat": per("n_repeat_words", "n_words"), "r_distinct": per("n_distinct", "n_words"),
        "r_word_length": per("word_chars", "n_words"), "r_upper": per("n_upper", "word_chars"), "r_marks": per("n_marks", "n_words"),
    }
    return step.withColumns(ratios).select(*here, *COUNTS, *[r for r in RATIOS if r not in COUNTS])


def _holds(conditions: list[tuple[int, bool, int]]) -> Column:
    """Over bins: (statistic, above, cut): bin > cut, or bin <= cut."""
    out = F.lit(True)
    for f, above, at in conditions:
        out = out & ((F.get("bins", F.lit(f)) > at) if above else (F.get("bins", F.lit(f)) <= at))
    return out


def learn(rows: DataFrame, id_col: str, bad_col: str = "bad", bins: int = 16, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.95, min_rows: int = 5) -> list[list[tuple[str, str, float]]]:
    """Ordered rules, each a list of (statistic, '>' or '<=', threshold); rows hold RATIOS and a 0/1 column."""
    shares = [i / bins for i in range(1, bins)]
    first = rows.agg(*[F.percentile_approx(F.col(r).cast("double"), shares, 10_000).alias(r) for r in RATIOS]).first()
    # quantiles alone miss a rare class, so those of the bad rows are thresholds as well
    also = rows.filter(F.col(bad_col) == 1).agg(*[F.percentile_approx(F.col(r).cast("double"), shares, 10_000).alias(r) for r in RATIOS]).first()
    cuts = [sorted({*(first[r] or []), *(also[r] or [])}) for r in RATIOS]
    binned = rows.select(
        F.col(bad_col).cast("int").alias("bad"),
        (F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(3)) == 0).alias("held"),
        F.array(*[sum(((F.col(r) > c).cast("int") for c in at), F.lit(0)) for r, at in zip(RATIOS, cuts, strict=True)]).alias("bins"),
    )
    left, found = cut(binned), []
    while len(found) < max_rules:
        grow, rule = left.filter(~F.col("held")), []
        total = grow.agg(F.count("*").alias("n"), F.sum("bad").alias("p")).first()
        n, p = total.n, total.p or 0
        while len(rule) < max_conditions and p >= min_rows and p / n < 0.999:
            # at most statistics x bins rows
            counts = grow.filter(_holds(rule)).select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.count("*").alias("n"), F.sum("bad").alias("p")).collect()
            best = (0.0, None)
            for f, at in enumerate(cuts):
                mine = sorted((r.b, r.n, r.p) for r in counts if r.f == f)
                for c in range(len(at)):
                    ln, lp = sum(x[1] for x in mine if x[0] <= c), sum(x[2] for x in mine if x[0] <= c)
                    for above, cn, cp in ((False, ln, lp), (True, n - ln, p - lp)):
                        if cp >= min_rows and cn < n:
                            best = max(best, (cp * (log2(cp / cn) - log2(p / n)), (f, above, c), cn, cp), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
            n, p = best[2:]
        if not rule:
            break
        held = left.filter("held").agg(*[y for k in range(1, len(rule) + 1) for y in (F.count_if(_holds(rule[:k])).alias(f"n{k}"), F.sum(F.when(_holds(rule[:k]), F.col("bad"))).alias(f"p{k}"))]).first()
        worth = [((held[f"p{k}"] or 0) / held[f"n{k}"], held[f"p{k}"] or 0, -k) if held[f"n{k}"] else (0.0, 0, -k) for k in range(1, len(rule) + 1)]
        good = [w for w in worth if w[0] >= min_precision and w[1] >= min_rows]
        if not good:
            break
        rule = rule[: -max(good, key=lambda w: (w[1] * (2 * w[0] - 1), w[2]))[2]]
        found.append([(RATIOS[f], ">" if above else "<=", cuts[f][c]) for f, above, c in rule])
        left = left.filter(~_holds(rule))
    return found


def rejected(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The rules in order as one conditional expression: the number of the first that holds, else null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        holds = F.lit(True)
        for name, op, at in rule:
            holds = holds & ((F.col(name) > at) if op == ">" else (F.col(name) <= at))
        out = F.when(holds, F.lit(k)).otherwise(out)
    return out


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str | None = None, max_labelled: int = 200_000
) -> list[list[tuple[str, str, float]]]:
    """Rules learnt from the statistics of about `max_labelled` labelled rows at most."""
    own = label_id_col or id_col
    marks = labels.filter(F.col(own).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(own).alias("__id")).agg((1 - F.min(label_col)).cast("int").alias("bad"))
    total = marks.count()
    if not total:
        return []
    share = min(1.0, max_labelled / total)
    marks = marks.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    # about max_labelled rows of two numbers
    chosen = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__t")).join(F.broadcast(marks), "__id")
    return learn(cut(statistics(chosen, "__t", ["__id", "bad"])), "__id")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """Kept columns (all by default), statistics, and rule: the first rule that rejects the document, else null."""
    rules = fit(docs, labels, id_col, text_col, **options)
    return statistics(docs, text_col, keep).withColumn("rule", rejected(rules))


def kept(docs: DataFrame, labels: DataFrame, failed: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that a rule rejects or of which `failed`, over the statistics, holds; each row is judged by its own text."""
    plain, names = numbered(docs), docs.columns
    judged = judge(plain, labels, f"c{names.index(id_col)}", f"c{names.index(text_col)}", label_id_col=id_col, **options)
    # a filter does not move below a row number, where it would count everything anew for each mention
    good = judged.withColumn("__row", F.monotonically_increasing_id()).filter(F.col("rule").isNull() & ~failed & (F.col("__row") >= 0))
    return restored(good, docs)
