"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent ones of a role merged by array
aggregation, and concatenated:  `<|im_start|>role LF text(<|im_sep|>text)* <|im_end|> LF`.  The separator keeps
the rows inside a merged turn apart.  Control strings begin with `<|`; in texts and roles a backslash goes
between `<` and `|` (one more where backslashes stand there already), which is undone exactly.

Cases: null text or role is empty; turns tie-break by role, then text; null turns come first; a null
conversation id is one conversation; repeated rows are repeated turns; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed control strings of the template.
START, SEPARATOR, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """(conv, formatted, segments): segments are struct<text, loss> whose texts join to formatted."""
    clean = lambda c: escape(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.replace(clean(role_col), F.lit("\n"), F.lit(LINE)).alias("role"), clean(text_col).alias("text"))
    grouped = turns.groupBy(F.col(f"`{conv_col}`").alias(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("t"))

    def merged(i: Column, x: Column) -> Column:
        same_before = F.coalesce(F.get("t", i - 1)["role"] == x["role"], F.lit(False))
        same_after = F.coalesce(F.get("t", i + 1)["role"] == x["role"], F.lit(False))
        opening = F.when(same_before, F.lit(SEPARATOR)).otherwise(F.concat(F.lit(START), x["role"], F.lit("\n")))
        closing = F.when(same_after, F.lit("")).otherwise(F.lit(END + "\n"))
        return F.array(
            F.struct(opening.alias("text"), F.lit(False).alias("loss")),
            F.struct(x["text"].alias("text"), (x["role"] == trained_role).alias("loss")),
            F.struct(closing.alias("text"), F.lit(False).alias("loss")),
        )

    made = grouped.select(conv_col, F.flatten(F.transform("t", lambda x, i: merged(i, x))).alias("segments"))
    made = made.withColumn("segments", F.filter("segments", lambda s: (s["text"] != "") | s["loss"]))
    return made.select(conv_col, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_chat(formatted: Column) -> Column:
    """The rows of a formatted conversation, array<struct<role, text>>, from the string alone."""
    turns = F.filter(F.split(formatted, F.lit(r"<\|im_start\|>"), -1), lambda x: x != "")
    role = lambda t: F.substring_index(t, "\n", 1)
    body = lambda t: F.substr(t, F.length(role(t)) + 2, F.length(t) - F.length(role(t)) - 2 - len(END))
    plain = lambda r: F.replace(unescape(r), F.lit(LINE), F.lit("\n"))
    return F.flatten(
        F.transform(turns, lambda t: F.transform(F.split(body(t), F.lit(r"<\|im_sep\|>"), -1), lambda x: F.struct(plain(role(t)).alias("role"), unescape(x).alias("text"))))
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
