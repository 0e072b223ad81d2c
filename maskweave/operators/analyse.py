"""The whole analysis of texts: detect, refine, resolve, number, rewrite; all in one row per text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.operators.patterns import Pattern
from maskweave.operators.pseudonym import mapping_json, number_rows, rewrite
from maskweave.operators.refine import refine
from maskweave.operators.resolve import resolve
from maskweave.operators.spans import detect


def with_spans(df: DataFrame, text: str = "text", only: tuple[str, ...] | None = None, extra: tuple[Pattern, ...] = ()) -> DataFrame:
    return df.withColumn("spans", detect(F.col(text), only, extra=extra))


def analyse(df: DataFrame, text: str = "text", only: tuple[str, ...] | None = None, extra: tuple[Pattern, ...] = ()) -> DataFrame:
    """df with spans (refined), entities (resolved and numbered) and counts of what the passes did."""
    out = with_spans(df, text, only, extra).withColumn("n_found", F.size("spans"))
    for i, (name, step) in enumerate(refine(F.col(text), F.col("spans"))):
        out = out.withColumn(name, step)
        if not i:
            out = out.withColumn("procedural", (F.col("n_found") - F.size("spans")).cast("bigint"))
    out = out.withColumns({"propagated": F.size("spread").cast("bigint"), "variant_count": F.size("variants").cast("bigint")})
    return out.withColumn("entities", number_rows(resolve(F.col("spans")))).drop("companies", "spread", "variants", "n_found")


def pseudonymise(df: DataFrame, text: str = "text", only: tuple[str, ...] | None = None, extra: tuple[Pattern, ...] = ()) -> DataFrame:
    """df with entities, text_anon and mapping (JSON)."""
    out = analyse(df, text, only, extra)
    return out.withColumns({"text_anon": rewrite(F.col(text), F.col("entities")), "mapping": mapping_json(F.col("entities"))})
