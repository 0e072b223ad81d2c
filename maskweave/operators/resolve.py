"""Interval sweep: of overlapping spans the one that starts first stays; at one start, by priority, length, order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskweave.operators.patterns import PRIORITY
from maskweave.operators.spans import sweep


def priority(category: Column) -> Column:
    return F.coalesce(F.try_element_at(F.expr("map(" + ", ".join(f"'{c}', {p}" for c, p in PRIORITY.items()) + ")"), category), F.lit(0))


def resolve(spans: Column) -> Column:
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-priority(x["category"])).alias("k2"), (x["start"] - x["end"]).alias("k3"), x["seq"].alias("k4"), x["end"].alias("end"), x.alias("s")))
    return F.transform(sweep(F.sort_array(keyed)), lambda x: x["s"])
