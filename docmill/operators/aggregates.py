"""Grouping with count, sum, min and max. Sums, minima and maxima are over numbers; what is none counts as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.errors import Validation
from docmill.functions import paths
from docmill.plans.model import Query, Select


def _column(s: Select, df: DataFrame, compat: bool) -> Column:
    if s.aggregate == "count":
        return F.count(F.lit(1)).cast("double").alias(s.alias)
    at = paths.resolve(df.schema, s.field)
    value = F.lit(0.0) if at is None else paths.number(at)
    if s.aggregate == "sum":
        return F.sum(value).alias(s.alias)
    if s.aggregate == "max":
        return (F.greatest(F.lit(0.0), F.max(value)) if compat else F.max(value)).alias(s.alias)
    if s.aggregate == "min":
        return (F.least(F.lit(0.0), F.min(value)) if compat else F.min(value)).alias(s.alias)
    raise Validation(f"unknown aggregate {s.aggregate!r}")


def group(df: DataFrame, q: Query, compat: bool = False) -> DataFrame:
    """One row per group, named by the selects. Partial sums are combined before the shuffle; no input rows give no
    output row, also without group by. compat: min and max start at 0."""
    keys = []
    for s in q.select:
        if not s.aggregate:
            at = paths.resolve(df.schema, s.field)
            value = F.lit(None).cast("string") if at is None else paths.raw_text(at) if paths.family(at.kind) in ("variant", "object", "list") else at.col
            keys.append(value.alias(s.alias))
    sums = [_column(s, df, compat) for s in q.select if s.aggregate]
    if keys:
        out = df.groupBy(*keys).agg(*sums)
    else:
        out = df.agg(*sums, F.count(F.lit(1)).alias("_rows")).where("_rows > 0").drop("_rows")
    return out.select(*[F.col(f"`{s.alias}`") for s in q.select])
