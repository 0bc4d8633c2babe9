"""From a query to one declarative DataFrame: scan, computed fields, joins, filter, then group or sort, page and project.

Nothing runs here. Filters on numeric and text columns reach the Parquet scan, columns that no part names are pruned,
sort with limit becomes a top-k, and joins are chosen by Catalyst and adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import paths
from docmill.operators import aggregates, joins, predicates
from docmill.plans.model import Query


def compile_query(q: Query, base: DataFrame, collection: Callable[[str], DataFrame] | None = None, primary_key: str | None = None, compat: bool = False) -> DataFrame:
    """collection gives the frame of a joined collection by name; primary_key breaks ties of the order."""
    q.check(strict=compat)
    df = filtered(base, q.join, q.where, collection, compat)
    if q.is_aggregate:
        out = aggregates.group(df, q, compat)
        kept = predicates.conjunction(q.having, lambda p: paths.resolve(out.schema, p), compat=compat)
        out = out if kept is None else out.where(kept)
        return paged(ordered(out, q, None, {}), q)
    aliases = {s.alias: s.field for s in q.select}
    return project(paged(ordered(df, q, primary_key, aliases), q), q)


def filtered(base: DataFrame, join, where, collection=None, compat: bool = False) -> DataFrame:
    df = base
    for j in join:
        df = joins.left_outer(df, collection(j.collection), j, compat)
    kept = predicates.conjunction(where, lambda p: paths.resolve(df.schema, p), compat=compat)
    return df if kept is None else df.where(kept)


def _sort_keys(df: DataFrame, field: str, descending: bool, aliases: dict[str, str]) -> list[Column]:
    at = paths.resolve(df.schema, field) or (paths.resolve(df.schema, aliases[field]) if field in aliases else None)
    if at is None:
        return []  # an unknown field sorts all rows alike
    kind = paths.family(at.kind)
    if kind == "variant":  # by kind of value, then number, then text
        number = F.try_variant_get(at.col, "$", "double")
        parts = [F.when(number.isNotNull(), 1).otherwise(2), number, paths.raw_text(at)]
        parts[0] = F.when(paths.raw_text(at).isNull(), F.lit(None)).otherwise(parts[0])
    else:
        parts = [F.to_json(at.col) if kind in ("object", "list") else at.col]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in parts]


def ordered(df: DataFrame, q: Query, primary_key: str | None, aliases: dict[str, str]) -> DataFrame:
    keys = [k for o in q.order_by for k in _sort_keys(df, o.field, o.direction == "desc", aliases)]
    if not q.order_by and not q.limit:
        return df
    if primary_key and primary_key not in [o.field for o in q.order_by]:
        keys += _sort_keys(df, primary_key, False, {}) if q.order_by or q.page else []
    return df.orderBy(*keys) if keys else df


def paged(df: DataFrame, q: Query) -> DataFrame:
    if not q.limit:
        return df
    return (df.offset(q.page * q.limit) if q.page else df).limit(q.limit)


def project(df: DataFrame, q: Query) -> DataFrame:
    if q.select[0].field == "*":
        return df
    out = []
    for s in q.select:
        at = paths.resolve(df.schema, s.field)
        value = F.lit(None).cast(T.StringType()) if at is None else paths.raw_text(at) if paths.family(at.kind) == "variant" else at.col
        out.append(value.alias(s.alias))
    return df.select(*out)


def nested(df: DataFrame) -> DataFrame:
    """Flat columns with dots in their names as nested structs, for JSON output."""

    def build(parts: dict) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in parts.items()]

    tree: dict = {}
    for c in df.columns:
        at = tree
        *path, last = c.split(".")
        for p in path:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                return df
        at[last] = F.col(f"`{c}`")
    return df.select(*build(tree))
