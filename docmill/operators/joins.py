"""Left outer joins that nest the joined document under an alias; conditions of any operator, all required."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.errors import Validation
from docmill.functions import paths
from docmill.operators import predicates
from docmill.plans.model import Join, Where


def condition(j: Join, left: DataFrame, right_type: T.StructType, compat: bool) -> Column:
    """References read the left side, fields the right one; a reference that is null matches nothing."""
    resolve_left = lambda p: paths.resolve(left.schema, p)
    resolve_right = lambda p: paths.resolve(right_type, p, prefix=f"`{j.alias}`.")
    parts = []
    for w in j.on:
        reference = predicates._reference(w.value) if w.op in ("eq", "neq", "lt", "lte", "gt", "gte") else None
        if reference is None:
            parts.append(predicates.clause(w, resolve_right, resolve_left, compat))
            continue
        a, b = resolve_right(w.field), resolve_left(reference)
        if b is None or a is None:
            raise Validation(f"join: {w.field if a is None else reference} is not a field")
        if w.op == "eq":
            parts.append(predicates.strict_equal(a, b))
        elif w.op in ("lt", "lte", "gt", "gte") and paths.family(a.kind) == paths.family(b.kind) == "time":
            parts.append(predicates._ORDER[w.op](a.col, b.col))
        else:
            parts.append(predicates.clause(Where(w.field, w.op, w.value), resolve_right, resolve_left, compat) & b.col.isNotNull())
    return reduce(operator.and_, parts)


def left_outer(left: DataFrame, right: DataFrame, j: Join, compat: bool = False) -> DataFrame:
    """Every left row with each of its matches as a struct named by the alias, or null. Catalyst picks the join: equality
    clauses become hash or sort-merge keys, and a later filter that needs the alias turns it into an inner join."""
    if j.alias in left.columns:
        raise Validation(f"join: {j.alias} is a field already; give another alias")
    nested = right.select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias(j.alias))
    return left.join(nested, condition(j, left, right.schema, compat), "left_outer")
