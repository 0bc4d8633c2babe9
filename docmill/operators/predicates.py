"""Where clauses as Columns.

Comparison by eq, neq and in is strict about types: a number never equals text. lt, lte, gt and gte compare numbers, where
null, missing and non-numeric values count as 0; over numeric columns the clause is written so that Spark pushes it to the Parquet scan. Time columns
compare natively. The clauses of a list are all required.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.errors import Validation
from docmill.functions import paths
from docmill.functions.paths import Resolved
from docmill.plans.model import Field, Where

Resolver = Callable[[str], Resolved | None]
_ORDER = {"lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}
_VARIANT_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT")


def _literal_family(v: Any) -> str:
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text" if isinstance(v, str) else "other"


def _reference(value: Any) -> str | None:
    if isinstance(value, Field):
        return value.path
    return value[1:] if isinstance(value, str) and value.startswith("$") else None


def equals(at: Resolved | None, value: Any) -> Column:
    """Strictly typed equality with a literal; null where the field is (which a filter takes for false), so that it can be pushed to the scan."""
    if value is None or value == "null":
        if at is None:
            return F.lit(True)
        return F.coalesce(F.is_variant_null(at.col), F.lit(False)) | at.col.isNull() if paths.family(at.kind) == "variant" else at.col.isNull()
    if at is None:
        return F.lit(False)
    kind, wanted = paths.family(at.kind), _literal_family(value)
    if kind == "variant":
        shape = F.coalesce(F.schema_of_variant(at.col), F.lit("VOID"))
        fits = {"number": shape.isin(*_VARIANT_NUMBERS) | shape.startswith("DECIMAL"), "text": shape == "STRING", "bool": shape == "BOOLEAN"}.get(wanted, F.lit(False))
        typed = F.try_variant_get(at.col, "$", {"number": "double", "text": "string", "bool": "boolean"}.get(wanted, "string"))
        return fits & F.coalesce(typed == F.lit(value), F.lit(False))
    if kind == "time" and wanted == "text":
        return at.col == F.lit(value).cast(at.kind)
    if kind == wanted and kind != "other":
        return at.col == F.lit(value)
    if kind in ("list", "object") and isinstance(value, (list, dict)):
        return F.coalesce(F.to_json(at.col) == F.to_json(F.from_json(F.lit(_compact(value)), at.kind)), F.lit(False))
    return F.lit(False)


def _compact(value: Any) -> str:
    import json

    return json.dumps(value, separators=(",", ":"))


def same(a: Resolved | None, b: Resolved | None) -> Column:
    """Equality of two fields; null equals null."""
    if a is None and b is None:
        return F.lit(True)
    if a is None or b is None:
        return (b or a).col.isNull()
    fa, fb = paths.family(a.kind), paths.family(b.kind)
    if fa == fb == "variant":
        return F.to_json(a.col).eqNullSafe(F.to_json(b.col))
    if fa == fb and fa not in ("object", "list"):
        return a.col.eqNullSafe(b.col)
    if "variant" in (fa, fb):
        v, o = (a, b) if fa == "variant" else (b, a)
        return F.try_variant_get(v.col, "$", o.kind.simpleString()).eqNullSafe(o.col)
    if fa == fb:
        return F.to_json(a.col).eqNullSafe(F.to_json(b.col))
    return a.col.isNull() & b.col.isNull()


def _ordered(at: Resolved | None, op: str, value: Any) -> Column:
    compare = _ORDER[op]
    if at is not None and paths.family(at.kind) == "time" and isinstance(value, str):
        return compare(at.col, F.lit(value).cast(at.kind))
    try:
        number = value if isinstance(value, (int, float)) else float(value)
    except (TypeError, ValueError):
        number = 0
    if at is None:
        return F.lit(bool(compare(0, number)))
    if paths.family(at.kind) == "number":
        clause = compare(at.col, F.lit(number))
        return clause | at.col.isNull() if compare(0, number) else clause
    return compare(paths.number(at), F.lit(float(number)))


def _elements(at: Resolved) -> Column:
    """The elements as texts: of an array, or the words of a text."""
    kind = paths.family(at.kind)
    if kind == "list":
        return F.coalesce(F.transform(at.col, lambda x: x.cast("string")), F.array().cast("array<string>"))
    if kind == "variant":
        listed = F.try_variant_get(at.col, "$", "array<string>")
        return F.coalesce(listed, F.filter(F.split(F.try_variant_get(at.col, "$", "string"), r"\s+"), lambda w: w != ""), F.array().cast("array<string>"))
    return F.filter(F.split(paths.text(at), r"\s+"), lambda w: w != "")


def _contains(at: Resolved, value: Any, compat: bool) -> Column:
    kind = paths.family(at.kind)
    if kind == "text":
        return F.coalesce(at.col.contains(str(value)), F.lit(False))
    if kind == "variant":
        return F.coalesce(F.try_variant_get(at.col, "$", "string").contains(str(value)) if isinstance(value, str) else F.array_contains(F.try_variant_get(at.col, "$", "array<string>"), str(value)), F.lit(False))
    if compat:
        whole = F.to_json(at.col) if kind in ("list", "object") else paths.text(at)
        return F.coalesce(F.instr(whole, _compact(value)) > 0, F.lit(False))
    if kind == "list":
        element = at.kind.elementType
        if paths.family(element) != _literal_family(value):
            return F.lit(False)
        return F.coalesce(F.array_contains(at.col, F.lit(value).cast(element)), F.lit(False))
    return F.lit(False)


def clause(w: Where, resolve: Resolver, other: Resolver | None = None, compat: bool = False) -> Column:
    """One clause. other resolves references ("$path"), by default in the same frame."""
    at, op, value = resolve(w.field), w.op, w.value
    reference = _reference(value) if op in ("eq", "neq", *_ORDER) else None
    if reference is not None:
        b = (other or resolve)(reference)
        if op in ("eq", "neq"):
            return same(at, b) if op == "eq" else ~same(at, b)
        whole = all(x is None or isinstance(x.kind, paths.INTEGERS) for x in (at, b))  # longs beyond 2**53 keep their last digits
        left, right = (F.lit(0) if x is None else F.coalesce(x.col.cast("bigint"), F.lit(0)) if whole else paths.number(x) for x in (at, b))
        return _ORDER[op](left, right)
    if op == "eq":
        return equals(at, value)
    if op == "neq":
        plain = at is not None and value not in (None, "null") and _literal_family(value) == paths.family(at.kind)
        return ~at.col.eqNullSafe(F.lit(value)) if plain else ~F.coalesce(equals(at, value), F.lit(False))
    if op in _ORDER:
        return _ordered(at, op, value)
    if op == "in":
        values = list(value)
        plain = [v for v in values if at is not None and _literal_family(v) == paths.family(at.kind) != "other"]
        rest = [equals(at, v) for v in values if v not in plain or v is None]
        parts = ([at.col.isin(plain)] if plain else []) + rest
        return reduce(operator.or_, parts, F.lit(False)) if parts else F.lit(False)
    if op == "contains":
        return F.lit(False) if at is None else _contains(at, value, compat)
    if op in ("containsAll", "containsAny"):
        wanted = F.array(*[F.lit(str(v)) for v in value]).cast("array<string>")
        have = F.array().cast("array<string>") if at is None else _elements(at)
        return F.size(F.array_except(wanted, have)) == 0 if op == "containsAll" else F.arrays_overlap(have, wanted) & (F.size(wanted) > 0)
    text = F.lit("") if at is None else paths.text(at)
    if op == "hasPrefix":
        return text.startswith(str(value))
    if op == "hasSuffix":
        return text.endswith(str(value))
    if op == "regex":
        pattern = _java_pattern(str(value))
        return F.lit(False) if pattern is None else text.rlike(pattern)
    raise Validation(f"where: unknown operator {op!r}")


def _java_pattern(pattern: str) -> str | None:
    """The pattern as Java takes it (groups named by ?P< included), or None if it is none."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext
    from pyspark.errors import PySparkException

    pattern = pattern.replace("(?P<", "(?<")
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return None
    return pattern


def conjunction(wheres, resolve: Resolver, other: Resolver | None = None, compat: bool = False) -> Column | None:
    clauses = [clause(w, resolve, other, compat) for w in wheres]
    return reduce(operator.and_, clauses) if clauses else None


def strict_equal(a: Resolved, b: Resolved) -> Column:
    """Join equality: nulls never match."""
    return a.col == b.col if paths.family(a.kind) == paths.family(b.kind) not in ("variant", "object", "list") else same(a, b) & a.col.isNotNull() & b.col.isNotNull()


__all__ = ["Resolver", "clause", "conjunction", "equals", "same", "strict_equal"]
