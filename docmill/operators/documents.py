"""Single documents on the driver, and row-wise document operations of whole frames."""

from __future__ import annotations

import copy
import json
import re
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.catalog import FieldOp, diff, flat
from docmill.errors import Validation
from docmill.functions import paths
from docmill.functions.builtins import TRUE_TEXTS
from docmill.plans.model import Field, Where

_MISSING = object()


class Document:
    """A JSON object with dotted paths."""

    def __init__(self, value: Any = None):
        if isinstance(value, (str, bytes)):
            try:
                value = json.loads(value)
            except ValueError as e:
                raise Validation(f"invalid json: {e}") from e
        value = {} if value is None else value.value if isinstance(value, Document) else value
        if not isinstance(value, dict):
            raise Validation("a document must be an object")
        self.value: dict = copy.deepcopy(value)

    def _find(self, path: str) -> Any:
        at: Any = self.value
        for part in path.split("."):
            if isinstance(at, dict) and part in at:
                at = at[part]
            elif isinstance(at, list) and part == "#":
                at = len(at)
            elif isinstance(at, list) and part.isdigit() and int(part) < len(at):
                at = at[int(part)]
            else:
                return _MISSING
        return at

    def get(self, path: str) -> Any:
        found = self._find(path)
        return None if found is _MISSING else copy.deepcopy(found)

    def exists(self, path: str) -> bool:
        """A null counts as present."""
        return self._find(path) is not _MISSING

    def get_string(self, path: str) -> str:
        v = self.get(path)
        return "" if v is None else v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else json.dumps(v)

    def get_bool(self, path: str) -> bool:
        v = self.get(path)
        return v if isinstance(v, bool) else v != 0 if isinstance(v, (int, float)) else str(v) in TRUE_TEXTS

    def get_float(self, path: str) -> float:
        v = self.get(path)
        try:
            return float(v)
        except (TypeError, ValueError):
            return 0.0

    def get_int(self, path: str) -> int:
        return int(self.get_float(path))

    def get_time(self, path: str) -> datetime | None:
        try:
            return datetime.fromisoformat(self.get_string(path).replace("Z", "+00:00"))
        except ValueError:
            return None

    def get_array(self, path: str) -> list:
        v = self.get(path)
        return v if isinstance(v, list) else [] if v is None else [v]

    def set(self, path: str, value: Any) -> Document:
        at = self.value
        *parents, last = path.split(".")
        for p in parents:
            if isinstance(at, list):
                at = at[int(p)]
                continue
            if not isinstance(at.get(p), (dict, list)):
                at[p] = {}
            at = at[p]
        if isinstance(at, list):
            at[int(last)] = copy.deepcopy(value)
        else:
            at[last] = copy.deepcopy(value)
        return self

    def set_all(self, values: dict[str, Any]) -> Document:
        for k, v in values.items():
            self.set(k, v)
        return self

    def overwrite(self, values: dict[str, Any]) -> Document:
        self.value = {}
        return self.set_all(values)

    def merge(self, other: Document | dict) -> Document:
        """The other's leaves win."""
        return self.set_all(flat(Document(other).value))

    def merge_join(self, other: Document | dict, alias: str) -> Document:
        if not alias:
            raise Validation("join: an alias is required")
        return self.set_all({f"{alias}.{k}": v for k, v in flat(Document(other).value).items()})

    def delete(self, *names: str) -> Document:
        for path in names:
            *parents, last = path.split(".")
            at: Any = self.value
            for p in parents:
                at = at.get(p) if isinstance(at, dict) else None
            if isinstance(at, dict):
                at.pop(last, None)
        return self

    def diff(self, before: Document | dict | None) -> list[FieldOp]:
        return list(diff(self.value, Document(before).value))

    def apply_ops(self, ops: list[FieldOp]) -> Document:
        for o in ops:
            self.delete(o.path) if o.op == "remove" else self.set(o.path, o.value)
        return self

    def revert_ops(self, ops: list[FieldOp]) -> Document:
        """Undo the ops: added fields go, others get their old values back."""
        for o in reversed(ops):
            self.delete(o.path) if o.op == "add" else self.set(o.path, o.before_value)
        return self

    def clone(self) -> Document:
        return Document(self.value)

    def field_paths(self) -> list[str]:
        return [p for p, v in flat(self.value).items() if v != {}]

    def scan(self, into: type) -> Any:
        return into(**{k: v for k, v in self.value.items() if k in getattr(into, "__dataclass_fields__", self.value)})

    def to_json(self) -> str:
        return json.dumps(self.value, separators=(",", ":"), ensure_ascii=False)

    def where(self, wheres: list[Where]) -> bool:
        return all(self._holds(w) for w in wheres)

    def _number(self, v: Any) -> float:
        try:
            return float(v)
        except (TypeError, ValueError):
            return 0.0

    def _holds(self, w: Where) -> bool:
        """The row-wise meaning of a clause, as docmill.operators.predicates has it for columns."""
        have, want, op = self.get(w.field), w.value, w.op
        if op in ("eq", "neq", "lt", "lte", "gt", "gte") and (isinstance(want, Field) or isinstance(want, str) and want.startswith("$")):
            want = self.get(want.path if isinstance(want, Field) else want[1:])
            if op in ("eq", "neq"):
                return _typed(have) == _typed(want) if op == "eq" else _typed(have) != _typed(want)
        if op in ("eq", "neq"):
            want = None if want == "null" else want
            return (_typed(have) == _typed(want)) == (op == "eq")
        if op in ("lt", "lte", "gt", "gte"):
            a, b = self._number(have), self._number(want)
            return {"lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b}[op]
        if op == "in":
            return any(_typed(have) == _typed(v) for v in want)
        if op == "contains":
            return want in have if isinstance(have, str) else any(_typed(x) == _typed(want) for x in have) if isinstance(have, list) else False
        if op in ("containsAll", "containsAny"):
            words = have.split() if isinstance(have, str) else [x if isinstance(x, str) else json.dumps(x) for x in have] if isinstance(have, list) else []
            return (all if op == "containsAll" else any)(str(v) in words for v in want)
        text = self.get_string(w.field)
        if op == "hasPrefix":
            return text.startswith(str(want))
        if op == "hasSuffix":
            return text.endswith(str(want))
        if op == "regex":
            try:
                return re.search(str(want), text) is not None
            except re.error:
                return False
        raise Validation(f"where: unknown operator {op!r}")


def _typed(v: Any) -> tuple:
    """Values compare equal only within a type; numbers are one type."""
    kind = "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else type(v).__name__
    return kind, float(v) if kind == "number" else v


def as_json(value: Column) -> Column:
    """A value inside a one-field JSON object, so that every type has a text form; null for null."""
    return F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v"))))


def from_json_value(text: Column, kind: T.DataType) -> Column:
    return F.from_json(text, T.StructType([T.StructField("v", kind)])).getField("v")


def diff_columns(schema: T.StructType, before: str, after: str) -> Column:
    """The leaf operations between two struct columns as an array; a missing document has no leaves."""
    ops = []
    for p in paths.leaf_paths(schema):
        a, b = (paths.resolve(schema, p, prefix=f"{x}.") for x in (after, before))
        old, new = as_json(b.col), as_json(a.col)
        op = F.when(old.isNull(), F.lit("add")).when(new.isNull(), F.lit("remove")).otherwise(F.lit("replace"))
        ops.append(F.when(~old.eqNullSafe(new), F.struct(op.alias("op"), F.lit(p).alias("path"), new.alias("value"), old.alias("beforeValue"))))
    return F.array_compact(F.array(*ops))


def rebuild(schema: T.StructType, leaf: dict[str, Column], prefix: str = "") -> list[Column]:
    """Columns of a schema from one column per leaf path; a struct of nulls only is null."""
    out = []
    for f in schema.fields:
        p = prefix + f.name
        if isinstance(f.dataType, T.StructType):
            inner = rebuild(f.dataType, leaf, p + ".")
            any_leaf = F.greatest(*[F.lit(0), *[leaf[q].isNotNull().cast("int") for q in paths.leaf_paths(f.dataType, p + ".")]])
            out.append(F.when(any_leaf > 0, F.struct(*inner)).alias(f.name))
        else:
            out.append(leaf[p].alias(f.name))
    return out


def merged(schema: T.StructType, base: str, patch: str) -> list[Column]:
    """Leaf-wise merge of two struct columns: the patch's value where it has one."""
    leaf = {}
    for p in paths.leaf_paths(schema):
        leaf[p] = F.coalesce(paths.resolve(schema, p, prefix=f"{patch}.").col, paths.resolve(schema, p, prefix=f"{base}.").col)
    return rebuild(schema, leaf)


def state_at(current: DataFrame, log: DataFrame, key: str, timestamp: int) -> DataFrame:
    """All documents as they were just before the timestamp: of every leaf, the value before its first later change.

    log: change records of this collection. One aggregation over the changes since then and one join with the current documents."""
    schema = current.schema
    later = log.where(F.col("timestamp") >= timestamp)
    first = later.groupBy("documentID").agg(F.min_by(F.struct(F.col("action"), F.size(F.filter("diff", lambda d: d["beforeValue"].isNotNull())).alias("had")), "timestamp").alias("_first"))
    ops = later.select("documentID", "timestamp", F.explode("diff").alias("o")).select("documentID", "timestamp", F.col("o.path").alias("path"), F.col("o.beforeValue").alias("old"))
    oldest = ops.groupBy("documentID", "path").agg(F.min_by(F.struct("old"), "timestamp").alias("old"))
    undo = oldest.groupBy("documentID").agg(F.map_from_entries(F.collect_list(F.struct("path", F.col("old.old")))).alias("_undo"))
    undo = first.join(undo, "documentID", "left")
    joined = current.withColumn("_now", F.lit(True)).join(undo, F.col(key).cast("string") == F.col("documentID"), "full_outer")
    leaf = {}
    for p in paths.leaf_paths(schema):
        at = paths.resolve(schema, p)
        leaf[p] = F.when(F.coalesce(F.map_contains_key("_undo", p), F.lit(False)), from_json_value(F.try_element_at("_undo", F.lit(p)), at.kind)).otherwise(at.col)
    # a document whose first later change is its creation, or that had nothing before, was not there
    there = F.col("_first").isNull() | ~((F.col("_first.action") == "create") | ((F.col("_first.action") == "set") & (F.col("_first.had") == 0)))
    return joined.where(there).select(*rebuild(schema, leaf))


class Documents(list):
    """A list of documents on the driver. For frames: offset and limit, where, select or mapInPandas, foreach."""

    def slice(self, start: int, end: int) -> Documents:
        return Documents(self[max(0, start) : max(0, end)])

    def filter(self, keep) -> Documents:
        return Documents(d for i, d in enumerate(self) if keep(d, i))

    def map(self, change) -> Documents:
        return Documents(change(d, i) for i, d in enumerate(self))

    def for_each(self, do) -> None:
        for i, d in enumerate(self):
            do(d, i)
