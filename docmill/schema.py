"""Collection schemas: JSON Schema (YAML or JSON text) with the x- keywords, and what Spark needs of them."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.errors import Validation
from docmill.functions import paths

_SCALARS = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
#: Undeclared fields of a document, as one JSON object.
EXTRA = "_extra"


@dataclass(frozen=True)
class ForeignKey:
    collection: str
    cascade: bool = False


@dataclass(frozen=True)
class Index:
    name: str
    fields: tuple[str, ...]
    unique: bool = False
    primary: bool = False
    foreign_key: ForeignKey | None = None


@dataclass(frozen=True)
class Computed:
    expr: str
    read: bool = False
    write: bool = False


@dataclass(frozen=True)
class Property:
    name: str
    path: str
    type: str
    description: str = ""
    primary: bool = False
    unique: bool = False
    immutable: bool = False
    foreign_key: ForeignKey | None = None
    compute: Computed | None = None
    default: Any = None
    has_default: bool = False
    rules: tuple[tuple[str, Any], ...] = ()
    properties: tuple[Property, ...] = ()
    items: Any = None


@dataclass(frozen=True)
class Trigger:
    name: str
    order: int
    events: tuple[str, ...]
    script: str


@dataclass(frozen=True)
class Rule:
    effect: str
    actions: tuple[str, ...]
    match: str


@dataclass(frozen=True)
class CollectionSchema:
    collection: str
    properties: tuple[Property, ...]
    required: tuple[str, ...]
    primary_key: str
    indexes: dict[str, Index]
    triggers: tuple[Trigger, ...] = ()
    rules: tuple[Rule, ...] = ()
    read_only: bool = False
    require_index: bool = False
    immutable: bool = False
    prevent_deletes: bool = False
    closed: bool = False
    raw: dict = field(default_factory=dict)

    @property
    def primary_index(self) -> Index:
        return next(i for i in self.indexes.values() if i.primary)

    def all_properties(self) -> list[Property]:
        out: list[Property] = []

        def walk(ps):
            for p in ps:
                out.append(p)
                walk(p.properties)

        walk(self.properties)
        return out

    def foreign_keys(self) -> list[tuple[str, ForeignKey]]:
        return [(p.path, p.foreign_key) for p in self.all_properties() if p.foreign_key]

    def unique_fields(self) -> list[str]:
        return [p.path for p in self.all_properties() if p.unique]

    def struct(self) -> T.StructType:
        """Declared fields as typed columns; objects of open shape as JSON text; everything else in _extra."""
        return T.StructType([*(T.StructField(p.name, _spark_type(p), True, {"path": p.path}) for p in self.properties), T.StructField(EXTRA, T.StringType())])

    def errors(self, resolve) -> Column:
        """All rule violations of a row as an array of texts: one projection, no join."""
        found = []
        for p in self.all_properties():
            at = resolve(p.path)
            if at is None:
                continue
            for rule, value in p.rules:
                bad = _violation(at, rule, value)
                if bad is not None:
                    found.append(F.when(at.col.isNotNull() & bad, F.lit(f"{p.path}: {rule} {json.dumps(value)}")))
        for name in self.required:
            at = resolve(name)
            found.append(F.when(F.lit(True) if at is None else at.col.isNull(), F.lit(f"{name} is required")))
        if self.closed:
            at = resolve(EXTRA)
            if at is not None:
                found.append(F.when(F.coalesce(F.length(paths.raw_text(at)) > 2, F.lit(False)), F.lit("additional properties are not allowed")))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    def document_errors(self, doc) -> list[str]:
        """The same rules for one document (docmill.operators.documents.Document) on the driver."""
        found = []
        for p in self.all_properties():
            v = doc.get(p.path)
            found += [f"{p.path}: {rule} {json.dumps(value)}" for rule, value in p.rules if v is not None and _broken(v, rule, value)]
        found += [f"{name} is required" for name in self.required if doc.get(name) is None]
        if self.closed and set(doc.value) - {p.name for p in self.properties}:
            found.append("additional properties are not allowed")
        return found

    def to_yaml(self) -> str:
        return yaml.safe_dump(self.raw, sort_keys=False)


def _spark_type(p: Property) -> T.DataType:
    if p.type in _SCALARS:
        return _SCALARS[p.type]
    if p.type == "object" and p.properties:
        return T.StructType([T.StructField(c.name, _spark_type(c), True, {"path": c.path}) for c in p.properties])
    if p.type == "array" and isinstance(p.items, dict) and p.items.get("type") in _SCALARS:
        return T.ArrayType(_SCALARS[p.items["type"]])
    return T.StringType()


def _violation(at, rule: str, value) -> Column | None:
    c = at.col
    return {
        "enum": lambda: ~c.isin(*value), "const": lambda: c != F.lit(value),
        "minimum": lambda: c < value, "maximum": lambda: c > value,
        "exclusiveMinimum": lambda: c <= value, "exclusiveMaximum": lambda: c >= value, "multipleOf": lambda: c % value != 0,
        "minLength": lambda: F.length(c) < value, "maxLength": lambda: F.length(c) > value, "pattern": lambda: ~c.rlike(value),
        "minItems": lambda: F.size(c) < value, "maxItems": lambda: F.size(c) > value, "uniqueItems": lambda: F.size(F.array_distinct(c)) < F.size(c) if value else F.lit(False),
    }.get(rule, lambda: None)()


def _broken(v: Any, rule: str, value: Any) -> bool:
    try:
        return bool({
            "enum": lambda: v not in value, "const": lambda: v != value, "minimum": lambda: v < value, "maximum": lambda: v > value,
            "exclusiveMinimum": lambda: v <= value, "exclusiveMaximum": lambda: v >= value, "multipleOf": lambda: v % value != 0,
            "minLength": lambda: len(v) < value, "maxLength": lambda: len(v) > value, "pattern": lambda: re.search(value, v) is None,
            "minItems": lambda: len(v) < value, "maxItems": lambda: len(v) > value, "uniqueItems": lambda: value and len({json.dumps(x) for x in v}) < len(v),
        }[rule]())
    except TypeError:  # a value of another type: its type is reported instead
        return False


_RULES = ("enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems")
_OLD_EVENTS = {"on_create": "onCreate", "on_update": "onUpdate", "on_set": "onSet", "on_delete": "onDelete"}


def parse(source: str | dict) -> CollectionSchema:
    """From YAML or JSON text, or the parsed object. Raises Validation."""
    raw = yaml.safe_load(source) if isinstance(source, str) else copy.deepcopy(source)
    if not isinstance(raw, dict):
        raise Validation("schema: an object is required")
    name = raw.get("x-collection")
    if not name:
        raise Validation("schema: x-collection is required")
    common = raw.get("common") or {}
    required = tuple(raw.get("required") or ())
    indexes: dict[str, Index] = {}
    keys: list[str] = []

    def prop(key: str, spec: dict, path: str) -> Property:
        spec = dict(spec or {})
        ref = spec.pop("$ref", None)
        if ref:
            parts = ref.removeprefix("#/").split("/")
            if parts[0] != "common" or len(parts) < 2 or parts[1] not in common:
                raise Validation(f"schema {name}: $ref {ref} is not under #/common")
            spec = {**common[parts[1]], **spec}
        if not spec.get("type"):
            raise Validation(f"schema {name}: type of {path} is required")
        fk = spec.get("x-foreign")
        foreign = ForeignKey(fk["collection"], bool(fk.get("cascade"))) if fk else None
        compute = spec.get("x-compute")
        if isinstance(compute, str):
            compute = {"expr": compute, "read": True}
        if spec.get("x-primary"):
            keys.append(path)
            indexes[f"{path}.primaryidx"] = Index(f"{path}.primaryidx", (path,), True, True)
        if spec.get("x-unique"):
            indexes[f"{path}.uniqueidx"] = Index(f"{path}.uniqueidx", (path,), True)
        if foreign:
            indexes[f"{path}.foreignidx"] = Index(f"{path}.foreignidx", (path,), False, False, foreign)
        for index, more in (spec.get("x-index") or {}).items():
            indexes[index] = Index(index, (path, *((more or {}).get("additional_fields") or ())))
        children = tuple(prop(k, v, f"{path}.{k}") for k, v in (spec.get("properties") or {}).items())
        return Property(
            key, path, spec["type"], spec.get("description", ""), bool(spec.get("x-primary")), bool(spec.get("x-unique")), bool(spec.get("x-immutable")), foreign,
            Computed(compute["expr"], bool(compute.get("read")), bool(compute.get("write"))) if compute else None,
            spec.get("default"), "default" in spec, tuple((r, spec[r]) for r in _RULES if r in spec), children, spec.get("items"),
        )

    properties = tuple(prop(k, v, k) for k, v in (raw.get("properties") or {}).items())
    if len(keys) != 1:
        raise Validation(f"schema {name}: exactly one primary key is required, found {len(keys)}")
    if keys[0] not in required:
        raise Validation(f"schema {name}: the primary key {keys[0]} must be required")
    triggers = tuple(sorted((Trigger(k, int(t.get("order", 0)), tuple(_OLD_EVENTS.get(e, e) for e in t.get("events") or ()), t.get("script", "")) for k, t in (raw.get("x-triggers") or {}).items()), key=lambda t: (t.order, t.name)))
    for t in triggers:
        if not t.events or not t.script:
            raise Validation(f"schema {name}: trigger {t.name} needs events and a script")
    rules = tuple(Rule(r["effect"], tuple(r.get("action") or ()), r["match"]) for r in (raw.get("x-authorization") or {}).get("rules") or ())
    return CollectionSchema(
        name, properties, required, keys[0], indexes, triggers, rules, bool(raw.get("x-read-only", raw.get("x-readonly"))), bool(raw.get("x-require-index")),
        bool(raw.get("x-immutable")), bool(raw.get("x-prevent-deletes")), raw.get("additionalProperties") is False, raw,
    )


CDC = parse("""
type: object
x-collection: system_cdc
x-immutable: true
x-read-only: true
required: [_id, collection, action, documentID, timestamp]
properties:
  _id: {type: string, x-primary: true}
  collection: {type: string, x-index: {collection_document_idx: {additional_fields: [documentID]}}}
  action: {type: string, enum: [create, update, delete, set]}
  documentID: {type: string, x-index: {document_id_idx: {}}}
  diff: {type: array}
  timestamp: {type: integer, x-index: {timestamp_idx: {}}}
  metadata: {type: object}
""")
