"""The graph of collections by foreign keys, and plans that turn one set of schemas into another."""

from __future__ import annotations

import graphlib
import hashlib
import json
import string
from dataclasses import dataclass

from docmill.errors import Validation
from docmill.schema import CollectionSchema, parse


class Dag:
    """Edges lead from a collection to the targets of its top-level foreign keys."""

    def __init__(self, schemas: dict[str, CollectionSchema]):
        self.targets: dict[str, set[str]] = {}
        for name, s in schemas.items():
            found = {p.foreign_key.collection for p in s.properties if p.foreign_key}
            for t in found:
                if t not in schemas:
                    raise Validation(f"collection {name} refers to {t}, which does not exist")
            self.targets[name] = found - {name}
        try:
            self._order = list(graphlib.TopologicalSorter({n: sorted(t) for n, t in sorted(self.targets.items())}).static_order())
        except graphlib.CycleError as e:
            raise Validation(f"foreign keys form a cycle: {e.args[1]}") from e

    def creation_order(self) -> list[str]:
        """Targets first."""
        return list(self._order)

    def deletion_order(self) -> list[str]:
        """Those that refer to others first."""
        return self._order[::-1]

    def children(self, name: str) -> list[str]:
        return sorted(n for n, t in self.targets.items() if name in t)


@dataclass(frozen=True)
class FieldOp:
    path: str
    op: str
    value: object = None
    before_value: object = None


@dataclass(frozen=True)
class PlanItem:
    collection: str
    diff: tuple[FieldOp, ...]


@dataclass(frozen=True)
class Plan:
    to_delete: tuple[PlanItem, ...]
    to_create: tuple[PlanItem, ...]
    to_replace: tuple[PlanItem, ...]
    previous_hash: str = ""

    @property
    def is_empty(self) -> bool:
        return not (self.to_delete or self.to_create or self.to_replace)


def flat(d, prefix: str = "") -> dict[str, object]:
    """Leaves by dotted path; empty objects and lists are leaves."""
    if isinstance(d, dict) and d:
        return {k: v for key, x in d.items() for k, v in flat(x, f"{prefix}{key}.").items()}
    return {prefix[:-1]: d} if prefix else {}


def diff(after: dict, before: dict) -> tuple[FieldOp, ...]:
    """Leaf operations that turn before into after: removes, replaces, then adds, by path."""
    a, b = flat(after), flat(before)
    return (
        *(FieldOp(p, "remove", None, b[p]) for p in sorted(b.keys() - a.keys())),
        *(FieldOp(p, "replace", a[p], b[p]) for p in sorted(a.keys() & b.keys()) if a[p] != b[p]),
        *(FieldOp(p, "add", a[p], None) for p in sorted(a.keys() - b.keys())),
    )


def hash_of(schemas: dict[str, CollectionSchema]) -> str:
    return hashlib.sha1(json.dumps({n: s.raw for n, s in sorted(schemas.items())}, sort_keys=True).encode()).hexdigest()


def plan(wanted: list[str | dict], current: dict[str, CollectionSchema], values: dict | None = None) -> tuple[Plan, dict[str, CollectionSchema]]:
    """The changes from the current schemas to the wanted ones. Texts are templates: $name or ${name} takes a value."""
    texts = [string.Template(w).safe_substitute(values or {}) if isinstance(w, str) else w for w in wanted]
    schemas: dict[str, CollectionSchema] = {}
    for t in texts:
        s = parse(t)
        if s.collection in schemas:
            raise Validation(f"collection {s.collection} is declared twice")
        schemas[s.collection] = s
    dag = Dag(schemas)
    old = Dag(current)
    item = lambda n, after, before: PlanItem(n, diff(after, before))
    return Plan(
        tuple(item(n, {}, current[n].raw) for n in old.deletion_order() if n not in schemas),
        tuple(item(n, schemas[n].raw, {}) for n in dag.creation_order() if n not in current),
        tuple(item(n, schemas[n].raw, current[n].raw) for n in dag.creation_order() if n in current and schemas[n].raw != current[n].raw),
        hash_of(current) if current else "",
    ), schemas
