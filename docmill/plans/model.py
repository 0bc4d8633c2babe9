"""The structured query: select, join, where, group by, having, order by, limit and page."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from docmill.errors import Validation

QUERY_OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "containsAny", "containsAll", "in")
TEXT_OPS = ("hasPrefix", "hasSuffix", "regex")
AGGREGATES = ("count", "max", "min", "sum")


@dataclass(frozen=True)
class Field:
    """A reference to a field as a predicate's value; in JSON it is written "$path"."""

    path: str


@dataclass(frozen=True)
class Where:
    field: str
    op: str
    value: Any = None

    def check(self, strict: bool = False) -> None:
        if not self.field:
            raise Validation("where: field is required")
        if self.op not in QUERY_OPS and (strict or self.op not in TEXT_OPS):
            raise Validation(f"where: unknown operator {self.op!r}")
        if self.value is None or (isinstance(self.value, str) and self.value == ""):
            raise Validation("where: value is required")


@dataclass(frozen=True)
class Select:
    field: str
    aggregate: str = ""
    as_: str = ""

    @property
    def alias(self) -> str:
        return self.as_ or (f"{self.aggregate}_{self.field}" if self.aggregate else self.field)


@dataclass(frozen=True)
class OrderBy:
    field: str
    direction: str = "asc"


@dataclass(frozen=True)
class Join:
    collection: str
    on: tuple[Where, ...]
    as_: str = ""

    @property
    def alias(self) -> str:
        return self.as_ or self.collection


@dataclass(frozen=True)
class Query:
    select: tuple[Select, ...] = ()
    join: tuple[Join, ...] = ()
    where: tuple[Where, ...] = ()
    group_by: tuple[str, ...] = ()
    page: int = 0
    limit: int = 0
    order_by: tuple[OrderBy, ...] = ()
    having: tuple[Where, ...] = ()

    @property
    def is_aggregate(self) -> bool:
        return any(s.aggregate for s in self.select)

    def check(self, strict: bool = False) -> None:
        """Raises Validation. strict: also refuses the text operators, which only scans and streams take then."""
        if not self.select:
            raise Validation("query: at least one select is required")
        for s in self.select:
            if not s.field:
                raise Validation("select: field is required")
            if s.aggregate and s.aggregate not in AGGREGATES:
                raise Validation(f"select: unknown aggregate {s.aggregate!r}")
        if self.page < 0 or self.limit < 0:
            raise Validation("query: page and limit must not be negative")
        for w in (*self.where, *self.having):
            w.check(strict)
        for j in self.join:
            if not j.collection or not j.on:
                raise Validation("join: collection and on are required")
            for w in j.on:
                w.check(strict)
        for o in self.order_by:
            if o.direction not in ("asc", "desc"):
                raise Validation(f"order by: direction must be asc or desc, not {o.direction!r}")
        if self.is_aggregate:
            plain = [s.field for s in self.select if not s.aggregate]
            for f in plain:
                if f not in self.group_by:
                    raise Validation(f"select: {f} is neither aggregated nor in group by")
            for g in self.group_by:
                if g not in plain:
                    raise Validation(f"group by: {g} is not selected")
            names = [s.alias for s in self.select]
            if len(set(names)) < len(names):
                raise Validation("select: two results have the same name")

    def to_dict(self) -> dict:
        """The JSON form: empty parts are left out, page is always there."""
        value = lambda v: f"${v.path}" if isinstance(v, Field) else v
        wheres = lambda ws: [{"field": w.field, "op": w.op, "value": value(w.value)} for w in ws]
        out: dict = {"select": [{k: v for k, v in (("aggregate", s.aggregate), ("as", s.as_), ("field", s.field)) if v} for s in self.select]}
        if self.join:
            out["join"] = [{"collection": j.collection, "on": wheres(j.on), **({"as": j.as_} if j.as_ else {})} for j in self.join]
        if self.where:
            out["where"] = wheres(self.where)
        if self.group_by:
            out["groupBy"] = list(self.group_by)
        out["page"] = self.page
        if self.limit:
            out["limit"] = self.limit
        if self.order_by:
            out["orderBy"] = [asdict(o) for o in self.order_by]
        if self.having:
            out["having"] = wheres(self.having)
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), separators=(",", ":"))

    @staticmethod
    def from_dict(d: dict) -> Query:
        wheres = lambda ws: tuple(Where(w.get("field", ""), w.get("op", ""), w.get("value")) for w in ws or ())
        return Query(
            tuple(Select(s.get("field", ""), s.get("aggregate", ""), s.get("as", "")) for s in d.get("select") or ()),
            tuple(Join(j.get("collection", ""), wheres(j.get("on")), j.get("as", "")) for j in d.get("join") or ()),
            wheres(d.get("where")), tuple(d.get("groupBy") or ()), int(d.get("page") or 0), int(d.get("limit") or 0),
            tuple(OrderBy(o["field"], o.get("direction", "asc")) for o in d.get("orderBy") or ()), wheres(d.get("having")),
        )


@dataclass
class Q:
    """Fluent builder; every call appends."""

    parts: dict = field(default_factory=lambda: {k: [] for k in ("select", "join", "where", "group_by", "order_by", "having")} | {"limit": 0, "page": 0})

    def _add(self, part: str, items: tuple) -> Q:
        self.parts[part] += items
        return self

    def select(self, *items: Select | str) -> Q:
        return self._add("select", tuple(Select(i) if isinstance(i, str) else i for i in items))

    def where(self, *items: Where) -> Q:
        return self._add("where", items)

    def join(self, *items: Join) -> Q:
        return self._add("join", items)

    def group_by(self, *items: str) -> Q:
        return self._add("group_by", items)

    def order_by(self, *items: OrderBy) -> Q:
        return self._add("order_by", items)

    def having(self, *items: Where) -> Q:
        return self._add("having", items)

    def limit(self, n: int) -> Q:
        self.parts["limit"] = n
        return self

    def page(self, n: int) -> Q:
        self.parts["page"] = n
        return self

    def query(self) -> Query:
        return Query(**{k: tuple(v) if isinstance(v, list) else v for k, v in self.parts.items()})


@dataclass(frozen=True)
class Explain:
    """Which declared index a where list would use: a hint about layout, as Spark does the pruning."""

    collection: str = ""
    index: str = ""
    equal: tuple[tuple[str, Any], ...] = ()  # fields and what they are to equal
    bound: Where | None = None
    backwards: bool = False


@dataclass
class Page:
    """A page of results. documents is a DataFrame; count runs it."""

    documents: Any
    next_page: int
    explain: Explain
    seconds: float = 0.0

    def rows(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.documents.collect()]

    def count(self) -> int:
        return self.documents.count()
