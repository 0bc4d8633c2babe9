"""Which declared index fits a where list: the one with the longest leading run of fields that are asked to equal something, a
bound on the field after that run counting as one more if it is the index's last."""

from __future__ import annotations

from itertools import takewhile

from docmill.errors import Forbidden
from docmill.plans.model import Explain, Where

BOUNDS = ("lt", "lte", "gt", "gte")


def _fit(fields: tuple[str, ...], equal: dict[str, object], bound: dict[str, Where]) -> tuple[tuple[str, ...], Where | None]:
    run = tuple(takewhile(equal.__contains__, fields))
    rest = fields[len(run) :]
    return run, bound.get(rest[0]) if len(rest) == 1 else None


def choose(schema, where: tuple[Where, ...]) -> Explain:
    """schema: docmill.schema.CollectionSchema. The order of the clauses does not matter. Equally good indexes: the primary one, then by name."""
    equal = {w.field: w.value for w in where if w.op == "eq"}
    bound = {w.field: w for w in where if w.op in BOUNDS}
    ranked = sorted(schema.indexes.values(), key=lambda i: (not i.primary, i.name))
    fits = [(index, *_fit(tuple(index.fields), equal, bound)) for index in ranked]
    index, run, last = max(fits, key=lambda f: (len(f[1]) + (f[2] is not None), schema.primary_key in f[1]), default=(schema.primary_index, (), None))
    if where and not run and last is None and schema.require_index:
        raise Forbidden(f"{schema.collection} can only be asked by one of its indexes")
    return Explain(schema.collection, index.name, tuple((f, equal[f]) for f in run), last, last is not None and last.op.startswith("lt"))
