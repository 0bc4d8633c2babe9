"""Access rules: deny rules first; if allow rules are for the action, one of them must match; if none are, it is allowed."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from docmill import scripts
from docmill.errors import Forbidden
from docmill.operators.documents import Document
from docmill.schema import CollectionSchema


@dataclass
class Context:
    """Who asks, and for which namespace. internal: schema upkeep, which no rule stops."""

    metadata: Document = field(default_factory=Document)
    internal: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.metadata, Document):
            self.metadata = Document(self.metadata)
        if not self.metadata.exists("namespace"):
            self.metadata.set("namespace", "default")

    @property
    def namespace(self) -> str:
        return self.metadata.get_string("namespace")

    def with_value(self, key: str, value: Any) -> Context:
        return Context(self.metadata.clone().set(key, value), self.internal)


def allowed(schema: CollectionSchema, action: str, context: Context, names: dict[str, Any], library: str = "") -> bool:
    if context.internal or not schema.rules:
        return True
    names = {"meta": context.metadata, "ctx": context, "schema": schema, "query": None, "doc": None, **names}
    of = lambda effect: [r for r in schema.rules if r.effect == effect and (r.actions[:1] == ("*",) or action in r.actions)]
    if any(scripts.truth(scripts.run(r.match, names, library)) for r in of("deny")):
        return False
    rules = of("allow")
    return not rules or any(scripts.truth(scripts.run(r.match, names, library)) for r in rules)


def require(schema: CollectionSchema, action: str, context: Context, names: dict[str, Any], library: str = "") -> None:
    if not allowed(schema, action, context, names, library):
        raise Forbidden(f"not authorized: {action} in {schema.collection}")
