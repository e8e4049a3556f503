"""Names: schema and name, kinds of objects, and the keys that state is kept under."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

#: The kinds of managed objects, as state tables spell them.
KINDS = ("table", "view", "materialized_view", "function", "procedure", "type", "domain", "index", "trigger", "comment", "cron_job", "aggregate", "operator")
#: What a dependency of each class may refer to.
TARGETS = {"relation": ("table", "view", "materialized_view"), "function": ("function", "procedure", "operator"), "type": ("type", "domain", "view", "materialized_view", "table")}


class Ident(NamedTuple):
    """A name as it is spelled; schema is None where none was written."""

    schema: str | None
    name: str

    def __str__(self) -> str:
        return self.name if self.schema is None else f"{self.schema}.{self.name}"

    @classmethod
    def parse(cls, text: str) -> Ident:
        """Two parts are schema and name; anything else is a name as a whole."""
        parts = text.split(".")
        return cls(parts[0], parts[1]) if len(parts) == 2 else cls(None, text)

    def sort_key(self) -> tuple:
        return (self.schema is not None, self.schema or "", self.name)


@dataclass(frozen=True)
class Dependencies:
    relations: frozenset[Ident] = frozenset()
    functions: frozenset[Ident] = frozenset()
    types: frozenset[Ident] = frozenset()

    def __or__(self, other: Dependencies) -> Dependencies:
        return Dependencies(self.relations | other.relations, self.functions | other.functions, self.types | other.types)

    def without(self, ident: Ident) -> Dependencies:
        return Dependencies(self.relations - {ident}, self.functions - {ident}, self.types - {ident})

    def minus(self, other: Dependencies) -> Dependencies:
        """Without built-in names."""
        return Dependencies(self.relations - other.relations, self.functions - other.functions, self.types - other.types)

    def rows(self) -> list[tuple[str, Ident]]:
        """(class, name) of all, sorted within each class; names without a schema first."""
        return [(kind, i) for kind, found in (("relation", self.relations), ("function", self.functions), ("type", self.types)) for i in sorted(found, key=Ident.sort_key)]


def state_key(kind: str, ident: Ident, trigger_table: Ident | None = None) -> str:
    """The name that an object is recorded under: name:table for triggers, else schema.name."""
    return f"{ident}:{trigger_table}" if kind == "trigger" and trigger_table is not None else str(ident)


def from_state_key(kind: str, key: str) -> tuple[Ident, Ident | None]:
    if kind == "trigger" and ":" in key:
        name, _, on = key.partition(":")
        return Ident.parse(name), Ident.parse(on)
    # keys of comments hold dots and colons of their own
    return (Ident(None, key) if kind == "comment" else Ident.parse(key)), None


def shown(kind: str, ident: Ident, trigger_table: Ident | None = None) -> str:
    return f"{ident} on {trigger_table}" if trigger_table is not None else str(ident)
