"""The syntax tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields


class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


def _nodes(value) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, (list, tuple)):
        for v in value:
            yield from _nodes(v)


@dataclass(eq=False)
class Number(Node):
    text: str


@dataclass(eq=False)
class Text(Node):
    value: str


@dataclass(eq=False)
class Constant(Node):
    word: str  # NULL, TRUE, FALSE


@dataclass(eq=False)
class Column(Node):
    parts: tuple[str, ...]
    at: int


@dataclass(eq=False)
class Star(Node):
    qualifier: tuple[str, ...] = ()


@dataclass(eq=False)
class Unary(Node):
    op: str
    value: Node


@dataclass(eq=False)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(eq=False)
class Between(Node):
    value: Node
    low: Node
    high: Node
    negated: bool


@dataclass(eq=False)
class In(Node):
    value: Node
    items: list[Node]  # one Subquery, or values
    negated: bool


@dataclass(eq=False)
class Like(Node):
    value: Node
    pattern: Node
    negated: bool
    any_case: bool


@dataclass(eq=False)
class IsNull(Node):
    value: Node
    negated: bool


@dataclass(eq=False)
class Exists(Node):
    query: Node


@dataclass(eq=False)
class Subquery(Node):
    query: Node


@dataclass(eq=False)
class Case(Node):
    base: Node | None
    whens: list[tuple[Node, Node]]
    default: Node | None


@dataclass(eq=False)
class Cast(Node):
    value: Node
    type: str


@dataclass(eq=False)
class Over(Node):
    partition: list[Node]
    order: list[Node]
    frame: str


@dataclass(eq=False)
class Call(Node):
    name: str
    args: list[Node]
    at: int
    distinct: bool = False
    over: Over | None = None


@dataclass(eq=False)
class Ordering(Node):
    value: Node
    descending: bool = False


@dataclass(eq=False)
class Item(Node):
    value: Node
    alias: str | None = None


@dataclass(eq=False)
class Table(Node):
    parts: tuple[str, ...]
    alias: str | None
    at: int


@dataclass(eq=False)
class Derived(Node):
    query: Node
    alias: str | None


@dataclass(eq=False)
class Join(Node):
    left: Node
    right: Node
    kind: str  # ",", CROSS, INNER, LEFT, RIGHT, FULL
    natural: bool = False
    on: Node | None = None
    using: list[str] = field(default_factory=list)


@dataclass(eq=False)
class Grouping(Node):
    kind: str  # "", ROLLUP, CUBE, SETS
    sets: list[list[Node]]


@dataclass(eq=False)
class Select(Node):
    items: list[Item]
    distinct: bool = False
    source: Node | None = None
    where: Node | None = None
    groups: Grouping | None = None
    having: Node | None = None
    order: list[Ordering] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    ctes: list[tuple[str, Node]] = field(default_factory=list)

    def children(self) -> Iterator[Node]:
        yield from super().children()


@dataclass(eq=False)
class SetOperation(Node):
    op: str  # UNION, INTERSECT, EXCEPT
    all: bool
    left: Node
    right: Node
    order: list[Ordering] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    ctes: list[tuple[str, Node]] = field(default_factory=list)
