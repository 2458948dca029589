"""The syntax tree: immutable nodes that compare by structure."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, is_dataclass, replace


@dataclass(frozen=True)
class Node:
    """Any expression."""


@dataclass(frozen=True, eq=False)
class Literal(Node):
    value: object  # int, float, str, bool or None

    def __eq__(self, other):
        """1, 1.0 and true are different literals."""
        return isinstance(other, Literal) and type(self.value) is type(other.value) and self.value == other.value

    def __hash__(self):
        return hash((type(self.value), self.value))


@dataclass(frozen=True)
class Param(Node):
    name: str


@dataclass(frozen=True)
class Regex(Node):
    pattern: str
    flags: str


@dataclass(frozen=True)
class Path(Node):
    """Names as written: range.property.path, property, alias or range."""

    parts: tuple[str, ...]


@dataclass(frozen=True)
class Field(Node):
    """A property of a range, with the path into its JSON value, if any."""

    range: str
    name: str
    path: tuple[str, ...] = ()


@dataclass(frozen=True)
class Whole(Node):
    """A range as a value."""

    range: str


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Arith(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Compare(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Logic(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    operand: Node


@dataclass(frozen=True)
class In(Node):
    operand: Node
    values: tuple[object, ...]
    negated: bool


@dataclass(frozen=True)
class Cast(Node):
    kind: str
    operand: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Search(Node):
    fields: tuple[Node, ...]
    text: Node
    score: bool = False


@dataclass(frozen=True)
class Exists(Node):
    range: str


@dataclass(frozen=True)
class Aggregate(Node):
    fn: str
    operand: Node
    where: Node | None = None


@dataclass(frozen=True)
class Item:
    alias: str
    expr: Node
    explicit: bool


@dataclass(frozen=True)
class Sort:
    expr: Node
    descending: bool


@dataclass(frozen=True)
class Retrieve:
    items: tuple[Item, ...]
    unique: bool = False
    where: Node | None = None
    sort: tuple[Sort, ...] = ()
    window: tuple[int, int] | None = None  # page, size


@dataclass(frozen=True)
class EntitySource:
    entity: str


@dataclass(frozen=True)
class JsonSource:
    file: str
    path: str | None = None


@dataclass(frozen=True)
class Range:
    name: str
    source: "EntitySource | JsonSource | Query"
    via: Path | None = None


@dataclass(frozen=True)
class Query:
    directives: dict
    ranges: tuple[Range, ...]
    retrieve: Retrieve

    def __hash__(self):
        return id(self)


def children(node: object) -> Iterator[Node]:
    for f in fields(node) if is_dataclass(node) else ():
        v = getattr(node, f.name)
        for x in v if isinstance(v, tuple) else (v,):
            if isinstance(x, Node):
                yield x


def walk(node: Node | None, stop: type | tuple = ()) -> Iterator[Node]:
    """The node and all below it; nodes of a type in ``stop`` are given but not entered."""
    if node is not None:
        yield node
        if not isinstance(node, stop or ()):
            for c in children(node):
                yield from walk(c, stop)


def rewrite(node: Node | None, change: Callable[[Node], Node | None]) -> Node | None:
    """A copy in which each node for which ``change`` gives another is replaced; replaced nodes are not entered."""
    if node is None:
        return None
    new = change(node)
    if new is not None:
        return new
    parts = {}
    for f in fields(node):
        v = getattr(node, f.name)
        if isinstance(v, Node):
            parts[f.name] = rewrite(v, change)
        elif isinstance(v, tuple) and any(isinstance(x, Node) for x in v):
            parts[f.name] = tuple(rewrite(x, change) if isinstance(x, Node) else x for x in v)
    return replace(node, **parts) if parts else node


def terms(node: Node | None) -> list[Node]:
    """The operands of the ands at the top."""
    if node is None:
        return []
    return [*terms(node.left), *terms(node.right)] if isinstance(node, Logic) and node.op == "and" else [node]


def both(nodes: list[Node]) -> Node | None:
    out = None
    for n in nodes:
        out = n if out is None else Logic("and", out, n)
    return out


def ranges_in(*nodes: Node | None, stop: type | tuple = ()) -> set[str]:
    return {n.range for node in nodes for n in walk(node, stop) if isinstance(n, (Field, Whole, Exists))}
