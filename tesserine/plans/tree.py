"""Syntax tree of the pattern query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    """An expression; equality is structural and ignores places in the text."""


@dataclass(frozen=True)
class Literal(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Name(Expr):
    name: str
    at: tuple[int, int] = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    key: str


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr
    at: tuple[int, int] = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False
    at: tuple[int, int] = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple[str, ...]
    props: tuple[tuple[str, Expr], ...]
    at: tuple[int, int] = (0, 0)


@dataclass(frozen=True)
class EdgePattern:
    var: str | None
    types: tuple[str, ...]
    direction: str  # out, in, both
    props: tuple[tuple[str, Expr], ...]
    hops: tuple[int, int | None] | None = None
    at: tuple[int, int] = (0, 0)


@dataclass(frozen=True)
class Path:
    """Nodes and the edges between them, in turn."""

    parts: tuple


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None
    text: str


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool


@dataclass
class Match:
    paths: list[Path]
    where: Expr | None = None


@dataclass
class Unwind:
    expr: Expr
    var: str


@dataclass
class Projection:
    """WITH or RETURN."""

    items: list[Item]
    distinct: bool = False
    order: list[Order] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None
    final: bool = False
    star: bool = False


@dataclass
class Create:
    paths: list[Path]


@dataclass
class Merge:
    path: Path
    on_create: list = field(default_factory=list)
    on_match: list = field(default_factory=list)


@dataclass
class Delete:
    names: list[Expr]
    detach: bool


@dataclass(frozen=True)
class SetProperty:
    var: str
    key: str
    value: Expr


@dataclass(frozen=True)
class SetLabels:
    var: str
    labels: tuple[str, ...]


@dataclass(frozen=True)
class SetMap:
    var: str
    value: Expr
    merge: bool


@dataclass
class Set:
    items: list


@dataclass(frozen=True)
class RemoveProperty:
    var: str
    key: str


@dataclass
class Remove:
    items: list


@dataclass
class Query:
    clauses: list


def children(e: Any) -> list:
    if isinstance(e, Prop):
        return [e.of]
    if isinstance(e, Unary):
        return [e.arg]
    if isinstance(e, Binary):
        return [e.left, e.right]
    if isinstance(e, ListOf):
        return list(e.items)
    if isinstance(e, MapOf):
        return [v for _, v in e.items]
    if isinstance(e, Call):
        return list(e.args)
    return []


def walk(e: Any):
    yield e
    for c in children(e):
        yield from walk(c)


AGGREGATES = frozenset(("count", "sum", "avg", "min", "max", "collect"))


def is_aggregate(e: Any) -> bool:
    return isinstance(e, Call) and e.name.lower() in AGGREGATES


def has_aggregate(e: Any) -> bool:
    return any(is_aggregate(x) for x in walk(e))
