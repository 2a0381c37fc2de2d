"""Syntax tree of queries.  Parsers of all surfaces (JSON, builder, query strings, SQL) make it, and compile.py reads it."""

from __future__ import annotations

from dataclasses import dataclass


class ParsingError(ValueError):
    """A query that has no meaning; it never silently matches everything."""


class Node:
    pass


@dataclass(frozen=True)
class MatchAll(Node):
    pass


@dataclass(frozen=True)
class MatchNone(Node):
    pass


@dataclass(frozen=True)
class Match(Node):
    field: str
    text: str
    operator: str = "or"


@dataclass(frozen=True)
class Phrase(Node):
    fields: tuple
    text: str


@dataclass(frozen=True)
class PhrasePrefix(Node):
    field: str
    text: str


@dataclass(frozen=True)
class MultiMatch(Node):
    fields: tuple
    text: str
    type: str = "best_fields"


@dataclass(frozen=True)
class QueryString(Node):
    text: str
    fields: tuple = ("_all",)
    simple: bool = False


@dataclass(frozen=True)
class Term(Node):
    field: str
    value: object


@dataclass(frozen=True)
class Terms(Node):
    field: str
    values: tuple


@dataclass(frozen=True)
class Range(Node):
    field: str
    bounds: tuple  # of (gt | gte | lt | lte, value)


@dataclass(frozen=True)
class Exists(Node):
    field: str


@dataclass(frozen=True)
class Prefix(Node):
    field: str
    value: str


@dataclass(frozen=True)
class Wildcard(Node):
    field: str
    value: str


@dataclass(frozen=True)
class Regexp(Node):
    field: str
    value: str


@dataclass(frozen=True)
class Fuzzy(Node):
    field: str
    value: str
    fuzziness: object = "AUTO"


@dataclass(frozen=True)
class TermsSet(Node):
    field: str
    values: tuple
    minimum: int


@dataclass(frozen=True)
class GeoDistance(Node):
    field: str
    lat: float
    lon: float
    metres: float


@dataclass(frozen=True)
class GeoBox(Node):
    field: str
    top: float
    left: float
    bottom: float
    right: float


@dataclass(frozen=True)
class Bool(Node):
    must: tuple = ()
    filter: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    minimum: int | None = None


def walk(node: Node):
    yield node
    if isinstance(node, Bool):
        for part in (node.must, node.filter, node.should, node.must_not):
            for x in part:
                yield from walk(x)
