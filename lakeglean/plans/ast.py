"""Query trees. A leaf is evaluated on postings or on document columns; inner nodes combine leaves."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Node:
    boost: float = field(default=1.0, kw_only=True)


@dataclass
class MatchAll(Node):
    pass


@dataclass
class MatchNone(Node):
    pass


@dataclass
class Term(Node):
    """One analysed term of a text field, scored by BM25."""

    field: str
    path: str
    term: str


@dataclass
class TermSet(Node):
    """Any of these terms; constant score."""

    field: str
    path: str
    terms: list


@dataclass
class Pattern(Node):
    """Terms by prefix, regex or edit distance; constant score."""

    field: str
    path: str
    kind: str
    text: str
    ignore_case: bool = False
    distance: int = 0
    transpositions: bool = True


@dataclass
class Phrase(Node):
    """Terms at relative positions; ``slop`` is the total displacement allowed."""

    field: str
    path: str
    terms: list  # (offset, term)
    slop: int = 0
    prefix_last: bool = False
    max_expansions: int = 50


@dataclass
class Compare(Node):
    """Comparison on a typed column or a typed JSON value; constant score."""

    field: str
    path: str
    ops: dict  # eq, in, gt, gte, lt, lte
    vtype: str


@dataclass
class Exists(Node):
    field: str
    path: str


@dataclass
class Bool(Node):
    must: list = field(default_factory=list)
    should: list = field(default_factory=list)
    must_not: list = field(default_factory=list)
    filter: list = field(default_factory=list)
    minimum: int = 0


@dataclass
class DisMax(Node):
    queries: list
    tie: float = 0.0


@dataclass
class Constant(Node):
    query: Node


LEAVES = (Term, TermSet, Pattern, Phrase, Compare, Exists)


def children(n: Node) -> list[Node]:
    if isinstance(n, Bool):
        return [*n.must, *n.should, *n.must_not, *n.filter]
    return n.queries if isinstance(n, DisMax) else [n.query] if isinstance(n, Constant) else []


def any_of(nodes: list[Node], minimum: int = 1) -> Node:
    if not nodes:
        return MatchNone()
    return nodes[0] if len(nodes) == 1 and minimum <= 1 else Bool(should=nodes, minimum=minimum)


def all_of(nodes: list[Node]) -> Node:
    if not nodes:
        return MatchNone()
    return nodes[0] if len(nodes) == 1 else Bool(must=nodes)


def boolean(must=(), should=(), must_not=(), filter=(), minimum: int | None = None) -> Node:
    """A Bool after the rules: empty means all; pure exclusion means all the others; a lone should must match."""
    if not (must or should or must_not or filter):
        return MatchAll()
    if minimum is None:
        minimum = 1 if should and not (must or filter) else 0
    n = Bool(must=list(must), should=list(should), must_not=list(must_not), filter=list(filter), minimum=minimum)
    if must_not and not (must or should or filter):
        n.filter.append(MatchAll())
    return n
