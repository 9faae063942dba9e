"""Query trees as Catalyst expressions: exact over token arrays, or as a prefilter over signature bits."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from termweave.functions.text import contains_phrase
from termweave.plans.parser import And, Fact, MatchAll, MatchNone, Node, Not, Or, Phrase, Term


def to_column(node: Node, terms: Mapping[int, str], tokens: Mapping[int, str] | None = None, stream_scope: str = "enforce") -> Column:
    """terms and tokens: by stream, the columns with distinct terms and with tokens in order.

    stream_scope "ignore" lets a term of any stream match in any. Membership is never null.
    """
    tokens = tokens or terms

    def places(columns: Mapping[int, str], stream: int) -> list[Column]:
        return [F.col(c) for c in columns.values()] if stream_scope == "ignore" else [F.col(columns[stream])]

    def leaf(n: Node) -> Column:
        match n:
            case Term(text, stream):
                return reduce(or_, [F.coalesce(F.array_contains(c, text), F.lit(False)) for c in places(terms, stream)])
            case Phrase(grams, stream):
                held = zip(places(terms, stream), places(tokens, stream), strict=True)
                # set membership is cheap and decides most rows before places are compared
                return reduce(or_, [reduce(and_, [F.coalesce(F.array_contains(t, g), F.lit(False)) for g in grams]) & contains_phrase(c, grams) for t, c in held])
            case Fact(name):
                return F.coalesce(F.col(name).cast("boolean"), F.lit(False))
        raise TypeError(n)

    return evaluate(node, leaf)


def evaluate(node: Node, leaf: Callable[[Node], Column]) -> Column:
    """The tree over what leaf() gives for its terms, phrases and facts, none of which is null."""
    match node:
        case MatchAll():
            return F.lit(True)
        case MatchNone():
            return F.lit(False)
        case Not(child):
            return ~evaluate(child, leaf)
        case And(children):
            return reduce(and_, [evaluate(c, leaf) for c in children])
        case Or(children):
            return reduce(or_, [evaluate(c, leaf) for c in children])
    return leaf(node)


def literals(node: Node) -> list[Term | Phrase | Fact]:
    match node:
        case Not(child):
            return literals(child)
        case And(children) | Or(children):
            return [x for c in children for x in literals(c)]
        case MatchAll() | MatchNone():
            return []
    return [node]


def possible_without(node: Node) -> bool:
    """Can a document match that has none of the terms and phrases? (Facts may be either.)"""

    def values(n: Node) -> set[bool]:
        match n:
            case MatchAll():
                return {True}
            case Fact():
                return {True, False}
            case Not(child):
                return {not v for v in values(child)}
            case And(children) | Or(children):
                test = all if isinstance(n, And) else any
                got = [values(c) for c in children]
                return {v for v in (True, False) if (all(v in g for g in got) if v == (test is all) else any(v in g for g in got))}
        return {False}

    return True in values(node)


def prefilter(node: Node, may_have: Callable[[str, int], Column]) -> Column:
    """A superset of the matches from a test without false negatives; negations test nothing."""
    match node:
        case Term(text, stream):
            return may_have(text, stream)
        case Phrase(grams, stream):
            return reduce(and_, [may_have(g, stream) for g in grams])
        case And(children):
            return reduce(and_, [prefilter(c, may_have) for c in children])
        case Or(children):
            return reduce(or_, [prefilter(c, may_have) for c in children])
    return F.lit(True)


def disjuncts(node: Node, limit: int = 180) -> list[list[tuple[bool, Term | Phrase | Fact]]] | None:
    """Disjunctive normal form as lists of (wanted, literal); None beyond limit conjunctions."""

    def push(n: Node, wanted: bool) -> list[list] | None:
        match n:
            case Not(child):
                return push(child, not wanted)
            case And(children) | Or(children):
                parts = [push(c, wanted) for c in children]
                if any(p is None for p in parts):
                    return None
                if isinstance(n, And) == wanted:
                    out: list[list] = [[]]
                    for p in parts:
                        out = [a + b for a in out for b in p]
                        if len(out) > limit:
                            return None
                    return out
                out = [c for p in parts for c in p]
                return out if len(out) <= limit else None
        return [[(wanted, n)]]

    return push(node, True)
