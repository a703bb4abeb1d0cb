"""Boolean queries: trees of terms that compile to one boolean column over per-document term flags."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class Query:
    """Base of the tree's nodes. Combine with ``&``, ``|`` and ``~``."""

    def __and__(self, other: Query) -> Query:
        return And(self, other)

    def __or__(self, other: Query) -> Query:
        return Or(self, other)

    def __invert__(self) -> Query:
        return Not(self)

    def leaves(self) -> list[str]:
        """All leaf terms, with multiplicity, also those under a negation."""
        raise NotImplementedError

    def bag(self) -> dict[str, int]:
        return dict(Counter(self.leaves()))

    def column(self, flag: Callable[[str], Column]) -> Column:
        """``flag`` gives the column that says whether the document has a term."""
        raise NotImplementedError

    def matches_nothing_known(self) -> bool:
        """Whether a document with none of the leaf terms matches."""
        raise NotImplementedError


@dataclass(frozen=True)
class Nothing(Query):
    def leaves(self) -> list[str]:
        return []

    def column(self, flag: Callable[[str], Column]) -> Column:
        return F.lit(False)

    def matches_nothing_known(self) -> bool:
        return False


@dataclass(frozen=True)
class Everything(Nothing):
    def column(self, flag: Callable[[str], Column]) -> Column:
        return F.lit(True)

    def matches_nothing_known(self) -> bool:
        return True


@dataclass(frozen=True)
class Term(Query):
    term: str

    def leaves(self) -> list[str]:
        return [self.term]

    def column(self, flag: Callable[[str], Column]) -> Column:
        return flag(self.term)

    def matches_nothing_known(self) -> bool:
        return False


@dataclass(frozen=True)
class Not(Query):
    inner: Query

    def leaves(self) -> list[str]:
        return self.inner.leaves()

    def column(self, flag: Callable[[str], Column]) -> Column:
        return ~self.inner.column(flag)

    def matches_nothing_known(self) -> bool:
        return not self.inner.matches_nothing_known()


@dataclass(frozen=True)
class And(Query):
    left: Query
    right: Query

    def leaves(self) -> list[str]:
        return self.left.leaves() + self.right.leaves()

    def column(self, flag: Callable[[str], Column]) -> Column:
        return self.left.column(flag) & self.right.column(flag)

    def matches_nothing_known(self) -> bool:
        return self.left.matches_nothing_known() and self.right.matches_nothing_known()


@dataclass(frozen=True)
class Or(And):
    def column(self, flag: Callable[[str], Column]) -> Column:
        return self.left.column(flag) | self.right.column(flag)

    def matches_nothing_known(self) -> bool:
        return self.left.matches_nothing_known() or self.right.matches_nothing_known()


def _fold(terms: Iterable[str], join: type[And]) -> Query:
    """A balanced tree, so that long bags make no deep recursion."""
    nodes: list[Query] = [Term(t) for t in terms]
    if not nodes:
        return Nothing()
    while len(nodes) > 1:
        pairs = [join(a, b) for a, b in zip(nodes[::2], nodes[1::2], strict=False)]
        nodes = pairs + nodes[len(pairs) * 2 :]
    return nodes[0]


def any_of(bag: Iterable[str]) -> Query:
    """Documents with any term of the bag; an empty bag matches nothing."""
    return _fold(bag, Or)


def all_of(bag: Iterable[str]) -> Query:
    """Documents with all terms of the bag; an empty bag matches nothing, not everything."""
    return _fold(bag, And)


def parse(text: str) -> Query:
    """Query from text: ``&``, ``|``, ``!`` and ``[ ]`` for grouping; ``!`` binds tightest, ``|`` loosest."""
    words = "".join(f" {c} " if c in "&|![]" else c for c in text).split()
    at = 0

    def peek() -> str | None:
        return words[at] if at < len(words) else None

    def take() -> str:
        nonlocal at
        if at >= len(words):
            raise ValueError("the query ends too soon")
        at += 1
        return words[at - 1]

    def either() -> Query:
        out = both()
        while peek() == "|":
            take()
            out = Or(out, both())
        return out

    def both() -> Query:
        out = single()
        while peek() == "&":
            take()
            out = And(out, single())
        return out

    def single() -> Query:
        word = take()
        if word == "!":
            return Not(single())
        if word == "[":
            out = either()
            if take() != "]":
                raise ValueError("a ] is missing")
            return out
        if word in "&|]":
            raise ValueError(f"a term is missing before {word}")
        return Term(word)

    if not words:
        return Nothing()
    out = either()
    if at < len(words):
        raise ValueError(f"{words[at]} does not belong there")
    return out
