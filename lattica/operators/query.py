"""The grammar of full-text queries, and what it asks of the places of terms in a note."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.sources.index import COLUMN_PLACES

NEAR_DEFAULT = 10


class QueryError(ValueError):
    """A query that the grammar doesn't allow."""


@dataclass(frozen=True)
class Phrase:
    """Terms that stand one after the other; with prefix the last is the beginning of one, with first they begin a column. number is its place in the query."""

    number: int
    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False

    @property
    def simple(self) -> bool:
        """Whether counts of one term tell how often it occurs."""
        return len(self.terms) == 1 and not self.first


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    within: int


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Without:
    keep: object
    drop: object


_TOKEN = re.compile(r"\s*(?:([()+*,^])|((?:[^\W]|[^\x00-\x7f])+))")


class Parser:
    """A query as a tree. OR binds least, then AND, then NOT, then words side by side, all of which are needed.

    word*  beginnings of words     a + b  words next to each other     ^a  at the start of a column
    NEAR(a b, n)  all of them, at most n words between the end of each and the beginning of the last
    ( )  as usual, joined to the rest by an operator. Dashes and quotation marks count as blanks.

    lead is what a column written before the query would bind: its first item, or all in parentheses that it begins with.
    """

    def __init__(self, query: str, terms_of):
        self.terms_of, self.tokens, text, at = terms_of, [], re.sub(r'[-"]', " ", query).rstrip(), 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected sign {text[at:].strip()[:1]!r} in {query!r}")
            self.tokens.append(m[1] or m[2])
            at = m.end()
        self.query, self.at, self.lead, self.phrases = query, 0, None, 0

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        token = self.peek()
        if token is None or want is not None and token != want:
            raise QueryError(f"{want or 'a word'} is missing before {token or 'the end'!r} in {self.query!r}")
        self.at += 1
        return token

    def parse(self):
        """The tree, or None for a query without words."""
        if not self.tokens:
            return None
        out = self.either()
        if self.peek() is not None:
            raise QueryError(f"unexpected {self.peek()!r} in {self.query!r}")
        self.lead = self.lead or first_of(out)
        return out

    def _chain(self, sign: str, part, kind):
        parts = [part()]
        while self.peek() == sign:
            self.take()
            parts.append(part())
        parts = [p for p in parts if p is not None]
        return (kind(tuple(parts)) if len(parts) > 1 else parts[0]) if parts else None

    def either(self):
        return self._chain("OR", self.both, Either)

    def both(self):
        return self._chain("AND", self.without, Both)

    def without(self):
        out = self.side_by_side()
        while self.peek() == "NOT":
            self.take()
            drop = self.side_by_side()
            out = out if drop is None or out is None else Without(out, drop)
        return out

    def side_by_side(self):
        if self.peek() == "(":
            leads = self.at == 0
            self.take()
            out = self.either()
            self.take(")")
            self.lead = out if leads else self.lead
            return out
        parts = [self.item()]
        while self.peek() is not None and self.peek() not in ("OR", "AND", "NOT", ")", "(", ",", "+", "*"):
            parts.append(self.item())
        parts = [p for p in parts if p is not None]
        return (Both(tuple(parts)) if len(parts) > 1 else parts[0]) if parts else None

    def item(self):
        if self.peek() == "NEAR" and self.peek(1) == "(":
            self.take()
            self.take()
            phrases, within = [], NEAR_DEFAULT
            while self.peek() not in (")", ","):
                phrases.append(self.phrase())
            if self.peek() == ",":
                self.take()
                number = self.take()
                if not number.isdecimal():
                    raise QueryError(f"{number!r} is no number of words in {self.query!r}")
                within = int(number)
            self.take(")")
            phrases = [p for p in phrases if p is not None]
            return (Near(tuple(phrases), within) if len(phrases) > 1 else phrases[0]) if phrases else None
        return self.phrase()

    def phrase(self) -> Phrase | None:
        first = self.peek() == "^"
        if first:
            self.take()
        terms, prefix = [], False
        while True:
            word = self.take()
            if word in ("(", ")", "+", "*", ",", "^", "OR", "AND", "NOT"):
                raise QueryError(f"a word is missing before {word!r} in {self.query!r}")
            terms += self.terms_of(word)
            if self.peek() == "*":
                self.take()
                prefix = True
            if self.peek() != "+":
                break
            if prefix:
                raise QueryError(f"only the last word of a phrase can be a beginning in {self.query!r}")
            self.take()
        if not terms:
            return None
        self.phrases += 1
        return Phrase(self.phrases - 1, tuple(terms), prefix, first)


def phrases_of(node) -> list[Phrase]:
    """The phrases of a tree, in order."""
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    if isinstance(node, Without):
        return phrases_of(node.keep) + phrases_of(node.drop)
    return [p for x in node.parts for p in phrases_of(x)]


def scored_of(node) -> list[Phrase]:
    """The phrases that a note which is found can hold."""
    if isinstance(node, Without):
        return scored_of(node.keep)
    return [p for x in node.parts for p in scored_of(x)] if isinstance(node, (Both, Either)) else phrases_of(node)


def first_of(node):
    """The phrase or group of near ones at the beginning of a tree."""
    while isinstance(node, (Both, Either, Without)):
        node = node.keep if isinstance(node, Without) else node.parts[0]
    return node


def hit(phrase: Phrase, k: int) -> Column:
    """Whether a posting is of the k-th term of a phrase."""
    last = k == len(phrase.terms) - 1
    return F.col("term").startswith(phrase.terms[k]) if phrase.prefix and last else F.col("term") == phrase.terms[k]


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x + by)


def starts(phrase: Phrase, places: list[Column]) -> Column:
    """Where a phrase begins in a note, by the sorted places of its terms."""
    out = places[0]
    for k, p in enumerate(places[1:], 1):
        out = F.array_intersect(out, _moved(p, -k))
    return F.filter(out, lambda x: x % COLUMN_PLACES == 0) if phrase.first else out


def in_column(found: Column, column: int) -> Column:
    return F.filter(found, lambda x: F.floor(x / COLUMN_PLACES) == column)


def _tagged(places: Column, number: int) -> Column:
    return F.transform(places, lambda x: F.struct(x.alias("at"), F.lit(number).alias("k")))


def near(found: list[Column], lengths: list[int], within: int) -> Column:
    """Whether all phrases stand close together: some beginning of one is the last, and before it, or with it, each of the others has begun and ended at most so many words before. One pass over all beginnings in their order, with the latest of each phrase."""
    never = -COLUMN_PLACES
    tagged = F.array_sort(F.flatten(F.array(*(_tagged(o, i) for i, o in enumerate(found)))))
    state = F.struct(F.array(*(F.lit(never).cast("long") for _ in found)).alias("latest"), F.lit(False).alias("met"))

    def step(z: Column, x: Column) -> Column:
        latest = F.transform(z["latest"], lambda v, i: F.when(i == x["k"], x["at"]).otherwise(v))
        close = reduce(Column.__and__, (x["at"] - F.when(x["k"] == i, x["at"]).otherwise(F.get(z["latest"], F.lit(i))) - n <= within for i, n in enumerate(lengths)))
        return F.struct(latest.alias("latest"), (z["met"] | close).alias("met"))

    return F.aggregate(tagged, state, step, lambda z: z["met"])
