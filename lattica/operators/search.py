"""Full-text search over an index: BM25 by column, recency, and the handling of hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import recency
from lattica.model import BM25_B, BM25_K1, WEIGHTS
from lattica.sources.index import TEXTS

from . import query as Q
from .relational import keep_latest

COLUMNS = ("title", "tags", "body")


def _weighted(columns: dict[str, str]) -> Column:
    """Counts by column of a note, each held in a column of the table, with the columns' weights."""
    return reduce(Column.__add__, (F.col(held) * WEIGHTS[c] for c, held in columns.items()))


def term_weights(postings: DataFrame) -> DataFrame:
    """(note_id, term, tf): counts weighted by column."""
    return postings.select("note_id", "term", _weighted({c: c for c in COLUMNS}).alias("tf"))


def statistics(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df) and (note_id, doc_len), the length being the sum of whole weighted frequencies."""
    tf = term_weights(postings)
    return tf.groupBy("term").agg(F.count("*").alias("df")), tf.groupBy("note_id").agg(F.sum(F.floor("tf")).cast("long").alias("doc_len"))


class _Matches:
    """What a query's phrases ask of the postings of a note, and what they tell once these are grouped by note.

    A single word needs counts only; the places of words are read for phrases of several, near ones and beginnings of a
    column. ARMS are the ways in which a query is asked: in all columns, and with its lead bound to one.
    """

    ARMS = (None, "title", "tags")

    def __init__(self, tree, lead):
        self.tree = tree
        self.phrases = Q.phrases_of(tree)
        self.bound = set(Q.phrases_of(lead))
        close = {p for n in self._nears(tree) for p in n.phrases}
        self.counted = [p for p in self.phrases if p.simple and p not in close]
        self.placed = [p for p in self.phrases if p not in self.counted]
        self.scored = Q.scored_of(tree)

    def _nears(self, node) -> list:
        if isinstance(node, Q.Near):
            return [node]
        parts = (node.keep, node.drop) if isinstance(node, Q.Without) else getattr(node, "parts", ())
        return [n for x in parts for n in self._nears(x)]

    def name(self, phrase, column: str | None = None) -> str:
        return f"p{phrase.number}" + (f"_{column}" if column else "")

    def grouped(self, postings: DataFrame) -> DataFrame:
        """A row for each note with any of the query's words: how often each phrase stands in each column."""
        wanted = [Q.hit(p, k) for p in self.phrases for k in range(len(p.terms))]
        sums = [F.sum(F.when(Q.hit(p, 0), F.col(c)).otherwise(0)).alias(self.name(p, c)) for p in self.counted for c in COLUMNS]
        lists = [F.array_sort(F.flatten(F.collect_list(F.when(Q.hit(p, k), F.col("places"))))).alias(f"{self.name(p)}_w{k}") for p in self.placed for k in range(len(p.terms))]
        found = postings.filter(reduce(Column.__or__, wanted)).groupBy("note_id").agg(*sums, *lists, F.max("length").alias("length"), F.max("updated").alias("updated"))
        found = found.withColumns({f"{self.name(p)}_at": Q.starts(p, [F.col(f"{self.name(p)}_w{k}") for k in range(len(p.terms))]) for p in self.placed})
        return found.withColumns({self.name(p, c): F.size(Q.in_column(F.col(f"{self.name(p)}_at"), i)) for p in self.placed for i, c in enumerate(TEXTS)})

    def often(self, phrase, arm: str | None) -> Column:
        """The weighted number of times that a phrase counts."""
        return _weighted({c: self.name(phrase, c) for c in ((arm,) if arm and phrase in self.bound else COLUMNS)})

    def holds(self, node, arm: str | None) -> Column:
        """Whether a note is found by a node of the tree."""
        if isinstance(node, Q.Phrase):
            return self.often(node, arm) > 0
        if isinstance(node, Q.Near):
            only = arm is not None and set(node.phrases) <= self.bound
            found = [Q.in_column(F.col(f"{self.name(p)}_at"), TEXTS.index(arm)) if only else F.col(f"{self.name(p)}_at") for p in node.phrases]
            return reduce(Column.__and__, (F.size(o) > 0 for o in found)) & Q.near(found, [len(p.terms) for p in node.phrases], node.within)
        if isinstance(node, Q.Without):
            return self.holds(node.keep, arm) & ~self.holds(node.drop, None)
        join = Column.__and__ if isinstance(node, Q.Both) else Column.__or__
        return reduce(join, (self.holds(x, arm) for x in node.parts))


def search(index, query: str, now: Column, limit: int | None = 200, where: Column | None = None) -> DataFrame:
    """(id, relevance) of the best notes of an index, all with limit None: BM25 of the query's phrases over all columns, and with its lead bound to title or tags, whichever is more, plus recency. where: a test of the notes' metadata. See query.Parser for the grammar.

    Only postings of the query's words are read, which are sorted by word, and they are grouped by note once. A blank query
    finds nothing; one that the grammar doesn't allow raises QueryError.
    """
    parser = Q.Parser(query, index.analyser.of_query)
    tree = parser.parse()
    if tree is None:
        return index.notes.select("id", F.lit(0.0).alias("relevance")).limit(0)
    total, average = index.statistics()
    matches = _Matches(tree, parser.lead)
    found = matches.grouped(index.table("postings"))
    arms = {(p, arm): matches.often(p, arm) for p in matches.scored for arm in _Matches.ARMS if arm is None or p in matches.bound}
    df = found.agg(*(F.count_if(v > 0).alias(f"n{i}") for i, v in enumerate(arms.values()))).first()  # a number for each part of the query
    often = dict(zip(arms, df, strict=True))

    def score(arm: str | None) -> Column:
        out = F.lit(0.0)
        for p in matches.scored:
            n, f = float(often[p, arm if p in matches.bound else None]), matches.often(p, arm)
            idf = F.greatest(F.log(F.lit((total - n + 0.5) / (n + 0.5))), F.lit(1e-6))
            out = out + idf * f * (BM25_K1 + 1) / (f + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / average))
        return F.when(matches.holds(tree, arm), out)

    hits = found.select(F.col("note_id").alias("id"), "updated", F.greatest(*(score(arm) for arm in _Matches.ARMS)).alias("score")).filter("score is not null")
    if where is not None:
        hits = hits.join(index.notes.filter(where).select("id"), "id", "left_semi")
    out = hits.select("id", (F.col("score") + recency(F.col("updated"), now)).alias("relevance")).orderBy(F.desc("relevance"), "id")
    return out if limit is None else out.limit(limit)


def to_digests(hits: DataFrame, canon: DataFrame) -> DataFrame:
    """Hits (id, relevance) moved to the digests that stand for them (canon: id, canonical), the best hit of each, with the way there."""
    moved = hits.join(canon, "id", "left").select(F.coalesce("canonical", "id").alias("to"), F.when(F.col("canonical") != F.col("id"), F.col("id")).alias("via"), "relevance")
    best = keep_latest(moved, ["to"], F.desc("relevance"), F.col("via").asc_nulls_first())
    return best.select(F.col("to").alias("id"), "relevance", "via")
