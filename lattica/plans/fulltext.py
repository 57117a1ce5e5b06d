"""Queries of the full-text grammar, by the places of words, and of the index of stems."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import search as T
from lattica.sources.index import placed

from .registry import Book
from .retrieval import NOW, ROUND, _arms
from .sql import POSTINGS

BOOK = Book()
add = BOOK.add
_TEXTS = "SELECT id, 'title' AS col, title AS x FROM notes UNION ALL SELECT id, 'body', body FROM notes UNION ALL SELECT id, 'tags', array_to_string(tags,' ') FROM notes"


def _places(text: str) -> str:
    return rf"tok AS MATERIALIZED (SELECT id AS note_id, col, unnest(l) AS term, unnest(range(len(l))) AS pos FROM (SELECT id, col, list_filter(string_split_regex({text},'[^\p{{L}}\p{{N}}]+'), lambda w: w<>'') AS l FROM ({_TEXTS})))"


#: Every word of every column with its place.
PLACES, FOLDED = _places("lower(x)"), _places("strip_accents(lower(x))")
IDS = "SELECT DISTINCT note_id AS id FROM "


def _has(*words: str) -> str:
    return "SELECT note_id FROM tok WHERE term IN (" + ",".join(f"'{w}'" for w in words) + ")"


def _pair(a: str, b: str, test: str) -> str:
    return f"tok x JOIN tok y ON x.note_id=y.note_id AND x.col=y.col AND x.term='{a}' AND y.term='{b}' AND {test}"


def _close(a: str, b: str, n: int) -> str:
    return _pair(a, b, f"abs(y.pos-x.pos)<={n + 1}")


def found(query: str):
    return lambda s: T.search(s.index, query, NOW(), None).select("id")


add("T3_phrase", found("the + and"), IDS.replace("note_id", "x.note_id") + _pair("the", "and", "y.pos=x.pos+1"), PLACES)
add("T3_near", found("NEAR(tion ble, 5)"), IDS.replace("note_id", "x.note_id") + _close("tion", "ble", 5), PLACES)
add("T3_near_default", found("NEAR(tion nt)"), IDS.replace("note_id", "x.note_id") + _close("tion", "nt", 10), PLACES)
add("T3_near_phrase", found("NEAR(of + the tion, 3)"), "SELECT DISTINCT x.note_id AS id FROM tok x JOIN tok y ON x.note_id=y.note_id AND x.col=y.col AND x.term='of' AND y.term='the' AND y.pos=x.pos+1 JOIN tok z ON z.note_id=x.note_id AND z.col=x.col AND z.term='tion' WHERE (z.pos>=x.pos AND z.pos-x.pos-2<=3) OR (z.pos<x.pos AND x.pos-z.pos-1<=3)", PLACES)
add("T3_near_three", found("NEAR(tion ble nt, 60)"), "SELECT DISTINCT e.note_id AS id FROM tok e WHERE e.term IN ('tion','ble','nt') AND " + " AND ".join(f"EXISTS (SELECT 1 FROM tok w WHERE w.note_id=e.note_id AND w.col=e.col AND w.term='{t}' AND w.pos BETWEEN e.pos-61 AND e.pos)" for t in ("tion", "ble", "nt")), PLACES)
add("T3_or_binds_least", found("therer OR ble tion"), IDS + f"tok WHERE term='therer' OR (note_id IN ({_has('ble')}) AND note_id IN ({_has('tion')}))", PLACES)
add("T3_parentheses", found("(therer OR ingand) NOT tion"), IDS + f"tok WHERE term IN ('therer','ingand') AND note_id NOT IN ({_has('tion')})", PLACES)
add("T3_not_takes_all_words", found("tion NOT ble nt"), IDS + f"tok WHERE term='tion' AND NOT (note_id IN ({_has('ble')}) AND note_id IN ({_has('nt')}))", PLACES)
add("T3_and_before_or", found("tion AND therer OR ble AND (ingand OR nt)"), IDS + f"tok WHERE (note_id IN ({_has('tion')}) AND note_id IN ({_has('therer')})) OR (note_id IN ({_has('ble')}) AND note_id IN ({_has('ingand', 'nt')}))", PLACES)
add("T3_first_of_column", found("^the"), IDS + "tok WHERE term='the' AND pos=0", PLACES)
add("T3_phrase_prefix", found("of + the*"), IDS.replace("note_id", "x.note_id") + "tok x JOIN tok y ON x.note_id=y.note_id AND x.col=y.col AND x.term='of' AND y.term LIKE 'the%' AND y.pos=x.pos+1", PLACES)
# A phrase as one term of its own, scored as a word is: its rows stand beside those of single words.
_SEL, _CTES = _arms(["the and", "tion"])
_PHRASES = "SELECT x.note_id, 'the and' AS term, x.col, count(*) AS cnt FROM " + _pair("the", "and", "y.pos=x.pos+1") + " GROUP BY ALL"
_CTES = PLACES + ",\n" + POSTINGS.replace("wpost AS (SELECT *,", f"units AS (SELECT * FROM post UNION ALL {_PHRASES}), wpost AS (SELECT *,").replace("AS wc FROM post)", "AS wc FROM units)") + _CTES.removeprefix(POSTINGS)
add("T3_phrase_scores", lambda s: ROUND(T.search(s.index, "the + and tion", NOW())), _SEL, _CTES)
add("S1_places", lambda s: placed(s.notes).select(F.explode("places").alias("p")).groupBy((F.col("p") % (1 << 32)).alias("place")).agg(F.count("*").alias("n")), "SELECT pos AS place, count(*) AS n FROM tok GROUP BY 1", PLACES)
#: The words of the tables that share Porter's stem with what is asked for.
_TION = ("tion", "tions", "tione", "tioned", "tiones", "tioning")
add("X3_stemmed_search", lambda s: T.search(s.stemmed, "tioning", NOW(), None).select("id"), f"SELECT DISTINCT note_id AS id FROM ({_has(*_TION)})", FOLDED)
add("X3_folded_search", lambda s: T.search(s.stemmed, "\u00c8que", NOW(), None).select("id"), f"SELECT DISTINCT note_id AS id FROM ({_has('eque', 'eques')})", FOLDED)
add("X3_stemmed_phrase", lambda s: T.search(s.stemmed, "thes + and", NOW(), None).select("id"), "SELECT DISTINCT x.note_id AS id FROM tok x JOIN tok y ON x.note_id=y.note_id AND x.col=y.col AND x.term IN ('the','thes') AND y.term='and' AND y.pos=x.pos+1", FOLDED)
