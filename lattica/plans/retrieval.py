"""Queries for the index, full-text search and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import search as T
from lattica.operators import similarity as M
from lattica.operators.compaction import canonical
from lattica.sources.index import counted

from .registry import Book
from .sql import POSTINGS

BOOK = Book()
add = BOOK.add
NOW = lambda: F.lit("2025-02-01").cast("timestamp")
RECENT = "0.1/(1+coalesce((epoch(TIMESTAMP '2025-02-01')-epoch(updated))/86400.0::DOUBLE,0)/7.0)"


def _arms(words: list[str], where: str = "true", limit: int = 200) -> tuple[str, str]:
    case = lambda scope: "CASE " + " ".join(f"WHEN term='{w}'{f' AND col={scope!r}' if scope and i == 0 else ''} THEN {i}" for i, w in enumerate(words)) + " END"
    ctes = [POSTINGS, "lens AS (SELECT note_id, sum(cnt)::DOUBLE AS len FROM post GROUP BY 1)", "tot AS (SELECT count(*) AS n, avg(len) AS a FROM lens)"]
    for i, scope in enumerate((None, "title", "tags")):
        ctes.append(f"g{i} AS (SELECT note_id, g, sum(wc) AS f FROM (SELECT *, {case(scope)} AS g FROM wpost) WHERE g IS NOT NULL GROUP BY ALL)")
        ctes.append(f"s{i} AS (SELECT note_id, sum(greatest(ln((tot.n-d.n+0.5)/(d.n+0.5)),1e-6)*f*2.2/(f+1.2*(0.25+0.75*len/tot.a))) AS score FROM g{i} JOIN (SELECT g, count(*) AS n FROM g{i} GROUP BY 1) d USING (g) JOIN lens USING (note_id), tot GROUP BY 1 HAVING count(*)={len(words)})")
    ctes.append(f"hits AS (SELECT id, max(score)+any_value({RECENT}) AS relevance FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) JOIN notes ON id=note_id WHERE {where} GROUP BY id ORDER BY relevance DESC, id LIMIT {limit})")
    return "SELECT id, round(relevance,6) AS relevance FROM hits", ",\n".join(ctes)


def by_column(rows):
    """(col, n, notes): postings and notes that have any, by column."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("n")) for c in T.COLUMNS)))
    return rows.select("note_id", each.alias("x")).filter("x.n > 0").groupBy("x.col").agg(F.sum("x.n").alias("n"), F.count_distinct("note_id").alias("notes"))


ROUND = lambda d: d.withColumn("relevance", F.round("relevance", 6))
SCORE = lambda d: d.withColumn("score", F.round("score", 6))
add("A8_term_frequency", lambda s: T.term_weights(s.index.postings).groupBy("term").agg(F.sum("tf").alias("tf"), F.max("tf").alias("most")), "SELECT term, sum(tf) AS tf, max(tf) AS most FROM tf GROUP BY 1", POSTINGS)
add("A9_document_frequency", lambda s: T.statistics(s.index.postings)[0], "SELECT term, count(*) AS df FROM tf GROUP BY 1", POSTINGS)
add("A9_document_length", lambda s: T.statistics(s.index.postings)[1], "SELECT note_id, sum(floor(tf))::BIGINT AS doc_len FROM tf GROUP BY 1", POSTINGS)
add("S16_basic_index", lambda s: by_column(counted(s.notes.withColumn("body", F.lit("")))).filter("col <> 'body'").select("col", "n"), "SELECT col, sum(cnt)::BIGINT AS n FROM post WHERE col<>'body' GROUP BY 1", POSTINGS)
add("S1_full_index", lambda s: by_column(counted(s.notes)), "SELECT col, sum(cnt)::BIGINT AS n, count(DISTINCT note_id) AS notes FROM post GROUP BY 1", POSTINGS)
add("T1_search", lambda s: ROUND(T.search(s.index, "thtion", NOW())), *_arms(["thtion"]))
add("T2_search_two_words", lambda s: ROUND(T.search(s.index, "er-re thtion", NOW())), *_arms(["er", "re", "thtion"]))
add("F14_search_filtered", lambda s: ROUND(T.search(s.index, "re er", NOW(), 100, F.col("type").isin("permanent", "moc") & (F.coalesce("value", F.lit(50)) >= 30))), *_arms(["re", "er"], "type IN ('permanent','moc') AND coalesce(value,50)>=30", 100))
add("T3_or_not_prefix", lambda s: T.search(s.index, "therer OR ingand NOT token", NOW(), None).select("id"), "SELECT DISTINCT note_id AS id FROM post WHERE term='therer' OR (term='ingand' AND note_id NOT IN (SELECT note_id FROM post WHERE term='token'))", POSTINGS)
add("T3_prefix", lambda s: T.search(s.index, "ingthe*", NOW(), None).select("id"), "SELECT DISTINCT note_id AS id FROM post WHERE term LIKE 'ingthe%'", POSTINGS)
_SEL, _CTES = _arms(["thtion"])
add("T4_hits_to_digests", lambda s: ROUND(T.to_digests(T.search(s.index, "thtion", NOW()), canonical(s.compacts))).select("id", "relevance", "via"),
    "SELECT id, round(relevance,6) AS relevance, via FROM (SELECT coalesce(c2.digest_id,c1.digest_id,h.id) AS id, relevance, CASE WHEN c1.digest_id IS NOT NULL THEN h.id END AS via, row_number() OVER (PARTITION BY coalesce(c2.digest_id,c1.digest_id,h.id) ORDER BY relevance DESC, CASE WHEN c1.digest_id IS NOT NULL THEN h.id END NULLS FIRST) AS r FROM hits h LEFT JOIN compacts c1 ON c1.source_id=h.id LEFT JOIN compacts c2 ON c2.source_id=c1.digest_id) WHERE r=1", _CTES)
VEC = POSTINGS + ", dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w0 AS (SELECT note_id AS id, term, tf*(ln(((SELECT c FROM n)+1.0)/(df+1.0))+1) AS w FROM tf JOIN dfs USING (term)), vec AS MATERIALIZED (SELECT id, term, w/sqrt(sum(w*w) OVER (PARTITION BY id)) AS w FROM w0)"
_V = lambda s: M.vectors(s.index.postings, s.size)
add("X34_tfidf", lambda s: _V(s).groupBy("id").agg(F.round(F.max("w"), 6).alias("top"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("norm")), "SELECT id, round(max(w),6) AS top, round(sum(w*w),6) AS norm FROM vec GROUP BY 1", VEC)
add("T5_pair_similarity", lambda s: SCORE(M.cosines_to(M.vectors(s.index.postings, s.size, ["qp-1", "qp-6"]), "qp-1")), "SELECT b.id, round(sum(a.w*b.w),6) AS score FROM vec a JOIN vec b USING (term) WHERE a.id='qp-1' AND b.id='qp-6' GROUP BY 1", VEC)
add("T6_similar", lambda s: SCORE(M.similar_to(s.index.postings, s.size, "qp-6", 0.1, 50)), "SELECT b.id, round(sum(a.w*b.w),6) AS score FROM vec a JOIN vec b USING (term) WHERE a.id='qp-6' AND b.id<>'qp-6' GROUP BY 1 HAVING sum(a.w*b.w)>=0.1 ORDER BY sum(a.w*b.w) DESC, b.id LIMIT 50", VEC)
SIG = "sig AS MATERIALIZED (SELECT note_id AS id, list_sort(list((term, tf))) AS l FROM tf GROUP BY 1), rep AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY l) AS rep FROM sig), rvec AS MATERIALIZED (SELECT * FROM vec WHERE id IN (SELECT rep FROM rep))"
_NEAR = lambda s, t: M.near_duplicates(s.index.postings, s.size, t)
add("T7_near_duplicates", lambda s: SCORE(_NEAR(s, 0.85)), "SELECT a.id AS id_a, b.id AS id_b, round(sum(a.w*b.w),6) AS score FROM rvec a JOIN rvec b ON a.term=b.term AND a.id<b.id GROUP BY 1,2 HAVING sum(a.w*b.w)>=0.85", VEC + ", " + SIG)
add("T7_copies", lambda s: M.copies(s.index.postings), "SELECT id, rep FROM rep", VEC + ", " + SIG)
add("T7_classes", lambda s: M.duplicate_classes(s.index.postings, s.size, 0.85), "SELECT rep.id, rep.rep, coalesce((SELECT min(b) FROM reach WHERE a=rep.rep AND b<=rep.rep),rep.rep) AS class_id, (SELECT count(*) FROM near WHERE x=rep.rep) AS n_links FROM rep",
    VEC + ", " + SIG + ", half AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM rvec a JOIN rvec b ON a.term=b.term AND a.id<b.id GROUP BY 1,2 HAVING sum(a.w*b.w)>=0.85), near AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half), reach AS (SELECT x AS a, y AS b FROM near UNION SELECT r.a, n2.y FROM reach r JOIN near n2 ON n2.x=r.b)", True)
_TAGS = "SELECT b.note_id AS id, count(*)/(any_value(nb.n)+any_value(na.n)-count(*)) AS score FROM tags a JOIN tags b ON a.tag=b.tag AND b.note_id<>a.note_id JOIN (SELECT note_id, count(*) AS n FROM tags GROUP BY 1) na ON na.note_id=a.note_id JOIN (SELECT note_id, count(*) AS n FROM tags GROUP BY 1) nb ON nb.note_id=b.note_id WHERE a.note_id='qp-6' GROUP BY 1 ORDER BY score DESC, id LIMIT {}"
add("T8_shared_tags", lambda s: SCORE(M.shared_tags(s.tags, "qp-6", 40)), f"SELECT id, round(score,6) AS score FROM ({_TAGS.format(40)})")
BOTH = "b2 AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"
_HOP = "SELECT dst AS id, count(*)::DOUBLE AS score FROM b2 WHERE src IN (SELECT dst FROM b2 WHERE src='qp-6') AND dst<>'qp-6' AND dst NOT IN (SELECT dst FROM b2 WHERE src='qp-6') GROUP BY 1 ORDER BY score DESC, id LIMIT {}"
add("T9_second_neighbours", lambda s: M.second_neighbours(s.edges, "qp-6", 40), _HOP.format(40), BOTH)
add("J14_second_neighbours_all", lambda s: M.second_neighbours(s.edges, "qp-30", None), _HOP.removesuffix(" ORDER BY score DESC, id LIMIT {}").replace("qp-6", "qp-30"), BOTH)
add("T10_related", lambda s: SCORE(M.related([M.similar_to(s.index.postings, s.size, "qp-6", 0.3, 100), M.shared_tags(s.tags, "qp-6", 100), M.second_neighbours(s.edges, "qp-6", 100)], s.edges.filter("src = 'qp-6'").select(F.col("dst").alias("id")))).select("id", "score"),
    f"SELECT id, round(max(score),6) AS score FROM (SELECT * FROM (SELECT b.id, sum(a.w*b.w) AS score FROM vec a JOIN vec b USING (term) WHERE a.id='qp-6' AND b.id<>'qp-6' GROUP BY 1 HAVING sum(a.w*b.w)>=0.3 ORDER BY score DESC, b.id LIMIT 100) UNION ALL SELECT * FROM ({_TAGS.format(100)}) UNION ALL SELECT * FROM ({_HOP.format(100)})) WHERE id NOT IN (SELECT dst FROM edges WHERE src='qp-6') GROUP BY 1", VEC + ", " + BOTH)
