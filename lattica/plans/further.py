"""Queries for operators that the other modules use inside larger ones, each on its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.functions import text as X
from lattica.operators import filters as P
from lattica.operators import graph as G
from lattica.operators import ids as I
from lattica.operators import quality as Q
from lattica.operators import relational as R
from lattica.operators import search as T
from lattica.operators import similarity as M
from lattica.operators.compaction import canonical
from lattica.sources import markdown
from lattica.sources.index import Index
from lattica.sources.storage import new_path
from lattica.streaming import telemetry

from .exchange import _FILES
from .graphs import DIR, SEED, hops
from .registry import Book
from .retrieval import _NEAR, NOW, POSTINGS, RECENT, ROUND, SIG, VEC, _arms
from .textual import LINKED, SQL_LINKED

BOOK = Book()
add = BOOK.add
_HITCTES = _arms(["thtion"])[1]
add("F1_composite", lambda s: P.hide_compacted(s.notes.filter(P.note_filter(["de", "es"], "literature", None, 20)), s.compacts).select("id"), "SELECT id FROM notes WHERE list_has_any(tags,['de','es']) AND type='literature' AND coalesce(value,50)>=20 AND id NOT IN (SELECT source_id FROM compacts)")
add("F7_custom_grammar", lambda s: s.custom.filter(P.custom_filter(F.col("custom"), " value >= 10.5 ")).select("id"), "SELECT id FROM custom WHERE value>=10.5")
add("F22_value_bounds", lambda s: s.base.filter(P.min_value(F.col("value"), P.parse_min_value("100"))).select("id"), "SELECT id FROM notes WHERE value>=100")
add("S25_upsert_with_tags", lambda s: R.upsert(s.tags, s.spark.createDataFrame([("qp-3", "new")], "note_id string, tag string"), "note_id").groupBy("tag").agg(F.count("*").alias("n")), "SELECT tag, count(*) AS n FROM (SELECT note_id, tag FROM tags WHERE note_id<>'qp-3' UNION ALL SELECT 'qp-3','new') GROUP BY 1")
add("J1_hits_with_notes", lambda s: T.search(s.index, "thtion", NOW()).join(s.base.select("id", "title", "type"), "id").select("id", "title", "type"), "SELECT h.id, title, type FROM hits h JOIN notes n2 ON n2.id=h.id", _HITCTES)
add("J4_path_to_id", lambda s: LINKED(s).select("id", F.explode(X.markdown_links(F.col("b"))).alias("l")).select("id", X.id_in_target(F.col("l.target")).alias("dst")).join(s.base.select(F.col("id").alias("dst")), "dst"), "SELECT 'qp-'||doc_id AS id, 'qp-'||(doc_id+3) AS dst FROM documents, n WHERE doc_id+3<n.c")
add("J13_similar_pairs", lambda s: _NEAR(s, 0.95).select("id_a", "id_b"), "SELECT a.id AS id_a, b.id AS id_b FROM rvec a JOIN rvec b ON a.term=b.term AND a.id<b.id GROUP BY 1,2 HAVING sum(a.w*b.w)>=0.95", VEC + ", " + SIG)
add("J16_hit_to_digest", lambda s: T.to_digests(T.search(s.index, "thtion", NOW()), canonical(s.compacts)).filter("via is not null").select("id", "via"),
    "SELECT id, via FROM (SELECT coalesce(c2.digest_id,c1.digest_id,h.id) AS id, CASE WHEN c1.digest_id IS NOT NULL THEN h.id END AS via, row_number() OVER (PARTITION BY coalesce(c2.digest_id,c1.digest_id,h.id) ORDER BY relevance DESC, CASE WHEN c1.digest_id IS NOT NULL THEN h.id END NULLS FIRST) AS r FROM hits h LEFT JOIN compacts c1 ON c1.source_id=h.id LEFT JOIN compacts c2 ON c2.source_id=c1.digest_id) WHERE r=1 AND via IS NOT NULL", _HITCTES)
add("A7_max_over_arms", lambda s: s.index.postings.filter("term = 'thtion'").select("note_id", F.greatest(*T.COLUMNS).alias("most")), "SELECT note_id, max(cnt) AS most FROM post WHERE term='thtion' GROUP BY 1", POSTINGS)
add("U1_union_of_arms", lambda s: (lambda p: (lambda arm: arm("title").unionByName(arm("tags")).unionByName(arm("body")).unionByName(arm("title")))(lambda c: p.filter(F.col(c) > 0).select("note_id")))(s.index.postings.filter("term = 'thtion'")).groupBy("note_id").agg(F.count("*").alias("n")), "SELECT note_id, count(*) AS n FROM (SELECT note_id FROM post WHERE term='thtion' UNION ALL SELECT note_id FROM post WHERE term='thtion' AND col='title') GROUP BY 1", POSTINGS)
add("O3_top_hits", lambda s: ROUND(T.search(s.index, "thtion", NOW(), 7)), *_arms(["thtion"], limit=7))
add("O5_digest_order", lambda s: T.to_digests(T.search(s.index, "thtion", NOW(), 50), canonical(s.compacts)).select("id", F.row_number().over(Window.orderBy(F.desc("relevance"), "id")).alias("place")), "SELECT id, row_number() OVER (ORDER BY max(relevance) DESC, id) AS place FROM (SELECT coalesce(c2.digest_id,c1.digest_id,h.id) AS id, relevance FROM hits h LEFT JOIN compacts c1 ON c1.source_id=h.id LEFT JOIN compacts c2 ON c2.source_id=c1.digest_id) GROUP BY id", _arms(["thtion"], limit=50)[1])
add("O6_similar_order", lambda s: M.similar_to(s.index.postings, s.size, "qp-9", 0.05, 10).withColumn("score", F.round("score", 6)), "SELECT b.id, round(sum(a.w*b.w),6) AS score FROM vec a JOIN vec b USING (term) WHERE a.id='qp-9' AND b.id<>'qp-9' GROUP BY 1 HAVING sum(a.w*b.w)>=0.05 ORDER BY sum(a.w*b.w) DESC, b.id LIMIT 10", VEC)
add("O9_tree_order", lambda s: G.tree(G.directed(s.edges, "out"), SEED(s, "qp-1"), 2).orderBy("hop", "link_type", "id").select("id", "hop"), "SELECT id, cost::INT AS hop FROM h2", hops("h", "qp-1", 2, "edges"))
add("X3_stemmed_index", lambda s: (lambda p: p.join(X.stems(p.select("term")), "term").groupBy("stem").agg(F.sum("count").alias("n")))(s.base.select(F.explode(X.tokens(F.col("body"))).alias("term")).groupBy("term").agg(F.count("*").alias("count"))))
add("X9_attachment_targets", lambda s: LINKED(s).select("id", F.get(X.attachments(F.col("b")), F.lit(0)).alias("name")), "SELECT id, 'a'||(doc_id%5)||'.png' AS name FROM notes")
add("X13_rename_in_bodies", lambda s: LINKED(s).select("id", X.rewrite_ids(X.rewrite_ids(F.col("b"), "qp-3", "qp-3-1"), "qp-4", "qp-4-1").alias("b")), r"SELECT id, regexp_replace(regexp_replace(b,'\bqp-3\b','qp-3-1','g'),'\bqp-4\b','qp-4-1','g') AS b FROM linked", SQL_LINKED)
add("X35_cosine", lambda s: (lambda v: v.filter("id = 'qp-1'").select("term", F.col("w").alias("a")).join(v.filter("id = 'qp-6'"), "term").agg(F.round(F.coalesce(F.sum(F.col("a") * F.col("w")), F.lit(0.0)), 6).alias("cosine")))(M.vectors(s.index.postings, s.size, ["qp-1", "qp-6"])), "SELECT round(coalesce(sum(a.w*b.w),0),6) AS cosine FROM vec a JOIN vec b USING (term) WHERE a.id='qp-1' AND b.id='qp-6'", VEC)
add("X39_scalar_types", lambda s: s.custom.select("id", F.schema_of_variant(F.try_parse_json(F.get_json_object("custom", "$.k"))).alias("kind")), "SELECT id, CASE WHEN k IS NULL THEN NULL ELSE 'BIGINT' END AS kind FROM custom")
add("X40_nested_json", lambda s: s.custom.select("id", F.try_variant_get(F.parse_json("custom"), "$.kind", "string").alias("kind")), "SELECT id, kind FROM custom")
add("T_recency", lambda s: s.base.select("id", F.round(X.recency(F.col("updated"), NOW()), 6).alias("boost")), f"SELECT id, round({RECENT},6)::DOUBLE AS boost FROM notes")
add("D2_invalid_frontmatter", lambda s: Q.issue(markdown.parse(_FILES(s)).filter("error is not null"), "error", "invalid-frontmatter", "path", F.col("error")), "SELECT 'error' AS severity, 'invalid-frontmatter' AS category, 'notes/'||id||'.md' AS note_id, 'no head' AS detail FROM notes WHERE doc_id%25=3")
add("P13_workspace_slice", lambda s: (lambda near: s.base.join(near, "id", "left_semi").select("id", "title"))(G.distances(G.directed(s.edges), SEED(s, "qp-3"), 2).select("id")), "SELECT id, title FROM notes WHERE id IN (SELECT id FROM a2)", DIR + ", " + hops("a", "qp-3", 2, "dir"))

#: Every tenth note is there already, by six letters of its hash.
_HASH = lambda s: s.base.select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("body", F.lit(""))).cast("binary"), 256).alias("hash"))
add("X22_shortest_ids", lambda s: I.shortest_ids(I.apart(_HASH(s).filter("doc_id % 10 <> 0").withColumnRenamed("doc_id", "key")), _HASH(s).filter("doc_id % 10 = 0").select(F.concat(F.lit("qp-"), F.substring("hash", 1, 6)).alias("id"))),
    "SELECT key, 'qp-'||substr(h,1,greatest(4,1+coalesce(max(k),0))::INT) AS id FROM (SELECT a.doc_id AS key, a.h, len(list_filter(range(1,65), lambda n: substr(a.h,1,n::INT)=substr(b.h,1,n::INT) AND n<=len(b.h))) AS k FROM x a LEFT JOIN x b ON substr(a.h,1,4)=substr(b.h,1,4) AND a.doc_id<>b.doc_id WHERE a.doc_id%10<>0) GROUP BY key, h",
    "x AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id%10=0 THEN substr(h,1,6) ELSE h END AS h FROM (SELECT doc_id, sha256(doc_id||':'||coalesce(body,'')) AS h FROM notes))")


def synced(s):
    """An index of an older state brought to the notes as they are, and the checks after it."""
    index = Index(s.spark, new_path(s.spark, "synced"))
    notes = s.notes.withColumn("body", F.lit(""))
    index.build(notes.filter("doc_id % 10 <> 3").withColumn("updated", F.when(F.col("doc_id") % 10 == 4, F.lit("2020-01-01").cast("timestamp")).otherwise(F.col("updated"))), s.edges)
    index.put(notes.filter("id = 'qp-1'").withColumn("id", F.lit("qp-gone")), s.edges.limit(0))
    changed, gone = index.sync(notes, s.edges)
    done = s.spark.createDataFrame([("changed", changed), ("gone", gone), ("indexed", index.notes.count())], "what string, n long")
    checks = Q.broken_links(s.unresolved).unionByName(Q.invalid_values(s.base.withColumn("value", F.col("value") + 20))).unionByName(Q.empty_collections(s.base, s.edges.filter("src <> 'qp-20'")))
    return done.unionByName(checks.groupBy(F.col("category").alias("what")).agg(F.count("*").alias("n")))


add("P17_sync", synced, "SELECT 'changed' AS what, count(*) FILTER (doc_id%10=3 OR (doc_id%10=4)) AS n FROM notes UNION ALL SELECT 'gone', 1 UNION ALL SELECT 'indexed', count(*) FROM notes UNION ALL SELECT 'broken-link', count(*) FROM unresolved UNION ALL SELECT 'invalid-value', count(*) FROM notes WHERE value+20>100 UNION ALL SELECT 'empty-moc', 1")


def streamed(s):
    """The events written as files, streamed through the daily roll-up, and read back; days that the watermark hasn't passed stay open."""
    where = new_path(s.spark, "stream")
    s.telemetry.write.mode("overwrite").parquet(f"{where}/in")
    stream = s.spark.readStream.schema(s.telemetry.schema).parquet(f"{where}/in")
    telemetry.stream_daily(stream, f"{where}/out", f"{where}/state").awaitTermination()
    return s.spark.read.parquet(f"{where}/out").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "command", "succeeded", "failed")


add("R3_streamed_days", streamed, "SELECT strftime(ts,'%Y-%m-%d') AS day, command, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM telemetry GROUP BY 1,2 HAVING any_value(date_trunc('day',ts))+INTERVAL 1 DAY<=(SELECT max(ts) FROM telemetry)-INTERVAL 7 DAY")


def rerun(s):
    """Notes that come as files, indexed a file at a time by a stream that breaks off after two batches and is started again: how often each note was put in."""
    path = new_path(s.spark, "rerun")
    s.base.select("id").repartition(4, "id").write.parquet(f"{path}/in")
    stream = lambda: s.spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    for most in (2, None):
        telemetry.stream_batches(stream(), f"{path}/out", f"{path}/state", most)
    return telemetry.batches(s.spark, f"{path}/out").groupBy("id").agg(F.count("*").alias("n"))


add("R5_resume_batches", rerun, "SELECT id, 1 AS n FROM notes")
add("R6_latest_versions", lambda s: R.keep_latest(s.table("events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type"), "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1")


def in_weeks(s) -> str:
    """The events as files of a week each, written one after the other, so that a stream reads them in that order."""
    where = new_path(s.spark, "weeks")
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
    for i in range(5):
        s.telemetry.filter(week == i if i < 4 else week >= 4).coalesce(1).write.parquet(f"{where}/in/{i}")
    return where


def _weekly(s, where: str):
    return s.spark.readStream.schema(s.telemetry.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{where}/in")


def buffered(s):
    """What the bounded buffer holds after the stream, by command."""
    where = in_weeks(s)
    telemetry.stream_newest(_weekly(s, where), f"{where}/out", f"{where}/state", 1000)
    return telemetry.kept_newest(s.spark, f"{where}/out").groupBy("command").agg(F.count("*").alias("n"))


def sent(s):
    """Batches of a hundred events that the stream has sent for each day, and the rest of days that the watermark has passed."""
    where = in_weeks(s)
    telemetry.stream_sessions(_weekly(s, where), f"{where}/out", f"{where}/state", 10).awaitTermination()
    out = s.spark.read.schema("day date, number long, events long, whole boolean").parquet(f"{where}/out")
    return out.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count_if("whole").alias("batches"), F.coalesce(F.sum(F.when(~F.col("whole"), F.col("events"))), F.lit(0)).alias("rest")).filter("batches > 0 or rest > 0")


add("R1_streamed_buffer", buffered, "SELECT command, count(*) AS n FROM (SELECT * FROM telemetry ORDER BY ts DESC, command, duration_ms LIMIT 1000) GROUP BY 1")
add("R4_streamed_batches", sent, "SELECT day, n//10 AS batches, CASE WHEN over THEN n%10 ELSE 0 END::BIGINT AS rest FROM (SELECT strftime(ts,'%Y-%m-%d') AS day, count(*) AS n, any_value(date_trunc('day',ts))+INTERVAL 1 DAY<=(SELECT max(ts) FROM telemetry)-INTERVAL 7 DAY AS over FROM telemetry GROUP BY 1) WHERE n//10>0 OR (over AND n%10>0)")
