"""Queries for scans, filters, joins, aggregations, windows, orders and set operations."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text as X
from lattica.operators import filters as P
from lattica.operators import relational as R
from lattica.sources import markdown
from lattica.sources.index import Index
from lattica.sources.storage import new_path

from .registry import Book
from .sql import POSTINGS

BOOK = Book()
add = BOOK.add
START = datetime(2024, 6, 1, tzinfo=timezone.utc)
DAY = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
SQL_META = "id, title, type, coalesce(value,-1) AS value, strftime(created,'%Y-%m-%d') AS created, strftime(updated,'%Y-%m-%d') AS updated, verified, array_to_string(tags,',') AS tags"
SQL_MTIME = "(doc_id*37)%1000"


def meta(n: DataFrame) -> DataFrame:
    return n.select("id", "title", "type", F.coalesce("value", F.lit(-1)).alias("value"), DAY("created"), DAY("updated"), "verified", F.array_join("tags", ",").alias("tags"))


def mtimes(s, factor: int = 37) -> DataFrame:
    """(id, mtime): stand-in times of change by number."""
    return s.table("documents").select(F.concat(F.lit("qp-"), F.col("doc_id")).alias("id"), (F.col("doc_id") * factor % 1000).alias("mtime"), "doc_id")


# Scans
add("list_filtered", lambda s: meta(R.list_order(s.index.notes.filter(P.note_filter(["en", "fr"], "permanent", START, 40)))), f"SELECT {SQL_META} FROM notes WHERE list_has_any(tags,['en','fr']) AND type='permanent' AND created>=TIMESTAMP '2024-06-01' AND coalesce(value,50)>=40")
add("S2_count_files", lambda s: markdown.files(s.spark, s.folder).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM documents")
add("S6_table_scan", lambda s: R.list_order(s.notes).select("id", "title", F.octet_length("body").cast("long").alias("bytes"), "type", F.coalesce("value", F.lit(-1)).alias("value"), DAY("created"), "verified"), "SELECT id, title, strlen(body)::BIGINT AS bytes, type, coalesce(value,-1) AS value, strftime(created,'%Y-%m-%d') AS created, verified FROM notes")
add("S7_filtered_scan", lambda s: s.index.notes.filter(F.array_contains("tags", "en") & (F.col("type") == "literature") & (F.col("created") >= F.lit(START))).select("id", "title"), "SELECT id, title FROM notes WHERE type='literature' AND created>=TIMESTAMP '2024-06-01' AND id IN (SELECT note_id FROM tags WHERE tag='en')")
add("S8_point_lookup", lambda s: s.notes.filter("id = 'qp-17'").select("id", "title", "body", "type"), "SELECT id, title, body, type FROM notes WHERE id='qp-17'")
add("S9_metadata_lookup", lambda s: meta(s.index.notes.filter("id = 'qp-17'")), f"SELECT {SQL_META} FROM notes WHERE id='qp-17'")
add("S10_id_listing", lambda s: s.base.select("id").orderBy("id"), "SELECT id FROM notes")
add("S12_resolve_id", lambda s: R.resolve(s.base, "qp-21-some-slug.md").select("id", "title").unionByName(R.resolve(s.base, "the").select("id", "title")), "SELECT id, title FROM notes WHERE id='qp-21' UNION ALL (SELECT id, title FROM notes WHERE contains(title,'the') ORDER BY id LIMIT 1)")
add("S11_lookup_by_id_or_title", lambda s: s.base.filter((F.col("id") == "qp-5") | (F.col("title") == "qp-5")).select("id"), "SELECT id FROM notes WHERE id='qp-5' OR title='qp-5'")
add("S13_snapshot_diff", lambda s: R.snapshot_diff(mtimes(s).filter("doc_id % 13 <> 0"), mtimes(s, 37).filter("doc_id % 17 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 5 == 0, F.lit(-1)).otherwise(F.col("mtime"))), "id", ["mtime"]),
    "SELECT id, CASE WHEN doc_id%13=0 THEN 'insert' WHEN doc_id%17=0 THEN 'delete' ELSE 'update' END AS change FROM notes WHERE (doc_id%13=0)<>(doc_id%17=0) OR (doc_id%13<>0 AND doc_id%17<>0 AND doc_id%5=0)")
add("S14_changed", lambda s: mtimes(s).alias("a").join(mtimes(s, 41).alias("b"), "id").filter(~F.col("a.mtime").eqNullSafe(F.col("b.mtime"))).select("id"), "SELECT id FROM notes WHERE doc_id*37%1000<>doc_id*41%1000")
add("S15_deleted", lambda s: s.base.select("id").join(s.base.filter("doc_id % 9 <> 0").select("id"), "id", "left_anti"), "SELECT id FROM notes WHERE doc_id%9=0")
add("S17_quick_index", lambda s: R.quick(s.base, 100).select("id", "type"), "SELECT id, type FROM notes WHERE type='moc' UNION ALL (SELECT id, type FROM notes WHERE type<>'moc' ORDER BY updated DESC NULLS LAST, id LIMIT 100)")
add("S18_adaptive_index", lambda s: (s.base if s.size < 10_000 else R.quick(s.base, 100)).select("id"), "SELECT id FROM notes WHERE (SELECT c FROM n)<10000 OR type='moc' OR id IN (SELECT id FROM notes WHERE type<>'moc' ORDER BY updated DESC NULLS LAST, id LIMIT 100)")
_BATCH = "('0x'||substr(md5(id),1,8))::BIGINT%4"


def resumed(s):
    """An index built in four batches, interrupted after two: what each of the two runs has indexed."""
    index = Index(s.spark, new_path(s.spark, "resumed"))
    notes = s.notes.withColumn("body", F.lit(""))
    first, second = index.build(notes, s.edges, 4, most=2), index.build(notes, s.edges, 4)
    run = {k: 1 for k in first} | {k: 2 for k in second}
    return index.notes.select("id", Index.batch(F.col("id"), 4).alias("batch")).join(index.postings.groupBy(F.col("note_id").alias("id")).agg(F.sum(F.col("title") + F.col("tags")).alias("terms")), "id").withColumn("run", F.element_at(F.create_map(*(F.lit(x) for kv in run.items() for x in kv)), F.col("batch")))


add("S19_resume", resumed, f"SELECT id, {_BATCH} AS batch, sum(cnt)::BIGINT AS terms, CASE WHEN {_BATCH}<2 THEN 1 ELSE 2 END AS run FROM (SELECT note_id AS id, cnt FROM post WHERE col<>'body') GROUP BY id", POSTINGS)


def upserted(s):
    """An index in which one note is put in anew, one is taken out and another gets a link."""
    index = Index(s.spark, new_path(s.spark, "upserted"))
    notes = s.notes.withColumn("body", F.lit(""))
    index.build(notes, s.edges)
    index.put(notes.filter("id = 'qp-3'").withColumn("title", X.upper(F.col("title"))), s.edges.filter("src = 'qp-3'").limit(0))
    index.delete(s.base.filter("id = 'qp-5'").select("id"))
    index.merge()
    links = index.links.filter("provenance <> 'virtual'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("links"))
    return index.notes.select("id", "title").join(links, "id", "left").na.fill(0, ["links"])


add("S20_upsert_one", upserted, "SELECT id, CASE WHEN id='qp-3' THEN upper(title) ELSE title END AS title, CASE WHEN id='qp-3' THEN 0 ELSE (SELECT count(*) FROM edges WHERE src=id) END AS links FROM notes WHERE id<>'qp-5'")
add("S21_selective_index", lambda s: s.base.filter("type = 'permanent'").filter(F.array_contains("own_tags", "en")).orderBy(F.col("updated").desc_nulls_last(), "id").limit(20).filter(F.col("updated") >= F.lit(START)).select("id"), "SELECT id FROM (SELECT * FROM notes WHERE type='permanent' AND list_contains(tags,'en') ORDER BY updated DESC NULLS LAST, id LIMIT 20) WHERE updated>=TIMESTAMP '2024-06-01'")
add("S22_collection_members", lambda s: R.outbound(s.edges, "qp-10").select(F.col("dst").alias("id")).union(s.base.filter("id = 'qp-10'").select("id")).distinct(), "SELECT dst AS id FROM edges WHERE src='qp-10' UNION SELECT 'qp-10'")
add("S23_most_recent", lambda s: R.first_n(s.base, 25, F.col("updated").desc_nulls_last()).select("id"), "SELECT id FROM notes ORDER BY updated DESC NULLS LAST, id LIMIT 25")
add("S24_quick_filter", lambda s: R.quick(s.base.filter("value > 20"), 100).select("id"), "SELECT id FROM notes WHERE value>20 AND type='moc' UNION ALL (SELECT id FROM notes WHERE value>20 AND type<>'moc' ORDER BY updated DESC NULLS LAST, id LIMIT 100)")
add("S26_replace_edges", lambda s: R.upsert(s.edges.select("src", "dst", "link_type"), s.spark.createDataFrame([("qp-4", "qp-9", "refines")], "src string, dst string, link_type string"), "src"), "SELECT src, dst, link_type FROM edges WHERE src<>'qp-4' UNION ALL SELECT 'qp-4','qp-9','refines'")
add("S27_delete_note", lambda s: s.edges.filter("src <> 'qp-7' and dst <> 'qp-7'").select("src", "dst", "link_type"), "SELECT src, dst, link_type FROM edges WHERE src<>'qp-7' AND dst<>'qp-7'")
# Filters
add("F2_hide_compacted", lambda s: P.hide_compacted(s.base, s.compacts).select("id"), "SELECT id FROM notes WHERE id NOT IN (SELECT source_id FROM compacts)")
add("F3_tag_any", lambda s: s.notes.filter(P.has_tag(F.col("tags"), P.equivalent_tags("tox", {"toxic": "tox", "bad": "tox"}))).select("id"), "SELECT id FROM notes WHERE list_has_any(tags,['tox','toxic','bad'])")
add("F4_type", lambda s: s.base.filter(P.note_filter(kind="MOC")).select("id"), "SELECT id FROM notes WHERE type='moc'")
add("F5_since", lambda s: s.base.filter(P.since(F.col("created"), START)).select("id"), "SELECT id FROM notes WHERE created>=TIMESTAMP '2024-06-01'")
add("F6_min_value", lambda s: s.base.filter(P.min_value(F.col("value"), 50)).select("id", R.effective_value(F.col("value")).alias("value")), "SELECT id, coalesce(value,50) AS value FROM notes WHERE coalesce(value,50)>=50")
for name, expression, sql in [
    ("F8_absent", "!day", "day IS NULL"), ("F8_present", "day", "day IS NOT NULL"), ("F9_equals", "kind = click", "kind='click'"), ("F9_equals_number", "k=26", "k=26"),
    ("F10_date", "day>=2024-01-02", "day>='2024-01-02'"), ("F11_number", "value>20.5", "value>20.5"), ("F11_text_as_number", "code>50", "k>50"), ("F7_order_of_signs", "k<=40", "k<=40"),
]:
    add(name, lambda s, x=expression: s.custom.filter(P.lenient_custom_filter(F.col("custom"), x)).select("id"), f"SELECT id FROM custom WHERE {sql}")
add("F12_bad_expression", lambda s: s.custom.select("id", P.lenient_custom_filter(F.col("custom"), "k>abc").alias("bad"), P.lenient_custom_filter(F.col("custom"), "k>50").alias("good")), "SELECT id, false AS bad, coalesce(k>50,false) AS good FROM custom")
add("F13_alias_expansion", lambda s: s.tags.filter(F.col("tag").isin(P.equivalent_tags("german", {"german": "de", "deutsch": "de"}))).select("note_id").distinct(), "SELECT DISTINCT note_id FROM tags WHERE tag IN ('german','de','deutsch')")
add("F15_exclude_after_limit", lambda s: s.base.orderBy(F.col("value").desc_nulls_last(), "id").limit(200).filter("type <> 'moc'").select("id"), "SELECT id FROM (SELECT * FROM notes ORDER BY value DESC NULLS LAST, id LIMIT 200) WHERE type<>'moc'")
add("F16_edge_filter", lambda s: P.edge_filter(s.edges, typed_only=True, exclude=["follows"]).select("src", "dst", "link_type"), "SELECT src, dst, link_type FROM edges WHERE NOT inline AND link_type<>'follows'")
add("F17_traversal_filter", lambda s: P.edge_filter(s.edges, include=["related", "part-of"]).select("src", "dst", "link_type"), "SELECT src, dst, link_type FROM edges WHERE link_type IN ('related','part-of')")
add("F18_inbox", lambda s: P.inbox(s.base, s.edges, s.compacts, True).select("id", "type"), "SELECT id, type FROM notes WHERE type IN ('fleeting','literature') AND id NOT IN (SELECT source_id FROM compacts) AND id NOT IN (SELECT dst FROM edges JOIN notes m ON m.id=src WHERE m.type='moc')")
add("F19_relative_time", lambda s: s.base.filter(F.col("updated") >= F.lit(P.parse_time("30 days ago", datetime(2024, 7, 1, tzinfo=timezone.utc)))).select("id"), "SELECT id FROM notes WHERE updated>=TIMESTAMP '2024-06-01'")
add("F20_all_filters", lambda s: s.base.join(s.custom, "id").filter(P.note_filter(least=30, custom="k>50")).filter(P.lenient_custom_filter(F.col("custom"), "kind=view")).select("id"), "SELECT id FROM notes JOIN custom c USING (id) WHERE coalesce(notes.value,50)>=30 AND k>50 AND kind='view'")
add("F21_substring", lambda s: P.contains(s.base, "tion the").select("id"), "SELECT id FROM notes WHERE contains(title,'tion the') OR contains(body,'tion the')")
add("F23_metadata", lambda s: meta(R.metadata(s.notes)), f"SELECT {SQL_META} FROM notes")
# Joins
add("J2_tag_semi_join", lambda s: s.base.join(s.tags.filter("tag = 'en'").select(F.col("note_id").alias("id")), "id", "left_semi").select("id"), "SELECT id FROM notes WHERE id IN (SELECT note_id FROM tags WHERE tag='en')")
_LINKS = lambda s: s.edges.select("src", "dst", "link_type").unionByName(s.unresolved.select("src", F.col("target_ref").alias("dst"), F.lit("related").alias("link_type")))
add("J3_resolved", lambda s: R.resolve_links(_LINKS(s), s.base)[0].groupBy("link_type").agg(F.count("*").alias("n")), "SELECT link_type, count(*) AS n FROM edges GROUP BY 1")
add("J3_unresolved", lambda s: R.resolve_links(_LINKS(s), s.base)[1], "SELECT src, target_ref FROM unresolved")
add("J5_nested_rows", lambda s: R.nested(s.base, s.tags, s.edges).select("id", F.array_join("all_tags", ",").alias("tags"), F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["position"].cast("string"), x["link_type"], x["dst"])), ",").alias("links")),
    "SELECT id, (SELECT string_agg(DISTINCT tag,',' ORDER BY tag) FROM tags WHERE note_id=id) AS tags, (SELECT string_agg(position||':'||link_type||':'||dst,',' ORDER BY position) FROM edges WHERE src=id) AS links FROM notes")
add("J6_edges_with_titles", lambda s: s.edges.join(s.base.select(F.col("id").alias("dst"), F.col("title").alias("dst_title")), "dst", "left").select("src", "dst", "link_type", "dst_title"), "SELECT src, dst, link_type, title AS dst_title FROM edges LEFT JOIN notes ON id=dst")
add("J7_backlinks", lambda s: s.index.backlinks("qp-31"), "SELECT src, link_type FROM edges WHERE dst='qp-31'")
add("J8_outbound", lambda s: R.outbound(s.edges, "qp-30").orderBy("position").select("dst", "link_type", "position"), "SELECT dst, link_type, position FROM edges WHERE src='qp-30'")
add("J10_induced_subgraph", lambda s: R.induced(s.edges, s.base.filter("type = 'permanent'")).select("src", "dst", "link_type"), "SELECT src, dst, link_type FROM edges WHERE src IN (SELECT id FROM notes WHERE type='permanent') AND dst IN (SELECT id FROM notes WHERE type='permanent')")
add("J11_not_in_collections", lambda s: s.base.join(s.edges.join(s.base.filter("type = 'moc'").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")), "id", "left_anti").select("id"), "SELECT id FROM notes WHERE id NOT IN (SELECT dst FROM edges WHERE src IN (SELECT id FROM notes WHERE type='moc'))")
add("J12_missing", lambda s: s.base.join(s.table("pages").select(F.concat(F.lit("qp-"), F.col("page_id")).alias("id")), "id", "left_anti").select("id"), "SELECT id FROM notes WHERE doc_id NOT IN (SELECT page_id FROM pages)")
add("J15_conflicts", lambda s: R.semantic_conflicts(s.edges.unionByName(s.edges.filter("link_type = 'supports' and dst like '%1'").withColumn("link_type", F.lit("contradicts")))).select("src", "dst"), "SELECT src, dst FROM edges WHERE link_type='supports' AND dst LIKE '%1'")
add("J17_diff", lambda s: R.snapshot_diff(s.base.select("id", "title", "value"), s.base.filter("doc_id % 4 > 0").select("id", "title", F.when(F.col("doc_id") % 6 == 1, F.lit(1)).otherwise(F.col("value")).alias("value")), "id", ["title", "value"]),
    "SELECT id, CASE WHEN doc_id%4=0 THEN 'delete' ELSE 'update' END AS change FROM notes WHERE doc_id%4=0 OR (doc_id%6=1 AND value IS DISTINCT FROM 1)")
add("J18_members_in_order", lambda s: s.edges.join(s.base.filter("type = 'moc'").select(F.col("id").alias("src")), "src", "left_semi").select("src", "position", "dst"), "SELECT src, position, dst FROM edges WHERE src IN (SELECT id FROM notes WHERE type='moc')")
add("J19_broken_with_title", lambda s: s.unresolved.join(s.base.select(F.col("id").alias("src"), "title"), "src", "left"), "SELECT src, target_ref, title FROM unresolved LEFT JOIN notes ON id=src")
# Aggregations
add("A1_tag_frequency", lambda s: R.tag_counts(s.tags).orderBy(F.desc("n"), "tag"), "SELECT tag, count(*) AS n FROM tags GROUP BY 1")
add("A2_counts", lambda s: s.base.agg(F.count("*").alias("notes")).join(s.edges.agg(F.count("*").alias("edges"))).join(s.unresolved.agg(F.count("*").alias("unresolved"))), "SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM unresolved) AS unresolved")
add("A3_distinct_tags", lambda s: s.tags.agg(F.count_distinct("tag").alias("n")), "SELECT count(DISTINCT tag) AS n FROM tags")
add("A4_max_mtime", lambda s: mtimes(s).agg(F.max("mtime").alias("mtime")), f"SELECT max({SQL_MTIME}) AS mtime FROM documents")
add("A5_duplicates", lambda s: s.base.groupBy("title").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids")).filter("n > 1").select("title", "n", "ids"), "SELECT title, count(*) AS n, string_agg(id,',' ORDER BY id) AS ids FROM notes GROUP BY 1 HAVING count(*)>1")
add("A6_level_counts", lambda s: s.base.agg(F.count_if(F.col("doc_id") % 3 == 0).alias("basic"), F.count_if(F.col("doc_id") % 3 != 0).alias("full")), "SELECT count(*) FILTER (doc_id%3=0) AS basic, count(*) FILTER (doc_id%3<>0) AS full FROM notes")
add("A10_tag_index", lambda s: s.tags.select("tag", F.col("note_id").alias("id")).distinct(), "SELECT DISTINCT tag, note_id AS id FROM tags")
add("A16_compacts_count", lambda s: s.compacts.groupBy("digest_id").agg(F.count("*").alias("n")), "SELECT digest_id, count(*) AS n FROM compacts GROUP BY 1")
add("A20_roles", lambda s: s.base.select("id").join(s.compacts.select(F.col("digest_id").alias("id")).distinct().withColumn("d", F.lit(True)), "id", "left").join(s.compacts.select(F.col("source_id").alias("id")).distinct().withColumn("c", F.lit(True)), "id", "left").select("id", F.when(F.col("d") & F.col("c"), "intermediate-digest").when(F.col("d"), "digest").when(F.col("c"), "leaf-source").otherwise("standalone").alias("role")),
    "SELECT id, CASE WHEN d AND c THEN 'intermediate-digest' WHEN d THEN 'digest' WHEN c THEN 'leaf-source' ELSE 'standalone' END AS role FROM (SELECT id, id IN (SELECT digest_id FROM compacts) AS d, id IN (SELECT source_id FROM compacts) AS c FROM notes)")
add("A21_store_stats", lambda s: s.base.agg(F.count("*").alias("notes"), F.count_if(F.col("type") == "moc").alias("mocs")).join(s.tags.agg(F.count_distinct("tag").alias("tags"))).join(s.edges.agg(F.count("*").alias("links"))).join(s.unresolved.agg(F.count("*").alias("unresolved"))), "SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM notes WHERE type='moc') AS mocs, (SELECT count(DISTINCT tag) FROM tags) AS tags, (SELECT count(*) FROM edges) AS links, (SELECT count(*) FROM unresolved) AS unresolved")
# Windows
_TOP = lambda s: R.first_n(s.base, 200, F.col("value").desc_nulls_last()).withColumn("size", F.octet_length("title") + 21)
_SQL_TOP = "top AS (SELECT *, strlen(title)+21 AS size FROM notes ORDER BY value DESC NULLS LAST, id LIMIT 200)"
add("W1_char_budget", lambda s: R.running_budget(_TOP(s), "size", [F.col("value").desc_nulls_last(), "id"], 2000, 50).select("id", "used"), "SELECT id, used::BIGINT AS used FROM (SELECT id, 50+sum(size) OVER (ORDER BY value DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS used FROM top) WHERE used<=2000", _SQL_TOP)
add("W3_budget_flag", lambda s: _TOP(s).withColumn("used", F.sum("size").over(Window.orderBy(F.col("value").desc_nulls_last(), "id").rowsBetween(Window.unboundedPreceding, 0))).agg(F.bool_or(F.col("used") > 3000).alias("truncated")), "SELECT bool_or(used>3000) AS truncated FROM (SELECT sum(size) OVER (ORDER BY value DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS used FROM top)", _SQL_TOP)
add("W6_fanout", lambda s: R.fanout(s.edges, 2).select("src", "dst", "link_type", "rn"), "SELECT * FROM (SELECT src, dst, link_type, row_number() OVER (PARTITION BY src ORDER BY link_type, dst) AS rn FROM edges) WHERE rn<=2")
add("W7_positions", lambda s: s.edges.select("src", "dst", "position"), "SELECT src, dst, position FROM edges")
add("W8_best_per_id", lambda s: R.keep_latest(s.edges.withColumn("score", F.col("position") * 7 % 4).select(F.col("dst").alias("id"), "score", F.col("link_type").alias("via")), ["id"], F.desc("score"), F.col("via")), "SELECT id, score, via FROM (SELECT dst AS id, position*7%4 AS score, link_type AS via, row_number() OVER (PARTITION BY dst ORDER BY position*7%4 DESC, link_type) AS r FROM edges) WHERE r=1")
add("W9_best_per_digest", lambda s: R.keep_latest(s.compacts.join(s.base.select(F.col("id").alias("source_id"), F.coalesce("value", F.lit(50)).alias("relevance")), "source_id"), ["digest_id"], F.desc("relevance"), F.col("source_id")).select("digest_id", F.col("source_id").alias("via"), "relevance"), "SELECT digest_id, source_id AS via, relevance FROM (SELECT digest_id, source_id, coalesce(value,50) AS relevance, row_number() OVER (PARTITION BY digest_id ORDER BY coalesce(value,50) DESC, source_id) AS r FROM compacts JOIN notes ON id=source_id) WHERE r=1")
# Orders: ranks make the order part of the result
_RANK = lambda d, *order: d.select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))
add("O1_list_order", lambda s: R.numbered(s.index.notes.select("id", "created"), [F.col("created").desc_nulls_first(), "id"]).select("id", "place"), "SELECT id, row_number() OVER (ORDER BY created DESC NULLS FIRST, id) AS place FROM notes")
add("O2_export_order", lambda s: R.numbered(s.index.notes.select("id", "created"), [F.col("created").asc_nulls_last(), "id"]).select("id", "place"), "SELECT id, row_number() OVER (ORDER BY created ASC NULLS LAST, id) AS place FROM notes")
add("O4_value_order", lambda s: _RANK(s.base.orderBy(F.col("created").desc_nulls_last(), "id").limit(200), R.effective_value(F.col("value")).desc(), "id"), "SELECT id, row_number() OVER (ORDER BY coalesce(value,50) DESC, id) AS place FROM (SELECT * FROM notes ORDER BY created DESC NULLS LAST, id LIMIT 200)")
_IN = lambda s: s.edges.filter("src = 'qp-10' or src = 'qp-20' or src = 'qp-30'").select(F.col("dst").alias("id"), "link_type")
add("O7_context_order", lambda s: R.context_order(_IN(s).join(s.notes.select("id", "verified", "created"), "id")).select("id", "link_type", F.row_number().over(Window.orderBy(F.coalesce("verified", F.lit(False)).desc(), F.when(F.col("link_type").isin("part-of", "supports"), 0).when(F.col("link_type") == "related", 2).otherwise(1), F.col("created").asc_nulls_last(), "id")).alias("place")),
    "SELECT e.dst AS id, e.link_type, row_number() OVER (ORDER BY coalesce(verified,false) DESC, CASE WHEN link_type IN ('part-of','supports') THEN 0 WHEN link_type='related' THEN 2 ELSE 1 END, created ASC NULLS LAST, dst) AS place FROM edges e JOIN notes ON id=dst WHERE src IN ('qp-10','qp-20','qp-30')")
add("O8_prime_order", lambda s: _RANK(s.base.filter("type = 'moc'"), F.col("updated").desc_nulls_first(), "id"), "SELECT id, row_number() OVER (ORDER BY updated DESC NULLS FIRST, id) AS place FROM notes WHERE type='moc'")
add("O10_link_list_order", lambda s: s.edges.filter("src = 'qp-30' or dst = 'qp-30'").select(F.when(F.col("src") == "qp-30", "out").otherwise("in").alias("direction"), "link_type", F.when(F.col("src") == "qp-30", F.col("dst")).otherwise(F.col("src")).alias("id")).dropDuplicates().orderBy("direction", "link_type", "id"), "SELECT DISTINCT CASE WHEN src='qp-30' THEN 'out' ELSE 'in' END AS direction, link_type, CASE WHEN src='qp-30' THEN dst ELSE src END AS id FROM edges WHERE src='qp-30' OR dst='qp-30'")
add("O12_edge_order", lambda s: R.numbered(s.edges.select("src", "link_type", "dst"), ["src", "link_type", "dst"]), "SELECT src, link_type, dst, row_number() OVER (ORDER BY src, link_type, dst) AS place FROM edges")
add("O13_random_sample", lambda s: s.base.orderBy(F.rand()).limit(5).select("id"))
# Set operations
_SEL = lambda d, by: d.select("id", F.row_number().over(Window.orderBy(by)).alias("pos"))
add("U2_ordered_union", lambda s: R.ordered_union(_SEL(R.outbound(s.edges, "qp-10").select(F.col("dst").alias("id"), "position"), "position"), _SEL(s.base.filter("type = 'moc' and value > 60"), "id"), _SEL(s.base.filter("value > 90"), "id")),
    "SELECT id, source_rank, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_rank, pos) AS r FROM (SELECT dst AS id, 0 AS source_rank, row_number() OVER (ORDER BY position) AS pos FROM edges WHERE src='qp-10' UNION ALL SELECT id, 1, row_number() OVER (ORDER BY id) FROM notes WHERE type='moc' AND value>60 UNION ALL SELECT id, 2, row_number() OVER (ORDER BY id) FROM notes WHERE value>90)) WHERE r=1")
_PAIR = lambda s: s.notes.select("id", "tags").alias("a").join(s.edges.filter("link_type = 'follows'").alias("e"), F.col("a.id") == F.col("e.src")).join(s.notes.select(F.col("id").alias("dst2"), F.col("tags").alias("tags2")), F.col("e.dst") == F.col("dst2"))
_SQL_PAIR = "FROM edges e JOIN notes a ON a.id=e.src JOIN notes b ON b.id=e.dst WHERE link_type='follows'"
add("U3_tag_union", lambda s: _PAIR(s).select("id", F.array_join(F.array_sort(F.array_union("tags", "tags2")), ",").alias("tags")), f"SELECT a.id, array_to_string(list_sort(list_distinct(list_concat(a.tags,b.tags))),',') AS tags {_SQL_PAIR}")
add("U6_difference", lambda s: s.base.select("id").exceptAll(s.compacts.select(F.col("source_id").alias("id")).distinct()), "SELECT id FROM notes EXCEPT ALL SELECT DISTINCT source_id FROM compacts")
add("U7_intersection", lambda s: s.edges.filter("link_type = 'supports'").select("src", "dst").intersect(s.edges.filter("link_type = 'follows'").select("src", "dst")), "SELECT src, dst FROM edges WHERE link_type='supports' INTERSECT SELECT src, dst FROM edges WHERE link_type='follows'")
add("U8_edge_dedup", lambda s: s.edges.unionByName(s.edges).dropDuplicates(["src", "dst", "link_type"]).groupBy("link_type").agg(F.count("*").alias("n")), "SELECT link_type, count(*) AS n FROM edges GROUP BY 1")
add("U9_shared_tag_ratio", lambda s: _PAIR(s).select("id", F.round(F.size(F.array_intersect("tags", "tags2")) / F.size(F.array_union("tags", "tags2")), 6).alias("ratio")), f"SELECT a.id, round(len(list_intersect(a.tags,b.tags))/len(list_distinct(list_concat(a.tags,b.tags))),6) AS ratio {_SQL_PAIR}")
