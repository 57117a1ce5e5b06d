"""Queries for files, packs, exports and telemetry, and substrate checks on the generic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import export as E
from lattica.sources import markdown, pack
from lattica.sources.storage import new_path
from lattica.streaming import telemetry as R

from .registry import Book

BOOK = Book()
add = BOOK.add
_FILES = lambda s: s.notes.select(F.concat(F.lit("notes/"), F.col("id"), F.lit(".md")).alias("path"), F.when(F.col("doc_id") % 25 == 3, "no head").otherwise(markdown.render(s.notes)).alias("text"))
add("S3_frontmatter", lambda s: markdown.scan(s.spark, s.folder).filter("error is null").select("id", "title", "type", F.coalesce("value", F.lit(-1)).alias("value"), F.array_join("tags", ",").alias("tags"), F.md5(F.col("body").cast("binary")).alias("body")), "SELECT id, title, type, coalesce(value,-1) AS value, array_to_string(tags,',') AS tags, md5(body) AS body FROM notes")
add("S5_permissive_scan", lambda s: markdown.parse(_FILES(s)).filter("error is not null").select("path", "error"), "SELECT 'notes/'||id||'.md' AS path, 'no head' AS error FROM notes WHERE doc_id%25=3")
_BAD_VALUES = lambda s: _FILES(s).withColumn("text", F.when(F.regexp_extract("path", r"qp-(\d+)", 1).cast("int") % 3 == 0, F.regexp_replace("text", r"\nvalue: \d+\n", "\nvalue: high\n")).otherwise(F.col("text")))
add("S5_bad_values", lambda s: markdown.parse(_BAD_VALUES(s)).select("path", F.col("error").isNull().alias("fine"), F.coalesce("value", F.lit(-1)).alias("value"), F.when(F.col("error").startswith("value"), F.col("error")).alias("error")), "SELECT 'notes/'||id||'.md' AS path, doc_id%25<>3 AND NOT coalesce(doc_id%3=0 AND value IS NOT NULL,false) AS fine, CASE WHEN doc_id%25=3 OR doc_id%3=0 OR value IS NULL THEN -1 ELSE value END AS value, CASE WHEN doc_id%25<>3 AND doc_id%3=0 AND value IS NOT NULL THEN 'value is no whole number: high' END AS error FROM notes")
_SQL_FILE = "'---'||chr(10)||'id: '||id||chr(10)||'title: '||to_json(title)||chr(10)||'type: '||type||coalesce(chr(10)||'value: '||value,'')||chr(10)||'tags: '||to_json(tags)||chr(10)||'---'||chr(10)||body"
add("S4_note_writer", lambda s: markdown.scan_raw(s.spark, s.folder).select(F.regexp_extract("path", "([^/]+)[.]md$", 1).alias("id"), F.octet_length("text").cast("long").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("digest")), f"SELECT id, strlen(f)::BIGINT AS bytes, md5(f) AS digest FROM (SELECT id, {_SQL_FILE} AS f FROM notes)")
_LINES = lambda s: pack.note_lines(s.notes).select("line")
add("S31_pack_notes", lambda s: pack.read_notes(_LINES(s)).select("id", "type", "title", F.array_join("tags", ",").alias("tags"), F.date_format("created", "yyyy-MM-dd").alias("created"), F.coalesce("value", F.lit(-1)).alias("value")), r"SELECT id, type, regexp_replace(title,'[\r\n]',' ','g') AS title, array_to_string(tags,',') AS tags, strftime(created,'%Y-%m-%d') AS created, coalesce(value,-1) AS value FROM notes")
add("S30_pack_links", lambda s: pack.read_links(pack.link_lines(s.edges)), "SELECT src, link_type, dst, inline FROM edges")
add("S28_pack_bodies", lambda s: pack.read_bodies(pack.note_lines(s.notes).groupBy("at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n").alias("value"))).select("id", F.md5(F.col("body").cast("binary")).alias("body")), "SELECT id, md5(body) AS body FROM notes")
add("S32_pack_lines", lambda s: pack.note_lines(s.notes).groupBy("part").agg(F.count("*").alias("n")), "SELECT unnest([0,1,2,3])::INT AS part, count(*) AS n FROM notes")


def packed(s):
    """All notes with metadata and sources, links, and pages as attachments, written as a pack and read again in splits."""
    custom = s.custom.groupBy("id").agg(F.min("custom").alias("custom"))
    source = F.array(F.struct(F.concat(F.lit("https://s.example/"), "doc_id").alias("url"), F.when(F.col("doc_id") % 2 == 0, "Title of it").alias("title"), F.lit(None).cast("string").alias("accessed")))
    notes = s.notes.join(custom, "id", "left").withColumns({"sources": F.when(F.col("doc_id") % 5 == 0, source), "author": F.when(F.col("doc_id") % 4 == 0, "A. N. Other")})
    files = s.table("pages").select(F.concat(F.lit("attachments/p"), "page_id", F.lit(".html")).alias("path"), F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("name"), F.lit("text/html").alias("content_type"), F.coalesce("html", F.lit("")).cast("binary").alias("data"))
    path = new_path(s.spark, "whole-pack")
    pack.write_all(notes, s.edges, path, "tables", files, "[store]\nname = 1\n")
    return pack.read_lines(s.spark, path)


add("S28_pack_splits", lambda s: pack.whole_notes(packed(s)).select("id", "type", F.md5(F.col("body").cast("binary")).alias("body"), "value", "author", F.get_json_object("custom", "$.kind").alias("kind"), F.get(F.col("sources"), F.lit(0))["url"].alias("url"), F.get(F.col("sources"), F.lit(0))["title"].alias("source_title"), F.date_format("created", "yyyy-MM-dd").alias("created")),
    "SELECT notes.id, type, md5(body) AS body, notes.value, CASE WHEN doc_id%4=0 THEN 'A. N. Other' END AS author, c.kind, CASE WHEN doc_id%5=0 THEN 'https://s.example/'||doc_id END AS url, CASE WHEN doc_id%10=0 THEN 'Title of it' END AS source_title, strftime(created,'%Y-%m-%d') AS created FROM notes LEFT JOIN (SELECT id, min(kind) AS kind FROM custom GROUP BY 1) c ON c.id=notes.id")
add("S32_pack_kinds", lambda s: packed(s).groupBy(F.split("line", " ")[0].alias("kind")).agg(F.count("*").alias("n")), "SELECT kind, n FROM (SELECT unnest(['H','CFG','CFG-END','END']) AS kind, 1 AS n UNION ALL SELECT unnest(['A','D','D-END']), count(*) FROM pages UNION ALL SELECT 'N', count(*) FROM notes UNION ALL SELECT unnest(['C','C-END']), count(*) FROM notes WHERE body<>'' UNION ALL SELECT 'S', count(*) FROM notes WHERE doc_id%5=0 UNION ALL SELECT 'L', count(*) FROM edges)")
add("S33_pack_attachments", lambda s: pack.attachments(packed(s)).select("path", "content_type", F.md5("data").alias("data")), "SELECT 'attachments/p'||page_id||'.html' AS path, 'text/html' AS content_type, md5(coalesce(html,'')) AS data FROM pages")
add("S29_pack_json", lambda s: pack.read_json(E.as_json(s.notes).select(F.col("json").alias("line")), "id string, title string, type string, tags array<string>").select("id", "title", "type", F.array_join("tags", ",").alias("tags")), "SELECT id, title, type, array_to_string(tags,',') AS tags FROM notes")
add("P15_dump", lambda s: pack.link_lines(s.edges.join(s.notes.filter("type = 'moc'").select(F.col("id").alias("src")), "src", "left_semi")).select("line"), "SELECT 'L '||src||' '||dst||' type='||link_type||' inline='||inline AS line FROM edges WHERE src IN (SELECT id FROM notes WHERE type='moc')")
add("S34_bundle", lambda s: E.bundle(s.base).select("place", F.md5(F.col("section").cast("binary")).alias("section")), "SELECT row_number() OVER (ORDER BY created ASC NULLS LAST, id) AS place, md5('## '||title||' ('||id||')'||chr(10)||chr(10)||body||chr(10)) AS section FROM notes")
add("S35_outline", lambda s: E.outline(s.base, s.edges, "qp-20").select("place", F.md5(F.col("section").cast("binary")).alias("section")), "SELECT place, md5('## '||title||chr(10)||chr(10)||body) AS section FROM (SELECT 'qp-20' AS id, 0 AS place UNION ALL SELECT dst, min(position)+1 FROM edges WHERE src='qp-20' GROUP BY 1) JOIN notes USING (id)")
_SRC = lambda s: s.table("pages").select("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Page_"), F.col("page_id"))).alias("title"), F.when(F.col("page_id") % 3 == 0, "2024-01-02").alias("accessed"), F.concat(F.lit("N & "), F.col("page_id")).alias("note_title"))
SRC = "src AS (SELECT url, CASE WHEN page_id%2=0 THEN 'Page_'||page_id END AS title, CASE WHEN page_id%3=0 THEN '2024-01-02' END AS accessed, 'N & '||page_id AS note_title FROM pages), num AS (SELECT *, row_number() OVER (ORDER BY url, note_title) AS place FROM src)"
add("S36_bibliography_markdown", lambda s: E.bibliography(_SRC(s), "markdown"), "SELECT place, coalesce('- ['||title||']('||url||')','- '||url)||coalesce(' (accessed '||accessed||')','')||' — from: '||note_title AS entry FROM num", SRC)
add("S36_bibliography_bibtex", lambda s: E.bibliography(_SRC(s), "bibtex"), r"SELECT place, '@misc{'||regexp_replace(split_part(regexp_replace(url,'^https?://',''),'/',1),'[.-]','_','g')||'_'||place||','||chr(10)||coalesce('  title = {'||replace(title,'_','\_')||'},'||chr(10),'')||'  url = {'||url||'},'||chr(10)||'  note = {From: '||replace(note_title,'&','\&')||'}'||chr(10)||'}'||chr(10) AS entry FROM num", SRC)
add("W10_citation_numbers", lambda s: E.bibliography(_SRC(s), "csl-json").select("place", F.get_json_object("entry", "$.URL").alias("url")), "SELECT place, url FROM num", SRC)
add("S37_export_json", lambda s: E.as_json(s.notes).select("id", F.get_json_object("json", "$.title").alias("title"), F.get_json_object("json", "$.tags[0]").alias("tag")), "SELECT id, title, tags[1] AS tag FROM notes")
add("S37_export_records", lambda s: E.records(s.notes), """SELECT id, 'N '||id||' '||type||' "'||replace(title,'"','\\"')||'" tags='||array_to_string(tags,',') AS line FROM notes""")


def dumped(s):
    """A pack of the collections and their links, written as files and read back."""
    mocs, path = s.notes.filter("type = 'moc'"), new_path(s.spark, "pack")
    pack.write(mocs, s.edges.join(mocs.select(F.col("id").alias("src")), "src", "left_semi"), path)
    lines = s.spark.read.text(path).select(F.col("value").alias("line"))
    return pack.read_links(lines).join(pack.read_notes(lines).select(F.col("id").alias("src"), "title"), "src")


add("S33_links_of_dump", dumped, r"SELECT src, link_type, dst, inline, regexp_replace(title,'[\r\n]',' ','g') AS title FROM edges JOIN notes ON id=src WHERE type='moc'")
add("P14_export", lambda s: E.bundle(s.base.join(s.tags.filter("tag = 'de'").select(F.col("note_id").alias("id")), "id", "left_semi")).select("place"), "SELECT row_number() OVER () AS place FROM tags WHERE tag='de'")
# Telemetry


def sunk(s):
    """Events appended to JSON lines in two parts and read back."""
    path = new_path(s.spark, "events")
    for part in ("success", "not success"):
        R.sink(s.telemetry.filter(part), path)
    return R.source(s.spark, path).groupBy("command", "success").agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.count_distinct("error").alias("errors")).select("command", "success", "n", F.date_format("last", "yyyy-MM-dd").alias("last"), "errors")


add("S38_sink", sunk, "SELECT command, success, count(*) AS n, strftime(max(ts),'%Y-%m-%d') AS last, count(DISTINCT error) AS errors FROM telemetry GROUP BY 1,2")
NOW = lambda: F.lit("2024-01-30 00:00:00").cast("timestamp")
add("A17_command_stats", lambda s: R.daily(s.telemetry).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "command", "succeeded", "failed", F.col("durations")["less-than-100ms"].alias("fast"), F.array_join(F.array_sort("errors"), ",").alias("errors")),
    "SELECT strftime(ts,'%Y-%m-%d') AS day, command, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, count(*) FILTER (duration_ms<100) AS fast, coalesce(string_agg(DISTINCT error,',' ORDER BY error),'') AS errors FROM telemetry GROUP BY 1,2")
add("A18_ready_batches", lambda s: R.ready(R.daily(s.telemetry), 330).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "events"), "SELECT strftime(ts,'%Y-%m-%d') AS day, count(*) AS events FROM telemetry GROUP BY 1 HAVING count(*)>=330")
add("S39_retention", lambda s: R.retained(s.telemetry, NOW()).groupBy("command").agg(F.count("*").alias("n")), "SELECT command, count(*) AS n FROM telemetry WHERE ts>=TIMESTAMP '2024-01-23' GROUP BY 1")
add("R1_newest_events", lambda s: R.newest(s.telemetry, 1000).groupBy("command").agg(F.count("*").alias("n")), "SELECT command, count(*) AS n FROM (SELECT * FROM telemetry ORDER BY ts DESC, command, duration_ms LIMIT 1000) GROUP BY 1")
add("R2_daily_windows", lambda s: s.telemetry.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n"), "SELECT strftime(ts,'%Y-%m-%d') AS day, count(*) AS n FROM telemetry GROUP BY 1")
add("R4_session_threshold", lambda s: R.daily(s.telemetry).groupBy("command").agg(F.sum("succeeded").alias("n")).filter("n >= 100"), "SELECT command, count(*)::BIGINT AS n FROM telemetry WHERE success GROUP BY 1 HAVING count(*)>=100")
# Substrate: what the generic tables need and the note operators don't show
add("substrate_price_summary", lambda s: s.table("lineitem").filter("l_shipdate <= '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")), "SELECT l_returnflag, l_linestatus, round(sum(l_quantity),2) AS qty, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate<='1998-09-02' GROUP BY ALL")
add("substrate_nation_revenue", lambda s: s.table("lineitem").join(s.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(s.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(s.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")), "SELECT n_name, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
