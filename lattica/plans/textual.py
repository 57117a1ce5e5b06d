"""Queries for scalar functions over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import text as X
from lattica.functions.snowball import english

from .registry import Book

BOOK = Book()
add = BOOK.add
#: Bodies with links, the same on both sides.
LINKED = lambda s: s.base.select("doc_id", "id", "title", F.concat(F.lit("# Head "), F.col("doc_id"), F.lit("\n\nSee [[qp-"), F.col("doc_id") + 1, F.lit("|next one]] and [[ qp-"), F.col("doc_id") + 2, F.lit(" ]] or [here](./qp-"), F.col("doc_id") + 3, F.lit("-slug.md)\nbut ![pic](../attachments/a"), F.col("doc_id") % 5, F.lit(".png) not [web](https://x.org/a).\n\n## Summary\n\nShort text "), F.col("doc_id"), F.lit(".\nSecond line.\n\nRest.\n\n## Text\n\n"), F.coalesce("body", F.lit(""))).alias("b"))
SQL_LINKED = "linked AS (SELECT doc_id, id, title, '# Head '||doc_id||chr(10)||chr(10)||'See [[qp-'||(doc_id+1)||'|next one]] and [[ qp-'||(doc_id+2)||' ]] or [here](./qp-'||(doc_id+3)||'-slug.md)'||chr(10)||'but ![pic](../attachments/a'||(doc_id%5)||'.png) not [web](https://x.org/a).'||chr(10)||chr(10)||'## Summary'||chr(10)||chr(10)||'Short text '||doc_id||'.'||chr(10)||'Second line.'||chr(10)||chr(10)||'Rest.'||chr(10)||chr(10)||'## Text'||chr(10)||chr(10)||coalesce(body,'') AS b FROM notes)"
STOP = ",".join(f"'{w}'" for w in X.STOP_WORDS)


def linked(name: str, column, sql: str, alias: str = "out") -> None:
    add(name, lambda s: LINKED(s).select("id", column(F.col("b")).alias(alias)), f"SELECT id, {sql} AS {alias} FROM linked", SQL_LINKED)


add("X1_tokenize", lambda s: s.base.select("id", F.array_join(X.tokens(F.col("title")), " ").alias("out")), rf"SELECT id, array_to_string(list_filter(string_split_regex(lower(title),'[^\p{{L}}\p{{N}}]+'), lambda w: w<>'' AND w NOT IN ({STOP})),' ') AS out FROM notes")
add("X2_stem_terms", lambda s: X.stems(s.base.select(F.explode(X.tokens(F.col("body"))).alias("term")), stemmer=english))
linked("X4_wiki_links", lambda b: F.array_join(X.wiki_links(b), ","), r"array_to_string(list_transform(regexp_extract_all(b,'\[\[([^\]|]+)(?:\|[^\]]+)?\]\]',1), lambda x: trim(x)),',')")
linked("X5_markdown_links", lambda b: F.array_join(F.transform(X.markdown_links(b), lambda x: F.concat_ws("=", x["text"], x["target"])), ";"), r"array_to_string(list_transform(list_zip(regexp_extract_all(b,'\[([^\]]*)\]\(([^)]+)\)',1), regexp_extract_all(b,'\[([^\]]*)\]\(([^)]+)\)',2)), lambda x: x[1]||'='||x[2]),';')")
linked("X6_external", lambda b: F.size(F.filter(X.markdown_links(b), lambda x: X.is_external(x["target"]))), r"len(list_filter(regexp_extract_all(b,'\[([^\]]*)\]\(([^)]+)\)',2), lambda x: regexp_matches(x,'^(https?://|#)')))::INT")
linked("X7_id_in_target", lambda b: F.array_join(F.transform(X.markdown_links(b), lambda x: F.coalesce(X.id_in_target(x["target"]), F.lit("-"))), ","), r"array_to_string(list_transform(regexp_extract_all(b,'\[([^\]]*)\]\(([^)]+)\)',2), lambda x: coalesce(nullif(regexp_extract(x,'(qp-[^-./)\s]+)',1),''),'-')),',')")
linked("X8_rewrite_ids", lambda b: X.rewrite_ids(b, "qp-12", "qp-99"), r"regexp_replace(b,'\bqp-12\b','qp-99','g')")
linked("X10_attachments", lambda b: F.array_join(X.attachments(b), ","), r"array_to_string(list_distinct(regexp_extract_all(b,'attachments/([^)\s\n]+)',1)),',')")
linked("X11_wiki_to_markdown", X.wiki_to_markdown, r"regexp_replace(regexp_replace(b,'\[\[([^\]|]+)\|([^\]]+)\]\]','[\2](\1.md)','g'),'\[\[([^\]|]+)\]\]','[\1](\1.md)','g')")
linked("X12_anchor_links", lambda b: X.export_links(b, "anchors"), r"regexp_replace(regexp_replace(b,'\[\[([^\]|]+)\|([^\]]+)\]\]','[\2](#note-\1)','g'),'\[\[([^\]|]+)\]\]','[\1](#note-\1)','g')")
linked("X14_strip_links", X.strip_links, r"regexp_replace(regexp_replace(regexp_replace(b,'\[\[[^\]|]+\|([^\]]+)\]\]','\1','g'),'\[\[([^\]|]+)\]\]','\1','g'),'\[([^\]]*)\]\(([^)]+)\)','\1','g')")
linked("X15_summary_section", X.summary_section, "'Short text '||doc_id||'.'||chr(10)||'Second line.'")
linked("X16_first_paragraph", X.first_paragraph, "replace(split_part(b,chr(10)||chr(10),2),chr(10),' ')")
linked("X17_summary", lambda b: X.summary(F.lit(""), b), "'Short text '||doc_id||'.'||chr(10)||'Second line.'")
add("X18_size", lambda s: LINKED(s).select("id", F.octet_length(X.summary(F.lit(""), F.col("b"))).cast("long").alias("summary_bytes"), F.octet_length("b").cast("long").alias("body_bytes")), "SELECT id, strlen('Short text '||doc_id||'.'||chr(10)||'Second line.')::BIGINT AS summary_bytes, strlen(b)::BIGINT AS body_bytes FROM linked", SQL_LINKED)
add("X21_slug", lambda s: s.base.select("id", F.concat(F.col("id"), F.lit("-"), X.slug(F.col("title")), F.lit(".md")).alias("file")), "SELECT id, id||'-'||regexp_replace(regexp_replace(lower(title),'[^a-z0-9]+','-','g'),'^-|-$','','g')||'.md' AS file FROM notes")
add("X22_hash_id", lambda s: s.base.select("id", X.short_id(F.col("id"), 8).alias("short")), "SELECT id, 'qp-'||substr(sha256(id),1,8) AS short FROM notes")
add("X23_valid_id", lambda s: s.base.select("id", X.valid_id(F.col("title")).alias("ok")), "SELECT id, regexp_matches(title,'^[A-Za-z0-9_-]+$') AS ok FROM notes")
add("X24_title", lambda s: s.base.select("id", X.title_of(F.concat(F.lit("\n<!-- c -->\n## "), F.regexp_replace("body", r"\s+", " "))).alias("made")),
    "SELECT id, CASE WHEN t='' THEN 'Untitled capture' WHEN length(t)<=60 THEN t WHEN contains(c,' ') AND p>30 THEN substr(c,1,p)||'...' ELSE c||'...' END AS made FROM (SELECT id, t, substr(t,1,60) AS c, 60-length(list_last(string_split(substr(t,1,60),' ')))-1 AS p FROM (SELECT id, trim(regexp_replace('## '||regexp_replace(body,'\\s+',' ','g'),'^#+','')) AS t FROM notes))".replace("\\\\", "\\"))
add("X25_format_tags", lambda s: s.notes.select("id", X.format_tags(F.col("tags")).alias("out")), "SELECT id, array_to_string(tags,',') AS out FROM notes")
add("X26_escape", lambda s: s.base.select("id", X.escape_bibtex(F.concat(F.lit("a{b}_$%&#\\"), F.col("id"))).alias("bib"), X.escape_quotes(F.concat(F.lit('"'), F.col("title"), F.lit('"'))).alias("quoted")), r"""SELECT id, regexp_replace(replace('a{b}_$%&#\'||id,'\','\\'),'([{}%$&#_])','\\\1','g') AS bib, replace('"'||title||'"','"','\"') AS quoted FROM notes""")
add("X27_citation_key", lambda s: s.table("pages").select("page_id", X.citation_key(F.col("url"), F.col("page_id") + 1).alias("key")), "SELECT page_id, regexp_replace(split_part(regexp_replace(url,'^https?://',''),'/',1),'[.-]','_','g')||'_'||(page_id+1) AS key FROM pages")
add("X28_date_parts", lambda s: s.custom.select("id", F.aggregate(X.date_parts(F.get_json_object("custom", "$.day")), F.lit(0), lambda a, x: a * 100 + x).alias("n")), "SELECT id, replace(day,'-','')::INT AS n FROM custom")
add("X29_iso_date", lambda s: s.custom.filter(F.get_json_object("custom", "$.day").rlike(r"^\d{4}-\d{2}-\d{2}$")).agg(F.count("*").alias("n")), r"SELECT count(*) AS n FROM custom WHERE regexp_matches(day,'^\d{4}-\d{2}-\d{2}$')")
add("X30_inverse", lambda s: s.edges.select("src", "dst", "link_type", X.inverse(F.col("link_type")).alias("inv"), X.inverse(F.concat(F.lit("inverse-"), F.col("link_type"))).alias("back")), "SELECT src, dst, link_type, CASE link_type WHEN 'supports' THEN 'supported-by' WHEN 'part-of' THEN 'has-part' WHEN 'follows' THEN 'precedes' ELSE 'related' END AS inv, link_type AS back FROM edges")
add("X31_link_cost", lambda s: s.edges.select("link_type", X.link_cost(F.col("link_type")).alias("cost")).distinct(), "SELECT DISTINCT link_type, CASE WHEN link_type IN ('part-of','follows') THEN 0.5 ELSE 1.0 END::DOUBLE AS cost FROM edges")
add("X32_edge_cost", lambda s: s.edges.join(s.base.select(F.col("id").alias("dst"), F.coalesce("value", F.lit(50)).alias("v")), "dst").select("src", "dst", "link_type", F.round(X.edge_cost(F.col("link_type"), F.col("v")), 6).alias("cost")), "SELECT src, dst, link_type, round((CASE WHEN link_type IN ('part-of','follows') THEN 0.5 ELSE 1.0 END)::DOUBLE*(1+(100-coalesce(value,50))/100.0::DOUBLE),6) AS cost FROM edges JOIN notes ON id=dst")
add("X33_recency", lambda s: s.base.select("id", F.round(X.recency(F.coalesce("updated", "created"), F.lit("2025-02-01").cast("timestamp")), 6).alias("boost")), "SELECT id, round(0.1/(1+coalesce((epoch(TIMESTAMP '2025-02-01')-epoch(coalesce(updated,created)))/86400.0::DOUBLE,0)/7.0),6)::DOUBLE AS boost FROM notes")
add("X36_decode", lambda s: s.table("documents").select("doc_id", F.coalesce(X.decoded_value(F.col("doc_id") % 150), F.lit(-1)).alias("v"), (F.col("doc_id") % 3 != 0).alias("verified")), "SELECT doc_id, CASE WHEN doc_id%150 BETWEEN 0 AND 100 THEN (doc_id%150)::INT ELSE -1 END AS v, doc_id%3<>0 AS verified FROM documents")
add("X37_time_decode", lambda s: s.custom.select("id", F.date_format(F.try_to_timestamp(F.when(F.substring("id", -1, 1) == "3", F.lit("bad")).otherwise(F.get_json_object("custom", "$.day"))), "yyyy-MM-dd").alias("t")), "SELECT id, CASE WHEN right(id,1)='3' THEN NULL ELSE day END AS t FROM custom")
add("X38_json_round_trip", lambda s: s.custom.select("id", F.from_json("custom", "k bigint, kind string, day string").alias("c")).select("id", "c.k", "c.kind", "c.day"), "SELECT id, k, kind, day FROM custom")
add("X41_base64", lambda s: s.base.select("id", X.base64(F.col("title")).alias("b64"), F.unbase64(X.base64(F.col("title"))).cast("string").alias("back")), "SELECT id, base64(encode(title)) AS b64, title AS back FROM notes")
add("X42_counts", lambda s: s.base.select("id", X.words(F.col("body")).alias("words"), X.paragraphs(F.col("body")).alias("paragraphs")), r"SELECT id, len(list_filter(string_split_regex(body,'[\s\x0b]+'), lambda x: x<>''))::INT AS words, len(list_filter(string_split(body,chr(10)||chr(10)), lambda x: regexp_replace(x,'[\s\x0b]','','g')<>''))::INT AS paragraphs FROM notes")
add("X43_buckets", lambda s: s.telemetry.select(X.bucket(F.col("duration_ms") * 30, *X.DURATIONS).alias("duration"), X.bucket(F.col("duration_ms"), *X.RESULTS).alias("results")).groupBy("duration", "results").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN d<100 THEN 'less-than-100ms' WHEN d<500 THEN 'ms-100-to-500' WHEN d<1000 THEN 'ms-500-to-1s' WHEN d<5000 THEN 's-1-to-5' ELSE 'more-than-5s' END AS duration, CASE WHEN v<1 THEN 'zero' WHEN v<2 THEN 'one' WHEN v<6 THEN 'two-to-five' WHEN v<21 THEN 'six-to-twenty' WHEN v<101 THEN 'twenty-one-to-100' ELSE 'more-than-100' END AS results, count(*) AS n FROM (SELECT duration_ms*30 AS d, duration_ms AS v FROM telemetry) GROUP BY 1,2")
add("X44_strip_frontmatter", lambda s: s.base.select("id", X.strip_frontmatter(F.concat(F.lit("---\nid: x\ntitle: y\n---\n"), F.col("title"))).alias("out")), "SELECT id, title AS out FROM notes")
