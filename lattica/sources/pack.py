"""Packs: notes, sources, links and attachments as lines of text.

A pack is written by ranges of what its lines belong to, and read in splits: what a line belongs to is told by the last line
before it that opens something, which may stand in an earlier split of its file, so the splits' last ones are carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.text import base64, escape_quotes, format_tags

KEYS = ["at", "part", "line"]
#: Order of a pack's sections.
HEAD, NOTES, LINKS, FILES, END = range(5)
#: Metadata of a note that its line quotes, in order.
QUOTED = ("source", "author", "generated_by", "prompt_hash")
NOTE_FIELDS = {"summary": "string", "compacts": "array<string>", **dict.fromkeys(QUOTED, "string"), "verified": "boolean", "value": "int", "custom": "string", "created": "timestamp", "updated": "timestamp", "sources": "array<struct<url:string,title:string,accessed:string>>", "body": "string"}


def note_lines(notes: DataFrame) -> DataFrame:
    """N, and the body as C with base64 and C-END, of each note; at orders notes, part lines within one."""
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("-"))
    head = F.concat(F.lit("N "), F.col("id"), F.lit(" "), F.col("type"), F.lit(' "'), escape_quotes(F.regexp_replace("title", r"[\r\n]", " ")), F.lit('" tags='), format_tags(F.col("tags")), F.lit(" created="), stamp("created"), F.lit(" updated="), stamp("updated"), F.when(F.col("value").isNotNull(), F.concat(F.lit(" value="), F.col("value").cast("string"))).otherwise(""))
    lines = F.array(head, F.concat(F.lit("C "), F.col("id")), base64(F.col("body")), F.lit("C-END"))
    return notes.select(F.col("id").alias("at"), F.posexplode(lines).alias("part", "line"))


def link_lines(edges: DataFrame) -> DataFrame:
    kind = F.coalesce("link_type", F.lit("-"))
    line = F.concat_ws(" ", F.lit("L"), "src", "dst", F.concat(F.lit("type="), kind), F.concat(F.lit("inline="), F.col("inline").cast("string")))
    return edges.select(F.lit("~links").alias("at"), F.row_number().over(_order("src", "position")).alias("part"), line.alias("line"))


def _order(*by: str):
    return Window.partitionBy("src").orderBy(*by)


def write(notes: DataFrame, edges: DataFrame, path: str, store: str = "store") -> None:
    """Notes without their further metadata, and links; see write_all."""
    write_all(notes, edges, path, store)


def _whole(notes: DataFrame) -> DataFrame:
    """Notes with all columns of NOTE_FIELDS, null where there are none."""
    return notes.withColumns({c: F.lit(None).cast(t) for c, t in NOTE_FIELDS.items() if c not in notes.columns})


def _lines_of_notes(notes: DataFrame) -> DataFrame:
    """(section, at, part, line): the line of each note, its body if it has any, and its sources."""
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("-"))
    plain = lambda c: F.regexp_replace(c, r"[\r\n]", " ")
    said = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f" {name}="), value)).otherwise("")
    quoted = lambda c: F.concat(F.lit('"'), plain(c), F.lit('"'))
    head = F.concat(F.lit("N "), "id", F.lit(" "), "type", F.lit(' "'), escape_quotes(plain(F.coalesce("title", F.lit("")))), F.lit('" tags='), format_tags(F.coalesce("tags", F.array().cast("array<string>"))), F.lit(" created="), stamp("created"), F.lit(" updated="), stamp("updated"),
                    said("summary", quoted(F.col("summary"))), said("compacts", F.when(F.size("compacts") > 0, F.array_join("compacts", ","))), *(said(c, quoted(F.col(c))) for c in QUOTED), said("verified", F.col("verified").cast("string")), said("value", F.col("value").cast("string")), said("custom", base64(F.col("custom"))))
    none = F.array().cast("array<string>")
    body = F.when(F.coalesce("body", F.lit("")) != "", F.array(F.concat(F.lit("C "), base64(F.col("body"))), F.lit("C-END"))).otherwise(none)
    source = lambda x: F.concat(F.lit("S "), F.col("id"), F.lit(" url="), x["url"], F.lit(' title="'), plain(F.coalesce(x["title"], F.lit(""))), F.lit('" accessed='), F.coalesce(x["accessed"], F.lit("-")))
    lines = F.concat(F.array(head), body, F.coalesce(F.transform("sources", source), none))
    return notes.select(F.lit(NOTES).alias("section"), F.col("id").alias("at"), F.posexplode(lines).alias("part", "line"))


def write_all(notes: DataFrame, edges: DataFrame, path: str, store: str = "store", attachments: DataFrame | None = None, config: str = "") -> None:
    """The pack as text files: a header, the configuration, notes by id with bodies and sources, links, attachments (path, name, content_type, data) and the end. Partitions are ranges of what lines belong to, so these stay together and in order."""
    spark, notes = notes.sparkSession, _whole(notes)
    count = lambda d, name: d.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    sizes = count(notes, "n").join(count(edges, "l"), "one")
    sizes = sizes.join(count(attachments, "a"), "one") if attachments is not None else sizes.withColumn("a", F.lit(0))
    text = lambda c: F.col(c).cast("string")
    first = F.concat(F.lit(f"H pack=1 version=1.0 store={store} notes="), text("n"), F.lit(" links="), text("l"), F.lit(" attachments="), text("a"), F.lit(f" config={int(bool(config))}"))
    head = sizes.select(F.lit(HEAD).alias("section"), F.lit("").alias("at"), F.posexplode(F.array(first, *((F.concat(F.lit("CFG "), base64(F.lit(config))), F.lit("CFG-END")) if config else ()))).alias("part", "line"))
    links = link_lines(edges.withColumn("position", F.col("position") if "position" in edges.columns else F.lit(0)).withColumn("__at", F.col("src")))
    every = head.unionByName(_lines_of_notes(notes)).unionByName(links.select(F.lit(LINKS).alias("section"), F.split("line", " ")[1].alias("at"), "part", "line"))
    if attachments is not None:
        own = F.array(F.concat(F.lit("A "), "path", F.lit(" name="), "name", F.lit(" content_type="), F.coalesce("content_type", F.lit("-"))), F.concat(F.lit("D "), F.regexp_replace(F.base64("data"), r"[\r\n]", "")), F.lit("D-END"))
        every = every.unionByName(attachments.select(F.lit(FILES).alias("section"), F.col("path").alias("at"), F.posexplode(own).alias("part", "line")))
    every = every.unionByName(spark.createDataFrame([(END, "", 0, "END")], "section int, at string, part int, line string"))
    every.repartitionByRange("section", "at").sortWithinPartitions("section", "at", "part").select("line").write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, owner) of the lines of the packs at a path: owner is the note or attachment whose line was the last before, across splits of a file and the files of one folder in the order of their names."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    opened = F.when(F.col("value").rlike("^[NA] "), F.split("value", " ", 3)[1])
    split = Window.partitionBy("file", "start")
    inside = rows.withColumn("own", F.last(opened, ignorenulls=True).over(split.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("file", "start").agg(F.max_by(opened, F.when(opened.isNotNull(), F.col("place"))).alias("last"))
    folder = F.regexp_replace("file", "[^/]*$", "")  # a row for each split of a pack
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(Window.partitionBy(folder).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))).select("file", "start", "carried")
    return inside.join(carried, ["file", "start"]).select(F.col("value").alias("line"), F.coalesce("own", "carried").alias("owner"))


def _value(name: str, line: str = "line") -> Column:
    """The value of name= in a line, quoted or up to the next blank; null without it."""
    found = F.regexp_extract(line, rf'(?: |^){name}=("(?:[^"]*)"|[^ ]*)', 1)
    return F.when(F.col(line).rlike(rf"(?: |^){name}="), F.regexp_replace(found, '^"|"$', ""))


def whole_notes(lines: DataFrame) -> DataFrame:
    """Notes with all their metadata, bodies and sources, from lines (line, owner)."""
    n = lines.filter(F.col("line").startswith("N "))
    part = lambda i: F.regexp_extract("line", r'^N (\S+) (\S+) "((?:\\"|[^"])*)"(.*)$', i)
    n = n.select(part(1).alias("id"), part(2).alias("type"), F.replace(part(3), F.lit('\\"'), F.lit('"')).alias("title"), part(4).alias("line"))
    listed = lambda c: F.when(F.coalesce(c, F.lit("-")).isin("-", ""), F.array().cast("array<string>")).otherwise(F.split(c, ","))
    time = lambda name: F.try_to_timestamp(F.nullif(_value(name), F.lit("-")))
    meta = n.select("id", "type", "title", listed(_value("tags")).alias("tags"), time("created").alias("created"), time("updated").alias("updated"), _value("summary").alias("summary"), listed(_value("compacts")).alias("compacts"), *(_value(c).alias(c) for c in QUOTED), _value("verified").try_cast("boolean").alias("verified"), _value("value").try_cast("int").alias("value"), F.unbase64(_value("custom")).cast("string").alias("custom"))
    bodies = lines.filter(F.col("line").startswith("C ")).select(F.col("owner").alias("id"), F.unbase64(F.substring_index("line", " ", -1)).cast("string").alias("body"))
    s = lines.filter(F.col("line").startswith("S ")).select(F.split("line", " ", 3)[1].alias("id"), F.struct(_value("url").alias("url"), F.nullif(_value("title"), F.lit("")).alias("title"), F.nullif(_value("accessed"), F.lit("-")).alias("accessed")).alias("s"))
    sources = s.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("sources"))
    return meta.join(bodies, "id", "left").join(sources, "id", "left").withColumn("body", F.coalesce("body", F.lit("")))


def attachments(lines: DataFrame) -> DataFrame:
    """(path, name, content_type, data) from lines (line, owner)."""
    a = lines.filter(F.col("line").startswith("A ")).select(F.split("line", " ", 3)[1].alias("path"), _value("name").alias("name"), F.nullif(_value("content_type"), F.lit("-")).alias("content_type"))
    d = lines.filter(F.col("line").startswith("D ")).select(F.col("owner").alias("path"), F.unbase64(F.substring_index("line", " ", -1)).alias("data"))
    return a.join(d, "path", "left")


def faults(lines: DataFrame) -> DataFrame:
    """(what, said, there) of a pack that is cut off or whose numbers of notes, links or attachments differ from its header's; no rows for a whole one."""
    kinds = {"notes": "N ", "links": "L ", "attachments": "A "}
    counted = lines.agg(*(F.count_if(F.col("line").startswith(p)).alias(k) for k, p in kinds.items()), F.count_if(F.col("line") == "END").alias("end"), F.max(F.when(F.col("line").startswith("H "), F.col("line"))).alias("line"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("what"), _value(k).try_cast("long").alias("said"), F.col(k).alias("there")) for k in kinds), F.struct(F.lit("end").alias("what"), F.lit(1).cast("long").alias("said"), F.col("end").alias("there"))))
    return counted.select(each.alias("x")).select("x.*").filter("not (said <=> there)")


def fields(line: Column) -> Column:
    """k=v parts of a line as a map."""
    return F.map_from_entries(F.transform(F.regexp_extract_all(line, F.lit(r"(?:^| )([a-z_]+)=([^ ]*)"), F.lit(0)), lambda x: F.struct(F.substring_index(F.trim(x), "=", 1).alias("k"), F.regexp_replace(F.trim(x), "^[a-z_]+=", "").alias("v"))))


def read_notes(lines: DataFrame) -> DataFrame:
    """Notes of N lines (line): id, type, title and metadata."""
    n = lines.filter(F.col("line").startswith("N "))
    part = lambda i: F.regexp_extract("line", r'^N (\S+) (\S+) "((?:\\"|[^"])*)"(.*)$', i)
    meta = n.select(part(1).alias("id"), part(2).alias("type"), F.replace(part(3), F.lit('\\"'), F.lit('"')).alias("title"), fields(part(4)).alias("m"))
    tags = F.when(F.col("m")["tags"] == "-", F.array().cast("array<string>")).otherwise(F.split(F.col("m")["tags"], ","))
    return meta.select("id", "type", "title", tags.alias("tags"), F.try_to_timestamp(F.nullif(F.col("m")["created"], F.lit("-"))).alias("created"), F.col("m")["value"].try_cast("int").alias("value"))


def read_bodies(blocks: DataFrame) -> DataFrame:
    """Bodies of whole packs (value), one file a row, decoded: what follows C below the line of its note, or stands between C with the note's id and C-END."""
    each = lambda pattern: F.regexp_extract_all("value", F.lit(pattern), F.lit(0))
    found = blocks.select(F.explode(F.concat(each(r"(?m)^C \S+\n[^\n]*\nC-END$"), each(r"(?m)^N \S+ [^\n]*\nC \S+\nC-END$"))).alias("b"))
    below = F.split("b", "\n")[1]
    return found.select(F.regexp_extract("b", r"^[CN] (\S+)", 1).alias("id"), F.unbase64(F.when(F.col("b").startswith("N "), F.substring(below, 3, 1 << 30)).otherwise(below)).cast("string").alias("body"))


def read_links(lines: DataFrame) -> DataFrame:
    """Links of L lines (line)."""
    p = F.split("line", " ")
    return lines.filter(F.col("line").startswith("L ")).select(p[1].alias("src"), F.nullif(_value("type"), F.lit("-")).alias("link_type"), p[2].alias("dst"), (_value("inline") == "true").alias("inline"))


def read_json(lines: DataFrame, schema: str) -> DataFrame:
    """Notes of a pack in JSON (line), an object each; bad lines give nulls."""
    return lines.select(F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("x")).select("x.*")
