"""Notes, links and telemetry as a fixed projection of the generic tables documents, labels and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.analysis import PLAIN, STEMMED, Analyser
from lattica.model import ID_PREFIX

from . import markdown
from .index import Index
from .storage import fingerprint, new_path

_indexes: dict[tuple, Index] = {}
_folders: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def note_id(number: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), number.cast("string"))


def days_after(start: str, days: Column) -> Column:
    return F.to_timestamp(F.date_add(F.lit(start).cast("date"), days.cast("int")))


class Store:
    """The relations of one store, built lazily; a plan reads only the columns that it uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def size(self) -> int:
        """Number of notes, from the files' footers."""
        return self.table("documents").count()

    def index_by(self, analyser: Analyser) -> Index:
        """The stored index of the notes and edges by an analyser's terms, built at its first use in a session and used as long as the tables stay as they are."""
        mark = (self.spark.sparkContext.applicationId, analyser, self.sf_dir, *(fingerprint(self.spark, f"{self.sf_dir}/{t}.parquet") for t in ("documents", "labels")))
        if mark not in _indexes:
            _indexes[mark] = index = Index(self.spark, new_path(self.spark, "index", keep=True), analyser)
            index.build(self.notes, self.edges)
        return _indexes[mark]

    @property
    def index(self) -> Index:
        """The index of words as they stand."""
        return self.index_by(PLAIN)

    @property
    def stemmed(self) -> Index:
        """The index of stems without marks on letters."""
        return self.index_by(STEMMED)

    @property
    def folder(self) -> str:
        """A folder with a markdown file of every note, written at its first use in a session."""
        mark = (self.spark.sparkContext.applicationId, self.sf_dir, fingerprint(self.spark, f"{self.sf_dir}/documents.parquet"))
        if mark not in _folders:
            path = new_path(self.spark, "notes", keep=True)
            markdown.write(self.notes, path)
            _folders[mark] = path
        return _folders[mark]

    @property
    def base(self) -> DataFrame:
        """Columns that the documents alone give."""
        d = F.col("doc_id")
        created = F.when(d % 11 != 0, days_after("2024-01-01", d % 365))
        kind = F.when(d % 10 == 0, "moc").when(d % 10 <= 3, "permanent").when(d % 10 <= 6, "literature").otherwise("fleeting")
        return self.table("documents").select(
            "doc_id", note_id(d).alias("id"), F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"), F.col("text").alias("body"), kind.alias("type"),
            F.when(d % 7 != 0, (d % 101).cast("int")).alias("value"), created.alias("created"), F.when((d % 3 != 0) & (d % 11 != 0), days_after("2024-01-01", d % 365 + d % 30)).alias("updated"),
            F.array("lang", "source").alias("own_tags"))

    @property
    def notes(self) -> DataFrame:
        labels = self.table("labels").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        n = self.base.join(labels, F.col("doc_id") == F.col("l_id"), "left")
        tags = F.when(F.coalesce(F.col("toxic") == 1, F.lit(False)), F.concat("own_tags", F.array(F.lit("tox")))).otherwise(F.col("own_tags"))
        return n.select("doc_id", "id", "title", "body", "type", "value", "created", "updated", (F.col("quality") == 1).alias("verified"), tags.alias("tags"))

    @property
    def custom(self) -> DataFrame:
        """(id, custom): metadata of notes as JSON, where an event has the note's number."""
        e = self.table("events").select(F.col("event_id"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value", F.col("event_type").alias("kind"), F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("day"), F.get_json_object("props", "$.k").alias("code"))
        docs = self.table("documents").select("doc_id")
        return docs.join(e, F.col("doc_id") == F.col("event_id")).select(note_id(F.col("doc_id")).alias("id"), F.to_json(F.struct("k", "value", "kind", "day", "code")).alias("custom"))

    @property
    def tags(self) -> DataFrame:
        return self.notes.select(F.col("id").alias("note_id"), F.explode("tags").alias("tag"))

    @property
    def edges(self) -> DataFrame:
        d, n = F.col("doc_id"), F.lit(self.size)
        one = lambda to, kind, inline, at, when=None: F.when(F.lit(True) if when is None else when, F.struct((to % n).alias("to"), F.lit(kind).alias("link_type"), F.lit(inline).alias("inline"), F.lit(at).alias("position")))
        four = F.array(one(3 * d + 1, "supports", False, 0), one(5 * d + 2, "part-of", False, 1), one(d + 1, "follows", False, 2, d % 2 == 0), one(7 * d + 3, "related", True, 3))
        e = self.table("documents").select("doc_id", F.explode(four).alias("e")).filter(F.col("e").isNotNull() & (F.col("e.to") != d))
        return e.select(note_id(d).alias("src"), note_id(F.col("e.to")).alias("dst"), "e.link_type", "e.inline", "e.position")

    @property
    def unresolved(self) -> DataFrame:
        d = F.col("doc_id")
        return self.table("documents").filter(d % 50 == 0).select(note_id(d).alias("src"), note_id(d + self.size).alias("target_ref"))

    @property
    def compacts(self) -> DataFrame:
        d = F.col("doc_id")
        more = F.when(d % 20 == 0, F.array(d + 1, d + 2, d + 3)).otherwise(F.array().cast("array<bigint>"))
        more = F.concat(more, F.when(d % 200 == 100, F.array(d + 20)).otherwise(F.array().cast("array<bigint>")))
        e = self.table("documents").select("doc_id", F.explode(more).alias("s")).filter(F.col("s") < self.size)
        return e.select(note_id(d).alias("digest_id"), note_id(F.col("s")).alias("source_id"))

    @property
    def telemetry(self) -> DataFrame:
        return self.table("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("command"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("user_id") % 5)).alias("error"))


#: The same projection as common table expressions.
SQL = """
n AS (SELECT count(*) AS c FROM documents),
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
notes AS (SELECT d.doc_id, 'qp-'||d.doc_id AS id, substr(split_part(d.text,chr(10),1),1,60) AS title, d.text AS body,
  CASE WHEN d.doc_id%10=0 THEN 'moc' WHEN d.doc_id%10<=3 THEN 'permanent' WHEN d.doc_id%10<=6 THEN 'literature' ELSE 'fleeting' END AS type,
  CASE WHEN d.doc_id%7<>0 THEN (d.doc_id%101)::INT END AS value,
  CASE WHEN d.doc_id%11<>0 THEN TIMESTAMP '2024-01-01' + to_days((d.doc_id%365)::INT) END AS created,
  CASE WHEN d.doc_id%11<>0 AND d.doc_id%3<>0 THEN TIMESTAMP '2024-01-01' + to_days((d.doc_id%365+d.doc_id%30)::INT) END AS updated,
  l.quality=1 AS verified, CASE WHEN coalesce(l.toxic=1,false) THEN [d.lang,d.source,'tox'] ELSE [d.lang,d.source] END AS tags
  FROM documents d LEFT JOIN lab l USING (doc_id)),
custom AS (SELECT 'qp-'||d.doc_id AS id, (e.props->>'$.k')::BIGINT AS k, e.value, e.event_type AS kind, CASE WHEN e.event_id%5<>0 THEN strftime(e.ts,'%Y-%m-%d') END AS day FROM documents d JOIN events e ON d.doc_id=e.event_id),
tags AS (SELECT id AS note_id, unnest(tags) AS tag FROM notes),
e0 AS (SELECT doc_id, unnest([{'t':3*doc_id+1,'k':'supports','i':false,'p':0,'w':true},{'t':5*doc_id+2,'k':'part-of','i':false,'p':1,'w':true},{'t':doc_id+1,'k':'follows','i':false,'p':2,'w':doc_id%2=0},{'t':7*doc_id+3,'k':'related','i':true,'p':3,'w':true}]) AS e FROM documents),
edges AS (SELECT 'qp-'||doc_id AS src, 'qp-'||(e.t%n.c) AS dst, e.k AS link_type, e.i AS inline, e.p AS position FROM e0, n WHERE e.w AND e.t%n.c<>doc_id),
unresolved AS (SELECT 'qp-'||doc_id AS src, 'qp-'||(doc_id+n.c) AS target_ref FROM documents, n WHERE doc_id%50=0),
compacts AS (SELECT 'qp-'||doc_id AS digest_id, 'qp-'||s AS source_id FROM (SELECT doc_id, unnest(CASE WHEN doc_id%200=100 THEN [doc_id+1,doc_id+2,doc_id+3,doc_id+20] ELSE [doc_id+1,doc_id+2,doc_id+3] END) AS s FROM documents WHERE doc_id%20=0), n WHERE s<n.c),
telemetry AS (SELECT ts, event_type AS command, event_type<>'error' AS success, value AS duration_ms, CASE WHEN event_type='error' THEN 'e'||(user_id%5) END AS error FROM events)
"""
