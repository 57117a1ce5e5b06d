"""A stored index of notes: metadata by id, postings by term, links by source and by target.

Tables are sorted by what they are looked up by, so a look-up reads the few row groups that can hold its key. A posting
carries its note's length and time of change, so that a search needs no join, and the places of its term in the note; stop
words have postings too, so that phrases can hold them, but count in no length. Each segment is marked with the analyser
that made its terms, and an index is read and written by that one only. The index is a row of segments. The first
ones are batches of a build: each is whole once its mark stands, so a build that was interrupted goes on with the batches
that have none. Later ones hold notes that changed or went; what they name counts no longer in the segments before. Reading
leaves such rows out; merge() writes one segment of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.analysis import PLAIN, Analyser
from lattica.functions.text import NO_WORD, inverse
from lattica.model import STOP_WORDS

from .storage import _store, remove, written

META = ["id", "title", "type", "value", "created", "updated", "verified", "tags"]
#: Table: (schema, column that names the note that a row belongs to, columns that the rows are sorted by).
TABLES = {
    "notes": ("id string, title string, type string, value int, created timestamp, updated timestamp, verified boolean, tags array<string>", "id", ["id"]),
    "postings": ("term string, note_id string, title long, tags long, body long, length long, updated timestamp, places array<long>", "note_id", ["term", "note_id"]),
    "lengths": ("note_id string, length long", "note_id", ["note_id"]),
    "links": ("src string, dst string, link_type string, provenance string, original string, position int, owner string", "owner", ["src", "dst"]),
}
NEW, CHANGED, WHOLE = "_new", "_changed", "_whole"
MADE_BY = "_by-"
#: Columns of a note in the order of their places, a place being the column's number times COLUMN_PLACES plus the word's.
TEXTS = ("title", "tags", "body")
COLUMN_PLACES = 1 << 32


def counted(notes: DataFrame) -> DataFrame:
    """(note_id, updated, term, title, tags, body): how often each term stands in the columns of a note. Terms are counted within each task before anything is shuffled."""
    text = {"title": F.col("title"), "body": F.col("body"), "tags": F.array_join("tags", " ")}
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.split(F.lower(t), NO_WORD).alias("terms")) for c, t in text.items())))
    rows = notes.select(F.col("id").alias("note_id"), "updated", each.alias("x")).select("note_id", "updated", "x.col", F.explode("x.terms").alias("term"))
    rows = rows.filter((F.col("term") != "") & ~F.col("term").isin(STOP_WORDS))  # after the explosion, where the set is a hash look-up
    return rows.groupBy("note_id", "updated", "term").agg(*(F.count_if(F.col("col") == c).alias(c) for c in ("title", "tags", "body")))


PLACED = "note_id string, updated timestamp, term string, title long, tags long, body long, places array<long>, own long, length long"
#: Words that a task takes to pieces at once; a longer note is taken alone.
WORDS_AT_ONCE = 1 << 20


def _postings(analyser: Analyser):
    """(note_id, updated, title, tags, body), the last three as lists of words, to PLACED, for mapInArrow: each row's words are grouped by term where they are, in slices of WORDS_AT_ONCE."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sizes = sum(pc.fill_null(pc.list_value_length(b[c]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in TEXTS)
            total, at = np.cumsum(sizes), 0
            while at < b.num_rows:
                before = total[at - 1] if at else 0
                end = max(int(np.searchsorted(total, before + WORDS_AT_ONCE, "right")), at + 1)
                yield of_slice(b.slice(at, end - at))
                at = end

    def of_slice(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, cols, place = [], [], []
        for i, c in enumerate(TEXTS):
            n = pc.fill_null(pc.list_value_length(b[c]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows.append(np.repeat(np.arange(len(n)), n))
            cols.append(np.full(n.sum(), i))
            place.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        coded = pa.concat_arrays([b[c].flatten() for c in TEXTS]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        term, terms = pd.factorize(pd.Series(analyser.terms_of(words), dtype=object))
        stop = np.array([w in STOP_WORDS for w in words], bool)
        word = coded.indices.to_numpy(zero_copy_only=False)
        row, col, place = np.concatenate(rows), np.concatenate(cols), np.concatenate(place)
        order = np.argsort(row * max(len(terms), 1) + term[word], kind="stable")  # stable: places of a term stay in order
        row, col, place, word = row[order], col[order], place[order], word[order]
        code = term[word]
        first = np.nonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]))[0] if len(row) else np.zeros(0, np.int64)
        group = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)
        own = group((~stop[word]).astype(np.int64)) if len(words) else np.zeros(0, np.int64)
        of = row[first]
        lengths = np.bincount(of, own, b.num_rows).astype(np.int64)[of]
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(col * COLUMN_PLACES + place))
        taken = pa.array(of)
        names = pa.array(terms.tolist(), pa.string()).take(pa.array(code[first]))
        counts = [pa.array(group((col == i).astype(np.int64))) for i in range(len(TEXTS))]
        return pa.RecordBatch.from_arrays([b["note_id"].take(taken), b["updated"].take(taken), names, *counts, places, pa.array(own), pa.array(lengths)], ["note_id", "updated", "term", *TEXTS, "places", "own", "length"])

    return run


def placed(notes: DataFrame, analyser: Analyser = PLAIN) -> DataFrame:
    """(note_id, updated, term, title, tags, body, places, length): how often and where each term stands in a note, and the note's words without stop words. Words are grouped in the row that they stand in, so neither texts nor words are shuffled or sorted by Spark; only where rows repeat an id are their postings brought together."""
    text = {"title": F.col("title"), "tags": F.array_join("tags", " "), "body": F.col("body")}
    words = notes.select(F.col("id").alias("note_id"), "updated", *(F.filter(analyser.words(t), lambda w: w != "").alias(c) for c, t in text.items()))
    rows = words.mapInArrow(_postings(analyser), PLACED)
    if notes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return rows.drop("own")
    merged = rows.groupBy("note_id", "updated", "term").agg(*(F.sum(c).alias(c) for c in TEXTS), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"), F.sum("own").alias("own"))
    return merged.withColumn("length", F.sum("own").over(Window.partitionBy("note_id"))).drop("own")


class Index:
    """The index below a folder of any store that the session reaches, by the terms of an analyser."""

    def __init__(self, spark: SparkSession, root: str, analyser: Analyser = PLAIN):
        self.spark, self.root, self.analyser = spark, root, analyser
        self._statistics: tuple[int, float] | None = None

    # Segments

    def segments(self) -> list[tuple[int, str]]:
        """(number, mark) of the segments that are written to the end and count: the last merged one and those after it. A segment made by another analyser is refused."""
        where, store = _store(self.spark, self.root)
        if not store.exists(where):
            return []
        found = []
        for d in store.listStatus(where):
            name = d.getPath().getName()
            if not name.isdigit():
                continue
            marks = {f.getPath().getName() for f in store.listStatus(d.getPath())}
            if other := [m for m in marks if m.startswith(MADE_BY) and m != MADE_BY + self.analyser.mark]:
                raise ValueError(f"{self.root} was made by the analyser {other[0].removeprefix(MADE_BY)}, not {self.analyser.mark}; rebuild it")
            found += [(int(name), mark) for mark in (NEW, CHANGED, WHOLE) if mark in marks]
        found.sort()
        start = max((i for i, (_, mark) in enumerate(found) if mark == WHOLE), default=0)
        return found[start:]

    def _write(self, number: int, rows: dict[str, DataFrame], mark: str) -> None:
        """All tables of a segment, and then the mark that makes them count."""
        top = f"{self.root}/{number:06d}"
        where, store = _store(self.spark, f"{top}/{MADE_BY}{self.analyser.mark}")
        store.create(where).close()
        for name, df in rows.items():
            order = TABLES[name][2] if name in TABLES else ["id"]
            columns = T._parse_datatype_string(TABLES[name][0]).names if name in TABLES else ["id"]
            df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(f"{top}/{name}")
        where, store = _store(self.spark, f"{top}/{mark}")
        store.create(where).close()
        self._statistics = None

    def _rows(self, notes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
        postings = written(placed(notes, self.analyser), "postings")  # texts are taken to pieces once; dealing out by ranges reads its input twice
        types = {f.name: f.dataType for f in T._parse_datatype_string(TABLES["notes"][0])}
        meta = notes.select(*((F.col(c) if c in notes.columns else F.lit(None)).cast(types[c]).alias(c) for c in META))
        owner = F.when(F.col("provenance") == "virtual", F.col("dst")).otherwise(F.col("src"))
        own = edges.select("src", "dst", "link_type", F.when(F.col("inline"), "inline").otherwise("typed").alias("provenance"), F.col("link_type").alias("original"), F.col("position").cast("int").alias("position"))
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), inverse(F.col("link_type")).alias("link_type"), F.lit("virtual").alias("provenance"), F.col("link_type").alias("original"), F.col("position").cast("int").alias("position"))
        return {"notes": meta, "postings": postings, "lengths": postings.filter("length > 0").groupBy("note_id").agg(F.max("length").alias("length")), "links": own.unionByName(back).withColumn("owner", owner)}

    def build(self, notes: DataFrame, edges: DataFrame, batches: int = 1, most: int | None = None) -> list[int]:
        """Indexes notes (with title, body, tags and updated) and edges by src in batches by a hash of the id, leaving out those that are whole, at most so many in this call; gives back the batches done. Call it with the same input and number of batches until nothing is left."""
        done = {k for k, _ in self.segments()}
        part = lambda c: self.batch(F.col(c), batches)
        todo = [k for k in range(batches) if k not in done][:most]
        for k in todo:
            own, links = (notes, edges) if batches == 1 else (notes.filter(part("id") == k), edges.filter(part("src") == k))
            self._write(k, self._rows(own, links), NEW)
        return todo

    @staticmethod
    def batch(note_id: Column, batches: int) -> Column:
        """The batch of a note, by its id alone."""
        return F.pmod(F.conv(F.substring(F.md5(note_id.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(batches))

    def put(self, notes: DataFrame, edges: DataFrame) -> None:
        """New or changed notes with all their edges, in place of what the index holds of them."""
        number = max((k for k, _ in self.segments()), default=-1) + 1
        self._write(number, self._rows(notes, edges) | {"ids": notes.select("id").distinct()}, CHANGED)

    def delete(self, ids: DataFrame) -> None:
        """Takes notes (id) out, with the edges that they have."""
        number = max((k for k, _ in self.segments()), default=-1) + 1
        self._write(number, {"ids": ids.select("id").distinct()}, CHANGED)

    def sync(self, notes: DataFrame, edges: DataFrame, key: str = "updated") -> tuple[int, int]:
        """Brings the index to the notes as they are now: notes whose key differs or that are new are put in, missing ones taken out. Gives back how many."""
        old = self.notes.select("id", F.col(key).alias("__old"), F.lit(True).alias("__in"))
        now = notes.join(old, "id", "left")
        changed = now.filter(F.col("__in").isNull() | ~F.col(key).eqNullSafe(F.col("__old"))).drop("__old", "__in")
        gone = old.select("id").join(notes.select("id"), "id", "left_anti")
        counts = changed.count(), gone.count()
        if counts[1]:
            self.delete(gone)
        if counts[0]:
            self.put(changed, edges.join(changed.select(F.col("id").alias("src")), "src", "left_semi"))
        return counts

    def merge(self) -> None:
        """One segment in place of all. Once its mark stands those before count no longer, and they are removed."""
        old = [k for k, _ in self.segments()]
        self._write(max(old, default=-1) + 1, {name: self.table(name) for name in TABLES}, WHOLE)
        for k in old:
            remove(self.spark, f"{self.root}/{k:06d}")

    # Reading

    def table(self, name: str) -> DataFrame:
        """The rows of a table that count."""
        schema, owner, _ = TABLES[name]
        parts, later = [], None
        for number, mark in reversed(self.segments()):
            where, store = _store(self.spark, f"{self.root}/{number:06d}/{name}")
            if store.exists(where):
                df = self.spark.read.schema(schema).parquet(where.toString())
                parts.append(df if later is None else df.join(later.withColumnRenamed("id", owner), owner, "left_anti").select(*df.columns))
            if mark == CHANGED:
                ids = self.spark.read.schema("id string").parquet(f"{self.root}/{number:06d}/ids")
                later = ids if later is None else later.unionByName(ids)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    @property
    def notes(self) -> DataFrame:
        """Metadata of all notes, without bodies."""
        return self.table("notes")

    @property
    def postings(self) -> DataFrame:
        """Counts by note and term, without stop words."""
        return self.table("postings").filter(~F.col("term").isin(STOP_WORDS)).drop("places")

    def rebuild(self, notes: DataFrame, edges: DataFrame) -> None:
        """Removes what is there, by whatever analyser, and builds anew."""
        remove(self.spark, self.root)
        self._statistics = None
        self.build(notes, edges)

    @property
    def links(self) -> DataFrame:
        """Edges by source, and as virtual ones with their inverse type by target; original is the type as written."""
        return self.table("links")

    def steps(self, direction: str = "both") -> DataFrame:
        """(src, dst, link_type) as a walk in the direction sees them."""
        keep = {"out": F.col("provenance") != "virtual", "in": F.col("provenance") == "virtual", "both": F.lit(True)}[direction]
        return self.links.filter(keep).select("src", "dst", "link_type")

    def backlinks(self, note_id: str) -> DataFrame:
        """(src, link_type) of the edges to a note."""
        return self.links.filter((F.col("src") == note_id) & (F.col("provenance") == "virtual")).select(F.col("dst").alias("src"), F.col("original").alias("link_type"))

    def statistics(self) -> tuple[int, float]:
        """How many notes have a term, and their mean length; worked out once for every state of the index."""
        if self._statistics is None:
            total, mean = self.table("lengths").agg(F.count("*"), F.avg("length")).first()
            self._statistics = total, float(mean or 1)
        return self._statistics
