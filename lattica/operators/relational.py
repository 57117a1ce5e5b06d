"""Scans, joins, aggregations, orders and set operations over notes and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.model import DEFAULT_VALUE
from lattica.sources.storage import written

METADATA = ["id", "title", "type", "value", "created", "updated", "verified", "tags"]


def list_order(notes: DataFrame) -> DataFrame:
    """Newest first; notes without a creation time come first."""
    return notes.orderBy(F.col("created").desc_nulls_first(), "id")


def export_order(notes: DataFrame) -> DataFrame:
    """Oldest first; notes without a creation time come last."""
    return notes.orderBy(F.col("created").asc_nulls_last(), "id")


def context_order(notes: DataFrame) -> DataFrame:
    """Verified first, then by the way in (link_type), then oldest."""
    rank = F.when(F.col("link_type").isin("part-of", "supports"), 0).when(F.col("link_type") == "related", 2).otherwise(1)
    return notes.orderBy(F.coalesce("verified", F.lit(False)).desc(), rank, F.col("created").asc_nulls_last(), "id")


def numbered(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Rows with their place in a total order, from 1. They are sorted by ranges and written; each partition then counts on from the rows before it, so no task holds more than its range."""
    at = F.monotonically_increasing_id()  # number of the partition, and 33 bits for the place in it
    placed = written(rows.orderBy(*order).withColumn("__at", at), "numbered").withColumns({"__part": F.shiftright("__at", 33), "__own": F.col("__at").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__start")))  # a row for each partition
    return placed.join(starts, "__part").withColumn(name, F.col("__start") + F.col("__own") + 1).drop("__at", "__part", "__own", "__start")


def metadata(notes: DataFrame) -> DataFrame:
    """Notes without bodies."""
    return notes.select(*METADATA)


def first_n(notes: DataFrame, n: int, by: Column) -> DataFrame:
    """The n first by an order, as a top-k without a full sort."""
    return notes.orderBy(by, "id").limit(n)


def quick(notes: DataFrame, n: int, recency: str = "updated") -> DataFrame:
    """All collections and the n most recent other notes."""
    other = first_n(notes.filter("type <> 'moc'"), n, F.col(recency).desc_nulls_last())
    return notes.filter("type = 'moc'").unionByName(other)


def resolve(notes: DataFrame, text: str, prefix: str = "qp-") -> DataFrame:
    """The note of an id, or of the first two dash parts of a slug; else the first note whose title holds the text."""
    if text.startswith(prefix):
        return notes.filter(F.col("id") == "-".join(text.split("-")[:2]))
    return notes.filter(F.col("title").contains(text)).orderBy("id").limit(1)


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def nested(notes: DataFrame, tags: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes with their tags and links as arrays, each gathered once per note."""
    t = tags.groupBy(F.col("note_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("all_tags"))
    e = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "link_type", "dst"))).alias("links"))
    return notes.select("id").join(t, "id", "left").join(e, "id", "left")


def backlinks(edges: DataFrame, note_id: str) -> DataFrame:
    return edges.filter(F.col("dst") == note_id)


def outbound(edges: DataFrame, note_id: str) -> DataFrame:
    return edges.filter(F.col("src") == note_id)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of which both ends are among the ids."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def resolve_links(links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved) of links (src, dst, link_type, ...) by whether their target exists; repeated edges once."""
    known = ids.select(F.col("id").alias("dst"))
    return links.join(known, "dst", "left_semi").dropDuplicates(["src", "dst", "link_type"]), links.join(known, "dst", "left_anti").select("src", F.col("dst").alias("target_ref")).distinct()


def semantic_conflicts(edges: DataFrame) -> DataFrame:
    """Pairs that support and contradict, or are the same as and an alias of, each other, in one pass by pair."""
    has = lambda k: F.bool_or(F.col("link_type") == k)
    pairs = edges.filter("not inline").groupBy("src", "dst").agg((has("supports") & has("contradicts")).alias("argument"), (has("same-as") & has("alias-of")).alias("identity"))
    return pairs.filter("argument or identity")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) by a full join: insert, delete or update."""
    o, n = (d.select(key, *(F.col(c).alias(f"{p}_{c}") for c in columns), F.lit(True).alias(f"in_{p}")) for d, p in ((old, "o"), (new, "n")))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    kind = F.when(F.col("in_o").isNull(), "insert").when(F.col("in_n").isNull(), "delete").when(~same, "update")
    return o.join(n, key, "full").select(key, kind.alias("change")).filter("change is not null")


def keep_latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by an order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without those that new ones replace, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def ordered_union(*selectors: DataFrame) -> DataFrame:
    """Ids of selectors (id, pos) in the order of selectors; the first way in wins."""
    out = None
    for i, s in enumerate(selectors):
        s = s.select("id", F.lit(i).alias("source_rank"), F.col("pos").cast("long").alias("pos"))
        out = s if out is None else out.unionByName(s)
    return keep_latest(out, ["id"], F.col("source_rank"), F.col("pos"))


def running_budget(rows: DataFrame, size: str, order: list, budget: int, start: int = 0) -> DataFrame:
    """Rows of the longest prefix, by order, whose sizes with the start fit the budget."""
    upto = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + start
    return rows.withColumn("used", upto).filter(F.col("used") <= budget)


def fanout(edges: DataFrame, k: int) -> DataFrame:
    """The first k neighbours of each node by type and id."""
    w = Window.partitionBy("src").orderBy("link_type", "dst")
    return edges.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def effective_value(value: Column) -> Column:
    return F.coalesce(value, F.lit(DEFAULT_VALUE))
