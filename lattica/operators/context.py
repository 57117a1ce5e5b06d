"""Selections of notes under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import format_tags

from .relational import running_budget


def note_size(with_body: bool = False) -> Column:
    """Estimated bytes of a note in a context: fixed overheads and the bytes of its fields; columns id, title, type, tags, body, summary."""
    n = lambda c: F.octet_length(c)
    size = n("id") + 15 + n("title") + 20 + n("type") + 15 + n(format_tags(F.col("tags"))) + 20 + 100
    return size + (n("body") + 30 if with_body else n("summary") + F.when(F.col("summary") != "", n("id") + 5).otherwise(0))


def prime_size(kind: str, collection: bool) -> Column:
    """Estimated characters of a note in a primer, by format: human, records or json."""
    n = lambda c: F.octet_length(c)
    size = n("id") + n("title")
    if kind == "human":
        return size + n(F.array_join("tags", ", ")) + 15 if collection else size + 5
    if kind == "records":
        return size + n(format_tags(F.col("tags"))) + 15 if collection else size + n("type") + n(format_tags(F.col("tags"))) + 20
    tags = n(F.to_json("tags"))
    return size + tags + 50 if collection else size + n("type") + tags + 50


def prime(notes: DataFrame, budget: int = 6000, base: int = 500, collections: int = 10, recent: int = 10, kind: str = "human") -> DataFrame:
    """Collections by last change, then recent notes, each the longest prefix that fits; both inputs are top-k already."""
    mocs = notes.filter("type = 'moc'").withColumn("at", F.col("updated")).orderBy(F.col("at").desc_nulls_first(), "id").limit(collections).withColumn("size", prime_size(kind, True)).withColumn("part", F.lit(0))
    rest = notes.filter("type <> 'moc'").withColumn("at", F.coalesce("updated", "created")).orderBy(F.col("at").desc_nulls_first(), "id").limit(recent).withColumn("size", prime_size(kind, False)).withColumn("part", F.lit(1))
    fit = running_budget(mocs.unionByName(rest), "size", ["part", F.col("at").desc_nulls_first(), "id"], budget, base)
    return fit.select("id", "part", "size", "used")


def blocks_within(rows: DataFrame, size: str, order: list, budget: int, start: int = 0) -> DataFrame:
    """Rows taken greedily in order: one that doesn't fit is left out and later, smaller ones may still fit. Sequential by nature, over a top-k held as one array."""
    w = Window.orderBy(*order)
    listed = rows.withColumn("__place", F.row_number().over(w)).agg(F.array_sort(F.collect_list(F.struct("__place", F.col(size).cast("long").alias("s"), "id"))).alias("a"))
    zero = F.struct(F.lit(start).cast("long").alias("used"), F.expr("cast(array() as array<string>)").alias("ids"))
    add = lambda z, x: F.when(z["used"] + x["s"] <= budget, F.struct((z["used"] + x["s"]).alias("used"), F.array_append(z["ids"], x["id"]).alias("ids"))).otherwise(z)
    return listed.select(F.posexplode(F.aggregate("a", zero, add, lambda z: z["ids"])).alias("place", "id"))


def truncated_contents(rows: DataFrame, order: list, budget: int) -> DataFrame:
    """Contents in order, the first that doesn't fit cut to what is left, later ones empty."""
    before = F.coalesce(F.sum(F.char_length("content")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(budget) - F.col("before"), F.lit(0))
    return rows.withColumn("before", before).withColumn("content", F.substr("content", F.lit(1), room.cast("int"))).drop("before")
