"""Changes of a store, as functions from relations to relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import upsert


def update_where(notes: DataFrame, test: Column, **values) -> DataFrame:
    """Columns set where the test holds."""
    return notes.withColumns({c: F.when(test, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def save(notes: DataFrame, new: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """Notes with new versions put in; updated moves only where something else changed."""
    n = new.select("id", *(F.col(c).alias(f"n_{c}") for c in columns), F.lit(True).alias("__new"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"n_{c}"))
    j = notes.join(n, "id", "left").withColumn("__changed", F.col("__new").isNotNull() & ~same)
    j = j.withColumns({**{c: F.when(F.col("__changed"), F.col(f"n_{c}")).otherwise(F.col(c)) for c in columns}, "updated": F.when(F.col("__changed"), now).otherwise(F.col("updated"))})
    return j.drop("__new", "__changed", *(f"n_{c}" for c in columns))


def add_link(edges: DataFrame, src: str, dst: str, link_type: str) -> DataFrame:
    """The edge, once, after the source's others."""
    at = edges.filter(F.col("src") == src).agg(F.coalesce(F.max("position") + 1, F.lit(0)).cast("int").alias("position"))
    new = at.select(F.lit(src).alias("src"), F.lit(dst).alias("dst"), F.lit(link_type).alias("link_type"), F.lit(False).alias("inline"), "position")
    return edges.unionByName(new.join(edges, ["src", "dst", "link_type"], "left_anti"))


def remove_link(edges: DataFrame, src: str, dst: str, link_type: str) -> DataFrame:
    return edges.filter(~((F.col("src") == src) & (F.col("dst") == dst) & (F.col("link_type") == link_type)))


def materialize(edges: DataFrame, src: str, link_type: str = "related") -> DataFrame:
    """Inline links of a note as typed ones."""
    test = (F.col("src") == src) & F.col("inline")
    return edges.withColumn("link_type", F.when(test, link_type).otherwise(F.col("link_type"))).withColumn("inline", F.col("inline") & ~test)


def merge_notes(notes: DataFrame, edges: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """One note merged into another: tags and bodies joined, links moved, links to the target from itself dropped, repeats once."""
    s = notes.filter(F.col("id") == source).select(F.col("tags").alias("s_tags"), F.col("body").alias("s_body"), F.lit(target).alias("id"))
    # The heading is a fixed value: files that were merged elsewhere have the same.
    body = F.concat(F.trim("body"), F.lit(f"\n\n---\n\n### Merged from {source}\n\n"), F.trim("s_body"))
    kept = notes.filter(F.col("id") != source).join(F.broadcast(s), "id", "left")  # one row at most, for one id
    hit = F.col("s_tags").isNotNull()
    kept = kept.withColumn("tags", F.when(hit, F.array_sort(F.array_union("tags", "s_tags"))).otherwise(F.col("tags"))).withColumn("body", F.when(hit, body).otherwise(F.col("body"))).drop("s_tags", "s_body")
    move = lambda c: F.when(F.col(c) == source, target).otherwise(F.col(c))
    moved = edges.withColumns({"src": move("src"), "dst": move("dst")}).filter("src <> dst").dropDuplicates(["src", "dst", "link_type"])
    return kept, moved


def load(old: DataFrame, new: DataFrame, strategy: str) -> DataFrame:
    """Notes of a pack put into a store: skip keeps what is there, overwrite replaces it, merge-links keeps notes (links are united apart)."""
    if strategy == "overwrite":
        return upsert(old, new, "id")
    return old.unionByName(new.join(old.select("id"), "id", "left_anti"))


def load_links(old: DataFrame, new: DataFrame, old_notes: DataFrame, new_notes: DataFrame, strategy: str) -> DataFrame:
    """Links of a pack: of new notes only (skip), in place of those of replaced notes (overwrite), or united (merge-links)."""
    fresh = new_notes.select(F.col("id").alias("src"))
    if strategy == "skip":
        return old.unionByName(new.join(fresh.join(old_notes.select(F.col("id").alias("src")), "src", "left_anti"), "src", "left_semi"))
    if strategy == "overwrite":
        return old.join(fresh, "src", "left_anti").unionByName(new)
    return old.unionByName(new).dropDuplicates(["src", "dst", "link_type"])


def renamed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, new_id) of new notes; an id that is taken gets the smallest free suffix -n, whatever that is. The suffixes in use of each such id, in order, run 1, 2, ... up to the first gap."""
    clash = new.join(old.select("id"), "id", "left_semi").select("id").distinct()
    taken = old.select("id").unionByName(new.select("id")).distinct()
    cut = taken.select(F.regexp_extract("id", r"^(.*)-([1-9][0-9]*)$", 1).alias("id"), F.regexp_extract("id", r"^(.*)-([1-9][0-9]*)$", 2).alias("n"))
    used = cut.filter((F.col("n") != "") & (F.length("n") <= 18)).select("id", F.col("n").cast("long").alias("n")).join(clash, "id", "left_semi")
    run = used.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("n"))).filter("n = place").groupBy("id").agg(F.max("n").alias("n"))
    free = clash.join(run, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    return new.select("id").join(free, "id", "left").select("id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.concat_ws("-", "id", F.col("n").cast("string"))).alias("new_id"))
