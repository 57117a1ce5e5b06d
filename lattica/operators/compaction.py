"""Digests that stand for notes: canonical ids, expansion, sizes and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.storage import written

from .graph import components, strong_components


def conflicts(compacts: DataFrame) -> DataFrame:
    """Notes with more than one digest, and digests of themselves."""
    many = compacts.groupBy("source_id").agg(F.count_distinct("digest_id").alias("n")).filter("n > 1").select(F.col("source_id").alias("id"), F.lit("multiple-compactors").alias("problem"))
    own = compacts.filter("digest_id = source_id").select(F.col("source_id").alias("id"), F.lit("self").alias("problem"))
    return many.unionByName(own).distinct()


def validation(compacts: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, problem): conflicts, cycles, and sources and digests that aren't among the notes (id)."""
    unknown = lambda c, problem: compacts.select(F.col(c).alias("id")).distinct().join(notes, "id", "left_anti").withColumn("problem", F.lit(problem))
    return conflicts(compacts).unionByName(cycles(compacts)).unionByName(unknown("source_id", "unknown-source")).unionByName(unknown("digest_id", "unknown-digest"))


def cycles(compacts: DataFrame) -> DataFrame:
    """(id, problem) of notes that stand for each other in a circle; a digest of itself is a conflict already."""
    links = compacts.filter("digest_id <> source_id").select(F.col("digest_id").alias("src"), F.col("source_id").alias("dst"))
    return strong_components(links).select("id", F.lit("cycle").alias("problem"))


def tree_rows(compacts: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, parent, id, depth, place) of what stands below digests (id), to a depth: place counts a root's notes in pre-order, those below one digest by id.

    Sizes of subtrees are summed upward from the deepest level, then places go downward: a note comes after its digest and
    all that is below the notes before it. A note below two digests is listed below each.
    """
    step = compacts.select(F.col("digest_id").alias("parent"), F.col("source_id").alias("id")).distinct()
    none = F.lit(None).cast("string")
    levels = [written(roots.select(F.col("id").alias("root"), none.alias("parent"), "id", none.alias("above")).withColumn("node", F.col("id")), "tree")]
    while len(levels) <= depth:
        up = levels[-1].select("root", F.col("id").alias("parent"), F.col("node").alias("above"))
        # a node is told by its way from the root, as a digest of ids, since a note may stand in several places
        down = up.join(step, "parent").withColumn("node", F.sha2(F.concat_ws("/", "above", "id").cast("binary"), 256))
        level = written(down.select("root", "parent", "id", "above", "node"), "tree")
        if level.isEmpty():
            break
        levels.append(level)
    sized = [levels[-1].withColumn("size", F.lit(1).cast("long"))]
    for level in reversed(levels[:-1]):
        below = sized[0].groupBy("root", F.col("above").alias("node")).agg(F.sum("size").alias("below"))
        sized.insert(0, written(level.join(below, ["root", "node"], "left").withColumn("size", 1 + F.coalesce("below", F.lit(0))).drop("below"), "tree"))
    earlier = Window.partitionBy("root", "above").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = [sized[0].withColumn("place", F.lit(0).cast("long"))]
    for level in sized[1:]:
        start = placed[-1].select("root", F.col("node").alias("above"), F.col("place").alias("start"))
        before = level.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        placed.append(written(before.join(start, ["root", "above"]).withColumn("place", F.col("start") + 1 + F.col("before")).drop("start", "before"), "tree"))
    out = [d.select("root", "parent", "id", F.lit(i).alias("depth"), "place") for i, d in enumerate(placed)]
    for d in out[1:]:
        out[0] = out[0].unionByName(d)
    return out[0]


def canonical(compacts: DataFrame, rounds: int = 32) -> DataFrame:
    """(id, canonical) of every compacted note, by doubling pointers until none moves; a cycle is an error."""
    up = written(compacts.select(F.col("source_id").alias("id"), F.col("digest_id").alias("canonical")), "compaction")
    for _ in range(rounds):
        far = up.select(F.col("id").alias("canonical"), F.col("canonical").alias("__far"))
        new = up.join(far, "canonical", "left").select("id", F.coalesce("__far", "canonical").alias("canonical"), F.col("__far").isNotNull().alias("__moved"))
        new = written(new, "compaction")
        if not new.filter("id = canonical").isEmpty():
            raise ValueError("compaction has a cycle")
        if new.filter("__moved").isEmpty():
            return new.select("id", "canonical")
        up = new.select("id", "canonical")
    raise ValueError("compaction has a cycle")


def equivalence(compacts: DataFrame) -> DataFrame:
    """(canonical, members): who a digest stands for, itself included."""
    c = canonical(compacts)
    return c.groupBy("canonical").agg(F.array_sort(F.array_append(F.collect_set("id"), F.first("canonical"))).alias("members"))


def expand(compacts: DataFrame, depth: int) -> DataFrame:
    """(digest_id, source_id, depth): everything below a digest, each note once at its least depth."""
    step = compacts.select(F.col("digest_id").alias("__d"), F.col("source_id").alias("__s"))
    level = compacts.select("digest_id", "source_id", F.lit(1).alias("depth"))
    out = level
    for i in range(2, depth + 1):
        level = written(level.join(step, F.col("source_id") == F.col("__d")).select("digest_id", F.col("__s").alias("source_id"), F.lit(i).alias("depth")), "compaction")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.groupBy("digest_id", "source_id").agg(F.min("depth").alias("depth"))


def saved_percent(sizes: DataFrame, below: DataFrame) -> DataFrame:
    """(digest_id, pct): 100 (1 - digest's size / sum of sources' sizes), 0 without any; sizes: id, size."""
    total = below.join(sizes.select(F.col("id").alias("source_id"), F.col("size").alias("s")), "source_id", "left").groupBy("digest_id").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("total"))
    own = sizes.select(F.col("id").alias("digest_id"), "size")
    return total.join(own, "digest_id").select("digest_id", F.when(F.col("total") == 0, 0.0).otherwise(100.0 * (1 - F.col("size") / F.col("total"))).alias("pct"))


def staleness(compacts: DataFrame, notes: DataFrame) -> DataFrame:
    """(digest_id, source_id) of sources that changed after their digest."""
    d, s = notes.select(F.col("id").alias("digest_id"), F.col("updated").alias("d")), notes.select(F.col("id").alias("source_id"), F.col("updated").alias("s"))
    return compacts.join(d, "digest_id").join(s, "source_id").filter("s > d").select("digest_id", "source_id")


def suggestions(edges: DataFrame, notes: DataFrame, top: int | None = 10) -> DataFrame:
    """The best, or all with top None, of connected groups of three or more notes that aren't collections, by how well a digest would serve; notes: id, type, size, value."""
    plain = notes.filter("type <> 'moc'").select("id", "size", "value")
    ids = plain.select("id")
    inner = edges.select("src", "dst").join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    group = written(components(inner), "compaction")
    sizes = group.join(plain, "id").groupBy("component").agg(F.count("*").alias("node_count"), F.sum("size").alias("estimated_size"), F.coalesce(F.avg("value"), F.lit(50.0)).alias("avg_value"))
    of = group.select(F.col("id").alias("src"), F.col("component").alias("c1"))
    to = group.select(F.col("id").alias("dst"), F.col("component").alias("c2"))
    links = edges.join(of, "src").join(to, "dst", "left").groupBy(F.col("c1").alias("component")).agg(F.count_if(F.col("c1").eqNullSafe(F.col("c2"))).alias("internal_edges"), F.count_if(~F.col("c1").eqNullSafe(F.col("c2"))).alias("boundary_edges"))
    x = sizes.join(links, "component", "left").na.fill(0, ["internal_edges", "boundary_edges"])
    total = F.greatest(F.col("internal_edges") + F.col("boundary_edges"), F.lit(1))
    x = x.withColumn("cohesion", F.col("internal_edges") / total).withColumn("boundary_ratio", F.col("boundary_edges") / total)
    v = F.col("avg_value")
    boost = F.when(v < 20, 15.0).when(v < 40, 7.5).when(v < 60, 0.0).when(v < 80, -5.0).otherwise(-10.0)
    score = F.greatest(F.log(F.greatest(F.col("estimated_size"), F.lit(1)).cast("double")), F.lit(0.0)) + F.col("cohesion") * 10 - F.col("boundary_ratio") * 5 + F.sqrt("node_count") + boost
    x = x.withColumn("score", score).filter((F.col("node_count") >= 3) & (F.col("cohesion") >= 0.3)).orderBy(F.desc("score"), "component")
    return x if top is None else x.limit(top)
