"""Graph operators: inversion, neighbourhoods, trees, paths, components and cycles, as joins of a frontier with the edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.text import edge_cost, inverse, link_cost
from lattica.model import DEFAULT_VALUE
from lattica.sources.storage import written

#: A frontier of at most so many notes is held by the plan itself, and is a filter that the scan of the edges can use; larger ones are written and joined.
SMALL_FRONT = 256
#: Rounds of a walk whose tables are read one by one.
ROUNDS = 12
#: What the cheapest link costs: half a step to a note of the highest value.
LEAST_COST = 0.5


def inverted(edges: DataFrame) -> DataFrame:
    """Edges with the inverse of each as a virtual edge back."""
    own = edges.select("src", "dst", "link_type", F.when(F.col("inline"), "inline").otherwise("typed").alias("provenance"))
    return own.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), inverse(F.col("link_type")).alias("link_type"), F.lit("virtual").alias("provenance")))


def directed(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(src, dst, link_type) as a walk in the direction sees them."""
    out = inverted(edges)
    keep = {"out": F.col("provenance") != "virtual", "in": F.col("provenance") == "virtual", "both": F.lit(True)}[direction]
    return out.filter(keep).select("src", "dst", "link_type")


def weighted(edges: DataFrame, weights: DataFrame | None = None, least: int | None = None) -> DataFrame:
    """(src, dst, link_type, w): links count 1, or with weights (id, value) by type and the target's value. With least, targets below it are left out."""
    if weights is None:
        return edges.select("src", "dst", "link_type", F.lit(1.0).alias("w"))
    step = edges.join(weights.select(F.col("id").alias("dst"), F.coalesce("value", F.lit(DEFAULT_VALUE)).alias("v")), "dst")
    if least is not None:
        step = step.filter(F.col("v") >= least)
    return step.select("src", "dst", "link_type", edge_cost(F.col("link_type"), F.col("v")).alias("w"))


class Front:
    """The rows of one round: in the plan if there are few of them, else written."""

    def __init__(self, df: DataFrame):
        few = df.limit(SMALL_FRONT + 1).toArrow()
        self.ids = few["id"].to_pylist() if len(few) <= SMALL_FRONT else None
        self.rows = df.sparkSession.createDataFrame(few, df.schema) if self.ids is not None else written(df, "front")

    @property
    def empty(self) -> bool:
        return self.ids == []

    def count(self) -> int:
        return self.rows.count() if self.ids is None else len(self.ids)

    def out_of(self, step: DataFrame, *columns: str) -> DataFrame:
        """Steps out of the notes, with columns of their rows; those of few notes are looked up by the scan."""
        if self.ids is not None:
            step = step.filter(F.col("src").isin(self.ids))
        return self.rows.select(F.col("id").alias("src"), *columns).join(step, "src")


def levels(step: DataFrame, seeds: DataFrame, hops: int | None, budget: float | None = None) -> list[DataFrame]:
    """What each round of a walk over steps (src, dst, link_type, w) finds: (id, cost, hop, parent, link_type) of the notes that so many links reach at a lower cost than fewer do; of equal ways the first by type and parent.

    Each round joins only the notes whose cost fell, and writes only those. hops None: until no cost falls. The way to a
    note of a round is its parent of the round before.
    """
    none = F.lit(None).cast("string")
    front = Front(seeds.select("id").distinct().select("id", F.lit(0.0).alias("cost"), F.lit(0).alias("hop"), none.alias("parent"), none.alias("link_type")))
    out, known = [front.rows], []  # known: the rounds so far, brought together now and then
    while hops is None or len(out) <= hops:
        known.append(out[-1].select("id", "cost"))
        if len(known) > ROUNDS:
            known = [written(_together(known).groupBy("id").agg(F.min("cost").alias("cost")), "known")]
        near = front.out_of(step, "cost").select(F.col("dst").alias("id"), F.struct((F.col("cost") + F.col("w")).alias("cost"), "link_type", F.col("src").alias("parent")).alias("way"))
        found = near.groupBy("id").agg(F.min("way").alias("way"))
        if budget is not None:
            found = found.filter(F.col("way.cost") <= budget)
        old = _together(known).groupBy("id").agg(F.min("cost").alias("old"))
        better = found.join(old, "id", "left").filter(F.col("old").isNull() | (F.col("way.cost") < F.col("old")))
        front = Front(better.select("id", F.col("way.cost").alias("cost"), F.lit(len(out)).alias("hop"), F.col("way.parent").alias("parent"), F.col("way.link_type").alias("link_type")))
        if front.empty:
            break
        out.append(front.rows)
    return out


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _best(found: list[DataFrame]) -> DataFrame:
    best = _together(found).groupBy("id").agg(F.min(F.struct("cost", "hop", "link_type", "parent")).alias("x"))
    return best.select("id", "x.cost", "x.hop", "x.parent", "x.link_type")


def distances(edges: DataFrame, seeds: DataFrame, hops: int, weights: DataFrame | None = None, least: int | None = None) -> DataFrame:
    """(id, cost) of notes that walks of at most so many links reach from the seeds (id), at least cost: links count 1, or with weights (id, value) by type and the target's value. With least, notes below it are not entered."""
    return _best(levels(weighted(edges, weights, least), seeds, hops)).select("id", "cost")


def tree(edges: DataFrame, root: DataFrame, hops: int, weights: DataFrame | None = None, least: int | None = None) -> DataFrame:
    """(id, cost, hop, parent, link_type): a spanning tree by least cost, then least hop; of equal ways in the first by type and parent. Without weights the cost is the hop."""
    return _best(levels(weighted(edges, weights, least), root, hops))


def path(edges: DataFrame, start: str, end: str, hops: int, spark: SparkSession, weights: DataFrame | None = None, least: int | None = None) -> DataFrame:
    """(place, id, link_type, cost) of a cheapest path, at most hops links long; empty if there is none. It is walked back from round to round, a row for each link."""
    found = levels(weighted(edges, weights, least), spark.createDataFrame([(start,)], "id string"), hops)
    last = _best(found).filter(F.col("id") == end).first()
    back = []
    while last is not None:
        back.append((last["hop"], last["id"], last["link_type"], last["cost"]))
        last = found[last["hop"] - 1].filter(F.col("id") == last["parent"]).first() if last["hop"] else None
    return spark.createDataFrame(back[::-1], "place int, id string, link_type string, cost double")


def limited(edges: DataFrame, root: str, hops: int, spark: SparkSession, max_nodes: int | None = None, max_edges: int | None = None, max_fanout: int | None = None) -> tuple[DataFrame, DataFrame, str | None]:
    """Notes (id, hop, parent, link_type) and links (src, dst, link_type) of a walk in breadth that stops at limits, and why it was cut: max_nodes, max_edges, max_fanout, max_hops, or None.

    Notes are expanded in the order in which they are found, each one's links by type and target; a link is listed once
    for every note that it is seen from. The fan-out limit cuts the links of each note, the others the walk. Reaching the
    limit of notes cuts, as does a link beyond that of links; of several reasons the first in the order above is given.
    """
    edges = edges.select("src", "dst", "link_type").distinct().filter("src <> dst")
    bounded = max_nodes is not None or max_edges is not None
    none = F.lit(None).cast("string")
    front = Front(spark.createDataFrame([(root, 0, 0)], "id string, hop int, place int").select("id", "hop", none.alias("parent"), none.alias("link_type"), "place"))
    notes, links, nodes, listed, reasons = [front.rows], [], 1, 0, set()
    for hop in range(1, hops + 1):
        if max_nodes is not None and nodes >= max_nodes:
            break
        near = written(front.out_of(edges, "place").withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy("link_type", "dst"))), "limited")
        if max_fanout is not None:
            if not near.filter(F.col("rn") > max_fanout).isEmpty():
                reasons.add("max_fanout")
            near = near.filter(F.col("rn") <= max_fanout)
        if max_edges is not None:  # at most so many rows are put in order
            there = near.count()
            if there > max_edges - listed:
                reasons.add("max_edges")
            near = near.orderBy("place", "rn").limit(max_edges - listed)
            listed += min(there, max_edges - listed)
        seen = _together([n.select("id") for n in notes])
        way = F.min(F.struct("place", "rn", F.col("src").alias("parent"), "link_type")).alias("way")
        new = near.withColumnRenamed("dst", "id").join(seen, "id", "left_anti").groupBy("id").agg(way)
        if max_nodes is not None:
            new = new.orderBy("way").limit(max_nodes - nodes)
        place: Column = F.row_number().over(Window.orderBy("way")) if bounded else F.lit(0)  # bounded: as many rows as the limit
        front = Front(new.select("id", F.lit(hop).alias("hop"), "way.parent", "way.link_type", place.alias("place")))
        links.append(near.select("src", "dst", "link_type"))
        notes.append(front.rows)
        nodes += front.count()
        if front.empty or "max_edges" in reasons:
            break
    if max_nodes is not None and nodes >= max_nodes:
        reasons.add("max_nodes")
    elif not front.empty and not front.out_of(edges).isEmpty():
        reasons.add("max_hops")
    all_links = _together(links) if links else edges.limit(0)
    reason = next((r for r in ("max_nodes", "max_edges", "max_fanout", "max_hops") if r in reasons), None)
    return _together(notes).drop("place"), all_links, reason


def cheapest(steps: DataFrame, root: str, max_cost: float, spark: SparkSession, max_nodes: int | None = None, max_edges: int | None = None, max_fanout: int | None = None, width: float = LEAST_COST) -> tuple[DataFrame, DataFrame, str | None]:
    """Notes (id, cost, parent, link_type) and links (src, dst, link_type) of a walk by least cost over steps (src, dst, link_type, w) that stops at limits, and why it was cut: max_nodes, max_edges, max_fanout, max_hops, or None.

    Delta-stepping (Meyer and Sanders, 2003) with buckets no wider than the cheapest link, so that the notes of a bucket
    can't make each other cheaper: in each round those of the least bucket are final. They count in the order of cost and
    id, so the first max_nodes are the cheapest there are. Notes below max_cost are expanded, each one's links by type and
    target, the first max_fanout of them; links are listed in the order of the notes that they leave. Of equal ways to a
    note the first by type and parent is its parent. Of several reasons the first in the order above is given.
    """
    steps = steps.filter("src <> dst").groupBy("src", "dst", "link_type").agg(F.min("w").alias("w"))
    none = F.lit(None).cast("string")
    ahead = spark.createDataFrame([(root, 0.0)], "id string, cost double").withColumns({"parent": none, "link_type": none})
    notes, links, settled, listed, reasons = [], [], 0, 0, set()
    while (low := ahead.agg(F.min("cost")).first()[0]) is not None:
        bucket = ahead.filter(F.col("cost") < low + width)
        if max_nodes is not None:
            bucket = bucket.orderBy("cost", "id").limit(max_nodes - settled)
        front = Front(bucket)
        notes.append(front.rows)
        settled += front.count()
        out = front.out_of(steps, "cost")
        if max_nodes is not None and settled >= max_nodes:
            reasons.add("max_nodes")
            last = front.rows.agg(F.max(F.struct("cost", "id")).alias("x")).select("x.id").first()[0]
            out = out.filter(F.col("src") != last)  # the notes before the last one were expanded
        if not out.filter(F.col("cost") >= max_cost).isEmpty():
            reasons.add("max_hops")
        near = written(out.filter(F.col("cost") < max_cost).withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy("link_type", "dst"))), "cheapest")
        if max_fanout is not None:
            if not near.filter(F.col("rn") > max_fanout).isEmpty():
                reasons.add("max_fanout")
            near = near.filter(F.col("rn") <= max_fanout)
        if max_edges is not None:
            there = near.count()
            if there > max_edges - listed:
                reasons.add("max_edges")
            near = near.orderBy("cost", "src", "rn").limit(max_edges - listed)
            listed += min(there, max_edges - listed)
        links.append(near.select("src", "dst", "link_type"))
        if "max_nodes" in reasons:
            break
        if len(notes) > ROUNDS:
            notes = [written(_together(notes), "settled")]
        ways = near.select(F.col("dst").alias("id"), F.struct((F.col("cost") + F.col("w")).alias("cost"), "link_type", F.col("src").alias("parent")).alias("way"))
        ways = ways.unionByName(ahead.select("id", F.struct("cost", "link_type", "parent").alias("way"))).join(_together(notes).select("id"), "id", "left_anti")
        ahead = written(ways.groupBy("id").agg(F.min("way").alias("way")).select("id", "way.cost", "way.parent", "way.link_type"), "ahead")
        if "max_edges" in reasons:
            notes.append(ahead)  # what the listed links lead to
            break
    all_links = _together(links) if links else steps.select("src", "dst", "link_type").limit(0)
    return _together(notes), all_links, next((r for r in ("max_nodes", "max_edges", "max_fanout", "max_hops") if r in reasons), None)


def simple_walk(edges: DataFrame, seeds: DataFrame, budget: float) -> DataFrame:
    """(id, cost) within a budget of link costs, over edges both ways."""
    both = directed(edges).select("src", "dst", "link_type", link_cost(F.col("link_type")).alias("w"))
    return _best(levels(both, seeds, None, budget)).select("id", "cost")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): least id of each connected component, by least labels of neighbours and then labels of labels, until none falls."""
    both = written(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct(), "both")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        far = labels.select(F.col("id").alias("new"), F.col("component").alias("far"))
        new = written(least.join(far, "new", "left").select("id", "old", F.least("new", F.coalesce("far", "new")).alias("component")), "labels")
        if new.filter("old <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def _peeled(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges left when notes without a way in or out are peeled off, in so many rounds at most."""
    left, n, k = edges, edges.count(), 0
    while n and (rounds is None or k < rounds):
        left = left.join(left.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi")
        left = written(left, "peeled")
        rest, k = left.count(), k + 1
        if rest == n:
            break
        n = rest
    return left


def least_ancestors(edges: DataFrame) -> DataFrame:
    """(id, least): the least id that leads to each note of the edges (src, dst), itself included, by labels of the notes before and then labels of labels, until none falls. A label leads to its note, so what leads to the label does too."""
    labels = written(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("least", F.col("id")), "ancestors")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "src").hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("least").alias("near"))
        step = labels.join(near.hint("merge"), "id", "left").select("id", F.col("least").alias("old"), F.least("least", F.coalesce("near", "least")).alias("new"))
        far = labels.select(F.col("id").alias("new"), F.col("least").alias("far"))
        step = written(step.join(far.hint("merge"), "new", "left").select("id", "old", F.least("new", F.coalesce("far", "new")).alias("least")), "ancestors")
        labels = step.select("id", "least")
        if step.filter("old <> least").isEmpty():
            return labels


def _single_cycles(edges: DataFrame) -> DataFrame:
    """(id, least) of the notes on cycles of which each note has one way in, or each has one way out; least: the cycle's least id.

    Every such note points along its one way, and each round doubles how far it points; a note whose way leaves the notes
    with one way, or that no other points to, goes. When none goes the rest lie on cycles, so the rounds are as many as the
    longest cycle's length has binary digits.
    """
    ways = edges.select(F.lit(0).alias("way"), F.col("dst").alias("id"), F.col("src").alias("to")).unionByName(edges.select(F.lit(1).alias("way"), F.col("src").alias("id"), F.col("dst").alias("to")))
    one = ways.groupBy("way", "id").agg(F.count("*").alias("n"), F.min("to").alias("to")).filter("n = 1")
    at = written(one.select("way", "id", "to", F.col("id").alias("least"), F.lit(True).alias("fell")), "single")
    n = at.count()
    while n:
        far = at.select("way", F.col("id").alias("to"), F.col("to").alias("far"), F.col("least").alias("there"))
        new = written(at.join(far.hint("merge"), ["way", "to"]).select("way", "id", F.col("far").alias("to"), F.least("least", "there").alias("least"), (F.col("there") < F.col("least")).alias("fell")), "doubled")
        at = written(new.join(new.select("way", F.col("to").alias("id")).distinct().hint("merge"), ["way", "id"], "left_semi"), "single")
        rest, fell = at.agg(F.count("*"), F.count_if("fell")).first()
        if rest == n and not fell:
            break
        n = rest
    return at.select("id", "least").distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the notes that lie on a cycle: the least id of all that lead to each other.

    Notes without a way in or out are peeled off first. Cycles whose notes have one way in or one way out each are found by
    doubling and become a note each, as long as there are any. Colouring (Orzan, 2004) for the rest: a note's colour is the
    least id that leads to it. Inside a colour, notes that lead back to that id are one component; what is left of the
    colour begins anew.
    """
    left, found, joined = written(edges.select("src", "dst").distinct(), "strong"), [], []
    while True:
        left = _peeled(left, ROUNDS)
        if left.isEmpty():
            break
        single = written(_single_cycles(left), "cycles")
        if not single.isEmpty():
            joined.append(single.select("id", F.col("least").alias("component")))
            of = lambda c: single.select(F.col("id").alias(c), F.col("least").alias(f"{c}_in")).hint("merge")
            both = left.join(of("src"), "src", "left").join(of("dst"), "dst", "left").filter("src_in is null or dst_in is null or src_in <> dst_in")
            left = written(both.select(F.coalesce("src_in", "src").alias("src"), F.coalesce("dst_in", "dst").alias("dst")).distinct(), "strong")
            continue
        colours = least_ancestors(left)
        inner = left.join(colours.select(F.col("id").alias("src"), F.col("least").alias("colour")).hint("merge"), "src").join(colours.select(F.col("id").alias("dst"), F.col("least").alias("c2")).hint("merge"), "dst").filter("colour = c2").select("src", "dst", "colour")
        inner = written(inner, "coloured")
        back = least_ancestors(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        members = written(back.join(colours.withColumnRenamed("least", "component").hint("merge"), "id").filter("least = component").select("id", "component"), "members")
        ids = lambda c: members.select(F.col("id").alias(c)).hint("merge")
        on = inner.join(ids("src"), "src", "left_semi").join(ids("dst"), "dst", "left_semi")
        found.append(members.join(on.select(F.col("src").alias("id")).distinct().hint("merge"), "id", "left_semi"))
        left = written(inner.join(ids("src"), "src", "left_anti").join(ids("dst"), "dst", "left_anti").select("src", "dst"), "strong")
    out = _together(found) if found else edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    for cycle in reversed(joined):  # what a cycle's note belongs to, its notes belong to
        of_note = out.select(F.col("id").alias("component"), F.col("component").alias("larger")).hint("merge")
        own = cycle.join(of_note, "component", "left").select("id", F.coalesce("larger", "component").alias("component"))
        out = written(out.join(cycle.select("id").hint("merge"), "id", "left_anti").unionByName(own), "joined")
    return out


def on_cycles(edges: DataFrame) -> DataFrame:
    """(id) of notes that lie on a cycle."""
    return strong_components(edges).select("id")


def _rings(inner: DataFrame, sizes: DataFrame) -> DataFrame:
    """(component, place, id) of components (component) that are one cycle each, of edges (src, dst, component): places from the least note on, by doubling how far back each note looks."""
    ring = inner.join(sizes.select("component").hint("merge"), "component", "left_semi")
    first = F.col("dst") == F.col("component")
    at = written(ring.select("component", F.col("dst").alias("id"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("to"), F.when(first, 0).otherwise(1).alias("place")), "ring")
    while not at.filter("to <> component").isEmpty():
        far = at.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("place").alias("more"))
        at = written(at.join(far.hint("merge"), "to").select("component", "id", F.col("far").alias("to"), (F.col("place") + F.col("more")).alias("place")), "ring")
    return at.select("component", "place", "id")


def shortest_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, place, id): for each strong component a shortest cycle through its least note, from place 0, which that note has; of equal ways by the least note before. A component that is one cycle is put in order by doubling; the others are walked at once, in as many rounds as the longest of their cycles has links."""
    of = lambda c, name: components.select(F.col("id").alias(c), F.col("component").alias(name)).hint("merge")
    inner = written(edges.select("src", "dst").distinct().join(of("src", "component"), "src").join(of("dst", "c2"), "dst").filter("component = c2").select("src", "dst", "component"), "inner")
    sizes = inner.groupBy("component").agg(F.count("*").alias("links")).join(components.groupBy("component").agg(F.count("*").alias("n")).hint("merge"), "component")
    sizes = written(sizes.filter("links = n").select("component"), "rings")  # strong, and a link for each note: one cycle
    rings = _rings(inner, sizes)
    inner = written(inner.join(sizes.hint("merge"), "component", "left_anti"), "inner")
    rounds = [written(components.filter("id = component").select("component", "id", F.lit(None).cast("string").alias("parent")).join(sizes.hint("merge"), "component", "left_anti"), "cycle")]
    ends, seen = [], rounds[0].select("component", "id").limit(0)
    while not rounds[-1].isEmpty():
        near = rounds[-1].select("component", F.col("id").alias("src")).join(inner, ["component", "src"]).groupBy("component", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        near = written(near.join(seen.hint("merge"), ["component", "id"], "left_anti"), "cycle")
        closed = near.filter("id = component")
        ends.append(closed)
        rest = near.join(closed.select("component"), "component", "left_anti")
        seen = written(seen.unionByName(rest.select("component", "id")), "seen")
        rounds.append(written(rest, "cycle"))
    back, out = None, [rings, rounds[0].select("component", F.lit(0).alias("place"), "id")]
    for k in range(len(ends), 0, -1):
        at = ends[k - 1].select("component", "parent")
        if back is not None:
            at = at.unionByName(back.withColumnRenamed("id", "at").join(rounds[k].withColumnRenamed("id", "at"), ["component", "at"]).select("component", "parent"))
        back = written(at.withColumnRenamed("parent", "id"), "back")  # the note of each cycle that stands at place k - 1
        if k > 1:
            out.append(back.select("component", F.lit(k - 1).alias("place"), "id"))
    return _together(out)


def collection_members(edges: DataFrame, notes: DataFrame, root: str, transitive: bool, spark: SparkSession) -> DataFrame:
    """(id) of a collection's root and what it links to, and, if transitive, what collections among these link to, however long the chain."""
    mocs = notes.filter("type = 'moc'").select("id")
    front = Front(spark.createDataFrame([(root,)], "id string"))
    seen = [front.rows]
    while not front.empty:
        near = front.out_of(edges.select("src", "dst")).select(F.col("dst").alias("id")).distinct()
        new = Front(near.join(_together(seen), "id", "left_anti"))
        seen.append(new.rows)
        if new.empty or not transitive:
            break
        if len(seen) > ROUNDS:
            seen = [written(_together(seen), "members")]
        front = Front(new.rows.join(mocs, "id", "left_semi"))
    return _together(seen)


def neighbours(edges: DataFrame, fanout: int | None = None) -> DataFrame:
    """Neighbours of every note both ways, by type and id, the first so many of each."""
    out = directed(edges).distinct()
    if fanout is None:
        return out
    w = Window.partitionBy("src").orderBy("link_type", "dst")
    return out.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= fanout).drop("rn")
