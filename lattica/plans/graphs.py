"""Queries for graph operators and compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import compaction as C
from lattica.operators import graph as G

from .registry import Book

BOOK = Book()
add = BOOK.add
INV = "CASE link_type WHEN 'supports' THEN 'supported-by' WHEN 'part-of' THEN 'has-part' WHEN 'follows' THEN 'precedes' ELSE 'related' END"
COST = "CASE WHEN link_type IN ('part-of','has-part','follows','precedes') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
DIR = f"dir AS (SELECT src, dst, link_type FROM edges UNION ALL SELECT dst, src, {INV} FROM edges)"
SEED = lambda s, *ids: s.spark.createDataFrame([(i,) for i in ids], "id string")


def hops(name: str, start: str, n: int, view: str, cost: str = "1.0::DOUBLE", extra: str = "") -> str:
    """Least costs by levels of at most n links, as a chain of expressions."""
    ctes = [f"{name}0 AS (SELECT '{start}' AS id, 0.0::DOUBLE AS cost)"]
    for i in range(n):
        ctes.append(f"{name}{i + 1} AS MATERIALIZED (SELECT id, min(cost) AS cost FROM (SELECT * FROM {name}{i} UNION ALL SELECT e.dst, p.cost+{cost} FROM {name}{i} p JOIN {view} e ON e.src=p.id {extra}) GROUP BY id)")
    return ",\n".join(ctes)


VALUED = "val AS (SELECT d.src, d.dst, d.link_type, coalesce(value,50) AS v FROM dir d JOIN notes ON id=d.dst)"
EDGE_COST = "e.w"
WEIGHTED = f"{DIR}, {VALUED}, wdir AS (SELECT src, dst, v, {COST}*(1+(100-v)/100.0::DOUBLE) AS w FROM val)"
R6 = lambda d: d.select("id", F.round("cost", 6).alias("cost"))
add("G1_inversion", lambda s: G.inverted(s.edges).groupBy("link_type", "provenance").agg(F.count("*").alias("n")), f"SELECT link_type, CASE WHEN inline THEN 'inline' ELSE 'typed' END AS provenance, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT {INV} AS link_type, 'virtual', count(*) FROM edges GROUP BY 1")
add("G2_neighbours", lambda s: G.neighbours(s.edges, 3).select("src", "dst", "link_type"), "SELECT src, dst, link_type FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY link_type, dst) AS r FROM (SELECT DISTINCT * FROM dir)) WHERE r<=3", DIR)
add("G3_tree_unweighted", lambda s: G.tree(s.index.steps("out"), SEED(s, "qp-1"), 3).select("id", "hop"), "SELECT id, cost::INT AS hop FROM h3", hops("h", "qp-1", 3, "edges"))
add("G3_distances_both", lambda s: R6(G.distances(s.index.steps(), SEED(s, "qp-30"), 3)), "SELECT id, cost FROM h3", DIR + ", " + hops("h", "qp-30", 3, "dir"))
add("G4_tree_weighted", lambda s: R6(G.distances(s.index.steps(), SEED(s, "qp-30"), 3, s.index.notes)), "SELECT id, round(cost,6) AS cost FROM h3", WEIGHTED + ", " + hops("h", "qp-30", 3, "wdir", EDGE_COST))
add("G8_min_value_gate", lambda s: R6(G.distances(s.index.steps(), SEED(s, "qp-30"), 3, s.index.notes, 40)), "SELECT id, round(cost,6) AS cost FROM h3", WEIGHTED + ", " + hops("h", "qp-30", 3, "wdir", EDGE_COST, "AND e.v>=40"))
add("G5_path_cost", lambda s: R6(G.distances(s.index.steps("out"), SEED(s, "qp-2"), 6, s.index.notes).filter("id = 'qp-77'")), "SELECT id, round(cost,6) AS cost FROM h6 WHERE id='qp-77'", "oval AS (SELECT d.src, d.dst, " + COST + "*(1+(100-coalesce(value,50))/100.0::DOUBLE) AS w FROM edges d JOIN notes ON id=d.dst), " + hops("h", "qp-2", 6, "oval", EDGE_COST))
#: The cheapest path by listing every path of so many links that can still be the cheapest: one for each end, cost and number of links.
PATHS = "oval2 AS (SELECT d.src, d.dst, d.link_type, " + COST + "*(1+(100-coalesce(value,50))/100.0::DOUBLE) AS w FROM edges d JOIN notes ON id=d.dst), p0 AS (SELECT 'qp-2' AS id, 0.0::DOUBLE AS cost, ['qp-2'] AS ids, [NULL]::VARCHAR[] AS types, [0.0::DOUBLE] AS costs)" + "".join(
    f", p{i + 1} AS MATERIALIZED (SELECT id, cost, ids, types, costs FROM (SELECT e.dst AS id, p.cost+e.w AS cost, list_append(p.ids,e.dst) AS ids, list_append(p.types,e.link_type) AS types, list_append(p.costs,p.cost+e.w) AS costs, row_number() OVER (PARTITION BY e.dst ORDER BY p.cost+e.w, e.link_type, p.id) AS r FROM p{i} p JOIN oval2 e ON e.src=p.id) WHERE r=1)"
    for i in range(6)
) + ", best AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT *, {i} AS n FROM p{i} WHERE id='qp-77'" for i in range(7)) + ") ORDER BY cost, n LIMIT 1)"
add("G5_path", lambda s: G.path(s.index.steps("out"), "qp-2", "qp-77", 6, s.spark, s.index.notes).select("place", "id", "link_type", F.round("cost", 6).alias("cost")),
    "SELECT unnest(range(0,len(ids)))::INT AS place, unnest(ids) AS id, unnest(types) AS link_type, round(unnest(costs),6) AS cost FROM best", PATHS)
add("G6_path_length", lambda s: G.path(s.index.steps("out"), "qp-2", "qp-77", 10, s.spark).agg((F.count("*") - 1).alias("links")), "SELECT cost::BIGINT AS links FROM h8 WHERE id='qp-77'", hops("h", "qp-2", 8, "edges"))
LIMITED = lambda s, *order, **limits: (lambda out: out[0].select("id", "hop", F.lit(out[2] or "none").alias("reason")))(G.limited(s.index.steps("out"), "qp-1", 3, s.spark, **limits))


def fans(start: str, n: int, most: int) -> str:
    """Levels of a walk in breadth that follows the first links of each note by type and target."""
    ctes = [f"cut AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY link_type, dst) AS r FROM (SELECT DISTINCT src, dst, link_type FROM edges)) WHERE r<={most})", f"f0 AS (SELECT '{start}' AS id, 0 AS hop)"]
    for i in range(n):
        ctes.append(f"f{i + 1} AS MATERIALIZED (SELECT id, min(hop) AS hop FROM (SELECT * FROM f{i} UNION ALL SELECT e.dst, {i + 1} FROM f{i} p JOIN cut e ON e.src=p.id WHERE p.hop={i}) GROUP BY id)")
    return ",\n".join(ctes)


def breadth(start: str, n: int, most: int) -> str:
    """Levels of a walk in breadth, with each note's place in the order in which notes are found; the first so many."""
    ctes = [f"b0 AS (SELECT '{start}' AS id, 0 AS hop, 0 AS place)"]
    for i in range(n):
        new = f"SELECT e.dst AS id, min((p.place, e.link_type)) AS way FROM b{i} p JOIN edges e ON e.src=p.id WHERE p.hop={i} AND e.dst NOT IN (SELECT id FROM b{i}) GROUP BY 1"
        ctes.append(f"b{i + 1} AS MATERIALIZED (SELECT * FROM b{i} UNION ALL SELECT id, {i + 1}, (SELECT max(place) FROM b{i})+row_number() OVER (ORDER BY way, id) FROM ({new}))")
    return ",\n".join(ctes) + f",\nfirst AS (SELECT id, hop FROM b{n} ORDER BY place LIMIT {most})"


add("G7_max_nodes", lambda s: LIMITED(s, max_nodes=10), "SELECT id, hop, 'max_nodes' AS reason FROM first", breadth("qp-1", 3, 10))
add("G7_max_fanout", lambda s: LIMITED(s, max_fanout=2), "SELECT id, hop, 'max_fanout' AS reason FROM f3", fans("qp-1", 3, 2))
add("G7_max_hops", lambda s: LIMITED(s), "SELECT id, cost::INT AS hop, 'max_hops' AS reason FROM h3", hops("h", "qp-1", 3, "edges"))
add("G7_max_edges", lambda s: (lambda out: out[1].agg(F.count("*").alias("links"), F.lit(out[2]).alias("reason")))(G.limited(s.index.steps("out"), "qp-1", 3, s.spark, max_edges=12)), "SELECT 12 AS links, 'max_edges' AS reason")
add("G7_edges_listed", lambda s: G.limited(s.index.steps("out"), "qp-1", 3, s.spark, max_edges=12)[1], "SELECT src, dst, link_type FROM (SELECT DISTINCT src, dst, link_type FROM edges WHERE src<>dst) JOIN b3 ON src=b3.id ORDER BY place, link_type, dst LIMIT 12", breadth("qp-1", 3, 100))
_CHEAPEST = lambda s, most=3.0, **limits: G.cheapest(G.weighted(s.index.steps(), s.index.notes), "qp-30", most, s.spark, **limits)
_NOTED = lambda out: R6(out[0]).withColumn("reason", F.lit(out[2] or "none"))
#: Least costs where only notes below a cost are left.
BELOW3 = WEIGHTED + ", " + hops("h", "qp-30", 7, "wdir", EDGE_COST, "WHERE p.cost<3.0")
add("G4_cheapest", lambda s: _NOTED(_CHEAPEST(s)), "SELECT id, round(cost,6) AS cost, 'max_hops' AS reason FROM h7", BELOW3)
add("G4_cheapest_nodes", lambda s: _NOTED(_CHEAPEST(s, max_nodes=25)), "SELECT id, round(cost,6) AS cost, 'max_nodes' AS reason FROM (SELECT * FROM h7 ORDER BY cost, id LIMIT 25)", BELOW3)
add("G4_cheapest_fanout", lambda s: _NOTED(_CHEAPEST(s, max_fanout=2)), "SELECT id, round(cost,6) AS cost, 'max_fanout' AS reason FROM h7",
    WEIGHTED.replace("AS w FROM val)", "AS w, link_type FROM val)") + ", narrow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY link_type, dst) AS r FROM (SELECT src, dst, link_type, min(w) AS w FROM wdir WHERE src<>dst GROUP BY ALL)) WHERE r<=2), " + hops("h", "qp-30", 7, "narrow", EDGE_COST, "WHERE p.cost<3.0"))
add("G4_cheapest_links", lambda s: _CHEAPEST(s, max_edges=40)[1], "SELECT src, dst, link_type FROM (SELECT DISTINCT src, dst, link_type FROM dir WHERE src<>dst) JOIN h7 ON src=h7.id WHERE cost<3.0 ORDER BY cost, src, link_type, dst LIMIT 40", BELOW3)
add("G4_parents", lambda s: _CHEAPEST(s)[0].filter("parent is not null").select("id", "parent", "link_type"), "SELECT id, parent, link_type FROM (SELECT b.id, e.src AS parent, e.link_type, row_number() OVER (PARTITION BY b.id ORDER BY a.cost+e.w, e.link_type, e.src) AS r FROM h7 a JOIN ldir e ON e.src=a.id JOIN h7 b ON b.id=e.dst WHERE a.cost<3.0 AND b.id<>'qp-30') WHERE r=1",
    BELOW3 + ", ldir AS (SELECT src, dst, link_type, " + COST + "*(1+(100-v)/100.0::DOUBLE) AS w FROM val WHERE src<>dst)")
add("G9_collection_members", lambda s: G.collection_members(s.index.steps("out"), s.index.notes, "qp-10", True, s.spark), "SELECT id FROM m", "m AS (SELECT 'qp-10' AS id UNION SELECT e.dst FROM m JOIN edges e ON e.src=m.id JOIN notes x ON x.id=m.id WHERE x.type='moc')", True)
add("G10_budget_walk", lambda s: R6(G.simple_walk(s.edges, SEED(s, "qp-30"), 2.0)), "SELECT id, round(cost,6) AS cost FROM h4 WHERE cost<=2.0", DIR + f", cdir AS (SELECT src, dst, {COST} AS w FROM dir), " + hops("h", "qp-30", 4, "cdir", EDGE_COST))
add("G11_slice", lambda s: G.distances(s.index.steps(), SEED(s, "qp-3", "qp-4"), 2).select("id"), "SELECT DISTINCT id FROM (SELECT id FROM a2 UNION SELECT id FROM b2)", DIR + ", " + hops("a", "qp-3", 2, "dir") + ", " + hops("b", "qp-4", 2, "dir"))
add("G12_walk_ids", lambda s: G.tree(s.index.steps(), SEED(s, "qp-5"), 2).select("id"), "SELECT id FROM h2", DIR + ", " + hops("h", "qp-5", 2, "dir"))
CANON = "chain AS (SELECT source_id AS id, digest_id AS top, 1 AS k FROM compacts UNION ALL SELECT c.id, p.digest_id, k+1 FROM chain c JOIN compacts p ON p.source_id=c.top), canon AS (SELECT id, arg_max(top,k) AS canonical FROM chain GROUP BY 1)"
add("G13_canonical", lambda s: C.canonical(s.compacts), "SELECT * FROM canon", CANON, True)
add("J9_equivalence", lambda s: C.equivalence(s.compacts).select("canonical", F.array_join("members", ",").alias("members")), "SELECT canonical, string_agg(m,',' ORDER BY m) AS members FROM (SELECT canonical, id AS m FROM canon UNION SELECT canonical, canonical FROM canon) GROUP BY 1", CANON, True)
add("G14_conflicts", lambda s: C.conflicts(s.compacts.unionByName(s.compacts.filter("digest_id = 'qp-100'").select(F.lit("qp-7").alias("digest_id"), "source_id"))), "SELECT source_id AS id, 'multiple-compactors' AS problem FROM compacts WHERE digest_id='qp-100'")
BELOW = "below AS (SELECT digest_id, source_id, 1 AS depth FROM compacts UNION ALL SELECT b.digest_id, c.source_id, depth+1 FROM below b JOIN compacts c ON c.digest_id=b.source_id WHERE depth<3), flat AS (SELECT digest_id, source_id, min(depth) AS depth FROM below GROUP BY 1,2)"
add("G15_expand", lambda s: C.expand(s.compacts, 3), "SELECT * FROM flat", BELOW, True)
add("G16_compaction_tree", lambda s: C.expand(s.compacts.filter("digest_id = 'qp-100' or digest_id = 'qp-120'"), 2).filter("digest_id = 'qp-100'").select("source_id", "depth"), "SELECT source_id, depth FROM flat WHERE digest_id='qp-100' AND depth<=2", BELOW, True)
SIZES = lambda s: s.base.select("id", F.octet_length("title").alias("size"))
PCT = "SELECT d.digest_id, round(CASE WHEN sum(strlen(n2.title))=0 THEN 0 ELSE 100.0::DOUBLE*(1-any_value(strlen(n1.title))/sum(strlen(n2.title))) END,6) AS pct FROM {} d JOIN notes n1 ON n1.id=d.digest_id JOIN notes n2 ON n2.id=d.source_id GROUP BY 1"
add("A11_saved_percent", lambda s: C.saved_percent(SIZES(s), s.compacts).select("digest_id", F.round("pct", 6).alias("pct")), PCT.format("compacts"))
add("A12_saved_at_depth", lambda s: C.saved_percent(SIZES(s), C.expand(s.compacts, 2)).select("digest_id", F.round("pct", 6).alias("pct")), PCT.format("(SELECT * FROM flat WHERE depth<=2)"), BELOW, True)
add("A15_staleness", lambda s: C.staleness(s.compacts, s.base), "SELECT digest_id, source_id FROM compacts JOIN notes d ON d.id=digest_id JOIN notes s ON s.id=source_id WHERE s.updated>d.updated")
add("A14_digest_edges", lambda s: s.edges.join(s.compacts.select(F.col("source_id").alias("src"), "digest_id"), "src").join(s.compacts.select(F.col("source_id").alias("dst"), F.col("digest_id").alias("d2")), "dst", "left").groupBy("digest_id").agg(F.count_if(F.col("digest_id") == F.col("d2")).alias("internal"), F.count_if(~F.col("digest_id").eqNullSafe(F.col("d2"))).alias("boundary")),
    "SELECT a.digest_id, count(*) FILTER (a.digest_id=b.digest_id) AS internal, count(*) FILTER (a.digest_id IS DISTINCT FROM b.digest_id) AS boundary FROM edges e JOIN compacts a ON a.source_id=e.src LEFT JOIN compacts b ON b.source_id=e.dst GROUP BY 1")
_SPARSE = lambda s: s.edges.filter("link_type = 'follows'")
LABEL = "und AS (SELECT src AS a, dst AS b FROM edges WHERE link_type='follows' UNION SELECT dst, src FROM edges WHERE link_type='follows'), reach AS (SELECT a, b FROM und UNION SELECT r.a, u.b FROM reach r JOIN und u ON u.a=r.b)"
add("G17_components", lambda s: G.components(_SPARSE(s)), "SELECT a AS id, least(a,min(b)) AS component FROM reach GROUP BY 1, a", LABEL.replace("SELECT a AS id", "SELECT a AS id"), True)
add("G18_on_cycles", lambda s: G.on_cycles(s.edges.filter("link_type = 'supports'")), "SELECT DISTINCT a AS id FROM reach WHERE a=b", "reach AS (SELECT src AS a, dst AS b FROM edges WHERE link_type='supports' UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON e.src=r.b WHERE e.link_type='supports')", True)
#: Links of two kinds: cycles, and notes between them. Every note's reach by UNION, so that it ends.
_MIXED = lambda s: s.edges.filter("link_type in ('part-of', 'follows')")
REACH = "mix AS (SELECT DISTINCT src, dst FROM edges WHERE link_type IN ('part-of','follows')), reach AS (SELECT src AS a, dst AS b FROM mix UNION SELECT r.a, e.dst FROM reach r JOIN mix e ON e.src=r.b), strong AS (SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON y.a=x.b AND y.b=x.a GROUP BY 1)"
add("G18_strong_components", lambda s: G.strong_components(_MIXED(s)), "SELECT id, component FROM strong", REACH, True)


def witnesses(s):
    """Length of the cycle given for each component, and how many of its steps are links of the store."""
    cycle = G.shortest_cycles(_MIXED(s), G.strong_components(_MIXED(s)))
    after = cycle.select("component", F.col("id").alias("dst"), (F.col("place") - 1).alias("place"))
    first = cycle.filter("place = 0").select("component", F.col("id").alias("first"))
    steps = cycle.join(after, ["component", "place"], "left").join(first, "component").select("component", F.col("id").alias("src"), F.coalesce("dst", "first").alias("dst"))
    there = _MIXED(s).select("src", "dst").distinct().withColumn("there", F.lit(1))
    return steps.join(there, ["src", "dst"], "left").groupBy("component").agg(F.count("*").alias("links"), F.count("there").alias("real"))


add("G18_cycle_lengths", witnesses, "SELECT component, min(n)::BIGINT AS links, min(n)::BIGINT AS real FROM far WHERE id=component GROUP BY 1",
    REACH + ", inside AS (SELECT e.src, e.dst, s1.component FROM mix e JOIN strong s1 ON s1.id=e.src JOIN strong s2 ON s2.id=e.dst AND s2.component=s1.component), far AS (SELECT component, dst AS id, 1 AS n FROM inside WHERE src=component UNION SELECT f.component, e.dst, f.n+1 FROM far f JOIN inside e ON e.src=f.id AND e.component=f.component WHERE f.id<>f.component AND f.n<400)", True)
_BAD = lambda s: s.compacts.unionByName(s.spark.createDataFrame([("qp-8", "qp-8"), ("qp-9", "qp-none"), ("qp-gone", "qp-17")], "digest_id string, source_id string"))
add("G19_validation", lambda s: C.validation(_BAD(s), s.base.select("id")), "SELECT source_id AS id, 'multiple-compactors' AS problem FROM bad GROUP BY 1 HAVING count(DISTINCT digest_id)>1 UNION ALL SELECT 'qp-8', 'self' UNION ALL SELECT 'qp-none', 'unknown-source' UNION ALL SELECT 'qp-gone', 'unknown-digest'", "bad AS (SELECT digest_id, source_id FROM compacts UNION ALL VALUES ('qp-8','qp-8'),('qp-9','qp-none'),('qp-gone','qp-17'))")
#: Digests of their own digests, near and far.
_ROUND = lambda s: s.compacts.unionByName(s.spark.createDataFrame([("qp-21", "qp-20"), ("qp-121", "qp-100"), ("qp-30", "qp-31"), ("qp-31", "qp-32")], "digest_id string, source_id string"))
add("G19_cycles", lambda s: C.cycles(_ROUND(s)), "SELECT DISTINCT a AS id, 'cycle' AS problem FROM rr WHERE a=b", "around AS (SELECT digest_id, source_id FROM compacts UNION ALL VALUES ('qp-21','qp-20'),('qp-121','qp-100'),('qp-30','qp-31'),('qp-31','qp-32')), rr AS (SELECT digest_id AS a, source_id AS b FROM around UNION SELECT rr.a, c.source_id FROM rr JOIN around c ON c.digest_id=rr.b)", True)
add("G16_preorder", lambda s: C.tree_rows(s.compacts, s.base.filter("type = 'moc'").select("id"), 3), "SELECT root, parent, id, depth::INT AS depth, row_number() OVER (PARTITION BY root ORDER BY way)-1 AS place FROM tr",
    "tr AS (SELECT id AS root, NULL::VARCHAR AS parent, id, 0 AS depth, [id] AS way FROM notes WHERE type='moc' UNION ALL SELECT tr.root, tr.id, c.source_id, tr.depth+1, list_append(tr.way,c.source_id) FROM tr JOIN compacts c ON c.digest_id=tr.id WHERE tr.depth<3)", True)
_ME = lambda s: C.canonical(s.compacts)


def link_list(s):
    """Links of a class of notes as links of its digest, without self-loops and repeats."""
    canon = _ME(s)
    to = canon.select(F.col("id").alias("dst"), F.col("canonical").alias("d2"))
    frm = canon.select(F.col("id").alias("src"), F.col("canonical").alias("s2"))
    e = s.edges.join(frm, "src", "left").join(to, "dst", "left").select(F.coalesce("s2", "src").alias("src"), F.coalesce("d2", "dst").alias("dst"), "link_type")
    return e.filter("src <> dst").filter("src = 'qp-100'").distinct()


add("G20_link_list", link_list, "SELECT DISTINCT s AS src, d AS dst, link_type FROM (SELECT coalesce(a.canonical,e.src) AS s, coalesce(b.canonical,e.dst) AS d, link_type FROM edges e LEFT JOIN canon a ON a.id=e.src LEFT JOIN canon b ON b.id=e.dst) WHERE s<>d AND s='qp-100'", CANON, True)
add("G21_show_links", lambda s: s.index.links.filter("src = 'qp-40'").select("dst", "link_type", "provenance"), f"SELECT dst, link_type, CASE WHEN inline THEN 'inline' ELSE 'typed' END AS provenance FROM edges WHERE src='qp-40' UNION ALL SELECT src, {INV}, 'virtual' FROM edges WHERE dst='qp-40'")
_NOTES = lambda s: s.base.select("id", "type", F.octet_length("title").alias("size"), "value")
#: Chains of neighbours in number, broken at every so many; collections among them are boundaries.
_CHAIN = lambda s, k: s.base.filter((F.col("doc_id") % k != 0) & (F.col("doc_id") + 1 < s.size)).select(F.col("id").alias("src"), F.concat(F.lit("qp-"), F.col("doc_id") + 1).alias("dst"))


def clusters(k: int) -> str:
    return f"""chain AS (SELECT 'qp-'||doc_id AS src, 'qp-'||(doc_id+1) AS dst FROM documents, n WHERE doc_id%{k}<>0 AND doc_id+1<n.c), pl AS (SELECT id FROM notes WHERE type<>'moc'),
und AS (SELECT src AS a, dst AS b FROM chain WHERE src IN (SELECT id FROM pl) AND dst IN (SELECT id FROM pl) UNION SELECT dst, src FROM chain WHERE src IN (SELECT id FROM pl) AND dst IN (SELECT id FROM pl)),
reach AS (SELECT a, b FROM und UNION SELECT r.a, u.b FROM reach r JOIN und u ON u.a=r.b), comp AS (SELECT a AS id, least(a,min(b)) AS component FROM reach GROUP BY a),
links AS (SELECT a.component, count(*) FILTER (a.component=b.component) AS internal_edges, count(*) FILTER (a.component IS DISTINCT FROM b.component) AS boundary_edges FROM chain e JOIN comp a ON a.id=e.src LEFT JOIN comp b ON b.id=e.dst GROUP BY 1),
metrics AS (SELECT component, count(*) AS node_count, sum(strlen(title)) AS size, coalesce(avg(value),50) AS v FROM comp JOIN notes USING (id) GROUP BY 1),
scored AS (SELECT *, ln(size)+10*cohesion-5*(boundary_edges/greatest(internal_edges+boundary_edges,1))+sqrt(node_count)+CASE WHEN v<20 THEN 15 WHEN v<40 THEN 7.5 WHEN v<60 THEN 0 WHEN v<80 THEN -5 ELSE -10 END AS score FROM (SELECT *, internal_edges/greatest(internal_edges+boundary_edges,1) AS cohesion FROM metrics JOIN links USING (component))),
best AS (SELECT component, node_count, internal_edges, boundary_edges, round(cohesion,6) AS cohesion, round(score,6) AS score FROM scored WHERE node_count>=3 AND cohesion>=0.3)"""


_METRICS = lambda d: d.select("component", "node_count", "internal_edges", "boundary_edges", F.round("cohesion", 6).alias("cohesion"), F.round("score", 6).alias("score"))
add("A13_cluster_metrics", lambda s: _METRICS(C.suggestions(_CHAIN(s, 7), _NOTES(s), None)), "SELECT * FROM best", clusters(7), True)
add("O11_suggestions", lambda s: C.suggestions(_CHAIN(s, 9), _NOTES(s)).select("component", "node_count"), "SELECT component, node_count FROM (SELECT * FROM scored WHERE node_count>=3 AND cohesion>=0.3 ORDER BY score DESC, component LIMIT 10)", clusters(9), True)
