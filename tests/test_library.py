"""Small literal cases of the note operators."""

import math
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lattica.functions import text as X
from lattica.operators import compaction as C
from lattica.operators import context as K
from lattica.operators import filters as P
from lattica.operators import graph as G
from lattica.operators import mutate as U
from lattica.operators import quality as Q
from lattica.operators import relational as R
from lattica.operators import search as T
from lattica.operators import similarity as M
from lattica.sources import markdown, pack, storage
from lattica.sources.index import Index, counted
from lattica.streaming import telemetry


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


@pytest.fixture
def notes(spark):
    rows = [("qp-1", "Rust basics", "rust ownership and borrowing", "permanent", 80, ["rust"]), ("qp-2", "Python", "python handles memory; rust does not", "fleeting", None, ["python"]), ("qp-3", "Map", "links", "moc", 10, [])]
    return spark.createDataFrame(rows, "id string, title string, body string, type string, value int, tags array<string>").withColumn("updated", F.lit(None).cast("timestamp")).withColumn("created", F.lit(None).cast("timestamp"))


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"), ("adjustable", "adjust"), ("controlling", "control"), ("is", "is"), ("été", "été")])
def test_stem(word, stem):
    assert X.stem(word) == stem


def test_tokens(spark):
    row = spark.createDataFrame([("The Rust-lang, and 2nd Été!",)], "t string").select(X.tokens(F.col("t"))).first()[0]
    assert row == ["rust", "lang", "2nd", "été"]


@pytest.mark.parametrize("expression, want", [("s=abc", [1]), ("n=5", [1]), ("b=true", [1]), ("n>=5", [1, 2]), ("d>=2024-06-01", [1]), ("!n", [3, 4]), ("n", [1, 2]), ("z", [4]), ("b>0", [1]), ("s>1", []), ("x>y", []), ("l=1", []), ("n<6", [1])])
def test_custom_filter(spark, expression, want):
    rows = [(1, '{"s":"abc","n":5,"b":true,"d":"2024-06-20"}'), (2, '{"n":"7","d":"2024-01-01"}'), (3, "{}"), (4, '{"z":null,"l":[1]}')]
    df = spark.createDataFrame(rows, "id int, custom string")
    assert ids(df.filter(P.lenient_custom_filter(F.col("custom"), expression))) == want


def test_bad_filters():
    for x in ("", "!", "=v", "k="):
        with pytest.raises(P.FilterError):
            P.custom_filter(None, x)
    with pytest.raises(P.FilterError):
        P.parse_min_value("101")
    assert P.parse_min_value("100") == 100


def test_times():
    now = datetime(2024, 7, 1, tzinfo=timezone.utc)
    assert P.parse_time("30 days ago", now) == datetime(2024, 6, 1, tzinfo=timezone.utc)
    assert P.parse_time("2024-06-01", now) == datetime(2024, 6, 1, tzinfo=timezone.utc)
    with pytest.raises(P.FilterError):
        P.parse_time("soon", now)


def test_search(spark, notes, tmp_path):
    now = F.lit("2025-01-01").cast("timestamp")
    index = Index(spark, str(tmp_path / "index"))
    index.build(notes, spark.createDataFrame([], "src string, dst string, link_type string, inline boolean, position int"))
    hits = T.search(index, "rust", now).collect()
    assert [h["id"] for h in hits] == ["qp-1", "qp-2"]  # title and tag weigh more
    assert T.search(index, "  ", now).count() == 0
    assert ids(T.search(index, "rust NOT python", now)) == ["qp-1"]
    assert ids(T.search(index, "own* OR python", now)) == ["qp-1", "qp-2"]
    assert ids(T.search(index, "rust rust", now, where=F.col("type") == "fleeting")) == ["qp-2"]


def test_similarity(spark):
    rows = [("a", "one two three four five"), ("b", "one two three four five"), ("c", "one two three four six")]
    n = spark.createDataFrame(rows, "id string, body string").withColumn("title", F.lit("")).withColumn("tags", F.array().cast("array<string>")).withColumn("updated", F.lit(None).cast("timestamp"))
    of = {r["id"]: (r["rep"], r["class_id"], r["n_links"]) for r in M.duplicate_classes(counted(n), 3, 0.5).collect()}
    assert of == {"a": ("a", "a", 1), "b": ("a", "a", 1), "c": ("c", "a", 1)}


def test_near_duplicates_against_all_pairs(spark):
    """Pairs are verified by vectors held in a row each, whose terms no join multiplies."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([8, 60, 900]))] for _ in range(12)]
    rows = [(f"n{k}-{i}", " ".join(w if rng.random() > i / 20 else rng.choice(words) for w in b)) for k, b in enumerate(base) for i in range(5)] + [("none", "")]
    n = spark.createDataFrame(rows, "id string, body string").withColumn("title", F.lit("")).withColumn("tags", F.array().cast("array<string>")).withColumn("updated", F.lit(None).cast("timestamp"))
    postings = counted(n).cache()
    of = {}
    for r in M.vectors(postings, len(rows)).collect():
        of.setdefault(r["id"], {})[r["term"]] = r["w"]
    reps = {tuple(sorted(of[x].items())): x for x in sorted(of, reverse=True)}  # the least id of each vector
    want = {(a, b): x for a in reps.values() for b in reps.values() if a < b and (x := sum(w * of[b].get(t, 0.0) for t, w in of[a].items())) >= 0.6}
    found = M.near_duplicates(postings, len(rows), 0.6)
    assert "term" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["id_a"], r["id_b"]): r["score"] for r in found.collect()}
    assert len(want) > 20 and got == {k: pytest.approx(x) for k, x in want.items()}
    assert M.near_duplicates(postings.limit(0), 1, 0.6).count() == 0


def test_second_neighbours(spark):
    e = spark.createDataFrame([("1", "2"), ("2", "3"), ("1", "4"), ("4", "3")], "src string, dst string")
    assert [(r["id"], r["score"]) for r in M.second_neighbours(e, "1", 10).collect()] == [("3", 2.0)]


def test_compaction(spark):
    c = spark.createDataFrame([("d1", "1"), ("d1", "2"), ("d2", "d1"), ("d2", "3")], "digest_id string, source_id string")
    assert {r["id"]: r["canonical"] for r in C.canonical(c).collect()} == {"1": "d2", "2": "d2", "3": "d2", "d1": "d2"}
    with pytest.raises(ValueError):
        C.canonical(spark.createDataFrame([("a", "b"), ("b", "a")], "digest_id string, source_id string"))
    two = spark.createDataFrame([("a", "x"), ("b", "x")], "digest_id string, source_id string")
    assert ids(C.conflicts(two)) == ["x"]
    assert {(r["source_id"], r["depth"]) for r in C.expand(c, 2).filter("digest_id = 'd2'").collect()} == {("d1", 1), ("3", 1), ("1", 2), ("2", 2)}


def test_costs(spark):
    df = spark.createDataFrame([("supports", 100, 1.0), ("supports", 50, 1.5), ("supports", 0, 2.0), ("part-of", 75, 0.625)], "t string, v int, want double")
    assert df.filter(X.edge_cost(F.col("t"), F.col("v")) != F.col("want")).count() == 0


def test_graph(spark):
    e = spark.createDataFrame([("f", "m", "supports", False), ("m", "t", "supports", False), ("x", "y", "follows", False), ("y", "x", "follows", False)], "src string, dst string, link_type string, inline boolean")
    assert [r["id"] for r in G.path(G.directed(e, "out"), "f", "t", 10, spark).orderBy("place").collect()] == ["f", "m", "t"]
    assert G.path(G.directed(e, "out"), "t", "f", 10, spark).count() == 0
    assert ids(G.on_cycles(e)) == ["x", "y"]
    assert {r["id"]: r["component"] for r in G.components(e).collect()} == {"f": "f", "m": "f", "t": "f", "x": "x", "y": "x"}
    assert X.inverse is not None and {r["link_type"] for r in G.directed(e, "in").collect()} == {"supported-by", "precedes"}


def test_budget(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 9), ("c", 3)], "id string, size int")
    assert ids(R.running_budget(rows, "size", ["id"], 14)) == ["a", "b"]
    assert [r["id"] for r in K.blocks_within(rows, "size", ["id"], 9).orderBy("place").collect()] == ["a", "c"]


def test_changes(spark, notes):
    edges = spark.createDataFrame([("qp-1", "qp-2", "supports", False, 0), ("qp-3", "qp-1", "related", True, 0), ("qp-1", "qp-3", "related", False, 1)], "src string, dst string, link_type string, inline boolean, position int")
    n, e = U.merge_notes(notes, edges, "qp-1", "qp-2")
    assert ids(n) == ["qp-2", "qp-3"] and n.filter("id = 'qp-2'").first()["tags"] == ["python", "rust"]
    assert {(r["src"], r["dst"]) for r in e.collect()} == {("qp-3", "qp-2"), ("qp-2", "qp-3")}
    again = U.add_link(U.add_link(edges, "qp-1", "qp-9", "refines"), "qp-1", "qp-9", "refines")
    assert again.count() == 4 and again.filter("dst = 'qp-9'").first()["position"] == 2


def test_checks(spark, notes):
    bodies = spark.createDataFrame([("a", "text\n- [[x]]\n- [[y]]"), ("b", "- [[x]] because it explains a lot of it")], "id string, body string")
    found = Q.bare_link_lists(bodies).collect()
    assert [(r["note_id"], r["detail"]) for r in found] == [("a", "2")]
    assert Q.complexity(notes).count() == 0


def test_markdown_round_trip(spark, notes, tmp_path):
    for r in notes.select("id", markdown.render(notes).alias("m")).collect():
        (tmp_path / f"{r['id']}.md").write_text(r["m"])
    (tmp_path / "bad.md").write_text("nothing")
    back = markdown.scan(spark, str(tmp_path))
    assert ids(back.filter("error is null")) == ["qp-1", "qp-2", "qp-3"]
    assert back.filter("error is not null").count() == 1
    assert back.filter("id = 'qp-1'").first()["body"] == "rust ownership and borrowing"


def test_markdown_keeps_odd_titles(spark, tmp_path):
    """A title may be empty, missing in its table, or hold letters that YAML refuses or folds; so may a body and tags be; a head without a title is an error still."""
    odd = ["", None, " ", "\x7f\x85\u2028\ufeff", 'a: "b" # \\ c', "\t\x01\U0001f600", "null"]
    notes = spark.createDataFrame([(f"qp-{i}", t, "moc", i or None, ["no", None, t], t and f"{t}\n---\n") for i, t in enumerate(odd)], "id string, title string, type string, value int, tags array<string>, body string")
    files = notes.select(F.concat("id", F.lit(".md")).alias("path"), markdown.render(notes).alias("text"))
    back = {r["id"]: r for r in markdown.parse(files).collect()}
    assert {i: (r["title"], r["value"], r["tags"], r["body"], r["error"]) for i, r in back.items()} == {r["id"]: (r["title"], r["value"], r["tags"], r["body"], None) for r in notes.collect()}
    for text, error in (("---\nid: a\n---\n", "id or title is missing"), ("---\nid: a\ntitle: b\n", "the head doesn't end"), ("---\nid: a\ntitle: b\nvalue: no\n---\n", "value is no whole number: False")):
        assert markdown.parse_note("a", text)["error"] == error
    read = markdown.parse_note("a", "---\nid: a\ntitle: 'b: c'\nlinks: [{type: supports, id: d}]\n---\nx")
    assert (read["title"], read["links"], read["body"]) == ("b: c", [{"type": "supports", "id": "d"}], "x")


def test_pack_round_trip(spark, notes, tmp_path):
    edges = spark.createDataFrame([("qp-1", "qp-2", "supports", False, 0)], "src string, dst string, link_type string, inline boolean, position int")
    pack.write(notes, edges, str(tmp_path / "p"))
    lines = spark.read.text(str(tmp_path / "p")).select(F.col("value").alias("line"))
    assert ids(pack.read_notes(lines)) == ["qp-1", "qp-2", "qp-3"]
    assert pack.read_links(lines).count() == 1
    bodies = pack.read_bodies(spark.read.text(str(tmp_path / "p"), wholetext=True))
    assert {r["id"]: r["body"] for r in bodies.collect()}["qp-3"] == "links"


def test_streamed_rollup(spark, tmp_path):
    events = spark.createDataFrame([(datetime(2024, 1, d, 5), "list", d % 2 == 0, 50.0 * d, None) for d in range(1, 25)], "ts timestamp, command string, success boolean, duration_ms double, error string")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    telemetry.stream_daily(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out"))
    want = telemetry.daily(events).filter(F.col("w.end") <= F.lit("2024-01-17 05:00:00").cast("timestamp"))
    assert closed.count() == want.count() == 16
    kept = {}
    telemetry.stream_upserts(stream, "command", "ts", lambda rows, n: kept.update({r["command"]: r["duration_ms"] for r in rows.collect()}), str(tmp_path / "s2")).awaitTermination()
    assert kept == {"list": 1200.0}


def test_stem_queries_read_whole_texts(spark):
    import regex

    from lattica.model import STOP_WORDS
    from lattica.plans import registry

    sf = "/root/testdata/sf0.001"
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = [w for t in texts for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w and w not in STOP_WORDS]
    assert {r["term"] for r in registry.queries()["X2_stem_terms"](spark, sf).collect()} == set(words)
    assert sum(r["n"] for r in registry.queries()["X3_stemmed_index"](spark, sf).collect()) == len(words)


def test_renames_find_the_smallest_free_suffix(spark):
    old = spark.createDataFrame([("a",), *((f"a-{i}",) for i in range(1, 1500) if i != 1203), ("b",), ("b-01",), ("b-2",), ("c-9",)], "id string")
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    assert {r["id"]: r["new_id"] for r in U.renamed(old, new).collect()} == {"a": "a-1203", "b": "b-1", "c": "c", "d": "d"}
    full = old.unionByName(spark.createDataFrame([("a-1203",)], "id string"))
    assert U.renamed(full, new).filter("id = 'a'").first()["new_id"] == "a-1500"


def test_collections_of_collections_have_no_depth(spark):
    n = 45
    e = spark.createDataFrame([(f"m{i}", f"m{i + 1}") for i in range(n)] + [(f"m{n}", "leaf"), ("leaf", "beyond"), ("m3", "m1")], "src string, dst string")
    notes = spark.createDataFrame([(f"m{i}", "moc") for i in range(n + 1)] + [("leaf", "permanent"), ("beyond", "moc")], "id string, type string")
    assert set(ids(G.collection_members(e, notes, "m0", True, spark))) == {f"m{i}" for i in range(n + 1)} | {"leaf"}
    assert ids(G.collection_members(e, notes, "m0", False, spark)) == ["m0", "m1"]


def walk_by_hand(edges, root, hops, max_nodes=None, max_edges=None, max_fanout=None):
    out = {}
    for s, d, t in sorted(set(edges)):
        if s != d:
            out.setdefault(s, []).append((t, d))
    hop, links, reasons, queue = {root: 0}, [], set(), [root]
    for at in queue:
        if max_nodes is not None and len(hop) >= max_nodes:
            break
        ways = sorted(out.get(at, []))
        if hop[at] == hops:
            if ways:
                reasons.add("max_hops")
            continue
        if max_fanout is not None and len(ways) > max_fanout:
            reasons.add("max_fanout")
            ways = ways[:max_fanout]
        for t, d in ways:
            if max_edges is not None and len(links) >= max_edges:
                reasons.add("max_edges")
                break
            links.append((at, d, t))
            if d not in hop and (max_nodes is None or len(hop) < max_nodes):
                hop[d] = hop[at] + 1
                queue.append(d)
        if "max_edges" in reasons:
            break
    if max_nodes is not None and len(hop) >= max_nodes:
        reasons.add("max_nodes")
    return hop, next((r for r in ("max_nodes", "max_edges", "max_fanout", "max_hops") if r in reasons), None), links


@pytest.mark.parametrize("limits", [{}, {"max_nodes": 1}, {"max_nodes": 6}, {"max_fanout": 2}, {"max_edges": 7}, {"max_fanout": 1}, {"max_nodes": 9, "max_fanout": 3}, {"max_edges": 1000}, {"max_nodes": 1000}])
def test_limits_of_walks(spark, limits):
    rng = random.Random(4)
    edges = [(f"n{i}", f"n{rng.randrange(40)}", rng.choice(["supports", "follows", "related"])) for i in range(40) for _ in range(3)]
    for hops in (1, 3):
        notes, links, reason = G.limited(spark.createDataFrame(edges, "src string, dst string, link_type string"), "n0", hops, spark, **limits)
        want, why, listed = walk_by_hand(edges, "n0", hops, **limits)
        assert {r["id"]: r["hop"] for r in notes.collect()} == want and reason == why
        if "max_nodes" not in limits:
            assert sorted(map(tuple, links.collect())) == sorted(listed)


def test_cheapest_paths(spark):
    e = spark.createDataFrame([("a", "b", "supports"), ("b", "c", "supports"), ("a", "c", "supports"), ("c", "d", "part-of")], "src string, dst string, link_type string")
    values = spark.createDataFrame([("a", 50), ("b", 100), ("c", 0), ("d", 100)], "id string, value int")
    path = lambda end, **more: [(r["place"], r["id"], r["link_type"], r["cost"]) for r in G.path(e, "a", end, 5, spark, values, **more).collect()]
    assert path("d") == [(0, "a", None, 0.0), (1, "c", "supports", 2.0), (2, "d", "part-of", 2.5)]
    assert path("d", least=1) == [] and path("a") == [(0, "a", None, 0.0)]
    assert {r["id"]: r["parent"] for r in G.tree(e, spark.createDataFrame([("a",)], "id string"), 3, values).collect()} == {"a": None, "b": "a", "c": "a", "d": "c"}


def test_walks_of_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(G, "SMALL_FRONT", 1)
    monkeypatch.setattr(G, "ROUNDS", 3)
    n = 9
    e = spark.createDataFrame([(f"a{i}", f"{x}{i + 1}", "follows", False) for i in range(n) for x in "ab"], "src string, dst string, link_type string, inline boolean")
    got = {r["id"]: r["cost"] for r in G.simple_walk(e, spark.createDataFrame([("a0",)], "id string"), 4.0).collect()}
    assert got == {"a0": 0.0} | {f"{x}{i}": i / 2 for i in range(1, 9) for x in "ab"}


def test_index_is_resumed_and_kept_up_to_date(spark, notes, tmp_path):
    edges = spark.createDataFrame([("qp-1", "qp-2", "supports", False, 0), ("qp-3", "qp-1", "related", True, 0)], "src string, dst string, link_type string, inline boolean, position int")
    index, now = Index(spark, str(tmp_path / "i")), F.lit("2025-01-01").cast("timestamp")
    assert index.build(notes, edges, 3, most=1) == [0]
    (tmp_path / "i" / "000001" / "notes").mkdir(parents=True)  # what a lost run left behind
    (tmp_path / "i" / "000001" / "notes" / "part-0.parquet").write_bytes(b"half")
    again = Index(spark, str(tmp_path / "i"))
    assert again.build(notes, edges, 3) == [1, 2] and again.build(notes, edges, 3) == []
    assert ids(again.notes) == ["qp-1", "qp-2", "qp-3"] and [h["id"] for h in T.search(again, "rust", now).collect()] == ["qp-1", "qp-2"]
    assert [tuple(r) for r in again.backlinks("qp-1").collect()] == [("qp-3", "related")]
    again.put(notes.filter("id = 'qp-2'").withColumn("body", F.lit("nothing of the kind")), edges.limit(0))
    again.delete(notes.filter("id = 'qp-3'").select("id"))
    for _ in range(2):
        assert ids(again.notes) == ["qp-1", "qp-2"] and ids(T.search(again, "rust", now)) == ["qp-1"] and ids(T.search(again, "kind", now)) == ["qp-2"]
        assert again.backlinks("qp-1").count() == 0 and again.steps().count() == 2
        again.merge()
    assert len(again.segments()) == 1
    assert again.sync(notes, edges) == (1, 0) and ids(again.notes) == ["qp-1", "qp-2", "qp-3"]
    assert again.sync(notes.filter("id <> 'qp-1'"), edges) == (0, 1) and ids(again.notes) == ["qp-2", "qp-3"]


def test_scratch_tables_go(spark, tmp_path):
    made = len(storage._made)
    with storage.scratch(spark):
        kept = storage.new_path(spark, "kept", keep=True)
        df = storage.written(spark.range(5), "five")
        path = df.inputFiles()[0].removeprefix("file://").rsplit("/data/")[0]
        assert os.path.isdir(path) and df.count() == 5
    assert not os.path.exists(path) and len(storage._made) == made and os.path.isdir(kept.removeprefix("file://").removesuffix("/data"))


def test_places_in_order(spark):
    rows = [(i * 37 % 101, f"r{i}") for i in range(500)]
    got = R.numbered(spark.createDataFrame(rows, "k int, id string").repartition(7), ["k", "id"]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [i for _, i in sorted(rows)] and sorted(r["place"] for r in got) == list(range(1, 501))


def test_a_folder_is_read_by_few_tasks(spark, tmp_path):
    """Many small files don't make a task for every few; each is a note once, whatever task reads it."""
    for i in range(200):
        (tmp_path / f"n{i}.md").write_text(f"---\nid: n{i}\ntitle: t\n---\nbody {i}")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # as if each file filled a task
    try:
        rows = markdown.scan(spark, str(tmp_path)).select("id", "body", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", opened)
    assert {r["id"]: r["body"] for r in rows} == {f"n{i}": f"body {i}" for i in range(200)} and len(rows) == 200
    assert len({r["task"] for r in rows}) <= markdown.TASKS * spark.sparkContext.defaultParallelism < 200


def shuffled_rows(spark, run):
    """What run() gives, and how many rows the stages that it ran shuffled."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    return run(), total() - before


@pytest.mark.parametrize("often", [1 << 19, 40])
def test_similar_notes_shuffle_no_postings(spark, tmp_path, monkeypatch, often):
    """Weights of all postings meet their terms' numbers where they are, but for rare terms; what is shuffled are sums by note and term."""
    monkeypatch.setattr(M, "OFTEN", often)
    rng = random.Random(7)
    texts = {f"n{k:03}": rng.choices([f"w{i}" for i in range(150)], [1 / (i + 1) for i in range(150)], k=120) for k in range(200)} | {"none": []}
    rows = [(n, t, 0, 0, ws.count(t)) for n, ws in texts.items() for t in sorted(set(ws))]
    spark.createDataFrame(rows, "note_id string, term string, title long, tags long, body long").repartitionByRange(2, "term").write.parquet(str(tmp_path / "p"))
    postings = spark.read.parquet(str(tmp_path / "p"))
    df = {t: sum(r[1] == t for r in rows) for t in {r[1] for r in rows}}
    raw = {n: {t: c * (math.log((len(texts) + 1) / (df[t] + 1)) + 1) for m, t, _, _, c in rows if m == n} for n in texts}
    vec = {n: {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for n, v in raw.items()}
    got = {}
    for r in M.vectors(postings, len(texts)).collect():
        got.setdefault(r["id"], {})[r["term"]] = r["w"]
    assert got == {n: pytest.approx(v) for n, v in vec.items() if v}
    dot = {n: sum(w * vec["n005"].get(t, 0.0) for t, w in v.items()) for n, v in vec.items() if n != "n005"}
    found, moved = shuffled_rows(spark, lambda: M.similar_to(postings, len(texts), "n005", 0.3, 1000).collect())
    assert {r["id"]: r["score"] for r in found} == {n: pytest.approx(x) for n, x in dot.items() if x >= 0.3} and len(found) > 10
    if often > len(rows):
        assert moved < len(rows) / 2
    pair, moved = shuffled_rows(spark, lambda: M.cosines_to(M.vectors(postings, len(texts), ["n005", "n009"]), "n005").collect())
    assert [r["score"] for r in pair] == [pytest.approx(dot["n009"])] and moved < len(rows) / 5
    assert M.similar_to(postings, len(texts), "none", 0.0, 5).count() == M.similar_to(postings.limit(0), 1, "n005", 0.0, 5).count() == 0


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(120)]
    base = [[rng.choice(words) for _ in range(30)] for _ in range(25)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[k:], *rng.choices(words, k=k)]) for b in base for k in (1, 3, 6)] + [" ".join(base[0])] * 6
    notes = spark.createDataFrame([(f"n{i:03}", t, "", []) for i, t in enumerate(texts)], "id string, body string, title string, tags array<string>").withColumn("updated", F.lit(None).cast("timestamp"))
    postings = counted(notes)
    vec: dict = {}
    for r in M.vectors(postings, len(texts)).collect():
        vec.setdefault(r["id"], {})[r["term"]] = r["w"]
    rep = {r["id"]: r["rep"] for r in M.copies(postings).collect()}
    assert all(rep[i] == min(j for j in vec if vec[j].keys() == vec[i].keys() and all(abs(vec[i][t] - vec[j][t]) < 1e-12 for t in vec[i])) for i in vec)
    reps = sorted(set(rep.values()))
    dot = lambda a, b: sum(w * vec[b].get(t, 0.0) for t, w in vec[a].items())
    for threshold in (0.6, 0.85):
        got = {(r["id_a"], r["id_b"]): r["score"] for r in M.near_duplicates(postings, len(texts), threshold).collect()}
        want = {(a, b): dot(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if dot(a, b) >= threshold}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want


def test_a_random_sample_has_five_of_the_notes(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    every = {f"qp-{r['doc_id']}" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    drawn = [[r["id"] for r in __spark_entry__.queries()["O13_random_sample"](spark, sf).collect()] for _ in range(3)]
    assert all(len(set(d)) == 5 and set(d) <= every for d in drawn) and len(set(map(tuple, drawn))) > 1


def test_large_metadata_by_size(spark):
    """Sizes that are known need no texts: a note's metadata may be larger than a string can be."""
    sizes = spark.createDataFrame([("a", 10240), ("b", 10241), ("c", 1 << 40)], "id string, bytes long")
    assert {(r["note_id"], r["detail"]) for r in Q.large_metadata(sizes).collect()} == {("b", "10241"), ("c", str(1 << 40))}
    texts = spark.createDataFrame([("a", "é" * 5120), ("b", "é" * 5121)], "id string, custom string")
    assert [(r["note_id"], r["detail"]) for r in Q.large_metadata(texts).collect()] == [("b", "10242")]


def test_capitals_letter_by_letter(spark):
    """Capitals are those of SQL, a letter each, also where Unicode's full mapping gives more."""
    duckdb = pytest.importorskip("duckdb")
    newer = (0x19B, 0x264, 0x1C8A)  # their capitals came with Unicode 16, which DuckDB doesn't know
    texts = ["größe é ŉ ﬁ ᾳ σς", "", None, "plain", "ß", *(chr(c) for c in range(0x80, 0x2000) if c not in newer)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.upper(F.col("t")).alias("u"))
    con = duckdb.connect()
    assert {r["i"]: r["u"] for r in got.collect()} == {i: con.execute("SELECT upper(?::VARCHAR)", [t]).fetchone()[0] for i, t in enumerate(texts)}


def test_near_duplicates_shuffle_no_pairs(spark, tmp_path, monkeypatch):
    """Candidates stay in the task that finds them: what is shuffled grows with the postings, not with the pairs; blocks of a few notes give what all pairs give."""
    monkeypatch.setattr(M, "TERMS_AT_ONCE", 200, raising=False)
    rng = random.Random(9)
    texts = {f"n{k}": [*rng.choices("abcdef", k=8), f"x{k % 7}", f"y{k}", f"z{k}"] for k in range(260)}
    rows = [(n, t, 0, 0, ws.count(t)) for n, ws in texts.items() for t in sorted(set(ws))]
    spark.createDataFrame(rows, "note_id string, term string, title long, tags long, body long").write.parquet(str(tmp_path / "p"))
    postings = spark.read.parquet(str(tmp_path / "p"))
    df = {t: sum(r[1] == t for r in rows) for t in {r[1] for r in rows}}
    raw = {n: {t: ws.count(t) * (math.log((len(texts) + 1) / (df[t] + 1)) + 1) for t in set(ws)} for n, ws in texts.items()}
    norm = {n: math.sqrt(sum(x * x for x in v.values())) for n, v in raw.items()}
    want = {(a, b): sum(x * raw[b].get(t, 0.0) for t, x in raw[a].items()) / norm[a] / norm[b] for a in texts for b in texts if a < b}
    found, moved = shuffled_rows(spark, lambda: M.near_duplicates(postings, len(texts), 0.1).collect())
    assert {(r["id_a"], r["id_b"]): r["score"] for r in found} == {k: pytest.approx(x) for k, x in want.items() if x >= 0.1}
    assert moved < 4 * len(rows) < len(found)


def test_a_folder_is_listed_by_tasks(spark, tmp_path):
    """The driver holds no list of files: Spark's own index of them isn't made. Files lie in many folders; others, hidden ones and folders below are as Spark reads them."""
    notes = spark.createDataFrame([(f"n-{i}", f"t{i}", "moc", None, [], f"b{i}") for i in range(300)], "id string, title string, type string, value int, tags array<string>, body string")
    written = markdown.write(notes, str(tmp_path)).collect()
    (tmp_path / "a b%20").mkdir()
    (tmp_path / "a b%20" / "z é.md").write_bytes(b"---\nid: z\ntitle: \xc3\xa9\n---\n\xffx")
    (tmp_path / "_hidden").mkdir()
    for name in ("_hidden/a.md", ".b.md", "_c.md", "d.txt", "e.markdown"):
        (tmp_path / name).write_text("---\nid: no\ntitle: no\n---\n")
    raw = markdown.scan_raw(spark, str(tmp_path))
    assert not any(p.endswith(".md") for p in raw.inputFiles())
    back = {r["id"]: (r["title"], r["body"]) for r in markdown.scan(spark, str(tmp_path)).collect()}
    assert back == {f"n-{i}": (f"t{i}", f"b{i}") for i in range(300)} | {"z": ("é", "�x")}
    assert {r["path"] for r in written} <= {r["path"] for r in raw.collect()} and len({r["path"].rsplit("/", 2)[1] for r in written}) > 100
    assert markdown.scan(spark, str(tmp_path / "_hidden" / "..")).count() == 301
    (tmp_path / "none").mkdir()
    assert markdown.scan(spark, str(tmp_path / "none")).count() == 0
