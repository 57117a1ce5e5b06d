"""Strong components, cycles and cheapest walks against plain Python on random graphs."""

import heapq
import random

import pytest

from lattica.operators import graph as G


def random_graph(seed, n, m):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}", rng.choice("ab")) for _ in range(m)]


def reach(edges):
    to = {}
    for a, b, _ in edges:
        to.setdefault(a, set()).add(b)
    out = {}
    for a in to:
        seen, stack = set(), [a]
        while stack:
            for b in to.get(stack.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        out[a] = seen
    return out


@pytest.mark.parametrize("edges", [random_graph(1, 30, 40), random_graph(2, 40, 45), [("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("c", "d", "x"), ("d", "e", "x"), ("e", "f", "x"), ("f", "e", "x"), ("g", "g", "x"), ("a", "h", "x")], [("a", "b", "x"), ("b", "c", "x")], []])
def test_components_and_cycles(spark, edges):
    far = reach(edges)
    want = {a: min(b for b in far[a] if a in far.get(b, ())) for a in far if a in far[a]}
    df = spark.createDataFrame(edges, "src string, dst string, link_type string")
    components = G.strong_components(df)
    assert {r["id"]: r["component"] for r in components.collect()} == want
    cycles = {}
    for r in G.shortest_cycles(df, components).collect():
        cycles.setdefault(r["component"], {})[r["place"]] = r["id"]
    assert set(cycles) == set(want.values())
    links = {(a, b) for a, b, _ in edges}
    for c, places in cycles.items():
        ids = [places[k] for k in range(len(places))]
        assert ids[0] == c and len(set(ids)) == len(ids) and all((a, b) in links for a, b in zip(ids, [*ids[1:], ids[0]], strict=True))
        level, k = {c}, 0
        while True:  # no shorter way back
            level, k = {b for a, b in links if a in level and want.get(b) == c}, k + 1
            if c in level:
                break
        assert k == len(ids)


def by_hand(steps, root, max_cost, max_nodes=None, max_edges=None, max_fanout=None):
    to = {}
    for a, b, t, w in steps:
        if a != b:
            to.setdefault(a, {})[t, b] = min(w, to.get(a, {}).get((t, b), w))
    heap, done, links, reasons, best = [(0.0, root, "", "")], {}, [], set(), {root: (0.0, "", "")}
    while heap:
        cost, x, _, _ = heapq.heappop(heap)
        if x in done or best[x][0] < cost:
            continue
        done[x] = best[x]
        if max_nodes is not None and len(done) >= max_nodes:
            reasons.add("max_nodes")
            break
        out = sorted(to.get(x, {}).items())
        if cost >= max_cost:
            if out:
                reasons.add("max_hops")
            continue
        if max_fanout is not None and len(out) > max_fanout:
            reasons.add("max_fanout")
            out = out[:max_fanout]
        for (t, b), w in out:
            if max_edges is not None and len(links) >= max_edges:
                reasons.add("max_edges")
                break
            links.append((x, b, t))
            if b not in done and (b not in best or (cost + w, t, x) < best[b]):
                best[b] = (cost + w, t, x)
                heapq.heappush(heap, (cost + w, b, t, x))
        if "max_edges" in reasons:
            break
    notes = best if "max_edges" in reasons else done
    return {k: v[0] for k, v in notes.items()}, sorted(links), next((r for r in ("max_nodes", "max_edges", "max_fanout", "max_hops") if r in reasons), None)


@pytest.mark.parametrize("limits", [{}, {"max_nodes": 7}, {"max_nodes": 1}, {"max_fanout": 1}, {"max_edges": 9}, {"max_fanout": 2, "max_nodes": 12}])
def test_cheapest(spark, limits):
    rng = random.Random(9)
    steps = [(a, b, t, rng.choice([0.5, 0.625, 1.0, 1.25, 2.0])) for a, b, t in random_graph(5, 40, 110)]
    notes, links, reason = G.cheapest(spark.createDataFrame(steps, "src string, dst string, link_type string, w double"), "n03", 2.5, spark, **limits)
    want = by_hand(steps, "n03", 2.5, **limits)
    assert {r["id"]: r["cost"] for r in notes.collect()} == want[0] and sorted(tuple(r) for r in links.collect()) == want[1] and reason == want[2]


def test_long_rings_take_few_rounds(spark, monkeypatch):
    """A ring leading into another at every second note, a tail before and after, and a third ring that a chord makes more than one cycle."""
    n = 40
    at = lambda c, k: f"{c}{k * 7 % n:03d}"
    edges = [(at(c, k), at(c, (k + 1) % n)) for c in "xyz" for k in range(n)] + [(at("x", k), at("y", k)) for k in range(0, n, 2)] + [(at("y", 3), at("z", 0)), (at("z", 0), at("z", 30)), ("in", at("x", 5)), (at("z", 9), "out")]
    rounds = []
    monkeypatch.setattr(G, "written", lambda df, name, f=G.written: rounds.append(name) or f(df, name))
    df = spark.createDataFrame(edges, "src string, dst string")
    components = G.strong_components(df)
    assert {(r["id"], r["component"]) for r in components.collect()} == {(at(c, k), f"{c}000") for c in "xyz" for k in range(n)}
    assert rounds.count("ancestors") < n
    rounds.clear()
    rings = df.filter("substring(src, 1, 1) in ('x', 'y') and substring(dst, 1, 1) in ('x', 'y')")
    cycles = {(r["component"], r["place"], r["id"]) for r in G.shortest_cycles(rings, components.filter("substring(id, 1, 1) < 'z'")).collect()}
    assert cycles == {(f"{c}000", k, at(c, k)) for c in "xy" for k in range(n)}
    assert len(rounds) < n
    assert G.shortest_cycles(df, components).filter("component = 'z000'").count() == n - 29
