import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>"


def by_hand(rows, k=lloyd.K, rounds=lloyd.ROUNDS, dim=lloyd.DIM):
    kept = [(i, [math.floor(256 * float(x)) for x in np.array(v, np.float32)]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept] if centroids else []
    per = {}
    for _, c, d in found:
        per[c] = per.get(c, 0) + d
    return sorted(((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def gathered(rng, n, spots=9, spread=0.02):
    at = rng.normal(size=(spots, 64))
    return [(i, (at[i % spots] + spread * rng.normal(size=64)).tolist()) for i in range(n)]


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = gathered(rng, 130) + [(200 + i, rng.normal(size=64).tolist()) for i in range(60)]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 63 + [None]), (304, [float("nan")] * 64), (305, [float("inf")] + [0.0] * 63), (306, [0.0] * 64), (7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (400, [-3.25] * 64), (401, [-3.25] * 64), (402, [3e4] * 64)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("x")).withColumn("v", F.lit(0))
    assert of(lloyd.clusters(df)) == by_hand(rows)


def test_few_and_none(spark):
    assert lloyd.clusters(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [1.0] * 64)]
    assert of(lloyd.clusters(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)
    assert lloyd.clusters(spark.createDataFrame([(None, [0.5] * 64)], SCHEMA)).count() == 0
    assert lloyd.clusters(spark.createDataFrame([(1, [1e30] * 64)], SCHEMA)).count() == 0  # documented: too large for a long


@pytest.mark.parametrize("spread", [0.0, 0.01, 3.0])
def test_walk_is_exact_and_prunes(spread):
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.array([v for _, v in gathered(rng, 1500, 12, spread)])).astype(np.int64)
    c = x[rng.permutation(len(x))[:40]].copy()
    c[7] = c[3]
    t = lloyd.Tree(x)
    assert sorted(t.order.tolist()) == list(range(len(x)))
    y = x[t.order]
    for i in range(len(t.centre)):  # every node covers what is below it
        own = y[t.lo[i] : t.hi[i]] - y[t.centre[i]]
        assert np.sqrt((own**2).sum(1)).max() <= t.radius[i] + 1e-6 and t.lo[i] <= t.centre[i] < t.hi[i]
    near, dist, compared = lloyd.Centroids(c).nearest(y, (t.centre, t.radius, t.lo, t.hi, t.skip))
    d2 = ((y[:, None, :] - c[None]) ** 2).sum(2)
    assert (near == d2.argmin(1)).all() and (dist == d2.min(1)).all()
    assert compared <= len(x) * len(c) and (spread > 1 or compared < len(x) * len(c) / 2)


def test_large_components():
    rng = np.random.default_rng(2)
    x = rng.integers(-(2**27) + 1, 2**27, (100, 64))
    c = np.concatenate([x[:5], x[:2]])
    t = lloyd.Tree(x)
    near, dist, _ = lloyd.Centroids(c).nearest(x[t.order], (t.centre, t.radius, t.lo, t.hi, t.skip))
    for row, n, d in zip(x[t.order].tolist(), near, dist, strict=True):
        assert (d, n) == min((sum((a - b) ** 2 for a, b in zip(row, y, strict=True)), i) for i, y in enumerate(c.tolist()))


def test_as_registered(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    cur = con.execute(lloyd.ORACLE["op13_centroid_clusters"])
    got = lloyd.op13_centroid_clusters(spark, "/root/testdata/sf0.001")
    assert got.columns == [c[0] for c in cur.description] and of(got) == sorted(cur.fetchall(), key=repr)
