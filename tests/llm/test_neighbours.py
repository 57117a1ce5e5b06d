import numpy as np
import pytest

from lattica.llm import neighbours


def brute(rows, top=20):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in fine:
        if q % 20 == 0:
            scored = sorted((-(v * x).sum(), i) for i, v in fine if i != q and len(v) == len(x))
            out[q] = [(i, -s) for s, i in scored[:top]]
    return out


@pytest.mark.parametrize("block", [4096, 150])
def test_recall(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "PARTITION_ROWS", 300)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 10)).astype(np.float32)
    x[600:] = x[7]  # half of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want, hit, total = {}, brute(rows), 0, 0
    for r in neighbours.search(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q, best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(m[2] == pytest.approx((x[q].astype(float) * x[m[1]].astype(float)).sum(), abs=1e-12) for m in mine)
        hit += len({m[1] for m in mine} & {i for i, _ in best})
        total += 20
    assert hit / total >= 0.9


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0]), (20, [-1.0, 1.0]), (None, [1.0, 1.0]), (9, [])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(df, lambda i: i % 20 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 7), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 7)]
    assert neighbours.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def recall(got, rows):
    want, mine = brute(rows), {}
    for r in got:
        mine.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert set(mine) == set(want)
    return sum(len(mine[q].keys() & {i for i, _ in best}) for q, best in want.items()) / sum(map(len, want.values()))


def test_recall_on_the_embeddings(spark, monkeypatch):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert recall(neighbours.op10_nearest(spark, sf).collect(), rows) >= 0.9
    # several partitions, and few candidates for the exact ranking in each
    monkeypatch.setattr(neighbours, "PARTITION_ROWS", 250)
    monkeypatch.setattr(neighbours, "RERANK", 60)
    assert recall(neighbours.op10_nearest(spark, sf).collect(), rows) >= 0.9


def test_recall_in_dense_clusters(spark):
    """Vectors of a cluster that differ by less than codes tell apart, more of them than RERANK."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(3, 16)) * 5
    x = np.concatenate([c + rng.normal(size=(900, 16)) * 0.01 for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(neighbours.search(df, lambda i: i % 20 == 0).collect(), rows) >= 0.99


def test_clusters_need_few_partitions():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 5
    x = np.concatenate([c + rng.normal(size=(60, 16)) * 0.3 for c in centres])
    index = neighbours.Index(x, 40 * neighbours.PARTITION_ROWS)
    assert index.parts > 20 and index.looks <= index.parts // 4


def test_the_query_on_whole_tables(spark, tmp_path):
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(40, rng.normal(size=6).tolist()), (121, None), (122, [0.0] * 6)]
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([(*r, 0) for r in rows], schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = neighbours.op10_nearest(spark, str(tmp_path)).collect()
    plain = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    for q in {r["query_id"] for r in got}:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert len({r for r, *_ in mine}) == len(mine) >= 20 and all(v != q for _, v, _ in mine)
    single = [r for r in got if r["query_id"] not in (40,)]
    want = brute([r for r in plain if r[0] != 40] + [r for r in plain if r[0] == 40])
    for q in {r["query_id"] for r in single}:
        assert [(r["vec_id"], pytest.approx(r["score"])) for r in sorted(single, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, pytest.approx(s)) for i, s in want[q]]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert neighbours.op10_nearest(spark, f"{tmp_path}/none").collect() == []
