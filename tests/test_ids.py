"""Ids are as short as they can be, and none clashes."""

import hashlib

from lattica.operators import ids


def test_shortest_ids(spark):
    hashes = {i: hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)}
    hashes |= {9001: "abcd" + "0" * 60, 9002: "abcd" + "0" * 59 + "1", 9003: "abce" + "f" * 60}
    taken = ["qp-" + hashes[5][:4], "qp-" + hashes[6][:9], "qp-" + hashes[7][:3], "other-" + hashes[8][:4], "qp-ffff"]
    got = dict(map(tuple, ids.shortest_ids(spark.createDataFrame(list(hashes.items()), "key int, hash string"), spark.createDataFrame([(t,) for t in taken], "id string")).collect()))
    assert len(set(got.values()) | set(taken)) == len(got) + len(taken)
    for k, h in hashes.items():
        others = [x for j, x in hashes.items() if j != k] + [t.removeprefix("qp-") for t in taken if t.startswith("qp-")]
        n = max(4, 1 + max(next((i for i in range(64) if i >= len(x) or x[i] != h[i]), 64) for x in others))
        assert got[k] == "qp-" + h[:n]
    assert got[9001] == "qp-" + hashes[9001] and len(got[5]) >= 8


def test_equal_hashes_are_told_apart(spark):
    df = spark.createDataFrame([(i, "f" * 64 if i < 4 else hashlib.sha256(str(i).encode()).hexdigest()) for i in range(8)], "key int, hash string")
    got = dict(map(tuple, ids.apart(df).collect()))
    assert len(set(got.values())) == 8 and got[0] == "f" * 64
