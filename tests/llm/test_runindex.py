import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import runindex
from lattica.sources import storage

SCHEMA = "doc_id long, text string"


def by_hand(rows, size=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - size + 1):
                s = t[k : k + size]
                least[s] = min(least.get(s, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if i is not None and least[t[k : k + size]] < i:
                gone[k : k + size] = b"\1" * size
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def sample(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(25), prose(12), "é" * 40, "x" * 300, "ab" * 100, "é" + "z" * 50]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            rows.append((i, prose(60)))
        elif kind == 1:
            rows.append((i, prose(10) + rng.choice(shared) + prose(10) + rng.choice(shared)))
        elif kind == 2 and len(rows) > 3:
            t = list(rows[rng.randrange(len(rows))][1] or "")
            for _ in range(2):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("abcé")
            rows.append((i, "".join(t)))
        elif kind == 3 and len(rows) > 3:
            rows.append((i, rows[rng.randrange(len(rows))][1]))
        else:
            rows.append((i, rng.choice([None, "", "a" * 49, "a" * 50, "a" * 51, prose(8), rng.choice(shared)])))
    rng.shuffle(rows)
    return rows


ODD = [(7, "same id " * 12), (7, "same id " * 12), (7, "same id " * 12 + "!"), (None, "same id " * 12), (None, None), (3, "y" * 50), (2, "y" * 50), (9, "q" * 5000), (8, "q" * 4000 + "r")]


@pytest.mark.parametrize("hot_over, most", [(runindex.HOT, runindex.FILTER_BYTES), (1, runindex.FILTER_BYTES), (runindex.HOT, 1)])
def test_against_all_strings(spark, hot_over, most):
    rows = sample() + ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("spans", F.lit(1)).withColumn("key", F.lit(2))
    got = runindex.dedup(df, hot_over=hot_over, most=most)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows)


def test_empty(spark):
    assert runindex.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r["n_removed"] for r in runindex.dedup(spark.createDataFrame([(1, "a" * 500), (2, None)], SCHEMA)).collect()] == [0, 0]


def test_long_text(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghijkl ") for _ in range(700_000))
    rows = [(1, long[300_000:300_100]), (2, long), (3, long[:10] + long[600_000:] + "tail")]
    assert sorted(map(tuple, runindex.dedup(spark.createDataFrame(rows, SCHEMA)).collect())) == by_hand(rows)


@pytest.mark.parametrize("place", [runindex.PLACE, 3])
def test_index(monkeypatch, place):
    """The index of pieces gives the least number of each string of 50 bytes, in fewer runs than signs."""
    monkeypatch.setattr(runindex, "PLACE", place)
    rng = np.random.default_rng(2)
    base = rng.integers(97, 101, 84, dtype=np.uint8)
    pieces = []
    for _ in range(200):
        p = base[rng.integers(0, 10) :][: rng.integers(50, 75)].copy()
        if rng.random() < 0.5:
            p[rng.integers(0, len(p))] = 255
        pieces.append(p.tobytes())
    pieces.append(b"\0" * 84)
    number = rng.permutation(len(pieces)) // 2
    data, at = runindex.bytes_of(pa.array(pieces, pa.binary()))
    index = runindex.RunIndex(data, at, number)
    least, want = index.stream(), {}
    for p, k in zip(pieces, number, strict=True):
        for i in range(len(p) - 49):
            want[p[i : i + 50]] = min(want.get(p[i : i + 50], k), k)
    for j, p in enumerate(pieces):
        own = least[index.origin[j] : index.origin[j] + len(p) + 1]
        assert own.tolist() == [want[p[i : i + 50]] if i + 50 <= len(p) else -1 for i in range(len(p) + 1)]
    assert len(index.start) < len(least)


def test_pieces_hold_every_string_once():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 100, n, dtype=np.uint8).tobytes() for n in (0, 10, 49, 50, 51, 500, 3000)] + [b"a" * 2000]
    data, at = runindex.bytes_of(pa.array(texts, pa.binary()))
    seen, keys = [], {}
    for p in runindex.pieces_of(data, at):
        assert p.size.max() <= runindex.PIECE
        for f, s, n, d, g in zip(p.key, p.start, p.size, p.doc, p.gram(), strict=True):
            own = runindex.fingerprints(data[s : s + n])
            assert (own == f).sum() == 1 and own[g] == f if g >= 0 else (own == f).sum() > 1
            for i in range(n - 49):
                seen.append((int(d), int(s - at[d]) + i))
                keys.setdefault(data[s + i : s + i + 50].tobytes(), set()).add(int(f))
    assert sorted(seen) == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 49)]
    assert all(len(v) == 1 for v in keys.values())


def test_as_registered(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = runindex.op12_suffix_dedup(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and sorted(map(tuple, got.collect()), key=repr) == want


@pytest.mark.parametrize("hot_over", [runindex.HOT, 1])
def test_rounds(spark, hot_over):
    """Fingerprints dealt out to rounds give the same, and no round's tables outlive it."""
    rows = sample(3)
    before = set(os.listdir(storage.shared_dir(spark).removeprefix("file://")))
    got = runindex.dedup(spark.createDataFrame(rows, SCHEMA), hot_over=hot_over, round_bytes=2000)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows)
    top = storage.shared_dir(spark).removeprefix("file://")
    left = {d: os.path.join(top, d, "data") for d in set(os.listdir(top)) - before}
    assert not [d for d in left if d.startswith(("distinct", "answers", "hot", "strings", "least")) and os.path.exists(left[d])]
    assert not [f for d in left if d.startswith("pieces") for f in os.listdir(left[d]) if f.startswith("part")]


def test_cut_of_spans_that_touch_overlap_and_end_texts():
    """Spans of several texts at once: out of order, nested, touching, at both ends; texts without any, and a slice of a batch."""
    texts = [b"", b"abcdefghij", b"klmnopqrst", b"uvwxyz", b"0123456789"]
    spans = [None, [(6, 10), (0, 2), (2, 4), (7, 8)], [], [(0, 6)], [(0, 3), (5, 6)]]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    rows = [None if s is None else [{"start": a, "end": b} for a, b in s] for s in spans]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts, pa.binary()), pa.array(rows, kind)], ["doc_id", "text", "spans"])
    kept = [(0, 0, 0, b""), (10, 8, 2, b"ef"), (10, 0, 0, b"klmnopqrst"), (6, 6, 1, b""), (10, 4, 2, b"346789")]
    want = [{"doc_id": i, "n_bytes": n, "n_removed": r, "n_spans": s, "kept_sha256": hashlib.sha256(k).hexdigest()} for i, (n, r, s, k) in enumerate(kept)]
    assert next(runindex._cut(iter([batch]))).to_pylist() == want
    assert next(runindex._cut(iter([batch.slice(1, 3)]))).to_pylist() == want[1:4]
    assert next(runindex._cut(iter([batch.slice(0, 0)]))).to_pylist() == []
