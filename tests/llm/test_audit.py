import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lattica.llm import audit

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def by_hand(docs, labels):
    """The contract, order by order."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    rows, least = [], {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    for i, text, source in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        rows.append((source or "", i, {f for f in fails if fails[f]}))
    out, taken = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                here = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                taken[part, f] = taken.get((part, f), 0) + len(here)
                all_f = [r for r in own if f in r[2]]
                out[part, "".join(order), k + 1] = [len(left), len(here), len(all_f) - len(here), sum(r[2] == {f} for r in own), sum(r[1] in good for r in here), sum(r[1] in toxic for r in here)]
    return {k: (*v, taken[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def sample():
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "short", long, long + " #", long.upper(), "a b " * 200, "A B " * 150 + "$", long + "é" * 3000, long + "é" * 3000 + "x", "x" * 40_000, "x" * 39_999 + "y", "x" * 128, "x" * 129]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(120)]
    docs += [(5, "short", "s"), (5, "short", "s"), (None, "short", "s"), (None, long, "t"), (7, "alone #", "u")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("hashed", [audit.hash_of, lambda c: F.when(c.isNotNull(), F.lit(1))])
def test_against_every_order(spark, hashed):
    docs, labels = sample()
    got = audit.audit(spark.createDataFrame(docs, DOCS).withColumn("mask", F.lit("x")).withColumn("id", F.lit(1)), spark.createDataFrame(labels, LABELS), hashed=hashed)
    assert rows_of(got) == by_hand(docs, labels)


def test_empty_and_no_ids(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0
    docs = [(None, None, None), (None, "", None)]
    assert rows_of(audit.audit(spark.createDataFrame(docs, DOCS), labels)) == by_hand(docs, [])


def test_copies_are_those_of_a_smaller_id(spark):
    docs = [(3, "a"), (1, "a"), (2, "b"), (9, "a"), (9, "a"), (1, "a"), (4, "c" * 5000), (5, "c" * 5000), (6, "c" * 4999 + "d")]
    got = audit.copies(spark.createDataFrame(docs, "doc_id long, text string"), [])
    assert sorted(r["id"] for r in got.collect()) == [3, 5, 9, 9]


def test_as_registered(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(audit.ORACLE["op11_filter_audit"])
    names = [c[0] for c in cur.description]
    got = audit.op11_filter_audit(spark, sf)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
