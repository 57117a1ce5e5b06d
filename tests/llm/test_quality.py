import random
import re
from collections import Counter

import pytest

from lattica.llm import quality

duckdb = pytest.importorskip("duckdb")
SCHEMA = "doc_id long, text string, lang string, source string"


def by_hand(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    repeat = len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n


TEXTS = [None, "", " \n\t", "one two", "a b c d e f g h i j", "a b c d e " * 4, "x y z\nx y z\n \nq é w\n" * 3, " ".join(f"w{i % 23}" for i in range(300)), "a a a a a a a a a a a a", "#$ | < >&*% " * 5, "z" * 200_000, "one two three four five six seven\x0beight\x1cnine ten eleven"]


def test_measures(spark):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS)], SCHEMA)
    for r in quality.assess(docs.selectExpr("*", "true as kept", "1 as n_words")).collect():
        assert tuple(r)[1:7] == by_hand(TEXTS[r["doc_id"]]), r["doc_id"]


def test_verdict(spark):
    clean = [(i, " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(40 + i % 30)) + ".", "en", "hot" if i % 3 else "small") for i in range(200)]
    junk = [(1000 + i, " ".join(f"word{k * i % 991} ||| &&& %%%" for k in range(40)), "en", "hot") for i in range(1, 4)]
    docs = spark.createDataFrame(clean + junk + [(2000, None, None, None)], SCHEMA)
    out = {r["doc_id"]: r["kept"] for r in quality.assess(docs).collect()}
    assert all(out[i] for i in range(200)) and not any(out[1000 + i] for i in range(1, 4)) and not out[2000]
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(200))


def test_empty(spark):
    assert quality.assess(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("v, want", [(0, 0), (255, 255), (257, 256), (1001, 1000), (123456, 123392)])
def test_buckets(spark, v, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(quality.bucket(F.lit(v).cast("long"))).first()[0] == want


def sentence(rng, letters, n=60):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(max(1, letters + rng.choice((-1, 0, 1))))) for _ in range(n))


def test_groups_have_fences_of_their_own(spark):
    rng = random.Random(8)
    plain = [(i, sentence(rng, 4), "en", "plain") for i in range(150)]
    code = [(1000 + i, sentence(rng, 9).replace(" ", " | ", 10 + i % 25), "en", "code") for i in range(150)]
    odd = sentence(rng, 9).replace(" ", " | ", 20)
    docs = spark.createDataFrame(plain + code + [(5000, odd, "en", "plain"), (5001, odd, "en", "code")], SCHEMA)
    fences = {r["source"]: r for r in quality.thresholds(quality.sketches(quality.features(docs), "lang", "source")).collect()}
    assert fences["code"]["symbol_rate"] > fences["plain"]["symbol_rate"] and fences["code"]["long_words"] > fences["plain"]["long_words"]
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(docs).collect()}
    assert not kept[5000] and kept[5001] and sum(kept.values()) >= 295


def by_hand_fences(rows):
    """Fences by exact counting over the bucketed measures of one group's texts."""
    out = {}
    kept = [x for x in (by_hand(t) for t in rows) if not x[5]]
    for rule, (measure, side, low, high, ranges, least) in quality.RULES.items():
        place = {"symbol_rate": 2, "repeat_rate": 4, "word_length": 1}.get(measure)
        if place is None:
            continue
        values = sorted(x[place] * (1000 if measure == "word_length" else 10000) // max(x[0], 1) for x in kept)
        values = [v >> max(v.bit_length() - 8, 0) << max(v.bit_length() - 8, 0) for v in values]
        at = {q: values[-(-len(values) * q // 100) - 1] for q in (low, high)}
        reach = ranges * max(at[high] - at[low], least)
        out[rule] = at[high] + reach if side == "upper" else at[low] - reach
    return out


def test_fences_follow_the_sketch(spark):
    rng = random.Random(9)
    texts = [sentence(rng, rng.choice((3, 5, 6)), rng.randint(5, 90)).replace(" ", " $ ", rng.choice((0, 0, 3, 9))) for _ in range(180)]
    docs = spark.createDataFrame([(i, t, "xx", None) for i, t in enumerate(texts)], SCHEMA)
    got = quality.thresholds(quality.sketches(quality.features(docs), "lang", "source")).first()
    want = by_hand_fences(texts)
    assert {k: got[k] for k in want} == want


def test_sketches_merge(spark):
    rng = random.Random(10)
    docs = spark.createDataFrame([(i, sentence(rng, 4 + i % 3), "en", f"s{i % 5}") for i in range(100)], SCHEMA)
    whole = quality.sketches(quality.features(docs), "lang", "source")
    halves = [quality.sketches(quality.features(docs.filter(f"doc_id % 2 = {k}")), "lang", "source") for k in (0, 1)]
    a, b = (sorted(map(str, quality.quantiles(x, ["lang"]).collect())) for x in (whole, halves[0].unionByName(halves[1])))
    assert a == b


def test_small_groups_use_their_language(spark):
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, sentence(rng, 4), "en", "large") for i in range(150)] + [(900 + i, sentence(rng, 12), "en", "tiny") for i in range(3)] + [(990, sentence(rng, 4), None, None)] * 2, SCHEMA)
    out = [(r["doc_id"], r["kept"]) for r in quality.assess(docs).collect()]
    assert sorted(i for i, k in out if not k) == [900, 901, 902] and out.count((990, True)) == 2


def test_against_sql(spark):
    con = duckdb.connect()
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
        got = quality.op8_quality_rules(spark, sf)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({quality.ORACLE['op8_quality_rules']})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and any(not r[-1] and not r[-2] for r in want)
