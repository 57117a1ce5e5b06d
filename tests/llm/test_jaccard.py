import random

import pytest

from lattica.llm import jaccard


def brute(rows):
    """class, links and copies of each (id, text)."""
    sets = {}
    for _, t in rows:
        w = (t or "").split()
        sets[t or ""] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    texts = list(sets)
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sets[a]
    links = {t: [u for u in texts if u != t and near(t, u)] for t in texts}
    group = {}
    for t in texts:
        seen, todo = {t}, [t]
        while todo:
            for u in links[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        group[t] = seen
    least = lambda ts: min((i for i, t in rows if (t or "") in ts and i is not None), default=None)
    return sorted(((i, least({t or ""}), least(group[t or ""]), len(links[t or ""]), sum((u or "") == (t or "") for _, u in rows)) for i, t in rows), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 6, 30, 120]))]
        for _ in range(rng.choice([1, 4, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    shared = " ".join(rng.choice(words) for _ in range(40))
    for _ in range(10):
        rows.append((n, shared + " " + " ".join(rng.choice(words) for _ in range(60))))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "two words"), (n + 3, "two  words"), (None, rows[0][1]), (None, "all alone here it is now"), (0, rows[0][1])]


@pytest.mark.parametrize("block", [1024, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, rep_id int")
    got = sorted(map(tuple, jaccard.join(docs).collect()), key=repr)
    # equal shingle sets of different texts count as links
    assert got == brute(rows)


def test_one_of_each(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars int")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = {r[2] for r in brute(rows)}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(classes, key=repr)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_pruning_bound():
    assert jaccard.least_equal(16) < 0.8 * 16 and jaccard.least_equal(64) > 20


def test_the_query_on_whole_tables(spark, tmp_path):
    rows = corpus(11) + [(900 + i, "one text that a third of all rows have, word by word") for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, "en", "s", 0) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, jaccard.op5_jaccard_join(spark, str(tmp_path)).collect()), key=repr) == brute(rows)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert jaccard.op5_jaccard_join(spark, f"{tmp_path}/none").collect() == []


def test_very_long_texts(spark):
    rng = random.Random(12)
    long = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    other = list(long)
    for _ in range(300):
        other[rng.randrange(len(other))] = "odd"
    far = list(long)
    for _ in range(900):
        far[rng.randrange(len(far))] = "far"
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(far)), (4, " ".join(long[:2000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(docs).collect()), key=repr) == brute(rows)
    assert [r["doc_id"] for r in jaccard.one_of_each(docs).orderBy("doc_id").collect()] == [1, *([3] if len(brute(rows)) and brute(rows)[2][2] == 3 else []), 4]
