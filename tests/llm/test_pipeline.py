import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from lattica.llm import secrets

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


def repeated(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    return len(words), len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)})


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], SF).write.parquet(str(tmp_path / str(i)))
        steps.append(spark.read.parquet(str(tmp_path / str(i))))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and all(s.columns == columns for s in steps[:-1])
    start, good, single, clean, drawn, tokens = (s.collect() for s in steps)
    failed = {r["doc_id"] for r in start for n, k in [repeated(r["text"])] if n < 10 or 100 * k > 20 * n}
    assert not failed & {r["doc_id"] for r in good} and len(good) >= 0.75 * len(start)
    sets = {r["doc_id"]: frozenset(zip(*(r["text"].split()[k:] for k in range(5)), strict=False)) for r in good}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    stays = {r["doc_id"] for r in single}
    for a in sets:
        assert (a in stays) != any(near(a, b) and b < a for b in sets if b != a)
    before = {r["doc_id"]: r["text"] for r in single}
    for r in clean:
        base = secrets.base_spans(before[r["doc_id"]])
        spans = sorted(base + secrets.linked_spans(before[r["doc_id"]], base), key=lambda s: (s[0], secrets.KINDS.index(s[2]), s[1]))
        assert r["text"] == secrets.redacted(before[r["doc_id"]], spans) and r["n_chars"] == len(r["text"])
    assert len(clean) == len(single) and 0 < len(drawn) < len(clean)
    library = tokenizers.Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    text = {r["doc_id"]: r["text"] for r in drawn}
    assert {r["doc_id"] for r in tokens} == set(text)
    for r in tokens:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["token_ids"] == b"".join(i.to_bytes(4, "little") for i in ids)
    assert corpus_pipeline.run(spark, SF).count() == len(tokens)


def test_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and columns with the names that the stages use."""
    words, rng = [f"word{i}" for i in range(900)], random.Random(4)
    text = lambda k: " ".join(words[(k * 7 + i * i) % 900] for i in range(60))
    rows = [(i, text(i), "en", "s", 5, 0.5, "x") for i in range(40)] + [(41, None, None, None, None, None, None), (42, "", "en", "s", 0, 0.5, "x"), (None, text(50), None, "s", 1, 0.5, "x"), (3, text(3), "en", "s", 5, 0.5, "x"), (43, text(3), "en", "s", 5, 0.5, "x"), (44, " ".join(rng.choice(words) for _ in range(60_000)), "en", "s", 9, 0.5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, weight double, key string")
    steps = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], SF).write.parquet(str(tmp_path / str(i)))
        steps.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(s.columns == docs.columns for s in steps[:-1])
    good, single, clean, drawn, tokens = ([r["doc_id"] for r in s.collect()] for s in steps[1:])
    assert {41, 42}.isdisjoint(good) and good.count(3) == 2 and {None, 44} <= set(good)
    assert single.count(3) == 1 and 43 not in single and sorted(single, key=repr) == sorted(clean, key=repr)
    assert set(tokens) == set(drawn) <= set(clean)


def test_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
