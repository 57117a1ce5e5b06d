import random
import zlib

import numpy as np

from lattica.llm import langid

WORDS = {"aa": ["bala", "tamo", "sulo", "baro", "mala"], "bb": ["xekki", "wexxi", "kewwek", "xikke"], "ru": ["мир", "дом", "река", "лес"]}


def docs(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def slow_viterbi(s, penalty):
    best = s[0].copy()
    ways = [[k] for k in range(s.shape[1])]
    for row in s[1:]:
        step = [max(range(len(best)), key=lambda j, k=k: best[j] - penalty * (j != k)) for k in range(len(best))]
        ways = [ways[j] + [k] for k, j in enumerate(step)]
        best = np.array([best[j] - penalty * (j != k) + row[k] for k, j in enumerate(step)])
    return best.max()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for n in [1, 2, 5, 30] * 25:
        s = -rng.random((n, 3)) * rng.choice([0.5, 6])
        path = langid.viterbi(s, 2.0)
        value = s[np.arange(n), path].sum() - 2.0 * (path[1:] != path[:-1]).sum()
        assert abs(value - slow_viterbi(s, 2.0)) < 1e-9


def test_accuracy_and_edges(spark):
    rows = docs()
    df = spark.createDataFrame([(*r, "s", 0.1) for r in rows], "doc_id long, text string, lang string, source string, score double")
    model = langid.fit(df)
    assert model.langs == ["aa", "bb", "ru"] and model.scripts["Cyrillic"] == [2]
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i] == lang for i, lang in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None), (2, "12 34 !"), (3, ""), (3, ""), (None, "bala tamo " * 30000)], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd, model).collect()]
    assert sorted(got, key=repr) == sorted([(1, "und"), (2, "und"), (3, "und"), (3, "und"), (None, "aa")], key=repr)
    mixed = spark.createDataFrame([(1, "bala tamo sulo baro mala " * 4 + "xekki wexxi kewwek " * 5)], "doc_id long, text string")
    spans = langid.identify(mixed, model).first()["spans"]
    assert [x.split(":")[2] for x in spans.split(",")] == ["aa", "bb"] and spans.startswith("0:100:aa,100:")
    nothing = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(mixed, nothing).collect()} == {"und"}


def test_batch_that_ends_with_a_whole_group(spark, monkeypatch):
    """The last text of a batch fills a group, so that none is left to predict."""
    df = spark.createDataFrame([(i, "bala tamo", "aa") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert langid.Tagger(model).predict([], True) == []
    monkeypatch.setattr(langid, "TOGETHER", 8)
    assert {r["lang_pred"] for r in langid.identify(df, model).collect()} == {"aa"}


def test_held_out_labels_teach_nothing(spark):
    rows = [(i, "bala tamo", "aa" if zlib.crc32(str(i).encode()) % 5 else "zz") for i in range(100)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["aa"]


def test_every_language_is_learned(spark):
    rng = random.Random(5)
    own = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(6)] for k in range(70)}
    rows = [(i * 100 + k, " ".join(rng.choice(words) for _ in range(12)), lang) for k, (lang, words) in enumerate(own.items()) for i in range(20 - k // 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.langs == sorted(own)
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len({lang for _, lang in held}) > 50 and all(out[i] == lang for i, lang in held)


def test_texts_without_a_switch_are_known_without_the_path():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(1, 25, 12)
        scores = -rng.random((sizes.sum(), 4)) * rng.choice([0.3, 2, 5])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        best, sure = langid.unmixed(scores, starts, 4.0)
        for i in range(len(sizes)):
            own = scores[starts[i] : starts[i + 1]]
            assert best[i] == own.sum(0).argmax()
            if sure[i]:
                assert abs(own[:, best[i]].sum() - slow_viterbi(own, 4.0)) < 1e-9
    alike = np.zeros((6, 2))
    alike[:, 1] = -1
    assert langid.unmixed(alike, np.array([0, 1, 6]))[1].all()


def test_scores_are_those_of_single_tokens():
    model = langid.Model([(lang, w, 3) for lang, words in WORDS.items() for w in words])
    tokens = ["bala", "xekki", "a", "мир", "l'x-bala", "zzzz", "bala2wexxi"]
    together = model.scores(tokens)
    assert np.allclose(together, np.concatenate([model.scores([t]) for t in tokens]))
    for t, row in zip(tokens, together, strict=True):
        raw = np.zeros(3)
        for part in langid.LETTERS.findall(t):
            known = {tuple(map(ord, g)): i for i, g in enumerate(sorted({g for words in WORDS.values() for w in words for g in langid.grams(w)}, key=lambda g: tuple(map(ord, g))))}
            raw += sum((model.weights[known[tuple(map(ord, g))]] for g in langid.grams(part) if tuple(map(ord, g)) in known), np.zeros(3))
            raw += model.weights[model.words[part]] if part in model.words else 0
        s = langid.script(langid.LETTERS.search(t)[0][0])
        raw += [4 * langid.FLOOR * (s in model.scripts and i not in model.scripts[s]) for i in range(3)]
        want = np.maximum(raw - raw.max() - np.log(np.exp(raw - raw.max()).sum()), langid.FLOOR)
        assert np.allclose(row, want)


def test_the_query_on_whole_tables(spark, tmp_path):
    rows = [(i, t, lang, "s", len(t)) for i, t, lang in docs(500, 4)] + [(1000, None, None, None, 0), (1001, "", "aa", "s", 0), (1002, "12 <> 7", None, "s", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.op9_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) >= {"doc_id", "held_out", "lang_pred", "score"}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(i, lang) for i, _, lang, _, _ in rows[:500] if got[i]["held_out"]]
    assert len(held) > 60 and sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.95 * len(held)
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert langid.op9_language_id(spark, f"{tmp_path}/none").collect() == []


def test_columns_with_the_names_of_outputs_play_no_part(spark):
    df = spark.createDataFrame([(i, "bala tamo sulo", "aa", 7, "x", "y") for i in range(20)], "doc_id long, text string, lang string, score int, spans string, lang_pred string")
    out = langid.identify(df, langid.fit(df), keep=("doc_id", "score", "lang_pred", "spans"))
    assert out.columns == ["doc_id", "lang_pred", "score", "spans"] and {r["lang_pred"] for r in out.collect()} == {"aa"}
