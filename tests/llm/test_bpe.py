import hashlib
import json
import random

import pytest

from lattica.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = str(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.Automaton(PATH))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def same(codec, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    made = codec.encode(text)
    assert [int.from_bytes(made[i : i + 4], "little") for i in range(0, len(made), 4)] == ids
    assert codec.decode(made) == library.decode(ids, skip_special_tokens=False)


def test_random_texts(codec, library):
    rng = random.Random(5)
    letters = ["abcdefghij klmnop  \n\t'sd’é日0123,.;!?  \x1c\x85 the", "abt hien", " \n", "aA'lv e"]
    for n in range(3000):
        same(codec, library, "".join(rng.choice(letters[n % 4]) for _ in range(rng.randint(0, 50))))
    for _ in range(500):
        same(codec, library, "".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(20)))


def test_odd_texts(codec, library):
    for text in ("", " ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "a" * 3000, " " * 2000, "ab" * 2000, "0" * 3000, "\n" * 999 + "x"):
        same(codec, library, text)


def test_small_tables_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_STATES", 20)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    tool = bpe.Codec(bpe.Automaton(PATH))
    for text in ("there were no signs of it anywhere", "antidisestablishmentarianism" * 20):
        same(tool, library, text)


def test_frames(spark, library):
    docs = spark.createDataFrame([(1, "a word", 9), (1, "a word", 9), (None, None, 9), (2, "", 9)], "doc_id long, text string, n_tokens int")
    out = bpe.encode(docs, PATH, keep=["doc_id", "n_tokens"], outputs=("n_tokens", "token_ids", "ids_sha256", "decoded_sha256"))
    got = sorted(map(tuple, out.select("doc_id", "n_tokens", "ids_sha256").collect()), key=repr)
    ids = b"".join(i.to_bytes(4, "little") for i in library.encode("a word", add_special_tokens=False).ids)
    nothing = hashlib.sha256(b"").hexdigest()
    assert got == sorted([(1, 2, hashlib.sha256(ids).hexdigest())] * 2 + [(None, 0, nothing), (2, 0, nothing)], key=repr)
    assert [r["decoded"] for r in bpe.decode(out, PATH).filter("doc_id = 1").collect()] == ["a word"] * 2
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_texts_together(codec, library):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéhinorst'日1") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) + rng.choice(["", "\n\n", "<|endoftext|>", " <|endoftext|> x", "  "]) for _ in range(400)] + ["x" * 500 + " and then " + "ab" * 900, "", "a " * 20_000]
    made = codec.encode_all(texts)
    for text, ids in zip(texts, made, strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)


def test_other_settings_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}, {"model": spec["model"] | {"type": "Unigram"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="no reading"):
            bpe.Automaton(str(tmp_path / "v.json"))


def test_the_query_on_whole_tables(spark, library, tmp_path):
    rng = random.Random(8)
    texts = [None, "", "the same text", "the same text", "".join(rng.choice("abc d,é\n") for _ in range(60_000)), "z" * 20_000, "<|endoftext|> 12  3"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i if i != 3 else 2, t, "en", "s", 0) for i, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op7_bpe_codec(spark, str(tmp_path)).collect())
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i != 3 else 2, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert bpe.op7_bpe_codec(spark, f"{tmp_path}/none").collect() == []


def test_states_are_small(codec):
    """States of the byte table are held as bytes, so that twice as many take no more room than tuples did."""
    rng = random.Random(8)
    codec.encode_all([" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 12))) for _ in range(3000))])
    states = codec.automaton._live
    assert len(states) > 1000 and all(isinstance(s, bytes) for s in states)
    assert sum(map(len, states)) / len(states) < 100
