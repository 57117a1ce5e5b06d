"""The grammar of queries, places of words, analysers and stems."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions.analysis import PLAIN, STEMMED, Analyser
from lattica.functions.snowball import english
from lattica.operators import query as Q
from lattica.operators import search as T
from lattica.sources.index import COLUMN_PLACES, Index, placed

NOW = lambda: F.lit("2025-01-01").cast("timestamp")
EDGES = "src string, dst string, link_type string, inline boolean, position int"
# Words and stems from the page of the algorithm's author.
WORDS = """consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistent consist, consistently consist, consisting consist, consists consist, consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol, consoles consol, consolidate consolid, consolidated consolid, consolidating consolid, consoling consol, consolingly consol, consols consol, consonant conson, consort consort, consorted consort, consorting consort, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirator conspir, conspirators conspir, conspire conspir, conspired conspir, conspiring conspir, constable constabl, constables constabl, constance constanc, constancy constanc, constant constant, knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead, kneading knead, knee knee, kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell, knelt knelt, knew knew, knick knick, knif knif, knife knife, knight knight, knightly knight, knights knight, knit knit, knits knit, knitted knit, knitting knit, knives knive, knob knob, knobs knob, knock knock, knocked knock, knocker knocker, knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot"""


def test_english_stems():
    for pair in WORDS.split(", "):
        word, want = pair.split()
        assert english(word) == want, word
    odd = {"skies": "sky", "dying": "die", "news": "news", "generously": "generous", "hopping": "hop", "hoping": "hope", "succeed": "succeed", "at": "at", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "youth": "youth", "sayings": "say", "boy's": "boy", "relational": "relat", "happy": "happi", "by": "by", "ability": "abil", "agreed": "agre", "feed": "feed"}
    assert {w: english(w) for w in odd} == odd


words = lambda s: [w.lower() for w in s.split("_") if w]


def shown(node):
    if isinstance(node, Q.Phrase):
        return "^" * node.first + "+".join(node.terms) + "*" * node.prefix
    if isinstance(node, Q.Near):
        return f"N{node.within}({' '.join(map(shown, node.phrases))})"
    if isinstance(node, Q.Without):
        return f"({shown(node.keep)} - {shown(node.drop)})"
    return "(" + (" & " if isinstance(node, Q.Both) else " | ").join(map(shown, node.parts)) + ")"


@pytest.mark.parametrize("query, want", [
    ("a b", "(a & b)"), ("a OR b c", "(a | (b & c))"), ("a OR b AND c", "(a | (b & c))"), ("a NOT b c", "(a - (b & c))"), ("a AND b NOT c OR d", "((a & (b - c)) | d)"),
    ("a NOT b NOT c", "((a - b) - c)"), ("(a OR b) AND c", "((a | b) & c)"), ("((a))", "a"), ("a + b* OR ^c", "(a+b* | ^c)"), ("NEAR(a b, 3) c", "(N3(a b) & c)"), ("NEAR(a+b c)", "N10(a+b c)"),
    ("NEAR a", "(near & a)"), ('"a b" c-d', "(a & b & c & d)"), ("x_y z", "(x+y & z)"), ("or and not", "(or & and & not)"), ("_ a", "a"), ("NEAR(a, 2)", "a")])
def test_grammar(query, want):
    assert shown(Q.Parser(query, words).parse()) == want


@pytest.mark.parametrize("query", ["a (b)", "(a) b", "(a", "a)", "a OR", "NOT a", "a AND AND b", "a + ", "+ a", "a* + b", "NEAR(a b, c)", "NEAR(a b", "a @ b", "*", "a, b", "( )"])
def test_what_the_grammar_refuses(query):
    with pytest.raises(Q.QueryError):
        Q.Parser(query, words).parse()


def test_what_a_column_would_bind():
    lead = lambda q: shown((lambda p: (p.parse(), p.lead)[1])(Q.Parser(q, words)))
    assert [lead(q) for q in ("a b OR c", "(a OR b) NOT c", "NEAR(a b) c", "a+b NOT c")] == ["a", "(a | b)", "N10(a b)", "a+b"]
    assert Q.Parser(" - ", words).parse() is None


def test_near_against_all_choices(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        rows.append((i, *(sorted(rng.sample(range(40), rng.randint(1, 4))) for _ in range(3))))
    lengths, within = [1, 3, 2], 4
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>, c array<long>")
    got = {r["i"]: r["met"] for r in df.select("i", Q.near([F.col(c) for c in "abc"], lengths, within).alias("met")).collect()}
    for i, *places in rows:
        assert got[i] == any(all(max(pick) - s - n <= within for s, n in zip(pick, lengths, strict=True)) for pick in itertools.product(*places))
    assert 0 < sum(got.values()) < 300


def note(i, title, body, *tags):
    return (f"qp-{i}", title, body, "fleeting", list(tags), None)


def index_of(spark, path, rows, analyser=PLAIN):
    index = Index(spark, str(path), analyser)
    index.build(spark.createDataFrame(rows, "id string, title string, body string, type string, tags array<string>, updated timestamp"), spark.createDataFrame([], EDGES))
    return index


ROWS = [note(1, "The state of mind", "one two three four five", "x"), note(2, "Mind", "state of a mind and mind of state"), note(3, "five four", "three two one"), note(4, None, "", "state", "of", "mind"), note(5, "Running", "café society"), note(6, "He ran", "a run in the CAFE")]


def hits(index, query):
    return {h["id"].removeprefix("qp-") for h in T.search(index, query, NOW()).collect()}


def test_places(spark, tmp_path):
    index = index_of(spark, tmp_path / "i", ROWS)
    assert [hits(index, q) for q in ("state + of + mind", "state of mind", "NEAR(one four, 2)", "NEAR(one four, 1)", "NEAR(four one)", "^mind", "mind + of + st*", "the", "five + one")] == [{"1", "4"}, {"1", "2", "4"}, {"1"}, set(), {"1"}, {"2"}, {"2"}, {"1", "6"}, set()]
    assert hits(index, "(two OR cafe) NOT three") == {"6"} and hits(index, "two OR cafe NOT caf*") == {"1", "3"}
    row = index.table("postings").filter("term = 'mind' and note_id = 'qp-2'").first()
    assert row["places"] == [0, 2 * COLUMN_PLACES + 3, 2 * COLUMN_PLACES + 5] and row["length"] == 5  # stop words count in no length
    assert "the" not in {r["term"] for r in index.postings.collect()}
    assert index.statistics() == (6, pytest.approx((8 + 5 + 5 + 2 + 3 + 4) / 6))


def test_stems_and_marks(spark, tmp_path):
    index = index_of(spark, tmp_path / "i", ROWS, STEMMED)
    assert hits(index, "running") == hits(index, "runs") == {"5", "6"} and hits(index, "cafés") == {"5", "6"} and hits(index, "café + society") == {"5"}
    with pytest.raises(ValueError, match="rebuild"):
        Index(spark, str(tmp_path / "i"), PLAIN).statistics()
    with pytest.raises(ValueError, match="rebuild"):
        index_of(spark, tmp_path / "i", ROWS, Analyser("porter-folded", 2, "porter", True))
    plain = Index(spark, str(tmp_path / "i"), PLAIN)
    plain.rebuild(spark.createDataFrame(ROWS, "id string, title string, body string, type string, tags array<string>, updated timestamp"), spark.createDataFrame([], EDGES))
    assert hits(plain, "running") == {"5"} and hits(plain, "runs") == set()


def test_a_phrase_in_the_title_weighs_more(spark, tmp_path):
    index = index_of(spark, tmp_path / "i", [note(1, "deep sea", "fish"), note(2, "fish", "deep sea"), note(3, "sea deep", "fish"), *(note(10 + i, f"other {i}", "words here") for i in range(6))])
    assert [h["id"] for h in T.search(index, "deep + sea", NOW()).collect()] == ["qp-1", "qp-2"]
    assert [h["id"] for h in T.search(index, "fish", NOW()).collect()][0] == "qp-2"
    twice = T.search(index, "fish fish", NOW()).collect()
    assert twice[0]["relevance"] > T.search(index, "fish", NOW()).collect()[0]["relevance"]


def test_words_are_grouped_where_they_stand(spark):
    """No shuffle or sort of texts or words; rows that repeat an id are brought together."""
    schema = "id string, title string, tags array<string>, body string, updated timestamp"
    one = spark.createDataFrame([("a", "The tale", ["x"], "tale of tales\nÉque", None), ("b", None, None, None, None)], schema)
    plan = placed(one)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Aggregate" not in plan
    got = {(r["note_id"], r["term"]): (r["title"], r["body"], r["places"], r["length"]) for r in placed(one).collect()}
    assert got["a", "tale"] == (1, 1, [1, (2 << 32)], 5) and got["a", "the"] == (1, 0, [0], 5) and len(got) == 6
    twice = one.unionByName(spark.createDataFrame([("a", "tale", ["x"], "of", None)], schema))
    got = {r["term"]: (r["title"], r["places"], r["length"]) for r in placed(twice).collect()}
    assert got["tale"] == (2, [0, 1, 2 << 32], 7) and got["x"] == (0, [1 << 32, 1 << 32], 7)
