import hashlib
import math
import random
import re
from collections import Counter

import regex

from lattica.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in value.split(".")) or kind == "phone" and 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def texts():
    rng = random.Random(3)
    alphabets = ["a@.-b_ %1é", "12345. -+()", "0123456789 -.", "+1 ()-.2345678", "ab@c.d@e-f_g", "255.1 4"]
    out = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    out += ["1 " * 20000, "a.b@" * 2000 + "x", "1.1.1.1 " * 2000, None, "4111 1111 1111 1111 " * 300 + "+1 (408) 555-1234 " * 300, "a" * 200_000 + "@", "4111-1111-1111-1111 x 0000255.1.1.1 256.1.1.1"]
    return out


def test_base_against_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, base int")
    got = {r["doc_id"]: [tuple(x) for x in r["base"]] for r in pii.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert pii.scan(docs.limit(0)).count() == 0


def test_disclosing_terms(spark):
    mail = "jo@corp.example"
    rows = [(i, f"number {i} says zanzibar treaty to {mail} about weather today") for i in range(4)]
    rows += [(10 + i, f"the weather today is {w}") for i, w in enumerate("fine bad odd wet dry hot cold mild".split())]
    rows += [(30, rows[0][1]), (31, "other@corp.example likes solitude"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.scan(docs).collect()}
    text = dict(rows)
    for i in (0, 3, 30):
        found = {text[i][x["s"] : x["e"]] for x in out[i]["terms"]}
        assert {"zanzibar", "treaty"} <= found and not {"weather", "today"} & found
    assert not out[10]["terms"] and not out[31]["terms"] and not out[None]["terms"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert "zanzibar" not in clean[0] and "[EMAIL]" in clean[0] and "weather today" in clean[0]
    assert clean[10] == text[10] and clean[31] == "[EMAIL] likes solitude" and clean[None] is None


def test_support_counts_texts_not_copies(spark):
    rows = [(i, "zanzibar writes jo@corp.example now") for i in range(9)] + [(20 + i, f"plain text {i}") for i in range(9)]
    assert all(not r["terms"] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_rare_entities_far_terms_and_short_names(spark):
    # five addresses of one text each; the name stands far from them, twice, and once without any address
    far = "plain words go on " * 30
    rows = [(i, f"a{i}@corp.example wrote. {far} here Li said no. {far} and Li again, entry {i}") for i in range(5)]
    rows += [(10, "a note by Li, sent alone")] + [(20 + i, f"{far} here said no and again, entry wrote {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text, out = dict(rows), {r["doc_id"]: r["terms"] for r in pii.scan(docs).collect()}
    for i in range(5):
        assert [text[i][x["s"] : x["e"]] for x in out[i]] == ["Li", "Li"]
    assert [(text[10][x["s"] : x["e"]], x["removed"]) for x in out[10]] == [("Li", False)]
    assert not any(out[20 + i] for i in range(60))
    assert "Li" not in "".join(r["text"] for r in pii.sanitised(docs).collect())


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in pii.op3_pii(spark, "/root/testdata/sf0.001").collect():
        base = brute(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(b[0] == k for b in base) for k in PATTERNS]


def brute_terms(rows, alpha=pii.ALPHA):
    """Telling terms with how each is treated, counted in plain Python; rows: (id, text)."""
    texts = [t or "" for _, t in rows]
    mail = re.compile(PATTERNS["email"])
    terms = lambda t: {x.lower() for x in regex.findall(r"\p{L}+", mail.sub(lambda m: "0" * len(m[0]), t))}
    total, n_t = len(texts), Counter(x for t in texts for x in terms(t))
    named = {t: {f"{k}:{t[s:e].lower()}" for k, s, e in brute(t)} for t in set(texts)}
    seen = Counter(e for es in named.values() for e in es)
    keys = {t: {e if seen[e] >= pii.SUPPORT else e.split(":")[0] for e in es} for t, es in named.items()}
    n_e = Counter(k for t in texts for k in keys[t])
    support, n_te = Counter((k, x) for t in named for k in keys[t] for x in terms(t)), Counter((k, x) for t in texts for k in keys[t] for x in terms(t))
    n_te = {p: n for p, n in n_te.items() if support[p] >= pii.SUPPORT}
    pmi = lambda both, of, k: math.log(total * both / (of * n_e[k]))
    ic = lambda k: math.log(total / n_e[k])
    told = {}
    for (k, x), n in n_te.items():
        if ic(k) > 0 and pmi(n, n_t[x], k) >= alpha * ic(k):
            told.setdefault(x, []).append(k)
    out = {}
    for x, ks in told.items():
        fine = [x[:i] for i in range(1, len(x)) if all(pmi(sum(n for (k2, y), n in n_te.items() if k2 == k and y.startswith(x[:i])), sum(n for y, n in n_t.items() if y.startswith(x[:i])), k) < alpha * ic(k) for k in ks)]
        removed = any(pmi(n_te[k, x], n_t[x], k) >= ic(k) - 1e-9 for k in ks)
        out[x] = (removed, None if removed else max(fine, key=len, default=""))
    return out


def test_terms_by_brute_force(spark):
    kinds = set()
    for seed in (21, 22):
        rng = random.Random(seed)
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(90)})
        rng.shuffle(words)
        common, rare = words[:50], words[50:]
        people = [(f"p{i}@x.example", rng.sample(rare, 3)) for i in range(5)] + [(f"+1 555 000 000{i}", rng.sample(rare, 2)) for i in range(3)]
        rows = []
        for i in range(160):
            text = rng.sample(common, 6) + [w for w in rare if rng.random() < 0.003]
            for name, own in people:
                if rng.random() < 0.06:
                    text += [name, *[w for w in own if rng.random() < 0.97]]
            rows.append((i, " , ".join(text)))
        rows += [rows[5], (900, None), (901, "")]
        docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_terms(rows)
        for r in pii.scan(docs).collect():
            text = dict(rows)[r["doc_id"]] or ""
            got = [(x["s"], x["e"], x["removed"], None if x["removed"] else x["general"]) for x in r["terms"]]
            hidden = re.sub(PATTERNS["email"], lambda m: "0" * len(m[0]), text)
            assert got == [(m.start(), m.end(), *want[m[0].lower()]) for m in regex.finditer(r"\p{L}+", hidden) if m[0].lower() in want]
        kinds |= {(removed, general is not None and len(general) > 0) for removed, general in want.values()}
    assert kinds >= {(True, False), (False, True)}


def test_general_terms_stand_for_many(spark):
    far = "some words that go on and on"
    rows = [(i, f"a{i}@corp.example of smithson {far} {i}") for i in range(5)] + [(9, f"smithson again {far}")]
    rows += [(20 + i, f"{far} of {['smithers', 'smithy', 'smithfield'][i % 3]} {i}") for i in range(60)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0] == f"[EMAIL] of smith* {far} 0"
    assert clean[9].startswith("smith") and "smithson" not in clean[9] and clean[20] == dict(rows)[20]


def test_long_runs_of_letters(spark):
    far, long = "plain words go on", "smith" + "xyzzy" * 200
    rows = [(i, f"a{i}@corp.example of {long} and smithson {far} {i}") for i in range(6)]
    rows += [(20 + i, f"{far} of {['smithers', 'smithy', 'smithfield'][i % 3]} {i}") for i in range(80)]
    rows += [(200, "smithson " + "q" * 200_000), (201, "s" * 1_000_000), (202, "mith" * 250_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text, found = dict(rows), {r["doc_id"]: r["terms"] for r in pii.scan(docs).collect()}
    for i in range(6):
        got = {text[i][x["s"] : x["e"]]: (x["removed"], x["general"]) for x in found[i]}
        assert got[long][0] and not got["smithson"][0] and got["smithson"][1] == "smith"
    assert [text[200][x["s"] : x["e"]] for x in found[200]] == ["smithson"] and not found[201] and not found[202]
