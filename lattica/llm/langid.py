"""Language identification of mixed-language texts.

Each word's script, by ranges of code points, narrows the languages that it may belong to; a word of these gets the log
posterior of its letter n-grams under each. Viterbi's algorithm over the words, with a penalty for each switch, labels
spans; the label with the most letters is the document's language.

The model is fitted on a bounded sample: about SAMPLE documents of every language, drawn by a hash of the id, of which the
WORDS most frequent words of each language count. Beyond DENSE languages there are fewer words a language, since the tables
have a column for each language and grow with its square otherwise. They go to the executors once.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, table, words_of, written

SAMPLE, DENSE, WORDS, LEAST_WORDS = 1200, 50, 40_000, 100
GRAM = 3
PENALTY, FLOOR = 8.0, -5.0
#: Texts labelled together hold about so many characters; tokens that are kept, and scored at once, times languages.
TOGETHER = 1 << 20
CACHE_TOKENS, SCORED = 200_000, 5_000_000
#: Fixed ranges of scripts.
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x77F), ("Devanagari", 0x900, 0x97F),
    ("Bengali", 0x980, 0x9FF), ("Tamil", 0xB80, 0xBFF), ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]
LETTERS = regex.compile(r"\p{L}+")


def script(letter: str) -> str:
    c = ord(letter)
    return next((name for name, lo, hi in SCRIPTS if lo <= c <= hi), "Other")


def grams(word: str) -> list[str]:
    """Letter n-grams of a word with its ends marked."""
    padded = f"^{word}$"
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


def _keys(points: np.ndarray) -> np.ndarray:
    """A number for each n-gram of a row of code points, which have 21 bits."""
    n = max(len(points) - GRAM + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = out << np.uint64(21) | points[i : i + n]
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Model:
    """Log weights of letter n-grams and whole words by language, and the scripts that each language is written in."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        number = {lang: i for i, lang in enumerate(self.langs)}
        k = max(len(self.langs), 1)
        seen: dict[str, list[int]] = defaultdict(lambda: [0] * k)
        whole: dict[str, list[int]] = defaultdict(lambda: [0] * k)
        letters: dict[str, list[int]] = defaultdict(lambda: [0] * k)
        for lang, word, n in counts:
            i = number[lang]
            letters[script(word[0])][i] += n
            whole[word][i] += n
            for g in grams(word):
                seen[g][i] += n
        pieces = sorted((g for g, c in seen.items() if sum(c) > 1), key=lambda g: tuple(map(ord, g)))
        names = [w for w, c in whole.items() if sum(c) > 1]
        self.keys = np.concatenate([np.empty(0, np.uint64), *(_keys(_points(g)) for g in pieces)])
        self.words = {w: len(pieces) + i for i, w in enumerate(names)}
        table = np.array([seen[g] for g in pieces] + [whole[w] for w in names], np.float64).reshape(-1, k) + 0.5
        weights = np.log(table / table.sum(0))
        # an n-gram says how much more a language uses it than all of them do; the last row is for what isn't known
        weights -= np.log((table / table.sum(0)).mean(1, keepdims=True))
        self.weights = np.concatenate([weights, np.zeros((1, k))])
        written = np.array([sum(c[i] for c in letters.values()) for i in range(k)], np.float64)
        self.scripts = {s: [i for i in range(k) if c[i] > 0.01 * max(written[i], 1)] for s, c in letters.items()}

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Log posterior of each language (columns) for tokens that have letters."""
        parts = [[t] if t.isalpha() else LETTERS.findall(t) for t in tokens]
        flat = [p for own in parts for p in own]
        of = np.repeat(np.arange(len(tokens)), [len(own) for own in parts])  # the token of each part
        points = _points("".join(f"^{p}$" for p in flat))
        keys = _keys(points)
        n = len(keys)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        # n-grams across the ends of parts don't count
        inner = points[1 : n + 1]
        known = (self.keys[at] == keys if len(self.keys) else np.zeros(n, bool)) & (points[:n] != ord("$")) & (inner != ord("$")) & (inner != ord("^"))
        lengths = np.array([len(p) + 2 for p in flat], np.int64)
        owner = np.repeat(of, lengths)[:n]
        rows, to = at[known], owner[known]
        get, unknown = self.words.get, len(self.weights) - 1
        rows = np.concatenate([rows, np.array([get(p, unknown) for p in flat], np.int64)])
        to = np.concatenate([to, of])
        raw = np.stack([np.bincount(to, self.weights[rows, i], len(tokens)) for i in range(self.weights.shape[1])], axis=1)
        first = [script(own[0][0]) for own in parts]
        for s in set(first) & set(self.scripts):
            barred = [i for i in range(len(self.langs)) if i not in self.scripts[s]]
            if barred and len(barred) < len(self.langs):
                raw[np.ix_([i for i, x in enumerate(first) if x == s], barred)] += 4 * FLOOR
        raw -= raw.max(1, keepdims=True)
        return np.maximum(raw - np.log(np.exp(raw).sum(1, keepdims=True)), FLOOR)


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best labelling of words (rows) by languages (columns), with a penalty for each switch."""
    n, k = scores.shape
    rows = scores.tolist()
    now, back = rows[0], []
    for row in rows[1:]:
        top = max(range(k), key=now.__getitem__)
        most = now[top] - penalty
        come = [i if v >= most else top for i, v in enumerate(now)]
        now = [(v if v >= most else most) + s for v, s in zip(now, row, strict=True)]
        back.append(come)
    at = max(range(k), key=now.__getitem__)
    out = np.empty(n, np.int32)
    out[n - 1] = at
    for i in range(n - 2, -1, -1):
        at = back[i][at]
        out[i] = at
    return out


def unmixed(scores: np.ndarray, starts: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose words' scores stand one below the other, text i from starts[i] to starts[i + 1]: the language that is best in all, and whether no labelling with a switch can beat it.

    Let a stretch's gain be by how much another language beats that one over it. Of a labelling with m switches, the first
    and the last stretch are ends of the text and at most m - 1 stretches lie between. So if ends gain at most the penalty
    together, and every stretch at most the penalty, the switches cost more than they bring. All texts are looked at in one
    pass: sums run on over them, each shifted below the last, so that running minima begin anew.
    """
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    best = np.add.reduceat(scores, starts[:-1], axis=0).argmax(1)
    gain = np.cumsum(scores - scores[np.arange(len(scores)), best[of]][:, None], axis=0)
    before = np.concatenate([np.zeros((1, gain.shape[1])), gain])
    own = gain - before[starts[:-1]][of]  # sums from the text's first word on
    deep = np.abs(gain).max() * 2 + 1
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, gain.shape[1])), own - deep * (of + 1)[:, None]]), axis=0)[:-1] + deep * (of + 1)[:, None]
    stretch = own - np.minimum(low, 0.0)
    head = np.maximum.reduceat(own, starts[:-1], axis=0).max(1)
    total = own[starts[1:] - 1]
    tail = (total - np.minimum(np.minimum.reduceat(own, starts[:-1], axis=0), 0.0)).max(1)
    inner = np.maximum.reduceat(stretch, starts[:-1], axis=0).max(1)
    return best, (np.maximum(head, 0) + np.maximum(tail, 0) <= penalty) & (inner <= penalty)


class _Rows(dict):
    """Row numbers of tokens; a new token gets the next one."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = row = len(self)
        self.new.append(token)
        return row


class Tagger:
    """A model with a bounded table of tokens that it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.rows = _Rows()
        self.scores = np.zeros((4096, max(len(self.model.langs), 1)))
        self.letters = np.zeros(4096, np.int64)

    def _add(self) -> None:
        """Scores and letters of new tokens; those without a letter have none."""
        tokens, self.rows.new = self.rows.new, []
        if (size := len(self.rows)) > len(self.letters):
            more = max(size, 2 * len(self.letters)) - len(self.letters)
            self.scores, self.letters = np.concatenate([self.scores, np.zeros((more, self.scores.shape[1]))]), np.concatenate([self.letters, np.zeros(more, np.int64)])
        start = size - len(tokens)
        kept = [(start + i, t) for i, t in enumerate(tokens) if t.isalpha() or LETTERS.search(t)]
        step = max(SCORED // len(self.model.langs), 1)
        for at in range(0, len(kept), step):
            part = kept[at : at + step]
            rows = np.array([i for i, _ in part], np.int64)
            self.scores[rows] = self.model.scores([t.lower() for _, t in part])
            self.letters[rows] = [len(t) if t.isalpha() else sum(map(str.isalpha, t)) for _, t in part]

    def predict(self, texts: list[str | None], spans: bool) -> list[tuple[str, float, str]]:
        """For each text its language, the share of letters labelled with it, and spans start:end:language in code points."""
        out: list[tuple[str, float, str]] = [("und", 0.0, "")] * len(texts)
        if not self.model.langs:
            return out
        if len(self.rows) > scaled(CACHE_TOKENS, len(self.model.langs)):
            self._clear()
        split = [words_of(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        every = np.fromiter(map(self.rows.__getitem__, (w for words in split for w in words)), np.int64, int(sizes.sum()))
        if self.rows.new:
            self._add()
        known = self.letters[every] > 0
        ends = np.cumsum(sizes)
        have = np.concatenate([[0], np.cumsum(known)])
        counts = have[ends] - have[ends - sizes]
        live = np.nonzero(counts)[0]
        if not len(live):
            return out
        at = every[known]
        starts = np.concatenate([[0], np.cumsum(counts[live])])
        scores, letters = self.scores[at], self.letters[at]
        best, sure = unmixed(scores, starts)
        for place, i in enumerate(live):
            if sure[place]:
                lang = self.model.langs[best[place]]
                out[i] = (lang, 1.0, f"0:{len(texts[i])}:{lang}" if spans else "")
                continue
            low, high = starts[place], starts[place + 1]
            labels = viterbi(scores[low:high])
            share = np.bincount(labels, letters[low:high], len(self.model.langs))
            top = int(share.argmax())
            out[i] = (self.model.langs[top], float(share[top] / share.sum()), self._spans(texts[i], split[i], known[ends[i] - sizes[i] : ends[i]], labels) if spans else "")
        return out

    def _spans(self, text: str, words: list[str], known: np.ndarray, labels: np.ndarray) -> str:
        """Spans of one label each; a word without a letter belongs to the word before it, at the start of a text to the first with one."""
        if (labels == labels[0]).all():
            return f"0:{len(text)}:{self.model.langs[labels[0]]}"
        turns = np.nonzero(np.diff(labels))[0] + 1  # the first words, among those with a letter, of further spans
        numbers = np.nonzero(known)[0][turns].tolist()
        out, place, start, now, at = [], 0, 0, int(labels[0]), 0
        for turn, number in zip(turns.tolist(), numbers, strict=True):
            for w in words[at:number]:
                place = text.index(w, place) + len(w)
            place, at = text.index(words[number], place), number
            out.append(f"{start}:{place}:{self.model.langs[now]}")
            start, now = place, int(labels[turn])
        return ",".join([*out, f"{start}:{len(text)}:{self.model.langs[now]}"])


def scaled(n: int, languages: int, power: int = 1) -> int:
    """n, and less of it beyond DENSE languages."""
    return int(n * min(1.0, DENSE / max(languages, 1)) ** power)


def held_out(doc_id: Column) -> Column:
    """Whether a document may not be learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model of the labelled documents that aren't held out; without any it has no language."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = own.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = written(own.groupBy("lang").agg(F.count("*").alias("of")), "langid-sizes")
    if not (languages := sizes.count()):
        return Model([])
    part = F.least(F.lit(1 << 20).cast("long"), F.ceil(F.lit(float(SAMPLE * (1 << 20))) / F.col("of")))
    drawn = own.join(sizes, "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < part)
    words = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).filter(F.char_length("word") <= 40)
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    most = max(scaled(WORDS, languages, 2), LEAST_WORDS)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    rows = [tuple(r) for r in counts.withColumn("place", place).filter(F.col("place") <= most).select("lang", "word", "n").collect()]
    return Model(rows)


_taggers: dict[int, Tagger] = {}


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: bool = True) -> DataFrame:
    """lang_pred, score and spans of every whole text.

    A null text and one without a letter (or a model without a language) give und with score 0 and no spans. Repeated
    rows get the same; an empty table gives an empty one; columns outside keep, whatever their names, play no part. One
    pass, no shuffle.
    """
    kept = [c for c in keep if c not in ("lang_pred", "score", "spans")]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = source.select(*(F.col(f"`{c}`") for c in kept)).schema.add("lang_pred", "string").add("score", "double").add("spans", "string")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = id(shared)

    def step(cols: dict, rows: int) -> dict:
        if mark not in _taggers:
            _taggers.clear()
            _taggers[mark] = Tagger(shared.value)
        tool = _taggers[mark]
        found, held, size = [], [], 0
        for x in cols["__text"]:
            held.append(x.as_py())
            size += len(held[-1] or "")
            if size > scaled(TOGETHER, len(shared.value.langs)):
                found += tool.predict(held, spans)
                held, size = [], 0
        found += tool.predict(held, spans)
        return {c: cols[c] for c in kept} | {c: [f[i] for f in found] for i, c in enumerate(("lang_pred", "score", "spans"))}

    return source.mapInArrow(batches(step, schema), schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, by a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).withColumn("held_out", held_out(F.col("doc_id")))
