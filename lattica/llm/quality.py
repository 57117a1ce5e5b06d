"""Quality rules with thresholds from mergeable quantile sketches for each language and source.

Every measure of a text is an integer. A sketch is a table of counts by bucket, over the texts that pass the base rules:
values below 256 have a bucket each, larger ones share one with values of the same eight leading bits, so a quantile is
off by one part in 128 at most. Counts by bucket add up, so sketches of sources merge into those of languages and of
everything. A group of fewer than MIN_DOCS documents uses its language's sketch, or else the one of everything.

A fence lies some ranges beyond a quantile, the range being the distance between two quantiles of the sketch: quartiles
for what is alike in most texts, and the median and the 98th hundredth for repeated lines and phrases, which ordinary texts
have now and then. There is no fixed cutoff: a group of longer words or more refrains gets a fence further out. Only where
a sketch is so nearly constant that its range is below the least one in RULES, that one counts in its place. Only built-in
functions are used; the documents themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank_if_null, table, written

WINDOW, MIN_WORDS, MAX_REPEAT = 5, 10, 20
MIN_DOCS = 100
SYMBOLS = r"[#*$%&|<>]"
SPLIT = r"[\x20\x09-\x0D]+"
#: Bits of a value that its bucket keeps.
BITS = 8
#: Rule: (measure, side of the fence, lower and upper quantile in hundredths, ranges beyond, least range).
RULES = {
    "symbol_rate": ("symbol_rate", "upper", 25, 75, 4, 400),
    "dup_line_rate": ("dup_line_rate", "upper", 50, 98, 3, 400),
    "repeat_rate": ("repeat_rate", "upper", 50, 98, 3, 200),
    "long_words": ("word_length", "upper", 25, 75, 4, 100),
    "short_words": ("word_length", "lower", 25, 75, 4, 100),
}
QUANTILES = sorted({q for r in RULES.values() for q in r[2:4]})


def bind(value: Column, fn) -> Column:
    """fn(value), with the value worked out once although fn uses it in loops."""
    return F.transform(F.array(value), fn)[0]


def _covered(windows: Column) -> Column:
    """Words inside windows that occur more than once, from the windows' hashes."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
    return bind(pairs, lambda p: F.aggregate(repeated(p), start, lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["at"])).alias("n"), i.alias("at")), lambda s: s["n"]))


def _repeat_words(hashes: Column) -> Column:
    step = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(h[i + k] for k in range(WINDOW))))
    many = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w))
    return bind(hashes, lambda h: F.when(F.size(h) < WINDOW + 1, F.lit(0)).otherwise(bind(step(h), many)))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the struct __q of integer measures of every whole text; a null text has no words.

    Words and lines are compared by 64-bit hashes within a document.
    """
    text = blank_if_null(F.col(f"`{text_col}`"))
    words = F.filter(F.split(text, SPLIT), lambda w: w != "")
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x))
    of_lines = bind(lines, lambda h: F.struct(F.size(h).cast("long").alias("lines"), (F.size(h) - F.size(F.array_distinct(h))).cast("long").alias("dup")))
    of_words = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("words"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), _repeat_words(F.transform(w, lambda x: F.xxhash64(x))).cast("long").alias("repeat")))
    return docs.withColumn("__q", bind(F.struct(of_words.alias("w"), of_lines.alias("l")), lambda x: F.struct(
        x["w"]["words"].alias("n_words"), x["w"]["chars"].alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        x["l"]["dup"].alias("n_dup_lines"), x["w"]["repeat"].alias("n_repeat_words"), x["l"]["lines"].alias("n_lines"))))


def measures(q: Column) -> dict[str, Column]:
    """The measures that rules look at: rates in ten-thousandths, the words' mean length in thousandths."""
    words, lines = F.greatest(q["n_words"], F.lit(1)), F.greatest(q["n_lines"], F.lit(1))
    part = lambda a, b, by: F.expr("bigint(0)") + F.floor(a * by / b).cast("long")
    return {"symbol_rate": part(q["n_symbols"], words, 10000), "dup_line_rate": part(q["n_dup_lines"], lines, 10000), "repeat_rate": part(q["n_repeat_words"], words, 10000), "word_length": part(q["word_chars"], words, 1000)}


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT * q["n_words"])


def bucket(v: Column) -> Column:
    """The smallest value that shares the value's bucket."""
    shift = F.greatest(F.char_length(F.bin(v)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """Counts by language, source, measure and bucket over all documents that pass the base rules."""
    listed = bind(F.col("__q"), lambda q: F.when(~base_failed(q), F.array(*(F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in measures(q).items()))))
    each = F.explode(listed)
    # no filter, which would be pushed below the measures and work them out again
    flat = measured.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{source}`").cast("string").alias("source"), each.alias("m"))
    return flat.groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Documents and quantiles (q25, ...) of each measure, of sketches merged by keys."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("of", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("of") * q, F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(F.max("of").alias("docs"), *(at(q).alias(f"q{q}") for q in QUANTILES))


def thresholds(sketch: DataFrame) -> DataFrame:
    """A row for each language and source: the fence of every rule."""
    own, by_lang, all_ = (quantiles(sketch, k).alias(a) for k, a in ((["lang", "source"], "s"), (["lang"], "l"), ([], "a")))
    joined = own.join(by_lang, (F.col("s.lang").eqNullSafe(F.col("l.lang"))) & (F.col("s.measure") == F.col("l.measure"))).join(all_, F.col("s.measure") == F.col("a.measure"))
    pick = lambda c: F.when(F.col("s.docs") >= MIN_DOCS, F.col(f"s.{c}")).when(F.col("l.docs") >= MIN_DOCS, F.col(f"l.{c}")).otherwise(F.col(f"a.{c}"))
    q = joined.select("s.lang", "s.source", "s.measure", *(pick(f"q{x}").alias(f"q{x}") for x in QUANTILES))

    def fence(rule: str) -> Column:
        measure, side, low, high, ranges, least = RULES[rule]
        reach = ranges * F.greatest(F.col(f"q{high}") - F.col(f"q{low}"), F.lit(least))
        return F.max(F.when(F.col("measure") == measure, F.col(f"q{high}") + reach if side == "upper" else F.col(f"q{low}") - reach)).alias(rule)

    return q.groupBy("lang", "source").agg(*(fence(k) for k in RULES))


def judged(measured: DataFrame, fences: DataFrame, lang: str, source: str) -> DataFrame:
    """Adds base_failed and kept to measured rows."""
    t = fences.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), F.struct(*RULES).alias("__t"))
    on = F.col("__l").eqNullSafe(F.col(f"`{lang}`").cast("string")) & F.col("__s").eqNullSafe(F.col(f"`{source}`").cast("string"))

    def verdict(q: Column) -> Column:
        good, values = F.lit(True), measures(q)
        for k, (measure, side, *_) in RULES.items():
            good = good & (values[measure] <= F.col(f"__t.{k}") if side == "upper" else values[measure] >= F.col(f"__t.{k}"))
        return F.struct(base_failed(q).alias("base_failed"), F.when(base_failed(q), False).otherwise(F.coalesce(good, F.lit(True))).alias("kept"))

    # one expression with one use of the measures, so that no part of it is pushed below them
    return measured.join(t, on, "left").withColumn("__v", bind(F.col("__q"), verdict)).withColumns({"base_failed": F.col("__v.base_failed"), "kept": F.col("__v.kept")}).drop("__l", "__s", "__t", "__v")


def assess(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures and verdict of every row; the measures are written once to the shared folder and joined with their group's fences.

    A null text has no words and fails the base rules; null languages and sources are groups of their own; repeated rows
    are judged alike; an empty table gives an empty one. Columns of docs outside keep, whatever their names, play no part.
    """
    slim = docs.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)), F.col(f"`{lang_col}`").alias("__lang"), F.col(f"`{source_col}`").alias("__source"), F.col(f"`{text_col}`").alias("__text"))
    measured = written(features(slim, "__text").drop("__text"), "quality")
    fences = written(thresholds(sketches(measured, "__lang", "__source")), "fences")
    out = judged(measured, fences, "__lang", "__source")
    return out.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), *(F.col(f"__q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def filter_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that are kept, with their columns. The measures, which cost far more than reading and writing a text, are worked out once and written beside the rows."""
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{lang_col}`").alias("__lang"), F.col(f"`{source_col}`").alias("__source"), F.col(f"`{text_col}`").alias("__text"))
    measured = written(features(inner, "__text").drop("__text"), "quality")
    fences = written(thresholds(sketches(measured, "__lang", "__source")), "fences")
    out = judged(measured, fences, "__lang", "__source").filter("kept")
    return out.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return assess(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    blank = r"[\x20\x09-\x0D]"
    rate = {"symbol_rate": "n_symbols*10000//greatest(n_words,1)", "dup_line_rate": "n_dup_lines*10000//greatest(n_lines,1)", "repeat_rate": "n_repeat_words*10000//greatest(n_words,1)", "word_length": "word_chars*1000//greatest(n_words,1)"}

    def quantile(keys: str) -> str:
        k = f"{keys}{',' * bool(keys)}"
        at = ", ".join(f"min(bucket) FILTER (upto*100>=total*{q}) AS q{q}" for q in QUANTILES)
        return f"""SELECT {k} measure, max(total) AS docs, {at}
      FROM (SELECT *, sum(n) OVER (PARTITION BY {k} measure ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {k} measure) AS total
            FROM (SELECT {k} measure, bucket, count(*) AS n FROM m GROUP BY ALL)) GROUP BY ALL"""

    def fence(rule: str) -> str:
        measure, side, low, high, ranges, least = RULES[rule]
        reach = f"{ranges}*greatest(q{high}-q{low},{least})"
        return f"max(CASE WHEN measure='{measure}' THEN {f'q{high}+{reach}' if side == 'upper' else f'q{low}-{reach}'} END) AS {rule}"

    good = " AND ".join(f"{rate[m]} {'<=' if side == 'upper' else '>='} t.{k}" for k, (m, side, *_) in RULES.items())
    picked = ", ".join(f"CASE WHEN s.docs>={MIN_DOCS} THEN s.q{q} WHEN l.docs>={MIN_DOCS} THEN l.q{q} ELSE a.q{q} END AS q{q}" for q in QUANTILES)
    shift = f"greatest(length(bin(v))-{BITS},0)::INT"
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text,'') AS text, row_number() OVER () AS rid FROM documents),
w AS MATERIALIZED (SELECT *, list_filter(string_split_regex(text,'{blank}+'), lambda x: x<>'') AS words, list_filter(string_split(text,chr(10)), lambda x: regexp_matches(x,'[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i+4],' ') AS g FROM (SELECT rid, words, unnest(range(1,len(words)-3)) AS i FROM w WHERE len(words)>=5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid,g) AS c FROM win) WHERE c>1),
cov AS (SELECT rid, count(DISTINCT i+k) AS n FROM rep, (SELECT unnest(range(0,5)) AS k) GROUP BY rid),
f AS MATERIALIZED (SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words,''))::BIGINT AS word_chars,
  (length(text)-length(regexp_replace(text,'{SYMBOLS}','','g')))::BIGINT AS n_symbols, (len(lines)-len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(cov.n,0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines FROM w LEFT JOIN cov ON w.rid=cov.rid),
b AS (SELECT f.*, n_words<{MIN_WORDS} OR 100*n_repeat_words>{MAX_REPEAT}*n_words AS base_failed FROM f),
v AS ({' UNION ALL '.join(f"SELECT lang, source, '{k}' AS measure, ({x})::BIGINT AS v FROM b WHERE NOT base_failed" for k, x in rate.items())}),
m AS MATERIALIZED (SELECT lang, source, measure, (v>>{shift})<<{shift} AS bucket FROM v),
qs AS ({quantile('lang, source')}), ql AS ({quantile('lang')}), qa AS ({quantile('')}),
q AS (SELECT s.lang, s.source, s.measure, {picked}
  FROM qs s JOIN ql l ON s.lang IS NOT DISTINCT FROM l.lang AND s.measure=l.measure JOIN qa a ON s.measure=a.measure),
t AS (SELECT lang, source, {', '.join(map(fence, RULES))} FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({good}, true) AS kept
FROM b LEFT JOIN t ON b.lang IS NOT DISTINCT FROM t.lang AND b.source IS NOT DISTINCT FROM t.source"""


ORACLE = {"op8_quality_rules": _oracle()}
