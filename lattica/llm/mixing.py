"""Mixing sources to target weights by iterative proportional fitting.

Token counts by cell (source, language, topic) are raked to the target shares of all three margins in turn; SWEEPS rounds
are made, always as many. RATE is the part of all tokens that is to be drawn. No document can be drawn more than once, so a
cell's raked share is bounded by its own share over the rate, after every step, and so is the share of a margin's value: a
target beyond that bound is out of reach and is lowered to it, and what it leaves goes to the other values in proportion. So
a rare value is drawn whole and falls short by what it lacks, and the others and the rate don't depend on it. The
probability of a document is its cell's raked share times the rate over the cell's own share, at most 1, and its draw is a
hash of its id, so a run repeats and needs no state. balance() gives each value's own share, its target, what is in reach
and what the draws will give.

Only built-in functions are used. The cells are a small table beside the documents: it is written between rounds and,
up to CELLS_A_TASK rows, held in one partition, where its windows need no shuffle; beyond, Spark deals it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, blank_if_null, table, written

SWEEPS, SWEEPS_A_JOB = 20, 5
RATE = 0.8
CELLS_A_TASK = 200_000
DIMS = ("source", "lang", "topic")
#: Default targets are the observed shares to these powers: below 1, small ones gain.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Topic by the first mark that a text holds.
TOPICS = [("legal", ("icense", "opyright")), ("contact", ("@",)), ("table", (" | ", "\t")), ("digits", ("+1", "://"))]


def topic_of(text: Column) -> Column:
    out = None
    for name, marks in TOPICS:
        test = F.lit(False)
        for m in marks:
            test = test | text.contains(m)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Words of a text, at least one, so that an empty document can be drawn too."""
    return F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1)).cast("long")


def draw(doc_id: Column) -> Column:
    """A number from 0 to 1 that only the id decides."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _all(rows: DataFrame, number: Column) -> float | None:
    """One number over all rows."""
    found = rows.agg(number.cast("double")).first()[0]
    return None if found is None else float(found)


def targets(cells: DataFrame, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds the target share of each margin's value: a given table (value, share), or powers of the observed shares. Shares are scaled to 1 over values that occur; a value without one gets 0."""
    for d in DIMS:
        if given and d in given:
            t = given[d].select(F.col("value").alias("__v"), F.col("share").cast("double").alias("__s"))
        else:
            t = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(POWERS[d])).alias("__s")).withColumnRenamed(d, "__v")
        values = cells.select(d).distinct().join(t, F.col(d).eqNullSafe(F.col("__v")), "left").select(d, F.coalesce("__s", F.lit(0.0)).alias("__s"))
        scaled = values.select(F.col(d).alias("__v"), (F.col("__s") / F.lit(_all(values, F.sum("__s")))).alias(f"t_{d}"))
        cells = cells.join(scaled, F.col(d).eqNullSafe(F.col("__v")), "left").drop("__v")
    return cells


def reachable(cells: DataFrame, rate: float) -> DataFrame:
    """Adds u_<margin> to cells with own and t_<margin>: the target share of each margin's value, lowered to its own share over the rate where it is more, the others scaled so that the sum is 1.

    Values by their bound over their target, the least first: the scale if all values before one are lowered tells whether
    it must be too, and the first that needn't be sets the scale. Values are a table beside the documents.
    """
    for d in DIMS:
        by = Window.orderBy(F.col("__bound") / F.col("__t"), "__v").rowsBetween(Window.unboundedPreceding, -1)
        before = lambda c, w=by: F.coalesce(F.sum(c).over(w), F.lit(0.0))
        values = cells.groupBy(F.col(d).alias("__v")).agg((F.sum("own") / F.lit(float(rate))).alias("__bound"), F.max(f"t_{d}").alias("__t")).filter("__t > 0")
        scaled = values.withColumn("__scale", F.greatest(1 - before("__bound"), F.lit(0.0)) / (1 - before("__t")))
        lowered = F.col("__bound") < F.col("__scale") * F.col("__t")
        scale = F.max(F.when(~lowered, F.col("__scale"))).over(Window.partitionBy())
        reach = scaled.select("__v", F.when(lowered, F.col("__bound")).otherwise(F.least(F.col("__bound"), scale * F.col("__t"))).alias(f"u_{d}"))
        cells = cells.join(reach, F.col(d).eqNullSafe(F.col("__v")), "left").drop("__v").withColumn(f"u_{d}", F.coalesce(f"u_{d}", F.lit(0.0)))
    return cells


def rake(cells: DataFrame, given: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, rate: float = RATE) -> DataFrame:
    """Cells (source, lang, topic, tokens) with own, their share, rate, the same for all, and w, the raked share."""
    out = written(targets(cells, given).withColumn("own", F.col("tokens") / F.lit(_all(cells, F.sum("tokens")))), "targets")
    out = written(reachable(out, rate).withColumn("rate", F.lit(float(rate))).withColumn("w", F.col("own")), "cells")
    parts = max(1, -(-out.count() // CELLS_A_TASK))
    for start in range(0, sweeps, SWEEPS_A_JOB):
        out = out.coalesce(parts)
        for _ in range(min(SWEEPS_A_JOB, sweeps - start)):
            for d in DIMS:
                total = F.sum("w").over(Window.partitionBy(d))
                out = out.withColumn("w", F.when(total > 0, F.least(F.col("own") / F.col("rate"), F.col("w") * F.col(f"u_{d}") / total)).otherwise(F.lit(0.0)))
        out = written(out, "raked")
    return out


def calibrate(raked: DataFrame) -> DataFrame:
    """Adds weight (raked share over own share) and probability to raked cells."""
    weight = F.col("w") / F.col("own")
    return raked.withColumns({"weight": F.round(weight, 9), "probability": F.round(F.least(F.lit(1.0), weight * F.col("rate")), 9)})


def balance(raked: DataFrame) -> DataFrame:
    """(dim, value, own, target, reach, expected): the share of tokens of every value of a margin, what it should be, what it can be at this rate, and what draws by the raked cells' probabilities give."""
    drawn = calibrate(raked).withColumn("__e", F.col("own") * F.col("probability"))
    drawn = drawn.withColumn("__e", F.col("__e") / F.lit(_all(drawn, F.sum("__e"))))
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"), F.col(f"t_{d}").alias("target"), F.col(f"u_{d}").alias("reach")) for d in DIMS)))
    return drawn.select("own", "__e", each.alias("x")).groupBy("x.dim", "x.value").agg(F.sum("own").alias("own"), F.max("x.target").alias("target"), F.max("x.reach").alias("reach"), F.sum("__e").alias("expected"))


def _celled(docs: DataFrame, text_col: str, source_col: str, lang_col: str) -> tuple[list[Column], Column]:
    text = blank_if_null(F.col(f"`{text_col}`"))
    return [F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{lang_col}`").cast("string").alias("lang"), topic_of(text).alias("topic")], tokens_of(text)


def _sum_cells(flat: DataFrame) -> DataFrame:
    return flat.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))


def _rates(cells: DataFrame, given: dict[str, DataFrame] | None, rate: float) -> DataFrame:
    rates = calibrate(rake(written(cells, "tokens-by-cell"), given, rate=rate))
    return written(rates.select(*(F.col(d).alias(f"__{d}") for d in DIMS), "weight", "probability"), "rates")


def _on(dims: dict[str, Column]):
    test = F.lit(True)
    for d, c in dims.items():
        test = test & c.eqNullSafe(F.col(f"__{d}"))
    return test


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", id_col: str = "doc_id", given: dict[str, DataFrame] | None = None, rate: float = RATE) -> DataFrame:
    """Cell, weight, probability and draw of every row.

    Null sources and languages are values of their own; a null text counts as empty, with one token; null ids share one
    draw, as do repeated rows; an empty table gives an empty one; extra columns, whatever their names, play no part.
    """
    dims, tokens = _celled(docs, text_col, source_col, lang_col)
    flat = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), *dims, tokens.alias("n_tokens")), "mix")
    rates = _rates(_sum_cells(flat), given, rate)
    out = flat.join(rates, _on({d: F.col(d) for d in DIMS}), "left")
    return out.select("doc_id", *DIMS, "n_tokens", "weight", "probability", (draw(F.col("doc_id")) < F.col("probability")).alias("selected"))


def sample_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", id_col: str = "doc_id", given: dict[str, DataFrame] | None = None, rate: float = RATE) -> DataFrame:
    """The documents drawn, with their columns. Two passes over the texts, so that no text is written or shuffled."""
    dims, tokens = _celled(docs, text_col, source_col, lang_col)
    rates = _rates(_sum_cells(docs.select(*dims, tokens.alias("n_tokens"))), given, rate)
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{id_col}`").alias("__id"), *(c.alias(f"__d{i}") for i, c in enumerate(dims)))
    out = inner.join(rates, _on({d: F.col(f"__d{i}") for i, d in enumerate(DIMS)}), "left").filter(draw(F.col("__id")) < F.col("probability"))
    return out.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Weight, probability and draw of every document."""
    return mix(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    topic = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(text, {'chr(9)' if m == chr(9) else repr(m)})" for m in marks) + f" THEN '{name}'" for name, marks in TOPICS) + " ELSE 'prose' END"
    dims = ", ".join(DIMS)
    parts = [rf"""d AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, greatest(len(list_filter(string_split_regex(coalesce(text,''),'[\x20\x09-\x0D]+'), lambda x: x<>'')),1)::BIGINT AS n_tokens FROM (SELECT doc_id, source, lang, coalesce(text,'') AS text FROM documents))""",
             f"c AS (SELECT {dims}, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL)"]
    for x in DIMS:
        parts.append(f"t_{x} AS (SELECT {x}, s/sum(s) OVER () AS t FROM (SELECT {x}, pow(sum(tokens)::DOUBLE,{POWERS[x]}) AS s FROM c GROUP BY ALL))")
    parts.append("o AS MATERIALIZED (SELECT c.*, " + ", ".join(f"t_{x}.t AS t_{x}" for x in DIMS) + ", tokens/sum(tokens) OVER () AS own FROM c " + " ".join(f"JOIN t_{x} ON c.{x} IS NOT DISTINCT FROM t_{x}.{x}" for x in DIMS) + ")")
    for x in DIMS:
        sums = f"sum({{}}) OVER (ORDER BY b/t, {x} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        scale = f"greatest(1-coalesce({sums.format('b')},0),0)/(1-coalesce({sums.format('t')},0))"
        parts.append(f"u_{x} AS MATERIALIZED (SELECT {x}, CASE WHEN b<s*t THEN b ELSE least(b, t*max(CASE WHEN b>=s*t THEN s END) OVER ()) END AS u FROM (SELECT *, {scale} AS s FROM (SELECT {x}, sum(own)/{RATE}::DOUBLE AS b, max(t_{x}) AS t FROM o GROUP BY 1)))")
    parts.append(f"r0 AS MATERIALIZED (SELECT o.*, own AS w, {RATE}::DOUBLE AS rate, " + ", ".join(f"u_{x}.u AS u_{x}" for x in DIMS) + " FROM o " + " ".join(f"JOIN u_{x} ON o.{x} IS NOT DISTINCT FROM u_{x}.{x}" for x in DIMS) + ")")
    for i in range(SWEEPS * len(DIMS)):
        x = DIMS[i % len(DIMS)]
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {x})>0 THEN least(own/rate, w*u_{x}/sum(w) OVER (PARTITION BY {x})) ELSE 0 END AS w) FROM r{i})")
    parts.append(f"p AS (SELECT {dims}, round(w/own,9) AS weight, round(least(1,w/own*rate),9) AS probability FROM r{SWEEPS * len(DIMS)})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, p.weight, p.probability, ('0x'||substr(md5(coalesce(d.doc_id::VARCHAR,'')),1,8))::BIGINT/4294967296.0 < p.probability AS selected
FROM d JOIN p ON {' AND '.join(f'd.{x} IS NOT DISTINCT FROM p.{x}' for x in DIMS)}"""


ORACLE = {"op6_mix_sources": _oracle()}
