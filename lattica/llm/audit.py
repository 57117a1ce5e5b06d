"""Audit of how filters of documents interact: what each of five filters removes in every order that they can be applied in.

A document's failures are a mask of bits. Four filters look at one text each; the fifth, exact copies of a text with a
smaller id anywhere in the table, is found by partition refinement: texts are split by their length in code points, then by
the hashes of successive blocks, each SPAN times as long as the one before, and a class of one row is dropped after every
split. What survives is compared by whole texts with the row of the least id of its class; rows that differ from it, which
only a collision of hashes can bring, are compared among themselves in the same way until none is left.

Masks are counted by part once. From these counts alone come the results of all orders: what a filter removes depends on
the set of filters before it, not on their order, so each part has 80 pairs of a filter and such a set, which the 600 steps of the
120 orders take their numbers from.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_if_null, table, written

FILTERS = "ABCDE"
#: First block of a text in code points, and how many times longer each next one is. The last block ends beyond any text that a row can hold.
BLOCK, SPAN, BLOCKS = 128, 16, 7
#: Classes that are broadcast to the texts at most; a row of three numbers each.
BROADCAST_CLASSES = 500_000
SPLIT = r"[\x20\x09-\x0D]+"
COPY = 1 << FILTERS.index("E")


def failures(text: Column) -> Column:
    """The bits of the four filters that look at one text alone."""
    words = F.array_remove(F.split(text, SPLIT), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    tests = [n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.char_length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    out = F.lit(0)
    for i, t in enumerate(tests):
        out = out + F.when(t, 1 << i).otherwise(0)
    return out


def hash_of(c: Column) -> Column:
    return F.xxhash64(c)


def block_hashes(text: Column, length: Column, hashed: Callable[[Column], Column] = hash_of) -> list[Column]:
    """The hash of each successive block of a text, null for blocks that it doesn't reach."""
    out, start, size = [], 0, BLOCK
    for _ in range(BLOCKS):
        part = text.substr(F.lit(start + 1), F.lit(min(size, 2**31 - 2 - start)))
        out.append(F.when(length > start, hashed(part)))
        start, size = start + size, size * SPAN
    return out


def _block_starts() -> list[int]:
    out, start, size = [], 0, BLOCK
    for _ in range(BLOCKS):
        out.append(start)
        start, size = start + size, size * SPAN
    return out


def _chained(length: Column, hashes: list[Column]) -> list[Column]:
    """The class of a text after the split by length and after each block: a number that only those decide."""
    out = [F.xxhash64(length)]
    for h in hashes:
        out.append(F.when(h.isNotNull(), F.xxhash64(out[-1], h)).otherwise(out[-1]))
    return out


def refined(rows: DataFrame) -> DataFrame:
    """(class, least, n) of the classes with more than one row that are left when rows (id, length, h0, h1, ...) are split by length, then block by block; least is the least id."""
    classes = _chained(F.col("length"), [F.col(f"h{i}") for i in range(BLOCKS)])
    left = rows.select("id", "length", *(c.alias(f"c{i}") for i, c in enumerate(classes)))
    for i, start in enumerate([-1, *_block_starts()]):
        many = written(left.groupBy(f"c{i}").agg(F.count("*").alias("__n")).filter("__n > 1").select(f"c{i}"), "many")  # a table of its own, so that the join of a large class can be split
        left = written(left.join(many, f"c{i}", "left_semi").select("id", "length", *(f"c{k}" for k in range(i, BLOCKS + 1))), f"split-{i}")
        if left.filter(F.col("length") > start + (BLOCK * SPAN ** max(i - 1, 0) if i else 0)).isEmpty():  # no text goes on beyond this block
            break
    return left.groupBy(F.col(f"c{BLOCKS}").alias("class")).agg(F.min("id").alias("least"), F.count("*").alias("n"))


def copies(docs: DataFrame, payload: list[str], text_col: str = "text", id_col: str = "doc_id", hashed: Callable[[Column], Column] = hash_of, rows: DataFrame | None = None) -> DataFrame:
    """Of docs the rows whose text is that of a row with a smaller id, with their id as id and the payload columns.

    Null texts are empty texts. A null id is smaller than none and no id is smaller than it, so such rows are neither copies
    nor originals; repeated rows of one id aren't copies of each other. rows: (id, length, h0, ...) of docs, if they were
    written before.
    """
    text = blank_if_null(F.col(f"`{text_col}`"))
    length = F.char_length(text)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), *(F.col(f"`{c}`") for c in payload)).filter("id is not null")
    hashes = block_hashes(text, length, hashed)
    if rows is None:
        rows = written(docs.select(F.col(f"`{id_col}`").alias("id"), length.alias("length"), *(h.alias(f"h{i}") for i, h in enumerate(hashes))), "blocks")
    classes = written(refined(rows.filter("id is not null")), "classes")
    of = F.col("text")
    inner = base.withColumn("class", _chained(F.char_length(of), block_hashes(of, F.char_length(of), hashed))[-1])
    small = classes.count() <= BROADCAST_CLASSES
    left = inner.join(F.broadcast(classes.select("class", "least")) if small else classes.select("class", "least"), "class")
    found = []
    while True:
        originals = left.filter(F.col("id") == F.col("least")).groupBy("class").agg(F.min("text").alias("__original"))
        originals = written(originals, "originals")
        same = F.col("text") == F.col("__original")
        compared = left.join(originals, "class").select("class", "id", *payload, (same & (F.col("id") > F.col("least"))).alias("copy"), F.when(~same, F.col("text")).alias("text"))
        compared = written(compared, "compared")
        found.append(compared.filter("copy").select("id", *payload))
        rest = compared.filter("text is not null").select("class", "id", "text", *payload)
        if rest.isEmpty():
            break
        left = rest.join(rest.groupBy("class").agg(F.min("id").alias("least")), "class")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, filter, before) of every step of every order; before is the mask of the filters before it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            out.append(("".join(order), i + 1, FILTERS.index(f), before))
            before |= 1 << FILTERS.index(f)
    return out


def interactions(cells: DataFrame) -> DataFrame:
    """The audit of every order from cells (part, mask, good, toxic, n): documents by the mask of the filters that they fail, of these with a label of quality and a toxic one."""
    spark = cells.sparkSession
    pairs = sorted({(f, before) for _, _, f, before in steps()})
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(b).alias("before"), F.lit(1 << f).alias("bit")) for f, b in pairs)))
    x = cells.select("*", each.alias("x")).select("part", "mask", "good", "toxic", "n", "x.*")
    bit = F.col("bit")
    fails, earlier = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda test, of="n": F.coalesce(F.sum(F.when(test, F.col(of))), F.lit(0)).cast("long")
    removed = fails & ~earlier
    #: A document that fails k filters is removed by each of them in a k-th of all orders.
    orders = len(list(permutations(FILTERS)))
    share = F.expr(f"bigint({orders})") / F.greatest(F.bit_count(F.col("mask")), F.lit(1))
    by = x.groupBy("part", "f", "before").agg(
        total(~fails & ~earlier).alias("kept"), total(removed).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == bit).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), F.coalesce(F.sum(F.when(fails, F.col("n") * F.round(share).cast("long"))), F.lit(0)).cast("long").alias("shapley"))
    order = spark.createDataFrame(steps(), "filter_order string, step int, f int, before int")
    return by.join(F.broadcast(order), ["f", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", hashed: Callable[[Column], Column] = hash_of) -> DataFrame:
    """One row for each part (source), order and step.

    Null texts and sources count as empty ones; a null id has no labels and no copies (see copies); of several labels of
    one id any of quality 1 makes it good and any of toxic 1 toxic, null ones don't count; repeated rows count each. An
    empty table gives no rows; extra columns play no part.
    """
    text = blank_if_null(F.col(f"`{text_col}`"))
    length = F.char_length(text)
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    of = F.col("text")
    rows = written(read.select("id", "part", failures(of).alias("mask"), F.char_length(of).alias("length"), *(h.alias(f"h{i}") for i, h in enumerate(block_hashes(of, F.char_length(of), hashed)))), "masks")
    again = read.select("id", "part", failures(of).alias("mask"), "text")
    repeated = copies(again, ["part", "mask"], "text", "id", hashed, rows.drop("part", "mask"))
    # Each row counts without the bit of copies; a copy then takes one away from there and adds one with the bit.
    moved = repeated.select("id", "part", "mask", F.lit(-1).alias("k")).unionByName(repeated.select("id", "part", (F.col("mask") + COPY).alias("mask"), F.lit(1).alias("k")))
    signed = rows.select("id", "part", "mask", F.lit(1).alias("k")).unionByName(moved)
    any_of = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").groupBy("id").agg(any_of("quality"), any_of("toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long") * F.col("k")
    cells = signed.join(marks, "id", "left").groupBy("part", "mask").agg(F.sum(F.col("k").cast("long")).alias("n"), F.sum(flag("quality")).alias("good"), F.sum(flag("toxic")).alias("toxic"))
    return interactions(written(cells, "cells"))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all orders, by source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _oracle() -> str:
    orders = ", ".join(f"('{o}',{s},{1 << f},{b})" for o, s, f, b in steps())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source,'') AS part, coalesce(text,'') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text,'[\x20\x09-\x0D]+'), lambda x: x<>'') AS words, row_number() OVER () AS rid FROM d),
f AS (SELECT w.doc_id, part, CASE WHEN len(words)<200 THEN 1 ELSE 0 END + CASE WHEN 100*len(list_distinct(words))<50*len(words) THEN 2 ELSE 0 END
 + CASE WHEN 100*length(regexp_replace(text,'[^A-Z]','','g'))>2*length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text,'[#$%&*|]') THEN 8 ELSE 0 END
 + CASE WHEN w.doc_id>min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality=1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic=1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
c AS MATERIALIZED (SELECT part, mask, count(*) AS n, coalesce(sum(good),0) AS good, coalesce(sum(toxic),0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o(filter_order, step, b, before) AS (VALUES {orders})
SELECT part, filter_order, step::INT AS step,
 coalesce(sum(n) FILTER (mask&(b|before)=0),0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask&b<>0 AND mask&before=0),0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (mask&b<>0 AND mask&before<>0),0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask=b),0)::BIGINT AS unique_fails,
 coalesce(sum(good) FILTER (mask&b<>0 AND mask&before=0),0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask&b<>0 AND mask&before=0),0)::BIGINT AS toxic_lost,
 coalesce(sum(n*(120//greatest(bit_count(mask),1))) FILTER (mask&b<>0),0)::BIGINT AS shapley
FROM c, o GROUP BY part, filter_order, step, b, before"""


ORACLE = {"op11_filter_audit": _oracle()}
