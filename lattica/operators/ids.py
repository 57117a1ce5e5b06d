"""Short ids for many notes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.model import ID_PREFIX
from lattica.sources.storage import written

LEAST, DIGITS = 4, 64


def _shared(a: Column, b: Column) -> Column:
    """How many letters two texts begin with in common; 0 if one is null."""
    same = F.filter(F.sequence(F.lit(1), F.lit(DIGITS)), lambda n: (F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n)) & (F.char_length(a) >= n) & (F.char_length(b) >= n))
    return F.when(a.isNull() | b.isNull(), 0).otherwise(F.size(same))


def apart(hashes: DataFrame, rounds: int = 8) -> DataFrame:
    """(key, hash) with equal hashes made different: the first by key keeps its own, each other gets a hash of it and its number."""
    for _ in range(rounds):
        place = F.row_number().over(Window.partitionBy("hash").orderBy("key"))
        again = F.sha2(F.concat_ws("-", "hash", "n").cast("binary"), 256)
        hashes = written(hashes.withColumn("n", place).select("key", F.when(F.col("n") == 1, F.col("hash")).otherwise(again).alias("hash"), (F.col("n") > 1).alias("moved")), "hashes")
        clash = not hashes.filter("moved").isEmpty()
        hashes = hashes.select("key", "hash")
        if not clash:
            break
    return hashes


def shortest_ids(hashes: DataFrame, taken: DataFrame | None = None, least: int = LEAST, prefix: str = ID_PREFIX) -> DataFrame:
    """(key, id) for rows (key, hash): the prefix and as many letters of the hash, at least so many, as no other row's hash and no id that is taken (id) begin with.

    In the order of hashes, what shares most with one is beside it. Those that share fewer than least letters don't count, so
    rows are dealt out by their first letters, and each group is sorted. Hashes must differ (see apart).
    """
    rows = hashes.select("key", "hash", F.lit(True).alias("new"))
    if taken is not None:
        own = F.when(F.col("id").startswith(prefix), F.substring("id", len(prefix) + 1, DIGITS))
        rows = rows.unionByName(taken.select(F.lit(None).cast(hashes.schema["key"].dataType).alias("key"), own.alias("hash"), F.lit(False).alias("new")).filter("hash is not null"))
    beside = Window.partitionBy(F.substring("hash", 1, least)).orderBy("hash", "new")
    shared = F.greatest(_shared(F.col("hash"), F.lag("hash").over(beside)), _shared(F.col("hash"), F.lead("hash").over(beside)))
    return rows.withColumn("letters", F.greatest(shared + 1, F.lit(least))).filter("new").select("key", F.concat(F.lit(prefix), F.substr("hash", F.lit(1), F.col("letters"))).alias("id"))
