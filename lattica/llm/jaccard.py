"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; two are linked if their Jaccard similarity is 0.8 or more.

1. Equal texts are one: everything below is about one representative for each different text.
2. A signature of HASHES MinHash values for each text; BANDS bands of ROWS_A_BAND of them bucket the texts. A pair at 0.8
   shares no band with probability (1 - 0.8^3)^16, one in a hundred thousand; more similar pairs are missed less.
3. In a bucket, values are compared ROUND at a time. After n comparisons with m equal ones the posterior probability that
   the similarity reaches the threshold, under a uniform prior, is a tail of a Beta distribution; pairs for which it falls
   below TOLERANCE are dropped (BayesLSH: Satuluri and Parthasarathy, 2012). A pair that shares several bands counts in the
   first of them only, which both signatures tell.
4. Texts with a surviving pair meet again in their bucket with whole shingle sets, and every surviving pair is verified
   exactly. Only counts of links and the links of a spanning forest leave a bucket, so rows grow with texts, not pairs.
5. Classes are the connected components of the links, by minimum labels with pointer jumping.

A bucket of more than BLOCK texts is dealt out as pairs of blocks, so that no task holds more than two blocks. All work
in between is streamed from sorted partitions. No text, shingle or link is collected on the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, table, words_of, written

SHINGLE, THRESHOLD = 5, 0.8
HASHES, BANDS, ROWS_A_BAND = 64, 16, 3
ROUND, TOLERANCE = 16, 1e-6
BLOCK = 1024
#: A table of which at most so many bytes are counted may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Word hashes kept in each Python worker; a full table is emptied.
CACHE_WORDS = 200_000


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


MULTIPLY, ADD = _multipliers()


def least_equal(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values among n for which the posterior probability of reaching the threshold isn't below the tolerance."""
    total = n + 1  # Beta(m + 1, n - m + 1): P(s >= t) is the chance of at most m successes in n + 1 draws at t
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(total, m) * threshold**m * (1 - threshold) ** (total - m)
        if tail >= tolerance:
            return m
    return n


LEAST = [(n, least_equal(n)) for n in range(ROUND, HASHES + 1, ROUND)]
_words: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str) -> np.ndarray:
    """Sorted different 64-bit hashes of a text's shingles; a text of fewer words than a shingle has is one shingle, one without words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    ids = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = _words.get(w)
        if h is None:
            h = _words[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        ids[i] = h
    with np.errstate(over="ignore"):
        if len(ids) < SHINGLE:
            x = np.full(1, len(ids), np.uint64)
            for h in ids:
                x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h)
            return x
        n = len(ids) - SHINGLE + 1
        x = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    return np.unique(x)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of 32 bits."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            part = shingles[at : at + 4096]
            for k in range(HASHES):
                out[k] = min(out[k], ((part * MULTIPLY[k] + ADD[k]) >> np.uint64(32)).min())
    return out


def _signatures(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        sets = [shingle_hashes(x.as_py()) for x in b.column(2)]
        sigs = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sigs], ["id", "key", "sig"])


def _bands(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = 4 * ROWS_A_BAND
    for b in it:
        reps, buckets = [], []
        for rep, sig in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for k in range(BANDS):
                part = sig[k * width : (k + 1) * width]
                reps.append(rep)
                buckets.append(int.from_bytes(hashlib.blake2b(part, digest_size=7).digest(), "little") << 4 | k)
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(reps, b.schema.field(0).type)], ["bucket", "rep"])


def _surviving(a: np.ndarray, b: np.ndarray, band: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks of signatures that belong to this band and outlast all rounds."""
    equal = np.ones((len(a), len(b)), bool)
    if same:
        equal = np.triu(equal, 1)
    for k in range(band + 1):
        hit = np.ones((len(a), len(b)), bool)
        for c in range(k * ROWS_A_BAND, (k + 1) * ROWS_A_BAND):
            hit &= a[:, c, None] == b[None, :, c]
        equal &= hit if k == band else ~hit
    i, j = np.nonzero(equal)
    match = np.zeros(len(i), np.int16)
    for n, least in LEAST:
        match += (a[i, n - ROUND : n] == b[j, n - ROUND : n]).sum(1, dtype=np.int16)
        stay = match >= least
        i, j, match = i[stay], j[stay], match[stay]
    return i, j


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the two blocks of a group, and whether they are one."""
    block, own = t["block"].to_numpy(), t["b1"].to_numpy()[0]
    one = own == t["b2"].to_numpy()[0]
    return (np.arange(len(block)), np.arange(len(block)), True) if one else (np.nonzero(block == own)[0], np.nonzero(block != own)[0], False)


def _sig_array(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)


def _prune(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group of blocks the members that have a surviving pair in it."""
    for (bucket, b1, b2), t in grouped(it, ["bucket", "b1", "b2"]):
        sigs = _sig_array(t)
        left, right, same = _sides(t)
        i, j = _surviving(sigs[left], sigs[right], bucket & 15, same)
        if len(i):
            rows = np.unique(np.concatenate([left[i], right[j]]))
            part = t.take(pa.array(rows)).select(["bucket", "b1", "b2", "block", "rep"]).combine_chunks()
            yield from part.to_batches()


def _verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link counts of each member, and for a spanning forest of the links the member's parent (else the member itself)."""
    names = ["rep", "parent", "links"]
    for (bucket, _, _), t in grouped(it, ["bucket", "b1", "b2"]):
        sigs, reps = _sig_array(t), t["rep"].to_pylist()
        left, right, same = _sides(t)
        i, j = _surviving(sigs[left], sigs[right], bucket & 15, same)
        i, j = left[i], right[j]
        sets = [np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()]
        linked = _exact(sets, i, j)
        i, j = i[linked], j[linked]
        links = np.bincount(np.concatenate([i, j]), minlength=len(reps)) if len(i) else np.zeros(len(reps), np.int64)
        parent = list(range(len(reps)))

        def top(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                low, high = (p, q) if reps[p] < reps[q] else (q, p)
                parent[high] = low
        rows = [x for x in range(len(reps)) if links[x]]
        yield pa.RecordBatch.from_arrays([pa.array([reps[x] for x in rows], t.schema.field("rep").type), pa.array([reps[top(x)] for x in rows], t.schema.field("rep").type), pa.array([int(links[x]) for x in rows], pa.int64())], names)


def _exact(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of sets reach the threshold: by shared bits of a row for each set over the group's shingles, a stretch of shingles at a time."""
    if not len(i):
        return np.zeros(0, bool)
    sizes = np.array([len(s) for s in sets], np.int64)
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.zeros(len(i), np.int64)
    if len(i) < 64:
        for k, (x, y) in enumerate(zip(i, j, strict=True)):
            shared[k] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
    else:
        for low in range(0, len(every), 1 << 14):
            inside = (at >= low) & (at < low + (1 << 14))
            bits = np.zeros((len(sets), 1 << 14), bool)
            bits[owner[inside], at[inside] - low] = True
            packed = np.packbits(bits, axis=1).view(np.uint64)
            for k in range(0, len(i), 4096):
                shared[k : k + 4096] += np.bitwise_count(packed[i[k : k + 4096]] & packed[j[k : k + 4096]]).sum(1, dtype=np.int64)
    union = sizes[i] + sizes[j] - shared
    return shared >= THRESHOLD * union - 1e-9


def _shingled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(x.as_py()).tobytes() for x in b.column(1)], pa.binary())], ["rep", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(rep, class): the least member of each connected component of the edges (rep, parent). Each round takes the least label of the neighbours, then the label's own label, until none changes."""
    both = written(edges.select(F.col("rep").alias("a"), F.col("parent").alias("b")).union(edges.select("parent", "rep")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("b")).select("rep", F.least("b", "rep").alias("class")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("class").alias("__near"))
        least = labels.join(near, "rep").select("rep", F.col("class").alias("__old"), F.least("class", "__near").alias("__new"))
        jump = labels.select(F.col("rep").alias("__new"), F.col("class").alias("__far"))
        new = written(least.join(jump, "__new", "left").select("rep", "__old", F.least("__new", F.coalesce("__far", "__new")).alias("class")), "labels")
        if new.filter(F.col("__old") != F.col("class")).isEmpty():
            return new.select("rep", "class")
        labels = new.select("rep", "class")


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table with a broadcast hint if its rows, counted, stay within BROADCAST_BYTES; beyond, the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _slim(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))


def _joined(docs: DataFrame, text_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, key) of each row, and a row for each different text: key, rep_id, n_copies, n_links, class_id and whether it stands for its class."""
    slim = _slim(docs, text_col, id_col)
    sigs = written(slim.mapInArrow(_signatures, "id long, key binary, sig binary"), "signatures")
    texts = written(sigs.groupBy("key").agg(F.min("id").alias("rep_id"), F.count("*").alias("n_copies"), F.first("sig").alias("sig")), "texts")
    live = texts.filter("sig is not null").select(F.col("key").alias("rep"), "sig")
    banded = written(live.mapInArrow(_bands, "bucket long, rep binary"), "bands")
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = banded.join(sizes, "bucket").withColumn("of", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("of")).cast("int"))
    spread = members.select("bucket", "rep", "block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    spread = spread.select("bucket", "rep", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    keys = ["bucket", "b1", "b2"]
    dealt = lambda d: d.repartition(*keys).sortWithinPartitions(*keys)
    alive = written(dealt(spread.join(live, "rep")).mapInArrow(_prune, "bucket long, b1 int, b2 int, block int, rep binary"), "pairs-alive")
    wanted = written(alive.select("rep").distinct().join(texts, F.col("rep") == F.col("key")).select("rep", "rep_id"), "wanted")
    # one row of each wanted text: the one with the least id, repeated rows of it as one
    keyed = slim.join(_small(wanted, 100), (F.col("key") == F.col("rep")) & F.col("id").eqNullSafe(F.col("rep_id"))).select("rep", "text")
    sets = written(keyed.mapInArrow(_shingled, "rep binary, shingles binary").dropDuplicates(["rep"]), "shingles")
    found = written(dealt(alive.join(live, "rep").join(sets, "rep")).mapInArrow(_verify, "rep binary, parent binary, links long"), "verified")
    links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    classes = components(found.filter("rep != parent").select("rep", "parent")).join(texts.select(F.col("key").alias("rep"), "rep_id"), "rep")
    order = F.struct(F.col("rep_id").isNull(), "rep_id", "rep")
    heads = classes.groupBy("class").agg(F.min("rep_id").alias("class_id"), F.min_by("rep", order).alias("head"))
    of_class = classes.join(heads, "class").select("rep", "class_id", "head")
    by_text = texts.withColumnRenamed("key", "rep").drop("sig").join(links, "rep", "left").join(of_class, "rep", "left")
    # written, so that a join of the rows with it, where one text may have a third of them, is one that Spark can split
    return sigs.select("id", "key"), written(by_text.select(F.col("rep").alias("key"), "rep_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("head").isNull(), F.col("rep_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(F.col("head") == F.col("rep"), F.lit(True)).alias("stands")), "by-text")


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each row of docs: id, rep_id (the least id with an equal text), class_id (the least id of its component), n_links (different texts linked to its text) and n_copies (rows with an equal text).

    A null text counts as empty; texts without words are linked to nothing but equal texts. A null id gives way to any
    other; texts and classes that have no other have null ids. Repeated rows are copies; one id may stand for several
    texts. An empty table gives an empty one. Extra columns, whatever their names, play no part. Ids are integers, or texts of
    integers; others fail under ANSI mode.
    """
    rows, by_text = _joined(docs, text_col, id_col)
    return rows.join(by_text, "key").select(F.col("id").alias(id_col), "rep_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each class, with its columns: that with the least id; of repeated rows of it one."""
    rows, by_text = _joined(docs, text_col, id_col)
    counted = rows.groupBy("key", "id").agg(F.count("*").alias("n"))
    decided = written(counted.join(by_text, "key").select("key", "id", "n", (F.col("stands") & F.col("id").eqNullSafe(F.col("rep_id"))).alias("stays")), "decided")
    out = decided.filter("not stays").select(F.col("key").alias("__key"), F.col("id").alias("__id"))
    again = decided.filter("stays and n > 1").select(F.col("key").alias("__key"), F.col("id").alias("__id"))
    columns = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), F.col(f"`{id_col}`").cast("long").alias("__own"), F.unhex(F.md5(text.cast("binary"))).alias("__hash"))
    on = (F.col("__hash") == F.col("__key")) & F.col("__own").eqNullSafe(F.col("__id"))
    kept = keyed.join(_small(out, 100), on, "left_anti")
    if not again.isEmpty():
        kept = kept.join(_small(again, 100), on, "left_anti").unionByName(kept.join(_small(again, 100), on, "left_semi").dropDuplicates(["__hash", "__own"]))
    return kept.select(*(F.col("__row").getField(c).alias(c) for c in columns))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return join(table(spark, sf_dir, "documents"))
