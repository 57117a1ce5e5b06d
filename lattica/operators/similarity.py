"""TF-IDF similarity, near-duplicates, shared tags and second neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.storage import open_store, written

from .graph import components
from .relational import keep_latest
from .search import term_weights

#: Buckets of a vector's sketch, a byte each.
BUCKETS = 512
#: Terms of vectors in a block, 16 bytes each, and candidates and sketches of pairs that a task holds at a time.
TERMS_AT_ONCE = 1 << 20
AT_ONCE = 1 << 20
SKETCHES_AT_ONCE = 1 << 13
#: Numbers of so many terms at most are held by every task.
OFTEN = 1 << 19
#: Parts of one that sums count in.
FRACTION = float(1 << 40)


def _weights(tf: DataFrame, total: int) -> DataFrame:
    """(note_id, term, w, df) of all postings, unscaled. Terms in more than one of OFTEN postings, fewer than OFTEN terms, are few enough for each task; only postings of the others are shuffled to meet their numbers."""
    df = written(tf.groupBy("term").agg(F.count("*").alias("df")), "df")
    least = (df.agg(F.sum("df")).first()[0] or 0) // OFTEN
    often = F.broadcast(df.filter(F.col("df") > least))
    rows = tf.join(often, "term")
    if least:
        rows = rows.unionByName(tf.join(often, "term", "left_anti").join(df.filter(F.col("df") <= least), "term"))
    return rows.select("note_id", "term", _weight(total), "df")


def _weight(total: int) -> Column:
    return (F.col("tf") * (F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)) + 1.0)).alias("w")


def _total(x: Column, over=lambda s: s) -> Column:
    """The sum of x by whole numbers, which doesn't depend on the order of rows: notes with the same words get the same sums, to the last digit."""
    whole = F.floor(x)
    return over(F.sum(whole)) + over(F.sum(F.floor((x - whole) * F.lit(FRACTION)))) / F.lit(FRACTION)


def _scaled(weights: DataFrame) -> DataFrame:
    norm = F.sqrt(_total(F.col("w") * F.col("w"), lambda s: s.over(Window.partitionBy("note_id"))))
    return weights.select(F.col("note_id").alias("id"), "term", (F.col("w") / norm).alias("w"), "df")


def vectors(postings: DataFrame, total: int, ids: list[str] | None = None) -> DataFrame:
    """(id, term, w, df): TF-IDF weights scaled to length 1, of all notes or those few of ids. Of few notes only their own terms are counted, so that nothing else is shuffled."""
    tf = term_weights(postings)
    if ids is None:
        return _scaled(_weights(tf, total))
    own = tf.filter(F.col("note_id").isin(ids))
    df = tf.join(F.broadcast(own.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return _scaled(own.join(df, "term").select("note_id", "term", _weight(total), "df"))


def copies(postings: DataFrame) -> DataFrame:
    """(id, rep) of every note: the least id of those with the same weighted frequency of every term, told by two sums of hashes over the terms."""
    tf = term_weights(postings)
    same = ["x", "y", "n"]
    sums = tf.groupBy("note_id").agg(F.bit_xor(F.xxhash64("term", "tf")).alias("x"), F.sum(F.pmod(F.xxhash64("tf", "term", F.lit(1)), F.lit(1 << 40))).alias("y"), F.count("*").alias("n"))
    sums = written(sums, "sums")
    return sums.join(sums.groupBy(*same).agg(F.min("note_id").alias("rep")), same).select(F.col("note_id").alias("id"), "rep")


def cosines_to(vec: DataFrame, note_id: str) -> DataFrame:
    """(id, score) of the other notes of vec that share a term with one of them."""
    own = vec.filter(F.col("id") == note_id).select("term", F.col("w").alias("q"))
    return vec.filter(F.col("id") != note_id).join(own, "term").groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("score"))


def similar_to(postings: DataFrame, total: int, note_id: str, threshold: float, limit: int) -> DataFrame:
    """(id, score) of the notes most similar to one. The one note's terms, as many as its words, are brought to all postings; products and squares are summed by note in each task before they are shuffled."""
    tf = term_weights(postings)
    own = written(vectors(postings, total, [note_id]).select("term", "df", F.col("w").alias("q")), "own")
    shared = tf.filter(F.col("note_id") != note_id).join(F.broadcast(own), "term").select("note_id", (_weight(total) * F.col("q")).alias("x"))
    products = shared.groupBy("note_id").agg(_total(F.col("x")).alias("product"))
    norms = _weights(tf, total).groupBy("note_id").agg(F.sqrt(_total(F.col("w") * F.col("w"))).alias("norm"))
    scored = products.join(norms, "note_id").select(F.col("note_id").alias("id"), (F.col("product") / F.col("norm")).alias("score"))
    return scored.filter(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(limit)


def _packed(weights: DataFrame, reps: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """(id, sketch, h, w, after) of the notes (note_id) in reps, in as many files as blocks. Each vector is one row: the hashes and weights of its terms, the rarest first, without terms of one note, which add nothing to a product;
    the lengths of what comes after each term of its prefix; and a sketch, the lengths of its parts by BUCKETS of hashes in 255ths rounded up, so that the products of two sketches' bytes bound the cosine from above."""

    def of_slice(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, sizes = b["v"].flatten(), np.diff(b["v"].offsets.to_numpy())
        h, w, df = (flat.field(c).to_numpy() for c in ("h", "w", "df"))
        row = np.repeat(np.arange(b.num_rows), sizes)
        order = np.lexsort((h, df, row))
        h, w, df, starts = h[order], w[order], df[order], np.cumsum(sizes) - sizes
        whole = np.floor(w * w)
        sums = np.add.reduceat(whole.astype(np.int64), starts) + np.add.reduceat(np.floor((w * w - whole) * FRACTION).astype(np.int64), starts) / FRACTION
        w = w / np.sqrt(sums)[row]
        shared = df > 1
        h, w, row = h[shared], w[shared], row[shared]
        lengths = np.sqrt(np.bincount(row * BUCKETS + h % BUCKETS, w * w, b.num_rows * BUCKETS)).reshape(b.num_rows, BUCKETS)
        sketch = np.minimum(np.ceil(lengths * 255), 255).astype(np.uint8)
        cuts = np.cumsum(np.bincount(row, minlength=b.num_rows))[:-1]
        hs, ws, afters = np.split(h, cuts), np.split(w, cuts), []
        for x in ws:
            rest = np.sqrt(np.cumsum((x * x)[::-1])[::-1])
            afters.append(np.append(rest[1:], 0.0)[: np.count_nonzero(rest >= threshold - 1e-9)])
        of = lambda parts: pa.array([p.tobytes() for p in parts], pa.binary())
        return pa.RecordBatch.from_arrays([b["id"], of(sketch), of(hs), of(ws), of(afters)], ["id", "sketch", "h", "w", "after"])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ends, at = b["v"].offsets.to_numpy(), 0
            while at < b.num_rows:  # a note is taken whole, however long
                end = max(int(np.searchsorted(ends, ends[at] + TERMS_AT_ONCE, "right")) - 1, at + 1)
                yield of_slice(b.slice(at, end - at))
                at = end

    terms = weights.select(F.col("note_id").alias("id"), F.struct(F.xxhash64("term").alias("h"), "w", "df").alias("t"), F.lit(None).cast("boolean").alias("rep"))
    marks = reps.select(F.col("note_id").alias("id"), F.lit(None).cast(terms.schema["t"].dataType).alias("t"), F.lit(True).alias("rep"))
    whole = terms.unionByName(marks).repartition(blocks, "id").groupBy("id").agg(F.collect_list("t").alias("v"), F.max("rep").alias("rep"))
    return written(whole.filter(F.col("rep") & (F.size("v") > 0)).select("id", "v").mapInArrow(rows, "id string, sketch binary, h binary, w binary, after binary"), "rows")


class _Block:
    """A file of packed vectors."""

    def __init__(self, path: str):
        store, name = open_store(path)
        t = pq.read_table(name, filesystem=store).combine_chunks()
        self.n, self.ids = t.num_rows, t["id"]
        self.sketch = np.frombuffer(_bytes(t["sketch"]), np.uint8).reshape(-1, BUCKETS)
        self.h, self.w, after = (np.frombuffer(_bytes(t[c]), k) for c, k in (("h", np.int64), ("w", np.float64), ("after", np.float64)))
        self.sizes, ahead = (pc.binary_length(t[c]).to_numpy().astype(np.int64) // 8 for c in ("h", "after"))
        self.starts = np.cumsum(self.sizes) - self.sizes
        row = np.repeat(np.arange(self.n), ahead)
        at = self.starts[row] + np.arange(len(row)) - (np.cumsum(ahead) - ahead)[row]
        order = np.argsort(self.h[at], kind="stable")
        #: The prefixes' terms by hash: of which row, with which weight, and the length of what comes after.
        self.term, self.row, self.weight, self.after = self.h[at][order], row[order], self.w[at][order], after[order]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The different hashes, and for each term the number of its own."""
        return np.unique(self.h, return_inverse=True)


def _bytes(column: pa.ChunkedArray) -> bytes:
    return b"".join(x.as_buffer() for x in column)


def _candidates(a: _Block, b: _Block, same: bool, threshold: float) -> np.ndarray:
    """Numbers row of a * rows of b + row of b of the pairs that share a term of both prefixes with a bound of the threshold, and whose sketches allow it; AT_ONCE pairs are held at a time."""
    first, last = np.searchsorted(b.term, a.term, "left"), np.searchsorted(b.term, a.term, "right")
    ends, found, at = np.cumsum(last - first), [], 0
    while at < len(a.term):
        before = ends[at - 1] if at else 0
        end = max(int(np.searchsorted(ends, before + AT_ONCE, "right")), at + 1)
        n = (last - first)[at:end]
        x = np.repeat(np.arange(at, end), n)
        y = first[x] + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        keep = a.weight[x] * b.weight[y] + a.after[x] * b.after[y] >= threshold - 1e-9
        if same:
            keep &= a.row[x] < b.row[y]
        found.append(np.unique(a.row[x[keep]] * b.n + b.row[y[keep]]))
        at = end
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    fits = [np.zeros(0, np.int64)]
    for k in range(0, len(pairs), SKETCHES_AT_ONCE):
        part = pairs[k : k + SKETCHES_AT_ONCE]
        x, y = a.sketch[part // b.n].astype(np.float32), b.sketch[part % b.n].astype(np.float32)
        fits.append(part[np.einsum("ij,ij->i", x, y) / 255.0**2 >= threshold - 1e-3])
    return np.concatenate(fits)


def _scores(a: _Block, b: _Block, pairs: np.ndarray) -> np.ndarray:
    """The cosines of pairs by their whole vectors: each row of a is laid out over a's terms, and what its rows of b have there is taken from it."""
    words, of = a.words
    mine, out = np.zeros(len(words) + 1), np.empty(len(pairs))
    used = np.unique(pairs % b.n)
    place = np.zeros(b.n, np.int64)
    sizes = b.sizes[used]
    place[used] = np.cumsum(sizes) - sizes
    at = np.repeat(b.starts[used], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h, w = b.h[at], b.w[at]
    there = np.minimum(np.searchsorted(words, h), len(words) - 1)
    there[words[there] != h] = len(words)  # a term that a hasn't, whose weight there stays 0
    rows, cols = pairs // b.n, pairs % b.n
    cuts = np.flatnonzero(np.diff(rows, prepend=-1))
    for k, end in zip(cuts, np.append(cuts[1:], len(pairs)), strict=True):
        own = slice(a.starts[rows[k]], a.starts[rows[k]] + a.sizes[rows[k]])
        mine[of[own]] = a.w[own]
        for p in range(k, end):
            s = slice(place[cols[p]], place[cols[p]] + b.sizes[cols[p]])
            out[p] = mine[there[s]] @ w[s]
        mine[of[own]] = 0.0
    return out


def near_duplicates(postings: DataFrame, total: int, threshold: float) -> DataFrame:
    """(id_a, id_b, score) of all pairs of different vectors with a cosine of at least the threshold, each vector by its rep (see copies), so that copies of a note make no pairs.

    Prefix filtering (Bayardo, Ma and Srikant, 2007): with terms by rarity, a note's rest of terms whose weights' length
    stays below the threshold can't reach it on its own, so a pair must share a term of both prefixes. Frequent terms
    come last and seldom enter a prefix. At the first term that a pair shares, its cosine is at most that term's product
    and the product of the lengths of what comes after it in both notes; so a pair counts only where this reaches the
    threshold. Of the pairs that pass, those whose sketches bound the cosine below the threshold go before their terms
    are looked at; the others are verified by the whole cosine.

    Vectors are shuffled once, to blocks of about TERMS_AT_ONCE terms, a file each. A task holds one block and reads others beside
    it, one after the other, so that candidates never leave a task and only what is near is written.
    """
    spark = postings.sparkSession
    reps = written(copies(postings).filter("id = rep").select(F.col("id").alias("note_id")), "reps")
    tf = term_weights(postings)
    weights = _weights(tf, total)
    blocks = max(spark.sparkContext.defaultParallelism, -(-tf.count() // TERMS_AT_ONCE))
    files = sorted(_packed(weights, reps, threshold, blocks).inputFiles())
    strip = max(1, len(files) // 16)
    strips = [(i, j) for i in range(len(files)) for j in range(i, len(files), strip)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, first in (strips[k] for batch in it for k in batch.column(0).to_pylist()):
            a = _Block(files[i])
            for j in range(first, min(first + strip, len(files))):
                b = a if i == j else _Block(files[j])
                pairs = _candidates(a, b, i == j, threshold)
                if not len(pairs):
                    continue
                scores = _scores(a, b, pairs)
                near = scores >= threshold
                x, y = (block.ids.take(pa.array(rows)).to_pylist() for block, rows in ((a, pairs[near] // b.n), (b, pairs[near] % b.n)))
                low, high = ([f(p, q, key=str.encode) for p, q in zip(x, y, strict=True)] for f in (min, max))
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.string()), pa.array(high, pa.string()), pa.array(scores[near])], ["id_a", "id_b", "score"])

    tasks = spark.range(0, len(strips), 1, max(len(strips), 1))
    return written(tasks.mapInArrow(run, "id_a string, id_b string, score double"), "near")


def duplicate_classes(postings: DataFrame, total: int, threshold: float) -> DataFrame:
    """(id, rep, class_id, n_links) of every note: its rep, the least id of the notes that chains of near-duplicates join, and how many different vectors are near its own."""
    of = written(copies(postings), "copies")
    pairs = written(near_duplicates(postings, total, threshold).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")), "pairs")
    links = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy(F.col("src").alias("rep")).agg(F.count("*").alias("n_links"))
    classes = components(pairs).withColumnRenamed("id", "rep")
    out = of.join(links, "rep", "left").join(classes, "rep", "left")
    return out.select("id", "rep", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def shared_tags(tags: DataFrame, note_id: str, limit: int) -> DataFrame:
    """(id, score) by the share of common tags."""
    counts = tags.groupBy("note_id").agg(F.count("*").alias("n"))
    own = tags.filter(F.col("note_id") == note_id)
    common = tags.filter(F.col("note_id") != note_id).join(own.select("tag"), "tag", "left_semi").groupBy("note_id").agg(F.count("*").alias("k"))
    mine = own.agg(F.count("*").alias("m"))
    scored = common.join(counts, "note_id").join(mine).select(F.col("note_id").alias("id"), (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def second_neighbours(edges: DataFrame, note_id: str, limit: int | None) -> DataFrame:
    """(id, score) of notes two links away, by the number of links that lead there, without the note and its neighbours; all with limit None."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    first = both.filter(F.col("src") == note_id).select(F.col("dst").alias("src")).distinct()
    second = both.join(first, "src", "left_semi").filter(F.col("dst") != note_id).select(F.col("dst").alias("id"))
    out = second.join(first.select(F.col("src").alias("id")), "id", "left_anti").groupBy("id").agg(F.count("*").cast("double").alias("score"))
    out = out.orderBy(F.desc("score"), "id")
    return out if limit is None else out.limit(limit)


def related(parts: list[DataFrame], seen: DataFrame) -> DataFrame:
    """The best score of each id over (id, score) parts, without those seen."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return keep_latest(out.join(seen, "id", "left_anti"), ["id"], F.desc("score"))
