"""Passages that repeat what a document with a smaller id holds, found by run-length compressed indexes.

Every string of MIN_BYTES bytes has a least fingerprint among those of its strings of GRAM bytes, and equal strings have the
same. So a document is a row of pieces: strings of bytes next to each other that share their least fingerprint, with their
overlap, at most PIECE bytes. Whatever repeats has a fingerprint that repeats. Fingerprints are counted in buckets of a
hash, 4 bytes each, and those that occur again go into a filter of at most FILTER_BYTES that all tasks get; pieces of others
are left out (one that gets through wrongly costs time only; on inputs so large that the filter is full, all do).

Equal pieces count once, with the least id that has them. Pieces of some fingerprints make up a bucket. Those that share
more than the fingerprint with another, enough for a string of MIN_BYTES bytes on one side of it, go into the bucket's
index: the Burrows-Wheeler transform of its pieces in runs, a run ending where the preceding byte changes or
where the next MIN_BYTES bytes do, and at each run's end a sample, the least id of the run. Every piece then streams through
the index from its end to its start, a step to the left for each byte: the matching statistics of a place in it are the
interval of rows that go on with the same MIN_BYTES bytes, and the interval's samples give the least id of all. A document
takes these numbers for its pieces; bytes of strings with an id smaller than its own are removed.

A fingerprint with more than HOT different pieces would make a bucket too large. For those every string of MIN_BYTES bytes
is a row of its own, and its least id an aggregation by the string, so nothing is left out.

Equal strings have the same fingerprint, so fingerprints are dealt out to rounds, which need nothing of each other: what a
round shuffles and writes goes when its spans are found, and the disk holds all pieces and one round's tables at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.storage import remove, scratch

from .common import blank_if_null, new_path, table, written

MIN_BYTES, GRAM = 50, 16
SPREAD = MIN_BYTES - GRAM + 1
PIECE = MIN_BYTES + SPREAD - 1
#: Places that a task looks at in one go, fingerprints in a bucket, bytes of all pieces for a bucket's index on average.
CHUNK, FINGERPRINTS, INDEX_BYTES = 1 << 19, 4_000_000, 500_000
FILTER_BYTES, BITS_EACH = 64 << 20, 16
HOT = 10_000
#: Bytes of texts whose pieces are compared in a round, by a hash of their fingerprints, and rounds at most.
ROUND_BYTES, MOST_ROUNDS = 128 << 20, 16
PIECE_ID = ["key", "one", "two"]
#: Bits of a place in an index that is sorted by packed numbers; larger ones are sorted more slowly.
PLACE = 21

_ODD, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_PROBES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_BYTES = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Setting by which Spark removes a query's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Setting by which a task writes so many folders side by side, without a sort.
SIDE_BY_SIDE = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside the block, what queries have shuffled goes when they end, since what they give is written; folders of rounds are written without a sort."""
    old = spark.conf.get(CLEAN, "false"), spark.conf.get(SIDE_BY_SIDE, "0")
    spark.conf.set(CLEAN, "true")
    spark.conf.set(SIDE_BY_SIDE, str(MOST_ROUNDS))
    try:
        yield
    finally:
        spark.conf.set(CLEAN, old[0])
        spark.conf.set(SIDE_BY_SIDE, old[1])


def _powers(n: int, held: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of an odd number and of its inverse modulo 2^64."""
    if held.get("n", -1) < n:
        inverse = 1
        for _ in range(6):
            inverse = inverse * (2 - int(_ODD) * inverse) % 2**64
        ones = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))])
        held.update(n=n, up=ones(_ODD), down=ones(np.uint64(inverse)))
    return held["up"], held["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def fingerprints(data: np.ndarray) -> np.ndarray:
    """The fingerprint of every string of GRAM bytes of data."""
    n = len(data)
    up, down = _powers(max(n, CHUNK + MIN_BYTES))
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=upto[1:])
    return _mixed((upto[GRAM:] - upto[:-GRAM]) * down[: n - GRAM + 1])


def least_of(grams: np.ndarray) -> np.ndarray:
    """The least of every SPREAD fingerprints next to each other."""
    low, span, n = grams, 1, len(grams) - SPREAD + 1
    while span * 2 <= SPREAD:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    return np.minimum(low[:n], low[SPREAD - span : SPREAD - span + n])


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after the other, and where each value begins and the last one ends."""
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    _, places, data = col.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


class Pieces:
    """Pieces of documents from one stretch of bytes: their fingerprints, where they start, how many bytes they have, and the place of their document."""

    def __init__(self, key: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, grams: np.ndarray, base: int):
        self.key, self.start, self.size, self.doc, self._grams, self._base = key, start, size, doc, grams, base

    def of(self, keep: np.ndarray) -> Pieces:
        return Pieces(self.key[keep], self.start[keep], self.size[keep], self.doc[keep], self._grams, self._base)

    def gram(self) -> np.ndarray:
        """Where in each piece its fingerprint stands; -1 if it does more than once."""
        at = (self.start - self._base)[:, None] + np.arange(PIECE - GRAM + 1)
        inside = np.arange(PIECE - GRAM + 1) <= (self.size - GRAM)[:, None]
        same = (self._grams[np.minimum(at, len(self._grams) - 1)] == self.key[:, None]) & inside
        return np.where(same.sum(1) == 1, same.argmax(1), -1)


def pieces_of(data: np.ndarray, at: np.ndarray) -> Iterator[Pieces]:
    """The pieces of documents that lie in data from at[i] to at[i + 1]."""
    first, last = int(at[0]), int(at[-1]) - MIN_BYTES + 1
    for x in range(first, last, CHUNK):
        y = min(x + CHUNK, last)
        grams = fingerprints(data[x : y + MIN_BYTES - 1])
        low = least_of(grams)
        i, j = np.searchsorted(at, [x, y - 1], "right") - 1
        ends = at[i + 1 : j + 2]
        counts = np.minimum(ends, y) - np.maximum(at[i : j + 1], x)
        doc = np.repeat(np.arange(i, j + 1), counts)
        inside = np.flatnonzero(np.arange(x, y) + MIN_BYTES <= np.repeat(ends, counts))
        if not len(inside):
            continue
        low, doc = low[inside], doc[inside]
        begins = np.ones(len(low), bool)
        begins[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        since = np.arange(len(low)) - np.maximum.accumulate(np.where(begins, np.arange(len(low)), 0))
        begins |= since % SPREAD == 0
        start = np.flatnonzero(begins)
        yield Pieces(low[start], inside[start] + x, np.diff(np.append(start, len(low))) + MIN_BYTES - 1, doc[start], grams, x)


def _bucketed(fingerprints: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and rest, 32 bits, of fingerprints; least ones are far from even, so they are mixed again."""
    h = _mixed(fingerprints + _ODD)
    return (h >> np.uint64(32)) % np.uint64(buckets), h & np.uint64(0xFFFFFFFF)


class Filter:
    """A Bloom filter with a slice for each bucket."""

    def __init__(self, slices: dict[int, bytes], buckets: int):
        self.buckets = buckets
        size = np.array([len(slices.get(i, b"")) for i in range(buckets)], np.int64)
        self.base = (np.cumsum(size) - size) * 8
        self.bits = np.array([max(int(s * 8).bit_length() - 1, 0) for s in size], np.uint64)
        self.data = np.frombuffer(b"".join(slices.get(i, b"") for i in range(buckets)), np.uint8)
        self.empty = size == 0

    @staticmethod
    def slice_of(rest: np.ndarray, most: int) -> bytes:
        """The slice of a bucket with these rests: BITS_EACH bits for each, at most so many bytes, to the next power of two."""
        bits = min(max(9, int(BITS_EACH * max(len(rest), 1) - 1).bit_length()), max(9, int(most * 8).bit_length() - 1))
        out = np.zeros(1 << bits, bool)
        for p in _PROBES:
            out[(rest * p) >> np.uint64(64 - bits)] = True
        return np.packbits(out, bitorder="little").tobytes()

    def may_hold(self, fingerprints: np.ndarray) -> np.ndarray:
        bucket, rest = _bucketed(fingerprints, self.buckets)
        bucket = bucket.astype(np.int64)
        out = ~self.empty[bucket]
        bucket, rest = bucket[out], rest[out]
        found = np.ones(len(rest), bool)
        for p in _PROBES:
            place = self.base[bucket] + ((rest * p) >> (np.uint64(64) - self.bits[bucket])).astype(np.int64)
            found &= (self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        out[out] = found
        return out


def repeated_fingerprints(texts: DataFrame, total: int, most: int = FILTER_BYTES) -> Filter:
    """A filter that holds every fingerprint that two pieces have, by counts in buckets."""
    spark = texts.sparkSession
    buckets = max(1, -(-total // (FINGERPRINTS * SPREAD // 2)))

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            parts = [p.key for p in pieces_of(*bytes_of(b.column("text")))] if b.num_rows else []
            if not parts:
                continue
            bucket, rest = _bucketed(np.concatenate(parts), buckets)
            keys, counts = np.unique(bucket << np.uint64(32) | rest, return_counts=True)
            own, begins = np.unique(keys >> np.uint64(32), return_index=True)
            cuts = [*begins.tolist(), len(keys)]
            once = [keys[lo:hi].astype(np.uint32).tobytes() for lo, hi in zip(cuts, cuts[1:], strict=False)]
            more = [keys[lo:hi][counts[lo:hi] > 1].astype(np.uint32).tobytes() for lo, hi in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["bucket", "once", "more"])

    def count(t: pa.Table) -> pa.Table:
        join = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32)
        rest = np.sort(join("once"))
        again = np.unique(np.concatenate([rest[1:][rest[1:] == rest[:-1]], join("more")])).astype(np.uint64)
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "slice": pa.array([Filter.slice_of(again, most // buckets)] if len(again) else [b""], pa.binary())})

    found = texts.select("text").mapInArrow(emit, "bucket long, once binary, more binary").groupBy("bucket").applyInArrow(count, "bucket long, slice binary").collect()
    return Filter({r["bucket"]: bytes(r["slice"]) for r in found if r["slice"]}, buckets)


def occurrences(texts: DataFrame, total: int, most: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, row, at, key, gram, piece) of pieces of texts (doc_id, row, text) whose fingerprint may occur again; at is where the piece begins, gram where its fingerprint stands in it."""
    held = texts.sparkSession.sparkContext.broadcast(repeated_fingerprints(texts, total, most))
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in it:
            if not b.num_rows:
                continue
            data, at = bytes_of(b.column("text"))
            for p in pieces_of(data, at):
                p = p.of(known.may_hold(p.key))
                ends = np.cumsum(p.size)
                source = np.repeat(p.start - (ends - p.size), p.size) + np.arange(ends[-1] if len(ends) else 0)
                places = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))
                piece = pa.Array.from_buffers(pa.binary(), len(ends), [None, places, pa.py_buffer(data[source])])
                take = pa.array(p.doc)
                columns = [b.column("doc_id").take(take), b.column("row").take(take), pa.array(p.start - at[p.doc]), pa.array(p.key.view(np.int64)), pa.array(p.gram().astype(np.int32)), piece]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "at", "key", "gram", "piece"])

    return texts.select("doc_id", "row", "text").mapInArrow(emit, f"doc_id {id_type}, row long, at long, key long, gram int, piece binary")


def linked(data: np.ndarray, at: np.ndarray, key: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Which pieces can share a string of MIN_BYTES bytes with another of the same fingerprint.

    Such a string holds the fingerprint's bytes and, before or after them, half of what it is longer, so both pieces have
    these on the same side. A fingerprint that some piece has twice can stand in a string in two ways; all its pieces pass.
    """
    half = GRAM + (MIN_BYTES - GRAM + 1) // 2
    size, out = np.diff(at), np.isin(key, key[gram < 0])
    for start in (gram - (half - GRAM), gram):
        fits = np.flatnonzero((gram >= 0) & (start >= 0) & (start + half <= size))
        if not len(fits):
            continue
        block = np.zeros((len(fits), -(-half // 8) * 8), np.uint8)
        block[:, :half] = data[(at[fits] + start[fits])[:, None] + np.arange(half)]
        h = _mixed(key[fits].view(np.uint64))
        for word in block.view(np.uint64).T:
            h = _mixed(h * _ODD + word)
        _, back, counts = np.unique(h, return_inverse=True, return_counts=True)
        out[fits[counts[back] > 1]] = True
    return out


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of pieces, each with a number; pieces end with signs below all bytes, in their order."""

    def __init__(self, data: np.ndarray, at: np.ndarray, number: np.ndarray):
        size = np.diff(at)
        self.size, m = size, len(size)
        n = int(size.sum()) + m
        signs, end = np.zeros(n, np.int64), np.repeat(np.cumsum(size + 1) - 1, size + 1)
        body = np.ones(n, bool)
        body[np.cumsum(size + 1) - 1] = False
        signs[body] = data[at[0] : at[-1]].astype(np.int64) + 1
        self.origin = np.cumsum(size + 1) - size - 1
        order, (known, ranks) = self._sorted(signs, end)
        before = signs[order - 1]
        new = np.ones(n, bool)  # rows whose next MIN_BYTES bytes differ from the last row's
        far = ranks[np.minimum(order + MIN_BYTES - known, end[order])]
        near = ranks[order]
        new[1:] = (near[1:] != near[:-1]) | (far[1:] != far[:-1]) | (end[order[1:]] - order[1:] < MIN_BYTES)
        ends = new.copy()
        ends[1:] |= before[1:] != before[:-1]
        self.start = np.flatnonzero(ends)
        self.sign = before[self.start]
        piece = np.repeat(np.arange(m), size + 1)
        sample = np.minimum.reduceat(number[piece[order]], self.start)
        same = np.cumsum(new)[self.start] - 1  # which interval of equal next bytes a run belongs to
        self.least = np.minimum.reduceat(sample, np.searchsorted(same, np.arange(same[-1] + 1)))[same]
        count = np.bincount(signs, minlength=257)
        below = np.cumsum(count) - count
        length = np.diff(np.append(self.start, n))
        by_sign = np.argsort(self.sign, kind="stable")
        seen = np.cumsum(length[by_sign]) - length[by_sign]
        firsts = np.searchsorted(self.sign[by_sign], np.arange(257))
        seen -= seen[np.minimum(firsts, len(seen) - 1)][self.sign[by_sign]]
        self.to = np.empty(len(seen), np.int64)
        self.to[by_sign] = seen
        self.to += below[self.sign] - self.start  # a row of a run steps to this plus its own place

    @staticmethod
    def _sorted(signs: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, tuple[int, np.ndarray]]:
        """The rows' places in the text in the order of their suffixes, by doubling of prefixes, and a number of signs, half of MIN_BYTES to all, with the ranks of all places by so many."""
        n = len(signs)
        here = np.arange(n)

        def ranked(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
            key = high.astype(np.uint64) << np.uint64(bits) | low.astype(np.uint64)
            if n <= 1 << PLACE:
                packed = np.sort(key << np.uint64(PLACE) | here.astype(np.uint64))
                order, key = (packed & np.uint64((1 << PLACE) - 1)).astype(np.int64), packed >> np.uint64(PLACE)
            else:
                order = np.argsort(key, kind="stable")
                key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            return order, rank

        present = np.flatnonzero(np.bincount(signs, minlength=257))
        dense = np.zeros(257, np.int64)
        dense[present] = np.arange(len(present))
        dense, width = dense[signs], max(1, int(len(present) - 1).bit_length())
        room = 64 - PLACE if n <= 1 << PLACE else 62
        reach, key = 1, dense
        while (reach + 1) * width <= room and reach < MIN_BYTES // 2 + 1:
            key = key << width | dense[np.minimum(here + reach, end)]
            reach += 1
        order, rank = ranked(key, np.zeros(1, np.int64), 0)
        bits, half = (PLACE if n <= 1 << PLACE else 31), None
        while reach < PIECE + 1:
            half = (reach, rank) if MIN_BYTES // 2 <= reach <= MIN_BYTES else half
            order, rank = ranked(rank, rank[np.minimum(here + reach, end)], bits)
            reach *= 2
        return order, half

    def stream(self) -> np.ndarray:
        """For every place of every piece, with a place for its end, the least number of pieces that hold its next MIN_BYTES bytes; -1 where fewer are left. All pieces go one sign to the left at a time."""
        out = np.full(int(self.size.sum()) + len(self.size), -1, np.int64)
        longest = np.argsort(-self.size, kind="stable")
        size, row = self.size[longest], longest.copy()  # the suffix of a piece's end is the row of its own place among the pieces
        last = self.origin[longest] + size
        run = np.searchsorted(self.start, row, "right") - 1
        for t in range(1, int(size[0]) + 1 if len(size) else 0):
            active = int(np.searchsorted(-size, -t, "right"))
            row = row[:active] + self.to[run[:active]]
            run = np.searchsorted(self.start, row, "right") - 1
            if t >= MIN_BYTES:
                out[last[:active] - t] = self.least[run]
        return out


def _answers(t: pa.Table, id_type: pa.DataType) -> pa.Table:
    """(key, one, two, spans) of the pieces of a bucket (key, one, two, gram, piece, first): for strings of MIN_BYTES bytes from off on, so many in a row, the least id that has them. Pieces that share no string with another have their own."""
    b = t.combine_chunks().to_batches()[0]
    data, at = bytes_of(b.column("piece"))
    ids, number = np.unique(b.column("first").to_numpy(zero_copy_only=False), return_inverse=True)
    strings = np.diff(at) - MIN_BYTES + 1
    origin = np.cumsum(strings) - strings
    least = np.repeat(number, strings)
    some = np.flatnonzero(linked(data, at, b.column("key").to_numpy(), b.column("gram").to_numpy()))
    if len(some):
        own, places = bytes_of(b.column("piece").take(pa.array(some)))
        streamed = RunIndex(own, places, number[some]).stream()
        n = strings[some]
        least[np.repeat(origin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = streamed[streamed >= 0]
    piece = np.repeat(np.arange(len(strings)), strings)
    begins = np.ones(len(piece), bool)
    begins[1:] = (piece[1:] != piece[:-1]) | (least[1:] != least[:-1])
    start = np.flatnonzero(begins)
    values = pa.StructArray.from_arrays([pa.array((start - origin[piece[start]]).astype(np.int32)), pa.array(np.diff(np.append(start, len(piece))).astype(np.int32)), pa.array(ids[least[start]], id_type)], ["off", "n", "first"])
    lists = np.concatenate([[0], np.cumsum(np.bincount(piece[start], minlength=len(strings)))]).astype(np.int32)
    return pa.table({**{c: b.column(c) for c in PIECE_ID}, "spans": pa.ListArray.from_arrays(pa.array(lists), values)})


def _piece_id() -> list[Column]:
    """What tells a piece (key, piece) from all others: its fingerprint and two hashes of its bytes, 192 bits."""
    return [F.col("key"), F.xxhash64("piece").alias("one"), F.xxhash64(F.lit(MIN_BYTES), "piece").alias("two")]


def answers(distinct: DataFrame, pieces: int, hot_over: int = HOT) -> DataFrame:
    """(key, one, two, spans) of different pieces (key, gram, piece, first), for as many occurrences: by an index for each bucket of fingerprints, or for those with more than hot_over pieces by aggregation over single strings."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = distinct.schema["first"].dataType
    kind = to_arrow_type(id_type)
    buckets = max(1, pieces * PIECE // INDEX_BYTES)
    hot = written(distinct.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_over).select("key"), "hot")
    some = not hot.isEmpty()
    rest = distinct.join(hot, "key", "left_anti") if some else distinct
    schema = f"key long, one long, two long, spans array<struct<off:int,n:int,first:{id_type.simpleString()}>>"
    out = rest.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), *_piece_id(), "gram", "piece", "first").groupBy("bucket").applyInArrow(lambda t: _answers(t.drop_columns(["bucket"]), kind), schema)
    if some:
        each = distinct.join(hot, "key", "left_semi").select(*_piece_id(), "first", "piece", F.explode(F.sequence(F.lit(0), F.octet_length("piece") - MIN_BYTES)).alias("off"))
        each = each.select(*PIECE_ID, "off", "first", F.substring("piece", F.col("off") + 1, F.lit(MIN_BYTES)).alias("string"))
        each = written(each, "strings")
        least = written(each.groupBy("string").agg(F.min("first").alias("least")), "least")  # a table of its own, so that the join of a hot string can be split
        single = F.struct("off", F.lit(1).alias("n"), F.col("least").alias("first"))
        out = out.unionByName(each.join(least, "string").groupBy(*PIECE_ID).agg(F.collect_list(single).alias("spans")))
    return out


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the spans (start, end) out of texts: those of all texts of a batch are put in order and joined to runs at once."""
    for b in it:
        data, at = bytes_of(b.column("text"))
        size = np.diff(at)
        lists, spans = b.column("spans"), b.column("spans").flatten()
        row = np.repeat(np.arange(len(size)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        base = np.cumsum(size + 1) - size - 1  # a place between texts, so that no run goes from one to the next
        start, end = (pc.struct_field(spans, c).to_numpy(zero_copy_only=False).astype(np.int64) + base[row] for c in ("start", "end"))
        order = np.argsort(start, kind="stable")
        row, start, reach = row[order], start[order], np.maximum.accumulate(end[order])
        first = np.flatnonzero(np.concatenate([np.ones(min(len(row), 1), bool), start[1:] > reach[:-1]]))
        last = np.append(first[1:], len(row))[: len(first)] - 1
        row, start, reach = row[first], start[first], reach[last]
        runs = np.bincount(row, minlength=len(size))
        removed = np.bincount(row, reach - start, minlength=len(size)).astype(np.int64)
        where, digests, k = memoryview(data), [], 0
        moved = at[row] - base[row]
        froms, tos = (start + moved).tolist(), (reach + moved).tolist()
        for begin, end, n in zip(at[:-1].tolist(), at[1:].tolist(), runs.tolist(), strict=True):
            digest = hashlib.sha256()
            for k in range(k, k + n):
                digest.update(where[begin : froms[k]])
                begin = tos[k]
            k += n > 0
            digest.update(where[begin:end])
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(removed), pa.array(runs.astype(np.int64)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _spans(found: DataFrame, hot_over: int) -> DataFrame:
    """(doc_id, row, spans) of documents with bytes that go, by all pieces (see occurrences) of some fingerprints."""
    spark, path = found.sparkSession, new_path(found.sparkSession, "distinct")
    distinct = found.groupBy("key", "gram", "piece").agg(F.min("doc_id").alias("first"))
    distinct.write.option("compression", "zstd").parquet(path)
    spans = written(answers(spark.read.schema(distinct.schema).parquet(path), found.count(), hot_over), "answers")
    remove(spark, path)
    places = found.select("doc_id", "row", "at", *_piece_id()).join(spans, PIECE_ID)
    removed = places.select("doc_id", "row", "at", F.explode(F.filter("spans", lambda s: s["first"] < F.col("doc_id"))).alias("s"))
    start = F.col("at") + F.col("s.off")
    return removed.groupBy("doc_id", "row").agg(F.collect_list(F.struct(start.alias("start"), (start + F.col("s.n") + MIN_BYTES - 1).alias("end"))).alias("spans"))


def removals(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", hot_over: int = HOT, most: int = FILTER_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(doc_id, row, text, spans): every row with its text as bytes, and the spans (start, end) of bytes that a document with a smaller id has in a string of MIN_BYTES bytes; spans may overlap.

    A null text is empty. A null id is smaller than none and none is smaller than it, so nothing is removed there; rows of
    one id don't remove each other's bytes. row is a hash of the text, so that rows of one id are told apart.
    """
    text = blank_if_null(F.col(f"`{text_col}`"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text"))
    known = texts.filter("doc_id is not null")
    total = docs.agg(F.sum(F.octet_length(text)).cast("long")).first()[0] or 0
    rounds = min(max(1, -(-total // round_bytes)), MOST_ROUNDS)
    spark = docs.sparkSession
    pieces, marks = new_path(spark, "pieces"), new_path(spark, "marks")
    with shuffles_removed(spark):
        found = occurrences(known, total, most).withColumn("part", F.pmod(F.xxhash64("key", F.lit(rounds)), F.lit(rounds)).cast("int"))  # another hash than that of buckets
        found.write.option("compression", "zstd").partitionBy("part").parquet(pieces)
        schema = None
        for k in range(rounds):
            with scratch(spark):
                out = _spans(spark.read.schema(found.schema).parquet(pieces).filter(F.col("part") == k).drop("part"), hot_over)
                out.write.mode("append").option("compression", "zstd").parquet(marks)
                schema = out.schema
            remove(spark, f"{pieces}/part={k}")
        found = spark.read.schema(schema).parquet(marks)
        if rounds > 1:
            found = written(found.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans")), "all-marks")
    return texts.join(found, ["doc_id", "row"], "left")


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", hot_over: int = HOT, most: int = FILTER_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; see removals. Repeated rows give a row each; an empty table gives an empty one; extra columns play no part."""
    id_type = docs.schema[id_col].dataType.simpleString()
    return removals(docs, text_col, id_col, hot_over, most, round_bytes).select("doc_id", "text", "spans").mapInArrow(_cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of documents before it."""
    return dedup(table(spark, sf_dir, "documents"))
