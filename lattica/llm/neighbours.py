"""Approximate nearest neighbours by largest inner product.

Vectors are dealt into partitions by coarse centroids; what remains is quantised by products of two-dimensional codebooks
of 16 entries. Codes are score-aware (Guo et al., 2020, "Accelerating Large-Scale Inference with Anisotropic Vector
Quantization"): error parallel to the vector, which changes large inner products, weighs ETA times as much as error
across it. A query scans its best partitions by tables of 16 products for each codebook (two four-bit codes a byte, so
tables of 256 for each pair). The RERANK best of each block are scored exactly, and so is every other vector of the block
whose codes, within their error, allow it among the best: in what it looks into, a search misses nothing.

Codebooks are fitted on a bounded sample of FIT_ROWS vectors drawn by a hash of the id; every vector is indexed. Partitions
are dealt out in blocks of at most about BLOCK rows and BLOCK queries, whatever their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

TOP, RERANK = 20, 300
FIT_ROWS, BLOCK = 8192, 16384
#: A partition for about so many vectors, at most MOST_PARTITIONS. A query looks into as many of them as hold the part
#: COVER of the true nearest of sampled queries among the sample; where vectors form no clusters, that is nearly all.
PARTITION_ROWS, MOST_PARTITIONS, COVER, TRIED = 16384, 1024, 0.97, 400
SCORE_THRESHOLD = 0.2
#: A float array comes to the driver for each partition and codebook entry, so the dimension bounds the model.
SUBDIM, CODES = 2, 16


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part: not null or zero, without null or non-finite components; a null id takes no part."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    limit = float(np.finfo(np.float64).max)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= limit)) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


class Index:
    """Coarse centroids and codebooks for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n, self.dim = sample.shape
        self.parts = max(1, min(MOST_PARTITIONS, -(-rows // PARTITION_ROWS), n))
        self.centroids = self._kmeans(sample, self.parts, rng)
        self.parts = len(self.centroids)
        t2 = SCORE_THRESHOLD**2
        self.eta = max(1.0, (self.dim - 1) * t2 / (1 - t2))
        pad = -self.dim % (2 * SUBDIM)  # pairs of codes share a byte
        self.width = self.dim + pad
        self.books = self._fit(sample, rng)
        self.looks = self._calibrate(sample, rng)

    def _calibrate(self, sample: np.ndarray, rng: np.random.Generator) -> int:
        tried = rng.permutation(len(sample))[:TRIED]
        part, order = self.part_of(sample), self._order(sample[tried])
        seen = np.zeros(self.parts)
        for i, own in zip(tried, order, strict=True):
            score = sample @ sample[i]
            score[i] = -np.inf
            places = np.argsort(own)  # of each partition in the query's order
            seen += np.bincount(places[part[np.argsort(-score, kind="stable")[: min(TOP, len(sample) - 1)]]], minlength=self.parts)
        covered = np.cumsum(seen) / max(seen.sum(), 1)
        return int(np.searchsorted(covered, COVER)) + 1 if seen.sum() else self.parts

    @staticmethod
    def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
        centres = x[rng.permutation(len(x))[:k]].copy()
        for _ in range(rounds):
            near = ((x @ centres.T) - 0.5 * (centres**2).sum(1)).argmax(1)
            for c in range(len(centres)):
                own = x[near == c]
                if len(own):
                    centres[c] = own.mean(0)
        return centres

    def part_of(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.centroids.T) - 0.5 * (self.centroids**2).sum(1)).argmax(1)

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Partition, residual and direction of vectors, the last two by codebook."""
        part = self.part_of(x)
        padded = lambda y: np.pad(y, ((0, 0), (0, self.width - self.dim))).reshape(len(y), -1, SUBDIM)
        norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return part, padded(x - self.centroids[part]), padded(x / norm)

    def _assign(self, rest: np.ndarray, way: np.ndarray, books: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes that lessen |error|^2 + (eta - 1) (error along the vector)^2, one codebook after the other."""
        n, m, _ = rest.shape
        codes = np.empty((n, m), np.int64)
        along = np.zeros((n, m))
        for r in range(rounds + 1):
            for j in range(m):
                error = rest[:, j, None, :] - books[j][None]
                own = (error * way[:, j, None, :]).sum(2)
                others = along.sum(1) - along[:, j]
                cost = (error**2).sum(2) + (self.eta - 1) * ((others[:, None] + own) ** 2 if r else own**2)
                codes[:, j] = cost.argmin(1)
                along[:, j] = own[np.arange(n), codes[:, j]]
        return codes

    def _fit(self, sample: np.ndarray, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
        _, rest, way = self._split(sample)
        n, m, d = rest.shape
        books = np.stack([np.resize(self._kmeans(rest[:, j], min(CODES, n), rng, 6), (CODES, d)) for j in range(m)])
        for _ in range(rounds):
            codes = self._assign(rest, way, books, 1)
            error = rest - books[np.arange(m)[None], codes]
            along = (error * way).sum(2)
            for j in range(m):
                others = along.sum(1) - along[:, j]
                for c in range(CODES):
                    own = codes[:, j] == c
                    if not own.any():
                        continue
                    x, u, o = rest[own, j], way[own, j], others[own]
                    left = len(x) * np.eye(d) + (self.eta - 1) * u.T @ u
                    right = x.sum(0) + (self.eta - 1) * ((o + (x * u).sum(1))[:, None] * u).sum(0)
                    books[j, c] = np.linalg.solve(left, right)
        return books

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partitions, and two codes a byte."""
        part, rest, way = self._split(x)
        codes = self._assign(rest, way, self.books).astype(np.uint8)
        return part, codes[:, ::2] << 4 | codes[:, 1::2]

    def _order(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")

    def probes(self, q: np.ndarray) -> np.ndarray:
        return self._order(q)[:, : min(self.parts, max(2, self.looks))]

    def scan(self, q: np.ndarray, part: int, codes: np.ndarray) -> np.ndarray:
        """Approximate scores of queries (rows) with coded vectors of a partition (columns)."""
        padded = np.pad(q, ((0, 0), (0, self.width - self.dim))).reshape(len(q), -1, SUBDIM)
        tables = np.einsum("qmd,mcd->mqc", padded, self.books).astype(np.float32)
        pairs = (tables[::2, :, :, None] + tables[1::2, :, None, :]).reshape(len(tables) // 2, len(q), CODES * CODES)
        out = np.repeat((q @ self.centroids[part])[:, None].astype(np.float32), len(codes), 1)
        for j in range(codes.shape[1]):
            out += pairs[j][:, codes[:, j]]
        return out


    def missed(self, x: np.ndarray, part: int, codes: np.ndarray) -> np.ndarray:
        """How far each coded vector of a partition lies from what its codes say: times a query's length, this bounds the error of a score."""
        each = np.stack([codes >> 4, codes & 15], 2).reshape(len(codes), -1)
        said = self.books[np.arange(each.shape[1])[None], each].reshape(len(codes), -1)[:, : self.dim] + self.centroids[part]
        return np.linalg.norm(x - said, axis=1)


def fit(cleaned: DataFrame) -> dict[int, Index]:
    """An index for each dimension that occurs; vectors of different dimensions have no inner product."""
    out = {}
    sizes = cleaned.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").collect()
    for r in sizes:
        part = min(1 << 30, int(FIT_ROWS * (1 << 30) / r["n"]) + 1)
        drawn = cleaned.filter((F.size("v") == r["d"]) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part)).select("v").limit(2 * FIT_ROWS)
        sample = np.array([x["v"] for x in drawn.collect()], np.float64)
        if not len(sample):
            sample = np.array([x["v"] for x in cleaned.filter(F.size("v") == r["d"]).select("v").limit(1).collect()], np.float64)
        out[r["d"]] = Index(sample, r["n"])
    return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_dimension(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.array(pa.compute.list_value_length(b.column(b.schema.get_field_index("v"))).to_pylist())
    for d in np.unique(sizes):
        yield int(d), b.take(pa.array(np.nonzero(sizes == d)[0]))


def search(vectors: DataFrame, is_query, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the top nearest found of each query, a row of vectors for which is_query(id) holds.

    Scores are exact. Ties go to the smaller id; rows that repeat an id are all queries and candidates, but for a query
    those of its own id. Vectors that are null, zero or not finite take no part, nor do null ids. An empty table gives an
    empty one; extra columns, whatever their names, play no part. Vectors of other dimensions are never near. Ids are integers,
    or texts of integers; others fail under ANSI mode.
    """
    import pyarrow.compute  # noqa: F401

    spark = vectors.sparkSession
    cleaned = clean(vectors, id_col, vector_col)
    shared = spark.sparkContext.broadcast(fit(cleaned))

    def coded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for b in it:
            for d, part in _by_dimension(b):
                at, codes = shared.value[d].encode(_matrix(part["v"]))
                yield pa.RecordBatch.from_arrays([part["id"], part["v"], pa.array([d] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "v", "dim", "part", "codes"])

    def probing(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for b in it:
            for d, part in _by_dimension(b):
                at = shared.value[d].probes(_matrix(part["v"]))
                rows = np.repeat(np.arange(len(at)), at.shape[1])
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([taken["id"], taken["v"], pa.array([d] * len(rows), pa.int32()), pa.array(at.ravel(), pa.int32())], ["qid", "q", "dim", "part"])

    def block(query_rows: pa.Table, rows: pa.Table) -> pa.Table:
        names = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not query_rows.num_rows or not rows.num_rows:
            return pa.table({k: pa.array([], t) for k, t in names.items()})
        index, part = shared.value[rows["dim"][0].as_py()], rows["part"][0].as_py()
        rows = rows.sort_by("id")
        ids, v = rows["id"].to_numpy(), _matrix(rows["v"])
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        qids, q = query_rows["qid"].to_numpy(), _matrix(query_rows["q"])
        far = np.linalg.norm(v, axis=1)
        error = index.missed(v, part, codes)
        far = np.maximum(far, np.linalg.norm(index.centroids[part]) + error)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(q), 256):
            own, who = q[at : at + 256], qids[at : at + 256]
            rough = index.scan(own, part, codes)
            rough[who[:, None] == ids[None, :]] = -np.inf
            first = np.argpartition(-rough, min(RERANK, len(ids)) - 1, axis=1)[:, :RERANK]
            lengths = np.linalg.norm(own, axis=1)
            exact = np.stack([np.sort((v[f] * q).sum(1) + np.where(r[f] > -np.inf, 0.0, -np.inf))[-min(top, len(f)) :][:1] for f, q, r in zip(first, own, rough, strict=True)])
            # every vector that by its codes may still be among the top is scored; a few roundings are allowed for
            open_ = (rough > -np.inf) & (rough + lengths[:, None] * (error + 1e-5 * far)[None] >= exact)
            needed = np.nonzero(open_.any(0))[0]
            products = np.where(open_[:, needed], own @ v[needed].T, -np.inf)
            for i, row in enumerate(products):
                least = np.partition(row, -min(top, len(row)))[-min(top, len(row))] if len(row) else 0.0
                order = needed[(row > -np.inf) & (row >= least - 1e-9 * lengths[i] * far.max())]
                score = (v[order] * own[i]).sum(1)
                best = np.lexsort((ids[order], -score))[:top]
                out.append((np.full(len(best), who[i]), ids[order][best], score[best]))
        return pa.table({k: pa.array(np.concatenate([o[i] for o in out]), t) for i, (k, t) in enumerate(names.items())})

    rows = written(cleaned.mapInArrow(coded, "id long, v array<double>, dim int, part int, codes binary"), "codes")
    asked = written(cleaned.filter(is_query(F.col("id"))).mapInArrow(probing, "qid long, q array<double>, dim int, part int"), "probes")
    keys = ["dim", "part"]
    # tables of a row for each partition, of which there are at most MOST_PARTITIONS for each dimension
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rb"))
    blocks = F.broadcast(written(blocks.join(asked.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qb")), keys), "blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    r = rows.join(blocks, keys).withColumn("r", F.pmod(F.xxhash64("id", F.lit(1)), F.col("rb")).cast("int")).select(*keys, "r", every("qb").alias("s"), "id", "v", "codes")
    a = asked.join(blocks, keys).withColumn("s", F.pmod(F.xxhash64("qid", F.lit(2)), F.col("qb")).cast("int")).select(*keys, every("rb").alias("r"), "s", "qid", "q")
    slots = [*keys, "r", "s"]
    near = a.groupBy(*slots).cogroup(r.groupBy(*slots)).applyInArrow(block, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
