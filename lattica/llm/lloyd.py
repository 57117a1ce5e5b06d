"""Lloyd's clustering around centroids with two trees (Curtin, 2017, "A Dual-Tree Algorithm for Fast k-means Clustering").

Vectors become integers, so that all distances and sums are exact. Where they lie they are gathered into blocks of at most
BLOCK vectors, each with a cover tree of its own, and written once; they are never shuffled. A node of a tree has one of its
vectors as centre, and the largest distance from it to any vector below it. In every round a tree over the centroids is made,
and a block's tree and that one are walked together: a pair of nodes is left out if no vector of the one can have its nearest
centroid in the other, by the distance of their centres and their radii. If one centroid is left for a node, it is that of all
its vectors; leaves of both trees are compared exactly. What goes to the driver is a sum for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, "2:"
BLOCK = 2048
#: A node of so few vectors isn't split; at most CENTRES children are looked for, and what they don't cover is one more leaf.
LEAF, CENTRES = 24, 64
#: Largest integer component: squared distances of 64 such stay in a long, and below EXACT in a double.
LARGEST, EXACT = 2**27, 2**21


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component of the vectors that take part: those of dim components, none null or non-finite, and none whose integer is LARGEST or more in size."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fine = (F.size(F.col(f"`{vector_col}`")) == dim) & F.forall(F.col(f"`{vector_col}`"), lambda x: F.abs(x.cast("double")) * scale < LARGEST)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v"))


class Tree:
    """A cover tree over rows of x, in preorder: node i has the children i + 1, skip[i + 1], ... before skip[i], and the vectors lo[i] to hi[i] of those in order."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order, self.centre, self.radius, self.lo, self.hi, self.skip = [], [], [], [], [], []
        self.x, self.leaf = x.astype(np.float64), leaf
        if len(x):
            own = np.arange(len(x))
            self._add(own, 0, self._from(0, own))
        place = np.empty(len(x), np.int32)
        place[self.order] = np.arange(len(x))
        self.order = np.array(self.order, np.int32)
        self.centre = place[np.array(self.centre, np.int64)] if len(x) else place  # by place in the order
        self.radius, self.lo, self.hi, self.skip = np.array(self.radius, np.float64), *(np.array(a, np.int32) for a in (self.lo, self.hi, self.skip))

    def _from(self, i: int, rows: np.ndarray) -> np.ndarray:
        d = self.x[rows] - self.x[i]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _add(self, rows: np.ndarray, centre: int, far: np.ndarray, whole: bool = False) -> None:
        """One node over rows, and those below it. Each child covers what lies within half the radius of its centre, the first child having the parent's."""
        at = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(far.max()))
        self.lo.append(len(self.order))
        self.hi.append(len(self.order) + len(rows))
        self.skip.append(0)
        if whole or len(rows) <= self.leaf or not far.any():
            self.order.extend(rows.tolist())
        else:
            reach, rest, few = self.radius[at] / 2, rows, []
            near = far
            for k in range(CENTRES):
                if not len(rest):
                    break
                c = centre if k == 0 else int(rest[0])
                near = far if k == 0 else self._from(c, rest)
                inside = near <= reach
                own = rest[inside]
                if self.leaf > 1 and len(own) <= self.leaf // 2:
                    few.append(own)
                else:
                    self._add(own, c, near[inside])
                rest = rest[~inside]
            left = np.concatenate([*few, rest]) if few else rest
            if len(left):
                self._add(left, int(left[0]), self._from(int(left[0]), left), True)
        self.skip[at] = len(self.centre)

    def children(self, i: int) -> list[int]:
        out, c = [], i + 1
        while c < self.skip[i]:
            out.append(c)
            c = int(self.skip[c])
        return out


class Centroids:
    """The centroids of a round, and the tree over them, with a leaf for each."""

    def __init__(self, values: np.ndarray):
        self.values, self.tree = values, Tree(values, 1)
        self.number = self.tree.order  # of the centroid at a place of the tree
        self.below = [self.tree.children(i) for i in range(len(self.tree.centre))]
        self.points = values[self.tree.order][self.tree.centre].astype(np.float64) if len(values) else values.astype(np.float64)
        self.root = np.zeros(1, np.int64)

    def _leaves(self, nodes: np.ndarray) -> np.ndarray:
        """Numbers of the centroids of leaves, of which one may hold several equal centroids, in ascending order."""
        t = self.tree
        return np.sort(np.concatenate([self.number[t.lo[i] : t.hi[i]] for i in nodes]))

    def nearest(self, x: np.ndarray, block: tuple) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of every vector of a block, of equal ones the smallest number, and how many distances of vectors to centroids were worked out."""
        centre, radius, lo, hi, skip = block
        out, dist, compared = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64), 0
        t = self.tree
        floats = x.astype(np.float64)
        stack = [(0, self.root)] if len(x) else []
        while stack:
            node, nodes = stack.pop()
            while True:
                d = self.points[nodes] - floats[centre[node]]
                d = np.sqrt(np.einsum("ij,ij->i", d, d))
                most = (d.min() + radius[node]) * (1 + 1e-9) + 1e-6  # no vector of the node is further from its nearest centroid
                nodes = nodes[d - radius[node] - t.radius[nodes] <= most]
                inner = [i for i in nodes if self.below[i]]
                if not inner or t.radius[nodes].max() < radius[node] and skip[node] > node + 1:
                    break
                nodes = np.array([j for i in nodes for j in (self.below[i] or [i])])
            if skip[node] > node + 1 and (len(nodes) > 1 or self.below[nodes[0]]):
                c = node + 1
                while c < skip[node]:
                    stack.append((c, nodes))
                    c = int(skip[c])
                continue
            numbers = self._leaves(nodes)
            rows = slice(lo[node], hi[node])
            d2 = squared(x[rows], self.values[numbers])
            compared += d2.size
            best = d2.argmin(1)
            out[rows], dist[rows] = numbers[best], d2[np.arange(len(d2)), best]
        return out, dist, compared


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c.astype(np.int64)], axis=1)


_PARTS = ("centre", "radius", "lo", "hi", "skip")
_TYPES = (np.int32, np.float64, np.int32, np.int32, np.int32)


def blocks(kept: DataFrame, dim: int = DIM) -> DataFrame:
    """Blocks of vectors with their trees: ids, x (integers, row by row) and the tree's arrays as bytes."""
    id_type = kept.schema["vec_id"].dataType.simpleString()
    schema = f"ids array<{id_type}>, x binary, " + ", ".join(f"{p} binary" for p in _PARTS)

    def of(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        t = Tree(x)
        columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(t.order)))]
        columns += [pa.array([a.tobytes()], pa.binary()) for a in (x[t.order].astype(np.int32), t.centre.astype(np.int32), t.radius, t.lo, t.hi, t.skip)]
        return pa.RecordBatch.from_arrays(columns, ["ids", "x", *_PARTS])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            for at in range(0, b.num_rows, BLOCK):
                held.append(b.slice(at, BLOCK))
                n += held[-1].num_rows
                while n >= BLOCK:
                    all_rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield made(all_rows.slice(0, BLOCK))
                    held, n = [all_rows.slice(BLOCK)], n - BLOCK
        if n:
            yield made(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def made(b: pa.RecordBatch) -> pa.RecordBatch:
        return of(b.column("vec_id"), b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))

    return written(kept.mapInArrow(run, schema), "blocks")


def _opened(b: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, np.ndarray, tuple]]:
    for i in range(b.num_rows):
        get = lambda c, kind: np.frombuffer(b.column(c)[i].as_py(), kind)  # noqa: B023, E731
        yield b.column("ids")[i].values, get("x", np.int32).reshape(-1, dim).astype(np.int64), tuple(get(p, k) for p, k in zip(_PARTS, _TYPES, strict=True))


def sums(made: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, sum of each component) of the vectors nearest to each centroid that has any."""
    k, dim = centroids.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n, total = Centroids(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in it:
            for _, x, tree in _opened(b, dim):
                near, _, _ = c.nearest(x, tree)
                n += np.bincount(near, minlength=k)
                order = np.argsort(near, kind="stable")
                present, first = np.unique(near[order], return_index=True)
                total[present] += np.add.reduceat(x[order], first, axis=0)
        some = np.flatnonzero(n)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dim, pa.int32()), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), values], ["cluster", "n", "s"])

    rows = made.mapInArrow(run, "cluster int, n long, s array<long>")
    return rows.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim))).collect()


def assigned(made: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dim = centroids.shape[1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids(centroids)
        for b in it:
            for ids, x, tree in _opened(b, dim):
                near, dist, _ = c.nearest(x, tree)
                yield pa.RecordBatch.from_arrays([ids, pa.array(near), pa.array(dist)], ["vec_id", "cluster", "distance"])

    return made.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long")


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Cluster and squared distance of every vector that takes part (see integers), the sums of these over its cluster and over all, and a digest of its centroid.

    The first centroids are the k vectors with the least digests of their ids, fewer if there are fewer vectors; ids that
    are null start none, and vectors of equal ids do so in ascending order. Vectors equally near to several centroids belong
    to that of the smallest number; a centroid without vectors stays where it is. Repeated rows count each; an empty table,
    or one without any id, gives no rows; extra columns play no part.
    """
    spark = vectors.sparkSession
    kept = integers(vectors, id_col, vector_col, dim, scale)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    made = blocks(kept, dim)
    first = kept.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dim)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = centroids.copy()
        for r in sums(made, centroids):
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
    out = written(assigned(made, centroids, id_type), "assigned")
    per = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    about = spark.createDataFrame([(c, d, sum(per.values()), digest(c)) for c, d in sorted(per.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings after five rounds from 40 centroids."""
    return clusters(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    ctes = [f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE}*x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding)={DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))={DIM})",
            f"u AS MATERIALIZED (SELECT vec_id, unnest(range({DIM})) AS i, unnest(v) AS x FROM v)",
            f"c0 AS MATERIALIZED (SELECT c, unnest(range({DIM})) AS i, unnest(v) AS y FROM (SELECT row_number() OVER (ORDER BY h)-1 AS c, v FROM (SELECT sha256('{SEED}'||vec_id) AS h, v FROM v ORDER BY h LIMIT {K})))"]
    for r in range(ROUNDS + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS rn FROM (SELECT vec_id, c, sum((x-y)*(x-y))::BIGINT AS d FROM u JOIN c{r} USING (i) GROUP BY 1,2)) WHERE rn=1)")
        if r < ROUNDS:
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(n.y, o.y) AS y FROM c{r} o LEFT JOIN (SELECT c, i, ((s-((s%n)+n)%n)//n)::BIGINT AS y FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM u JOIN a{r} USING (vec_id) GROUP BY 1,2)) n USING (c, i))")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY 1) USING (c)"""


ORACLE = {"op13_centroid_clusters": _oracle()}
