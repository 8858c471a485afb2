"""k-means over whole-number vectors, filtered by ball trees.

Blocks of the input's rows become metric trees, once, in a table: a node holds the centre, radius,
count and integer sum of its points. A round walks each tree from its root. A centroid whose
nearest possible point of a ball is farther than another's farthest one is out for all points
below (triangle inequality). A ball with one centroid left is assigned whole, by its count and sum;
what reaches a leaf with several is compared point by point, in whole numbers. Sums of the parts
meet in k * (components + 1) counters, so that every round is exact, however the rows are dealt.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reverie.llm.common import load, written
from reverie.llm.vectors import blocks, matrix, products, whole

#: Points of a tree, and of a leaf at most (a ball of equal points is one leaf).
BLOCK, LEAF = 1 << 13, 24
#: Relative error that rounded roots may have.
SLACK = 1e-9
#: Of the query.
COMPONENTS, FACTOR, CLUSTERS, ROUNDS = 64, 64, 16, 3

TREES = "ids array<bigint>, points binary, first array<int>, last array<int>, child array<int>, centre binary, radius array<double>, total binary"
COUNTERS = "cluster int, component int, total bigint"
ASSIGNED = "id bigint, cluster int, distance bigint"


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    own = lambda x: np.einsum("ij,ij->i", x.astype(np.int64), x.astype(np.int64))
    return own(a)[:, None] - 2 * products(a, b) + own(b)[None, :]


@dataclass
class BallTree:
    """Nodes by level; node i has points[first[i]:last[i]] and the children child[i] and child[i] + 1, or none (-1)."""

    points: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    @classmethod
    def grown(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[BallTree, np.ndarray]:
        """The tree of points (n > 0) and the order in which it holds them."""
        points = points.astype(np.int64)
        order, spans, child, centre, radius, total = np.arange(len(points)), [(0, len(points))], [], [], [], []
        for a, b in spans:  # grows meanwhile
            own = points[order[a:b]]
            total.append(own.sum(0))
            centre.append(total[-1] // (b - a))
            away = own - centre[-1]
            square = np.einsum("ij,ij->i", away, away)
            radius.append(np.sqrt(float(square.max())) * (1 + SLACK))
            if b - a <= leaf or not (own != own[0]).any():
                child.append(-1)
                continue
            one = own[square.argmax()]
            gap = own - one
            other = own[np.einsum("ij,ij->i", gap, gap).argmax()]
            side = gap @ (other - one)
            near = int((2 * side < (other - one) @ (other - one)).sum())
            cut = near if 16 * min(near, b - a - near) >= b - a else (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(side, cut)]
            child.append(len(spans))
            spans += [(a, a + cut), (a + cut, b)]
        first, last = np.asarray(spans, np.int32).T
        return cls(points[order].astype(np.int32), first, last, np.asarray(child, np.int32), np.asarray(centre, np.int32), np.asarray(radius), np.asarray(total)), order

    def filtered(self, centroids: np.ndarray):
        """(nodes, cluster of each) that are assigned whole, and (points, cluster of each, squared distance) of the leaves that are not."""
        k = len(centroids)
        whole_nodes, whole_of, points, allowed = [], [], [], []
        now, left = np.zeros(1, np.int64), np.ones((1, k), bool)
        while len(now):
            d = np.sqrt(squared_distances(self.centre[now], centroids).astype(np.float64))
            r = self.radius[now][:, None]
            least, most = (d - r) - SLACK * (d + r), (d + r) * (1 + SLACK)
            left &= least <= np.where(left, most, np.inf).min(1)[:, None]
            single = left.sum(1) == 1
            whole_nodes.append(now[single])
            whole_of.append(left[single].argmax(1))
            below = self.child[now]
            for i in np.flatnonzero(~single & (below < 0)):
                points.append(np.arange(self.first[now[i]], self.last[now[i]]))
                allowed.append(np.broadcast_to(left[i], (len(points[-1]), k)))
            inner = ~single & (below >= 0)
            now, left = np.concatenate((below[inner], below[inner] + 1)), np.concatenate((left[inner], left[inner]))
        at = np.concatenate(points) if points else np.zeros(0, np.int64)
        d = squared_distances(self.points[at], centroids)
        if points:
            d[~np.concatenate(allowed)] = np.iinfo(np.int64).max
        best = d.argmin(1)  # the first, so the smaller number of ties
        return (np.concatenate(whole_nodes), np.concatenate(whole_of)), (at, best, d[np.arange(len(at)), best])

    def sums(self, centroids: np.ndarray) -> np.ndarray:
        """For each centroid the sum of its points' components and, last, their number."""
        out = np.zeros((len(centroids), self.points.shape[1] + 1), np.int64)
        (nodes, of), (at, best, _) = self.filtered(centroids)
        np.add.at(out, (of, slice(-1)), self.total[nodes])
        np.add.at(out[:, -1], of, (self.last - self.first)[nodes])
        np.add.at(out, (best, slice(-1)), self.points[at].astype(np.int64))
        np.add.at(out[:, -1], best, 1)
        return out

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of every point."""
        (nodes, of), (at, best, d) = self.filtered(centroids)
        cluster, distance = np.zeros(len(self.points), np.int32), np.zeros(len(self.points), np.int64)
        for node, c in zip(nodes, of, strict=True):
            own = slice(self.first[node], self.last[node])
            cluster[own] = c
            distance[own] = squared_distances(self.points[own], centroids[c : c + 1])[:, 0]
        cluster[at], distance[at] = best, d
        return cluster, distance


def _grow(batches, width: int):
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), *[(c, pa.list_(pa.int32())) for c in ("first", "last", "child")], ("centre", pa.binary()), ("radius", pa.list_(pa.float64())), ("total", pa.binary())])
    for table in blocks(batches, BLOCK):
        tree, order = BallTree.grown(matrix(table["v"], width))
        row = {"ids": table["id"].take(pa.array(order)).to_pylist(), "points": tree.points.tobytes(), "first": tree.first, "last": tree.last, "child": tree.child, "centre": tree.centre.tobytes(), "radius": tree.radius, "total": tree.total.tobytes()}
        yield pa.RecordBatch.from_pylist([row], schema)


def _trees(batches, width: int):
    """(ids, tree) of each row of the trees' table."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            flat = {c: row[c].values.to_numpy(zero_copy_only=False) for c in ("first", "last", "child", "radius")}
            raw = {c: np.frombuffer(row[c].as_py(), np.int64 if c == "total" else np.int32).reshape(-1, width) for c in ("points", "centre", "total")}
            yield row["ids"].values, BallTree(**flat, **raw)


def _counters(batches, centroids: np.ndarray):
    k, width = centroids.shape
    out = np.zeros((k, width + 1), np.int64)
    for _, tree in _trees(batches, width):
        out += tree.sums(centroids)
    cluster, component = np.nonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(component, pa.int32()), pa.array(out[cluster, component], pa.int64())], ["cluster", "component", "total"])


def _assignments(batches, centroids: np.ndarray):
    for ids, tree in _trees(batches, centroids.shape[1]):
        cluster, distance = tree.assigned(centroids)
        yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])


def grow_trees(vectors: DataFrame, width: int) -> DataFrame:
    """The trees of vectors (id long, v array<int> of `width` whole numbers), a row a block, as a table."""
    return written(vectors.select("id", "v").mapInArrow(lambda b: _grow(b, width), TREES), "trees")


def fit(trees: DataFrame, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """The centroids after so many rounds; an empty one stays where it is."""
    for _ in range(rounds):
        now = np.asarray(centroids, np.int64)
        parts = trees.mapInArrow(lambda b, now=now: _counters(b, now), COUNTERS)
        sums = parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k * (width + 1) at most
        total = {(r["cluster"], r["component"]): int(r["total"]) for r in sums}
        width = now.shape[1]
        centroids = [[total.get((c, j), 0) // n for j in range(width)] if (n := total.get((c, width), 0)) else old for c, old in enumerate(centroids)]
    return centroids


def clusters(table: DataFrame, vector: Column, row_id: Column, order: Column, width: int = COMPONENTS, factor: int = FACTOR, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """id, cluster, distance of each row of table with a vector of `width` components, and the centroids.

    Left out are rows with a null vector, another number of components, a null or non-finite one, or
    whole numbers too large (vectors.LENGTH_LIMIT). The first k rows by `order` (nulls last, then by
    vector) are the first centroids; with fewer rows there are fewer, with none there are no rows.
    Repeated rows are vectors of their own, and so are rows without id. Ties go to the smaller number.
    """
    vectors = table.select(row_id.cast("long").alias("id"), whole(F.when(F.size(vector) == width, vector), factor).alias("v"), order.alias("place")).where("v IS NOT NULL")
    trees = grow_trees(vectors, width)
    first = [list(r["v"]) for r in vectors.orderBy(F.col("place").asc_nulls_last(), "v").select("v").limit(k).collect()]  # k rows
    if not first:
        return table.sparkSession.createDataFrame([], ASSIGNED), []
    centroids = fit(trees, first, rounds)
    now = np.asarray(centroids, np.int64)
    return trees.mapInArrow(lambda b: _assignments(b, now), ASSIGNED), centroids


def query(spark, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "embeddings")
    found, centroids = clusters(table, F.col("embedding"), F.col("vec_id"), F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    found = written(found, "clusters")
    own = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    inertia = [own.get(c, 0) for c in range(len(sha))]
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", of(inertia).cast("long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of(sha).alias("centroid_sha256")
    )


def _oracle() -> str:
    """The same rounds over all pairs of vectors and centroids."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))"
    steps = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS m FROM v QUALIFY c < 16)",
    ]
    for n in range(1, ROUNDS + 2):
        steps.append(f"d{n} AS (SELECT vec_id, v, c, CAST({square} AS BIGINT) AS d FROM v, c{n - 1}), a{n} AS (SELECT vec_id, any_value(v) AS v, min(d) AS d, min_by(c, d * 16 + c) AS c FROM d{n} GROUP BY vec_id)")
        steps.append(
            f"s{n} AS (SELECT c, i, CAST(floor(sum(v[i])::DOUBLE / count(*)) AS BIGINT) AS x FROM a{n}, range(1, 65) t(i) GROUP BY c, i), "
            f"c{n} AS (SELECT c0.c, coalesce(s.m, c0.m) AS m FROM c{n - 1} c0 LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM s{n} GROUP BY c) s ON s.c = c0.c)"
        )
    last = ROUNDS + 1
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, CAST(a.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{last} a JOIN c{ROUNDS} m ON m.c = a.c"
    )


ORACLE = _oracle()
