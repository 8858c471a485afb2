"""Ball-tree clustering, hard negatives and exact duplicates on small tables, against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reverie.llm import ball_kmeans, digest_runs, hard_negatives
from reverie.llm.ball_kmeans import BallTree, squared_distances
from reverie.llm.hard_negatives import Bounds

TEXTS = "doc_id long, text string, keep_id string, run string"


def plain_copies(rows, largest=True):
    """(id, text): the kept id, size and text of each row, in order of (id, text)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: (max if largest else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(3)
    texts = ["", None, "one", "One", "one ", "zwei\n", "ä", "x" * 300_000, *[f"t{n}" for n in range(30)]]
    rows = [(n, rng.choice(texts)) for n in range(400)] + [(n, "hot") for n in range(1000, 1300)]
    return rows + [(None, "one"), (None, "no id"), (None, "no id"), (7, "twin"), (7, "twin"), (-5, "neg"), (-9, "neg")]


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("digest", [digest_runs.sha256, lambda t: F.length(t) % 5], ids=["sha256", "weak"])
def test_exact_duplicates(spark, copies, largest, digest):
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in copies], TEXTS).repartition(70)  # three rounds
    got = digest_runs.exact_duplicates(docs, keep="largest" if largest else "smallest", digest=digest).collect()
    plain = plain_copies(copies, largest)
    assert sorted(((r.id, r.keep_id, r.group_size) for r in got), key=str) == sorted((x[:3] for x in plain), key=str)
    assert sum(r.kept for r in got) == len({t or "" for _, t in copies})
    assert all(r.keep_id == r.id for r in got if r.kept)


def test_exact_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], TEXTS)
    assert digest_runs.exact_duplicates(empty).collect() == []
    assert digest_runs.exact_duplicates(empty).columns == ["id", "keep_id", "group_size", "kept", "digest"]


def test_a_hot_text_is_one_row_a_run(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text")).repartition(16)
    rows = digest_runs._rows(docs.select(F.col("doc_id").alias("id"), digest_runs.sha256(F.col("text")).alias("digest")), "largest")
    found = digest_runs._repeated(rows).collect()
    assert len(found) == 16 and {r.n for r in found} == {1000} and {r.best.id for r in found} == {2997}


def whole_rows(rng, n, width, spread=40):
    points = rng.integers(-spread, spread, (n, width))
    points[rng.random(n) < 0.4] = points[0]  # copies
    return points


def test_trees_assign_as_loops_do():
    rng = np.random.default_rng(1)
    for n, width in ((1, 3), (2, 1), (700, 2), (900, 12), (300, 64)):
        points = whole_rows(rng, n, width)
        if n == 900:
            points = points // 8 + 1000 * rng.integers(0, 5, (n, 1))  # far groups
        tree, order = BallTree.grown(points, leaf=8)
        assert (tree.points == points[order]).all() and sorted(order) == list(range(n))
        for a, b, r, c, total in zip(tree.first, tree.last, tree.radius, tree.centre, tree.total, strict=True):
            assert (total == tree.points[a:b].sum(0)).all() and np.sqrt(squared_distances(tree.points[a:b], c[None])).max() <= r
        centroids = np.concatenate((points[rng.integers(0, n, 6)], whole_rows(rng, 3, width), points[:1]))  # ties among them
        d = squared_distances(points, centroids)
        cluster, distance = tree.assigned(centroids)
        assert (cluster == d.argmin(1)[order]).all() and (distance == d.min(1)[order]).all()
        sums = tree.sums(centroids)
        for c in range(len(centroids)):
            own = points[d.argmin(1) == c]
            assert (sums[c, :-1] == own.sum(0)).all() and sums[c, -1] == len(own)
        if n == 900:
            (nodes, _), (at, _, _) = tree.filtered(1000 * np.arange(5)[:, None] + np.zeros((5, width), np.int64))
            assert len(at) == 0 and len(nodes) < 100  # whole balls


VECTORS = "vec_id long, embedding array<double>, cluster string, id string, v int"


def plain_clusters(vectors, k, rounds):
    """(id, whole vector) in the order of the first centroids."""
    centroids = [v for _, v in vectors[:k]]
    near = lambda v: min(range(len(centroids)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, centroids[c], strict=True)), c))
    for _ in range(rounds):
        own = {}
        for _, v in vectors:
            own.setdefault(near(v), []).append(v)
        centroids = [[sum(x) // len(own[c]) for x in zip(*own[c], strict=True)] if c in own else m for c, m in enumerate(centroids)]
    return sorted(((i, near(v), sum((a - b) ** 2 for a, b in zip(v, centroids[near(v)], strict=True))) for i, v in vectors), key=str), centroids


def test_clusters_of_odd_rows(spark):
    rng = random.Random(5)
    good = [(n, [rng.choice([-1.5, 0.0, 0.26, 3.0]) for _ in range(4)]) for n in range(200)]
    good += [(n, [0.25] * 4) for n in range(300, 420)] + [(300, [0.25] * 4), (None, [9.0, 9.0, 9.0, -9.0])]
    bad = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5), (904, [1.0, None, 1.0, 1.0]), (905, [1.0, math.nan, 1.0, 1.0]), (906, [1.0, math.inf, 1.0, 1.0]), (907, [1e300] * 4)]
    table = spark.createDataFrame([(i, v, "c", "i", 1) for i, v in good + bad], VECTORS).repartition(5)
    place = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in good]
    whole.sort(key=lambda r: ("~" if r[0] is None else place(r[0]), r[1]))
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    found, centroids = ball_kmeans.clusters(table, F.col("embedding"), F.col("vec_id"), order, width=4, k=6)
    plain, plain_centroids = plain_clusters(whole, 6, 3)
    assert centroids == plain_centroids and sorted((tuple(r) for r in found.collect()), key=str) == plain
    few, centroids = ball_kmeans.clusters(table.where("vec_id < 3"), F.col("embedding"), F.col("vec_id"), order, width=4, k=6)
    assert len(centroids) == 3 and few.count() == 3
    none, centroids = ball_kmeans.clusters(table.where("vec_id >= 900"), F.col("embedding"), F.col("vec_id"), order, width=4, k=6)
    assert centroids == [] and none.collect() == []


def plain_negatives(rows, is_anchor, k=5, percent=80):
    rows = {i: (label, v) for i, label, v in rows}
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in filter(is_anchor, rows):
        label, v = rows[a]
        ranked = sorted((-product(v, rows[b][1]), b) for b in rows if b != a)
        for s, p in [x for x in ranked if rows[x[1]][0] == label][:k]:
            near = [(-n, b) for n, b in ranked if rows[b][0] != label and percent * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a, p, rank + 1, b, -s, n) for rank, (n, b) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("spread", [3, 1000, 1 << 26])
def test_hard_negatives(spark, spread):
    rng = np.random.default_rng(spread)
    points = whole_rows(rng, 900, 20, spread)
    points[500:600] = points[500]
    points[600:700] += spread // 2  # mostly positive products
    labels = rng.integers(0, 4, 900)
    labels[700:] = 9
    rows = [(n, int(labels[n]), points[n].tolist()) for n in range(900)] + [(1000, 77, [1] * 20), (1010, 1, []), (1020, 2, [spread // 2] * 7)]
    odd = [(None, 1, [1]), (2000, None, [1]), (2010, 1, None), (1000, 78, [2] * 20), (0, *rows[0][1:])]
    table = spark.createDataFrame([(*r, "clash") for r in rows + odd], "id long, label int, v array<int>, slot string").repartition(6)
    got = hard_negatives.hard_negatives(table, F.col("id") % 10 == 0).collect()
    plain = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(plain) > 300 and sorted(map(tuple, got)) == plain


def test_no_hard_negatives(spark):
    table = spark.createDataFrame([], "id long, label int, v array<int>")
    assert hard_negatives.hard_negatives(table, F.col("id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(0, 1, [1, 2]), (1, 2, [3, 4])], "id long, label int, v array<int>")
    assert hard_negatives.hard_negatives(alone, F.col("id") % 10 == 0).collect() == []


def test_bounds_hold_and_discard():
    rng = np.random.default_rng(2)
    points = (rng.normal(size=(500, 64)) * np.geomspace(2000, 1, 64)).astype(np.int64)
    turn = np.linalg.eigh(points.T.astype(float) @ points)[1][:, ::-1]
    turned, exact = (points @ turn).astype(np.float32), points[:20] @ points.T
    bounds, gap = Bounds(turned[:20], turned, np.arange(500)), []
    for upto in (8, 16, 32, 64):
        bounds.extend(upto)
        assert (bounds.lower <= exact).all() and (exact <= bounds.upper).all()
        gap.append(float((bounds.upper - bounds.lower).mean()))
    assert gap == sorted(gap, reverse=True) and gap[1] < 0.2 * np.abs(exact).mean()
    bounds = Bounds(turned[:1], turned, np.arange(500))
    bounds.extend(8)
    alive = bounds.discard(bounds.upper >= hard_negatives._kth(bounds.lower, 5)[:, None])
    assert alive.shape[1] < 100 and set(np.argsort(-exact[0])[:5]) <= set(bounds.columns)


def test_registered_clusters_group_all_rows(spark):
    """Inertia adds up, and every vector's cluster is that of its centroid's digest."""
    rows = ball_kmeans.query(spark, "/root/testdata/sf0.01").collect()
    assert len({r.centroid_sha256 for r in rows}) >= len({r.cluster for r in rows}) - 1
    by = {}
    for r in rows:
        by[r.cluster] = by.get(r.cluster, 0) + r.distance
    assert all(r.cluster_inertia == by[r.cluster] and r.inertia == sum(by.values()) for r in rows)
