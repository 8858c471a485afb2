"""The similarity index against the scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reverie.operators import similarity_index
from reverie.operators.similarity_index import SimilarityIndex
from reverie.sources.store import Store
from tests.conftest import DATA


def nearest(rows, queries, k=10):
    """query: the k ids of rows (id, vector) most alike, ties by id."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = {i: n for n, i in enumerate(ids)}
    return {q: [int(ids[j]) for j in np.lexsort((ids, -np.round(x @ x[at[q]], 9))) if ids[j] != q][:k] for q in queries}


def recall(index, rows, queries, k=10, **how):
    found = {}
    for r in index.search(queries, k, **how).collect():
        found.setdefault(r.query, []).append((r.place, r.id))
    asked = [r.id for r in queries.select("id").collect()]
    true = nearest(rows, asked, k)
    assert all(sorted(p for p, _ in found[q]) == list(range(1, min(k, len(rows) - 1) + 1)) for q in asked)
    return sum(len({i for _, i in found[q]} & set(true[q])) for q in asked) / sum(map(len, true.values()))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return f"file://{tmp_path_factory.mktemp('index')}"


def test_finds_nine_tenths_and_reads_few(spark, folder):
    """Vectors without structure: codes spare their reading; clustered ones: lists do."""
    s = Store(spark, DATA)
    for name, table in (("flat", s.vectors.select("id", "embedding")), ("clustered", s.vector_tags.select("id", "embedding").dropDuplicates(["id"]))):
        rows = [(r.id, r.embedding) for r in table.collect()]
        queries = table.where("id % 20 = 0")
        index = SimilarityIndex.build(table, f"{folder}/{name}")
        assert recall(index, rows, queries) >= 0.9
        asked = similarity_index.units_of(queries, index.width).select(F.col("id").alias("query"), "unit")
        read = index.estimates(asked, index.probes, max(10, index.rescored)).count()
        assert read < 0.2 * len(rows) * queries.count()
        assert index.visited_share(queries) < (0.2 if name == "clustered" else 0.9)
        plan = index.search(queries)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def groups(n, seed, width=10):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(0).normal(size=(15, width))
    return middle[rng.integers(0, 15, n)] + rng.normal(0, 0.3, (n, width))


def test_new_vectors_are_filed_without_learning(spark, folder):
    table = lambda ids, x: spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, embedding array<double>")
    first, second = groups(300, 1), groups(200, 2)
    second[50:150] = second[50]  # one vector many times
    index = SimilarityIndex.build(table(range(300), first), f"{folder}/grown")
    centres = spark.read.parquet(f"{folder}/grown/centres").collect()
    assert index.add(table(range(250, 500), np.concatenate((first[:50], second)))) == 200
    assert index.add(table(range(250, 500), np.concatenate((first[:50], second)))) == 0
    again = SimilarityIndex(spark, f"{folder}/grown")
    assert spark.read.parquet(f"{folder}/grown/centres").collect() == centres and again.probes == index.probes
    whole = [(i, v) for i, v in enumerate(np.concatenate((first, second)))]
    assert recall(again, whole, table(range(300, 500, 10), second[::10])) >= 0.9


def test_a_crash_between_tables_is_taken_up(spark, folder):
    x = groups(60, 3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    index = SimilarityIndex.build(rows.where("id < 40"), f"{folder}/broken")
    index._append(similarity_index.units_of(rows.where("id >= 40"), index.width), "units")  # and no blocks
    assert index.add(rows) == 20 and index.add(rows) == 0
    assert sorted(i for r in index._table("blocks").collect() for i in r.ids) == list(range(60))


def test_scope_and_odd_vectors(spark, folder):
    x = groups(200, 4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 10), (902, [1.0] * 4), (903, [])]
    table = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = SimilarityIndex.build(table, f"{folder}/odd")
    got = index.search(table.where("id IN (3, 900, 901, 902, 903)"), 5, probes=1, among=spark.createDataFrame([(i,) for i in range(0, 200, 25)], "id long")).orderBy("place").collect()
    true = nearest([(i, v) for i, v in rows[:200] if i % 25 == 0 or i == 3], [3], 5)
    assert {r.query for r in got} == {3} and [r.id for r in got] == true[3]
    empty = SimilarityIndex.build(table.where("false"), f"{folder}/empty")
    assert empty.search(table, 5).collect() == []
    single = SimilarityIndex.build(table.where("id = 7"), f"{folder}/single")
    assert [(r.query, r.id) for r in single.search(table.where("id IN (7, 8)"), 5).collect()] == [(8, 7)]
