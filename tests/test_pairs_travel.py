"""What similar pairs and the groups made of them move about."""

import numpy as np

from reverie.operators import search


def test_a_vector_travels_as_often_as_there_are_sub_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6))
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<float>")
    monkeypatch.setattr(search, "SUB_BLOCK", 300)
    made, meetings = [], search._meetings
    monkeypatch.setattr(search, "_meetings", lambda *a: made.append(meetings(*a)) or made[-1])
    got = {(r.a, r.b) for r in search.similarity_pairs(table, 0.9).collect()}
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert got == {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9), strict=True) if i < j} and len(got) > 1000
    assert made[0].count() <= 6  # of three sub-blocks, not of 30 cells
