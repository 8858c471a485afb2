"""Functions for SQL, with a client that counts its calls."""

import os

from pyspark.sql import functions as F

from reverie.functions import embedding, extension


def test_embedder_connects_once_a_task_and_calls_in_batches(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        open(os.path.join(folder, f"connect-{os.urandom(8).hex()}"), "w").close()

        def client(texts):
            with open(os.path.join(folder, f"call-{os.urandom(8).hex()}"), "w") as f:
                f.write(str(len(texts)))
            if "bad" in texts:
                raise OSError("no answer")
            return [[float(len(t)), 1.0] for t in texts]

        return client

    rows = [(i, f"text {i % 40}") for i in range(100)] + [(200, None), (201, "")]
    table = spark.createDataFrame(rows, "id int, content string").repartition(3)
    extension.register(spark, connect, 16)
    table.createOrReplaceTempView("texts")
    got = {r.id: r.v for r in spark.sql("SELECT id, embed(content) AS v FROM texts").collect()}
    assert got == {i: None if c is None else [float(len(c)), 1.0] for i, c in rows}
    names = os.listdir(folder)
    sizes = [int(open(os.path.join(folder, n)).read()) for n in names if n.startswith("call")]
    assert sum(n.startswith("connect") for n in names) == 3 and max(sizes) == 16 and sum(sizes) < 103
    failing = spark.createDataFrame([(1, "bad"), (2, "good")], "id int, content string").coalesce(1).withColumns({"embedding": F.lit(None).cast("array<float>"), "embedding_model": F.lit(None).cast("string")})
    out = embedding.reindexed(failing, extension.model_name("m", 2), extension.client_embedder(connect, 1)).collect()
    assert {r.id: r.embedding for r in out} == {1: None, 2: [4.0, 1.0]} and {r.embedding_model for r in out} == {"m:2"}


def test_table_functions(spark):
    extension.register(spark)
    spark.createDataFrame([(1, "Café au café, x_y"), (2, ""), (3, None)], "id int, content string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, term, tf FROM texts, LATERAL postings_of(content)").collect()
    assert {tuple(r) for r in got} == {(1, "cafe", 2), (1, "au", 1), (1, "x", 1), (1, "y", 1)}
    runs = spark.sql("SELECT id, place, run FROM texts, LATERAL runs_of(content, 2) ORDER BY id, place").collect()
    assert [tuple(r) for r in runs] == [(1, 0, "cafe au"), (1, 1, "au cafe"), (1, 2, "cafe x"), (1, 3, "x y")]
