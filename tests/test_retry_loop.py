"""A stream in which failed messages come back by themselves."""

import pytest
from pyspark.sql import functions as F

from reverie.streaming import retrying


def test_failing_twice_then_done_in_one_query(spark, tmp_path):
    landing, path = f"file://{tmp_path}/landing", f"file://{tmp_path}/loop"
    first = spark.createDataFrame([("a", "fails 2"), ("b", "fails 0"), ("c", "fails 1"), ("d", None)], "id string, content string")
    first.write.parquet(landing)
    needed = F.coalesce(F.regexp_extract("content", r"\d", 0).cast("int"), F.lit(0))
    distill = lambda due: due.where(F.col("attempts") > needed).select("id", F.concat(F.lit("done "), F.coalesce("content", F.lit("nothing"))).alias("content"))
    crashed = []

    def fail(number):
        if not crashed:
            crashed.append(number)
            raise RuntimeError("crash")

    query = retrying.loop(spark, landing, path, distill, 0.1, fail)
    with pytest.raises(Exception, match="crash"):
        retrying.wait_for(query, path, 99, 100)
    spark.createDataFrame([("e", "fails 1"), ("b", "fails 0")], "id string, content string").write.mode("append").parquet(landing)
    query = retrying.loop(spark, landing, path, distill, 0.1)
    retrying.wait_for(query, path, 5, 100)
    got = retrying.finished(spark, path).collect()
    assert sorted((r.id, r.attempts, r.content) for r in got) == [("a", 3, "done fails 2"), ("b", 1, "done fails 0"), ("c", 2, "done fails 1"), ("d", 1, "done nothing"), ("e", 2, "done fails 1")]
    due = spark.read.schema(retrying.EVENT).parquet(f"{path}/emitted/*").where("kind = 'due'").collect()
    assert sorted((r.id, r.attempts) for r in due) == sorted([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1), ("c", 2), ("d", 1), ("e", 1), ("e", 2)])  # none twice
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != retrying.PROVIDER
