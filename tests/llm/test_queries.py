"""The registered queries of the llm operators at the smallest scale."""

import zlib

import duckdb
import numpy as np
import pytest

from reverie.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.test_queries import TABLES, compared


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    compared(QUERIES[name](spark, DATA), c.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    rows, docs = QUERIES[name](spark, DATA).toPandas(), spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    assert len(rows) >= len(docs) if name.startswith("op7") else len(rows) == len(docs)
    assert set(rows["doc_id"]) == set(docs["doc_id"])


def test_quality_of_held_out_rows(spark):
    rows = QUERIES["op2_compression_quality"](spark, "/root/testdata/sf0.01").toPandas()
    both = rows.merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert list(both["held_out"]) == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both["doc_id"]]
    assert np.mean(held["predicted"] == held["quality"]) > 0.93 and np.mean(held[held["quality"] == 1]["predicted"]) > 0.97


def test_language_model_beats_its_base(spark):
    rows = QUERIES["op9_gru_lm"](spark, "/root/testdata/sf0.01").toPandas()
    held = rows[rows["held_out"]]
    assert held["score"].sum() > 0.95 * held["base_score"].sum() and (held["score"] > held["base_score"]).mean() > 0.95


def test_mix_is_near_its_targets(spark):
    rows = QUERIES["op5_entropy_mix"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").toPandas()
    by = rows.merge(docs, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by["taken"] - by["target"]) < 0.005 * by["target"]).all() and (rows["taken"] <= 2 * rows["size"]).all()
