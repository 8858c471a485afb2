"""Bundles, and tables that change together."""

import os

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from reverie.sources import bundle
from reverie.sources.bundle import TableSet


def tables(spark, ids):
    entities = spark.createDataFrame([(i, f"e{i}", [0.1 * i, -1.5, 3e-8] if i % 2 else None) for i in ids], "id long, name string, embedding array<float>")
    mentions = spark.createDataFrame([(i, 10 * i, "ä\n\"x\"") for i in ids], "entity_id long, memory_id long, surface string")
    return {"entities": entities, "entity_mentions": mentions}


def rows(found):
    return {name: sorted(map(tuple, df.collect()), key=str) for name, df in found.items()}


def test_round_trip_and_restore(spark, tmp_path):
    where = f"file://{tmp_path}"
    bundle.write_bundle(tables(spark, range(8)), f"{where}/bundle")
    assert rows(bundle.read_bundle(spark, f"{where}/bundle")) == rows(tables(spark, range(8)))
    store = TableSet.create(tables(spark, [1, 2]), f"{where}/store")
    store.restore(bundle.read_bundle(spark, f"{where}/bundle"))
    assert rows(TableSet(spark, f"{where}/store").tables()) == rows(tables(spark, range(8)))
    store.restore(bundle.read_bundle(spark, f"{where}/bundle"))  # nothing is new
    assert rows(store.tables()) == rows(tables(spark, range(8)))
    os.remove(next(str(p) for p in (tmp_path / "bundle" / "entities").glob("part-*.json.gz")))
    with pytest.raises(ValueError, match="lost rows"):
        bundle.read_bundle(spark, f"{where}/bundle")


def test_a_failed_import_changes_nothing(spark, tmp_path, monkeypatch):
    where = f"file://{tmp_path}"
    store = TableSet.create(tables(spark, [1, 2]), f"{where}/store")
    before = rows(store.tables())
    more = tables(spark, range(5))
    with pytest.raises(ValueError, match="differs"):
        store.restore(more | {"entities": more["entities"].withColumn("name", F.lit("other"))})
    with pytest.raises(ValueError, match="names one"):
        store.restore({"entity_mentions": more["entity_mentions"]})
    with pytest.raises(ValueError, match="columns"):
        store.restore({"entities": more["entities"].drop("name")})
    write, done = DataFrameWriter.parquet, []

    def crash(self, path, *a, **b):
        if "staging" in path:
            done.append(path)
            if len(done) == 2:
                raise RuntimeError("crash")
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", crash)
    with pytest.raises(RuntimeError):
        store.restore(more)
    monkeypatch.undo()
    assert rows(TableSet(spark, f"{where}/store").tables()) == before
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("staging")]) == 1  # that of the first version
    store.restore(more)
    assert rows(store.tables()) == rows(tables(spark, range(5)))
