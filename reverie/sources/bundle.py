"""Tables that change together: one manifest makes a new version of all of them visible at once; bundles carry them elsewhere."""

from __future__ import annotations

import base64
import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructField, StructType

from reverie.operators import lifecycle
from reverie.sources.backup import KEYS, dangling

MANIFEST = "version int, name string, folder string"
CONTENTS = "name string, rows bigint, schema string"


def _text(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())


def _floats(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else np.frombuffer(base64.b64decode(t), "<f4"))


def enveloped(vector: str) -> Column:
    """A vector as text: its elements as little-endian 32-bit floats, in base64."""
    return F.pandas_udf(_text, "string")(vector)


def opened(envelope: str) -> Column:
    return F.pandas_udf(_floats, "array<float>")(envelope)


def _is_vector(kind) -> bool:
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType))


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """tables as JSON lines, vectors in envelopes, with a list of what there is, which is written last; a bundle without it is none."""
    spark = next(iter(tables.values())).sparkSession
    contents = []
    for name, df in tables.items():
        vectors = [f.name for f in df.schema if _is_vector(f.dataType)]
        df.withColumns({c: enveloped(c) for c in vectors}).write.option("compression", "gzip").option("ignoreNullFields", False).json(f"{path}/{name}")
        contents.append((name, spark.read.text(f"{path}/{name}").count(), df.schema.json()))
    spark.createDataFrame(contents, CONTENTS).coalesce(1).write.json(f"{path}/contents")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle; one that lost lines is an error."""
    out = {}
    for r in spark.read.schema(CONTENTS).json(f"{path}/contents").collect():  # a row a table
        schema = StructType.fromJson(json.loads(r["schema"]))
        vectors = {f.name: f.dataType for f in schema if _is_vector(f.dataType)}
        written = StructType([StructField(f.name, StringType()) if f.name in vectors else f for f in schema])
        df = spark.read.schema(written).json(f"{path}/{r['name']}")
        if spark.read.text(f"{path}/{r['name']}").count() != r["rows"]:
            raise ValueError(f"the bundle's {r['name']} has lost rows")
        out[r["name"]] = df.withColumns({c: opened(c).cast(kind) for c, kind in vectors.items()}).select(*schema.names)
    return out


class TableSet:
    """Tables by name under a path that all executors reach; readers see the last whole version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, tables: dict[str, DataFrame], path: str) -> TableSet:
        out = cls(next(iter(tables.values())).sparkSession, path)
        out._write(0, tables)
        return out

    def _last(self) -> tuple[int, dict[str, str]]:
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        version = rows.agg(F.max("version")).first()[0]
        return version, {r["name"]: r["folder"] for r in rows.where(F.col("version") == version).collect()}  # a row a table

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(f"{self.path}/{folder}") for name, folder in self._last()[1].items()}

    def _write(self, version: int, tables: dict[str, DataFrame], others: dict[str, str] | None = None) -> None:
        staging = f"staging-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.path}/{staging}/{name}")
            folders = (others or {}) | {name: f"{staging}/{name}" for name in tables}
            rows = self.spark.createDataFrame([(version, name, folder) for name, folder in folders.items()], MANIFEST)
            rows.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")  # one file: all tables or none
        except BaseException:
            _drop(self.spark, f"{self.path}/{staging}")
            raise

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """tables take the place of those of their names; the others stay as they are."""
        version, folders = self._last()
        self._write(version + 1, tables, folders)

    def restore(self, bundle: dict[str, DataFrame], keys: dict[str, tuple[str, ...]] = KEYS) -> None:
        """Adds the new rows of a bundle, all or nothing: a missing table or column, a row that differs from the stored one of its key, or one whose reference leads nowhere fails the whole of it."""
        stored, changed = self.tables(), {}
        for name, df in bundle.items():
            if name not in stored or set(df.columns) != set(stored[name].columns):
                raise ValueError(f"the bundle's {name} has other columns than the store's")
            key: Column = F.struct(*keys[name]).alias("_key")
            mine, theirs = (x.select(key, *stored[name].columns) for x in (df, stored[name]))
            changed[name] = lifecycle.restored(mine, theirs, "_key").drop("_key")
        if dangling(stored | changed).limit(1).count():
            raise ValueError("a row of the bundle names one that neither it nor the store has")
        self.commit(changed)
