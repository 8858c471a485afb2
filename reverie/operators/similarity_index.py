"""A similarity index: inverted lists around trained centres, with residual codes, kept as tables.

Every vector is filed under the nearest of some centres, whose number grows with the root of the
vectors'. What is left of it beside its centre is cut into short pieces, each coded by the nearest
of up to 256 trained ones, so that a code has a byte for SUB elements. A query visits the lists
of its nearest centres, estimates all products there from the codes, and has only the best
estimates rescored on whole vectors. How many lists and estimates that takes depends on the
vectors: calibrate() measures it on a sample of the stored ones against the scan.

New vectors are filed with the centres and pieces that are there, by appending to the tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.functions import scoring
from reverie.operators.graph import kept

#: Vectors from which centres and pieces are learnt, and those that calibrate() asks for; bounds, whatever the number of vectors.
TRAIN_ROWS, CALIBRATION_ROWS = 1 << 16, 200
#: Centres for each unit of the root of the number of vectors, and MB that all centres may take.
PER_ROOT, MAX_CENTRES_MB = 2, 64
#: Elements of a piece; vectors and queries of a block.
SUB, BLOCK, CHUNK = 4, 4096, 256
#: Estimates of a query that calibrate() looks through.
DEEPEST = 1024

BLOCKS = "list int, ids array<bigint>, codes binary"
ESTIMATES = "query bigint, id bigint, estimate float"


def _means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of x by Lloyd's rounds, from rows spread over it."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def units_of(vectors: DataFrame, width: int) -> DataFrame:
    """id, unit of vectors (id, embedding) of that width; null and all-zero ones are not filed."""
    own = vectors.where((F.size("embedding") == width) & (scoring.norm(F.col("embedding")) > 0))
    return own.select(F.col("id").cast("long").alias("id"), scoring.unit(F.col("embedding")).cast("array<float>").alias("unit"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


@dataclass
class Codec:
    """Centres (one a list) and pieces (one array for each SUB elements)."""

    centres: np.ndarray
    pieces: list[np.ndarray]

    def nearest(self, units: np.ndarray, n: int) -> np.ndarray:
        """The n lists nearest to each unit vector, the nearest first."""
        away = (self.centres**2).sum(1)[None, :] - 2 * units @ self.centres.T
        n = min(n, len(self.centres))
        few = np.argpartition(away, n - 1, 1)[:, :n]
        return np.take_along_axis(few, np.take_along_axis(away, few, 1).argsort(1, kind="stable"), 1).astype(np.int32)

    def encoded(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = self.nearest(units, 1)[:, 0]
        rest = units - self.centres[lists]
        codes = np.empty((len(units), len(self.pieces)), np.uint8)
        for j, piece in enumerate(self.pieces):
            part = rest[:, j * SUB : (j + 1) * SUB]
            codes[:, j] = ((piece**2).sum(1)[None, :] - 2 * part @ piece.T).argmin(1)
        return lists, codes

    def decoded(self, at: int, codes: np.ndarray) -> np.ndarray:
        return self.centres[at] + np.concatenate([piece[codes[:, j]] for j, piece in enumerate(self.pieces)], 1)


def _packed(batches, codec: Codec):
    """Rows (id, unit) in order of their lists, as blocks of one list."""
    schema = pa.schema([("list", pa.int32()), ("ids", pa.list_(pa.int64())), ("codes", pa.binary())])

    def block(at: int, ids: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"list": at, "ids": np.concatenate(ids), "codes": np.concatenate(codes).tobytes()}], schema)

    now, ids, codes, n = -1, [], [], 0
    for batch in batches:
        own_ids = batch.column("id").to_numpy()
        lists, own = codec.encoded(_matrix(batch.column("unit")))
        starts = np.flatnonzero(np.diff(lists, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(lists)], strict=True):
            for i in range(a, b, BLOCK):
                j = min(b, i + BLOCK)
                if n and (lists[a] != now or n + j - i > BLOCK):
                    yield block(now, ids, codes)
                    ids, codes, n = [], [], 0
                now = int(lists[a])
                ids.append(own_ids[i:j])
                codes.append(own[i:j])
                n += j - i
    if n:
        yield block(now, ids, codes)


def _estimated(batches, codec: Codec, most: int):
    """For each query of a chunk the best estimates of a block, but for its own row."""
    for batch in batches:
        for i in range(batch.num_rows):
            at, ids = batch.column("list")[i].as_py(), batch.column("ids")[i].values.to_numpy()
            codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(len(ids), -1)
            asked = batch.column("asked")[i].values
            queries, units = asked.field("query").to_numpy(), _matrix(asked.field("unit"))
            # equal codes are taken in order of their ids, in which a block has them
            scores = np.round(units.astype(np.float64) @ codec.decoded(at, codes).T.astype(np.float64), 7) - 1e-12 * np.arange(len(ids))
            scores[queries[:, None] == ids[None, :]] = -np.inf
            n = min(most, len(ids))
            best = np.argpartition(scores, len(ids) - n, 1)[:, len(ids) - n :]
            found = np.take_along_axis(scores, best, 1)
            real = np.isfinite(found)
            rows = np.broadcast_to(queries[:, None], best.shape)
            yield pa.RecordBatch.from_arrays([pa.array(rows[real]), pa.array(ids[best][real]), pa.array(np.round(found[real], 7).astype(np.float32))], ["query", "id", "estimate"])


class SimilarityIndex:
    """The tables centres, pieces, settings, blocks and units under a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        centres = np.array([r["centre"] for r in self._table("centres").orderBy("list").collect()], np.float32)  # MAX_CENTRES_MB at most
        pieces = [np.array(r["codes"], np.float32) for r in self._table("pieces").orderBy("sub").collect()]  # 256 * width numbers at most
        self.codec, self.width = Codec(centres, pieces), centres.shape[1] if len(centres) else 0
        settings = self._table("settings").orderBy(F.desc("nth")).first()
        self.probes, self.rescored, self._nth = settings["probes"], settings["rescored"], settings["nth"]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.path}/{name}")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, recall: float = 0.95) -> SimilarityIndex:
        """Learns from TRAIN_ROWS of vectors (id, embedding), files all of them and calibrates; vectors of another width than the widest are not filed."""
        spark = vectors.sparkSession
        width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
        units = units_of(vectors, max(1, width))
        n = units.count()
        k = max(1, min(int(PER_ROOT * math.isqrt(n)), n, MAX_CENTRES_MB * 250_000 // max(1, width)))
        sample = kept(units.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS), "sample")
        centres = cls._centres(sample, k) if n else []
        spark.createDataFrame(list(enumerate(centres)), "list int, centre array<float>").write.parquet(f"{path}/centres")
        codec = Codec(np.array(centres, np.float32).reshape(len(centres), width), [])
        cls._pieces(sample, codec, width).write.parquet(f"{path}/pieces")
        spark.createDataFrame([(0, len(centres), DEEPEST)], "nth int, probes int, rescored int").write.parquet(f"{path}/settings")
        spark.createDataFrame([], "id long, unit array<float>").write.parquet(f"{path}/units")
        spark.createDataFrame([], BLOCKS).write.parquet(f"{path}/blocks")
        index = cls(spark, path)
        if n:
            index._file(units)
            index.calibrate(recall)
        return index

    @staticmethod
    def _centres(sample: DataFrame, k: int) -> list[list[float]]:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        learnt = KMeans(k=k, maxIter=8, initMode="random", seed=7, featuresCol="v") if k > 1 else None
        if learnt is None:
            mean = np.mean(_matrix(sample.select("unit").toArrow().column("unit").combine_chunks()), 0)  # TRAIN_ROWS at most
            return [mean.tolist()]
        return [c.tolist() for c in learnt.fit(sample.select(array_to_vector("unit").alias("v"))).clusterCenters()]

    @staticmethod
    def _pieces(sample: DataFrame, codec: Codec, width: int) -> DataFrame:
        """sub, codes: learnt piece by piece from the sample's residuals."""

        @F.pandas_udf("array<array<float>>")
        def cut(units: pd.Series) -> pd.Series:
            x = np.array(units.tolist(), np.float32)
            rest = x - codec.centres[codec.nearest(x, 1)[:, 0]]
            return pd.Series([[r[i : i + SUB] for i in range(0, width, SUB)] for r in rest])

        def learnt(rows: pd.DataFrame) -> pd.DataFrame:
            codes = _means(np.array(rows["part"].tolist(), np.float32), 256)
            return pd.DataFrame({"sub": [rows["sub"].iloc[0]], "codes": [codes.tolist()]})

        return sample.select(F.posexplode(cut("unit")).alias("sub", "part")).groupBy("sub").applyInPandas(learnt, "sub int, codes array<array<float>>")

    def _file(self, units: DataFrame) -> int:
        """Files those of units whose ids are not there; a run that broke off is taken up where it ended."""
        new = kept(units.dropDuplicates(["id"]).join(self._table("units").select("id"), "id", "left_anti"), "new")
        self._append(new, "units")
        codec = self.codec

        @F.pandas_udf("int")
        def placed(column: pd.Series) -> pd.Series:
            return pd.Series(codec.nearest(np.array(column.tolist(), np.float32), 1)[:, 0])

        filed = self._table("blocks").select(F.explode("ids").alias("id"))
        lacking = kept(self._table("units").join(filed, "id", "left_anti").withColumn("list", placed("unit")), "placed")
        n = lacking.count()
        if n:
            parts = lacking.repartitionByRange("list", "id").sortWithinPartitions("list", "id")  # a long list goes to several
            self._append(parts.select("id", "unit").mapInArrow(lambda b: _packed(b, codec), BLOCKS), "blocks")
        return n

    def add(self, vectors: DataFrame) -> int:
        """Files new vectors (id, embedding) with the centres and pieces that are there; ids that are filed keep their vectors. The number of new ones."""
        return self._file(units_of(vectors, self.width))

    def estimates(self, asked: DataFrame, probes: int, most: int, among: DataFrame | None = None) -> DataFrame:
        """query, id, estimate, place: the best by their codes in the lists that each of asked (query, unit) visits, of the ids in among if it is given."""
        codec = self.codec

        @F.pandas_udf("array<int>")
        def visited(column: pd.Series) -> pd.Series:
            return pd.Series(list(codec.nearest(np.array(column.tolist(), np.float32), probes)))

        visits = kept(asked.select("query", "unit", F.explode(visited("unit")).alias("list")), "visits")
        chunks = visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))  # a row a list
        spread = visits.join(F.broadcast(chunks), "list").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")))
        packed = spread.groupBy("list", "chunk").agg(F.collect_list(F.struct("query", "unit")).alias("asked"))  # about CHUNK at most
        met = self._table("blocks").join(packed, "list").select("list", "ids", "codes", "asked")
        each = most if among is None else BLOCK
        found = met.mapInArrow(lambda b: _estimated(b, codec, each), ESTIMATES)
        found = found if among is None else found.join(among.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("estimate"), "id"))
        return found.withColumn("place", place).where(F.col("place") <= most)

    def _rescored(self, asked: DataFrame, k: int, probes: int, rescored: int, among: DataFrame | None) -> DataFrame:
        few = self.estimates(asked, probes, max(k, rescored), among).select("query", "id")
        whole = few.join(self._table("units").dropDuplicates(["id"]), "id").join(asked.withColumnRenamed("unit", "x"), "query")
        scored = whole.select("query", "id", scoring.dot(F.col("x"), F.col("unit")).alias("score"))
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
        return kept(scored.withColumn("place", place).where(F.col("place") <= k).select("query", "id", "place", "score"), "nearest")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, rescored: int | None = None, among: DataFrame | None = None) -> DataFrame:
        """query, id, place, score: about the k filed vectors nearest to each of queries (id, embedding), by cosine, but for its own id; ties by id.

        among (id) is a scope. Queries that find fewer than k in their lists, for the scope is
        thin or the lists are short, visit all of them. Null and all-zero queries, and those of another width, have no answer.
        """
        if not self.width:
            return self.spark.createDataFrame([], "query long, id long, place int, score double")
        asked = kept(units_of(queries, self.width).select(F.col("id").alias("query"), "unit"), "asked")
        probes, rescored = probes or self.probes, rescored or self.rescored
        found = self._rescored(asked, k, probes, rescored, among)
        if probes >= len(self.codec.centres):
            return found
        full = found.where(F.col("place") == k).select("query")
        short = kept(asked.join(full, "query", "left_anti"), "short")
        if short.isEmpty():
            return found
        again = self._rescored(short, k, len(self.codec.centres), max(rescored, DEEPEST), among)
        return found.join(full, "query", "left_semi").select(*found.columns).unionByName(again)

    def _nearest_by_scan(self, asked: list, k: int) -> DataFrame:
        """query, id: the true neighbours of a few queries, which go to every task."""
        ids, units = np.array([r["id"] for r in asked]), np.array([r["unit"] for r in asked], np.float32)

        def best(batches):
            for batch in batches:
                own = batch.column("id").to_numpy()
                scores = units @ _matrix(batch.column("unit")).T
                scores[ids[:, None] == own[None, :]] = -np.inf
                n = min(k, len(own))
                at = np.argpartition(scores, len(own) - n, 1)[:, len(own) - n :] if n else np.zeros((len(ids), 0), int)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(own[at].ravel()), pa.array(np.take_along_axis(scores, at, 1).ravel())], ["query", "id", "estimate"])

        found = self._table("units").mapInArrow(best, ESTIMATES)
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("estimate"), "id"))
        return found.withColumn("place", place).where((F.col("place") <= k) & (F.col("estimate") > -2)).select("query", "id")

    def calibrate(self, recall: float = 0.95, k: int = 10) -> None:
        """Sets how many lists are visited, and estimates rescored, so that this share of the k true neighbours of CALIBRATION_ROWS stored vectors is found."""
        asked = self._table("units").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION_ROWS)
        rows = asked.collect()  # CALIBRATION_ROWS at most
        true = kept(self._nearest_by_scan(rows, k), "true")
        filed = self._table("blocks").select("list", F.explode("ids").alias("id"))
        lists = {r["query"]: r["lists"] for r in true.join(filed, "id").groupBy("query").agg(F.collect_list("list").alias("lists")).collect()}  # k of each
        order = self.codec.nearest(np.array([r["unit"] for r in rows], np.float32), len(self.codec.centres))
        places = sorted(int(np.flatnonzero(order[i] == at)[0]) + 1 for i, r in enumerate(rows) for at in lists.get(r["id"], []))
        if not places:
            return
        each = recall**0.5  # of either step
        self.probes = places[min(len(places) - 1, math.ceil(each * len(places)) - 1)]
        deep = self.estimates(asked.select(F.col("id").alias("query"), "unit"), self.probes, DEEPEST).join(true, ["query", "id"])
        found = sorted(r["place"] for r in deep.select("place").collect())  # k of each
        needed = min(len(found), math.ceil(recall * len(places)))
        self.rescored, self._nth = found[needed - 1] if found else DEEPEST, self._nth + 1
        self._append(self.spark.createDataFrame([(self._nth, self.probes, self.rescored)], "nth int, probes int, rescored int"), "settings")

    def visited_share(self, queries: DataFrame, probes: int | None = None) -> float:
        """Which share of all pairs of a query and a filed vector has its codes read."""
        sizes = {r["list"]: r["n"] for r in self._table("blocks").groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect()}  # a row a list
        size = np.array([sizes.get(i, 0) for i in range(len(self.codec.centres))])
        codec, probes = self.codec, probes or self.probes

        @F.pandas_udf("long")
        def read(column: pd.Series) -> pd.Series:
            return pd.Series(size[codec.nearest(np.array(column.tolist(), np.float32), probes)].sum(1))

        pairs, n = units_of(queries, self.width).agg(F.sum(read("unit")), F.count(F.lit(1))).first()
        return (pairs or 0) / max(1, n * int(size.sum()))
