"""Hard negatives by inner products of whole-number vectors, found through a PCA rotation.

An orthogonal rotation leaves inner products alone and gathers most of a product in the leading
components. For blocks of anchors and rows partial products over the leading components are
summed, and the rest is bounded by the product of both residual norms, plus a slack for rounding.
Rows that no anchor of the block can need any more are discarded before the next components; what
survives is verified with whole-number products, which alone decide. The rotation comes from the
second moments of all rows; a poor one would cost time, not results.

Two passes: the positives of every anchor, then the negatives in their score bands. Rows lie in
blocks by label. Blocks of anchors, the smaller side, are copied to SLOTS-many slots over which
the blocks of rows are spread; a label that many rows have fills many blocks.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.llm.common import load, partitions, written
from reverie.llm.vectors import blocks, matrix, products, row_count, whole

#: Rows, and anchors, of a block.
ROW_BLOCK, ANCHOR_BLOCK = 2048, 256
#: Leading components after which rows are discarded.
STAGES = (8, 16, 32)
FACTOR, POSITIVES, NEGATIVES, LEAST_PERCENT = 256, 5, 5, 80

CELLS = "i int, j int, total double"
ROW_BLOCKS = "ids array<bigint>, labels array<int>, points binary, rotated binary"
ANCHOR_BLOCKS = "anchor_ids array<bigint>, anchor_labels array<int>, anchors binary, positive_ids array<bigint>, positive_scores array<bigint>"
POSITIVE = "anchor_id bigint, positive_id bigint, positive_score bigint"
NEGATIVE = "anchor_id bigint, nth int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def _moments(batches, width: int):
    total = np.zeros((width, width))
    for batch in batches:
        x = matrix(batch.column("v"), width).astype(np.float64)
        total += x.T @ x
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "total"])


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Orthogonal columns, that of the greatest second moment of all rows (v) first; width * width sums come to the driver."""
    cells = rows.select("v").mapInArrow(lambda b: _moments(b, width), CELLS).groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    moments = np.zeros((width, width))
    for r in cells:
        moments[r["i"], r["j"]] = r["total"]
    return np.linalg.eigh(moments / max(1.0, np.abs(moments).max(initial=0)))[1][:, ::-1]


def _row_blocks(batches, turn: np.ndarray):
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("points", pa.binary()), ("rotated", pa.binary())])
    for table in blocks(batches, ROW_BLOCK):
        points = matrix(table["v"], len(turn))
        row = {"ids": table["id"].to_numpy(), "labels": table["label"].to_numpy(), "points": points.tobytes(), "rotated": (points @ turn).astype(np.float32).tobytes()}
        yield pa.RecordBatch.from_pylist([row], schema)


def _anchor_blocks(batches, width: int):
    schema = pa.schema([("anchor_ids", pa.list_(pa.int64())), ("anchor_labels", pa.list_(pa.int32())), ("anchors", pa.binary()), ("positive_ids", pa.list_(pa.int64())), ("positive_scores", pa.list_(pa.int64()))])
    for table in blocks(batches, ANCHOR_BLOCK):
        row = {"anchor_ids": table["id"].to_numpy(), "anchor_labels": table["label"].to_numpy(), "anchors": matrix(table["v"], width).tobytes(), "positive_ids": [], "positive_scores": []}
        if "positives" in table.column_names:  # flat; missing ones are null
            flat = table["positives"].combine_chunks().flatten()
            row |= {"positive_ids": flat.field("id").to_pylist(), "positive_scores": flat.field("score").to_pylist()}
        yield pa.RecordBatch.from_pylist([row], schema)


class Bounds:
    """Bounds of all products of the rows of a with those of b, closer with every stage; columns are rows of b that are still needed."""

    def __init__(self, a: np.ndarray, b: np.ndarray, columns: np.ndarray):
        self.a, self.b, self.columns, self.done = a, b[columns], columns, 0
        # each of width products and sums rounds by 2^-24, and each rotated component did
        self.slack = (a.shape[1] + 8) * 2.0**-23
        self.partial = np.zeros((len(a), len(columns)), np.float32)
        self.norm_a, self.norm_b = self._norm(a), self._norm(self.b)
        self.upper = self.lower = self.partial

    @staticmethod
    def _norm(x: np.ndarray) -> np.ndarray:
        return (np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64)) * (1 + 1e-6)).astype(np.float32)

    def extend(self, upto: int) -> None:
        """Partial products over the components before `upto`."""
        self.partial += self.a[:, self.done : upto] @ self.b[:, self.done : upto].T
        self.done = upto
        rest = np.outer(self._norm(self.a[:, upto:]), self._norm(self.b[:, upto:])) + self.slack * np.outer(self.norm_a, self.norm_b)
        self.upper, self.lower = self.partial + rest, self.partial - rest

    def discard(self, alive: np.ndarray) -> np.ndarray:
        """Goes on with the columns alive for some row of a; alive of these."""
        needed = alive.any(0)
        if needed.all():
            return alive
        self.columns, self.b, self.partial, self.norm_b = self.columns[needed], self.b[needed], self.partial[:, needed], self.norm_b[needed]
        self.upper, self.lower = self.upper[:, needed], self.lower[:, needed]
        return alive[:, needed]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf, np.float32)
    return np.partition(values, values.shape[1] - k, 1)[:, values.shape[1] - k]


def _stages(width: int) -> list[int]:
    return [s for s in STAGES if s < width] + [width]


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best by score, then by smaller id."""
    if len(scores) > 4 * k:
        few = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return few[np.lexsort((ids[few], -scores[few]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Block:
    """A row of the joined blocks, as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int, turn: np.ndarray):
        get = lambda c: batch.column(c)[i]
        numbers = lambda c: get(c).values.to_numpy(zero_copy_only=False)
        width = len(turn)
        self.ids, self.labels, self.anchor_ids, self.anchor_labels = map(numbers, ("ids", "labels", "anchor_ids", "anchor_labels"))
        self.points, self.anchors = (np.frombuffer(get(c).as_py(), np.int32).reshape(-1, width) for c in ("points", "anchors"))
        self.rotated = np.frombuffer(get("rotated").as_py(), np.float32).reshape(-1, width)
        self.turned = (self.anchors @ turn).astype(np.float32)
        self.positive_ids = get("positive_ids").values
        self.positive_scores = get("positive_scores").values

    def exact(self, anchor: int, rows: np.ndarray) -> np.ndarray:
        return products(self.points[rows], self.anchors[anchor : anchor + 1])[:, 0]

    def positives(self, k: int):
        """(anchor, rows, scores): the k best rows of its label, but for itself."""
        for label in np.intersect1d(self.anchor_labels, self.labels):
            own = np.flatnonzero(self.anchor_labels == label)
            bounds = Bounds(self.turned[own], self.rotated, np.flatnonzero(self.labels == label))
            alive = self.anchor_ids[own][:, None] != self.ids[bounds.columns][None, :]
            for upto in _stages(len(self.turned[0])):
                bounds.extend(upto)
                alive &= bounds.upper >= _kth(np.where(alive, bounds.lower, -np.inf), k)[:, None]
                alive = bounds.discard(alive)
            for anchor, keep in zip(own, alive, strict=True):
                rows = bounds.columns[keep]
                scores = self.exact(anchor, rows)
                best = _first(scores, self.ids[rows], k)
                yield anchor, rows[best], scores[best]

    def negatives(self, k: int, least: tuple[int, int]):
        """(anchor, nth positive, rows, scores): the k best rows of other labels in the band of each positive."""
        n = len(self.anchor_ids)
        missing = self.positive_scores.is_null().to_numpy(zero_copy_only=False).reshape(n, -1)
        high = self.positive_scores.fill_null(0).to_numpy(zero_copy_only=False).reshape(n, -1)
        low = -((-least[0] * high) // least[1])
        # floats on the safe side; an empty band has its ends crossed
        lows, highs = (np.nextafter(x.astype(np.float32), np.float32(way)) for x, way in ((low, -np.inf), (high, np.inf)))
        lows[missing | (low > high)] = np.inf
        bounds = Bounds(self.turned, self.rotated, np.arange(len(self.ids)))
        alive = self.anchor_labels[:, None] != self.labels[None, :]
        for upto in _stages(len(self.turned[0])):
            bounds.extend(upto)
            alive = bounds.discard(alive & (bounds.upper >= lows.min(1)[:, None]))
            needed = np.zeros_like(alive)
            for p in range(high.shape[1]):
                lo, hi = lows[:, p, None], highs[:, p, None]
                sure = alive & (bounds.lower >= np.nextafter(np.nextafter(lo, np.float32(np.inf)), np.float32(np.inf))) & (bounds.upper <= np.nextafter(np.nextafter(hi, np.float32(-np.inf)), np.float32(-np.inf)))
                enough = np.maximum(lo[:, 0], _kth(np.where(sure, bounds.lower, -np.inf), k))
                needed |= (bounds.upper >= enough[:, None]) & (bounds.lower <= hi)
            alive = bounds.discard(alive & needed)
            if not alive.any():
                return
        for anchor in np.flatnonzero(alive.any(1)):
            rows = bounds.columns[alive[anchor]]
            scores = self.exact(anchor, rows)
            for p in np.flatnonzero(~missing[anchor]):
                inside = np.flatnonzero((low[anchor, p] <= scores) & (scores <= high[anchor, p]))
                if len(inside):
                    best = inside[_first(scores[inside], self.ids[rows[inside]], k)]
                    yield anchor, p, rows[best], scores[best]


def _in_rows(parts: list[list], schema: pa.Schema) -> pa.RecordBatch:
    """Parts of columns, one number or an array each, as one batch."""
    columns = zip(*[[np.broadcast_to(c, len(part[-1])) for c in part] for part in parts], strict=True) if parts else [[np.zeros(0)]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _positives(batches, turn: np.ndarray, k: int):
    schema = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score")])
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block(batch, i, turn)
            yield _in_rows([[block.anchor_ids[a], block.ids[rows], scores] for a, rows, scores in block.positives(k)], schema)


def _negatives(batches, turn: np.ndarray, k: int, least: tuple[int, int]):
    schema = pa.schema([("anchor_id", pa.int64()), ("nth", pa.int32()), *[(c, pa.int64()) for c in ("positive_id", "positive_score", "negative_id", "negative_score")]])
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block(batch, i, turn)
            each = len(block.positive_scores) // max(1, len(block.anchor_ids))
            of = lambda column, a, p, each=each: column[int(each * a + p)].as_py()
            parts = [[block.anchor_ids[a], p, of(block.positive_ids, a, p), of(block.positive_scores, a, p), block.ids[rows], scores] for a, p, rows, scores in block.negatives(k, least)]
            yield _in_rows(parts, schema)


def _met(row_blocks: DataFrame, anchors: DataFrame, n_anchors: int, width: int) -> DataFrame:
    """Each block of rows beside each block of anchors."""
    spark = row_blocks.sparkSession
    slots = partitions(spark)
    packed = anchors.coalesce(max(1, -(-n_anchors // ANCHOR_BLOCK))).mapInArrow(lambda b: _anchor_blocks(b, width), ANCHOR_BLOCKS)
    copied = packed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    spread = row_blocks.withColumn("slot", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(slots)).cast("int"))
    return spread.join(copied, "slot").drop("slot")


def _best(found: DataFrame, of: list[str], name: str, k: int) -> DataFrame:
    order = W.partitionBy(*of).orderBy(F.col(f"{name}_score").desc(), f"{name}_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (id long, label int, v array<int>).

    is_anchor is a condition on id. The score of two rows is their inner product; a shorter vector
    counts as filled up with 0. Higher scores come first, then smaller ids. For each of an anchor's
    first `positives` other rows of its label the first `negatives` rows of other labels with
    least_percent of the positive's score or more, and no more than it. Rows with a null take no
    part. Of rows that share an id the least by label and vector counts. Fewer rows than asked for
    are all of them; an anchor without positives, or without negatives in a band, has no rows.
    """
    own = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "v")).alias("least")).select("id", "least.label", "least.v")
    spark = rows.sparkSession
    kept = written(own.repartitionByRange(partitions(spark), "label", "id").sortWithinPartitions("label", "id"), "rows")
    width = max(1, kept.agg(F.max(F.size("v"))).first()[0] or 0)
    turn = rotation(kept, width)
    row_blocks = written(kept.mapInArrow(lambda b: _row_blocks(b, turn), ROW_BLOCKS), "row-blocks")
    anchors = kept.where(is_anchor)
    n_anchors = row_count(anchors)
    found = _met(row_blocks, anchors, n_anchors, width).mapInArrow(lambda b: _positives(b, turn, positives), POSITIVE)
    best = _best(found, ["anchor_id"], "positive", positives)
    listed = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))  # `positives` of them at most
    padded = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.get("positives", i))
    asked = written(anchors.join(listed, anchors["id"] == listed["anchor_id"]).select("id", "label", "v", padded.alias("positives")), "anchors", 8)
    divisor = gcd(least_percent, 100)
    least = (least_percent // divisor, 100 // divisor)
    mined = _met(row_blocks, asked, n_anchors, width).mapInArrow(lambda b: _negatives(b, turn, negatives, least), NEGATIVE)
    return _best(mined, ["anchor_id", "nth"], "negative", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select(F.col("vec_id").cast("long").alias("id"), label.cast("int").alias("label"), whole(F.col("embedding"), FACTOR).alias("v"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


ORACLE = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
p AS (SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS nth FROM p WHERE same QUALIFY nth <= 5)
SELECT pos.anchor_id, pos.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY pos.anchor_id, pos.other_id ORDER BY n.score DESC, n.other_id) AS INT) AS rank, n.other_id AS negative_id, pos.score AS positive_score, n.score AS negative_score
FROM pos JOIN p n ON n.anchor_id = pos.anchor_id AND NOT n.same AND 80 * pos.score <= 100 * n.score AND 100 * n.score <= 100 * pos.score QUALIFY rank <= 5
"""
