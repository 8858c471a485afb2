"""Exact k nearest binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into segments, each with a table of its values. A query looks up the
values within radius 0 of its first segment, of its second and so on, then within radius 1, and
so on. After step R = r * segments + a, segments 0 to a have been searched to radius r and the
others to r - 1; a code at distance R or less differs by that little in one of them, so all of
these are found and verified. A query stops once k verified codes lie within R.

The work is on distinct codes: a code that many rows share is searched for and found once.
Index and queries meet in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.llm.common import load, partitions, written

BITS = 64
#: Codes and queries of a block.
INDEX_BLOCK, QUERY_BLOCK = 1 << 16, 1 << 15
SEARCHED = "query_code long, code long, distance int"


def sign_codes(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, code: bit i is set where element i is above 0; missing elements and null vectors have no bits. A vector of more than 64 elements is an error: it does not fit a code."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    bits = F.transform(vector_col, bit)
    wide = F.raise_error(F.concat(F.lit("a vector has more than 64 elements: "), F.size(vector_col).cast("string"))).cast("long")
    code = F.when(F.size(vector_col) > BITS, wide).otherwise(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    return table.select(F.col(id_col).cast("long").alias("id"), F.coalesce(code, F.lit(0).cast("long")).alias("code"))


class SegmentIndex:
    """Multi-index hashing over distinct codes (uint64); ties go by rank, ascending."""

    def __init__(self, codes: np.ndarray, rank: np.ndarray):
        self.codes, self.rank = codes, rank
        width = min(16, max(4, round(np.log2(max(2, len(codes))))))
        self.m = -(-BITS // width)
        cuts = [BITS * j // self.m for j in range(self.m + 1)]
        self.segments = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            mask = np.uint64((1 << (b - a)) - 1)
            values = ((codes >> np.uint64(a)) & mask).astype(np.int64)
            order = np.argsort(values, kind="stable")
            self.segments.append((np.uint64(a), mask, order, np.searchsorted(values[order], np.arange((1 << (b - a)) + 1))))
        all_values = {b - a: np.arange(1 << (b - a)) for a, b in zip(cuts, cuts[1:], strict=False)}
        self.near = {w: [v[np.bitwise_count(v) == r] for r in range(w + 1)] for w, v in all_values.items()}
        self.widths = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        self.seen = np.zeros(len(codes), bool)

    def search(self, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the k nearest codes, all of them if there are fewer."""
        q, found, dist, total = np.uint64(query), [], [], np.zeros(BITS + 1, np.int64)
        for step in range(self.m * (max(self.widths) + 1)):
            r, j = divmod(step, self.m)
            shift, mask, order, starts = self.segments[j]
            if r <= self.widths[j]:
                values = int((q >> shift) & mask) ^ self.near[self.widths[j]][r]
                lo, n = starts[values], starts[values + 1] - starts[values]
                ends = np.cumsum(n)
                at = order[np.repeat(lo - ends + n, n) + np.arange(ends[-1])]
                at = at[~self.seen[at]]
                self.seen[at] = True
                d = np.bitwise_count(self.codes[at] ^ q).astype(np.int64)
                found.append(at)
                dist.append(d)
                total += np.bincount(d, minlength=BITS + 1)
            if total[: step + 1].sum() >= k:
                break
        at, d = np.concatenate(found), np.concatenate(dist)
        self.seen[at] = False
        best = np.lexsort((self.rank[at], d))[:k]
        return at[best], d[best]


def _block(index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(index) or not len(queries):
        return pd.DataFrame({"query_code": [], "code": [], "distance": []}).astype({"query_code": "int64", "code": "int64", "distance": "int32"})
    codes = index["code"].to_numpy(np.int64)
    table, out = SegmentIndex(codes.view(np.uint64), index["least"].to_numpy(np.int64)), []
    for q in queries["query_code"].to_numpy(np.int64):
        at, d = table.search(int(q.view(np.uint64)), k)
        out.append((np.full(len(at), q), codes[at], d.astype(np.int32)))
    return pd.DataFrame({name: np.concatenate(c) for name, c in zip(("query_code", "code", "distance"), zip(*out, strict=True), strict=True)})


def nearest(table: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (1 to k), id, distance: the k rows of table (id, code) nearest to each of queries (id, code), ties by id.

    A row is no neighbour of a query of its own id. Rows without id are not searched for and ask
    nothing; repeated queries answer once; fewer than k rows give fewer neighbours. Only the
    k + 1 least ids of a code can be among any query's k nearest, so a code keeps no more.
    """
    table = table.where("id IS NOT NULL").distinct()
    queries = written(queries.where("id IS NOT NULL").distinct(), "queries", 8)
    place = F.row_number().over(W.partitionBy("code").orderBy("id"))
    codes = written(table.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes", 4)
    asked = written(queries.select(F.col("code").alias("query_code")).distinct(), "query-codes", 8)
    n, m = codes.count(), asked.count()
    index_blocks = max(1, -(-n // INDEX_BLOCK))
    query_blocks = max(1, -(-m // QUERY_BLOCK), -(-partitions(table.sparkSession) // index_blocks))
    own = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = codes.select("code", F.get("ids", F.lit(0)).alias("least"), own("code", index_blocks).alias("i")).withColumn("j", every(query_blocks))
    right = asked.select("query_code", own("query_code", query_blocks).alias("j")).withColumn("i", every(index_blocks))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(lambda index, asks: _block(index, asks, k + 1), SEARCHED)
    members = found.join(codes, "code").select("query_code", "distance", F.explode("ids").alias("id"))
    nearest_ids = F.row_number().over(W.partitionBy("query_code").orderBy("distance", "id"))
    few = members.withColumn("nth", nearest_ids).where(F.col("nth") <= k + 1)
    answers = few.groupBy("query_code").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))  # k + 1 at most
    asked_rows = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query_code")).join(answers, "query_code")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return asked_rows.select("query_id", F.posexplode(others)).select("query_id", (F.col("pos") + 1).alias("rank"), "col.id", "col.distance")


def query(spark, sf_dir: str) -> DataFrame:
    codes = sign_codes(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(codes, codes.where(F.col("id") % 20 == 0))


ORACLE = """
WITH bits AS (SELECT vec_id AS id, list_aggregate(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS UBIGINT) << CAST(i - 1 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END), 'bit_or') AS code FROM embeddings),
pairs AS (
  SELECT q.id AS query_id, b.id AS id, CAST(bit_count(xor(q.code, b.code)) AS INT) AS distance
  FROM bits q JOIN bits b ON q.id <> b.id WHERE q.id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank FROM pairs)
SELECT query_id, rank, id, distance FROM ranked WHERE rank <= 10
"""
