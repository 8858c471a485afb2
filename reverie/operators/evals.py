"""How well retrieval answers questions with known keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.functions import text
from reverie.operators.search import beside


def answers(memories: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """case, id, place, content: for each of asked (case, q) the k memories (id, content) with the best word match."""
    worded = memories.select("id", "content", text.index_words(F.coalesce("content", F.lit(""))).alias("w"))
    totals = worded.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    terms = asked.select("case", F.explode(F.slice(text.index_words(F.col("q")), 1, text.QUERY_WORDS)).alias("term")).groupBy("case", "term").agg(F.count(F.lit(1)).alias("times"))
    spread = worded.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    tf = spread.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))), F.lit(1e-6))
    gain = idf * F.col("times") * F.col("tf") * F.lit(2.2) / (F.col("tf") + F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * F.col("dl") / F.col("avgdl")))
    scored = beside(tf.join(df, "term").join(terms, "term"), totals).groupBy("case", "id").agg(F.sum(gain).alias("score"))
    best = scored.withColumn("place", F.row_number().over(W.partitionBy("case").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k)
    return best.join(memories.select("id", "content"), "id").select("case", "id", "place", "content")


def first_hits(found: DataFrame, asked: DataFrame) -> DataFrame:
    """case, first_hit: the first place whose content has any of the case's keywords; null without one."""
    hit = F.exists("keywords", lambda w: F.contains(F.lower("content"), F.lower(w)))
    hits = found.join(asked.select("case", "keywords"), "case").where(hit).groupBy("case").agg(F.min("place").alias("first_hit"))
    return asked.select("case").join(hits, "case", "left")


def nearest_rank(values: DataFrame, column: str, shares: tuple[float, ...], cells: int = 1024) -> list[float | None]:
    """The exact value at place round(share * (n - 1)) of a sorted column, for each share.

    Counts by ranges of value (one small row a range) tell which range holds a place, and ranges
    narrow until they hold one value; no task sorts or holds the column.
    """
    own = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    found = []
    for share in shares:
        low, high, n = own.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
        part, rank = own, round(share * (n - 1)) if n else 0
        while n and low < high:
            cell = F.least(F.floor((F.col("x") - low) / (high - low) * cells), F.lit(cells - 1))
            before = 0
            for r in sorted(part.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()):  # cells rows at most
                if before + r["n"] > rank:
                    rank, low, high = rank - before, r["low"], r["high"]
                    part = own.where((F.col("x") >= low) & (F.col("x") <= high))
                    break
                before += r["n"]
        found.append(low if n else None)
    return found


def summary(cases: DataFrame) -> DataFrame:
    """recall, mrr of cases (first_hit or null, ms), and the ms at the nearest rank of the half and the 95th of a hundred."""
    half, most = nearest_rank(cases, "ms", (0.5, 0.95))
    hits = cases.agg(F.round(F.avg(F.when(F.col("first_hit").isNotNull(), 1.0).otherwise(0.0)), 6).alias("recall"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))), 6).alias("mrr"))
    return hits.withColumns({"p50": F.lit(half).cast("double"), "p95": F.lit(most).cast("double")})


def metrics(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    return first_hits(found.where(F.col("place") <= k), asked).agg(
        F.avg(F.when(F.col("first_hit").isNotNull(), 1.0).otherwise(0.0)).alias("recall"), F.avg(F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("questions")
    )
