"""Ranked retrieval: full text, vectors, and both fused."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.functions import predicates, scoring, text
from reverie.operators import graph


def postings(docs: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """id, term, tf and dl (the text's length in words): the index that a search reads."""
    worded = docs.select(F.col(id_col).alias("id"), text.index_words(F.coalesce(F.col(content), F.lit(""))).alias("w"))
    return worded.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """n, avgdl: how many docs there are and their mean length in words; part of the index, beside its postings."""
    return docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size(text.index_words(F.coalesce(F.col(content), F.lit(""))))).alias("avgdl"))


def bm25(docs: DataFrame, query: str, id_col: str = "id", content: str = "content", **how) -> DataFrame:
    """id, score of the docs that have a word of query. Texts are read once: their lengths and the words asked for are kept as a table."""
    wanted = F.slice(text.index_words(F.lit(query)), 1, text.QUERY_WORDS)
    worded = docs.select(F.col(id_col).alias("id"), text.index_words(F.coalesce(F.col(content), F.lit(""))).alias("w"))
    read = graph.kept(worded.select("id", F.size("w").alias("dl"), F.filter("w", lambda x: F.array_contains(wanted, x)).alias("asked")), "asked")
    hits = read.select("id", "dl", F.explode("asked").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return bm25_indexed(hits, read.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl")), query, **how)


def bm25_indexed(index: DataFrame, totals: DataFrame, query: str, k1: float = 1.2, b: float = 0.75, floor: float | None = 1e-6) -> DataFrame:
    """id, score of what has a word of query, from postings (id, term, tf, dl) and lengths; repeated words count again.

    Length and document counts are over all of the index, so that a scope set afterwards does not
    move scores. floor bounds the weight of frequent words; None takes the form that stays above 0.
    """
    wanted = F.slice(text.index_words(F.lit(query)), 1, text.QUERY_WORDS)
    asked = index.sparkSession.range(1).select(F.explode(wanted).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    hits = index.where(F.array_contains(wanted, F.col("term")))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    odds = (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))
    idf = F.greatest(F.log(odds), F.lit(floor)) if floor is not None else F.log(F.lit(1.0) + odds)
    weights = beside(df, totals).join(asked, "term").select("term", (idf * F.col("times")).alias("weight"), "avgdl")
    gain = F.col("weight") * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    return hits.join(F.broadcast(weights), "term").groupBy("id").agg(F.sum(gain).alias("score"))  # at most 32 words


def beside(df: DataFrame, totals: DataFrame) -> DataFrame:
    """df with the columns of totals, an aggregate of one row that the driver reads: no join is needed to put it beside every row."""
    row = totals.first()
    return df.withColumns({name: F.lit(row[name]).cast(kind) for name, kind in totals.dtypes})


def top(scored: DataFrame, k: int, score: str = "score", id_col: str = "id") -> DataFrame:
    return scored.orderBy(F.desc(score), id_col).limit(k)


def vector_scores(vectors: DataFrame, query: Column, model: str | None = None) -> DataFrame:
    """id, score: cosine of each vector to the query, among those of one model; no rows for an all-zero query."""
    own = vectors if model is None else vectors.where(F.col("embedding_model") == model)
    return own.where(F.col("embedding").isNotNull() & (scoring.norm(query) > 0)).select("id", scoring.cosine(F.col("embedding"), query).alias("score"))


def ranked(scored: DataFrame, name: str, score: str = "score") -> DataFrame:
    """A short list with its ranks from 0; for lists already cut to a few rows."""
    return scored.select("id", F.col(score).alias(f"{name}_score"), (F.row_number().over(W.orderBy(F.desc(score), "id")) - 1).alias(name))


def fused(by_vector: DataFrame, by_words: DataFrame, vector_weight: float = 1.0, word_weight: float = 1.0, k: int = 60) -> DataFrame:
    """id, vector and words (ranks from 0 or null), fused: reciprocal rank sum over its maximum of both short lists."""
    both = ranked(by_vector, "vector").join(ranked(by_words, "words"), "id", "full_outer")
    total = both.withColumn("sum", scoring.reciprocal(F.col("vector"), vector_weight, k) + scoring.reciprocal(F.col("words"), word_weight, k))
    most = F.max("sum").over(W.partitionBy(F.lit(1)))
    return total.select("id", "vector", "words", (F.col("sum") / F.when(most > 0, most).otherwise(F.lit(1.0))).alias("fused"))


def hybrid(memories: DataFrame, by_vector: DataFrame, by_words: DataFrame, now: str, limit: int = 10, widen: int = 3, weights: tuple[float, float, float] = (0.70, 0.15, 0.15), half_life: float = 30.0) -> DataFrame:
    """The limit best of memories (id, updated_at, importance) by fused rank, recency and importance.

    Either list is cut to limit * widen candidates; a list without rows leaves the other to rank.
    """
    n = limit * widen
    lists = fused(top(by_vector, n), top(by_words, n))
    recent = scoring.recency(F.col("updated_at"), F.expr(f"timestamp_ntz'{now}'"), half_life)
    a, b, c = weights
    score = F.lit(a) * F.col("fused") + F.lit(b) * recent + F.lit(c) * scoring.clamped(F.col("importance"))
    rows = memories.join(F.broadcast(lists), "id").withColumn("recency", recent).withColumn("score", score)  # 2 * n rows at most
    return rows.orderBy(F.desc("score"), F.asc_nulls_last("vector"), F.asc_nulls_last("words"), "id").limit(limit)


def relational_fusion(by_rank: DataFrame, by_graph: DataFrame, protect: int = 5, boost_from: int = 10, k: int = 60) -> DataFrame:
    """id, place of a hybrid list (id, rank from 0) joined with a graph list (id, rank from 0).

    The first few of the hybrid list keep their places. Others go by 1 / (k + rank) of either list;
    the graph's counts where the hybrid list lacks the row or has it from boost_from on.
    """
    both = by_rank.withColumnRenamed("rank", "h").join(by_graph.withColumnRenamed("rank", "g"), "id", "full_outer")
    boosted = F.col("h").isNull() | (F.col("h") >= boost_from)
    score = scoring.reciprocal(F.col("h"), 1.0, k, 0) + F.when(boosted, scoring.reciprocal(F.col("g"), 1.0, k, 0)).otherwise(F.lit(0.0))
    free = F.coalesce(F.col("h") >= protect, F.lit(True))
    keyed = both.select("id", F.when(~free, F.col("h")).alias("pinned"), score.alias("s"), "h", "g")
    placed = graph.numbered(keyed, F.asc_nulls_last("pinned"), F.desc("s"), F.asc_nulls_last("h"), F.asc_nulls_last("g"), F.col("id"))
    return placed.select("id", F.col("rank").alias("place"), F.round("s", 6).alias("fused"))


def relational(told: DataFrame, memories: DataFrame, reached: DataFrame, seeds: DataFrame, per_entity: int = 25) -> DataFrame:
    """id, rank (from 0): memories (id, updated_at) that mention (told: entity_id, id) what relations reach (entity_id, hop), nearest first, and after them those of the seeds (entity_id).

    Each entity gives its latest per_entity; a memory stands where it comes first.
    """
    own = reached.select("entity_id", "hop").unionByName(seeds.join(reached.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lit(1 << 20).alias("hop")))
    links = told.join(own, "entity_id").join(memories.select("id", "updated_at"), "id")
    few = graph.per_key(links, "entity_id", [F.desc("updated_at"), F.col("id")], per_entity)
    first = few.groupBy("id").agg(F.min(F.struct("hop", "entity_id", "place")).alias("first"))
    return graph.numbered(first.select("id", "first.hop", "first.entity_id", "first.place"), "hop", "entity_id", "place").select("id", "rank")


def search(memories: DataFrame, lists: tuple[DataFrame, DataFrame] | None, walked: DataFrame | None, now: str, limit: int = 10, since: str | None = None, until: str | None = None, filtered: bool = False, include_invalid: bool = False) -> DataFrame:
    """id, place of a whole search: lists are its vector and word scores (None for a blank query), walked (id, rank from 0) what typed relations reach.

    A blank query browses active memories, the latest first. Otherwise the fetch is widened where dates or the graph take part;
    the graph joins in only without a category or entity filter, and brings active memories alone; the dates come last.
    """
    seen = memories.where(predicates.within(F.col("created_at"), since, until))
    if lists is None:
        own = seen if include_invalid else seen.where("invalid_at IS NULL")
        return own.orderBy(F.desc("updated_at"), "seq").limit(limit).select("id", F.row_number().over(W.orderBy(F.desc("updated_at"), "seq")).alias("place"))
    fused_in = walked is not None and not filtered
    fetch = min(max(limit * 8, 40), 500) if since or until or fused_in else limit
    found = hybrid(memories, *lists, now, fetch)
    order = W.orderBy(F.desc("score"), F.asc_nulls_last("vector"), F.asc_nulls_last("words"), "id")
    ranked_ = graph.kept(found.select("id", (F.row_number().over(order) - 1).alias("rank")), "found")
    placed = ranked_.select("id", F.col("rank").alias("place"))
    if fused_in:
        alive = memories if include_invalid else memories.where("invalid_at IS NULL")
        there = walked.join(alive.select("id").union(ranked_.select("id")), "id", "left_semi")
        placed = relational_fusion(ranked_, there)
    kept_ = placed.join(seen.select("id"), "id", "left_semi")
    return kept_.orderBy("place").limit(limit).select("id", F.row_number().over(W.orderBy("place")).alias("place"))


#: Pivots of similarity cells at most (they grow with the root of the vectors' number), vectors of a sub-block, about as many as travel as one row, and rows of one product.
PIVOTS, SUB_BLOCK, PRODUCT = 4096, 8192, 1024


def _assigned(pivots: np.ndarray):
    """Pandas UDF embedding -> (nearest pivot, angle to it)."""

    @F.pandas_udf("cell int, angle double")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        near = np.clip(_units(vectors) @ pivots.T, -1, 1)
        cell = near.argmax(1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": np.arccos(near[np.arange(len(vectors)), cell])})

    return assign


def _units(vectors) -> np.ndarray:
    x = np.asarray(vectors.tolist(), np.float64).reshape(len(vectors), -1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def _packer(kind: str):
    """A sub-block as one row, its vectors by cell and as they are stored."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cell", "id"], kind="stable")
        vectors = np.array(rows["embedding"].tolist(), kind)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "ids": [rows["id"].to_numpy()], "cells": [rows["cell"].to_numpy()], "vectors": [vectors.tobytes()]})

    return packed


def _forest(low: np.ndarray, high: np.ndarray) -> list[int]:
    """Which of the links are enough to join the same components."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    keep = []
    for t, (p, q) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
            keep.append(t)
    return keep


def _products(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, meet: np.ndarray):
    """i, j, similarity of parts of x and y, whose cells may meet; bounded in size."""
    starts = [0, *(np.flatnonzero(of_x[1:] != of_x[:-1]) + 1).tolist(), len(x)]
    if meet[np.ix_(np.unique(of_x), np.unique(of_y))].all():  # nothing is ruled out
        starts = [0, len(x)]
    for s, e in zip(starts, starts[1:], strict=False):
        own = np.flatnonzero(meet[of_x[s], of_y])
        if len(own):
            there = y if len(own) == len(y) else y[own]
            for t in range(s, e, PRODUCT):
                yield t, own, x[t : min(t + PRODUCT, e)] @ there.T


def _met(frames, least: float, links_only: bool, kind: str, meet: np.ndarray):
    """Pairs of each two sub-blocks that meet; meet: which cells may hold one."""
    for frame in frames:
        for _, m in frame.iterrows():
            a, b = np.asarray(m["ids"]), np.asarray(m["ids_2"])
            x, y = (_units(np.frombuffer(m[c], kind).reshape(len(ids), -1)) for c, ids in (("vectors", a), ("vectors_2", b)))
            for t, own, similarity in _products(x, y, np.asarray(m["cells"]), np.asarray(m["cells_2"]), meet):
                i, j = np.nonzero(similarity >= least)
                near, i, j = similarity[i, j], i + t, own[j]
                keep = a[i] < b[j] if m["g"] == m["h"] else a[i] != b[j]
                i, j, near = i[keep], j[keep], near[keep]
                low, high = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
                if links_only and len(low):
                    keep = _forest(low, high)
                    low, high, near = low[keep], high[keep], near[keep]
                yield pd.DataFrame({"a": low, "b": high, "similarity": near})


def _meetings(blocks: DataFrame, meet: np.ndarray, ends: np.ndarray) -> DataFrame:
    """g, h: sub-blocks that may hold a pair, each two once; every sub-block finds its own, on its task. ends: the first and last sub-block of each cell."""

    def partners(frames):
        for frame in frames:
            for g in frame["block"].tolist():
                own = np.flatnonzero((ends[0] <= g) & (g <= ends[1]))
                cells = np.flatnonzero(meet[own].any(0) & (ends[0] <= ends[1]))
                met = np.unique(np.concatenate([np.arange(max(g, i), j + 1) for i, j in zip(ends[0][cells].tolist(), ends[1][cells].tolist(), strict=True)] + [np.array([g])]))
                yield pd.DataFrame({"g": np.full(len(met), g, np.int64), "h": met.astype(np.int64)})

    return blocks.select("block").mapInPandas(partners, "g long, h long")


def similarity_pairs(vectors: DataFrame, least: float, links_only: bool = False) -> DataFrame:
    """a < b, similarity of all vectors (id, embedding) at least that alike, exactly; with links_only as many pairs as join the same components.

    Vectors go to the nearest of some pivots. Two of them can be that alike only if their pivots'
    angle is at most both cells' radii and the angle of the similarity together; only such pairs
    of cells meet, as products of matrices of bounded size. Cells, neighbours beside each other, lie in
    sub-blocks of about equal size, which travel as one row to each sub-block that they may meet; so a
    vector travels as often as there are sub-blocks, at most. The driver holds the pivots and a number of
    each cell; which sub-blocks meet is found on Spark. Vectors of zero are like none.
    """
    spark = vectors.sparkSession
    own = vectors.where(F.col("embedding").isNotNull() & (scoring.norm(F.col("embedding")) > 0)).select(F.col("id").cast("long").alias("id"), "embedding")
    copies = None
    if links_only:  # equal vectors are linked to the first of them, and only that one is compared
        first = graph.kept(own.groupBy("embedding").agg(F.min("id").alias("first")), "distinct")
        copies = own.join(first, "embedding").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
        own = first.select(F.col("first").alias("id"), "embedding")
    n = own.count()
    if not n:
        return spark.createDataFrame([], "a long, b long, similarity double")
    wanted = min(PIVOTS, max(1, int(n**0.5)))
    picked = np.array([r["embedding"] for r in own.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()], np.float64)  # PIVOTS rows at most
    pivots = _beside_each_other(picked / np.linalg.norm(picked, axis=1, keepdims=True))
    placed = graph.kept(own.withColumn("at", _assigned(pivots)("embedding")).select("id", "embedding", "at.cell", "at.angle"), "placed")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    radii, sizes = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in cells.collect():  # a row a pivot
        radii[r["cell"]], sizes[r["cell"]] = r["radius"], r["n"]
    between, reach = np.arccos(np.clip(pivots @ pivots.T, -1, 1)), float(np.arccos(min(1.0, max(-1.0, least)))) + 1e-6
    meet = between <= radii[:, None] + radii[None, :] + reach  # a byte for each two pivots, which tasks get
    start = np.cumsum(sizes) - sizes
    ends = np.array([start // SUB_BLOCK, np.where(sizes > 0, (start + sizes - 1) // SUB_BLOCK, -1)])
    offsets = F.array(*[F.lit(int(x)) for x in start])  # PIVOTS numbers at most
    counts = F.array(*[F.lit(int(x)) for x in np.maximum(sizes, 1)])
    block = F.floor((F.get(offsets, F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(counts, F.col("cell")))) / SUB_BLOCK).cast("long")
    kind = "float32" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "float64"
    packed = graph.kept(placed.select(block.alias("block"), "cell", "id", "embedding").groupBy("block").applyInPandas(_packer(kind), "block long, ids array<bigint>, cells array<int>, vectors binary"), "blocks")
    few = max(1, min(int(ends[1].max()) + 1, spark.sparkContext.defaultParallelism))
    meetings = _meetings(packed.select("block").repartition(few), meet, ends)
    left = packed.select(F.col("block").alias("g"), "ids", "cells", "vectors")
    right = packed.select(F.col("block").alias("h"), F.col("ids").alias("ids_2"), F.col("cells").alias("cells_2"), F.col("vectors").alias("vectors_2"))
    both = meetings.join(left, "g").join(right, "h")
    met = both.mapInPandas(lambda frames: _met(frames, least, links_only, kind, meet), "a long, b long, similarity double")
    return met if copies is None else met.unionByName(copies)


def _beside_each_other(pivots: np.ndarray) -> np.ndarray:
    """pivots in an order in which each is followed by the nearest one that is left."""
    order, free = [0], np.ones(len(pivots), bool)
    free[0] = False
    for _ in range(len(pivots) - 1):
        order.append(int(np.where(free, pivots @ pivots[order[-1]], -2).argmax()))
        free[order[-1]] = False
    return pivots[order]
