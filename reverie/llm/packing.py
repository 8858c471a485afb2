"""Packing documents into token sequences: shortest-pack-first over the length histogram.

Documents are cut into whole sequences and a rest; the pieces' lengths are counted, and the
histogram (as many entries as a sequence has tokens) alone goes to the driver. Lengths are
placed longest first into the pack with most room, many equal packs at once: a group of packs
with the same pattern is a range of sequence numbers. The placements (length, ranks, first
sequence, offset) then join back to the pieces by their rank among those of the same length.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.llm.common import TOKEN_RUN, load, runs_of, small_batches, token_bytes, word_bpe_path, written

SEQUENCE = 2048
PIECES = "part int, doc_id long, start long, length int, doc_tokens long, ids binary, nth long"
#: Bytes of ids in a batch that a task hands back.
BATCH_BYTES = 8 << 20


def pack_histogram(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, end rank, first sequence, offset) of counts pieces of each length, all at most size.

    The pieces of ranks first..end of that length go to consecutive sequences at that offset.
    A placement uses up either a length or a group of equal packs, so their number follows
    the lengths and not the pieces.
    """
    out: list[tuple[int, int, int, int, int]] = []
    packs: list[tuple[int, int, int]] = []  # used, first sequence, end
    new = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if packs and packs[0][0] + length <= size:
                used, a, b = heapq.heappop(packs)
                n = min(left, b - a)
                if n < b - a:
                    heapq.heappush(packs, (used, a + n, b))
            else:
                used, a, n = 0, new, left
                new += n
            out.append((length, rank, rank + n, a, used))
            if used + length < size:
                heapq.heappush(packs, (used + length, a, a + n))
            rank, left = rank + n, left - n
    return out


def padding(placements: list[tuple[int, int, int, int, int]], size: int = SEQUENCE) -> tuple[int, int]:
    """Padded tokens and sequences; a sequence of a power of two is not padded."""
    cuts = sorted({x for _, lo, hi, a, _ in placements for x in (a, a + hi - lo)})
    place = {c: i for i, c in enumerate(cuts)}
    fill = np.zeros(len(cuts), np.int64)
    for length, lo, hi, a, _ in placements:
        fill[place[a] : place[a + hi - lo]] += length
    lack = sum((size - int(u)) * (b - a) for u, a, b in zip(fill, cuts, cuts[1:], strict=False) if int(u) & (int(u) - 1))
    return lack, cuts[-1] if cuts else 0


def _cut(frames: Iterator[pd.DataFrame], tokenizer: str, size: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), Counter()
    rows: list[tuple] = []
    held = 0
    columns = ["part", "doc_id", "start", "length", "doc_tokens", "ids", "nth"]

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns, dtype=object).astype({"doc_id": "Int64"})

    for frame in frames:
        docs = [None if pd.isna(d) else int(d) for d in frame["doc_id"]]
        for run in runs_of(frame["text"], TOKEN_RUN):
            for d, b in zip(docs[run], token_bytes(frame["text"].iloc[run], tokenizer), strict=True):
                n = len(b) // 4
                for start in range(0, n, size):
                    length = min(size, n - start)
                    rows.append((part, d, start, length, n, b[4 * start : 4 * (start + length)], seen[length]))
                    seen[length] += 1
                held += len(b)
            if held >= BATCH_BYTES:
                yield frame_of(rows)
                rows, held = [], 0
    if rows:
        yield frame_of(rows)


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    Each row of docs is packed by itself, also where ids repeat or are null; a null text counts
    as empty and has the end id alone. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")  # pandas would make floating numbers of integers with nulls among them
    pieces = written(docs.mapInPandas(partial(_cut, tokenizer=tokenizer, size=size), PIECES), "pieces")
    counts = written(pieces.groupBy("part", "length").count(), "piece-counts", 8)
    placed = pack_histogram({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, size)
    earlier = F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = counts.withColumn("before", earlier).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before"))  # a row a part, of size entries at most
    places = spark.createDataFrame(placed or [(0, 0, 0, 0, 0)], "length int, lo long, hi long, first long, offset long")
    ranked = pieces.join(before, "part").withColumn("rank", F.element_at("before", F.col("length")) + F.col("nth")).drop("before")
    found = ranked.join(F.broadcast(places), "length").where("rank >= lo AND rank < hi")
    return found.select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "ids", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def query(spark, sf_dir: str) -> DataFrame:
    packed = pack(load(spark, sf_dir, "documents"), word_bpe_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
