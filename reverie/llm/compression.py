"""Quality by compression: one zstandard dictionary from good, one from bad labelled texts.

A text is compressed in blocks with either; the difference of the sizes over the text's bytes,
calibrated by logistic regression on labelled rows that built no dictionary, is its score. The
regression also sees how short the text is, since a few bytes give little evidence either way.
Only texts are read to score; labels, lang, source and ids never are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.llm.common import fold_of, load, small_batches, written

FOLDS = 5
#: Labelled rows of a class that build its dictionary, and as many that calibrate; the bound of what training reads into the driver.
SAMPLE_ROWS = 1_500
#: Longer texts are not in the sample (they are scored whole like all others).
SAMPLE_CHARS = 50_000
#: UTF-8 bytes of the texts of a class and use, at most; four times this is what the driver holds.
SAMPLE_BYTES = 16 << 20
DICTIONARY_BYTES = 256 << 10
BLOCK = 256
SHORT_BYTES = 50
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries, and weights of 1, the difference and the shortness in the log-odds of good; no dictionaries without both classes, then a constant."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their blocks themselves, evenly from all texts where they are too many
        step = max(1, -(-sum(map(len, blocks)) // DICTIONARY_BYTES))
        return b"".join(blocks[::step])


@lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(text: str | None, good: bytes, bad: bytes) -> tuple[float, float, float]:
    """1; (bytes with the bad dictionary - bytes with the good one) / bytes of the whole text, 0 for null and empty texts; shortness, 1 for these and falling."""
    data = (text or "").encode("utf-8", "replace")
    short = 1 / (1 + len(data) / SHORT_BYTES)
    if not data or not good:
        return 1.0, 0.0, short
    a, b = _compressor(good).compress, _compressor(bad).compress
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return 1.0, sum(len(b(x)) - len(a(x)) for x in blocks) / len(data), short


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps with a weak ridge, so that separable samples stay finite."""
    scale = np.maximum(x.std(0), 1e-9)
    scale[0] = 1
    z, w, ridge = x / scale, np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple((w / scale).tolist())


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> QualityModel:
    """Learns from labelled docs of the folds 1 to FOLDS - 1: two of them build dictionaries, the others calibrate.

    The labels are the first of each class and use by a hash of doc_id, sample_rows at most, and
    only their texts come to the driver, the first of them whose bytes together are within SAMPLE_BYTES. A doc_id labelled twice counts once, with its lowest
    quality; of texts that share a doc_id the least stands for them.
    """
    fold = fold_of(F.col("doc_id"), FOLDS)
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(fold != 0)
    marked = written(marked.withColumn("builds", fold.isin(1, 2)), "labels", 16)
    picks = [marked.where((F.col("quality") == q) & (F.col("builds") == b)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for q in (0, 1) for b in (True, False)]
    picked = F.broadcast(reduce(DataFrame.union, picks))  # 4 * sample_rows rows at most
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= sample_chars)).select("doc_id", "text").join(picked, "doc_id")
    rows: dict[tuple[int, bool], list[bytes]] = {(q, b): [] for q in (0, 1) for b in (True, False)}
    single = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"), F.min("builds").alias("builds"))
    running = F.sum(F.octet_length("text")).over(W.partitionBy("quality", "builds").orderBy(F.xxhash64("doc_id"), "doc_id"))  # 4 * sample_rows rows at most
    for r in sorted(single.withColumn("bytes", running).where(F.col("bytes") <= SAMPLE_BYTES).collect(), key=lambda r: r["doc_id"]):
        rows[r["quality"], r["builds"]].append(r["text"].encode("utf-8", "replace"))
    if not (rows[0, True] or rows[0, False]) or not (rows[1, True] or rows[1, False]):
        share = 1.0 if rows[1, True] or rows[1, False] else 0.0 if rows[0, True] or rows[0, False] else 0.5
        return QualityModel(b"", b"", ({1.0: 30.0, 0.0: -30.0}.get(share, 0.0), 0.0, 0.0))
    good, bad = (_dictionary(rows[q, True] or rows[q, False]) for q in (1, 0))
    tests = [(features(t.decode(), good, bad), q) for q in (0, 1) for t in rows[q, False] or rows[q, True]]
    x, y = np.array([t[0] for t in tests]), np.array([t[1] for t in tests], float)
    return QualityModel(good, bad, _logistic(x, y))


def score_udf(model: QualityModel):
    """Pandas UDF text -> score from 0 to 1, of whole texts."""

    @F.pandas_udf("double")
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            odds = np.array([features(t, model.good, model.bad) for t in texts], float).reshape(-1, 3) @ np.array(model.weights)
            yield pd.Series(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    return score


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """docs with `score` and `predicted` (1 from the threshold up); null and empty texts get the score of no difference. Columns of these names are replaced."""
    small_batches(docs.sparkSession)
    return docs.withColumn("score", score_udf(model)(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = score_quality(docs.select("doc_id", "text"), train(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")
