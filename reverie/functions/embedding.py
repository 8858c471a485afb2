"""Feature-hash vectors of texts, by Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A feature's hash is the first 8 bytes of its blake2b digest, little-endian; its slot
# the hash modulo the width; bit 62 its sign; word pairs join by "_", words stand in "^" and "$" for their triples.
WORDS = "[a-z0-9]+"


def _spread(features: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and signs of distinct features."""
    raw = b"".join(hashlib.blake2b(f.encode(), digest_size=8).digest() for f in features)
    h = np.frombuffer(raw, "<u8")
    return (h % np.uint64(dims)).astype(np.int64), np.where(h >> np.uint64(62) & np.uint64(1), 1.0, -1.0)


def _by_word(words: list[str], dims: int) -> np.ndarray:
    """A row for each distinct word: what it and its triples add."""
    framed = pd.Series(words, dtype=object).map(lambda w: [w, *(f"^{w}$"[i : i + 3] for i in range(len(w)))])
    long = framed.explode()
    codes, features = pd.factorize(long)
    slots, signs = _spread(list(features), dims)
    out = np.zeros((len(words), dims))
    np.add.at(out, (long.index.to_numpy(), slots[codes]), signs[codes])
    return out


def hashed(texts: pd.Series, dims: int = 256) -> np.ndarray:
    """Vectors of a batch of texts, each of unit length or all 0: words, letter triples and pairs of words add their signs at their slots.

    Every distinct word and pair of the batch is hashed once; texts are then sums over them.
    """
    found = texts.fillna("").str.lower().str.findall(WORDS)
    words = found.explode().dropna()
    out = np.zeros((len(texts), dims))
    if len(words):
        row = np.repeat(np.arange(len(texts)), found.map(len))
        codes, names = pd.factorize(words)
        n = len(names)
        cells, times = np.unique(row.astype(np.int64) * n + codes, return_counts=True)
        for at in range(0, n, 4096):  # rows of words are dense, so a share of them at a time
            own = (cells % n >= at) & (cells % n < at + 4096)
            table = _by_word(list(names[at : at + 4096]), dims)
            np.add.at(out, cells[own] // n, table[cells[own] % n - at] * times[own, None])
        follows = row[1:] == row[:-1]
        pairs, of = np.unique(codes[:-1][follows].astype(np.int64) * n + codes[1:][follows], return_inverse=True)
        slots, signs = _spread([f"{names[p // n]}_{names[p % n]}" for p in pairs], dims)
        np.add.at(out, (row[1:][follows], slots[of]), signs[of])
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(size > 0, size, 1.0)


def hash_embedder(dims: int = 256):
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hashed(texts.reset_index(drop=True), dims).astype(np.float32)))

    return embed


def reindexed(rows: DataFrame, model: str, embed, content: str = "content") -> DataFrame:
    """rows with vectors of model; those that have them already are not embedded again, and no times change."""
    stale = F.col("embedding").isNull() | (F.col("embedding_model") != model) | F.col("embedding_model").isNull()
    old = rows.where(~stale)
    new = rows.where(stale).withColumn("embedding", embed(F.col(content))).withColumn("embedding_model", F.lit(model))
    return old.unionByName(new.select(*rows.columns))
