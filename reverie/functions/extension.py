"""Functions for SQL: an embedder behind a client, and table functions for a text's words and word runs."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Texts of a call, unless a client says otherwise.
CALL = 64


def model_name(model: str, width: int) -> str:
    """Under which vectors of a model are stored: those of another width are another model's."""
    return f"{model}:{width}"


def client_embedder(connect: Callable[[], Callable[[list[str]], list[list[float]]]], call: int = CALL):
    """A column function text -> vector through a client: connect runs once for each task, calls take that many texts, equal ones of a batch once.

    A null text has no vector, and neither have the texts of a call that fails: they can be embedded later, as reindexed() does.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = connect()
        for texts in batches:
            distinct, found = list(dict.fromkeys(texts.dropna())), {}
            for i in range(0, len(distinct), call):
                try:
                    found.update(zip(distinct[i : i + call], client(distinct[i : i + call]), strict=True))
                except Exception:  # noqa: BLE001, S112
                    continue
            yield pd.Series([None if t is None else found.get(t) for t in texts.astype(object).where(texts.notna(), None)], index=texts.index)

    return embed


def _index_words(content: str | None) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", (content or "").lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", plain)


class Postings:
    """term, tf of a text's words."""

    def eval(self, content: str):
        yield from Counter(_index_words(content)).items()


class Runs:
    """place (from 0) and run of each n words in a row."""

    def eval(self, content: str, n: int):
        words = _index_words(content)
        for i in range(len(words) - n + 1):
            yield i, " ".join(words[i : i + n])


def register(spark: SparkSession, connect: Callable | None = None, call: int = CALL) -> None:
    """postings_of(text), runs_of(text, n) as table functions, and embed(text) where a client is given, for SQL of this session."""
    spark.udtf.register("postings_of", F.udtf(Postings, returnType="term string, tf int"))
    spark.udtf.register("runs_of", F.udtf(Runs, returnType="place int, run string"))
    if connect is not None:
        spark.udf.register("embed", client_embedder(connect, call))
