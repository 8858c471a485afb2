"""Scoring documents with a gated recurrent language model.

All training documents are counted: their tokens make the base model, the vocabulary of the
network, and what other words weigh in their classes (by a hash of a word's last two characters).
Documents are then numbered once: a written table holds each one's word numbers, from which the
network both trains and scores. It trains by rounds, each on a hash range of the training
documents; the ranges are disjoint and together hold all of them, at any size. Every
partition's part of a range gives its own weights, whose mean by tokens starts the next round.
Scoring reads whole documents; a word outside the vocabulary takes its class's probability from
the network and its share of the class from the counts. The most frequent words' counts, KNOWN
at most, travel to the tasks that number documents; the rare rest is joined.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reverie.llm import gru
from reverie.llm.common import fold_of, load, small_batches, written

FOLDS, HELD_OUT = 7, 2
#: Words of the vocabulary, the end of a document among them, in classes of this many; classes of other words.
VOCABULARY, PER_CLASS, OTHERS = 1024, 64, 32
KNOWN = 200_000
#: Rounds of training, each on another hash range of the training documents.
ROUNDS = 3
#: Characters that a task splits into words, and words that it trains on or scores, at a time; whole documents.
RUN_CHARS = 8_000_000
RUN_WORDS = 2_000_000
END = ""
#: The role of a document that is scored alone; those of training documents are the rounds.
HELD = -1


@dataclass(frozen=True)
class Language:
    """known: count by word, END included; vocabulary: number by word; shares: count + 1 summed over each class of other words, and 1 for all unseen."""

    known: dict[str, int]
    vocabulary: dict[str, int]
    shares: np.ndarray
    tokens: int
    types: int
    weights: gru.Weights


def other_class(word: str) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "replace")) % OTHERS


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of the words of all texts in a row, where each text's begin (and the end), and the distinct words."""
    data = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.ascii_split_whitespace(data)
    coded = split.flatten().dictionary_encode()
    of = coded.indices.to_numpy(zero_copy_only=False)
    there = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[of] if len(of) else np.zeros(0, bool)
    return of[there], np.concatenate(([0], np.cumsum(there)))[split.offsets.to_numpy()], coded.dictionary


def _runs(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = RUN_CHARS) -> Iterator[pa.Table]:
    """Batches gathered to about that many bytes of the column."""
    held, size = [], 0
    for batch in batches:
        for row in range(0, batch.num_rows, 250):
            part = batch.slice(row, 250)
            held.append(part)
            size += pc.sum(pc.binary_length(part[column])).as_py() or 0
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _text(table: pa.Table) -> pa.Array:
    return pa.concat_arrays([c.cast(pa.large_string()) for c in table["text"].chunks])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("word", pa.large_string()), ("n", pa.int64())])
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        out = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
        held.clear()
        return out

    for run in _runs(batches):
        of, _, words = tokens_of(_text(run))
        n = np.bincount(of, minlength=len(words))
        held.append(pa.table([pa.concat_arrays([words.filter(pa.array(n > 0)), pa.array([END], pa.large_string())]), pa.array([*n[n > 0].tolist(), run.num_rows], pa.int64())], schema=kind))
        if sum(t.num_rows for t in held) > 1_500_000:
            held.append(merged())
            if held[0].num_rows > 750_000:
                yield from held.pop().to_batches(max_chunksize=100_000)
    if held:
        yield from merged().to_batches(max_chunksize=100_000)


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all docs (text); the word '' is the end of a document."""
    partial_counts = docs.select("text").mapInArrow(_count, "word string, n long")
    return written(partial_counts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts", 2)


def _frequent(counts: DataFrame, most: int) -> dict[str, int]:
    """The words of the highest counts, most at most: those above a threshold from the histogram of the counts' logarithms."""
    level = F.floor(F.log2(F.col("n")) * 8)
    histogram = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True)
    total, floor = 0, None
    for r in histogram:
        total += r["words"]
        if total > most:
            break
        floor = r["level"]
    if floor is None:
        return {}
    return {r["word"]: r["n"] for r in counts.where(level >= floor).collect()}


def _other_classes(words: pa.Array) -> np.ndarray:
    """other_class of each word, worked out once for each ending."""
    ends = pc.utf8_slice_codeunits(words, start=-2).dictionary_encode()
    own = np.fromiter(map(other_class, ends.dictionary.to_pylist()), np.int32, len(ends.dictionary))
    return own[ends.indices.to_numpy(zero_copy_only=False)] if len(words) else own


def _looker(language: Language):
    """A function that gives the network's number of each word, and its count, -1 where the task does not know it."""
    known = pa.array(list(language.known), pa.large_string())
    # what stands last is for words that are not known
    counts = np.array([*language.known.values(), -1], np.int64)
    places = np.array([*map(language.vocabulary.get, language.known, itertools.repeat(-1)), -1], np.int32)

    def look(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = pc.fill_null(pc.index_in(words, value_set=known), len(known)).to_numpy(zero_copy_only=False)
        return np.where(places[at] < 0, VOCABULARY + _other_classes(words), places[at]), counts[at]

    return look


ROWS = "row long, doc_id long, role int, n_tokens long, n_known long, base double, model double, ids binary, word string, tf long"
_ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("role", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("ids", pa.large_binary()), ("word", pa.large_string()), ("tf", pa.int64())])


def _batch(n: int, **columns) -> pa.RecordBatch:
    """A batch of ROWS; columns not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROWS], schema=_ROWS)


def _number(batches: Iterator[pa.RecordBatch], language: Language) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for each of its words whose count the task does not know (word, tf).

    ids are the document's word numbers and its end, 16 bits each; base and model are the logs
    of what the counts alone give.
    """
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    size = math.log10(language.tokens + language.types + 1)
    end = language.known.get(END, 0)
    look = _looker(language)
    for run in _runs(batches):
        n = run.num_rows
        of, bounds, words = tokens_of(_text(run))
        numbers, count = look(words)
        inside = numbers < VOCABULARY
        shares = np.log10(language.shares)[np.where(inside, 0, numbers - VOCABULARY)]
        log = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1), 0)
        lengths = np.diff(bounds)
        doc = np.repeat(np.arange(n), lengths)
        add = lambda x: np.bincount(doc, x[of], n)
        ids = np.empty(len(of) + n, "<u2")
        ids[np.arange(len(of)) + doc] = numbers[of]
        ids[bounds[1:] + np.arange(n)] = language.vocabulary[END]
        offsets = pa.py_buffer(2 * (bounds + np.arange(n + 1)).astype(np.int64))
        yield _batch(
            n, row=row + np.arange(n), doc_id=run["doc_id"].combine_chunks(), role=run["role"].combine_chunks(), n_tokens=lengths + 1, n_known=add(count > 0).astype(np.int64) + (end > 0),
            base=add(log) - lengths * size + math.log10(end + 1) - size, model=add(np.where(inside, 0, log - shares)), ids=pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, offsets, pa.py_buffer(ids)]),
        )
        rare = (count < 0)[of]
        pairs, tf = np.unique(doc[rare] * np.int64(max(1, len(words))) + of[rare], return_counts=True)
        for a in range(0, len(pairs), 100_000):
            own = pairs[a : a + 100_000]
            yield _batch(len(own), row=row + own // len(words), word=words.take(pa.array(own % len(words))), tf=tf[a : a + 100_000])
        row += n


def numbered(docs: DataFrame, language: Language) -> DataFrame:
    """docs (doc_id, text, role: a round of training or HELD) as a written table of ROWS."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("role").cast("int").alias("role"))
    return written(own.mapInArrow(partial(_number, language=language), ROWS), "numbered")


def _documents(run: pa.Table) -> list[np.ndarray]:
    """The word numbers of each document of a run."""
    return [np.frombuffer(x.as_buffer(), "<u2") for c in run["ids"].chunks for x in c]


def _train(batches: Iterator[pa.RecordBatch], weights: gru.Weights) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    tokens = 0
    for run in _runs(batches, "ids", 2 * RUN_WORDS):
        docs = _documents(run)
        weights, tokens = gru.train(weights, docs), tokens + sum(map(len, docs))
    if tokens:
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "tokens": pa.array([tokens], pa.int64()), "weights": pa.array([weights.flat().astype("<f4").tobytes()])})


def _mean(frame: pd.DataFrame) -> pd.DataFrame:
    n = frame["tokens"].to_numpy(np.float64)
    total = sum(np.frombuffer(b, "<f4").astype(np.float64) * k for b, k in zip(frame["weights"], n, strict=True)) / n.sum()
    return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "tokens": [int(n.sum())], "weights": [total.astype("<f4").tobytes()]})


def round_of(doc_id: Column) -> Column:
    """The round, 0 to ROUNDS - 1, that trains on a document."""
    return F.floor(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) * ROUNDS / (1 << 20)).cast("int")


def train_network(rows: DataFrame, language: Language) -> Language:
    """One pass over all numbered documents of training roles; means taken 64 partitions at a time so that no group grows with the input."""
    schema = "part int, tokens long, weights binary"
    small_batches(rows.sparkSession)
    for k in range(ROUNDS):
        own = rows.where((F.col("role") == k) & F.col("ids").isNotNull()).select("ids")
        parts = written(own.mapInArrow(partial(_train, weights=language.weights), schema), "weights")
        while (parts.agg(F.max("part")).first()[0] or 0) >= 64:
            parts = written(parts.withColumn("part", (F.col("part") / 64).cast("int")).groupBy("part").applyInPandas(_mean, schema), "means")
        row = parts.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(_mean, schema).first()
        if row is not None:
            language = replace(language, weights=language.weights.filled(np.frombuffer(row["weights"], "<f4")))
    return language


def counted(docs: DataFrame) -> tuple[Language, DataFrame]:
    """The language of docs (text), all of them for training, before its network is trained, and their word counts."""
    small_batches(docs.sparkSession)
    counts = count_words(docs)
    n = counts.agg(F.sum("n"), F.count(F.lit(1)), F.max(F.when(F.col("word") == END, F.col("n")))).first()
    tokens, types, n_docs = n[0] or 0, n[1], n[2] or 0
    known = _frequent(counts, KNOWN) or {}
    ranked = sorted((w for w in known if w != END), key=lambda w: (-known[w], w))[: VOCABULARY - 1]
    ranked = sorted([*ranked, END], key=lambda w: (-known.get(w, n_docs), w))
    vocabulary = {w: i for i, w in enumerate(ranked)}
    known.setdefault(END, n_docs)
    inside = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in ranked], "word string"))  # VOCABULARY rows
    suffix = F.pmod(F.crc32(F.substring("word", -2, 2).cast("binary")), F.lit(OTHERS))
    sums = {r["c"]: (r["n"], r["k"]) for r in counts.join(inside, "word", "left_anti").groupBy(suffix.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    seen = np.array([sums.get(c, (0, 0))[0] for c in range(OTHERS)], float)
    shares = np.array([sum(sums.get(c, (0, 0))) + 1 for c in range(OTHERS)], float)
    own = np.array([known[w] for w in ranked] + [0] * (VOCABULARY - len(ranked)), float)
    return Language(known, vocabulary, shares, tokens, types, gru.initial(own, seen + 1, PER_CLASS)), counts


def learn(docs: DataFrame) -> tuple[Language, DataFrame]:
    """The language of docs (doc_id, text), all of them for training, and their word counts."""
    language, counts = counted(docs)
    return train_network(numbered(docs.withColumn("role", round_of(F.col("doc_id"))), language), language), counts


def _score(batches: Iterator[pa.RecordBatch], weights: gru.Weights) -> Iterator[pa.RecordBatch]:
    """Numbered documents with what the network gives them added to `model`, less their ids."""
    for run in _runs(batches, "ids", 2 * RUN_WORDS):
        model = run["model"].to_numpy() + gru.score(weights, _documents(run)) / math.log(10)
        rest = run.drop_columns(["ids"])
        yield from rest.set_column(rest.schema.get_field_index("model"), "model", pa.array(model)).to_batches()


def with_rare_words(scored: DataFrame, rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Scored documents (row, doc_id, role, n_tokens, n_known, base, model) with what the words give whose counts the tasks did not know, as base_score and score."""
    rare = rows.where("word IS NOT NULL").select("row", "word", "tf").join(counts, "word")
    more = rare.groupBy("row").agg(F.sum("tf").alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more"))
    extra, known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    return scored.join(more, "row", "left").select("doc_id", "role", "n_tokens", (F.col("n_known") + known).alias("n_known"), (F.col("base") + extra).alias("base_score"), (F.col("model") + extra).alias("score"))


def score_numbered(rows: DataFrame, language: Language, counts: DataFrame) -> DataFrame:
    """Numbered documents to doc_id, role, n_tokens, n_known, base_score, score."""
    small_batches(rows.sparkSession)
    kept = "row long, doc_id long, role int, n_tokens long, n_known long, base double, model double"
    columns = [c.split()[0] for c in kept.split(", ")]
    scored = rows.where("ids IS NOT NULL").select(*columns, "ids").mapInArrow(partial(_score, weights=language.weights), kept)
    return with_rare_words(written(scored, "scores"), rows, counts)


def score(docs: DataFrame, language: Language, counts: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_tokens, n_known, base_score, score: log10 probabilities of whole texts.

    Each row is scored by itself, null texts as empty ones (their end alone); an empty table gives
    an empty one. Without any training document every token is unseen.
    """
    small_batches(docs.sparkSession)
    return score_numbered(numbered(docs.select("doc_id", "text").withColumn("role", F.lit(HELD)), language), language, counts).drop("role")


def learn_and_score(docs: DataFrame, held: Column) -> tuple[DataFrame, Language]:
    """docs (doc_id, text) to the columns of score and role (HELD where held), after learning from the others; documents are numbered once."""
    language, counts = counted(docs.where(~held))
    rows = numbered(docs.select("doc_id", "text", F.when(held, HELD).otherwise(round_of(F.col("doc_id"))).alias("role")), language)
    return score_numbered(rows, train_network(rows, language), counts), language


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored, language = learn_and_score(docs, fold_of(F.col("doc_id"), FOLDS) == HELD_OUT)
    held = (F.col("role") == HELD).alias("held_out")
    return scored.select("doc_id", held, "n_tokens", "n_known", F.lit(language.tokens).cast("long").alias("train_tokens"), "base_score", "score")
