"""Token-id files as directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the low chunk of every id, level 1
the next chunk of those that go on, and so forth; a continuation bitmap of each level says
which go on, and a rank directory (ones before each block of RANK_BLOCK bits) turns a
position of one level into that of the next. So any token is read without decoding others: its
code byte, its block of the bitmap and one entry of the directory, level by level.

Layout of a shard, all integers little-endian:
    magic "DAC2", u8 levels, 3 zero bytes, u64 tokens, u64 documents
    for each of four levels: u64 codes, u64 where they begin in the shard (0, 0 beyond the last)
    i64 doc_id of each document; u8 1 where it is null
    u64 first token of each document in the shard, and the number of tokens
    for each level: u8 codes; bitmap (bit i at byte i // 8, low bit first,
    padded to whole blocks); u32 ones before each block
A task appends its shards to one plain file (part-<number>-<attempt>.dac) in the folder, which
any store that Arrow's file systems reach may be. The Parquet table `manifest` in it names the
files of the tasks that ended well and each shard's place in its file; part, shard is the order
of the documents. A file of a lost or repeated task has no row there and is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.llm.common import TOKEN_RUN, by_id, load, partitions, runs_of, shared_dir, small_batches, token_bytes, word_bpe_path

RANK_BLOCK = 512
SHARD_TOKENS = 1 << 20
LEVELS = 4
HEADER = 24 + 16 * LEVELS
FILES = "part int, shard int, before long, n_tokens long, file string, at long, size long"


def encode_shard(ids: np.ndarray, doc_ids: list, starts: np.ndarray) -> bytes:
    """ids: uint32; starts: first token of each document, then the number of tokens."""
    levels, table, rest = [], [], ids.astype("<u4")
    null = np.array([d is None for d in doc_ids], "u1")
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    docs = known.tobytes() + null.tobytes() + starts.astype("<u8").tobytes()
    at = HEADER + len(docs)
    while not levels or len(rest):
        more = rest > 0xFF
        bits = np.zeros(-(-len(rest) // RANK_BLOCK) * RANK_BLOCK, bool)
        bits[: len(rest)] = more
        ones = np.concatenate(([0], np.cumsum(bits.reshape(-1, RANK_BLOCK).sum(1))))[:-1]
        levels.append((rest & 0xFF).astype("u1").tobytes() + np.packbits(bits, bitorder="little").tobytes() + ones.astype("<u4").tobytes())
        table.append((len(rest), at))
        at += len(levels[-1])
        rest = rest[more] >> np.uint32(8)
    places = np.array(table + [(0, 0)] * (LEVELS - len(table)), "<u8").tobytes()
    head = b"DAC2" + bytes([len(levels), 0, 0, 0]) + len(ids).to_bytes(8, "little") + len(doc_ids).to_bytes(8, "little")
    return b"".join([head, places, docs, *levels])


class Shard:
    """One shard through read(at, size), which gives the bytes from `at` on; the header is read at once, all else when asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        head = read(0, HEADER)
        if head[:4] != b"DAC2":
            raise ValueError("not a shard of directly addressable codes")
        self.read, self.n_tokens, self.n_docs = read, int.from_bytes(head[8:16], "little"), int.from_bytes(head[16:24], "little")
        self.levels = [tuple(map(int, x)) for x in np.frombuffer(head, "<u8", 2 * LEVELS, 24).reshape(-1, 2)[: head[4]]]

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda at, size: data[at : at + size])

    def documents(self) -> tuple[list, np.ndarray]:
        """doc_ids, and the first token of each document and the number of tokens."""
        n = self.n_docs
        data = self.read(HEADER, 17 * n + 8)
        ids, null = np.frombuffer(data, "<i8", n), np.frombuffer(data, "u1", n, 8 * n)
        return [None if x else int(d) for d, x in zip(ids, null, strict=True)], np.frombuffer(data[9 * n :], "<u8", n + 1)

    def get(self, at: int) -> int:
        """The token at a position, from one code byte, at most one block of the bitmap and one directory entry a level."""
        if not 0 <= at < self.n_tokens:
            raise IndexError(at)
        out, block = 0, RANK_BLOCK // 8
        for level, (n, start) in enumerate(self.levels):
            out |= self.read(start + at, 1)[0] << (8 * level)
            if level + 1 == len(self.levels):
                break
            b = at // RANK_BLOCK
            bits = int.from_bytes(self.read(start + n + b * block, at % RANK_BLOCK // 8 + 1), "little")
            inside = at % RANK_BLOCK
            if not bits >> inside & 1:
                break
            ones = int.from_bytes(self.read(start + n + -(-n // RANK_BLOCK) * block + 4 * b, 4), "little")
            at = ones + (bits & ((1 << inside) - 1)).bit_count()
        return out

    def all(self) -> np.ndarray:
        """Every token in order: each level's codes fall to the places that go on."""
        out, slot = np.zeros(self.n_tokens, "<u4"), None
        for level, (n, start) in enumerate(self.levels):
            data = self.read(start, n + -(-n // RANK_BLOCK) * RANK_BLOCK // 8)
            codes, more = np.frombuffer(data, "u1", n), np.flatnonzero(np.unpackbits(np.frombuffer(data, "u1", len(data) - n, n), count=n, bitorder="little"))
            if slot is None:
                out[:], slot = codes, more
            else:
                out[slot] |= codes.astype("<u4") << np.uint32(8 * level)
                slot = slot[more]
        return out


def _write(frames: Iterator[pd.DataFrame], path: str, tokenizer: str, shard_tokens: int) -> Iterator[pd.DataFrame]:
    from pyarrow import fs
    from pyspark import TaskContext

    part, shard, before, at = TaskContext.get().partitionId(), 0, 0, 0
    held: list[tuple] = []
    rows: list[tuple] = []
    size, out, file = 0, None, f"{path}/part-{part:05d}-{uuid.uuid4().hex}.dac"

    def flush() -> None:
        nonlocal shard, before, at, size, out
        if out is None:
            system, place = fs.FileSystem.from_uri(path)
            system.create_dir(place, recursive=True)
            out = system.open_output_stream(f"{place}/{file.rpartition('/')[2]}")
        starts = np.concatenate(([0], np.cumsum([len(b) // 4 for _, b in held])))
        data, n = encode_shard(np.frombuffer(b"".join(b for _, b in held), "<u4"), [d for d, _ in held], starts), int(starts[-1])
        out.write(data)
        rows.append((part, shard, before, n, file, at, len(data)))
        shard, before, at, size = shard + 1, before + n, at + len(data), 0
        held.clear()

    for frame in frames:
        docs = [None if pd.isna(d) else int(d) for d in frame["doc_id"]]
        for run in runs_of(frame["text"], TOKEN_RUN):
            for d, b in zip(docs[run], token_bytes(frame["text"].iloc[run], tokenizer), strict=True):
                if held and size + len(b) // 4 > shard_tokens:
                    flush()
                held.append((d, b))
                size += len(b) // 4
    if held:
        flush()
    if out is not None:
        out.close()
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FILES.split(", ")])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Files of docs (doc_id, text) under path, a URI that all executors reach, in ascending doc_id order, null ids first, equal ids by a hash of the text.

    A shard closes before shard_tokens, or holds one longer document. Null texts count as
    empty: every document has at least the end id. An empty table writes no shards.
    """
    small_batches(docs.sparkSession)
    by_id(docs).mapInPandas(partial(_write, path=path.rstrip("/"), tokenizer=tokenizer, shard_tokens=shard_tokens), FILES).write.parquet(f"{path}/manifest")


def _based(spark: SparkSession, path: str) -> DataFrame:
    """The shards with `base`, the tokens of all shards before; one row a part is summed up, as many as the writer had partitions."""
    files = spark.read.schema(FILES).parquet(f"{path}/manifest")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return files.join(F.broadcast(first), "part").withColumn("base", F.col("first") + F.col("before")).drop("first", "before")


class _Files:
    """Shards by file and place; the file read last stays open."""

    def __init__(self):
        self.name, self.file = None, None

    def bytes_of(self, file: str, at: int, size: int) -> bytes:
        from pyarrow import fs

        if file != self.name:
            system, place = fs.FileSystem.from_uri(file)
            self.name, self.file = file, system.open_input_file(place)
        return self.file.read_at(size, at)

    def shard(self, file: str, start: int) -> Shard:
        return Shard(lambda at, size: self.bytes_of(file, start + at, size))


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    files = _Files()
    for frame in frames:
        for base, file, at, size in zip(frame["base"], frame["file"], frame["at"], frame["size"], strict=True):
            shard = Shard.of(files.bytes_of(file, at, size))
            ids, (doc_ids, ends) = shard.all().tobytes(), shard.documents()
            ends = ends.astype(np.int64)
            yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": base + ends[:-1], "ids": [ids[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]})


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) of every document."""
    shards = _based(spark, path).select("base", "file", "at", "size").repartition(partitions(spark), "file", "at")
    return shards.mapInPandas(_read, "doc_id long, start long, ids binary")


def _tokens_at(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    files, last, shard = _Files(), None, None
    for frame in frames:
        tokens = []
        for base, file, at, position in zip(frame["base"], frame["file"], frame["at"], frame["position"], strict=True):
            if last != (file, at):
                last, shard = (file, at), files.shard(file, at)
            tokens.append(shard.get(position - base))
        yield pd.DataFrame({"position": frame["position"], "token": np.array(tokens, np.int64)})


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """position, token for each of the global positions given, read by offset from its file: a header for a shard and a few bytes for a token.

    Repeated positions have a row each, null ones and those outside none.
    """
    spans, grid = _based(spark, path).select("file", "at", "base", "n_tokens"), F.lit(SHARD_TOKENS)
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("base") / grid), F.floor((F.col("base") + F.greatest(F.col("n_tokens"), F.lit(1)) - 1) / grid))))
    wanted = positions.select("position", F.floor(F.col("position") / grid).alias("cell")).join(spans, "cell").where("position >= base AND position < base + n_tokens")
    placed = wanted.select("base", "file", "at", "position").sortWithinPartitions("file", "at")
    return placed.mapInPandas(_tokens_at, "position long, token long")


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(load(spark, sf_dir, "documents"), path, word_bpe_path())
    return read_token_files(spark, path).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
