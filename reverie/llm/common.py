"""What the operators of this subpackage share: the shared folder, written tables, tokenizing by words."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
END_ID = 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset in local mode (tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str, shrink: int = 1) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage, survives lost executors.

    A table of a few narrow columns goes to fewer files, one for every shrink shuffle partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if shrink > 1:
        df = df.coalesce(max(1, partitions(spark) // shrink))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """Each row whole as `row`, beside the columns given, so that no name of docs can clash with one of an operator."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *columns)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


def by_id(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in ascending doc_id order over ranges of it; equal or missing ids by a hash of the text, so that no id fills a range.

    The ids come as text: pandas would make floating numbers of integers with nulls among them.
    """
    place = ["doc_id", F.xxhash64("text")]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.repartitionByRange(partitions(docs.sparkSession), *place).sortWithinPartitions(*place, "text").select(F.col("doc_id").cast("string").alias("doc_id"), "text")


#: Bits of the bitmap that spares rows the way to a join.
BITMAP = 1 << 22


def maybe_among(own: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of own whose key (long) has its bit set among the keys of keys; the bitmap has BITMAP bits, as 64-bit words, however many keys there are."""
    slot = F.pmod("key", F.lit(BITMAP))
    word, bit = F.floor(slot / 64).cast("int"), F.pmod(slot, F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    masks = keys.groupBy(word.alias("word")).agg(F.bit_or(one).alias("mask"))
    return own.withColumn("word", word).join(F.broadcast(masks), "word").where(F.col("mask").bitwiseAND(one) != 0).drop("word", "mask")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo folds; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Words whose ids a worker keeps, at most in either of two generations.
CACHED_WORDS = 200_000
#: Characters that are looked up at a time, whole texts.
TOKEN_RUN = 3_000_000
_IDS: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}


@lru_cache(maxsize=4)
def _closing(path: str):
    """For each id, whether it closes a word."""
    import numpy as np

    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    return out


def _ids_of_words(words: list[str], path: str) -> list[bytes]:
    """Ids of each word. All-letter words are one token pattern each, so a line of them is cut after the ids that close words."""
    import numpy as np

    if not words:
        return []
    tokenizer = _tokenizer(path)
    if all(map(str.isalpha, words)):
        ids = np.asarray(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(_closing(path)[ids]) + 1
        if len(ends) == len(words):
            data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            return [data[i:j] for i, j in zip(at, at[1:], strict=False)]
    found = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
    data = np.asarray(found.ids, "<u4").tobytes()
    at = (4 * np.searchsorted(np.asarray([-1 if i is None else i for i in found.word_ids]), np.arange(len(words) + 1))).tolist()
    return [data[i:j] for i, j in zip(at, at[1:], strict=False)]


def _looked_up(words, path: str):
    """Ids of an Arrow array of words: all in a row, the number of each word's, and where they begin."""
    import numpy as np

    young, old = _IDS[path]
    words = words.to_pylist()
    new = [w for w in words if w not in young]
    if new:
        known = [w for w in new if w in old]
        young.update(zip(known, map(old.__getitem__, known), strict=True))
        new = [w for w in new if w not in young] if known else new
        letters = [w for w in new if w.isalpha()]
        others = [w for w in new if not w.isalpha()]
        for group in (letters, others):
            young.update(zip(group, _ids_of_words(group, path), strict=True))
    ids = list(map(young.__getitem__, words))
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return np.frombuffer(b"".join(ids), "<u4"), sizes, np.cumsum(sizes) - sizes


def _gathered(pool, at, size):
    """The spans of pool that begin at `at`, in a row, and where each begins in the result (and the end)."""
    import numpy as np

    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    place = np.repeat((at - ends[:-1]).astype(np.int32), size)
    place += np.arange(len(place), dtype=np.int32)
    return pool[place], ends


def token_bytes(texts, path: str) -> list[bytes]:
    """The ids of each text and END_ID, as little-endian unsigned 32-bit integers.

    Every pattern of this tokenizer ends at white space and between a letter and marks (but for
    U+0130, whose small form is no letter alone), and it reads A-Z as a-z. So a text's ids are those of its lower-cased words and their closing marks
    in a row; what was met before is looked up.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    young, old = _IDS.get(path, ({"": b""}, {}))
    _IDS[path] = ({"": b""}, young) if len(young) > CACHED_WORDS else (young, old)
    data = pc.fill_null(pa.array(texts, pa.large_string(), from_pandas=True), "")
    # special tokens are matched before letters are lower-cased
    data = pc.if_else(pc.match_substring(data, "<|"), data, pc.ascii_lower(data))
    split = pc.ascii_split_whitespace(data)
    coded = split.flatten().dictionary_encode()
    parts = pc.extract_regex(coded.dictionary, r"(?s)^(?P<word>.*[^\PL\x{130}])(?P<marks>[.,;:!?]+)$")
    word = pc.coalesce(pc.struct_field(parts, "word"), coded.dictionary).dictionary_encode()
    marks = pc.fill_null(pc.struct_field(parts, "marks"), "").dictionary_encode()
    word_ids, word_size, word_at = _looked_up(word.dictionary, path)
    mark_ids, mark_size, mark_at = _looked_up(marks.dictionary, path)
    w, m = word.indices.to_numpy(zero_copy_only=False), marks.indices.to_numpy(zero_copy_only=False)
    pool, ends = _gathered(np.concatenate((word_ids, mark_ids)), np.stack((word_at[w], mark_at[m] + len(word_ids)), 1).ravel(), np.stack((word_size[w], mark_size[m]), 1).ravel())
    whole = ends[::2]  # of each distinct word with its marks
    of = coded.indices.to_numpy(zero_copy_only=False)
    ids, ends = _gathered(pool, whole[:-1][of], np.diff(whole)[of])
    out, bounds = ids.tobytes(), (4 * ends[split.offsets.to_numpy()]).tolist()
    end = END_ID.to_bytes(4, "little")
    return [out[i:j] + end for i, j in zip(bounds, bounds[1:], strict=False)]


def runs_of(texts, chars: int = 1_500_000):
    """Consecutive slices of texts that hold about that many characters, or one longer text."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > chars:
            yield slice(first, i)
            first, held = i, 0
        held += len(t or "")
    if len(texts):
        yield slice(first, len(texts))


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts go to Python workers in batches of this many rows at most, so that long ones fit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def unsigned_crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
