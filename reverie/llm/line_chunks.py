"""Line dedup by content-defined chunks (DataFrame functions only).

A rolling hash over the last WINDOW line hashes closes a chunk where it is 0 modulo DIVISOR,
so that the cuts depend on the lines around them and not on their place in the document. A line
of LONG_CHUNK characters is a passage by itself: chunks close before and after it. Such lines and
chunks of several lines that occur more than once in the corpus are compared byte by byte
with their first occurrence and removed elsewhere.

Chunks miss passages that their cuts don't fall in with. drop_repeated_passages does without cuts:
every two lines in a row, and every long line, are looked up over the whole corpus, and what
repeats in a row goes where it is long enough: blank lines, braces and bullets stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.llm.common import boxed, load, maybe_among, written

WINDOW = 2
DIVISOR = 3
#: Characters from which a line is a chunk of its own.
LONG_CHUNK = 150
#: Of the rolling hash: base and a prime modulus; line hashes are below 2 ** 32, so that sums stay below 2 ** 63.
BASE = 31
MODULUS = 1_000_000_007
#: Characters from which a line alone is looked up, and those that a repeated passage has at least, without white space at the ends of its lines.
LONG_LINE, LEAST_PASSAGE = 100, 100


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _closes(i: Column) -> Column:
    """Whether the line at i, from 0, is the last of its chunk; reads _hashes and _long."""
    rolling = F.lit(0).cast("long")
    for back in reversed(range(WINDOW)):
        own = F.when(i >= back, F.get("_hashes", (i - back).cast("int"))).otherwise(F.lit(0).cast("long"))
        rolling = (rolling * BASE + own % MODULUS) % MODULUS
    long = F.get("_long", i.cast("int")) | F.coalesce(F.get("_long", (i + 1).cast("int")), F.lit(False))
    return (rolling % DIVISOR == 0) | long | (i == F.size("_hashes") - 1)


def chunked(docs: DataFrame) -> DataFrame:
    """docs with _lines and _chunks, an array of struct(start, n) in order; start counts lines from 0."""
    lines = docs.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    lines = lines.withColumns({"_hashes": F.transform("_lines", _line_hash), "_long": F.transform("_lines", lambda line: F.length(line) >= LONG_CHUNK)})
    ends = lines.withColumn("_ends", F.filter(F.sequence(F.lit(0), F.size("_hashes") - 1), _closes))
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("_ends", k - 1) + 1)
    return ends.withColumn("_chunks", F.transform("_ends", lambda e, k: F.struct(start(k).alias("start"), (e + 1 - start(k)).alias("n")))).drop("_ends", "_hashes", "_long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, start, n of each occurrence of a repeated chunk, of several lines or a long one, but its first, by (doc_id, start).

    Only hashes move until chunks are known to repeat; then each repeated chunk's text is compared
    with that of the first occurrence. A bitmap of fixed size, sent to all tasks, spares most
    other texts the way to that join. A hot chunk is a join key whose rows are split, and its count
    and first occurrence are partial aggregates.
    """
    several = chunked(docs.where("doc_id IS NOT NULL").select("doc_id", "text")).select("doc_id", "_lines", F.explode(F.filter("_chunks", lambda c: (c["n"] > 1) | (F.length(F.get("_lines", c["start"])) >= LONG_CHUNK))).alias("c"))
    own = several.select("doc_id", F.col("c.start").alias("start"), F.col("c.n").alias("n"), F.array_join(F.slice("_lines", F.col("c.start") + 1, F.col("c.n")), "\n").alias("chunk")).withColumn("key", F.xxhash64("chunk"))
    again = written(own.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("key", "first"), "chunk-keys", 8)
    found = maybe_among(own, again).join(again, "key")
    here = F.struct("doc_id", "start") == F.col("first")
    found = written(found.select("key", "doc_id", "start", "n", "chunk", here.alias("is_first")), "chunk-texts")
    first = found.where("is_first").select("key", F.col("chunk").alias("model")).dropDuplicates(["key"])
    return found.where("NOT is_first").join(first, "key").where(F.col("chunk") == F.col("model")).select("doc_id", "start", "n")


def drop_repeated_chunks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) with `text` less its repeated chunks, `n_lines` and `n_removed` (lines).

    Every row stays, also where no line is left (text is then empty). A null text becomes an empty
    one. Rows that share a doc_id count as one document: their equal chunks at equal places are
    the same occurrence. Rows without doc_id are neither compared nor changed. An empty table
    gives an empty one; columns named n_lines or n_removed are replaced.
    """
    gone = repeated_chunks(docs).groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("_gone")).withColumnRenamed("doc_id", "_id")
    joined = boxed(docs, "doc_id", "text").join(gone, F.col("doc_id") == F.col("_id"), "left")
    none = F.array().cast("array<struct<start:int,n:int>>")
    split = joined.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1)).withColumn("_gone", F.coalesce(F.sort_array("_gone"), none))
    out = split.withColumn("n_lines", F.size("_lines")).withColumn("n_removed", F.aggregate("_gone", F.lit(0), lambda n, g: n + g["n"]))

    def between(k: Column) -> Column:
        """The lines after the k-th removed chunk, up to the next."""
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("_gone", k - 1)["start"] + F.get("_gone", k - 1)["n"])
        end = F.when(k == F.size("_gone"), F.col("n_lines")).otherwise(F.get("_gone", k)["start"])
        return F.slice("_lines", start + 1, end - start)

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_gone")), between)), "\n")
    text = F.when(F.size("_gone") == 0, F.coalesce("text", F.lit(""))).otherwise(left).alias("text")
    own = [text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*own, "n_lines", "n_removed")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text) and line, from 0, of each line that belongs to a repeat of an earlier passage.

    Two lines in a row, and one of LONG_LINE characters, are looked up. A passage is the union of
    those that repeat in a row, so that its ends are found exactly, whatever stands around it; it
    has LEAST_PASSAGE characters or more, and shorter ones stay. A repeat that overlaps its own
    first occurrence stays. As each removed line has an equal one earlier, by document and
    place, at least one copy of every line stays.
    """
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("hash"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_lines"))
    unit = lambda i, passage, *parts: F.struct(i.alias("start"), F.array(*[F.length(F.trim(p)) for p in parts]).alias("chars"), passage.alias("passage"))
    pairs = F.transform("_lines", lambda line, i: unit(i, F.concat(line, F.lit("\n"), F.get("_lines", i + 1)), line, F.get("_lines", i + 1)))
    long = F.filter(F.transform("_lines", lambda line, i: unit(i, line, line)), lambda u: F.length(u["passage"]) >= LONG_LINE)
    units = lines.select("doc_id", "hash", F.explode(F.concat(F.filter(pairs, lambda u: u["passage"].isNotNull()), long)).alias("u"))
    own = units.select("doc_id", "hash", "u.start", F.size("u.chars").alias("n"), "u.chars", "u.passage").withColumn("key", F.xxhash64("n", "passage"))
    place = F.struct("doc_id", "hash", "start")
    again = written(own.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("key", "first"), "passage-keys", 8)
    found = written(maybe_among(own, again).join(again, "key").withColumn("is_first", place == F.col("first")), "passage-texts")
    first = found.where("is_first").select("key", F.col("passage").alias("model")).dropDuplicates(["key"])
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))
    apart = found.where(~F.col("is_first") & ~(same & (F.col("start") < F.col("first.start") + F.col("n"))))
    repeats = apart.join(first, "key").where(F.col("passage") == F.col("model"))
    each = repeats.select("doc_id", "hash", "start", F.posexplode("chars").alias("pos", "chars")).select("doc_id", "hash", (F.col("start") + F.col("pos")).alias("line"), "chars").distinct()
    run = F.col("line") - F.row_number().over(W.partitionBy("doc_id", "hash").orderBy("line"))  # the lines of one document
    runs = each.withColumn("run", run).groupBy("doc_id", "hash", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.sum("chars").alias("chars"))
    return runs.where(F.col("chars") >= LEAST_PASSAGE).select("doc_id", "hash", F.explode(F.sequence("first", "last")).alias("line"))


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """As drop_repeated_chunks, but less the lines of repeated_lines; rows that share a doc_id are one document where their texts are equal."""
    gone = repeated_lines(docs).groupBy("doc_id", "hash").agg(F.collect_set("line").alias("_gone")).withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    joined = boxed(docs, "doc_id", "text").join(gone, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    split = joined.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1)).withColumn("n_lines", F.size("_lines"))
    left = split.withColumn("_left", F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>"))))
    out = left.withColumn("n_removed", F.col("n_lines") - F.size("_left"))
    kept = F.array_join(F.transform("_left", lambda i: F.get("_lines", i)), "\n")
    text = F.when(F.col("n_removed") == 0, F.coalesce("text", F.lit(""))).otherwise(kept).alias("text")
    own = [text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*own, "n_lines", "n_removed")


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_chunks(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) % {MODULUS} AS h FROM lines),
rolled AS (
  SELECT doc_id, line, i, ((coalesce(lag(h) OVER w, 0) * {BASE} + h) % {MODULUS}) % {DIVISOR} = 0 OR length(line) >= {LONG_CHUNK} OR coalesce(length(lead(line) OVER w), 0) >= {LONG_CHUNK} AS closes FROM hashed
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(CAST(closes AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM rolled),
chunk AS (SELECT doc_id, c, min(i) AS first_line, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, c),
firsts AS (SELECT body, min(struct_pack(d := doc_id, s := first_line)) AS f FROM chunk WHERE n > 1 OR length(body) >= {LONG_CHUNK} GROUP BY body HAVING count(*) > 1),
fate AS (
  SELECT chunk.*, f IS NOT NULL AND f <> struct_pack(d := doc_id, s := first_line) AS gone FROM chunk LEFT JOIN firsts USING (body))
SELECT doc_id, CAST(sum(n) AS INT) AS n_lines, CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS INT) AS n_removed,
  coalesce(string_agg(body, chr(10) ORDER BY first_line) FILTER (WHERE NOT gone), '') AS text
FROM fate GROUP BY doc_id
"""
