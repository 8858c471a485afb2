"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition becomes a run: its texts' digests in order, a row for each digest with the
best row id and the number of rows. In each round FAN neighbouring runs become one. The shuffle
brings the runs' rows of a digest together, the sort merges them, and the aggregate keeps the
best id. Runs are spread by their number and digest, so that no task holds a whole run; a text
that a third of all rows share is one row a run from the first round on, and a round brings at
most FAN of them together. What the last run says of a repeated digest goes down the same tree to
the rows.

Digests decide only after a comparison of bytes: the least and the greatest text of each repeated
digest must be one. Where they differ the text itself takes the digest's place and the merge runs
again. All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reverie.llm.common import load, maybe_among, written

#: Runs that a round merges into one.
FAN = 8
#: Parts in which the texts of one digest are compared first.
SALT = 64


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _merged(runs: DataFrame, run: Column) -> DataFrame:
    """One sorted run for each value of `run`: the best row of each digest and the number of rows."""
    merged = runs.groupBy(run.alias("run"), "digest").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    return merged.sortWithinPartitions("run", "digest")


def _repeated(rows: DataFrame) -> DataFrame:
    """run, digest, best, n of the digests that several of rows (run, digest, best) have, for each run that has them."""
    n_runs = rows.agg(F.max("run")).first()[0]
    levels = [written(_merged(rows.withColumn("n", F.lit(1).cast("long")), F.col("run")), "runs", 4)]
    while n_runs:
        levels.append(written(_merged(levels[-1], F.floor(F.col("run") / FAN).cast("int")), "runs", 4))
        n_runs //= FAN
    found = levels.pop().where("n > 1")
    for level in reversed(levels):
        up = found.select(F.col("run").alias("up"), F.col("digest").alias("of"), "best", "n")
        below = level.select("run", "digest")
        found = below.join(up, (F.floor(below["run"] / FAN).cast("int") == up["up"]) & (below["digest"] == up["of"])).select("run", "digest", "best", "n")
    return written(found, "repeated", 4)


def _unequal(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """The repeated digests that stand for unlike texts. A bitmap keeps most other texts where they are; equal ones of a part leave it once."""
    key = F.xxhash64("digest").alias("key")
    some = maybe_among(texts.select("digest", "text", key), repeated.select(key))
    parts = some.groupBy("digest", F.pmod(F.spark_partition_id(), F.lit(SALT)).alias("salt")).agg(F.min("text").alias("least"), F.max("text").alias("most"))
    return parts.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("digest")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """id, keep_id, group_size, kept for each row of docs, whatever its other columns; groups are the rows of one text.

    Null texts count as empty. The row with the largest (or smallest) id stays; of rows with equal
    ids, one; a row without id stays only where no row of the group has one, and keep_id is null
    then. digest is a column of the text; a weak one costs a second merge, not the result.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is largest or smallest, not {keep}")
    own = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    texts = own.select("id", "text", digest(F.col("text")).cast("string").alias("digest"))
    rows = _rows(texts, keep)
    repeated = _repeated(rows)
    unequal = written(_unequal(texts.select("text", "digest"), repeated), "unequal")
    if unequal.head(1):
        exact = texts.join(unequal.withColumn("by_text", F.lit(True)), "digest", "left")
        texts = exact.select("id", "text", F.when(F.col("by_text"), F.concat("digest", F.lit(" "), "text")).otherwise(F.col("digest")).alias("digest"))
        rows = _rows(texts, keep)
        repeated = _repeated(rows)
    keeper = F.coalesce(F.col("keeper"), F.col("best"))
    joined = rows.join(repeated.select("run", "digest", F.col("best").alias("keeper"), "n"), ["run", "digest"], "left")
    return joined.select("best.id", keeper["id"].alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (keeper["row"] == F.col("best.row")).alias("kept"), "digest")


def _rows(texts: DataFrame, keep: str) -> DataFrame:
    """run, digest and best (what ranks a row, greater is better) of each row, without its text, as a table: a run's number must not change."""
    rank = F.col("id") if keep == "largest" else -F.col("id")
    best = F.struct(rank.alias("rank"), F.col("id"), (-F.monotonically_increasing_id()).alias("row"))
    return written(texts.select(F.spark_partition_id().alias("run"), "digest", best.alias("best")), "digests")


def query(spark, sf_dir: str) -> DataFrame:
    found = exact_duplicates(load(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
