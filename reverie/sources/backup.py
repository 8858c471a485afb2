"""Backup of a scope's tables, and its restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reverie.operators import lifecycle
from reverie.sources.store import Store

#: The tables of a backup and their keys.
KEYS = {
    "episodes": ("id",), "memories": ("id",), "memory_events": ("id",), "topics": ("id",), "memory_topics": ("memory_id", "topic_id"), "topic_relations": ("broader", "narrower"),
    "entities": ("id",), "entity_mentions": ("entity_id", "memory_id"), "entity_proposals": ("id",), "synthetic_tags": ("id",), "relations": ("subject", "predicate", "object", "user_id"),
}

#: Which column of a table names a row of which other table, and the key there.
REFERENCES = (
    ("memory_events", "memory_id", "memories", "id"), ("memory_topics", "memory_id", "memories", "id"), ("memory_topics", "topic_id", "topics", "id"), ("topic_relations", "broader", "topics", "id"),
    ("topic_relations", "narrower", "topics", "id"), ("entity_mentions", "entity_id", "entities", "id"), ("entity_mentions", "memory_key", "memories", "seq"), ("entity_proposals", "entity_a", "entities", "id"),
    ("entity_proposals", "entity_b", "entities", "id"), ("relations", "object_id", "entities", "id"), ("relations", "memory_key", "memories", "seq"),
)


#: What a reset leaves.
LEFT_BY_RESET = ("relations", "synthetic_tags")


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables, by name, after a reset: all are empty but those that it leaves."""
    return {name: df if name in LEFT_BY_RESET else df.where(F.lit(False)) for name, df in tables.items()}


def all_tables(store: Store) -> dict[str, DataFrame]:
    """Every table of the store under its backup's name; memory_key is the number of the memory that a mention or relation rests on."""
    mentions = store.mentions.groupBy("entity_id", "memory_id").agg(F.min("surface").alias("surface")).withColumn("memory_key", F.col("memory_id"))
    relations = store.relations.withColumn("memory_key", F.col("memory_id")).withColumn("object_id", F.expr("CAST(substring(object, 2) AS BIGINT)"))
    return {
        "episodes": store.episodes, "memories": store.memories, "memory_events": store.events, "topics": store.topics, "memory_topics": store.memory_topics, "topic_relations": store.topic_relations,
        "entities": store.entities, "entity_mentions": mentions, "entity_proposals": store.proposals, "synthetic_tags": store.synthetic_tags, "relations": relations,
    }


def scoped_tables(store: Store, scope: Column) -> dict[str, DataFrame]:
    """The scope's memories and what belongs to them; what has two ends goes along if both of them do.

    Entities go along if a memory of the scope mentions them, topics if one has them; the
    scope's episodes are those of its users.
    """
    out = all_tables(store)
    out["memories"] = store.memories.where(scope)
    out["episodes"] = store.episodes.where(scope)
    semi = lambda df, c, ids, key: df.join(ids.select(F.col(key).alias(c)).distinct(), c, "left_semi").select(*df.columns)
    for name in ("memory_events", "memory_topics"):
        out[name] = semi(out[name], "memory_id", out["memories"], "id")
    out["topics"] = semi(out["topics"], "id", out["memory_topics"], "topic_id")
    out["entity_mentions"] = semi(out["entity_mentions"], "memory_key", out["memories"], "seq")
    out["entities"] = semi(out["entities"], "id", out["entity_mentions"], "entity_id")
    for table, column, parent, key in REFERENCES:
        if table in ("topic_relations", "entity_proposals", "relations"):
            out[table] = semi(out[table], column, out[parent], key)
    out["synthetic_tags"] = out["synthetic_tags"].join(out["topics"].select(F.col("name").alias("id")), "id", "left_semi")
    return out


def export_backup(store: Store, scope: Column, path: str) -> None:
    for name, df in scoped_tables(store, scope).items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def dangling(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, n: rows whose reference leads to no row of tables; references that hold have no row."""
    out = next(iter(tables.values())).sparkSession.createDataFrame([], "table string, column string, n long")
    for table, column, parent, key in REFERENCES:
        if table in tables and parent in tables and column in tables[table].columns:
            lost = tables[table].where(F.col(column).isNotNull()).join(tables[parent].select(F.col(key).alias(column)), column, "left_anti")
            row = lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("table"), F.lit(column).alias("column"), "n")
            out = out.union(row)
    return out.where("n > 0")


def fates(incoming: dict[str, DataFrame], stored: dict[str, DataFrame]) -> DataFrame:
    """table, fate, n over all tables: insert, unchanged or conflict."""
    out = None
    for name, df in incoming.items():
        if list(df.columns) != list(stored[name].columns):
            raise ValueError(f"the backup's {name} has other columns than the store's")
        key = F.struct(*KEYS[name]).alias("key")
        row = lifecycle.compared(df.select(key, *df.columns), stored[name].select(key, *df.columns), "key").groupBy("fate").agg(F.count(F.lit(1)).alias("n"))
        row = row.select(F.lit(name).alias("table"), "fate", "n")
        out = row if out is None else out.union(row)
    return out


def import_backup(spark: SparkSession, path: str, stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """stored tables (each under its backup's name) with the backup's new rows; unchanged rows are left.

    All or nothing: other columns, a conflicting row, or one whose reference leads neither into the backup nor the store fail the whole import.
    """
    incoming = {name: spark.read.parquet(f"{path}/{name}") for name in stored}
    known = {name: incoming[name].unionByName(stored[name]) for name in stored}
    if dangling(known).limit(1).count():
        raise ValueError("a row of the backup names one that neither it nor the store has")
    if fates(incoming, stored).where("fate = 'conflict'").limit(1).count():
        raise ValueError("a row of the backup differs from the stored row of its key")
    out = {}
    for name, df in incoming.items():
        out[name] = stored[name].unionByName(df.join(stored[name].select(*KEYS[name]), list(KEYS[name]), "left_anti").select(*stored[name].columns))
    return out
