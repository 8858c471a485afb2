"""A memory store as DataFrames, projected from the star tables, and the file sources."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-06-01 00:00:00"


@dataclass
class Store:
    """The logical tables over one folder of Parquet tables; each is read when first asked for."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def episodes(self) -> DataFrame:
        c = self.table("conversations")
        return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("content"), "role", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("user_id"), "turn")

    @cached_property
    def memories(self) -> DataFrame:
        labels = self.table("labels").select("doc_id", "quality", "toxic")
        kinds = F.array(*[F.lit(x) for x in ("semantic", "episodic", "procedural", "working")])
        created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 2400 AS INT), 0, 0)")
        updated = F.expr("created_at + make_dt_interval(CAST(doc_id % 50 AS INT), 0, 0, 0)")
        nation = lambda c: F.concat(F.lit("nation_"), c.cast("string"))
        second = F.when(F.col("doc_id") % 5 == 0, F.array(nation(F.col("doc_id") * 7 % 25))).otherwise(F.array().cast("array<string>"))
        tags = F.when(F.col("doc_id") % 10 == 9, F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(nation(F.col("doc_id") % 25)), second)))
        waiting = F.when(F.col("doc_id") % 40 == 3, F.lit('{"pending_distillation": true, "_enrichment": {"status": "pending", "attempts": 0}}')).when(F.col("doc_id") % 40 == 23, F.lit('{"pending_distillation": true, "_enrichment": {"status": "retry", "attempts": 2, "next_attempt_at": "2024-07-01T00:00:00"}}')).otherwise(F.lit("{}"))
        return (
            self.table("documents")
            .join(labels, "doc_id", "left")
            .withColumn("created_at", created)
            .withColumn("updated_at", updated)
            .select(
                F.col("doc_id").cast("string").alias("id"),
                F.col("doc_id").alias("seq"),
                F.col("text").alias("content"),
                F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("memory_type"),
                F.col("source").alias("user_id"),
                F.col("lang").alias("agent_id"),
                F.lit(None).cast("string").alias("run_id"),
                F.coalesce(F.lit(0.25) + F.lit(0.5) * F.col("quality"), F.lit(0.5)).alias("importance"),
                tags.alias("categories"),
                waiting.alias("metadata"),
                "created_at",
                "updated_at",
                F.col("created_at").alias("valid_from"),
                F.when(F.col("toxic") == 1, F.expr("updated_at + INTERVAL 1 DAY")).alias("invalid_at"),
                F.when((F.col("toxic") == 1) & (F.col("doc_id") % 3 == 0), (F.col("doc_id") + 1).cast("string")).alias("superseded_by"),
            )
        )

    @cached_property
    def contents(self) -> DataFrame:
        """The texts of memories alone, without the join that their importance and validity need."""
        return self.table("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), F.col("text").alias("content"), F.col("source").alias("user_id"))

    @cached_property
    def vectors(self) -> DataFrame:
        model = F.when(F.col("vec_id") % 10 == 9, "other").otherwise("main")
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("tag"), model.alias("embedding_model"))

    @cached_property
    def events(self) -> DataFrame:
        kinds = {"signup": "ADD", "click": "UPDATE", "purchase": "SUPERSEDE", "error": "DELETE", "view": "NONE"}
        kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
        actor = F.when(F.col("event_id") % 3 == 0, "user").when(F.col("event_id") % 3 == 1, "system")
        return self.table("events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("memory_id"), F.try_element_at(kind, "event_type").alias("event"), F.col("ts").alias("created_at"), actor.alias("actor"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))

    @cached_property
    def topics(self) -> DataFrame:
        region = self.table("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lower("r_name").alias("normalized"))
        nation = self.table("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("normalized"))
        return region.unionByName(nation)

    @cached_property
    def topic_relations(self) -> DataFrame:
        n = self.table("nation")
        return n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("broader"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("narrower"), F.col("n_nationkey").alias("seq"))

    @cached_property
    def memory_topics(self) -> DataFrame:
        return self.memories.select(F.col("id").alias("memory_id"), F.explode("categories").alias("tag")).select("memory_id", F.regexp_replace("tag", "nation_", "n").alias("topic_id"))

    @cached_property
    def entities(self) -> DataFrame:
        """Parts; of each nine, three are merged in a chain, and one into nothing known."""
        p = self.table("part")
        key = F.col("p_partkey")
        into = F.when(key % 9 == 1, key - 1).when(key % 9 == 2, key - 1).when(key % 90 == 8, F.lit(-1)).when(key % 90 == 44, key + 1).when(key % 90 == 45, key - 1)
        return p.select(key.alias("id"), F.concat_ws(" ", "p_name", F.lower(F.regexp_replace("p_brand", "#", ""))).alias("name"), F.lower(F.concat_ws(" ", "p_name", F.lower(F.regexp_replace("p_brand", "#", "")))).alias("normalized"), F.col("p_type").alias("entity_type"), into.alias("merged_into"), F.col("p_retailprice").alias("updated"), F.when(key % 2 == 0, F.col("p_brand")).alias("description"))

    @cached_property
    def mentions(self) -> DataFrame:
        """A line of an order mentions its part; the order is the memory."""
        li = self.table("lineitem")
        return li.select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("memory_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("surface"))

    @cached_property
    def told(self) -> DataFrame:
        """entity_id, id: which entities the memories mention; an order's parts are told in the memory of its number modulo theirs."""
        n = self.table("documents").count()
        return self.mentions.select("entity_id", (F.col("memory_id") % max(1, n)).cast("string").alias("id")).distinct()

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"))

    @cached_property
    def relations(self) -> DataFrame:
        """A supplier supplies a part, by the first order that says so."""
        li = self.table("lineitem")
        edges = li.groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("memory_id"), F.max("l_shipdate").alias("created_at"))
        ended = F.when((F.col("l_suppkey") + F.col("l_partkey")) % 7 == 0, F.col("created_at"))
        return edges.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("subject"), F.lit("supplies").alias("predicate"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("object"), (F.col("l_suppkey") % 10).alias("user_id"), "memory_id", "created_at", ended.alias("invalid_at"))

    @cached_property
    def proposals(self) -> DataFrame:
        """Pairs of neighbouring parts, some asked twice round."""
        p = self.table("part")
        key = F.col("p_partkey")
        a = F.when(key % 4 == 0, key + 1).otherwise(key)
        b = F.when(key % 4 == 0, key).otherwise(key + 1)
        return p.where(key % 2 == 0).select(key.alias("id"), a.alias("entity_a"), b.alias("entity_b"), (key % 10).alias("user_id"), F.when(key % 6 == 0, "confirmed").when(key % 6 == 2, "rejected").otherwise("proposed").alias("status"), F.col("p_retailprice").alias("created"))


    @cached_property
    def texts(self) -> DataFrame:
        """Memories as entities know them: memory_id, content, updated_at."""
        return self.memories.select(F.col("seq").alias("memory_id"), "content", "updated_at")

    @cached_property
    def vector_tags(self) -> DataFrame:
        """id, tag, embedding: each label is split in two tags, which every tenth vector has both; vectors lean to one that leads their label."""
        v = self.vectors
        lead = v.select(F.col("id").cast("int").alias("tag"), F.col("embedding").alias("lead"))
        both = F.when(F.col("id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("id") % 2).cast("int")))
        leaning = F.zip_with("embedding", "lead", lambda x, y: x.cast("double") + 3 * y.cast("double"))
        return v.join(F.broadcast(lead.where("tag < 10")), "tag").select("id", F.explode(both).alias("h"), "tag", leaning.alias("embedding")).select("id", (F.col("tag") * 2 + F.col("h")).alias("tag"), "embedding")  # ten labels

    @cached_property
    def synthetic_tags(self) -> DataFrame:
        n = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return n.groupBy(F.col("r_name").alias("id")).agg(F.sort_array(F.collect_list("n_name")).alias("source_tags"))

    @cached_property
    def changed_entities(self) -> DataFrame:
        """Entities with a second name, as metadata holds it."""
        return self.entities.withColumn("aliases", F.when(F.col("id") % 3 == 0, F.array(F.concat(F.lit("Alias "), F.col("id").cast("string")))))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, a JSON object a line: id, sessions (or one conversation), questions."""
    turn = "array<struct<role: string, content: string>>"
    raw = spark.read.schema(f"id string, sessions array<{turn}>, conversation {turn}, questions array<struct<q: string, expected_keywords: array<string>>>").json(path)
    return raw.select("id", F.coalesce("sessions", F.array("conversation")).alias("sessions"), "questions")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or objects a line each, whichever the file holds."""
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    return whole if first and first[0][0].lstrip().startswith("[") else spark.read.schema(schema).json(path)
