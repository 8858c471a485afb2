"""Streams, files, embedding and extraction: queries that SQL does not express."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from reverie.functions import embedding, extension, text
from reverie.operators import extraction, reconciling
from reverie.operators.graph import kept, shared_folder
from reverie.plans.registry import query
from reverie.sources import store as source
from reverie.streaming import ingest, retrying


def _folder(s) -> str:
    return f"{shared_folder(s.spark)}/flow-{uuid.uuid4().hex}"


def _messages(s):
    return s.episodes.select("id", "content", "role", "user_id")


SCHEMA = "id string, content string, role string, user_id string, status string"


@query("x1_land", "SELECT 'pending' AS status, count(*) AS n FROM episodes")
def _(s):
    path = _folder(s)
    ingest.land(_messages(s), path)
    return s.spark.read.schema(SCHEMA).parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


QUEUE = "id string, content string, user_id string, attempts int, next_attempt_at string"


def _queued(s):
    """Messages of the queue: some have failed before, and some of these are not due yet."""
    turn = F.col("turn") % 4
    tried = F.when(turn == 2, 2).when(turn == 3, 4).otherwise(0).cast("int")
    at = F.when(turn == 2, "2024-05-31T00:00:00").when(turn == 3, "2024-06-02T00:00:00")
    return s.episodes.select("id", "content", "user_id", tried.alias("attempts"), at.alias("next_attempt_at"))


def _distilled(batch):
    """Facts of a batch's replies, null where there are none: texts whose length is a multiple of five give no reply."""
    body = F.to_json(F.struct(F.array(F.struct(F.trim("content").alias("content"), F.lit("episodic").alias("type"))).alias("facts")))
    reply = F.when(F.length("content") % 5 != 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.lit("no reply"))
    return batch.select("id", reply.alias("reply"))


def _enriched(s, landed, fail=None):
    path = _folder(s)
    for k, part in enumerate(landed):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        run = lambda: ingest.enrich_queue(s.spark, f"{path}/in", QUEUE, f"{path}/out", f"{path}/state", lambda b: extraction.candidates(extraction.replies(_distilled(b))), "2024-06-01T00:00:00", fail if k == 0 else None)  # noqa: E731, B023
        try:
            run()
        except Exception:
            if k or fail is None:
                raise
            run()  # the stream starts again from its checkpoint
    return s.spark.read.parquet(f"{path}/out").select("id", "status", "attempts", "wait", F.md5(F.col("content").cast("binary")).alias("content"))


ENRICHED = """, q AS (SELECT *, CASE turn % 4 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 0 END AS tried FROM episodes)
SELECT id, CASE WHEN turn % 4 = 3 THEN 'waiting' WHEN length(content) % 5 <> 0 AND trim(content) <> '' THEN 'done' ELSE 'retry' END AS status, CAST(CASE WHEN turn % 4 = 3 THEN tried ELSE tried + 1 END AS INT) AS attempts,
  CASE WHEN turn % 4 <> 3 AND (length(content) % 5 = 0 OR trim(content) = '') THEN least(pow(2.0, least(tried + 1, 8)), 300.0) END AS wait, CASE WHEN turn % 4 <> 3 AND length(content) % 5 <> 0 AND trim(content) <> '' THEN md5(trim(content)) END AS content FROM q"""


@query("x2_enrich", ENRICHED)
def _(s):
    """Due messages are distilled in micro-batches; what fails waits longer each time, what is not due stays as it is."""
    return _enriched(s, [_queued(s)])


@query("x4_recovery", ENRICHED)
def _(s):
    """The first batch dies after its distilling, before it is committed; the stream goes on from its checkpoint, and nothing is lost or taken twice."""
    died = []

    def fail(number):
        if not died:
            died.append(number)
            raise RuntimeError("crash")

    half = F.pmod(F.xxhash64("id"), F.lit(2))
    return _enriched(s, [_queued(s).where(half == 0), _queued(s).where(half == 1)], fail)


@query("x3_retry_states", """, e AS (SELECT user_id AS id, event_type = 'purchase' AS ok FROM events), n AS (SELECT id, count(*) AS n, bool_or(ok) AS done FROM e GROUP BY 1)
SELECT id, CASE WHEN done THEN 'done' ELSE 'retry' END AS status, CASE WHEN NOT done THEN CAST(n AS INT) END AS failed, CASE WHEN done THEN 0.0 ELSE least(pow(2.0, least(n, 8)), 300.0) END AS wait FROM n""")
def _(s):
    path = _folder(s)
    s.table("events").select(F.col("user_id").alias("id"), (F.col("event_type") == "purchase").alias("ok")).repartition(2).write.parquet(f"{path}/in")
    stream = s.spark.readStream.schema("id long, ok boolean").parquet(f"{path}/in")

    def one(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    ingest.retries(stream).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    done = F.col("status") == "done"
    return s.spark.read.parquet(f"{path}/out").select("id", "status", F.when(~done, F.col("attempts")).alias("failed"), "wait")


@query("x3_retry_loop", "SELECT id, CAST(coalesce(length(content), 0) % 3 + 1 AS INT) AS attempts, md5(coalesce(content, '')) AS content FROM episodes")
def _(s):
    """One running stream: a message fails as often as its length is over a multiple of three, and comes back by itself each time."""
    path, size = _folder(s), F.length("content")
    s.episodes.select("id", F.coalesce("content", F.lit("")).alias("content")).write.option("maxRecordsPerFile", 2000).parquet(f"{path}/landing")  # a batch takes a few files
    running = retrying.loop(s.spark, f"{path}/landing", path, lambda due: due.where(F.col("attempts") > size % 3).select("id", "content"), 0.05)
    retrying.wait_for(running, path, s.episodes.count())
    return retrying.finished(s.spark, path).select("id", "attempts", F.md5(F.col("content").cast("binary")).alias("content"))


@query("x6_stream_windows", "SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H') AS hour, event, count(*) AS n FROM memory_events WHERE date_trunc('hour', created_at) + INTERVAL 2 HOUR <= (SELECT max(created_at) FROM memory_events) GROUP BY ALL")
def _(s):
    """Windows that the watermark has closed, an hour behind the latest event; one batch reads all files, so none of its events is late."""
    path = _folder(s)
    s.events.select("created_at", "event").write.parquet(f"{path}/in")
    stream = s.spark.readStream.schema("created_at timestamp_ntz, event string").parquet(f"{path}/in").withColumn("created_at", F.col("created_at").cast("timestamp"))
    out = ingest.windowed_counts(stream)
    out.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return s.spark.read.parquet(f"{path}/out").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event", "n")


@query("s16_jsonl_cases", "SELECT 'case-' || item_id AS id, CAST(1 AS INT) AS sessions, CAST(1 AS INT) AS questions FROM benchmark")
def _(s):
    path = _folder(s)
    asked = s.table("benchmark").select(F.concat(F.lit("case-"), F.col("item_id").cast("string")).alias("id"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("conversation"), F.array(F.struct(F.substring("text", 1, 20).alias("q"), F.slice(text.words(F.col("text")), 1, 2).alias("expected_keywords"))).alias("questions"))
    asked.write.json(path)
    return source.read_cases(s.spark, path).select("id", F.size("sessions").alias("sessions"), F.size("questions").alias("questions"))


@query("s17_json_rows", "SELECT id, user_id, memory_type FROM memories")
def _(s):
    path = _folder(s)
    s.memories.select("id", "user_id", "memory_type").write.json(path)
    return source.read_rows(s.spark, path, "id string, user_id string, memory_type string")


@query("v2_hash_embedder")
def _(s):
    return s.memories.select("id", embedding.hash_embedder(64)(F.col("content")).alias("embedding"))


@query("v8_reindex", "SELECT id, 'hash-64' AS embedding_model, CAST(64 AS INT) AS width FROM memories")
def _(s):
    rows = s.memories.select("id", "content", F.lit(None).cast("array<float>").alias("embedding"), F.when(F.col("seq") % 2 == 0, "old").alias("embedding_model"))
    return embedding.reindexed(rows, "hash-64", embedding.hash_embedder(64)).select("id", "embedding_model", F.size("embedding").alias("width"))


@query("v7_client_embedder", "SELECT id, 'hash:64' AS embedding_model, CASE WHEN content IS NOT NULL THEN CAST(64 AS INT) END AS width FROM memories")
def _(s):
    """All memories through a client that is connected to once a task; here it is the hash embedder."""
    rows = s.contents.select("id", "content", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model"))
    embed = extension.client_embedder(lambda: lambda texts: embedding.hashed(pd.Series(texts, dtype=object), 64).tolist())
    return embedding.reindexed(rows, extension.model_name("hash", 64), embed).select("id", "embedding_model", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("width"))


@query("t3_table_function", r"SELECT id, term, CAST(count(*) AS INT) AS tf FROM (SELECT id, unnest(regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+')) AS term FROM episodes) GROUP BY ALL")
def _(s):
    """Postings of all messages, as SQL with a table function."""
    extension.register(s.spark)
    return s.spark.sql("SELECT m.id, p.term, p.tf FROM {m} AS m, LATERAL postings_of(m.content) AS p", m=s.episodes)


def _replies(s):
    fact = F.to_json(F.struct(F.array(F.struct(F.col("content"), F.lit("Episodic").alias("type"), F.lit("1.7").alias("importance"), F.array(F.lit("x")).alias("categories"), F.array(F.struct(F.lit("a").alias("subject"), F.lit("Works On").alias("predicate"), F.lit("b").alias("object")), F.struct(F.lit("a").alias("subject"), F.lit("is").alias("predicate"), F.lit(" A").alias("object"))).alias("relations"))).alias("facts")))
    k = F.col("turn") % 3
    return s.episodes.select("id", "user_id", F.when(k == 0, fact).when(k == 1, F.concat(F.lit("```json\n"), fact, F.lit("\n```"))).otherwise(F.concat(F.lit("Sure: {oops} "), fact, F.lit(" done"))).alias("reply"))


@query("l9_extraction")
def _(s):
    return extraction.candidates(extraction.replies(_replies(s))).select("id", "content", "memory_type", "importance", F.to_json("relations").alias("relations"))


@query("l7_add", r""", form AS (SELECT *, trim(regexp_replace(lower(content), '[^\p{L}\p{N}_]+', ' ', 'g')) AS form FROM episodes), known AS (SELECT DISTINCT user_id, form FROM form WHERE turn = 0),
fate AS (SELECT f.id, CASE WHEN k.form IS NULL THEN 'ADD' ELSE 'NONE' END AS action FROM form f LEFT JOIN known k ON k.user_id = f.user_id AND k.form = f.form WHERE trim(coalesce(f.content, '')) <> '')
SELECT 'episodes' AS kind, count(*) AS n FROM episodes UNION ALL SELECT 'fate ' || action, count(*) FROM fate GROUP BY 1 UNION ALL SELECT 'memories', (SELECT count(*) FROM fate WHERE action = 'ADD') + (SELECT count(*) FROM episodes WHERE turn = 0)
UNION ALL SELECT 'events ADD', count(*) FROM fate WHERE action = 'ADD' UNION ALL SELECT 'topic links', count(*) FROM fate WHERE action = 'ADD' UNION ALL SELECT 'new topics', 1""")
def _(s):
    """Messages to episodes, facts, decisions, memories, events and topics; the first turn of each conversation is stored before."""
    now = F.expr("timestamp_ntz'2024-06-01 00:00:00'")
    none = F.lit(None).cast("string")
    stored = s.episodes.where("turn = 0").select(F.concat(F.lit("m"), "id").alias("id"), "content", "user_id", F.lit(0.5).alias("importance"), none.cast("timestamp_ntz").alias("invalid_at"), none.alias("superseded_by"), now.alias("updated_at"), now.alias("created_at"), F.lit(0).alias("seq"))
    facts = extraction.candidates(extraction.replies(_replies(s))).select("id", "user_id", "content", "importance", "categories")
    decisions = s.spark.createDataFrame([], "id string, action string, target string, new_content string")
    fates = kept(reconciling.decided(facts, stored, decisions), "fates")
    state = reconciling.state_after(stored, fates, now)
    added = fates.where("action = 'ADD'")
    links, new = reconciling.topics_of(added.select("id", F.lit(0).alias("seq"), "categories"), s.topics)
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    by_action = fates.groupBy(F.concat(F.lit("fate "), "action").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    events = reconciling.events_of(fates, stored).groupBy(F.concat(F.lit("events "), "event").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return count(s.episodes, "episodes").union(by_action).union(count(state, "memories")).union(events).union(count(links, "topic links")).union(count(new, "new topics"))
