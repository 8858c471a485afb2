"""Named queries over the store, each with the SQL that says the same over the star tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reverie.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The projection of reverie.sources.store in SQL; a query's SQL goes on from here with a comma or SELECT.
TABLES = """WITH RECURSIVE
episodes AS (SELECT conv_id || '-' || turn AS id, text AS content, role, 'c' || conv_id AS user_id, turn FROM conversations),
memories AS (SELECT *, created_at AS valid_from,
    CASE WHEN toxic = 1 THEN updated_at + INTERVAL 1 DAY END AS invalid_at,
    CASE WHEN toxic = 1 AND seq % 3 = 0 THEN CAST(seq + 1 AS VARCHAR) END AS superseded_by
  FROM (SELECT *, created_at + to_days(CAST(seq % 50 AS INT)) AS updated_at
    FROM (SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id AS seq, d.text AS content,
      CASE d.doc_id % 4 WHEN 0 THEN 'semantic' WHEN 1 THEN 'episodic' WHEN 2 THEN 'procedural' ELSE 'working' END AS memory_type,
      d.source AS user_id, d.lang AS agent_id,
      coalesce(0.25::DOUBLE + 0.5::DOUBLE * l.quality, 0.5::DOUBLE) AS importance, l.toxic,
      CASE WHEN d.doc_id % 10 = 9 THEN CAST([] AS VARCHAR[]) WHEN d.doc_id % 5 = 0 AND d.doc_id * 7 % 25 <> d.doc_id % 25
        THEN ['nation_' || (d.doc_id % 25), 'nation_' || (d.doc_id * 7 % 25)] ELSE ['nation_' || (d.doc_id % 25)] END AS categories,
      CASE d.doc_id % 40 WHEN 3 THEN '{"pending_distillation": true, "_enrichment": {"status": "pending", "attempts": 0}}'
        WHEN 23 THEN '{"pending_distillation": true, "_enrichment": {"status": "retry", "attempts": 2, "next_attempt_at": "2024-07-01T00:00:00"}}' ELSE '{}' END AS metadata,
      TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id % 2400 AS INT)) AS created_at
      FROM documents d LEFT JOIN labels l USING (doc_id)))),
vectors AS (SELECT vec_id AS id, embedding, label AS tag, CASE WHEN vec_id % 10 = 9 THEN 'other' ELSE 'main' END AS embedding_model FROM embeddings),
memory_events AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS memory_id,
  CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'click' THEN 'UPDATE' WHEN 'purchase' THEN 'SUPERSEDE' WHEN 'error' THEN 'DELETE' WHEN 'view' THEN 'NONE' END AS event,
  ts AS created_at, CASE event_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'system' END AS actor, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
topics AS (SELECT 'r' || r_regionkey AS id, r_name AS name, lower(r_name) AS normalized FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, lower(n_name) FROM nation),
topic_relations AS (SELECT 'r' || n_regionkey AS broader, 'n' || n_nationkey AS narrower, n_nationkey AS seq FROM nation),
memory_topics AS (SELECT id AS memory_id, replace(unnest(categories), 'nation_', 'n') AS topic_id FROM memories),
entities AS (SELECT p_partkey AS id, p_name || ' ' || lower(replace(p_brand, '#', '')) AS name, lower(p_name || ' ' || replace(p_brand, '#', '')) AS normalized, p_type AS entity_type,
  CASE WHEN p_partkey % 9 = 1 THEN p_partkey - 1 WHEN p_partkey % 9 = 2 THEN p_partkey - 1 WHEN p_partkey % 90 = 8 THEN -1 WHEN p_partkey % 90 = 44 THEN p_partkey + 1 WHEN p_partkey % 90 = 45 THEN p_partkey - 1 END AS merged_into,
  p_retailprice AS updated, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS description FROM part),
mentions AS (SELECT l_partkey AS entity_id, l_orderkey AS memory_id, 'part ' || l_partkey AS surface FROM lineitem),
placed AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS updated_at, o_orderstatus AS status, o_totalprice AS value FROM orders),
relations AS (SELECT 's' || l_suppkey AS subject, 'supplies' AS predicate, 'p' || l_partkey AS object, l_suppkey % 10 AS user_id, memory_id, created_at,
  CASE WHEN (l_suppkey + l_partkey) % 7 = 0 THEN created_at END AS invalid_at
  FROM (SELECT l_suppkey, l_partkey, min(l_orderkey) AS memory_id, max(l_shipdate) AS created_at FROM lineitem GROUP BY ALL)),
proposals AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 1 ELSE p_partkey END AS entity_a, CASE WHEN p_partkey % 4 = 0 THEN p_partkey ELSE p_partkey + 1 END AS entity_b,
  p_partkey % 10 AS user_id, CASE WHEN p_partkey % 6 = 0 THEN 'confirmed' WHEN p_partkey % 6 = 2 THEN 'rejected' ELSE 'proposed' END AS status, p_retailprice AS created FROM part WHERE p_partkey % 2 = 0),
vector_tags AS (SELECT id, tag * 2 + h AS tag, list_transform(list_zip(embedding, lead), lambda x: x[1]::DOUBLE + 3 * x[2]::DOUBLE) AS embedding
  FROM (SELECT v.id, v.tag, v.embedding, l.embedding AS lead, unnest(CASE WHEN v.id % 10 = 0 THEN [0, 1] ELSE [CAST(v.id % 2 AS INT)] END) AS h FROM vectors v JOIN vectors l ON l.id = v.tag))
"""


def query(name: str, sql: str | None = None):
    """Registers a function of a Store; sql goes on after TABLES."""

    def register(make: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: make(Store(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = TABLES + sql
        return make

    return register
