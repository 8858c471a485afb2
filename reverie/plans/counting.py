"""Joins, aggregates and windows over the store."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.functions import predicates as P
from reverie.functions import scoring, text
from reverie.operators import graph, lifecycle, search, upkeep
from reverie.plans.registry import query


def n_rows():
    return F.count(F.lit(1)).alias("n")


@query("j1_postings_join", r""", p AS (SELECT DISTINCT id FROM (SELECT id, unnest(regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+')) AS term FROM memories) WHERE term IN ('the', 'die'))
SELECT m.id, m.user_id FROM memories m JOIN p USING (id) WHERE invalid_at IS NULL""")
def _(s):
    hits = search.postings(s.contents).where(F.col("term").isin("the", "die")).select("id")
    return s.memories.where(P.active()).join(hits, "id", "left_semi").select("id", "user_id")


@query("j2_topic_memories", "SELECT t.normalized, m.id FROM topics t JOIN memory_topics x ON t.id = x.topic_id JOIN memories m ON m.id = x.memory_id WHERE m.user_id = 'src5' AND m.invalid_at IS NULL")
def _(s):
    own = s.memories.where(P.scoped(user_id="src5") & P.active()).select(F.col("id").alias("memory_id"))
    return s.memory_topics.join(own, "memory_id").join(s.topics.select(F.col("id").alias("topic_id"), "normalized"), "topic_id").select("normalized", F.col("memory_id").alias("id"))


@query("j3_entity_memories", "SELECT id FROM (SELECT DISTINCT o.id, o.updated_at FROM mentions m JOIN placed o ON m.memory_id = o.id WHERE m.entity_id = 17) ORDER BY updated_at DESC, id LIMIT 20")
def _(s):
    own = s.mentions.where("entity_id = 17").select(F.col("memory_id").alias("id")).distinct()
    return s.orders.join(own, "id", "left_semi").orderBy(F.desc("updated_at"), "id").limit(20).select("id")


@query("j4_entities_of_memory", "SELECT DISTINCT e.id, e.name FROM mentions m JOIN entities e ON m.entity_id = e.id WHERE m.memory_id IN (10, 11, 12) AND e.merged_into IS NULL")
def _(s):
    hit = s.mentions.where(F.col("memory_id").isin(10, 11, 12)).select(F.col("entity_id").alias("id"))
    return s.entities.where("merged_into IS NULL").join(hit, "id", "left_semi").select("id", "name")


@query("j5_topic_semi", "SELECT id FROM memories m WHERE EXISTS (SELECT 1 FROM memory_topics t WHERE t.memory_id = m.id AND t.topic_id = 'n4')")
def _(s):
    return s.memories.join(s.memory_topics.where("topic_id = 'n4'").select(F.col("memory_id").alias("id")), "id", "left_semi").select("id")


@query("j6_entity_semi", "SELECT count(*) AS n FROM placed o WHERE EXISTS (SELECT 1 FROM mentions m JOIN entities e ON e.id = m.entity_id WHERE m.memory_id = o.id AND e.entity_type = 'PROMO')")
def _(s):
    promo = s.entities.where("entity_type = 'PROMO'").select(F.col("id").alias("entity_id"))
    hit = s.mentions.join(promo, "entity_id", "left_semi").select(F.col("memory_id").alias("id"))
    return s.orders.join(hit, "id", "left_semi").agg(n_rows())


@query("j7_orphan_entities", """, told AS (SELECT entity_id FROM mentions WHERE entity_id % 11 NOT IN (2, 3, 5)), ends AS (SELECT object FROM relations WHERE CAST(substr(object, 2) AS BIGINT) % 11 NOT IN (3, 5))
SELECT id FROM entities e WHERE merged_into IS NULL AND id NOT IN (SELECT entity_id FROM told) AND 'p' || id NOT IN (SELECT object FROM ends) AND id NOT IN (SELECT merged_into FROM entities WHERE merged_into IS NOT NULL)""")
def _(s):
    """The memories of some entities are gone, and of most of these what relations said too."""
    used = s.mentions.select(F.col("entity_id").alias("id")).where(~(F.col("id") % 11).isin(2, 3, 5))
    ends = s.relations.select(F.expr("CAST(substring(object, 2) AS BIGINT)").alias("id")).where(~(F.col("id") % 11).isin(3, 5))
    merged = s.entities.where("merged_into IS NOT NULL").select(F.col("merged_into").alias("id"))
    return upkeep.orphans(s.entities.where("merged_into IS NULL").select("id"), used, ends, merged)


@query("j8_orphan_topics", """, had AS (SELECT topic_id FROM memory_topics WHERE topic_id NOT IN ('n4', 'n9', 'n12')), ends AS (SELECT broader AS id FROM topic_relations WHERE narrower NOT IN ('n4', 'n12') UNION SELECT narrower FROM topic_relations WHERE narrower NOT IN ('n4', 'n12'))
SELECT id FROM topics t WHERE id NOT IN (SELECT topic_id FROM had) AND id NOT IN (SELECT id FROM ends)""")
def _(s):
    """Three topics have lost their memories, two of them their place in the hierarchy as well."""
    ends = s.topic_relations.where(~F.col("narrower").isin("n4", "n12")).select(F.explode(F.array("broader", "narrower")).alias("id"))
    had = s.memory_topics.where(~F.col("topic_id").isin("n4", "n9", "n12"))
    return upkeep.orphans(s.topics.select("id"), had.select(F.col("topic_id").alias("id")), ends)


@query("j9_edges_touching", "SELECT subject, object FROM relations WHERE subject IN ('s1', 's7') OR object IN ('p3', 'p9')")
def _(s):
    ids = s.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("s1", "s7", "p3", "p9")])).alias("id"))
    return graph.touching(s.relations.select("subject", "object"), ids)


@query("j12_pair_lookup", "SELECT id, status FROM proposals WHERE (entity_a = 4 AND entity_b = 5) OR (entity_a = 5 AND entity_b = 4) OR (least(entity_a, entity_b) = 10 AND greatest(entity_a, entity_b) = 11)")
def _(s):
    wanted = s.spark.sql("SELECT * FROM VALUES (5L, 4L), (10L, 11L) AS t(a, b)").select(*upkeep.unordered(F.col("a"), F.col("b")))
    return s.proposals.select("id", "status", *upkeep.unordered(F.col("entity_a"), F.col("entity_b"))).join(wanted, ["low", "high"]).select("id", "status")


@query("j13_similar_pairs", "SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.embedding, b.embedding)::DOUBLE, 4) AS similarity FROM vectors a JOIN vectors b ON a.id < b.id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4")
def _(s):
    return search.similarity_pairs(s.vectors, 0.4).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query("j14_cooccurrence", "SELECT a.entity_id AS a, b.entity_id AS b, count(DISTINCT a.memory_id) AS n FROM mentions a JOIN mentions b ON a.memory_id = b.memory_id AND a.entity_id < b.entity_id GROUP BY ALL HAVING count(DISTINCT a.memory_id) > 1")
def _(s):
    return graph.shared_counts(s.mentions, "memory_id", "entity_id").where("n > 1")


#: Tags that mean the same: close centroids, or less close ones whose labels are alike, that rarely stand together.
SPLIT = """, cen AS (SELECT tag, count(*) AS n FROM vector_tags GROUP BY 1), mean AS (SELECT tag, list(m ORDER BY i) AS c FROM (SELECT tag, i, avg(v::DOUBLE) AS m FROM (SELECT tag, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM vector_tags) GROUP BY ALL) GROUP BY 1),
both_ AS (SELECT a.tag AS a, b.tag AS b, count(DISTINCT a.id) AS n FROM vector_tags a JOIN vector_tags b ON a.id = b.id AND a.tag < b.tag GROUP BY ALL),
label AS (SELECT id AS tag, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM vectors),
pair AS (SELECT a.tag AS a, b.tag AS b, na.n AS x, nb.n AS y, list_cosine_similarity(a.c, b.c) AS sim, list_cosine_similarity(la.e, lb.e) AS named, coalesce(t.n, 0) AS together
  FROM mean a JOIN mean b ON a.tag < b.tag JOIN cen na ON na.tag = a.tag JOIN cen nb ON nb.tag = b.tag LEFT JOIN label la ON la.tag = a.tag LEFT JOIN label lb ON lb.tag = b.tag LEFT JOIN both_ t ON t.a = a.tag AND t.b = b.tag WHERE na.n >= 2 AND nb.n >= 2),
split AS (SELECT CASE WHEN x >= y THEN a ELSE b END AS canonical, CASE WHEN x >= y THEN b ELSE a END AS variant, round(sim, 4) AS similarity FROM pair
  WHERE (sim >= 0.93 OR (sim >= 0.75 AND named >= 0.62)) AND together / least(x, y)::DOUBLE <= 0.25)
"""


def split_pairs(s, most=20):
    together = graph.shared_counts(s.vector_tags, "id", "tag")
    labels = s.vectors.select(F.col("id").cast("int").alias("tag"), F.col("embedding").alias("label"))
    return upkeep.split_tags(upkeep.tag_centroids(s.vector_tags), together, labels, most=most)


ROOTS = """, walk AS (SELECT id, id AS here, merged_into AS nxt, 0 AS d FROM entities UNION ALL SELECT w.id, e.id, e.merged_into, d + 1 FROM walk w JOIN entities e ON e.id = w.nxt WHERE d < 12),
roots AS (SELECT e.id, r.here AS root FROM entities e LEFT JOIN (SELECT id, here FROM walk WHERE nxt IS NULL) r USING (id))
"""


@query("j15_merge_roots", ROOTS + "SELECT id, root FROM roots")
def _(s):
    return graph.roots(s.entities)


@query("j16_endpoint_names", "SELECT s_name AS subject, p_name AS object, count(*) AS n FROM relations JOIN supplier ON subject = 's' || s_suppkey JOIN part ON object = 'p' || p_partkey GROUP BY ALL")
def _(s):
    sup = s.table("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("subject"), "s_name")
    part = s.table("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("object"), "p_name")
    named = s.relations.join(sup, "subject").join(part, "object")
    return named.groupBy(F.col("s_name").alias("subject"), F.col("p_name").alias("object")).agg(n_rows())


@query("j17_backup_conflicts", "SELECT count(*) AS n FROM (SELECT id, importance + CASE WHEN seq % 10 = 0 THEN 0.125 ELSE 0 END AS i FROM memories) a JOIN memories b USING (id) WHERE a.i IS DISTINCT FROM b.importance")
def _(s):
    changed = F.col("importance") + F.when(F.col("seq") % 10 == 0, F.lit(0.125)).otherwise(F.lit(0.0))
    return lifecycle.compared(s.memories.select("id", changed.alias("importance")), s.memories.select("id", "importance")).where("fate = 'conflict'").agg(n_rows())


@query("j18_as_of", "SELECT id FROM memories WHERE valid_from <= TIMESTAMP '2024-02-01' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-02-01')")
def _(s):
    return lifecycle.as_of(s.memories, "2024-02-01 00:00:00").select("id")


def _direct(s):
    live = s.memories.where(P.active()).select(F.col("id").alias("memory_id"))
    return s.memory_topics.join(live, "memory_id", "left_semi").groupBy("topic_id").agg(F.countDistinct("memory_id").alias("n"))


@query("a1_direct_topic_counts", "SELECT t.normalized, count(DISTINCT x.memory_id) AS n FROM topics t JOIN memory_topics x ON t.id = x.topic_id JOIN memories m ON m.id = x.memory_id WHERE m.invalid_at IS NULL GROUP BY 1 ORDER BY n DESC, 1")
def _(s):
    return _direct(s).join(s.topics.select(F.col("id").alias("topic_id"), "normalized"), "topic_id").select("normalized", "n").orderBy(F.desc("n"), "normalized")


@query("a2_topic_rollup", """, under AS (SELECT id AS root, id, 0 AS depth FROM topics UNION SELECT u.root, r.narrower, depth + 1 FROM under u JOIN topic_relations r ON r.broader = u.id WHERE depth < 7)
SELECT t.normalized, count(DISTINCT x.memory_id) AS n FROM topics t JOIN under u ON u.root = t.id JOIN memory_topics x ON x.topic_id = u.id JOIN memories m ON m.id = x.memory_id WHERE m.invalid_at IS NULL AND m.agent_id = 'en' GROUP BY 1""")
def _(s):
    under = graph.closure(s.topic_relations, s.topics.select("id")).select("root", F.col("id").alias("topic_id"))
    live = s.memories.where(P.active() & P.scoped(agent_id="en")).select(F.col("id").alias("memory_id"))
    own = s.memory_topics.join(live, "memory_id", "left_semi").join(under, "topic_id")
    counted = own.groupBy("root").agg(F.countDistinct("memory_id").alias("n"))
    return counted.join(s.topics, F.col("root") == F.col("id")).select("normalized", "n")


@query("a3_category_histogram", "SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM memories WHERE invalid_at IS NULL) GROUP BY 1")
def _(s):
    return s.memories.where(P.active()).select(F.explode("categories").alias("category")).groupBy("category").agg(n_rows())


@query("a4_by_type", "SELECT memory_type, count(*) AS n FROM memories WHERE invalid_at IS NULL GROUP BY 1")
def _(s):
    return s.memories.where(P.active()).groupBy("memory_type").agg(n_rows())


@query("a5_tag_cooccurrence", "SELECT a.topic_id AS a, b.topic_id AS b, count(*) AS n FROM memory_topics a JOIN memory_topics b ON a.memory_id = b.memory_id AND a.topic_id < b.topic_id GROUP BY ALL")
def _(s):
    return graph.shared_counts(s.memory_topics, "memory_id", "topic_id")


@query("a6_tag_centroids", "SELECT tag, i AS pos, round(avg(v::DOUBLE), 6) AS mean FROM (SELECT tag, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM vectors) GROUP BY ALL")
def _(s):
    return upkeep.tag_centroids(s.vectors).select("tag", F.posexplode("centroid").alias("pos", "mean")).select("tag", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


HEALTH = """, own AS (SELECT id, unnest(categories) AS tag FROM memories WHERE invalid_at IS NULL), c AS (SELECT tag, count(DISTINCT id) AS n FROM own GROUP BY 1)"""


@query("a7_tag_health", HEALTH + SPLIT + """, top AS (SELECT canonical || ' ' || variant AS pair, similarity FROM split ORDER BY similarity DESC, canonical, variant LIMIT 5)
SELECT (SELECT count(*) FROM memories WHERE invalid_at IS NULL) AS total, (SELECT count(*) FROM memories WHERE invalid_at IS NULL AND len(categories) = 0) AS untagged,
  count(*) AS tags, count(*) FILTER (WHERE n = 1) AS single_use, round(count(*) FILTER (WHERE n = 1) / count(*), 3) AS share, (SELECT count(*) FROM split) AS suspected,
  coalesce((SELECT string_agg(pair, ', ' ORDER BY similarity DESC, pair) FROM top), '') AS first FROM c""")
def _(s):
    live = s.memories.where(P.active())
    tags = live.select("id", F.explode("categories").alias("tag")).groupBy("tag").agg(F.countDistinct("id").alias("n"))
    used = tags.agg(F.count(F.lit(1)).alias("tags"), F.count_if(F.col("n") == 1).alias("single_use"), F.round(F.count_if(F.col("n") == 1) / F.count(F.lit(1)), 3).alias("share"))
    whole = live.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("categories") == 0).alias("untagged"))
    pairs = graph.kept(split_pairs(s, None), "split")
    top = pairs.orderBy(F.desc("similarity"), "canonical", "variant").limit(5)
    named = F.struct((-F.col("similarity")).alias("less"), F.concat_ws(" ", F.col("canonical").cast("string"), F.col("variant").cast("string")).alias("pair"))
    listed = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda x: x["pair"]), ", ").alias("first"))  # five rows
    return search.beside(search.beside(search.beside(whole, used), pairs.agg(F.count(F.lit(1)).alias("suspected"))), listed)


@query("a8_stats", """SELECT count(*) AS memories, count(*) FILTER (WHERE invalid_at IS NULL) AS active, count(*) FILTER (WHERE superseded_by IS NOT NULL) AS superseded,
  count(DISTINCT user_id) AS users, count(*) FILTER (WHERE json_extract_string(metadata, '$.pending_distillation') = 'true') AS pending, round(avg(importance), 6) AS importance FROM memories""")
def _(s):
    return _stats(s.memories)


def _stats(memories):
    waits = F.count_if(P.pending(F.col("metadata"))).alias("pending")
    return memories.agg(F.count(F.lit(1)).alias("memories"), F.count_if(P.active()).alias("active"), F.count("superseded_by").alias("superseded"), F.countDistinct("user_id").alias("users"), waits, F.round(F.avg("importance"), 6).alias("importance"))


@query("s24_stats_by_table", "SELECT 'episodes' AS name, count(*) AS n FROM episodes UNION ALL SELECT 'memories', count(*) FROM memories UNION ALL SELECT 'events', count(*) FROM memory_events UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'proposals', count(*) FROM proposals")
def _(s):
    tables = {"episodes": s.episodes, "memories": s.memories, "events": s.events, "entities": s.entities, "relations": s.relations, "proposals": s.proposals}
    out = None
    for name, df in tables.items():
        row = df.agg(n_rows()).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.union(row)
    return out


@query("a9_tenant_stats", """SELECT count(*) AS memories, count(*) FILTER (WHERE invalid_at IS NULL) AS active, count(*) FILTER (WHERE superseded_by IS NOT NULL) AS superseded,
  count(DISTINCT user_id) AS users, count(*) FILTER (WHERE json_extract_string(metadata, '$.pending_distillation') = 'true') AS pending, round(avg(importance), 6) AS importance FROM memories WHERE user_id = 'src4'""")
def _(s):
    return _stats(s.memories.where(P.owned(F.col("user_id"), "src4")))


@query("a10_repair_dates", """, last AS (SELECT memory_id, max(created_at) AS c FROM memory_events WHERE event IN ('ADD', 'UPDATE', 'SUPERSEDE') GROUP BY 1)
SELECT count(*) AS wrong FROM memories LEFT JOIN last ON id = memory_id WHERE updated_at <> greatest(created_at, coalesce(c, created_at))""")
def _(s):
    return lifecycle.repaired(s.memories, s.events).where("updated_at <> right").agg(F.count(F.lit(1)).alias("wrong"))


@query("a11_latest_delete", "SELECT memory_id, arg_max(actor, struct_pack(c := created_at, i := id)) AS actor, max(id) AS id FROM (SELECT * FROM memory_events WHERE event = 'DELETE') GROUP BY 1 HAVING arg_max(actor, struct_pack(c := created_at, i := id)) IS NOT NULL")
def _(s):
    last = s.events.where("event = 'DELETE'").groupBy("memory_id").agg(F.max(F.when(F.col("actor").isNotNull(), F.struct("created_at", "id", "actor"))).alias("last"), F.max("id").alias("id"))
    return last.where("last IS NOT NULL").select("memory_id", "last.actor", "id")


@query("a12_action_summary", "SELECT event, count(*) AS n FROM memory_events GROUP BY 1")
def _(s):
    return s.events.groupBy("event").agg(n_rows())


@query("a14_vector_width", "SELECT embedding_model, CAST(max(len(embedding)) AS INT) AS width FROM vectors GROUP BY 1")
def _(s):
    return s.vectors.groupBy("embedding_model").agg(F.max(F.size("embedding")).alias("width"))


@query("a15_zones", """, c AS (SELECT topic_id, count(*) AS n FROM memory_topics GROUP BY 1), m AS (SELECT avg(n) AS mean, stddev_pop(n) AS sd, max(n) AS most, count(*) FILTER (WHERE n >= (SELECT avg(n) + 2 * stddev_pop(n) FROM c)) AS far FROM c)
SELECT topic_id, CASE WHEN CASE WHEN far > 0 THEN n >= mean + 2 * sd ELSE n = most END THEN 'core' WHEN n <= greatest(1, mean - 2 * sd) THEN 'rim' ELSE 'belt' END AS zone FROM c, m""")
def _(s):
    c = s.memory_topics.groupBy("topic_id").agg(n_rows())
    m = c.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.max("n").alias("most"))
    core = F.when(F.col("most") >= F.col("mean") + 2 * F.col("sd"), F.col("n") >= F.col("mean") + 2 * F.col("sd")).otherwise(F.col("n") == F.col("most"))
    zone = F.when(core, "core").when(F.col("n") <= F.greatest(F.lit(1.0), F.col("mean") - 2 * F.col("sd")), "rim").otherwise("belt")
    return search.beside(c, m).select("topic_id", zone.alias("zone"))


@query("a16_tag_edges", r""", pairs AS (SELECT a.topic_id AS a, b.topic_id AS b, 2 * count(*) AS w FROM memory_topics a JOIN memory_topics b ON a.memory_id = b.memory_id AND a.topic_id < b.topic_id GROUP BY ALL),
said AS (SELECT DISTINCT id, 'n' || word AS b, replace(categories[1], 'nation_', 'n') AS a FROM (SELECT id, categories, unnest(regexp_extract_all(content, '\d+')) AS word FROM memories WHERE len(categories) > 0) WHERE word IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)),
more AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS w FROM said WHERE a <> b GROUP BY ALL)
SELECT a, b, CAST(least(3, sum(w)) AS BIGINT) AS weight FROM (SELECT * FROM pairs UNION ALL SELECT * FROM more) GROUP BY a, b""")
def _(s):
    pairs = graph.shared_counts(s.memory_topics, "memory_id", "topic_id").select("a", "b", (F.col("n") * 2).alias("w"))
    said = s.memories.where(F.size("categories") > 0).select("id", F.regexp_replace(F.get("categories", F.lit(0)), "nation_", "n").alias("x"), F.explode(F.regexp_extract_all("content", F.lit(r"\d+"), F.lit(0))).alias("word"))
    known = s.table("nation").select(F.col("n_nationkey").cast("string").alias("word"))
    named = said.join(known, "word", "left_semi").select("id", "x", F.concat(F.lit("n"), F.col("word")).alias("y")).distinct().where("x <> y")
    more = named.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    return pairs.union(more).groupBy("a", "b").agg(F.least(F.lit(3), F.sum("w")).cast("long").alias("weight"))


@query("a17_untagged", "SELECT greatest(0, count(*) - count(*) FILTER (WHERE len(categories) > 0)) AS n FROM memories WHERE invalid_at IS NULL")
def _(s):
    return s.memories.where(P.active()).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - F.count_if(F.size("categories") > 0)).alias("n"))


@query("w5_representatives", "SELECT id, user_id FROM (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, length(content) DESC, created_at, seq) AS r FROM memories) WHERE r = 1")
def _(s):
    return upkeep.representatives(s.memories, "user_id").select("id", "user_id")


@query("w6_keep_first", "SELECT min(seq) AS seq FROM memories GROUP BY user_id, lower(trim(content))")
def _(s):
    return upkeep.first_of(s.contents.select("seq", "user_id", F.lower(F.trim("content")).alias("c")), [F.col("user_id"), F.col("c")], [F.col("seq")]).select("seq")


@query("w7_name_anchor", "SELECT id, first_value(id) OVER (PARTITION BY normalized ORDER BY updated DESC, id) AS anchor FROM entities WHERE merged_into IS NULL")
def _(s):
    return s.entities.where("merged_into IS NULL").select("id", F.first("id").over(W.partitionBy("normalized").orderBy(F.desc("updated"), "id")).alias("anchor"))


@query("w8_latest_event", "SELECT memory_id, id, event FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY created_at DESC, id DESC) AS r FROM memory_events) WHERE r = 1")
def _(s):
    return upkeep.first_of(s.events, [F.col("memory_id")], [F.desc("created_at"), F.desc("id")]).select("memory_id", "id", "event")


@query("v9_norms", "SELECT id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM vectors")
def _(s):
    return s.vectors.select("id", F.round(scoring.norm(F.col("embedding")), 5).alias("norm"))
