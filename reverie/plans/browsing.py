"""Scans, predicates, limits, set operations and simple joins."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reverie.functions import predicates as P
from reverie.functions import scoring, text
from reverie.operators import graph, lifecycle, upkeep
from reverie.plans.counting import ROOTS
from reverie.plans.registry import query
from reverie.sources import bundle


@query("s1_list_episodes", "SELECT id, role, CAST(turn AS BIGINT) AS turn FROM episodes WHERE user_id = 'c7' ORDER BY turn DESC, id LIMIT 100")
def _(s):
    return s.episodes.where(P.scoped(user_id="c7")).orderBy(F.desc("turn"), "id").limit(100).select("id", "role", "turn")


@query("s2_get_memory", "SELECT id, memory_type, user_id FROM memories WHERE id = '17' AND starts_with(user_id, 'src')")
def _(s):
    return s.memories.where((F.col("id") == "17") & F.col("user_id").startswith("src")).select("id", "memory_type", "user_id")


@query("s3_list_memories", """SELECT id, memory_type, strftime(updated_at, '%Y-%m-%d %H') AS updated FROM memories m WHERE user_id = 'src3' AND invalid_at IS NULL
  AND EXISTS (SELECT 1 FROM memory_topics t WHERE t.memory_id = m.id AND t.topic_id IN ('n3', 'n13', 'n23')) ORDER BY updated_at DESC, seq LIMIT 20 OFFSET 2""")
def _(s):
    tagged = s.memory_topics.where(F.col("topic_id").isin("n3", "n13", "n23")).select(F.col("memory_id").alias("id"))
    own = s.memories.where(P.scoped(user_id="src3") & P.active()).join(tagged, "id", "left_semi")
    return own.orderBy(F.desc("updated_at"), "seq").offset(2).limit(20).select("id", "memory_type", F.date_format("updated_at", "yyyy-MM-dd HH").alias("updated"))


@query("s4_all_memories", "SELECT id, content, importance FROM memories")
def _(s):
    return s.memories.select("id", "content", "importance")


@query("s5_memory_vectors", "SELECT id, round(list_sum(embedding), 4) AS total FROM vectors WHERE embedding IS NOT NULL AND embedding_model = 'main' ORDER BY id DESC LIMIT 5000")
def _(s):
    rows = s.vectors.where("embedding IS NOT NULL AND embedding_model = 'main'").orderBy(F.desc("id")).limit(5000)
    return rows.select("id", F.round(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("s6_history", "SELECT id, event, actor FROM memory_events WHERE memory_id = '42' ORDER BY created_at, id")
def _(s):
    return s.events.where("memory_id = '42'").orderBy("created_at", "id").select("id", "event", "actor")


@query("s7_list_topics", "SELECT id, name, normalized FROM topics ORDER BY normalized LIMIT 100")
def _(s):
    return s.topics.orderBy("normalized").limit(100)


@query("s8_list_topic_relations", "SELECT broader, narrower FROM topic_relations ORDER BY seq")
def _(s):
    return s.topic_relations.orderBy("seq").select("broader", "narrower")


@query("s9_list_relations", "SELECT subject, object, memory_id FROM relations WHERE user_id = 3 AND invalid_at IS NULL ORDER BY created_at DESC, subject, object LIMIT 50")
def _(s):
    return s.relations.where("user_id = 3 AND invalid_at IS NULL").orderBy(F.desc("created_at"), "subject", "object").limit(50).select("subject", "object", "memory_id")


@query("s10_list_entities", "SELECT id, name FROM entities WHERE merged_into IS NULL ORDER BY updated DESC, id LIMIT 100")
def _(s):
    return s.entities.where("merged_into IS NULL").orderBy(F.desc("updated"), "id").limit(100).select("id", "name")


@query("s11_list_proposals", "SELECT id, entity_a, entity_b FROM proposals WHERE user_id = 4 AND status = 'proposed' ORDER BY created DESC, id LIMIT 50")
def _(s):
    return s.proposals.where("user_id = 4 AND status = 'proposed'").orderBy(F.desc("created"), "id").limit(50).select("id", "entity_a", "entity_b")


@query("s12_list_synthetic_tags", "SELECT r_name AS tag, list_sort(list(n_name)) AS source_tags FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def _(s):
    n = s.table("nation").join(s.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy(F.col("r_name").alias("tag")).agg(F.sort_array(F.collect_list("n_name")).alias("source_tags"))


@query("s13_distinct_users", "SELECT DISTINCT user_id FROM memories")
def _(s):
    return s.memories.select("user_id").distinct()


@query("s14_pending", """SELECT id FROM memories WHERE invalid_at IS NULL AND json_extract_string(metadata, '$.pending_distillation') = 'true'
  AND (json_extract_string(metadata, '$._enrichment.next_attempt_at') IS NULL OR json_extract_string(metadata, '$._enrichment.next_attempt_at') <= '2024-06-01T00:00:00') ORDER BY created_at, seq LIMIT 8""")
def _(s):
    return s.memories.where(P.active() & P.pending(F.col("metadata"), "2024-06-01T00:00:00")).orderBy("created_at", "seq").limit(8).select("id")


BACKUP = """, m AS (SELECT * FROM memories WHERE user_id = 'src3'), t AS (SELECT * FROM memory_topics WHERE memory_id IN (SELECT id FROM m)), tp AS (SELECT * FROM topics WHERE id IN (SELECT topic_id FROM t)),
em AS (SELECT DISTINCT entity_id, memory_id FROM mentions WHERE memory_id IN (SELECT seq FROM m)), en AS (SELECT * FROM entities WHERE id IN (SELECT entity_id FROM em))
SELECT 'memories' AS name, count(*) AS n FROM m UNION ALL SELECT 'memory_topics', count(*) FROM t UNION ALL SELECT 'topics', count(*) FROM tp
UNION ALL SELECT 'topic_relations', count(*) FROM topic_relations WHERE narrower IN (SELECT id FROM tp) AND broader IN (SELECT id FROM tp)
UNION ALL SELECT 'memory_events', count(*) FROM memory_events WHERE memory_id IN (SELECT id FROM m) UNION ALL SELECT 'episodes', count(*) FROM episodes WHERE user_id = 'src3'
UNION ALL SELECT 'entities', count(*) FROM en UNION ALL SELECT 'entity_mentions', count(*) FROM em
UNION ALL SELECT 'entity_proposals', count(*) FROM proposals WHERE entity_a IN (SELECT id FROM en) AND entity_b IN (SELECT id FROM en)
UNION ALL SELECT 'relations', count(*) FROM relations WHERE CAST(substr(object, 2) AS BIGINT) IN (SELECT id FROM en) AND memory_id IN (SELECT seq FROM m)
UNION ALL SELECT 'synthetic_tags', count(*) FROM region WHERE r_name IN (SELECT name FROM tp)"""


@query("s18_backup_counts", BACKUP)
def _(s):
    from reverie.sources.backup import scoped_tables

    parts = scoped_tables(s, P.scoped(user_id="src3"))
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in parts.items()]
    return reduce(DataFrame.union, rows)


@query("s19_dangling", """, e AS (SELECT id FROM entities WHERE id % 5 <> 0), m AS (SELECT seq, id FROM memories WHERE seq % 3 <> 0),
em AS (SELECT DISTINCT entity_id, memory_id FROM mentions), out AS (SELECT 'entity_mentions' AS "table", 'entity_id' AS "column", count(*) AS n FROM em WHERE entity_id NOT IN (SELECT id FROM e)
UNION ALL SELECT 'entity_mentions', 'memory_key', count(*) FROM em WHERE memory_id NOT IN (SELECT seq FROM m) UNION ALL SELECT 'memory_topics', 'memory_id', count(*) FROM memory_topics WHERE memory_id NOT IN (SELECT id FROM m)
UNION ALL SELECT 'entity_proposals', 'entity_a', count(*) FROM proposals WHERE entity_a NOT IN (SELECT id FROM e) UNION ALL SELECT 'entity_proposals', 'entity_b', count(*) FROM proposals WHERE entity_b NOT IN (SELECT id FROM e)
UNION ALL SELECT 'relations', 'object_id', count(*) FROM relations WHERE CAST(substr(object, 2) AS BIGINT) NOT IN (SELECT id FROM e) UNION ALL SELECT 'relations', 'memory_key', count(*) FROM relations WHERE memory_id NOT IN (SELECT seq FROM m)
UNION ALL SELECT 'memory_events', 'memory_id', count(*) FROM memory_events WHERE memory_id NOT IN (SELECT id FROM m)) SELECT * FROM out WHERE n > 0""")
def _(s):
    """A backup that lost a fifth of its entities and a third of its memories."""
    from reverie.sources.backup import all_tables, dangling

    tables = all_tables(s)
    return dangling({**tables, "entities": tables["entities"].where("id % 5 <> 0"), "memories": tables["memories"].where("seq % 3 <> 0")})


@query("s19_all_fates", """, x AS (SELECT 'entities' AS "table", id % 4 = 0 AS conflict, id % 3 = 0 AS fresh FROM entities UNION ALL SELECT 'topics', false, id = 'r1' FROM topics UNION ALL SELECT 'entity_proposals', false, id % 6 = 0 FROM proposals)
SELECT "table", CASE WHEN fresh THEN 'insert' WHEN conflict THEN 'conflict' ELSE 'unchanged' END AS fate, count(*) AS n FROM x GROUP BY ALL""")
def _(s):
    from reverie.sources.backup import all_tables, fates

    tables = {k: v for k, v in all_tables(s).items() if k in ("entities", "topics", "entity_proposals")}
    changed = {**tables, "entities": tables["entities"].withColumn("description", F.when(F.col("id") % 4 == 0, F.lit("changed")).otherwise(F.col("description")))}
    stored = {"entities": tables["entities"].where("id % 3 <> 0"), "topics": tables["topics"].where("id <> 'r1'"), "entity_proposals": tables["entity_proposals"].where("id % 6 <> 0")}
    return fates(changed, stored)


@query("s19_import_fates", """, incoming AS (SELECT id, content, CASE WHEN seq % 10 = 0 THEN importance + 0.125 ELSE importance END AS importance FROM memories WHERE seq % 2 = 0),
stored AS (SELECT id, content, importance FROM memories WHERE seq % 3 = 0)
SELECT i.id, CASE WHEN s.id IS NULL THEN 'insert' WHEN i.content IS NOT DISTINCT FROM s.content AND i.importance IS NOT DISTINCT FROM s.importance THEN 'unchanged' ELSE 'conflict' END AS fate
FROM incoming i LEFT JOIN stored s ON i.id = s.id""")
def _(s):
    changed = F.when(F.col("seq") % 10 == 0, F.col("importance") + F.lit(0.125)).otherwise(F.col("importance"))
    incoming = s.memories.where("seq % 2 = 0").select("id", "content", changed.alias("importance"))
    return lifecycle.compared(incoming, s.memories.where("seq % 3 = 0").select("id", "content", "importance"))


IMPORTED = """, incoming AS (SELECT conv_id * 100 + turn AS place, text AS content, 'src' || (conv_id % 20) AS user_id, role || ', ,x' AS categories, CASE WHEN role = 'user' THEN 'Episodic ' ELSE role END AS memory_type,
  CASE WHEN turn % 2 = 0 THEN '1.5' ELSE 'high' END AS importance FROM conversations UNION ALL SELECT 100000000 + seq, content, user_id, 'a', 'semantic', '0.25' FROM memories WHERE seq % 10 = 1),
clean AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(trim(content)) ORDER BY place) AS r FROM incoming WHERE trim(coalesce(content, '')) <> '')
SELECT place, user_id, CASE WHEN lower(trim(memory_type)) IN ('semantic', 'episodic', 'procedural', 'working') THEN lower(trim(memory_type)) ELSE 'semantic' END AS memory_type,
  coalesce(try_cast(importance AS DOUBLE), 0.5::DOUBLE) AS importance, array_to_string(list_filter(list_transform(string_split(categories, ','), lambda c: trim(c)), lambda c: c <> ''), '|') AS categories
FROM clean c WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM memories m WHERE m.seq % 3 = 0 AND m.user_id = c.user_id AND lower(trim(m.content)) = lower(trim(c.content)))"""


def _incoming(s):
    c = s.table("conversations")
    a = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("place"), F.col("text").alias("content"), F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("user_id"), F.concat("role", F.lit(", ,x")).alias("categories"), F.when(F.col("role") == "user", "Episodic ").otherwise(F.col("role")).alias("memory_type"), F.when(F.col("turn") % 2 == 0, "1.5").otherwise("high").alias("importance"))
    b = s.memories.where("seq % 10 = 1").select((F.lit(100000000) + F.col("seq")).alias("place"), "content", "user_id", F.lit("a").alias("categories"), F.lit("semantic").alias("memory_type"), F.lit("0.25").alias("importance"))
    return a.union(b)


@query("s19_bundle", """SELECT 'entities' AS name, count(*) AS n, sum(id) AS total FROM entities UNION ALL SELECT 'topics', count(*), sum(length(name)) FROM topics UNION ALL SELECT 'vectors', count(*), CAST(sum(list_sum(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000000) AS BIGINT)))) AS BIGINT) FROM vectors""")
def _(s):
    """Tables of which the store has a part, from a bundle of all rows, vectors among them; all become visible together."""
    path = f"{graph.shared_folder(s.spark)}/bundle-{uuid.uuid4().hex}"
    whole = {"entities": s.entities, "topics": s.topics, "vectors": s.vectors}
    bundle.write_bundle(whole, f"{path}/bundle")
    store = bundle.TableSet.create({"entities": s.entities.where("id % 3 = 0"), "topics": s.topics.where("id <> 'r1'"), "vectors": s.vectors.where("id % 2 = 0")}, f"{path}/store")
    store.restore(bundle.read_bundle(s.spark, f"{path}/bundle"), {"entities": ("id",), "topics": ("id",), "vectors": ("id",)})
    now = store.tables()
    million = F.aggregate(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    totals = {"entities": F.sum("id"), "topics": F.sum(F.length("name")), "vectors": F.sum(million)}
    return reduce(DataFrame.union, [now[name].agg(F.count(F.lit(1)).alias("n"), total.cast("long").alias("total")).select(F.lit(name).alias("name"), "n", "total") for name, total in totals.items()])


@query("l12_reset", "SELECT unnest(['episodes', 'memories', 'memory_events', 'topics', 'memory_topics', 'topic_relations', 'entities', 'entity_mentions', 'entity_proposals']) AS name, 0 AS n UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'synthetic_tags', count(DISTINCT n_regionkey) FROM nation")
def _(s):
    """Every table's rows after a reset, which leaves two of them."""
    from reverie.sources.backup import all_tables, reset

    return reduce(DataFrame.union, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in reset(all_tables(s)).items()])


@query("s20_import_rows", IMPORTED)
def _(s):
    out = upkeep.imported(_incoming(s), s.memories.where("seq % 3 = 0").select("user_id", "content"))
    return out.select("place", "user_id", "memory_type", "importance", F.array_join("categories", "|").alias("categories"))


@query("s20_near_rows", ", v AS (SELECT id, tag, embedding::DOUBLE[] AS e FROM vectors) SELECT a.id AS place FROM v a WHERE a.id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM v b WHERE b.id % 2 = 0 AND b.tag = a.tag AND round(list_cosine_similarity(a.e, b.e), 9) >= 0.3)")
def _(s):
    """Vectors of odd ids come in, those of even ids are stored; none is kept that its tag has a like one of. These vectors don't reach 0.97."""
    user = F.col("tag").cast("string").alias("user_id")
    out = upkeep.apart_from_stored(s.vectors.where("id % 2 = 1").select(F.col("id").alias("place"), user, "embedding"), s.vectors.where("id % 2 = 0").select(user, "embedding"), 0.3)
    return out.select("place")


@query("d17_import_dedup", IMPORTED.split("SELECT place, user_id, CASE")[0] + "SELECT count(*) FILTER (WHERE r = 1) AS kept, count(*) FILTER (WHERE r > 1) AS repeated FROM clean")
def _(s):
    own = _incoming(s).where("trim(coalesce(content, '')) <> ''").groupBy("user_id", F.lower(F.trim("content")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return own.agg(F.count(F.lit(1)).alias("kept"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"))


@query("p1_scope", "SELECT count(*) AS n FROM memories WHERE user_id = 'src3' AND agent_id = 'en'")
def _(s):
    return s.memories.where(P.scoped(user_id="src3", agent_id="en")).agg(F.count(F.lit(1)).alias("n"))


@query("p2_active", "SELECT user_id, count(*) AS n FROM memories WHERE invalid_at IS NULL GROUP BY user_id")
def _(s):
    return s.memories.where(P.active()).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


UNDER = """, under AS (SELECT id, 0 AS depth FROM topics WHERE normalized IN ('asia', 'nation_2') UNION SELECT r.narrower, depth + 1 FROM under u JOIN topic_relations r ON r.broader = u.id WHERE depth < 8)
"""


@query("p3_topic_filter", UNDER + "SELECT id FROM memories m WHERE invalid_at IS NULL AND EXISTS (SELECT 1 FROM memory_topics t JOIN under u ON t.topic_id = u.id WHERE t.memory_id = m.id)")
def _(s):
    seeds = s.topics.where(F.col("normalized").isin("asia", "nation_2")).select("id")
    under = graph.closure(s.topic_relations, seeds, 9).select(F.col("id").alias("topic_id")).distinct()
    hit = s.memory_topics.join(under, "topic_id", "left_semi").select(F.col("memory_id").alias("id"))
    return s.memories.where(P.active()).join(hit, "id", "left_semi").select("id")


@query("p4_entity_filter", ROOTS + """, wanted AS (SELECT DISTINCT root FROM roots WHERE id IN (5, 10, 17, 23) AND root IS NOT NULL)
SELECT id FROM placed o WHERE EXISTS (SELECT 1 FROM mentions m JOIN roots r ON r.id = m.entity_id WHERE m.memory_id = o.id AND r.root IN (SELECT root FROM wanted))""")
def _(s):
    """Ids lead through merges to their survivors, and so do mentions; without a survivor nothing is found."""
    root = graph.kept(graph.roots(s.entities), "roots").where("root IS NOT NULL")
    wanted = root.where(F.col("id").isin(5, 10, 17, 23)).select("root").distinct()
    members = root.join(wanted, "root", "left_semi").select(F.col("id").alias("entity_id"))
    hit = s.mentions.join(members, "entity_id", "left_semi").select(F.col("memory_id").alias("id"))
    return s.orders.join(hit, "id", "left_semi").select("id")


@query("p5_date_window", "SELECT id FROM memories WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-22' + INTERVAL 1 DAY")
def _(s):
    return s.memories.where(P.within(F.col("created_at"), "2024-01-10", "2024-01-22")).select("id")


@query("p6_ownership", """, held AS (SELECT id, CASE seq % 5 WHEN 0 THEN user_id || '::' || seq % 3 WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN user_id || ':' ELSE user_id END AS holder FROM memories)
SELECT id, coalesce(starts_with(holder, 'src1::'), false) AS tenant, coalesce(holder = 'src1', false) AS exact, true AS any_owner, false AS nobody FROM held""")
def _(s):
    """Owners that are a tenant's prefix, a name, all, and the empty name, over rows some of which have no user or an empty one."""
    k, user = F.col("seq") % 5, F.col("user_id")
    holder = F.when(k == 0, F.concat(user, F.lit("::"), (F.col("seq") % 3).cast("string"))).when(k == 1, "").when(k == 3, F.concat(user, F.lit(":"))).when(k == 4, user)
    held = s.contents.withColumn("holder", holder)
    return held.select("id", *[P.owned(F.col("holder"), owner).alias(name) for name, owner in (("tenant", "src1::"), ("exact", "src1"), ("any_owner", None), ("nobody", ""))])


FORGOTTEN = """, cut AS (SELECT * FROM memories WHERE invalid_at IS NOT NULL AND coalesce(superseded_by, '') = '' ORDER BY updated_at DESC, seq LIMIT 30),
last AS (SELECT memory_id, max(struct_pack(c := created_at, i := id, a := actor)) AS e FROM memory_events WHERE event = 'DELETE' GROUP BY memory_id)
SELECT id, coalesce(e.a, 'system') AS actor FROM cut LEFT JOIN last ON id = memory_id"""


@query("p7_forgotten", FORGOTTEN)
def _(s):
    cut = s.memories.where("invalid_at IS NOT NULL AND coalesce(superseded_by, '') = ''").orderBy(F.desc("updated_at"), "seq").limit(30)
    last = lifecycle.latest_event(s.events, ("DELETE",)).select(F.col("memory_id").alias("id"), "last")
    out = cut.join(last, "id", "left").orderBy(F.desc("invalid_at"), "seq")
    return out.select("id", F.coalesce("last.actor", F.lit("system")).alias("actor"))


NAMES = """, names AS (SELECT id, CASE id % 11 WHEN 0 THEN '2019-04' WHEN 1 THEN 'July 2026' WHEN 2 THEN '192 GB' WHEN 3 THEN 'www.' || replace(name, ' ', '') || '.com' WHEN 4 THEN 'Dear Sir' WHEN 5 THEN '[name]' WHEN 6 THEN '   '
  WHEN 7 THEN '$149' WHEN 8 THEN 'a@b.org' ELSE name END AS name, entity_type FROM entities),
junk AS (SELECT *, CASE id % 11 WHEN 0 THEN 'date' WHEN 1 THEN 'date' WHEN 2 THEN 'amount' WHEN 3 THEN 'link' WHEN 4 THEN 'greeting' WHEN 5 THEN 'filler' WHEN 6 THEN 'empty' WHEN 7 THEN 'amount' WHEN 8 THEN 'link' END AS reason FROM names)
"""


def _names(s):
    cases = ["2019-04", "July 2026", "192 GB", None, "Dear Sir", "[name]", "   ", "$149", "a@b.org"]
    name = F.col("name")
    for i, c in enumerate(cases):
        name = F.when(F.col("id") % 11 == i, F.concat(F.lit("www."), F.translate("name", " ", ""), F.lit(".com")) if c is None else F.lit(c)).otherwise(name)
    return s.entities.select("id", name.alias("name"), "entity_type")


@query("p8_no_referent", NAMES + "SELECT id, reason FROM junk WHERE reason IS NOT NULL")
def _(s):
    return _names(s).select("id", text.no_referent(F.col("name")).alias("reason")).where("reason IS NOT NULL")


@query("d16_entity_junk", NAMES + "SELECT id, reason, entity_type IN ('ECONOMY', 'PROMO') AS reviewable FROM junk WHERE reason IS NOT NULL")
def _(s):
    return _names(s).select("id", text.no_referent(F.col("name")).alias("reason"), F.col("entity_type").isin("ECONOMY", "PROMO").alias("reviewable")).where("reason IS NOT NULL")


@query("p9_coercion", "SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'working' ELSE 'semantic' END AS memory_type, least(greatest(value / 50, 0::DOUBLE), 1::DOUBLE) AS importance FROM events")
def _(s):
    e = s.table("events")
    kind = F.when(F.col("event_type") == "view", " Working").otherwise(F.col("event_type"))
    return e.select(F.col("event_id").alias("id"), scoring.memory_type(kind).alias("memory_type"), scoring.importance((F.col("value") / 50).cast("string")).alias("importance"))


@query("p10_json_paths", "SELECT json_extract_string(metadata, '$._enrichment.status') AS status, count(*) AS n FROM memories WHERE json_extract_string(metadata, '$.pending_distillation') = 'true' GROUP BY 1")
def _(s):
    return s.memories.where(P.pending(F.col("metadata"))).groupBy(F.get_json_object("metadata", "$._enrichment.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_normal_forms", r"""SELECT id, md5(array_to_string(regexp_extract_all(replace(translate(lower(content), 'ς', 'σ'), 'ß', 'ss'), '[\p{L}\p{N}]+'), ' ')) AS restated, md5(trim(regexp_replace(lower(content), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS loosely FROM memories""")
def _(s):
    return s.contents.select("id", F.md5(text.restated(F.col("content")).cast("binary")).alias("restated"), F.md5(text.loosely(F.col("content")).cast("binary")).alias("loosely"))


@query("p12_due", "SELECT id, value < 20 OR created_at <= TIMESTAMP '2024-01-15' - INTERVAL 6 HOUR AS due FROM memory_events")
def _(s):
    stamp = F.when(F.col("value") < 20, F.when(F.col("value") < 10, "never")).otherwise(F.col("created_at").cast("string"))
    return s.events.select("id", P.due(stamp, F.expr("timestamp_ntz'2024-01-15 00:00:00'"), 6).alias("due"))


@query("k1_order_limit", "SELECT id, status FROM placed ORDER BY updated_at DESC, id LIMIT 25 OFFSET 10")
def _(s):
    return s.orders.orderBy(F.desc("updated_at"), "id").offset(10).limit(25).select("id", "status")


@query("k8_top_per_key", "SELECT entity_id, memory_id, CAST(place AS INT) AS place FROM (SELECT entity_id, memory_id, row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC, memory_id) AS place FROM (SELECT DISTINCT entity_id, memory_id FROM mentions) JOIN placed ON memory_id = id) WHERE place <= 3")
def _(s):
    links = s.mentions.select("entity_id", "memory_id").distinct().join(s.orders.select(F.col("id").alias("memory_id"), "updated_at"), "memory_id")
    return graph.per_key(links, "entity_id", [F.desc("updated_at"), F.col("memory_id")], 3).select("entity_id", "memory_id", "place")


@query("u4_shared_words", r""", a AS (SELECT seq, list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS w FROM memories)
SELECT x.seq AS id, CAST(len(list_intersect(x.w, y.w)) AS INT) AS shared FROM a x JOIN a y ON y.seq = x.seq + 1""")
def _(s):
    a = s.contents.select("seq", F.array_distinct(text.words(F.col("content"))).alias("w"))
    b = a.select((F.col("seq") - 1).alias("seq"), F.col("w").alias("v"))
    return a.join(b, "seq").select(F.col("seq").alias("id"), F.size(F.array_intersect("w", "v")).alias("shared"))


@query("u5_ordered_union", """SELECT user_id, array_to_string(list(tag ORDER BY first), ',') AS tags FROM (SELECT user_id, tag, min(seq * 10 + i) AS first FROM
  (SELECT user_id, seq, unnest(categories) AS tag, generate_subscripts(categories, 1) - 1 AS i FROM memories) GROUP BY ALL) GROUP BY user_id""")
def _(s):
    spread = s.memories.select("user_id", "seq", F.posexplode("categories").alias("i", "tag"))
    first = spread.groupBy("user_id", "tag").agg(F.min(F.col("seq") * 10 + F.col("i")).alias("first"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "tag"))), lambda x: x["tag"]), ",").alias("tags"))


@query("u6_difference", "SELECT id FROM memories WHERE id NOT IN (SELECT memory_id FROM memory_events)")
def _(s):
    return s.contents.select("id").join(s.events.select(F.col("memory_id").alias("id")), "id", "left_anti")


@query("l8_verbatim", "SELECT id, CASE WHEN role = 'user' THEN '' ELSE role || ': ' END || trim(content) AS content FROM episodes WHERE trim(coalesce(content, '')) <> ''")
def _(s):
    body = F.trim("content")
    return s.episodes.where(F.coalesce(body, F.lit("")) != "").select("id", F.when(F.col("role") == "user", body).otherwise(F.concat("role", F.lit(": "), body)).alias("content"))


@query("p14_public_row", "SELECT id, round(value, 4) AS score, (SELECT list_sort(list(DISTINCT entity_id)) FROM mentions WHERE memory_id = placed.id) AS entities FROM placed")
def _(s):
    links = s.mentions.groupBy("memory_id").agg(F.sort_array(F.collect_set(F.struct("entity_id", "surface"))).alias("entity_links"))
    public = s.orders.join(links.withColumnRenamed("memory_id", "id"), "id", "left").select(F.struct("id", F.round("value", 4).alias("score"), "entity_links").alias("row"))
    return public.select("row.id", "row.score", F.col("row.entity_links.entity_id").alias("entities"))


