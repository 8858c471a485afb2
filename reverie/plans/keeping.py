"""Clean-up of tags and entities, mutations and fading."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.functions import scoring, text
from reverie.operators import bulk_search, graph, lifecycle, reconciling, resolving, search, tagging, upkeep
from reverie.operators.text_index import TextIndex
from reverie.plans.counting import ROOTS, SPLIT, split_pairs
from reverie.plans.registry import query
from reverie.sources.store import NOW


def n_rows():
    return F.count(F.lit(1)).alias("n")

TAGS = r""", raw AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN p_name || 's' WHEN 2 THEN upper(p_name) WHEN 3 THEN replace(p_name, ' ', '_') || 's' ELSE p_name || ' series' END AS tag FROM part),
own AS (SELECT DISTINCT lower(trim(tag)) AS tag FROM raw), parts AS (SELECT tag, list_filter(regexp_split_to_array(tag, '[-_\s]+'), lambda w: w <> '') AS w FROM own),
keyed AS (SELECT tag, array_to_string(list_append(w[1:-2], CASE WHEN length(w[-1]) <= 3 OR w[-1] IN ('alias', 'atlas', 'bias', 'business', 'canvas', 'chaos', 'gas', 'mathematics', 'news', 'physics', 'series', 'species', 'status') THEN w[-1]
  WHEN ends_with(w[-1], 'ies') THEN w[-1][1:-4] || 'y' WHEN regexp_matches(w[-1], '(ch|sh|ss|x|z)es$') THEN w[-1][1:-3] WHEN regexp_matches(w[-1], 's$') AND NOT regexp_matches(w[-1], '(ss|us|is)$') THEN w[-1][1:-2] ELSE w[-1] END), ' ') AS key FROM parts),
best AS (SELECT key, min(struct_pack(o := tag <> key, m := length(tag) - length(replace(replace(tag, '-', ''), '_', '')), s := length(tag), tag := tag)) AS b FROM keyed GROUP BY key HAVING count(*) > 1),
merges AS (SELECT tag, b.tag AS canonical FROM keyed JOIN best USING (key))
"""


def _tags(s):
    name, k = F.col("p_name"), F.col("p_partkey") % 5
    tag = F.when(k == 0, F.translate(name, " ", "-")).when(k == 1, F.concat(name, F.lit("s"))).when(k == 2, F.upper(name)).when(k == 3, F.concat(F.translate(name, " ", "_"), F.lit("s"))).otherwise(F.concat(name, F.lit(" series")))
    return s.table("part").select("p_partkey", tag.alias("tag"))


@query("d1_obvious_tags", TAGS + "SELECT tag, canonical FROM merges")
def _(s):
    return upkeep.obvious_tags(_tags(s).select("tag"))


@query("d2_canonical_on_write", TAGS + ", tagged AS (SELECT p_partkey // 3 AS id, p_partkey % 3 AS place, lower(trim(CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN p_name || 's' WHEN 2 THEN upper(p_name) WHEN 3 THEN replace(p_name, ' ', '_') || 's' ELSE p_name || ' series' END)) AS tag FROM part) SELECT id, coalesce(canonical, tag) AS tag, min(place) AS place FROM tagged LEFT JOIN merges USING (tag) GROUP BY ALL")
def _(s):
    tagged = _tags(s).select(F.floor(F.col("p_partkey") / 3).alias("id"), (F.col("p_partkey") % 3).alias("place"), text.normal(F.col("tag")).alias("tag"))
    return upkeep.mapped_tags(tagged, upkeep.obvious_tags(_tags(s).select("tag")))


@query("d3_merged_topics", TAGS + """, spoken AS (SELECT p_partkey AS id, lower(trim(tag)) AS tag FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN p_name || 's' WHEN 2 THEN upper(p_name) WHEN 3 THEN replace(p_name, ' ', '_') || 's' ELSE p_name || ' series' END AS tag FROM part))
SELECT coalesce(canonical, tag) AS tag, count(DISTINCT id) AS n FROM spoken LEFT JOIN merges USING (tag) GROUP BY 1""")
def _(s):
    """The histogram of tags after the obvious ones were merged, on every memory that has them."""
    spoken = _tags(s).select(F.col("p_partkey").alias("id"), F.lit(0).alias("place"), text.normal(F.col("tag")).alias("tag"))
    moved = upkeep.mapped_tags(spoken, upkeep.obvious_tags(spoken.select("tag")))
    return moved.groupBy("tag").agg(F.countDistinct("id").alias("n"))


@query("d6_retag", "SELECT id, array_to_string(CASE WHEN invalid_at IS NULL AND list_has_any(categories, ['nation_3', 'nation_4']) THEN list_append(list_filter(categories, lambda c: c NOT IN ('nation_3', 'nation_4')), 'far') ELSE categories END, ',') AS tags FROM memories")
def _(s):
    return upkeep.retag(s.memories, ["nation_3", "nation_4"], "far").select("id", F.array_join("categories", ",").alias("tags"))


@query("d6_retag_relations", "SELECT DISTINCT CASE WHEN broader IN ('r1', 'r2') THEN 'r2' ELSE broader END AS broader, CASE WHEN narrower IN ('r1', 'n3') THEN 'r2' ELSE narrower END AS narrower FROM topic_relations WHERE CASE WHEN broader IN ('r1', 'r2') THEN 'r2' ELSE broader END <> CASE WHEN narrower IN ('r1', 'n3') THEN 'r2' ELSE narrower END")
def _(s):
    """r1 and n3 become r2: edges move along, those that close on themselves go."""
    return upkeep.retagged_relations(s.topic_relations.select("broader", "narrower"), ["r1", "n3"], "r2")


@query("d7_exact_restatements", r", k AS (SELECT seq, trim(regexp_replace(lower(content), '[^\p{L}\p{N}_]+', ' ', 'g')) AS key FROM memories) SELECT a.seq AS id FROM k a WHERE a.seq % 2 = 1 AND EXISTS (SELECT 1 FROM k b WHERE b.key = a.key AND b.seq % 2 = 0)")
def _(s):
    k = s.contents.select(F.col("seq").alias("id"), text.loosely(F.col("content")).alias("key"))
    return k.where("id % 2 = 1").join(k.where("id % 2 = 0").select("key"), "key", "left_semi").select("id")


DECISIONS = r""", k AS (SELECT *, trim(regexp_replace(lower(content), '[^\p{L}\p{N}_]+', ' ', 'g')) AS form FROM memories), old AS (SELECT * FROM k WHERE seq % 2 = 0), live AS (SELECT * FROM old WHERE invalid_at IS NULL),
known AS (SELECT user_id, form, arg_min(id, struct_pack(c := created_at, s := seq)) AS known FROM live GROUP BY ALL),
new AS (SELECT *, CASE seq % 8 WHEN 1 THEN 'add' WHEN 3 THEN 'UPDATE' WHEN 5 THEN 'delete' ELSE CASE WHEN seq % 3 = 0 THEN 'NONE' ELSE 'odd' END END AS asked, CASE WHEN seq % 8 IN (3, 5) THEN CAST(seq + 17 AS VARCHAR) END AS wanted FROM k WHERE seq % 2 = 1),
fate AS (SELECT n.id, n.seq, n.content, n.importance, n.user_id, CASE WHEN w.known IS NOT NULL OR asked = 'NONE' THEN 'NONE' WHEN upper(asked) IN ('UPDATE', 'DELETE') AND t.id IS NOT NULL THEN upper(asked) ELSE 'ADD' END AS action, w.known, t.id AS there
  FROM new n LEFT JOIN known w ON w.user_id = n.user_id AND w.form = n.form LEFT JOIN live t ON t.id = n.wanted AND t.user_id = n.user_id),
fates AS (SELECT id, seq, content, importance, action, CASE WHEN known IS NOT NULL THEN known WHEN action <> 'ADD' THEN there END AS target, CASE WHEN action = 'UPDATE' THEN CASE WHEN seq % 16 = 3 THEN 'refined ' || id ELSE content END END AS said FROM fate)
"""


def _fates(s):
    """Odd memories are new facts, even ones the store; decisions name a target some rows on, which may be of another user, gone or missing."""
    stored, new = s.memories.where("seq % 2 = 0"), s.memories.where("seq % 2 = 1").select("id", "seq", "content", "user_id", "importance")
    k = F.col("seq") % 8
    asked = F.when(k == 1, "add").when(k == 3, "UPDATE").when(k == 5, "delete").when(F.col("seq") % 3 == 0, "NONE").otherwise("odd")
    decisions = new.select("id", asked.alias("action"), F.when(k.isin(3, 5), (F.col("seq") + 17).cast("string")).alias("target"), F.when(F.col("seq") % 16 == 3, F.concat(F.lit("refined "), "id")).alias("new_content"))
    return stored, graph.kept(reconciling.decided(new, stored, decisions), "fates")


@query("d8_reconcile", DECISIONS + "SELECT id, action, target, md5(said) AS said FROM fates")
def _(s):
    return _fates(s)[1].select("id", "action", "target", F.md5(F.col("new_content").cast("binary")).alias("said"))


@query("d8_state", DECISIONS + """, up AS (SELECT target, arg_max(said, id) AS said, max(importance) AS importance FROM fates WHERE action = 'UPDATE' GROUP BY 1), gone AS (SELECT target, max(id) AS ender FROM fates WHERE action = 'DELETE' GROUP BY 1)
SELECT o.id, md5(coalesce(up.said, o.content)) AS content, greatest(o.importance, up.importance) AS importance, coalesce(ender, superseded_by) AS superseded_by, ender IS NULL AND invalid_at IS NULL AS active FROM old o LEFT JOIN up ON up.target = o.id LEFT JOIN gone ON gone.target = o.id
UNION ALL SELECT id, md5(content), importance, NULL, true FROM fates WHERE action IN ('ADD', 'DELETE')""")
def _(s):
    stored, fates = _fates(s)
    state = reconciling.state_after(stored, fates, F.expr(f"timestamp_ntz'{NOW}'"))
    return state.select("id", F.md5(F.col("content").cast("binary")).alias("content"), "importance", "superseded_by", F.col("invalid_at").isNull().alias("active"))


@query("d8_events", DECISIONS + """SELECT id AS memory_id, 'ADD' AS event, NULL AS old, md5(content) AS new FROM fates WHERE action IN ('ADD', 'DELETE')
UNION ALL SELECT target, CASE action WHEN 'UPDATE' THEN 'UPDATE' ELSE 'SUPERSEDE' END, md5(o.content), md5(coalesce(said, f.content)) FROM fates f JOIN old o ON o.id = f.target WHERE action IN ('UPDATE', 'DELETE')""")
def _(s):
    stored, fates = _fates(s)
    out = reconciling.events_of(fates, stored)
    return out.select("memory_id", "event", F.md5(F.col("old_content").cast("binary")).alias("old"), F.md5(F.col("new_content").cast("binary")).alias("new"))


WORDED = r"regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+')"
SIMILAR = rf""", asks AS (SELECT c.conv_id || '-' || c.turn AS query, c.conv_id * 1000 + c.turn AS seq, c.turn, 'src' || (c.conv_id % 20) AS scope, c.text AS content, v.embedding FROM conversations c LEFT JOIN (SELECT * FROM vectors WHERE embedding_model = 'main') v ON v.id = c.conv_id * 8 + c.turn),
toks AS (SELECT id, CASE WHEN invalid_at IS NULL THEN user_id END AS scope, {WORDED} AS w FROM memories), totals AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM toks),
terms AS (SELECT query, scope, term, count(*) AS times FROM (SELECT query, scope, unnest(list_slice({WORDED}, 1, 32)) AS term FROM asks) GROUP BY ALL),
post AS (SELECT id, scope, dl, term, count(*) AS tf FROM (SELECT id, scope, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY ALL), df AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY 1),
bm AS (SELECT query, id, sum(times * greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM terms JOIN post USING (scope, term) JOIN df USING (term), totals GROUP BY ALL),
bw AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) - 1 AS words FROM bm QUALIFY words < 15),
vs AS (SELECT query, m.id, list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(v.embedding, lambda x: x::DOUBLE)) AS score FROM asks a JOIN memories m ON m.user_id = a.scope AND m.invalid_at IS NULL JOIN vectors v ON v.id = m.seq AND v.embedding_model = 'main' WHERE a.embedding IS NOT NULL),
bv AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) - 1 AS vector FROM vs QUALIFY vector < 15),
fused AS (SELECT query, id, vector, words, coalesce(1.0::DOUBLE / (61 + vector), 0) + coalesce(1.0::DOUBLE / (61 + words), 0) AS s FROM bv FULL JOIN bw USING (query, id)),
scored AS (SELECT query, id, vector, words, 0.70::DOUBLE * s / max(s) OVER (PARTITION BY query) + 0.15::DOUBLE * pow(0.5::DOUBLE, greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 86400000000.0::DOUBLE / 30) + 0.15::DOUBLE * least(greatest(importance, 0), 1) AS score FROM fused JOIN memories USING (id)),
five AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vector NULLS LAST, words NULLS LAST, id) - 1 AS place, score FROM scored QUALIFY place < 5)
"""


def _asks(s):
    """Every turn of a conversation as a fact of one source's store, with a stored vector for its own where there is one."""
    c, v = s.table("conversations"), s.vectors.where("embedding_model = 'main'").select("id", "embedding")
    turns = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "turn", F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("scope"), F.col("text").alias("content"), (F.col("conv_id") * 8 + F.col("turn")).alias("id"))
    return turns.join(v, "id", "left").drop("id")


def _five(s):
    """The five memories of its store that are most alike to each turn."""
    live = F.when(F.col("invalid_at").isNull(), F.col("user_id"))
    index = TextIndex.create(s.spark, f"{graph.shared_folder(s.spark)}/texts-{uuid.uuid4().hex}")
    index.upsert(s.memories.select("id", "content", live.alias("scope")))
    vectors = s.vectors.where("embedding_model = 'main'").select(F.col("id").cast("string").alias("id"), "embedding")
    rows = s.memories.select("id", live.alias("scope"), "updated_at", "importance").join(vectors, "id", "left")
    asks = graph.kept(_asks(s), "asks")
    return asks, graph.kept(bulk_search.similar(index, rows, asks, F.expr(f"timestamp_ntz'{NOW}'")), "five")


@query("d8_candidates", SIMILAR + "SELECT query, id, place, round(score, 6) AS score FROM five")
def _(s):
    return _five(s)[1].select("query", "id", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


ACTIONS = SIMILAR + r""", known AS (SELECT f.query, arg_min(f.id, f.place) AS known FROM five f JOIN memories m ON m.id = f.id JOIN asks a ON a.query = f.query
  WHERE trim(regexp_replace(lower(m.content), '[^\p{L}\p{N}_]+', ' ', 'g')) = trim(regexp_replace(lower(a.content), '[^\p{L}\p{N}_]+', ' ', 'g')) GROUP BY 1),
wish AS (SELECT a.*, k.known, f.id AS wanted, CASE turn % 4 WHEN 0 THEN 'ADD' WHEN 2 THEN 'DELETE' ELSE 'UPDATE' END AS asked FROM asks a LEFT JOIN known k USING (query) LEFT JOIN five f ON f.query = a.query AND f.place = CASE turn % 4 WHEN 2 THEN 1 ELSE 0 END),
act AS (SELECT *, CASE WHEN known IS NOT NULL THEN 'NONE' WHEN asked <> 'ADD' AND wanted IS NOT NULL THEN asked ELSE 'ADD' END AS first_action FROM wish),
taken AS (SELECT wanted, min(seq) AS taker FROM act WHERE first_action IN ('UPDATE', 'DELETE') GROUP BY 1),
fates AS (SELECT query AS id, content, turn % 5 / 4.0::DOUBLE AS importance, CASE WHEN first_action IN ('UPDATE', 'DELETE') AND seq > taker THEN 'ADD' ELSE first_action END AS action, known, a.wanted, CASE WHEN turn % 4 = 3 THEN 'said ' || query ELSE content END AS said FROM act a LEFT JOIN taken USING (wanted)),
done AS (SELECT id, content, importance, action, CASE WHEN known IS NOT NULL THEN known WHEN action <> 'ADD' THEN wanted END AS target, CASE WHEN action = 'UPDATE' THEN said END AS said FROM fates)
"""


def _acted(s):
    """Turns update, end or add to what their search found; several may want one memory."""
    asks, five = _five(s)
    facts = asks.select(F.col("query").alias("id"), "seq", "content", F.col("scope").alias("user_id"), (F.col("turn") % 5 / 4.0).alias("importance"))
    kind = F.col("turn") % 4
    aimed = F.when(kind == 2, 1).otherwise(0)
    wished = asks.join(five.select("query", "place", F.col("id").alias("target")), ["query"], "left").where(F.col("place").isNull() | (F.col("place") == aimed)).select("query", "target")
    said = F.when(kind == 3, F.concat(F.lit("said "), "query"))
    decisions = asks.join(wished, "query", "left").select(F.col("query").alias("id"), F.when(kind == 0, "ADD").when(kind == 2, "DELETE").otherwise("UPDATE").alias("action"), "target", said.alias("new_content"))
    return graph.kept(reconciling.decided(facts, s.memories, decisions, five, "seq"), "acted")


@query("l7_actions", ACTIONS + "SELECT id, action, target, md5(said) AS said FROM done")
def _(s):
    return _acted(s).select("id", "action", "target", F.md5(F.col("new_content").cast("binary")).alias("said"))


@query("l7_state", ACTIONS + """, up AS (SELECT target, said, importance FROM done WHERE action = 'UPDATE'), gone AS (SELECT target, id AS ender FROM done WHERE action = 'DELETE')
SELECT m.id, md5(coalesce(up.said, m.content)) AS content, greatest(m.importance, up.importance) AS importance, coalesce(ender, superseded_by) AS superseded_by, ender IS NULL AND invalid_at IS NULL AS active FROM memories m LEFT JOIN up ON up.target = m.id LEFT JOIN gone ON gone.target = m.id
UNION ALL SELECT id, md5(content), importance, NULL, true FROM done WHERE action IN ('ADD', 'DELETE')""")
def _(s):
    """All memories after the turns' facts."""
    state = reconciling.state_after(s.memories, _acted(s), F.expr(f"timestamp_ntz'{NOW}'"))
    return state.select("id", F.md5(F.col("content").cast("binary")).alias("content"), "importance", "superseded_by", F.col("invalid_at").isNull().alias("active"))


GROUPS = """, pairs AS (SELECT a.id AS a, b.id AS b FROM vectors a JOIN vectors b ON a.id < b.id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.42),
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS node, a AS low FROM e UNION SELECT e.b, low FROM reach JOIN e ON e.a = reach.node),
comp AS (SELECT node, min(low) AS component FROM reach GROUP BY node), sized AS (SELECT component, count(*) AS size FROM comp GROUP BY 1)
"""


def _groups(s, most=6):
    """Groups of all vectors; the least similarity is lower than a store's 0.90, which these vectors don't reach."""
    return upkeep.groups_of(search.similarity_pairs(s.vectors, 0.42, links_only=True).select("a", "b"), most)


@query("v4_similarity_groups", GROUPS + "SELECT node, component, size FROM comp JOIN sized USING (component) WHERE size BETWEEN 2 AND 6")
def _(s):
    return _groups(s)


@query("k6_groups_by_size", GROUPS + "SELECT component, size FROM sized WHERE size BETWEEN 2 AND 6 ORDER BY size DESC, component LIMIT 5")
def _(s):
    return _groups(s).select("component", "size").distinct().orderBy(F.desc("size"), "component").limit(5)


@query("v5_split_tags", SPLIT + "SELECT canonical, variant, similarity FROM split ORDER BY similarity DESC, 1, 2 LIMIT 20")
def _(s):
    return split_pairs(s, 20)


@query("k7_pairs_top", SPLIT + "SELECT canonical, variant FROM split ORDER BY similarity DESC, 1, 2 LIMIT 3")
def _(s):
    return split_pairs(s, 3).select("canonical", "variant")


@query("d5_suggested_merges", TAGS + SPLIT + """, sure AS (SELECT canonical, tag AS variant FROM merges WHERE tag <> canonical), near AS (SELECT CAST(canonical AS VARCHAR) AS canonical, CAST(variant AS VARCHAR) AS variant FROM (SELECT * FROM split ORDER BY similarity DESC, canonical, variant LIMIT 20))
SELECT * FROM sure UNION ALL SELECT canonical, variant FROM near WHERE variant NOT IN (SELECT variant FROM sure) AND canonical NOT IN (SELECT variant FROM sure)""")
def _(s):
    sure = upkeep.obvious_tags(_tags(s).select("tag")).where("tag <> canonical").select("canonical", F.col("tag").alias("variant"))
    near = split_pairs(s, 20).select(F.col("canonical").cast("string").alias("canonical"), F.col("variant").cast("string").alias("variant"))
    taken = sure.select("variant")
    free = near.join(taken, "variant", "left_anti").join(taken.withColumnRenamed("variant", "canonical"), "canonical", "left_anti")
    return sure.unionByName(free)


@query("d9_consolidate", GROUPS + r""", g AS (SELECT m.*, component AS k, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM comp JOIN sized USING (component) JOIN memories m ON m.seq = node WHERE size BETWEEN 2 AND 6 AND invalid_at IS NULL),
chosen AS (SELECT k FROM g GROUP BY k HAVING count(*) >= 2 ORDER BY count(*) DESC, k LIMIT 25)
SELECT k, count(*) AS n, count(DISTINCT array_to_string(w, ' ')) = 1 AS same, max(importance) AS importance, arg_min(memory_type, struct_pack(c := created_at, s := seq)) AS memory_type, arg_max(seq, struct_pack(i := importance, l := length(content), m := -epoch_us(created_at), s := -seq)) AS speaker,
  list_sort(list(id)) AS originals FROM g WHERE k IN (SELECT k FROM chosen) GROUP BY k""")
def _(s):
    """The first 25 groups of active similar memories, as one row would replace each; only those of one wording merge without a judge."""
    groups = graph.kept(_groups(s).select(F.col("node").alias("seq"), F.col("component").alias("k")), "groups")
    live = graph.kept(s.memories.where("invalid_at IS NULL").select("seq").join(groups, "seq"), "live")
    chosen = live.groupBy("k").agg(n_rows()).where("n >= 2").orderBy(F.desc("n"), "k").limit(25).select("k")
    ids = [r["seq"] for r in live.join(chosen, "k", "left_semi").select("seq").collect()]  # 25 groups of six at most
    own = s.memories.where(F.col("seq").isin(ids) & F.col("invalid_at").isNull()).join(groups, "seq")
    return upkeep.consolidated(own, "k").select("k", "n", "same", "importance", "memory_type", "speaker", "originals")


STOPPED = ", ".join(f"'{w}'" for w in text.CONTEXT_STOPWORDS)


def context_sql(facts: str, name: str) -> str:
    """The distinct stems of the telling words of facts, in SQL."""
    words = lambda c: rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+')"
    cut = lambda n: f"left(w, length(w) - {n})"
    stem = f"""CASE WHEN length(w) > 6 AND ends_with(w, 'ing') THEN CASE WHEN right({cut(3)}, 1) = right({cut(4)}, 1) THEN {cut(4)} ELSE {cut(3)} END WHEN length(w) > 5 AND ends_with(w, 'ied') THEN {cut(3)} || 'y'
      WHEN length(w) > 5 AND ends_with(w, 'ed') THEN {cut(2)} WHEN length(w) > 5 AND ends_with(w, 'ies') THEN {cut(3)} || 'y' WHEN length(w) > 4 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') AND NOT ends_with(w, 'us') THEN {cut(1)} ELSE w END"""
    told = f"list_filter({words(facts)}, lambda w: w NOT IN ({STOPPED}) AND length(w) >= 3 AND NOT list_contains({words(name)}, w))"
    return f"list_distinct(list_filter(list_transform({told}, lambda w: {stem}), lambda w: length(w) >= 3 AND w NOT IN ({STOPPED})))"


#: Entities of one name, the anchor with each other one, and what the latest eight memories say of either; every third has no facts.
FACTS = """, said AS (SELECT entity_id, m.content, row_number() OVER (PARTITION BY entity_id ORDER BY m.updated_at DESC, m.seq) AS r FROM (SELECT DISTINCT entity_id, memory_id FROM mentions) x JOIN memories m ON m.seq = x.memory_id),
facts AS (SELECT entity_id AS id, string_agg(content, ' / ' ORDER BY r) AS facts FROM said WHERE r <= 8 GROUP BY 1),
full_ AS (SELECT e.id, e.name, e.normalized, CASE WHEN e.id % 2 = 0 THEN e.entity_type END AS kind, e.description, e.updated, CASE WHEN e.id % 3 <> 0 THEN f.facts END AS facts FROM entities e LEFT JOIN facts f USING (id) WHERE merged_into IS NULL),
anchored AS (SELECT *, first_value(id) OVER (PARTITION BY normalized ORDER BY updated DESC, id) AS anchor FROM full_),
two AS (SELECT a.id, a.name, a.kind, a.facts, a.description, b.id AS other, b.name AS name2, b.kind AS kind2, b.facts AS facts2, """ + context_sql("a.facts", "a.name") + " AS x, " + context_sql("b.facts", "b.name") + """ AS y FROM full_ a JOIN anchored b ON b.anchor = a.id AND b.id <> a.id),
met AS (SELECT *, list_intersect(x, y) AS z FROM two)
"""


def _facts(s):
    facts = resolving.facts_of(s.mentions, s.texts, 8)
    known = s.entities.where("merged_into IS NULL").join(facts, "id", "left")
    return known.withColumns({"entity_type": F.when(F.col("id") % 2 == 0, F.col("entity_type")), "facts": F.when(F.col("id") % 3 != 0, F.col("facts"))})


def _fact_pairs(s):
    """Each name's latest entity with its others, so that a name of many entities gives as many pairs and not their square."""
    known = graph.kept(_facts(s), "facts")
    anchor = F.first("id").over(W.partitionBy("normalized").orderBy(F.desc("updated"), "id"))
    pairs = known.select(F.col("id").alias("other"), anchor.alias("id")).where("id <> other")
    side = known.select("id", "name", F.col("entity_type").alias("kind"), "facts", "description")
    two = known.select(F.col("id").alias("other"), F.col("name").alias("name2"), F.col("entity_type").alias("kind2"), F.col("facts").alias("facts2"))
    return pairs.join(side, "id").join(two, "other")


@query("d10_same_entity", FACTS + r"""SELECT id, other, len(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')) >= 2 AND coalesce(kind = kind2, true) AND (len(z) >= 2 OR (len(z) = 1 AND length(z[1]) >= 6 AND len(z) / greatest(least(len(x), len(y)), 1) >= 0.12)) AS same FROM met""")
def _(s):
    p = _fact_pairs(s)
    return p.select("id", "other", upkeep.same_entity(F.col("name"), F.col("name2"), F.col("kind"), F.col("kind2"), F.col("facts"), F.col("facts2")).alias("same"))


@query("d11_no_evidence", FACTS + "SELECT id, other, coalesce(kind = kind2, true) AND coalesce(facts, '') = '' AND trim(coalesce(description, '')) = '' AS same FROM met")
def _(s):
    p = _fact_pairs(s)
    return p.select("id", "other", upkeep.no_evidence(F.col("name"), F.col("name2"), F.col("kind"), F.col("kind2"), F.col("facts"), F.col("description")).alias("same"))


SEEN = ROOTS + FACTS + r""", seen AS (SELECT DISTINCT x.memory_id, lower(trim(e.name)) AS name, e.name AS surface, CASE WHEN e.id % 2 = 0 THEN e.entity_type END AS kind, m.content FROM mentions x JOIN entities e ON e.id = x.entity_id JOIN memories m ON m.seq = x.memory_id WHERE e.merged_into IS NULL),
named AS (SELECT x.name, x.id, l.updated FROM (SELECT normalized AS name, id FROM entities WHERE merged_into IS NULL UNION SELECT lower(trim(surface)), entity_id FROM mentions UNION SELECT e.normalized, r.root FROM entities e JOIN roots r USING (id) WHERE e.merged_into IS NOT NULL) x JOIN (SELECT id, updated FROM entities WHERE merged_into IS NULL) l USING (id)),
asked AS (SELECT s.*, n.id, n.updated, f.name AS fname, f.kind AS kind1, f.facts, f.description FROM seen s JOIN named n USING (name) JOIN full_ f ON f.id = n.id),
judged AS (SELECT *, lower(trim(fname)) = name AND coalesce(kind1 = kind, true) AND coalesce(facts, '') = '' AND trim(coalesce(description, '')) = '' AS bare, """ + context_sql("facts", "fname") + " AS x, " + context_sql("content", "surface") + r""" AS y FROM asked),
verdicts AS (SELECT *, bare OR (len(regexp_extract_all(lower(fname), '[\p{L}\p{N}]+')) >= 2 AND regexp_extract_all(lower(fname), '[\p{L}\p{N}]+') = regexp_extract_all(lower(surface), '[\p{L}\p{N}]+') AND coalesce(kind1 = kind, true) AND (len(list_intersect(x, y)) >= 2 OR (len(list_intersect(x, y)) = 1 AND length(list_intersect(x, y)[1]) >= 6 AND 1 / greatest(least(len(x), len(y)), 1) >= 0.12))) AS taken FROM judged)
"""


@query("d12_resolve_mentions", SEEN + "SELECT memory_id, name, arg_max(id, struct_pack(u := updated, i := -id)) FILTER (WHERE taken) AS entity_id, NOT bool_or(taken) AS is_new, CASE WHEN bool_or(taken) THEN 0 ELSE count(DISTINCT id) END AS proposed FROM verdicts GROUP BY memory_id, name")
def _(s):
    """Names of all living entities, as if the memories that mention them were read anew; of every second one the type is unknown."""
    live = s.entities.where("merged_into IS NULL").select(F.col("id").alias("entity_id"), F.col("name").alias("surface"), F.when(F.col("id") % 2 == 0, F.col("entity_type")).alias("entity_type"), text.normal(F.col("name")).alias("n"))
    seen = s.mentions.select("entity_id", "memory_id").distinct().join(live, "entity_id").select("memory_id", F.struct(F.col("n").alias("name"), "surface", "entity_type").alias("m"))
    own = seen.groupBy("memory_id").agg(F.collect_set("m").alias("mentioned")).join(s.texts.select("memory_id", "content"), "memory_id")  # what one memory mentions
    entities = s.entities.withColumn("entity_type", F.when(F.col("id") % 2 == 0, F.col("entity_type")))
    found = resolving.resolved_mentions(own, entities, s.mentions, graph.roots(s.entities), _facts(s).select("id", "facts"))
    return found.select("memory_id", "name", "entity_id", "is_new", F.size("proposed").cast("long").alias("proposed"))


@query("d12_new_names")
def _(s):
    """Brands as names that no entity has yet: which memories' mentions make entities, join them, or make ones that may be twins."""
    brands = s.table("part").select(F.col("p_partkey").alias("entity_id"), F.regexp_replace("p_brand", "#", " ").alias("surface"), F.element_at(F.split("p_type", " "), -1).alias("entity_type"))
    seen = s.mentions.select("entity_id", "memory_id").distinct().join(brands, "entity_id")
    each = seen.groupBy("memory_id", text.normal(F.col("surface")).alias("name")).agg(F.min("surface").alias("surface"), F.min("entity_type").alias("entity_type"))
    mentioned = each.groupBy("memory_id").agg(F.collect_list(F.struct("name", "surface", "entity_type")).alias("mentioned"))  # 25 brands
    return resolving.settled_names(mentioned.join(s.texts.select("memory_id", "content"), "memory_id"))


SAME = """, live AS (SELECT id, first_value(id) OVER (PARTITION BY normalized ORDER BY updated DESC, id) AS anchor FROM entities WHERE merged_into IS NULL),
new AS (SELECT least(id, anchor) AS low, greatest(id, anchor) AS high FROM live WHERE id <> anchor EXCEPT SELECT least(entity_a, entity_b), greatest(entity_a, entity_b) FROM proposals)
"""


@query("d13_same_name_pairs", SAME + "SELECT low, high FROM new ORDER BY 1, 2 LIMIT 50")
def _(s):
    return upkeep.same_name_pairs(s.entities, s.proposals)


OPEN = ROOTS + FACTS + r""", asked AS (SELECT p.id, a.root AS ra, b.root AS rb FROM (SELECT * FROM proposals WHERE status = 'proposed' UNION ALL SELECT 1000000 + id, id, anchor, 0, 'proposed', 0 FROM anchored WHERE id <> anchor) p LEFT JOIN roots a ON a.id = p.entity_a LEFT JOIN roots b ON b.id = p.entity_b),
ends AS (SELECT q.*, a.name, a.kind, a.facts, a.description, b.name AS name2, b.kind AS kind2, b.facts AS facts2, b.description AS description2, """ + context_sql("a.facts", "a.name") + " AS x, " + context_sql("b.facts", "b.name") + r""" AS y FROM asked q LEFT JOIN full_ a ON a.id = ra LEFT JOIN full_ b ON b.id = rb),
told AS (SELECT *, lower(trim(name)) = lower(trim(name2)) AND coalesce(kind = kind2, true) AND ((coalesce(facts, '') = '' AND trim(coalesce(description, '')) = '') OR (coalesce(facts2, '') = '' AND trim(coalesce(description2, '')) = '')) AS bare, list_intersect(x, y) AS z, regexp_extract_all(lower(name), '[\p{L}\p{N}]+') AS n1, regexp_extract_all(lower(name2), '[\p{L}\p{N}]+') AS n2 FROM ends),
settled AS (SELECT *, CASE WHEN ra IS NULL OR rb IS NULL THEN 'rejected' WHEN ra = rb THEN 'confirmed' WHEN bare THEN 'merged' WHEN len(n1) >= 2 AND n1 = n2 AND coalesce(kind = kind2, true) AND (len(z) >= 2 OR (len(z) = 1 AND length(z[1]) >= 6 AND 1 / greatest(least(len(x), len(y)), 1) >= 0.12)) THEN 'merged' ELSE 'kept' END AS fate,
  NOT coalesce(bare, false) OR coalesce(facts, '') <> '' OR coalesce(facts2, '') = '' AS first FROM told)
"""


def _asked(s):
    """Proposals, and a new one for each entity that shares its name with a later one."""
    live = s.entities.where("merged_into IS NULL")
    anchor = F.first("id").over(W.partitionBy("normalized").orderBy(F.desc("updated"), "id"))
    new = live.select("id", anchor.alias("anchor")).where("id <> anchor").select((F.col("id") + 1000000).alias("id"), F.col("id").alias("entity_a"), F.col("anchor").alias("entity_b"), F.lit("proposed").alias("status"))
    return s.proposals.select("id", "entity_a", "entity_b", "status").union(new)


def _half_typed(s):
    return s.entities.withColumn("entity_type", F.when(F.col("id") % 2 == 0, F.col("entity_type")))


def _open(s):
    return resolving.open_proposals(_half_typed(s), _asked(s), _facts(s).select("id", "facts"))


@query("d14_open_proposals", OPEN + "SELECT id, fate, CASE WHEN first THEN ra ELSE rb END AS keep, CASE WHEN first THEN rb ELSE ra END AS merge FROM settled")
def _(s):
    return _open(s).select("id", "fate", "keep", "merge")


@query("d15_resolve_entities", OPEN + """, pairs AS (SELECT least(id, anchor) AS low, greatest(id, anchor) AS high FROM anchored WHERE id <> anchor EXCEPT SELECT least(entity_a, entity_b), greatest(entity_a, entity_b) FROM proposals)
SELECT 'proposed' AS step, count(*) AS n FROM pairs UNION ALL SELECT fate, count(*) FROM settled GROUP BY 1
UNION ALL SELECT 'orphans', count(*) FROM entities e WHERE id NOT IN (SELECT entity_id FROM mentions) AND 'p' || id NOT IN (SELECT object FROM relations) AND id NOT IN (SELECT merged_into FROM entities WHERE merged_into IS NOT NULL)
UNION ALL SELECT 'no referent', 0""")
def _(s):
    """The steps of a whole clean-up: new pairs, the fates of open proposals, orphans, names that can be no entity."""
    count = lambda df, name: df.agg(n_rows()).select(F.lit(name).alias("step"), "n")
    pairs = count(upkeep.same_name_pairs(s.entities, s.proposals, None), "proposed")
    settled = _open(s).groupBy(F.col("fate").alias("step")).agg(n_rows())
    ends = s.relations.select(F.expr("CAST(substring(object, 2) AS BIGINT)").alias("id"))
    lost = upkeep.orphans(s.entities.select("id"), s.mentions.select(F.col("entity_id").alias("id")), ends, s.entities.where("merged_into IS NOT NULL").select(F.col("merged_into").alias("id")))
    return pairs.union(settled).union(count(lost, "orphans")).union(count(s.entities.where(text.no_referent(F.col("name")).isNotNull()), "no referent"))


CLEANED = OPEN.replace("asked AS (SELECT p.id", "junk AS (SELECT id FROM entities WHERE id % 97 = 5), asked AS (SELECT p.id").replace("a.name, a.kind", "CASE WHEN a.id % 97 = 5 THEN '$' || a.id ELSE a.name END AS name, a.kind").replace("b.name AS name2", "CASE WHEN b.id % 97 = 5 THEN '$' || b.id ELSE b.name END AS name2") + """, mrg AS (SELECT CASE WHEN first THEN ra ELSE rb END AS keep, CASE WHEN first THEN rb ELSE ra END AS lose FROM settled WHERE fate = 'merged' AND ra <> rb),
e2 AS (SELECT keep AS a, lose AS b FROM mrg UNION SELECT lose, keep FROM mrg), walk2 AS (SELECT a AS node, a AS low FROM e2 UNION SELECT e2.b, low FROM walk2 JOIN e2 ON e2.a = walk2.node),
comp AS (SELECT node, min(low) AS low FROM walk2 GROUP BY 1), lost AS (SELECT DISTINCT lose FROM mrg),
stays AS (SELECT low, arg_min(node, CASE WHEN lose IS NULL THEN 0 ELSE 1000000000 END + node) AS root FROM comp LEFT JOIN lost ON lose = node GROUP BY 1),
moved AS (SELECT node AS id, root FROM comp JOIN stays USING (low) WHERE node <> root),
people AS (SELECT e.id, coalesce(m.root, e.merged_into) AS merged_into, m.root IS NOT NULL OR e.id IN (SELECT root FROM moved) AS stale FROM entities e LEFT JOIN moved m USING (id)),
said2 AS (SELECT coalesce(root, entity_id) AS entity_id, memory_id, surface FROM mentions LEFT JOIN moved ON moved.id = entity_id WHERE entity_id % 11 NOT IN (2, 3)),
rel2 AS (SELECT subject, coalesce('p' || root, object) AS object, invalid_at IS NULL AS active FROM relations LEFT JOIN moved ON 'p' || moved.id = object WHERE CAST(substr(object, 2) AS BIGINT) % 11 <> 3),
prop2 AS (SELECT p.id, coalesce(a.root, entity_a) AS x, coalesce(b.root, entity_b) AS y, CASE WHEN fate = 'rejected' THEN 'rejected' WHEN fate IN ('confirmed', 'merged') THEN 'confirmed' ELSE status END AS status
  FROM (SELECT id, entity_a, entity_b, status FROM proposals UNION ALL SELECT 1000000 + id, id, anchor, 'proposed' FROM anchored WHERE id <> anchor) p LEFT JOIN settled t ON t.id = p.id LEFT JOIN moved a ON a.id = entity_a LEFT JOIN moved b ON b.id = entity_b),
bare_ AS (SELECT id FROM people WHERE merged_into IS NULL AND (id IN (SELECT id FROM junk) OR (id NOT IN (SELECT entity_id FROM said2) AND 'p' || id NOT IN (SELECT object FROM rel2) AND id NOT IN (SELECT merged_into FROM people WHERE merged_into IS NOT NULL)))),
gone AS (SELECT id FROM bare_ UNION SELECT id FROM people WHERE merged_into IN (SELECT id FROM bare_))
SELECT 'entities' AS name, CAST(id AS VARCHAR) AS key, coalesce(CAST(merged_into AS VARCHAR), '-') || ' ' || stale AS value FROM people WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'mentions', CAST(entity_id AS VARCHAR), memory_id || ' ' || surface FROM said2 WHERE entity_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'relations', subject, object || ' ' || active FROM rel2 WHERE object NOT IN (SELECT 'p' || id FROM bare_)
UNION ALL SELECT 'proposals', CAST(id AS VARCHAR), CASE WHEN x = y AND status = 'proposed' THEN 'confirmed' ELSE status END || ' ' || x || ' ' || y FROM prop2 WHERE x NOT IN (SELECT id FROM gone) AND y NOT IN (SELECT id FROM gone)"""


@query("d15_cleaned_tables", CLEANED)
def _(s):
    """All rows of the four tables after the clean-up; some entities have sums of money for names, and of others the memories and relations are gone."""
    end = lambda c: F.concat(F.lit("p"), c.cast("string"))
    entities = _half_typed(s).withColumn("name", F.when(F.col("id") % 97 == 5, F.concat(F.lit("$"), F.col("id").cast("string"))).otherwise(F.col("name")))
    mentions = s.mentions.where(~(F.col("entity_id") % 11).isin(2, 3))
    edges = s.relations.where(F.expr("CAST(substring(object, 2) AS BIGINT) % 11 <> 3"))
    new = resolving.cleaned(entities, mentions, edges, _asked(s), _facts(s).select("id", "facts"), end, F.expr(f"timestamp_ntz'{NOW}'"))
    text_of = lambda c: F.col(c).cast("string")
    shown = {
        "entities": (text_of("id"), F.concat_ws(" ", F.coalesce(text_of("merged_into"), F.lit("-")), text_of("stale"))),
        "mentions": (text_of("entity_id"), F.concat_ws(" ", text_of("memory_id"), "surface")),
        "relations": (F.col("subject"), F.concat_ws(" ", "object", F.col("invalid_at").isNull().cast("string"))),
        "proposals": (text_of("id"), F.concat_ws(" ", "status", text_of("entity_a"), text_of("entity_b"))),
    }
    return reduce(DataFrame.union, [new[name].select(F.lit(name).alias("name"), key.alias("key"), value.alias("value")) for name, (key, value) in shown.items()])


TAGGED = """, known AS (SELECT DISTINCT user_id, lower(trim(tag)) AS tag FROM (SELECT agent_id AS user_id, unnest(categories) AS tag FROM memories WHERE invalid_at IS NULL)),
users AS (SELECT user_id, ascii(user_id) AS u, count(*) AS n FROM known GROUP BY 1), already AS (SELECT user_id, unnest(['old', 'nation_5']) AS tag FROM users WHERE u % 2 = 0),
reply AS (SELECT user_id, n, p, lower(trim(['nation_2', ' Trade ', 'trade', '', 'Old', 'Sea', 'LAND', 'air', 'far', 'Far '][p + 1])) AS tag, q, 'nation_' || (u * 7 + p * 3 + q * q) % 30 AS m FROM users, range(10) t(p), range(5) s(q) WHERE q <= p % 4 + 1)
"""


def _tagged(s):
    """Tags of each agent, parents that some have, and the ten groups that a reply proposes to each."""
    tags = s.memories.where("invalid_at IS NULL").select(F.col("agent_id").alias("user_id"), F.explode("categories").alias("tag"))
    users = tags.select("user_id").distinct().withColumn("u", F.ascii("user_id").cast("long"))
    already = users.where("u % 2 = 0").select("user_id", F.explode(F.array(F.lit("old"), F.lit("nation_5"))).alias("tag"))
    names = F.array(*map(F.lit, ("nation_2", " Trade ", "trade", "", "Old", "Sea", "LAND", "air", "far", "Far ")))
    member = lambda q: F.concat(F.lit(" Nation_"), ((F.col("u") * 7 + F.col("pos") * 3 + q * q) % 30).cast("string"))
    groups = users.select("user_id", "u", F.posexplode(names).alias("pos", "tag")).withColumn("members", F.transform(F.sequence(F.lit(0), F.col("pos") % 4 + 1), member))
    return tags, already, groups


@query("d18_abstract_tags", TAGGED + """, ok AS (SELECT user_id, p, tag, m, min(q) AS q FROM reply WHERE n >= 6 AND tag <> '' AND (user_id, tag) NOT IN (SELECT (user_id, tag) FROM known UNION SELECT (user_id, tag) FROM already) AND (user_id, m) IN (SELECT (user_id, tag) FROM known) AND (user_id, m) NOT IN (SELECT (user_id, tag) FROM already) GROUP BY ALL),
grouped AS (SELECT user_id, p, tag, string_agg(m, '|' ORDER BY q) AS members FROM ok GROUP BY ALL HAVING count(*) >= 2), firsts AS (SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY user_id, tag ORDER BY p) = 1)
SELECT user_id, tag, members FROM firsts QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p) <= 5""")
def _(s):
    tags, already, groups = _tagged(s)
    return tagging.valid_parents(groups, tags, already).select("user_id", "tag", F.array_join("members", "|").alias("members"))


@query("d18_parent_edges", TAGGED + """, ok AS (SELECT DISTINCT user_id, tag AS broader, m AS narrower, p FROM reply WHERE n >= 6 AND tag = 'sea' AND (user_id, m) IN (SELECT (user_id, tag) FROM known) AND (user_id, m) NOT IN (SELECT (user_id, tag) FROM already))
SELECT user_id, broader, narrower FROM ok WHERE narrower <> 'nation_3' QUALIFY count(*) OVER (PARTITION BY user_id, p) >= 1 AND (user_id) IN (SELECT user_id FROM ok GROUP BY user_id HAVING count(*) >= 2)""")
def _(s):
    """The edges of one parent, where that to nation_3 is there already."""
    tags, already, groups = _tagged(s)
    there = tags.select("user_id", F.lit("sea").alias("broader"), F.lit("nation_3").alias("narrower")).distinct()
    return tagging.parent_edges(tagging.valid_parents(groups.where("tag = 'Sea'"), tags, already), there)


@query("d4_synonym_merges")
def _(s):
    """The groups of each reply as synonyms; tags of one obvious merge are taken."""
    tags, _, groups = _tagged(s)
    obvious = tags.select("user_id", F.lit("nation_7").alias("tag")).distinct()
    named = groups.select("user_id", "pos", F.when(F.col("pos") % 2 == 0, F.get("members", F.lit(1))).otherwise("x").alias("canonical"), F.col("members").alias("variants"))
    return tagging.valid_merges(named, tags, obvious).select("user_id", "canonical", F.array_join("variants", "|").alias("variants"))


@query("d18_proposed_parents")
def _(s):
    """Parents for the vectors' tags, of clusters of their centroids."""
    centroids = upkeep.tag_centroids(s.vector_tags).select(F.lit("u").alias("user_id"), F.concat(F.lit("tag "), F.col("tag").cast("string")).alias("tag"), F.col("centroid").alias("embedding"), "n")
    return tagging.valid_parents(tagging.proposed_parents(centroids, 0.5), centroids.select("user_id", "tag"), centroids.select("user_id", "tag").where("false")).select("user_id", "tag", F.array_join("members", "|").alias("members"))


@query("d19_topic_upsert", "SELECT DISTINCT lower(trim(c_mktsegment)) AS normalized FROM customer WHERE lower(trim(c_mktsegment)) NOT IN (SELECT normalized FROM topics)")
def _(s):
    new = s.table("customer").select(text.normal(F.col("c_mktsegment")).alias("normalized")).distinct()
    return new.join(s.topics.select("normalized"), "normalized", "left_anti")


@query("d19_topic_links", "SELECT DISTINCT id AS memory_id, lower(trim(tag)) AS normalized FROM (SELECT id, unnest(categories) AS tag FROM memories)")
def _(s):
    return reconciling.topics_of(s.memories, s.topics)[0]


@query("d20_hierarchy_insert", "SELECT DISTINCT 'r' || c_custkey % 5 AS broader, 'n' || c_nationkey AS narrower FROM customer WHERE NOT EXISTS (SELECT 1 FROM topic_relations t WHERE t.broader = 'r' || c_custkey % 5 AND t.narrower = 'n' || c_nationkey)")
def _(s):
    new = s.table("customer").select(F.concat(F.lit("r"), (F.col("c_custkey") % 5).cast("string")).alias("broader"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("narrower")).distinct()
    return new.join(s.topic_relations.select("broader", "narrower"), ["broader", "narrower"], "left_anti")


@query("u2_bounded_closure", ", under AS (SELECT 'r2' AS id, 0 AS depth UNION SELECT r.narrower, depth + 1 FROM under u JOIN topic_relations r ON r.broader = u.id WHERE depth < 8) SELECT DISTINCT id FROM under")
def _(s):
    return graph.closure(s.topic_relations, s.topics.where("id = 'r2'").select("id")).select("id")


@query("g7_new_edges", ", incoming AS (SELECT DISTINCT 's' || l_suppkey AS subject, 'supplies' AS predicate, 'p' || ((l_partkey + l_linenumber) % 2000) AS object, l_suppkey % 10 AS user_id FROM lineitem) SELECT subject, object FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.invalid_at IS NULL AND r.subject = i.subject AND r.object = i.object AND r.user_id = i.user_id)")
def _(s):
    li = s.table("lineitem")
    new = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("subject"), F.lit("supplies").alias("predicate"), F.concat(F.lit("p"), ((F.col("l_partkey") + F.col("l_linenumber")) % 2000).cast("string")).alias("object"), (F.col("l_suppkey") % 10).alias("user_id"))
    return upkeep.new_edges(new, s.relations).select("subject", "object")


@query("g8_resolve_relations", "SELECT DISTINCT a.l_partkey AS subject, b.l_partkey AS object FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey")
def _(s):
    own = s.table("lineitem").select(F.col("l_orderkey").alias("memory"), "l_linenumber", text.normal(F.concat(F.lit(" Part "), F.col("l_partkey").cast("string"))).alias("surface"))
    triples = own.select("memory", F.col("surface").alias("s"), (F.col("l_linenumber") + 1).alias("l_linenumber")).join(own.withColumnRenamed("surface", "o"), ["memory", "l_linenumber"])
    names = s.mentions.select(F.col("memory_id").alias("memory"), text.normal(F.col("surface")).alias("name"), "entity_id").distinct()
    left = triples.join(names.select("memory", F.col("name").alias("s"), F.col("entity_id").alias("subject")), ["memory", "s"])
    both = left.join(names.select("memory", F.col("name").alias("o"), F.col("entity_id").alias("object")), ["memory", "o"])
    return both.where("subject <> object").select("subject", "object").distinct()


#: Proposals that are confirmed merge their ends; several at once may form chains.
MERGED = """, pair AS (SELECT least(entity_a, entity_b) AS a, greatest(entity_a, entity_b) AS b FROM proposals WHERE status = 'confirmed'), e2 AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair), walk2 AS (SELECT a AS node, a AS low FROM e2 UNION SELECT e2.b, low FROM walk2 JOIN e2 ON e2.a = walk2.node),
moved AS (SELECT node AS id, min(low) AS root FROM walk2 GROUP BY node HAVING min(low) <> node)
"""


def _merged(s):
    moved = resolving.merged_roots(s.proposals.where("status = 'confirmed'").select(F.col("entity_a").alias("keep"), F.col("entity_b").alias("merge")))
    end = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    mapped = moved.withColumns({"end": end("id"), "end_root": end("root")})
    edges = s.relations.withColumn("subject", F.when(F.col("subject") == "s1", F.lit("p6")).otherwise(F.col("subject")))
    return resolving.after_merges(s.entities, s.mentions, edges, s.proposals, mapped, F.expr(f"timestamp_ntz'{NOW}'"))


@query("g9_merge_entities", MERGED + "SELECT e.id, coalesce(m.root, e.merged_into) AS merged_into, m.root IS NOT NULL OR e.id IN (SELECT root FROM moved) AS stale FROM entities e LEFT JOIN moved m USING (id)")
def _(s):
    return _merged(s)["entities"].select("id", "merged_into", "stale")


@query("g9_merged_mentions", MERGED + "SELECT coalesce(root, entity_id) AS entity_id, count(*) AS n FROM mentions LEFT JOIN moved ON id = entity_id GROUP BY 1")
def _(s):
    return _merged(s)["mentions"].groupBy("entity_id").agg(n_rows())


@query("g9_merged_relations", MERGED + """, r AS (SELECT CASE WHEN subject = 's1' THEN 'p6' ELSE subject END AS subject, object, invalid_at, user_id FROM relations), f AS (SELECT coalesce('p' || a.root, subject) AS subject, coalesce('p' || b.root, object) AS object, invalid_at FROM r LEFT JOIN moved a ON 'p' || a.id = subject LEFT JOIN moved b ON 'p' || b.id = object)
SELECT subject, object, invalid_at IS NULL AND subject <> object AS active, count(*) AS n FROM f GROUP BY ALL""")
def _(s):
    """One supplier is taken for an entity, so that some relation closes on itself."""
    return _merged(s)["relations"].groupBy("subject", "object", F.col("invalid_at").isNull().alias("active")).agg(n_rows())


@query("g9_merged_proposals", MERGED + "SELECT p.id, CASE WHEN coalesce(a.root, entity_a) = coalesce(b.root, entity_b) AND status = 'proposed' THEN 'confirmed' ELSE status END AS status, coalesce(a.root, entity_a) AS entity_a, coalesce(b.root, entity_b) AS entity_b FROM proposals p LEFT JOIN moved a ON a.id = entity_a LEFT JOIN moved b ON b.id = entity_b")
def _(s):
    return _merged(s)["proposals"].select("id", "status", "entity_a", "entity_b")


@query("g10_delete_entity", """, gone AS (SELECT id FROM entities WHERE id IN (5, 9) OR merged_into IN (5, 9))
SELECT 'entities' AS name, count(*) AS n FROM entities WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'mentions', count(*) FROM mentions WHERE entity_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'relations', count(*) FROM relations WHERE object NOT IN ('p5', 'p9') UNION ALL SELECT 'proposals', count(*) FROM proposals WHERE entity_a NOT IN (SELECT id FROM gone) AND entity_b NOT IN (SELECT id FROM gone)""")
def _(s):
    gone = s.entities.where(F.col("id").isin(5, 9)).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("end"))
    left = resolving.without(s.entities, s.mentions, s.relations, s.proposals, gone)
    rows = [df.agg(n_rows()).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return reduce(DataFrame.union, rows)


@query("g11_entity_hub", """, live AS (SELECT id, name FROM entities WHERE merged_into IS NULL),
al AS (SELECT id, md5(string_agg(alias, '|' ORDER BY alias)) AS aliases FROM (SELECT entity_id AS id, lower(surface) AS alias FROM mentions UNION SELECT merged_into, normalized FROM entities WHERE merged_into IS NOT NULL) GROUP BY 1),
mm AS (SELECT id, md5(string_agg(CAST(memory_id AS VARCHAR), '|' ORDER BY r)) AS memories FROM (SELECT entity_id AS id, memory_id, row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC, memory_id) AS r FROM (SELECT DISTINCT entity_id, memory_id FROM mentions) JOIN placed ON placed.id = memory_id) WHERE r <= 20 GROUP BY 1),
ed AS (SELECT CAST(substr(object, 2) AS BIGINT) AS id, md5(string_agg(subject || ' ' || predicate || ' ' || coalesce(name, object), '|' ORDER BY subject || ' ' || predicate || ' ' || coalesce(name, object))) AS edges FROM relations LEFT JOIN live ON 'p' || live.id = object WHERE invalid_at IS NULL GROUP BY object)
SELECT live.id, name, aliases, memories, edges FROM live LEFT JOIN al USING (id) LEFT JOIN mm USING (id) LEFT JOIN ed USING (id)""")
def _(s):
    edges = s.relations.withColumns({"subject_id": F.lit(None).cast("long"), "object_id": F.expr("CAST(substring(object, 2) AS BIGINT)")})
    hub = resolving.hubs(s.entities, s.mentions, edges, s.orders.select(F.col("id").alias("memory_id"), "updated_at"))
    digest = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), "|").cast("binary")).alias(c)
    return hub.select("id", "name", digest("aliases"), digest("memories"), digest("edges"))


@query("g12_aliases", "SELECT id, name FROM (SELECT id, lower(name) AS name FROM entities UNION SELECT entity_id, lower(surface) FROM mentions UNION SELECT m.merged_into, lower(m.name) FROM entities m WHERE m.merged_into IN (SELECT id FROM entities))")
def _(s):
    own = s.entities.select("id", text.normal(F.col("name")).alias("name"))
    said = s.mentions.select(F.col("entity_id").alias("id"), text.normal(F.col("surface")).alias("name"))
    merged = s.entities.where("merged_into IS NOT NULL").select(F.col("merged_into").alias("id"), text.normal(F.col("name")).alias("name")).join(s.entities.select("id"), "id", "left_semi")
    return own.union(said).union(merged).distinct()


#: A description is stale where the entity changed after it was written, or never had one.
@query("l10_stale", "SELECT id, updated > CASE WHEN id % 4 <> 0 THEN 1000 + id % 7 * 100 END IS NOT FALSE AS stale FROM entities WHERE merged_into IS NULL")
def _(s):
    written = F.when(F.col("id") % 4 != 0, F.lit(1000) + F.col("id") % 7 * 100)
    return s.entities.where("merged_into IS NULL").select("id", F.coalesce(F.col("updated") > written, F.lit(True)).alias("stale"))


EFFECTIVE = f"importance * (0.15::DOUBLE + 0.85::DOUBLE * pow(0.5::DOUBLE, greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 86400000000.0::DOUBLE / (90 * CASE memory_type WHEN 'episodic' THEN 0.5::DOUBLE WHEN 'procedural' THEN 3 WHEN 'working' THEN 0.25::DOUBLE ELSE 1 END)))"


@query("l1_effective_importance", f"SELECT id, round({EFFECTIVE}, 6) AS effective FROM memories")
def _(s):
    e = scoring.effective_importance(F.col("importance"), F.col("memory_type"), F.col("updated_at"), F.expr(f"timestamp_ntz'{NOW}'"))
    return s.memories.select("id", F.round(e, 6).alias("effective"))


@query("l2_decay_sweep", f"SELECT id AS memory_id, 'DELETE' AS event, 'decay' AS actor, md5(content) AS old FROM memories WHERE invalid_at IS NULL AND {EFFECTIVE} < 0.1")
def _(s):
    now = F.expr(f"timestamp_ntz'{NOW}'")
    return reconciling.swept(s.memories, lifecycle.faded(s.memories, NOW), now)[1].select("memory_id", "event", "actor", F.md5(F.col("old_content").cast("binary")).alias("old"))


@query("l2_swept_state", f"SELECT id, invalid_at IS NULL AND {EFFECTIVE} >= 0.1 AS active FROM memories")
def _(s):
    state, _ = reconciling.swept(s.memories, lifecycle.faded(s.memories, NOW), F.expr(f"timestamp_ntz'{NOW}'"))
    return state.select("id", F.col("invalid_at").isNull().alias("active"))


CHANGES = """, ch AS (SELECT user_id AS id, ts, event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'insert' WHEN event_type = 'click' THEN 'update' WHEN event_type = 'error' THEN 'invalidate' WHEN event_type = 'purchase' THEN 'revalidate' ELSE 'touch' END AS op,
  CASE WHEN event_id % 2 = 0 THEN event_type END AS content, value FROM events)
"""


def _changes(s):
    e = s.table("events")
    first = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) == 1
    op = F.when(first, "insert").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "error", "invalidate").when(F.col("event_type") == "purchase", "revalidate").otherwise("touch")
    return e.select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"), op.alias("op"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("content"), F.col("value").alias("importance"))


@query("l3_insert", CHANGES + "SELECT id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS valid_from FROM ch WHERE op = 'insert' GROUP BY 1")
def _(s):
    return lifecycle.fold(_changes(s)).select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("valid_from"))


@query("l3_topic_sync", "SELECT lower(trim(tag)) AS normalized, arg_min(trim(tag), seq * 10 + i) AS name FROM (SELECT seq, unnest(categories) AS tag, generate_subscripts(categories, 1) AS i FROM memories) WHERE lower(trim(tag)) NOT IN (SELECT normalized FROM topics WHERE id LIKE 'r%' OR id LIKE '%2') GROUP BY 1")
def _(s):
    """The topics that inserted memories bring along, where only some are known."""
    known = s.topics.where("id LIKE 'r%' OR id LIKE '%2'")
    return reconciling.topics_of(s.memories, known)[1].select("normalized", "name")


@query("l4_update", CHANGES + "SELECT id, arg_max(content, struct_pack(t := ts, s := seq)) FILTER (WHERE content IS NOT NULL AND op IN ('insert', 'update')) AS content, arg_max(value, struct_pack(t := ts, s := seq)) FILTER (WHERE op IN ('insert', 'update')) AS importance FROM ch GROUP BY 1")
def _(s):
    return lifecycle.fold(_changes(s)).select("id", "content", "importance")


@query("l5_invalidate", CHANGES + "SELECT id, arg_max(op, struct_pack(t := ts, s := seq)) FILTER (WHERE op IN ('insert', 'invalidate', 'revalidate')) = 'invalidate' AS off FROM ch GROUP BY 1")
def _(s):
    return lifecycle.fold(_changes(s)).select("id", F.col("invalid_at").isNotNull().alias("off"))


@query("l5_relations", CHANGES + """, off AS (SELECT id, arg_max(op, struct_pack(t := ts, s := seq)) FILTER (WHERE op IN ('insert', 'invalidate', 'revalidate')) = 'invalidate' AS off FROM ch GROUP BY 1)
SELECT CASE WHEN off IS NULL THEN r.invalid_at IS NULL ELSE NOT off END AS active, count(*) AS n FROM relations r LEFT JOIN off ON off.id = r.memory_id GROUP BY 1""")
def _(s):
    """Relations end and come back with the memory they rest on."""
    state = lifecycle.fold(_changes(s)).select("id", "invalid_at")
    return reconciling.relations_after(s.relations, state).groupBy(F.col("invalid_at").isNull().alias("active")).agg(n_rows())


@query("l6_delete", CHANGES + ", d AS (SELECT id, max(struct_pack(t := ts, s := seq)) AS gone FROM ch WHERE op = 'invalidate' AND seq % 7 = 0 GROUP BY 1) SELECT DISTINCT ch.id FROM ch LEFT JOIN d USING (id) WHERE op = 'insert' AND (gone IS NULL OR struct_pack(t := ts, s := seq) > gone)")
def _(s):
    hard = _changes(s).withColumn("op", F.when((F.col("op") == "invalidate") & (F.col("seq") % 7 == 0), "delete").otherwise(F.col("op")))
    return lifecycle.fold(hard).select("id")


PURGES = """, op AS (SELECT *, CASE WHEN op = 'invalidate' AND seq % 3 = 0 THEN 'supersede' WHEN op = 'touch' AND seq % 89 = 0 THEN 'purge' ELSE op END AS o FROM ch),
marked AS (SELECT *, coalesce(last_value(CASE o WHEN 'supersede' THEN 1 WHEN 'insert' THEN 0 END IGNORE NULLS) OVER w, 0) AS replaced FROM op WINDOW w AS (PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept_ AS (SELECT * FROM marked WHERE NOT (o = 'revalidate' AND replaced = 1)),
turned AS (SELECT *, coalesce(last_value(CASE WHEN o IN ('invalidate', 'supersede') THEN 1 WHEN o IN ('revalidate', 'insert') THEN 0 END IGNORE NULLS) OVER w, 0) AS ended FROM kept_ WINDOW w AS (PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
purged AS (SELECT id, max(struct_pack(t := ts, s := seq)) AS gone FROM turned WHERE o = 'purge' AND ended = 1 GROUP BY 1)
"""


@query("l6_purge_unforget", CHANGES + PURGES + "SELECT k.id, coalesce(arg_max(CASE WHEN o IN ('invalidate', 'supersede') THEN 1 ELSE 0 END, struct_pack(t := ts, s := seq)) FILTER (WHERE o IN ('invalidate', 'supersede', 'revalidate', 'insert')), 0) = 1 AS ended FROM turned k LEFT JOIN purged p USING (id) WHERE gone IS NULL OR struct_pack(t := ts, s := seq) > gone GROUP BY k.id HAVING count(*) FILTER (WHERE o = 'insert') > 0")
def _(s):
    """A purge needs a row that has ended, and a superseded row is not brought back."""
    op = F.when((F.col("op") == "invalidate") & (F.col("seq") % 3 == 0), "supersede").when((F.col("op") == "touch") & (F.col("seq") % 89 == 0), "purge").otherwise(F.col("op"))
    return lifecycle.fold(_changes(s).withColumn("op", op)).select("id", F.col("invalid_at").isNotNull().alias("ended"))


@query("l6_delete_all", "SELECT id FROM memories WHERE user_id = 'src3' AND invalid_at IS NULL")
def _(s):
    return lifecycle.forget_all(s.memories, F.col("user_id") == "src3", F.expr(f"timestamp_ntz'{NOW}'")).select("id")


@query("l10_descriptions", "SELECT l_partkey AS id, array_to_string(list_slice(list('order ' || o ORDER BY o), 1, 6), ' ') AS description FROM (SELECT DISTINCT l_partkey, l_orderkey AS o FROM lineitem) GROUP BY 1")
def _(s):
    facts = graph.per_key(s.mentions.select("entity_id", "memory_id").distinct(), "entity_id", [F.col("memory_id")], 6)
    joined = facts.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("memory_id")), lambda o: F.concat(F.lit("order "), o.cast("string"))), " ").alias("d"))
    return joined.select("id", text.bounded_words(F.col("d")).alias("description"))


@query("x6_session_windows", """, e AS (SELECT memory_id, created_at, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM memory_events WINDOW w AS (PARTITION BY memory_id ORDER BY created_at, id)),
n AS (SELECT memory_id, sum(starts) AS sessions, count(*) AS events FROM e GROUP BY 1) SELECT memory_id, CAST(sessions AS BIGINT) AS sessions, events FROM n""")
def _(s):
    sessions = s.events.groupBy("memory_id", F.session_window("created_at", "6 hours")).agg(n_rows())
    return sessions.groupBy("memory_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


@query("x6_hourly_events", "SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H') AS hour, event, count(*) AS n FROM memory_events GROUP BY ALL")
def _(s):
    return s.events.groupBy(F.window("created_at", "1 hour"), "event").agg(n_rows()).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event", "n")


