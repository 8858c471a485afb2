"""Full-text, vector, hybrid and graph retrieval."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.functions import predicates as P
from reverie.functions import scoring, text
from reverie.operators import graph, lifecycle, mentioning, resolving, search, strategies, upkeep
from reverie.operators.similarity_index import SimilarityIndex
from reverie.operators.text_index import TextIndex
from reverie.plans.counting import ROOTS
from reverie.plans.registry import query
from reverie.sources.store import NOW

ASKED = "The thing: in oredble ea, la the"

BM25 = r""", toks AS (SELECT id, regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+') AS w FROM memories),
totals AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM toks),
asked AS (SELECT term, count(*) AS times FROM (SELECT unnest(list_slice(regexp_extract_all(strip_accents(lower('The thing: in oredble ea, la the')), '[\p{L}\p{N}]+'), 1, 32)) AS term) GROUP BY 1),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
bm AS (SELECT id, sum(times * greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term), totals GROUP BY id)
"""
VECTOR = """, q AS (SELECT embedding AS e FROM vectors WHERE id = 7), vs AS (SELECT CAST(id AS VARCHAR) AS id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(e, lambda x: x::DOUBLE)) AS score FROM vectors, q WHERE embedding_model = 'main')
"""


def _words(s):
    return search.bm25(s.contents, ASKED)


def _near(s, model="main"):
    """Cosine to one stored vector, which is a row of a point lookup."""
    row = s.vectors.where("id = 7").select("embedding").first()
    asked = F.array(*[F.lit(float(x)) for x in (row[0] if row else [])])
    return search.vector_scores(s.vectors, asked, model).select(F.col("id").cast("string").alias("id"), "score")


@query("t1_query_words", r"SELECT id, array_to_string(list_slice(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'), 1, 32), ' ') AS words FROM memories")
def _(s):
    return s.contents.select("id", F.array_join(text.query_words(F.col("content")), " ").alias("words"))


@query("t2_index_words", r"SELECT id, md5(array_to_string(regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+'), ' ')) AS words FROM memories")
def _(s):
    return s.contents.select("id", F.md5(F.array_join(text.index_words(F.col("content")), " ").cast("binary")).alias("words"))


@query("t3_postings", r"SELECT id, dl, term, count(*) AS tf FROM (SELECT id, CAST(len(w) AS INT) AS dl, unnest(w) AS term FROM (SELECT id, regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+') AS w FROM memories)) GROUP BY ALL")
def _(s):
    return search.postings(s.contents)


def _index(s):
    return TextIndex.create(s.spark, f"{graph.shared_folder(s.spark)}/texts-{uuid.uuid4().hex}")


def _kept_up(s):
    """An index after an insert of two thirds, one of the rest, an update and a deletion."""
    index, rows = _index(s), s.contents.select("id", "seq", "content")
    index.upsert(rows.where("seq % 3 <> 2"))
    index.upsert(rows.where("seq % 3 = 2"))
    index.upsert(rows.where("seq % 10 = 1").withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit(" revised text"))))
    index.delete(rows.where("seq % 10 = 7"))
    return index


KEPT_UP = r", held AS (SELECT id, regexp_extract_all(strip_accents(lower(CASE WHEN seq % 10 = 1 THEN coalesce(content, '') || ' revised text' ELSE content END)), '[\p{L}\p{N}]+') AS w FROM memories WHERE seq % 10 <> 7)"


@query("t3_upkeep", KEPT_UP + "SELECT id, dl, term, count(*) AS tf FROM (SELECT id, CAST(len(w) AS INT) AS dl, unnest(w) AS term FROM held) GROUP BY ALL")
def _(s):
    return _kept_up(s).postings().select("id", "dl", "term", F.col("tf").cast("long").alias("tf"))


@query("t3_frequencies", KEPT_UP + "SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(w) AS term FROM held) GROUP BY term")
def _(s):
    """What the deltas of all changes add up to."""
    return _kept_up(s).frequencies()


@query("t4_indexed", BM25 + "SELECT id, round(score, 5) AS score FROM bm")
def _(s):
    """The same scores from an index that is already there."""
    index = _index(s)
    index.upsert(s.contents)
    return index.scores(ASKED).select("id", F.round("score", 5).alias("score"))


@query("t4_top", BM25 + "SELECT id, round(score, 5) AS score FROM bm ORDER BY round(score, 9) DESC, id LIMIT 20")
def _(s):
    """The best texts alone, of the layers that may hold one."""
    index = _index(s)
    index.upsert(s.contents)
    return index.top(ASKED, 20).select("id", F.round("score", 5).alias("score"))


@query("t4_bm25", BM25 + "SELECT id, round(score, 5) AS score FROM bm")
def _(s):
    return _words(s).select("id", F.round("score", 5).alias("score"))


@query("t5_bm25_plus", BM25.replace("greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE)", "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))").replace("2.2::DOUBLE", "2.5::DOUBLE").replace("1.2::DOUBLE", "1.5::DOUBLE") + "SELECT id, round(score, 5) AS score FROM bm")
def _(s):
    return search.bm25(s.contents, ASKED, k1=1.5, floor=None).select("id", F.round("score", 5).alias("score"))


@query("t6_alias_mentions", r"SELECT id FROM memories WHERE regexp_matches(lower(content), '(^|[^\p{L}\p{N}_])in oredble(?:[^\p{L}\p{N}_]|$)')")
def _(s):
    return s.contents.where(text.mentions(F.col("content"), F.lit("In oredble"))).select("id")


ALIASES = r""", turns AS (SELECT conv_id AS entity_id, regexp_extract_all(lower(regexp_replace(text, '^[^\p{L}\p{N}_]+', '')), '[\p{L}\p{N}_]+') AS w, text FROM conversations),
alias AS (SELECT DISTINCT entity_id, array_to_string(list_slice(w, 1, n), ' ') AS alias FROM turns, range(1, 5) t(n) WHERE len(w) >= n AND turns.entity_id % 4 + 1 >= n AND len(w[1]) > 2),
low AS (SELECT id, '|' || regexp_replace(lower(content), '([^\p{L}\p{N}_]+)', '|\1|', 'g') || '|' AS content FROM memories), hit AS (SELECT id, entity_id, alias FROM low JOIN alias ON contains(content, '|' || replace(alias, ' ', '| |') || '|'))
"""


@query("t6_all_aliases", ALIASES + "SELECT id, entity_id, arg_min(alias, struct_pack(l := -length(alias), a := alias)) AS surface FROM hit GROUP BY id, entity_id")
def _(s):
    """Conversations are entities here, known by the first words of their turns; all of them are looked for in all memories."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace("text", f"^{mentioning.OUTSIDE}", "")), F.lit(mentioning.INSIDE), F.lit(0))
    turns = s.table("conversations").select(F.col("conv_id").alias("entity_id"), words.alias("w")).where("length(w[0]) > 2")
    n = F.explode(F.sequence(F.lit(1), F.least(F.col("entity_id") % 4 + 1, F.size("w")).cast("int")))
    aliases = turns.withColumn("n", n).select("entity_id", F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("alias"))
    return mentioning.found(s.contents, aliases)


@query("v1_vector_top", VECTOR + "SELECT id, round(score, 5) AS score FROM vs ORDER BY score DESC, id LIMIT 20")
def _(s):
    return search.top(_near(s), 20).select("id", F.round("score", 5).alias("score"))


@query("k2_vector_top_k", VECTOR + "SELECT id FROM vs ORDER BY score DESC, id LIMIT 5")
def _(s):
    return search.top(_near(s), 5).select("id")


@query("k3_bm25_top_k", BM25 + "SELECT id FROM bm ORDER BY round(score, 9) DESC, id LIMIT 15")
def _(s):
    return search.top(_words(s).withColumn("score", F.round("score", 9)), 15).select("id")


@query("p13_near_duplicate", VECTOR + "SELECT max(score) >= 0.97 AS duplicate FROM vs WHERE id <> '7'")
def _(s):
    return _near(s).where("id <> '7'").agg((F.max("score") >= 0.97).alias("duplicate"))


RANKS = """, a AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS vector FROM vs QUALIFY vector < 30),
b AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS words FROM bm QUALIFY words < 30),
f AS (SELECT id, vector, words, coalesce(1.0::DOUBLE / (61 + vector), 0) + coalesce(1.0::DOUBLE / (61 + words), 0) AS s FROM a FULL JOIN b USING (id))
"""


def _lists(s):
    return (_near(s).withColumn("score", F.round("score", 9)), _words(s).withColumn("score", F.round("score", 9)))


@query("w1_reciprocal_ranks", BM25 + VECTOR + RANKS + "SELECT id, vector, words, round(s, 9) AS s FROM f")
def _(s):
    a, b = _lists(s)
    both = search.ranked(search.top(a, 30), "vector").join(search.ranked(search.top(b, 30), "words"), "id", "full_outer")
    return both.select("id", F.col("vector").cast("long").alias("vector"), F.col("words").cast("long").alias("words"), F.round(scoring.reciprocal(F.col("vector")) + scoring.reciprocal(F.col("words")), 9).alias("s"))


@query("w3_fused", BM25 + VECTOR + RANKS + "SELECT id, round(s / max(s) OVER (), 6) AS fused FROM f")
def _(s):
    a, b = _lists(s)
    return search.fused(search.top(a, 30), search.top(b, 30)).select("id", F.round("fused", 6).alias("fused"))


@query("u3_union_by_id", BM25 + VECTOR + RANKS + "SELECT id, vector IS NOT NULL AS in_vector, words IS NOT NULL AS in_words FROM f")
def _(s):
    a, b = _lists(s)
    return search.fused(search.top(a, 30), search.top(b, 30)).select("id", F.col("vector").isNotNull().alias("in_vector"), F.col("words").isNotNull().alias("in_words"))


UNKNOWN = "CASE WHEN seq % 7 <> 0 THEN updated_at END"


@query("r1_recency", f"SELECT id, round(coalesce(pow(0.5::DOUBLE, greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us({UNKNOWN})) / 86400000000.0::DOUBLE / 30) + 0 * epoch_us({UNKNOWN}), 0.5::DOUBLE), 6) AS recency FROM memories")
def _(s):
    """A seventh of the times is unknown."""
    return s.memories.select("id", F.round(scoring.recency(F.when(F.col("seq") % 7 != 0, F.col("updated_at")), F.expr(f"timestamp_ntz'{NOW}'")), 6).alias("recency"))


HYBRID = BM25 + VECTOR + RANKS + f""", h AS (SELECT f.id, vector, words, 0.70::DOUBLE * s / (SELECT max(s) FROM f) + 0.15::DOUBLE * pow(0.5::DOUBLE, greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 86400000000.0::DOUBLE / 30)
  + 0.15::DOUBLE * least(greatest(importance, 0), 1) AS score, memory_type, updated_at, content FROM f JOIN memories USING (id))
"""


def hybrid(s, limit=10):
    a, b = _lists(s)
    return search.hybrid(s.memories, a, b, NOW, limit)


@query("r2_hybrid", HYBRID + "SELECT id, round(score, 6) AS score FROM h ORDER BY h.score DESC, vector NULLS LAST, words NULLS LAST, id LIMIT 10")
def _(s):
    return hybrid(s).select("id", F.round("score", 6).alias("score"))


@query("k4_final_order", HYBRID + "SELECT id, CAST(row_number() OVER (ORDER BY h.score DESC, vector NULLS LAST, words NULLS LAST, id) AS INT) AS place FROM h QUALIFY place <= 10")
def _(s):
    return hybrid(s).select("id", F.row_number().over(W.orderBy(F.desc("score"), F.asc_nulls_last("vector"), F.asc_nulls_last("words"), "id")).alias("place"))


EXPAND = """, live AS (SELECT subject AS u, object AS v FROM relations WHERE invalid_at IS NULL UNION SELECT object, subject FROM relations WHERE invalid_at IS NULL),
one AS (SELECT DISTINCT v AS id FROM live WHERE u IN ('s1', 's2') AND v NOT IN ('s1', 's2')), two AS (SELECT DISTINCT v AS id FROM live WHERE u IN (SELECT id FROM one) AND v NOT IN ('s1', 's2') AND v NOT IN (SELECT id FROM one)),
reached AS (SELECT id, 1 AS hop FROM one UNION ALL SELECT id, 2 FROM two)
"""


def _expanded(s):
    seeds = s.spark.range(1).select(F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("id"))
    return graph.expand(s.relations.where("invalid_at IS NULL"), seeds)


WALKED = EXPAND + """, told AS (SELECT DISTINCT entity_id, CAST(memory_id % (SELECT count(*) FROM documents) AS VARCHAR) AS id FROM mentions),
ents AS (SELECT CAST(substr(id, 2) AS BIGINT) AS e, hop FROM reached WHERE starts_with(id, 'p') UNION ALL SELECT e, 99 FROM (VALUES (3), (8)) t(e) WHERE 'p' || e NOT IN (SELECT id FROM reached)),
walk AS (SELECT id, e, hop, row_number() OVER (PARTITION BY e ORDER BY updated_at DESC, id) AS r FROM ents JOIN told ON entity_id = e JOIN memories USING (id)),
gr AS (SELECT id, row_number() OVER (ORDER BY min(struct_pack(h := hop, e := e, r := r))) - 1 AS g FROM walk WHERE r <= 25 GROUP BY id)
"""
SEARCHED = HYBRID.replace("QUALIFY vector < 30", "QUALIFY vector < 240").replace("QUALIFY words < 30", "QUALIFY words < 240") + WALKED + """, hr AS (SELECT id, row_number() OVER (ORDER BY score DESC, vector NULLS LAST, words NULLS LAST, id) - 1 AS hk FROM h QUALIFY hk < 80),
g2 AS (SELECT gr.* FROM gr JOIN memories m USING (id) WHERE m.invalid_at IS NULL OR id IN (SELECT id FROM hr)),
x AS (SELECT id, hk, g, coalesce(1.0::DOUBLE / (60 + hk), 0) + CASE WHEN hk IS NULL OR hk >= 10 THEN coalesce(1.0::DOUBLE / (60 + g), 0) ELSE 0 END AS s FROM hr FULL JOIN g2 USING (id)),
o AS (SELECT x.id, s, row_number() OVER (ORDER BY coalesce(hk >= 5, true), CASE WHEN hk < 5 THEN hk END, s DESC, hk NULLS LAST, g NULLS LAST, x.id) AS place, created_at FROM x JOIN memories m USING (id))
"""


def _walked(s):
    """What typed relations reach from the suppliers asked for, and their parts 3 and 8."""
    reached = _expanded(s).where("id LIKE 'p%'").select(F.expr("CAST(substring(id, 2) AS BIGINT)").alias("entity_id"), "hop")
    seeds = s.spark.range(1).select(F.explode(F.array(F.lit(3).cast("long"), F.lit(8).cast("long"))).alias("entity_id"))
    return search.relational(s.told, s.memories, reached, seeds)


def _search(s, query, limit=10, **window):
    return search.search(s.memories, _lists(s) if query.strip() else None, _walked(s) if query.strip() else None, NOW, limit, **window)


@query("r4_search_window", SEARCHED + "SELECT id, CAST(place AS INT) AS place FROM (SELECT id, row_number() OVER (ORDER BY place) AS place FROM o WHERE created_at < TIMESTAMP '2024-01-15') WHERE place <= 10")
def _(s):
    """A wide fetch, fused with what the graph reaches, and then cut to the dates."""
    return _search(s, ASKED, until="2024-01-14")


@query("r4_blank_search", "SELECT id, CAST(row_number() OVER (ORDER BY updated_at DESC, seq) AS INT) AS place FROM memories WHERE invalid_at IS NULL AND created_at < TIMESTAMP '2024-01-15' QUALIFY place <= 10")
def _(s):
    """Without words a search browses."""
    return _search(s, "  ", until="2024-01-14")


@query("r9_browse_window", "SELECT id FROM memories WHERE invalid_at IS NULL AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-02-01' ORDER BY updated_at DESC, seq LIMIT 10 OFFSET 5")
def _(s):
    return s.memories.where(P.active() & P.within(F.col("created_at"), "2024-01-05", "2024-01-31")).orderBy(F.desc("updated_at"), "seq").offset(5).limit(10).select("id")


FUSION = SEARCHED + ", z AS (SELECT id, CAST(place - 1 AS INT) AS place, round(s, 6) AS fused FROM o)"


def _fusion(s):
    """The hybrid list of a wide fetch, and what the relations reach of active memories and its own."""
    order = W.orderBy(F.desc("score"), F.asc_nulls_last("vector"), F.asc_nulls_last("words"), "id")  # 80 rows
    listed = graph.kept(hybrid(s, 80).select("id", (F.row_number().over(order) - 1).alias("rank")), "listed")
    there = s.memories.where("invalid_at IS NULL").select("id").union(listed.select("id"))
    return search.relational_fusion(listed, _walked(s).join(there, "id", "left_semi"))


@query("r5_relational_fusion", FUSION + "SELECT * FROM z")
def _(s):
    return _fusion(s)


@query("w2_relational_ranks", FUSION + "SELECT id, fused FROM z WHERE place >= 5")
def _(s):
    return _fusion(s).where("place >= 5").select("id", "fused")


@query("k5_pinned", FUSION + "SELECT id, place FROM z WHERE place < 5")
def _(s):
    return _fusion(s).where("place < 5").select("id", "place")


BUDGET = HYBRID + """, t AS (SELECT id, row_number() OVER (ORDER BY score DESC, vector NULLS LAST, words NULLS LAST, id) AS place, greatest(1, length('- [' || memory_type || ' · ' || strftime(updated_at, '%Y-%m-%d') || '] ' || content) // 4) + 1 AS tokens FROM h),
c AS (SELECT *, min(CASE WHEN tokens <= 1200 THEN place END) OVER () AS start FROM t WHERE place <= 20), u AS (SELECT *, sum(tokens) OVER (ORDER BY place) AS used FROM c WHERE place >= start)
"""


def _context(s, budget=1200):
    rows = hybrid(s, 20)
    line = lifecycle.context_line(F.col("memory_type"), F.col("updated_at"), F.col("content"))
    place = F.row_number().over(W.orderBy(F.desc("score"), F.asc_nulls_last("vector"), F.asc_nulls_last("words"), "id"))
    return lifecycle.within_budget(rows.select("id", place.alias("place"), line.alias("line"), (lifecycle.tokens(line) + 1).alias("tokens")), budget)


@query("r6_context", BUDGET.replace("QUALIFY vector < 30", "QUALIFY vector < 60").replace("QUALIFY words < 30", "QUALIFY words < 60") + "SELECT id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 1200")
def _(s):
    return _context(s).select("id", "used")


@query("w4_budget_prefix", ", t AS (SELECT seq, CAST(greatest(1, length(content) // 4) AS INT) AS tokens FROM memories), u AS (SELECT *, sum(tokens) OVER (ORDER BY seq) AS used FROM t WHERE seq >= (SELECT min(seq) FROM t WHERE tokens <= 3000)) SELECT seq AS place, CAST(used AS BIGINT) AS used FROM u WHERE used <= 3000")
def _(s):
    own = s.contents.select(F.col("seq").alias("place"), lifecycle.tokens(F.col("content")).alias("tokens"))
    return lifecycle.within_budget(own, 3000).select("place", "used")


NAMED = ROOTS + """, live AS (SELECT id, updated FROM entities WHERE merged_into IS NULL),
names AS (SELECT x.name, x.id, l.updated FROM (SELECT normalized AS name, id FROM entities WHERE merged_into IS NULL UNION SELECT lower(trim(surface)), entity_id FROM mentions
  UNION SELECT e.normalized, r.root FROM entities e JOIN roots r USING (id) WHERE e.merged_into IS NOT NULL) x JOIN live l USING (id))
"""
BLOCKS = r""", fact AS (SELECT entity_id, memory_id, row_number() OVER (PARTITION BY entity_id ORDER BY memory_id) AS r FROM (SELECT DISTINCT entity_id, memory_id FROM mentions)),
described AS (SELECT e.id, e.name, e.entity_type, array_to_string(list('order ' || f.memory_id ORDER BY f.r), ' ') AS d FROM entities e JOIN fact f ON f.entity_id = e.id AND f.r <= 6 WHERE e.merged_into IS NULL GROUP BY ALL),
seen AS (SELECT id, max(updated) AS u FROM names WHERE name IN ('red widget brand17', 'small ring brand2', 'part 12', 'part 12', 'part 40') GROUP BY id ORDER BY max(updated) DESC, id LIMIT 3),
line AS (SELECT id, row_number() OVER (ORDER BY u DESC, id) AS place, '- ' || name || ' (' || entity_type || '): ' || d AS line FROM seen JOIN described USING (id)),
cost AS (SELECT *, CAST(greatest(1, length(line) // 4) + 1 AS INT) AS tokens FROM line)
"""
ENTITIES = "Red widget brand17, small ring brand2: part 12, part 40?"


def _blocks(s, budget):
    names = graph.identities(s.entities, s.mentions, graph.roots(s.entities))
    facts = graph.per_key(s.mentions.select("entity_id", "memory_id").distinct(), "entity_id", [F.col("memory_id")], 6)
    joined = facts.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("memory_id")), lambda o: F.concat(F.lit("order "), o.cast("string"))), " ").alias("d"))
    described = s.entities.where("merged_into IS NULL").join(joined, "id").select("id", "name", "entity_type", F.col("d").alias("description"))
    return lifecycle.entity_blocks(graph.detect(ENTITIES, names, 3), described, budget)


COMPOSED = NAMED + BLOCKS + """, e1 AS (SELECT 7 + coalesce((SELECT tokens FROM cost WHERE place = 1 AND 7 + tokens <= 225), 0) AS used), e2 AS (SELECT used + coalesce((SELECT tokens FROM cost WHERE place = 2 AND used + tokens <= 225), 0) AS used FROM e1),
fit AS (SELECT id, place, line FROM cost WHERE tokens + CASE place WHEN 1 THEN 7 WHEN 2 THEN (SELECT used FROM e1) ELSE (SELECT used FROM e2) END <= 225),
room_ AS (SELECT 900 - CASE WHEN count(*) = 0 THEN 0 ELSE (28 + sum(length(line)) + count(*) - 1) // 4 END AS room FROM fit),
said AS (SELECT DISTINCT entity_id, CAST(memory_id % (SELECT count(*) FROM documents) AS VARCHAR) AS id FROM mentions),
theirs AS (SELECT fit.place AS p, m.id, row_number() OVER (PARTITION BY fit.id ORDER BY m.updated_at DESC, m.id) AS r FROM fit JOIN said ON said.entity_id = fit.id JOIN memories m ON m.id = said.id WHERE m.invalid_at IS NULL)
""" + BUDGET.replace("QUALIFY vector < 30", "QUALIFY vector < 60").replace("QUALIFY words < 30", "QUALIFY words < 60").replace("1200", "(SELECT room FROM room_)") + """,
parts_ AS (SELECT id, p * 100 + r AS spot FROM theirs WHERE r <= 20 UNION ALL SELECT id, 1000 + place FROM u WHERE used <= (SELECT room FROM room_))
SELECT id, row_number() OVER (ORDER BY min(spot)) - 1 AS place FROM parts_ GROUP BY id"""


@query("r7_reconstructed", COMPOSED)
def _(s):
    """Entities' lines take at most a quarter of the budget (80 to 300) and bring their latest memories; others fill what the lines leave. Each memory once, in order."""
    budget, header = 900, 28
    blocks = graph.kept(_blocks(s, min(300, max(80, budget // 4))), "blocks")
    lines, length = blocks.agg(F.count(F.lit(1)), F.sum(F.length("line"))).first()
    used = (header + length + lines - 1) // 4 if lines else 0
    told = s.told.join(s.memories.where(P.active()).select("id", "updated_at"), "id")
    return lifecycle.composed(blocks, told, _context(s, max(0, budget - used)))


@query("r8_entity_blocks", NAMED + BLOCKS + ", one AS (SELECT * FROM cost WHERE place = 1), two AS (SELECT * FROM cost WHERE place = 2), three AS (SELECT * FROM cost WHERE place = 3), a AS (SELECT CASE WHEN 7 + tokens <= 60 THEN 7 + tokens ELSE 7 END AS used FROM one), b AS (SELECT CASE WHEN used + tokens <= 60 THEN used + tokens ELSE used END AS used, used AS before FROM a, two) SELECT id, tokens FROM one WHERE 7 + tokens <= 60 UNION ALL SELECT id, tokens FROM two, a WHERE used + tokens <= 60 UNION ALL SELECT id, tokens FROM three, b WHERE used + tokens <= 60")
def _(s):
    """Up to three entities of the question with their descriptions; one that doesn't fit is left out and the next tried."""
    return _blocks(s, 60).select("id", "tokens")


@query("r10_eval_harness")
def _(s):
    from reverie.operators import evals

    asked = s.table("benchmark").select(F.col("item_id").alias("case"), F.concat_ws(" ", F.slice(text.words(F.col("text")), 1, 6)).alias("q"), F.slice(text.words(F.col("text")), 3, 2).alias("keywords"))
    return evals.metrics(evals.answers(s.contents.select("id", "content"), asked, 5), asked, 5)


@query("a13_eval_metrics", """, asked AS (SELECT event_id AS q, event_id % 7 AS hit, value AS ms FROM events)
SELECT round(avg(CASE WHEN hit BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN hit BETWEEN 1 AND 5 THEN 1.0 / hit ELSE 0.0 END), 6) AS mrr,
  list_sort(list(ms))[CAST(round_even(0.5 * (count(*) - 1), 0) AS INT) + 1] AS p50, list_sort(list(ms))[CAST(round_even(0.95 * (count(*) - 1), 0) AS INT) + 1] AS p95 FROM asked""")
def _(s):
    from reverie.operators import evals

    e = s.table("events")
    return evals.summary(e.select(F.when((F.col("event_id") % 7).between(1, 5), F.col("event_id") % 7).alias("first_hit"), F.col("value").alias("ms")))


@query("a18_family_metrics", """, got AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS x, l_linenumber AS r FROM lineitem), gold AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS x FROM lineitem WHERE l_returnflag = 'A'),
hits AS (SELECT d.q, count(DISTINCT d.x) AS size, count(DISTINCT g.x) AS hit, min(g.r) AS first FROM gold d LEFT JOIN got g ON d.q = g.q AND d.x = g.x AND g.r <= 3 GROUP BY 1)
SELECT q % 3 AS family, round(avg(hit / size), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM hits GROUP BY 1""")
def _(s):
    li = s.table("lineitem")
    got = li.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("x"), F.col("l_linenumber").alias("r")).distinct()
    gold = li.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("x")).distinct()
    hits = gold.join(got.groupBy("q", "x").agg(F.min("r").alias("r")), ["q", "x"], "left").groupBy("q").agg(F.count(F.lit(1)).alias("size"), F.count("r").alias("hit"), F.min("r").alias("first"))
    return hits.groupBy((F.col("q") % 3).alias("family")).agg(F.round(F.avg(F.col("hit") / F.col("size")), 6).alias("recall"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query("r11_strategies")
def _(s):
    """The ten memories that each of six strategies finds for a question about part 3."""
    n = s.table("documents").count()
    typed = s.relations.where("invalid_at IS NULL").select("subject", "object", (F.col("memory_id") % max(1, n)).cast("string").alias("id"))
    seeds = s.spark.range(1).select(F.lit(3).cast("long").alias("entity_id"))
    return strategies.compared(*_lists(s), s.told, typed, seeds, F.concat(F.lit("p"), F.col("entity_id").cast("string"))).select("strategy", "place", "id")


@query("v3_similarity_index")
def _(s):
    """Every vector whose id is divisible by 20 asks an index of all; vectors of the second half of all ids' hashes are filed after it was built."""
    vectors = s.vectors.select("id", "embedding")
    late = F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    index = SimilarityIndex.build(vectors.where(~late), f"{graph.shared_folder(s.spark)}/similarity-{uuid.uuid4().hex}")
    index.add(vectors.where(late))
    return index.search(vectors.where("id % 20 = 0"), 10).select("query", "id", "place", F.round("score", 6).alias("score"))


VOCABULARY = VECTOR.replace("vs AS", "near AS") + """, c AS (SELECT tag, count(*) AS n FROM tagged GROUP BY 1), best AS (SELECT tag, max(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(e, lambda x: x::DOUBLE))) AS sim FROM tagged, q GROUP BY 1),
many AS (SELECT count(*) > 120 AS m FROM c), a AS (SELECT tag FROM best, many WHERE m ORDER BY round(sim, 9) DESC, tag LIMIT 60),
b AS (SELECT tag FROM c WHERE tag NOT IN (SELECT tag FROM a) ORDER BY n DESC, tag LIMIT (SELECT 120 - count(*) FROM a)) SELECT tag FROM a UNION ALL SELECT tag FROM b"""


def _vocabulary(s, tagged):
    row = s.vectors.where("id = 7").select("embedding").first()
    return upkeep.vocabulary(tagged, F.array(*[F.lit(float(x)) for x in row[0]]))


@query("v6_vocabulary", VOCABULARY.replace(", q AS", ", tagged AS (SELECT id % 150 AS tag, embedding FROM vectors), q AS", 1))
def _(s):
    """Of 150 tags, the 60 nearest and the most frequent up to 120."""
    return _vocabulary(s, s.vectors.select((F.col("id") % 150).alias("tag"), "embedding"))


@query("v6_small_vocabulary", VOCABULARY.replace(", q AS", ", tagged AS (SELECT tag, embedding FROM vectors), q AS", 1))
def _(s):
    """Few tags are all of the vocabulary."""
    return _vocabulary(s, s.vectors.select("tag", "embedding"))


@query("u1_identities", NAMED + "SELECT name, id FROM names")
def _(s):
    return graph.identities(s.entities, s.mentions, graph.roots(s.entities)).select("name", "id")


@query("g1_detect", NAMED + "SELECT id FROM names WHERE name IN ('red widget brand17', 'small ring brand2', 'red', 'widget', 'part 12') GROUP BY id ORDER BY max(updated) DESC, id LIMIT 50")
def _(s):
    return graph.detect("Red widget brand17, small ring brand2: part 12?", graph.identities(s.entities, s.mentions, graph.roots(s.entities))).select("id")


@query("g2_alias_tiers", NAMED + """, al AS (SELECT 'alias ' || id AS name, id FROM entities WHERE id % 3 = 0 AND merged_into IS NULL), asked AS (SELECT unnest(['alias 12', 'part 7', 'alias 15', 'part 3', 'alias 13']) AS name),
hit AS (SELECT name, id, 0 AS tier FROM names JOIN asked USING (name)), more AS (SELECT name, id, 1 AS tier FROM al JOIN asked USING (name) WHERE name NOT IN (SELECT name FROM hit)) SELECT name, id, tier FROM hit UNION ALL SELECT * FROM more""")
def _(s):
    """Names first; aliases in metadata only for what no name finds."""
    names = graph.identities(s.entities, s.mentions, graph.roots(s.entities))
    asked = s.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("Alias 12", "part 7", "alias 15", "Part 3", "alias 13")])).alias("name"))
    return graph.candidates(asked, names, s.changed_entities)


@query("g3_expand", EXPAND + "SELECT id, hop FROM reached")
def _(s):
    return _expanded(s)


@query("g4_fallback_pagerank")
def _(s):
    """The seed has no typed relation, so what shares its memories comes in order of rank."""
    memories = s.orders.select(F.col("id").alias("memory_id"), "updated_at")
    seeds = s.mentions.agg(F.min("entity_id").alias("id"))
    none = s.relations.where("false").select(F.col("memory_id").alias("subject"), F.col("memory_id").alias("object"))
    near = resolving.near_by_cooccurrence(s.mentions, memories, seeds)
    return resolving.expanded(none, seeds, lambda: near)


@query("g5_benchmark_pagerank")
def _(s):
    few = s.relations.where("invalid_at IS NULL")
    edges = graph.undirected(few).distinct().withColumn("weight", F.lit(1.0))
    return graph.pagerank(edges, few.agg(F.min("subject").alias("id")), rounds=25).select("id", F.round("rank", 9).alias("rank"))


@query("g6_relational_memories", EXPAND + """, ents AS (SELECT e, min(hop) AS hop FROM (SELECT CAST(substr(id, 2) AS BIGINT) AS e, hop FROM reached WHERE starts_with(id, 'p') UNION ALL SELECT 3, 9 UNION ALL SELECT 8, 9) GROUP BY e),
mem AS (SELECT e, hop, memory_id, row_number() OVER (PARTITION BY e ORDER BY updated_at DESC, memory_id) AS r FROM (SELECT DISTINCT e, hop, memory_id, updated_at FROM ents JOIN mentions ON entity_id = e JOIN placed ON placed.id = memory_id))
SELECT memory_id, CAST(min(hop) AS INT) AS hop FROM mem WHERE r <= 25 GROUP BY 1""")
def _(s):
    """Memories of what the relations reach, 25 for each entity, and after them those of the seeds (3 and 8) themselves."""
    found = _expanded(s).where("id LIKE 'p%'").select(F.expr("CAST(substring(id, 2) AS BIGINT)").alias("entity_id"), "hop")
    seeds = s.spark.range(1).select(F.explode(F.array(F.lit(3).cast("long"), F.lit(8).cast("long"))).alias("entity_id"), F.lit(9).alias("hop"))
    own = found.unionByName(seeds).groupBy("entity_id").agg(F.min("hop").alias("hop"))
    links = s.mentions.select("entity_id", "memory_id").distinct().join(own, "entity_id").join(s.orders.select(F.col("id").alias("memory_id"), "updated_at"), "memory_id")
    return graph.per_key(links, "entity_id", [F.desc("updated_at"), F.col("memory_id")], 25).groupBy("memory_id").agg(F.min("hop").alias("hop"))


@query("g13_two_hops", "SELECT DISTINCT o_custkey AS start, l_partkey AS end FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(s):
    first = s.orders.select(F.col("user_id").alias("a"), F.col("id").alias("b"))
    return graph.two_hops(first, s.mentions.select(F.col("memory_id").alias("a"), F.col("entity_id").alias("b")))
