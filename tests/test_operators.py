"""Behaviour of the memory store's operators on small fixtures."""

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reverie.functions import embedding, predicates, scoring, text
from reverie.operators import evals, extraction, graph, lifecycle, mentioning, reconciling, resolving, search, strategies, upkeep
from reverie.sources import store
from reverie.streaming import ingest


def one(spark, expr, **values):
    """A column expression's value over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "reason"),
    [("2019", "date"), ("2026-07-24", "date"), ("July 2026", "date"), ("März 2026", "date"), ("2026 - 2029", "date"), ("https://a.b", "link"), ("www.x.y", "link"), ("a@b.org", "link"), ("[name]", "filler"), ("{}", "filler"),
     ("Sehr geehrte Damen", "greeting"), ("192 GB", "amount"), ("$149", "amount"), ("16 GB RAM", "amount"), ("  ", "empty"), (None, "empty"), ("Ada Lovelace", None), ("7-Eleven", None), ("Area 51", None), ("3M", None), ("B52 bomber", None)],
)
def test_names_without_referent(spark, name, reason):
    assert one(spark, text.no_referent(F.lit(name))) == reason


@pytest.mark.parametrize(("tag", "key"), [("Categories", "category"), ("boxes", "box"), ("glass", "glass"), ("status", "status"), ("unit-tests", "unit test"), ("gas", "gas"), ("analysis", "analysis"), ("Data__Sets ", "data set"), ("-", "")])
def test_tag_keys(spark, tag, key):
    assert one(spark, text.tag_key(F.lit(tag))) == key


def test_obvious_tags(spark):
    tags = spark.createDataFrame([("unit-test",), ("unit tests",), ("Unit_Tests",), ("news",), ("box",), ("boxes",), (" BOX",)], "tag string")
    assert {tuple(r) for r in upkeep.obvious_tags(tags).collect()} == {("unit-test", "unit tests"), ("unit tests", "unit tests"), ("unit_tests", "unit tests"), ("box", "box"), ("boxes", "box")}


@pytest.mark.parametrize(
    ("since", "until", "kept"),
    [(None, None, True), ("2024-01-22", None, True), ("2024-01-23", None, False), (None, "2024-01-22", True), (None, "2024-01-21", False), (None, "2024-01-22T10:00:00", False), (None, "2024-01-22T10:00:01", True), ("soon", "later", True)],
)
def test_date_windows(spark, since, until, kept):
    assert one(spark, predicates.within(F.expr("timestamp_ntz'2024-01-22 10:00:00'"), since, until)) is kept
    assert one(spark, predicates.within(F.lit(None).cast("timestamp_ntz"), since, until)) is True


def test_ownership(spark):
    users = spark.createDataFrame([("a::x",), ("a",), ("",), (None,)], "u string")
    held = lambda owner: [r[0] for r in users.select(predicates.owned(F.col("u"), owner)).collect()]
    assert held("a::") == [True, False, False, False] and held("a") == [False, True, False, False] and held(None) == [True] * 4


def test_fading_goes_by_kind_and_has_a_floor(spark):
    now = F.expr("timestamp_ntz'2024-04-01 00:00:00'")
    rows = spark.createDataFrame([("episodic",), ("semantic",), ("procedural",), ("working",)], "k string").select("k", F.expr("timestamp_ntz'2024-01-02 00:00:00'").alias("t"))
    got = {r.k: r.e for r in rows.select("k", scoring.effective_importance(F.lit(1.0), F.col("k"), F.col("t"), now).alias("e")).collect()}
    assert got["semantic"] == pytest.approx(0.575) and got["episodic"] == pytest.approx(0.15 + 0.85 / 4) and got["working"] == pytest.approx(0.15 + 0.85 / 16) and got["procedural"] > got["semantic"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("1", "café au lait"), ("2", "the the the"), ("3", "the lait"), ("4", "foo_bar"), ("5", None)], "id string, content string")
    got = {r.id: r.score for r in search.bm25(docs, "lait, lait the!").collect()}
    avgdl = (3 + 3 + 2 + 2 + 0) / 5
    gain = lambda df, tf, dl: max(math.log((5 - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert got == pytest.approx({"1": 2 * gain(2, 1, 3), "2": gain(2, 3, 3), "3": 2 * gain(2, 1, 2) + gain(2, 1, 2)})
    assert search.bm25(docs, " ,;").count() == 0


def test_relational_fusion_keeps_the_first_and_boosts_late_rows(spark):
    hybrid = spark.createDataFrame([(f"h{i:02}", i) for i in range(15)], "id string, rank int")
    walked = spark.createDataFrame([("h12", 0), ("new", 1), ("h07", 2)], "id string, rank int")
    order = [r.id for r in search.relational_fusion(hybrid, walked).orderBy("place").collect()]
    assert order[:5] == [f"h{i:02}" for i in range(5)] and order[5] == "h12" and order.index("new") < order.index("h05") + 12 and len(order) == 16


def test_budget_skips_oversize_first_and_stops_at_overflow(spark):
    rows = spark.createDataFrame([(1, 900), (2, 60), (3, 40), (4, 1), (5, 1)], "place int, tokens int")
    assert [r.place for r in lifecycle.within_budget(rows, 100).orderBy("place").collect()] == [2, 3]
    keyed = rows.withColumn("q", F.lit(1))
    assert sorted(r.place for r in lifecycle.fitted(keyed, 62, "q").collect()) == [2, 4, 5]


def test_merge_roots(spark):
    chain = [(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 99), (8, 7), (9, 9)]
    e = spark.createDataFrame(chain, "id long, merged_into long")
    assert {r.id: r.root for r in graph.roots(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: None, 6: None, 7: None, 8: None, 9: None}


def test_closure_bounds_depth_and_survives_cycles(spark):
    steps = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(12)] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1")], "broader string, narrower string")
    seeds = spark.createDataFrame([("t0",), ("c1",)], "id string")
    got = {(r.root, r.id) for r in graph.closure(steps, seeds).collect()}
    assert got == {("t0", f"t{i}") for i in range(8)} | {("c1", c) for c in ("c1", "c2", "c3")}


def test_closure_runs_nothing_before_its_result_and_has_no_limit_of_rows(spark):
    steps = spark.createDataFrame([(f"{i}", f"{i + k}") for i in range(60) for k in (1, 2)] * 2, "broader string, narrower string")
    seeds = spark.createDataFrame([(f"{i}",) for i in range(60)], "id string")
    tracker, limit = spark.sparkContext.statusTracker(), spark.conf.get("spark.sql.cteRecursionRowLimit")
    before = set(tracker.getJobIdsForGroup())
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        under = graph.closure(steps, seeds, 4)
        assert set(tracker.getJobIdsForGroup()) == before
        got = [(r.root, r.id) for r in under.collect()]
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    assert sorted(got) == sorted((f"{i}", f"{j}") for i in range(60) for j in range(i, min(i + 6, 61) + 1))


def test_expand_and_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "subject string, object string")
    seeds = spark.createDataFrame([("c",)], "id string")
    assert {(r.id, r.hop) for r in graph.expand(edges, seeds).collect()} == {("b", 1), ("d", 1), ("a", 2)}
    parts = graph.components(edges.select(F.col("subject").alias("a"), F.col("object").alias("b")))
    assert {(r.node, r.component) for r in parts.collect()} == {(n, "a") for n in "abcd"} | {(n, "x") for n in "xy"}


def test_oversize_groups_are_left_out(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21), (21, 22)], "a long, b long")
    assert {(r.node, r.component, r["size"]) for r in upkeep.groups_of(pairs).collect()} == {(n, 20, 3) for n in (20, 21, 22)}


def test_pagerank_sums_to_one_and_favours_the_seed(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in (("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"))], "u string, v string, weight double")
    got = {r.id: r.rank for r in graph.pagerank(edges, spark.createDataFrame([("a",)], "id string")).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["a"] > got["c"]


def test_fold_of_changes(spark):
    rows = [(1, 1, "insert", "a", 0.5), (1, 2, "update", None, 0.9), (1, 3, "invalidate", None, None), (1, 4, "invalidate", None, None), (2, 1, "insert", "b", 0.1), (2, 2, "delete", None, None), (2, 3, "insert", "c", 0.2), (3, 1, "insert", "d", 0.3), (3, 2, "invalidate", None, None), (3, 3, "revalidate", None, None), (4, 1, "insert", "e", 0.3), (4, 2, "delete", None, None)]
    ch = spark.createDataFrame([(i, s, s, op, c, w) for i, s, op, c, w in rows], "id long, t int, seq int, op string, content string, importance double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(t)"))
    got = {r.id: (r.content, r.importance, r.invalid_at and r.invalid_at.day) for r in lifecycle.fold(ch).collect()}
    assert got == {1: ("a", 0.9, 4), 2: ("c", 0.2, None), 3: ("d", 0.3, None)}


def test_restore_is_whole_or_nothing(spark):
    stored = spark.createDataFrame([(1, "a"), (2, None)], "id long, content string")
    assert lifecycle.restored(spark.createDataFrame([(2, None), (3, "c")], "id long, content string"), stored).count() == 3
    with pytest.raises(ValueError, match="differs"):
        lifecycle.restored(spark.createDataFrame([(1, "other"), (4, "d")], "id long, content string"), stored)


def test_backup_round_trip(spark, tmp_path):
    from reverie.sources import backup
    from tests.conftest import DATA

    s = store.Store(spark, DATA)
    backup.export_backup(s, predicates.scoped(user_id="src3"), str(tmp_path / "b"))
    tables = backup.scoped_tables(s, predicates.scoped(user_id="src4"))
    assert len(tables) == 11 and backup.dangling(tables).count() == 0
    merged = backup.import_backup(spark, str(tmp_path / "b"), tables)
    assert merged["memories"].count() == s.memories.where("user_id IN ('src3', 'src4')").count()
    again = backup.import_backup(spark, str(tmp_path / "b"), {k: merged[k] for k in ("topics", "memory_topics", "memories")})
    assert again["topics"].count() == merged["topics"].count()
    with pytest.raises(ValueError, match="differs"):
        backup.import_backup(spark, str(tmp_path / "b"), {"topics": s.topics.withColumn("name", F.lit("other"))})
    with pytest.raises(ValueError, match="neither"):
        backup.import_backup(spark, _without_memories(spark, tmp_path / "b", tmp_path / "c"), {name: tables[name] for name in ("memory_topics", "memories")})


def _without_memories(spark, path, out):
    """The backup less its memories' rows."""
    for name in ("memory_topics", "memories"):
        df = spark.read.parquet(str(path / name))
        (df.where("false") if name == "memories" else df).write.parquet(str(out / name))
    return str(out)


def test_same_entity_rules(spark):
    say = lambda *v: one(spark, upkeep.same_entity(*[F.lit(x) for x in v]))
    assert say("Ada Smith", "ada smith", None, "person", "planning telescopes", "plans telescope") is True
    assert say("Ada Smith", "ada smith", "place", "person", "planning telescopes", "plans telescope") is False
    assert say("Ada", "ada", None, None, "planning telescopes", "plans telescope") is False
    assert say("Ada Smith", "ada smith", None, None, "the was", "plans telescope") is False


def test_replies_are_rescued(spark):
    good = '{"facts": [{"content": " x ", "type": "odd", "importance": "2", "relations": [{"subject": "A", "predicate": "Works On", "object": "B"}, {"subject": "a", "predicate": "is", "object": "A "}]}, {"content": " "}]}'
    raw = spark.createDataFrame([(1, good), (2, f"```json\n{good}\n```"), (3, f"Here {{it}} is: {good} ok?"), (4, "nothing"), (5, None)], "id long, reply string")
    got = extraction.candidates(extraction.replies(raw)).collect()
    assert sorted(r.id for r in got) == [1, 2, 3]
    assert {(r.content, r.memory_type, r.importance, r.relations[0].predicate, len(r.relations)) for r in got} == {("x", "semantic", 1.0, "works_on", 1)}


def test_hash_embedder():
    texts = pd.Series(["Red bicycle", "red BICYCLE!", "", None, "a", "the red red bicycle of the red"])
    got = embedding.hashed(texts)
    assert np.array_equal(got[0], got[1]) and np.allclose((got[[0, 4, 5]] ** 2).sum(1), 1) and not got[2:4].any() and got.shape == (6, 256)
    # the definition, word by word
    want = np.zeros(256)
    words = "the red red bicycle of the red".split()
    for f in words + [f"^{w}$"[i : i + 3] for w in words for i in range(len(w))] + [f"{a}_{b}" for a, b in itertools.pairwise(words)]:
        h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
        want[h % 256] += 1 if h >> 62 & 1 else -1
    assert np.allclose(got[5], want / np.linalg.norm(want))


def clustered(spark, n=400, zero=True):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8))
    x = centers[rng.integers(0, 12, n)] + rng.normal(0, 0.25, (n, 8))
    x[5:9] = x[4]
    if zero:
        x[9] = 0
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(n, None)], "id long, embedding array<double>")


@pytest.mark.parametrize("sub", [1024, 7])
def test_similarity_pairs_are_those_of_the_scan(spark, monkeypatch, sub):
    monkeypatch.setattr(search, "SUB_BLOCK", sub)
    x, table = clustered(spark)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    near = u @ u.T >= 0.95
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if near[i, j]}
    got = [(r.a, r.b) for r in search.similarity_pairs(table, 0.95).collect()]
    assert set(got) == want and len(got) == len(want) > 500
    links = search.similarity_pairs(table, 0.95, links_only=True).select("a", "b")
    parts = lambda df: {(r.node, r.component) for r in graph.components(df).collect()}
    assert links.count() < len(want) and parts(links) == parts(spark.createDataFrame(sorted(want), "a long, b long"))
    assert search.similarity_pairs(table.where("false"), 0.9).count() == 0


def test_meetings_are_found_on_spark(spark, monkeypatch):
    """The driver reads as many rows for small sub-blocks, of which many more meet, as for large ones."""
    from pyspark.sql import DataFrame

    _, table = clustered(spark)
    read = DataFrame.collect
    counts = []
    for sub in (1024, 4):
        monkeypatch.setattr(search, "SUB_BLOCK", sub)
        seen = []
        monkeypatch.setattr(DataFrame, "collect", lambda self, seen=seen: seen.append(read(self)) or seen[-1])
        made = search.similarity_pairs(table, 0.95)
        counts.append(sum(map(len, seen)))
        monkeypatch.setattr(DataFrame, "collect", read)
        assert made.count() > 500
    assert counts[0] == counts[1] < 50


def test_split_tags_by_centroid_or_label(spark):
    tags = {"tech": [1.0, 0.0, 0.1], "technical": [1.0, 0.0, 0.12], "food": [0.0, 1.0, 0.0], "foods": [0.6, 0.8, 0.0], "drink": [0.59, 0.81, 0.0], "thin": [1.0, 0.0, 0.1]}
    rows = [(t, v) for t, v in tags.items() for _ in range(1 if t == "thin" else 3)] + [("technical", tags["technical"])]
    centroids = upkeep.tag_centroids(spark.createDataFrame(rows, "tag string, embedding array<double>"))
    labels = spark.createDataFrame([("food", [1.0, 0.1]), ("foods", [1.0, 0.2]), ("drink", [0.0, 1.0])], "tag string, label array<double>")
    together = spark.createDataFrame([("drink", "foods", 2)], "a string, b string, n long")
    say = lambda df: {(r.canonical, r.variant) for r in df.collect()}
    assert say(upkeep.split_tags(centroids, together)) == {("technical", "tech")}  # drink and foods stand together, thin has one memory
    assert say(upkeep.split_tags(centroids, together, labels)) == {("technical", "tech"), ("food", "foods")}


def test_unknown_times(spark):
    now, none = F.expr("timestamp_ntz'2024-04-01 00:00:00'"), F.lit(None).cast("timestamp_ntz")
    assert one(spark, scoring.recency(none, now)) == 0.5 and one(spark, scoring.recency(F.expr("timestamp_ntz'2030-01-01 00:00:00'"), now)) == 1.0
    assert one(spark, scoring.effective_importance(F.lit(0.7), F.lit("semantic"), none, now)) == pytest.approx(0.7)


def test_forms_of_words(spark):
    assert one(spark, text.index_words(F.lit("Café ÜBER_naïve ﬁn Ǆ"))) == ["cafe", "uber", "naive", "ﬁn", "ǆ"]
    assert one(spark, text.restated(F.lit("Die STRASSE, ﬃ ς"))) == one(spark, text.restated(F.lit("die straße FFI Σ"))) == "die strasse ffi σ"
    for word in ("Straße", "ΌΣΟΣ", "ŉa", "ﬀ", "İx"):
        assert one(spark, text.casefolded(F.lit(word))) == word.lower().casefold()


def test_nearest_rank(spark):
    values = [0.5] * 40 + [float(i) for i in range(300)] + [1e9, -5.0, 3.25]
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "ms double")
    shares = (0.0, 0.05, 0.5, 0.95, 0.999, 1.0)
    assert evals.nearest_rank(table, "ms", shares, cells=5) == [sorted(values)[round(q * (len(values) - 1))] for q in shares]
    assert evals.nearest_rank(table.where("false"), "ms", (0.5,)) == [None]


def test_purge_needs_an_ended_row_and_superseded_rows_stay_ended(spark):
    rows = [(1, 1, "insert"), (1, 2, "purge"), (2, 1, "insert"), (2, 2, "invalidate"), (2, 3, "purge"), (3, 1, "insert"), (3, 2, "supersede"), (3, 3, "revalidate"), (4, 1, "insert"), (4, 2, "invalidate"), (4, 3, "revalidate"), (5, 1, "insert"), (5, 2, "supersede"), (5, 3, "purge"), (5, 4, "insert")]
    ch = spark.createDataFrame([(i, t, t, op, "x", 0.5) for i, t, op in rows], "id long, t int, seq int, op string, content string, importance double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(t)"))
    assert {r.id: r.invalid_at is None for r in lifecycle.fold(ch).collect()} == {1: True, 3: False, 4: True, 5: True}


def test_imports_near_stored_vectors_are_left_out(spark):
    rows = spark.createDataFrame([(1, "u", [1.0, 0.0]), (2, "u", [0.0, 1.0]), (3, "v", [1.0, 0.0]), (4, "u", None), (5, "u", [0.99, 0.05])], "place long, user_id string, embedding array<double>")
    stored = spark.createDataFrame([("u", [2.0, 0.01]), ("w", [0.0, 3.0])], "user_id string, embedding array<double>")
    assert sorted(r.place for r in upkeep.apart_from_stored(rows, stored).collect()) == [2, 3, 4]


def test_composed_context_names_each_memory_once_in_order(spark):
    blocks = spark.createDataFrame([(7, 2), (5, 1)], "id long, place int")
    told = spark.createDataFrame([(5, "a", 3), (5, "b", 9), (5, "c", 1), (7, "b", 9), (7, "d", 2), (8, "z", 9)], "entity_id long, id string, updated_at long")
    rest = spark.createDataFrame([("d", 0), ("e", 1), ("a", 2), ("c", 3)], "id string, place int")
    say = lambda b, t, m: [r.id for r in sorted(lifecycle.composed(b, t, m, 2).collect(), key=lambda r: r.place)]
    assert say(blocks, told, rest) == ["b", "a", "d", "e", "c"]
    assert say(blocks.where("false"), told, rest) == ["d", "e", "a", "c"] and say(blocks, told, rest.where("false")) == ["b", "a", "d"]


def test_who_survives_several_merges(spark):
    merges = spark.createDataFrame([(9, 4), (4, 2), (5, 6), (6, 5), (8, 7), (10, 7), (3, 3)], "keep long, merge long")
    got = {r.id: r.root for r in resolving.surviving(merges).collect()}
    assert got == {9: 9, 4: 9, 2: 9, 5: 5, 6: 5, 8: 8, 7: 8, 10: 8}


def test_a_whole_clean_up(spark):
    e = spark.createDataFrame([(1, "Ada Stone", None), (2, "Ada Stone", None), (3, "$40", None), (4, "Lost One", None), (5, "Told One", None), (6, "Old", 1), (7, "Once Forty", 3)], "id long, name string, merged_into long")
    e = e.withColumns({"entity_type": F.lit(None).cast("string"), "description": F.lit(None).cast("string")})
    m = spark.createDataFrame([(1, 100, "Ada"), (2, 101, "A. Stone"), (3, 100, "$40"), (5, 102, "Told")], "entity_id long, memory_id long, surface string")
    t = spark.createDataFrame([("e1", "knows", "e2", None), ("e2", "knows", "e5", None), ("e3", "costs", "e5", None)], "subject string, predicate string, object string, invalid_at timestamp_ntz")
    p = spark.createDataFrame([(1, 2, 1, "proposed"), (2, 4, 5, "proposed"), (3, 5, 1, "rejected"), (4, 3, 1, "proposed")], "id long, entity_a long, entity_b long, status string")
    facts = spark.createDataFrame([(2, "paints houses")], "id long, facts string")
    new = resolving.cleaned(e, m, t, p, facts, lambda c: F.concat(F.lit("e"), c.cast("string")), F.expr("timestamp_ntz'2024-01-01'"))
    rows = lambda name, *cs: sorted(map(tuple, new[name].select(*cs).collect()), key=str)
    # the one of equal names that has facts stays; the sum of money goes with its tombstone, and who is nowhere told goes
    assert rows("entities", "id", "merged_into") == [(1, 2), (2, None), (5, None), (6, 1)]
    assert rows("mentions", "entity_id", "surface") == [(2, "A. Stone"), (2, "Ada"), (5, "Told")]
    assert rows("relations", "subject", "object", F.col("invalid_at").isNull()) == [("e2", "e2", False), ("e2", "e5", True)]
    assert rows("proposals", "id", "entity_a", "entity_b", "status") == [(1, 2, 2, "confirmed"), (3, 5, 2, "rejected")]


def test_open_proposals(spark):
    e = spark.createDataFrame([(1, "Ada Smith", "person", None, None), (2, "Ada Smith", None, None, None), (3, "Ada Smith", "person", None, 1), (4, "Bob", None, None, None), (5, "Bob", None, None, None), (6, "Cy Young", None, None, None), (7, "Cy Young", None, None, None), (8, "X", None, None, 99)], "id long, name string, entity_type string, description string, merged_into long")
    facts = spark.createDataFrame([(1, "planning telescopes and gardens"), (2, "plans a telescope, a garden"), (4, "tall"), (6, "pitcher"), (7, "painter")], "id long, facts string")
    p = spark.createDataFrame([(10, 1, 2), (11, 3, 1), (12, 5, 4), (13, 6, 7), (14, 8, 1), (15, 4, 6), (16, 6, 4)], "id long, entity_a long, entity_b long").withColumn("status", F.lit("proposed"))
    say = lambda j: {r.id: (r.fate, r.keep, r["merge"]) for r in resolving.open_proposals(e, p, facts, j).collect()}
    got = say(None)
    assert got[10] == ("merged", 1, 2) and got[11][0] == "confirmed" and got[12] == ("merged", 4, 5) and got[13][0] == "kept" and got[14][0] == "rejected" and got[15][0] == "kept"
    judged = say(spark.createDataFrame([(7, 6, "same", 0.95), (2, 1, "different", 0.99), (4, 6, "different", 0.5)], "a long, b long, verdict string, confidence double"))
    assert judged[13][0] == "merged" and judged[10][0] == "rejected" and judged[15][0] == "kept"


def test_near_by_cooccurrence(spark):
    links = [(1, 10), (2, 10), (2, 11), (3, 11), (3, 12), (4, 12), (1, 13), (2, 13)]
    mentions = spark.createDataFrame(links, "entity_id long, memory_id long")
    dates = spark.createDataFrame([(m, m) for m in (10, 11, 12, 13)], "memory_id long, updated_at long")
    seeds = spark.createDataFrame([(1,)], "id long")
    got = {r.id: r.rank for r in resolving.near_by_cooccurrence(mentions, dates, seeds).collect()}
    of = lambda e: [m for x, m in links if x == e]
    adj, reached, front = {}, {1}, {1}
    for _ in range(2):
        new = set()
        for e in front:
            for m in of(e):
                others = [x for x, y in links if y == m]
                for a, b in itertools.permutations(others, 2):
                    adj.setdefault(a, {}).setdefault(b, 0)
                    adj[a][b] += 1
                new |= set(others) - reached
        reached |= new
        front = new
    rank = dict.fromkeys(reached, 0.0) | {1: 1.0}
    for _ in range(20):
        flow = {n: 0.15 * (n == 1) for n in rank}
        for a, out in adj.items():
            for b, w in out.items():
                flow[b] += 0.85 * rank[a] * w / sum(out.values())
        rank = flow
    assert got == pytest.approx({n: r for n, r in rank.items() if n != 1})
    typed = spark.createDataFrame([(1, 7)], "subject long, object long")
    assert [(r.id, r.hop) for r in resolving.expanded(typed, seeds, lambda: 1 / 0).collect()] == [(7, 1)]


def test_reconcile_by_hand(spark):
    now = F.expr("timestamp_ntz'2024-06-01 00:00:00'")
    m = spark.createDataFrame([("a", "likes tea", "u", 0.4, None), ("b", "lives in Rome", "u", 0.9, None), ("c", "old", "u", 0.1, "x")], "id string, content string, user_id string, importance double, superseded_by string")
    m = m.withColumns({"created_at": now, "updated_at": now, "seq": F.lit(1), "invalid_at": F.when(F.col("id") == "c", now)})
    new = spark.createDataFrame([("1", "Likes tea!", "u", 0.5), ("2", "likes green tea", "u", 0.8), ("3", "lives in Oslo", "u", 0.2), ("4", "x", "u", 0.3), ("5", "y", "v", 0.3)], "id string, content string, user_id string, importance double")
    d = spark.createDataFrame([("1", "DELETE", "a", None), ("2", "UPDATE", "a", " "), ("3", "DELETE", "b", None), ("4", "UPDATE", "c", "z"), ("5", "DELETE", "a", None)], "id string, action string, target string, new_content string")
    fates = reconciling.decided(new, m, d)
    assert {r.id: (r.action, r.target) for r in fates.collect()} == {"1": ("NONE", "a"), "2": ("UPDATE", "a"), "3": ("DELETE", "b"), "4": ("ADD", None), "5": ("ADD", None)}
    state = {r.id: (r.content, r.importance, r.superseded_by, r.invalid_at is None) for r in reconciling.state_after(m, fates, now).collect()}
    assert state["a"] == ("likes green tea", 0.8, None, True) and state["b"] == ("lives in Rome", 0.9, "3", False) and state["c"] == ("old", 0.1, "x", False) and len(state) == 6
    assert sorted((r.memory_id, r.event) for r in reconciling.events_of(fates, m).collect()) == [("3", "ADD"), ("4", "ADD"), ("5", "ADD"), ("a", "UPDATE"), ("b", "SUPERSEDE")]


@pytest.mark.parametrize("firsts", [8, 2])
def test_new_names_meet_within_a_batch(spark, monkeypatch, firsts):
    """Against a loop in order of arrival; one name has a third of all mentions."""
    import random

    monkeypatch.setattr(resolving, "FIRSTS", firsts)
    rng = random.Random(3)
    topics = [f"{w}{k}" for k in range(6) for w in ("gardening", "chess", "sailing", "baking")]
    rows = []
    for i in range(60):
        for name in {"Zed Koh"} | ({"Ann Lee"} if i % 2 else set()) | ({"Solo"} if i % 5 == 0 else set()):
            words_ = rng.sample(topics, 3)
            rows.append((i, name.lower(), name, rng.choice(["person", "place", None]), "" if rng.random() < 0.05 else f"{name} likes {' '.join(words_)}"))
    table = spark.createDataFrame(rows, "memory_id long, name string, surface string, entity_type string, content string")
    telling = {(r.memory_id, r.name): set(r.t) for r in table.select("memory_id", "name", text.context_words(F.col("content"), F.col("surface")).alias("t")).collect()}
    want, entities = set(), {}
    for i, name, surface, kind, content in sorted(rows):
        own = entities.setdefault(name, [])
        for first, known, empty in own:
            shared = telling[first, name] & telling[i, name]
            close = len(shared) >= 2 or (shared and max(map(len, shared)) >= 6 and len(shared) / max(1, min(len(telling[first, name]), len(telling[i, name]))) >= 0.12)
            if (known is None or kind is None or known == kind) and (empty or (len(surface.split()) >= 2 and close)):
                want.add((i, name, first, None))
                break
        else:
            want.add((i, name, i, own[0][0] if own else None))
            own.append((i, kind, content == ""))
    got = {tuple(r) for r in resolving.new_entities(table).collect()}
    assert got == want and max(map(len, entities.values())) > 3 and len({f for _, n, f, _ in want if n == "zed koh"}) > 2
    assert resolving.new_entities(table.where("false")).collect() == []


def test_strategies_by_loops(spark):
    import random

    rng = random.Random(9)
    near = {f"m{i:02}": round(rng.random(), 2) for i in range(40)}
    words_ = {f"m{i:02}": rng.choice([0.5, 1.5, 2.5]) for i in range(20, 60)}
    told = {(rng.randint(1, 25), f"m{rng.randint(0, 69):02}") for _ in range(130)}
    typed = [(f"s{rng.randint(1, 6)}", f"p{rng.randint(1, 25)}", f"m{rng.randint(0, 69):02}") for _ in range(40)] + [("s1", "p3", "m00")]
    seeds, k = {3, 4}, 10

    def fused(pool=None):
        out = {}
        for scores in (near, words_):
            for rank, m in enumerate(sorted((m for m in scores if pool is None or m in pool), key=lambda m: (-scores[m], m))):
                out[m] = out.get(m, 0) + 1 / (60 + rank)
        return out

    best = lambda scores: sorted(scores, key=lambda m: (-round(scores[m], 9), m))[:k]
    fill = lambda a, b: list(dict.fromkeys(a + b))[:k]
    want = {"hybrid": best(fused())}
    of = lambda m: {e for e, x in told if x == m}
    memories = set(near) | set(words_) | {m for e, m in told if e in seeds}
    want["hybrid+anchor"] = best({m: fused().get(m, 0) + 0.02 * len(of(m) & seeds) for m in memories})
    together = seeds | {e for _, m in told if of(m) & seeds for e in of(m)}
    want["graph"] = best(fused({m for e, m in told if e in together}))
    want["graph+hybrid"] = fill(want["graph"], want["hybrid"])
    first = {(e, m) for e in range(1, 26) for m in sorted(m for x, m in told if x == e)[:25]}
    links = {(a, b) for a, m in first for b, n in first if m == n and a != b}
    rank = {e: 0.5 for e in seeds}
    for _ in range(20):
        nxt = {e: 0.15 * 0.5 for e in seeds}
        for a, b in links:
            if a in rank:
                nxt[b] = nxt.get(b, 0) + 0.85 * rank[a] / sum(x == a for x, _ in links)
        rank = nxt
    want["ppr"] = best({m: sum(rank.get(e, 0) for e in of(m)) for _, m in told if any(e in rank for e in of(m))})
    both = typed + [(o, s, m) for s, o, m in typed]
    one = {v for u, v, _ in both if u in ("p3", "p4")}
    gold = {m for u, v, m in both if u in one and v not in ("p3", "p4")}
    pooled = fused(gold)
    want["typed2hop"] = fill(best({m: pooled.get(m, 0) for m in gold}), want["hybrid"])
    frame = lambda d: spark.createDataFrame(list(d.items()), "id string, score double")
    got = strategies.compared(frame(near), frame(words_), spark.createDataFrame(sorted(told), "entity_id long, id string"), spark.createDataFrame(typed, "subject string, object string, id string"), spark.createDataFrame([(e,) for e in seeds], "entity_id long"), F.concat(F.lit("p"), F.col("entity_id").cast("string")))
    by = {}
    for r in sorted(got.collect(), key=lambda r: r.place):
        by.setdefault(r.strategy, []).append(r.id)
    assert by == want


def test_all_aliases_in_all_texts(spark):
    """Against a loop of patterns: whole words, any case, signs around and between words, long aliases, the longest of an entity."""
    import re

    texts = {
        "1": "Ada Lovelace met ada.", "2": "adamant, ADA-LOVELACE", "3": "Ada  Lovelace and foo_bar", "4": "foo bar; foo (bar) .net asp.net", "5": None, "6": "",
        "7": "C++ and c# — Müller, MÜLLER-Lüdenscheid", "8": "one two three four five six seven eight", "9": "one two three four five six sevens", "10": "...ada", "11": "x" * 70_000 + " ada " + "y " * 50_000,
    }
    aliases = [(1, "Ada"), (1, "Ada Lovelace"), (2, "foo bar"), (2, "foo"), (2, "foo (bar)"), (3, ".net"), (3, "c++"), (4, "müller-lüdenscheid"), (4, "Müller"), (5, "one two three four five six seven"), (5, "one two"), (6, "++"), (6, " "), (7, "six"), (7, "two"), (8, "foo_bar"), (9, "nowhere")]
    want = set()
    for i, content in texts.items():
        for e in {e for e, _ in aliases}:
            own = sorted({a.strip() for x, a in aliases if x == e and re.search(r"\w", a)}, key=lambda a: (-len(a), a))
            best = next((a for a in own if re.search(rf"(?<!\w){re.escape(a)}(?!\w)", content or "", re.I)), None)
            want |= {(i, e, best)} if best else set()
    got = mentioning.found(spark.createDataFrame(list(texts.items()), "id string, content string"), spark.createDataFrame(aliases, "entity_id int, alias string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 12
    none = mentioning.found(spark.createDataFrame(list(texts.items()), "id string, content string"), spark.createDataFrame([], "entity_id int, alias string"))
    assert none.columns == got.columns and none.count() == 0


def test_a_memory_is_changed_once(spark):
    """The first to arrive keeps its target; those after it are facts of their own, and nothing they say is lost."""
    now = F.expr("timestamp_ntz'2024-06-01 00:00:00'")
    m = spark.createDataFrame([("a", "likes tea", "u", 0.4), ("b", "has a cat", "u", 0.4)], "id string, content string, user_id string, importance double")
    m = m.withColumns({"created_at": now, "updated_at": now, "seq": F.lit(1), "invalid_at": F.lit(None).cast("timestamp_ntz"), "superseded_by": F.lit(None).cast("string")})
    new = spark.createDataFrame([("z", 1, "said one", "u", 0.5), ("y", 2, "said two", "u", 0.5), ("x", 3, "said three", "u", 0.5), ("w", 4, "Has a cat.", "u", 0.5), ("v", 5, "has a dog", "u", 0.5)], "id string, seq int, content string, user_id string, importance double")
    d = spark.createDataFrame([("z", "UPDATE", "a", None), ("y", "UPDATE", "a", None), ("x", "DELETE", "a", None), ("w", "UPDATE", "a", None), ("v", "UPDATE", "b", None)], "id string, action string, target string, new_content string")
    fates = reconciling.decided(new, m, d, arrival="seq")
    assert {r.id: (r.action, r.target) for r in fates.collect()} == {"z": ("UPDATE", "a"), "y": ("ADD", None), "x": ("ADD", None), "w": ("NONE", "b"), "v": ("UPDATE", "b")}
    assert {r.content for r in reconciling.state_after(m, fates, now).collect()} == {"said one", "said two", "said three", "has a dog"}
    found = spark.createDataFrame([("z", "b", 0), ("y", "a", 0), ("w", "a", 0), ("v", "b", 1)], "query string, id string, place int")
    among = reconciling.decided(new, m, d, found, "seq")
    assert {r.id: (r.action, r.target) for r in among.collect()} == {"z": ("ADD", None), "y": ("UPDATE", "a"), "x": ("ADD", None), "w": ("ADD", None), "v": ("UPDATE", "b")}


def test_json_rows_and_cases(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"}]')
    (tmp_path / "b.json").write_text('{"id": "1"}\n{"id": "2"}\n')
    assert [store.read_rows(spark, str(tmp_path / f), "id string").count() for f in ("a.json", "b.json")] == [2, 2]
    (tmp_path / "c.jsonl").write_text('{"id": "x", "conversation": [{"role": "user", "content": "hi"}], "questions": []}\n')
    assert len(store.read_cases(spark, str(tmp_path / "c.jsonl")).first()["sessions"]) == 1


def test_backoff(spark):
    assert [one(spark, ingest.backoff(F.lit(n))) for n in (1, 3, 8, 50)] == [2, 8, 256, 256]
