"""Names with many entities: rounds are few, and mentions meet candidates in bounded groups."""

import random

import pytest

from reverie.operators import alike, graph, resolving


def test_many_unlike_mentions_of_a_name_take_few_rounds(spark, monkeypatch):
    tables, kept = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, name: tables.append(name) or kept(df, name))
    rows = [(i, "zed koh", "Zed Koh", None, f"Zed Koh likes thing{i}a and thing{i}b") for i in range(60)]
    rows += [(100 + i, "zed koh", "Zed Koh", None, f"Zed Koh has thing{i}a with thing{i}b") for i in range(60)]
    table = spark.createDataFrame(rows, "memory_id long, name string, surface string, entity_type string, content string")
    got = sorted(tuple(r) for r in resolving.new_entities(table).collect())
    assert got == [(i, "zed koh", i, 0 if i else None) for i in range(60)] + [(100 + i, "zed koh", i, None) for i in range(60)]
    assert len(tables) < 10


@pytest.mark.parametrize("near", [0, 3, 100])
def test_first_candidate_by_loops(monkeypatch, near):
    monkeypatch.setattr(alike, "NEAR", near)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + [f"longer{i}" for i in range(30)]
    draw = lambda: " ".join(rng.sample(vocabulary, rng.randint(0, 9)))
    made, all_ = alike.Candidates(), []
    for i in range(60):
        all_.append((rng.choice(["a", "b", "c", None]), i > 30 and rng.random() < 0.1, draw()))
        made.add(*all_[-1])
    found = []
    for _ in range(300):
        kind, telling = rng.choice(["a", "b", "c", "d", None]), draw()
        same = lambda c, t: bool(s := set(c.split()) & set(t.split())) and (len(s) >= 2 or (max(map(len, s)) >= 6 and 1 / min(len(c.split()), len(t.split())) >= 0.12))
        want = next((k for k, (of, bare, c) in enumerate(all_) if (of is None or kind is None or of == kind) and (bare or same(c, telling))), None)
        found.append(made.first(kind, telling))
        assert found[-1] == want
    assert len(set(found)) > 10


@pytest.mark.parametrize(("group", "words"), [(2048, 500_000), (3, 12)])
def test_mentions_resolve_by_loops(spark, monkeypatch, group, words):
    """Names with many entities in many texts, in groups of any size; a memory may have a name in several forms."""
    monkeypatch.setattr(resolving, "GROUP", group)
    monkeypatch.setattr(resolving, "FIRSTS", group)
    monkeypatch.setattr(resolving, "WORDS", words)
    rng = random.Random(2)
    topics = [f"{w}{k}" for k in range(5) for w in ("gardening", "chess", "sailing", "baking")]
    draw = lambda k: " ".join(rng.sample(topics, k))
    names = ["ann lee", "zed koh", "solo"]
    entities = [(i, n := rng.choice(names), n, rng.choice(["person", "place", None]), None, float(rng.randint(1, 9)), rng.choice([None, None, "known"])) for i in range(40)]
    facts = {i: rng.choice(["", draw(2), draw(3)]) for i in range(40) if i % 9}
    texts = [(m, draw(rng.randint(0, 4)), [(n, n.title(), k) for n in rng.sample([*names, "new one"], 3) for k in rng.sample(["person", "place", None], rng.randint(1, 2))]) for m in range(50)]
    table = spark.createDataFrame(entities, "id long, name string, normalized string, entity_type string, merged_into long, updated double, description string")
    seen = spark.createDataFrame(texts, "memory_id long, content string, mentioned array<struct<name: string, surface: string, entity_type: string>>")
    none = spark.createDataFrame([], "entity_id long, memory_id long, surface string")
    got = {(r.memory_id, r.name): (r.entity_id, r.is_new, tuple(r.proposed)) for r in resolving.resolved_mentions(seen, table, none, graph.roots(table), spark.createDataFrame(sorted(facts.items()), "id long, facts string")).collect()}
    want = {}
    for m, content, mentioned in texts:
        for n, _, kind in mentioned:
            all_ = [e for e in entities if e[1] == n]
            for i, _, _, of, _, updated, said in all_:
                known = facts.get(i, "")
                if (of is None or kind is None or of == kind) and ((not known and not said) or (n != "solo" and alike.same_context(set(known.split()), set(content.split())))):
                    want.setdefault((m, n), []).append((-updated, i))
            want.setdefault((m, n), [])
    proposed = {n: tuple(e[0] for e in entities if e[1] == n) for n in names}
    assert got == {(m, n): (min(c)[1], False, ()) if c else (None, True, proposed.get(n, ())) for (m, n), c in want.items()}
    assert len({x[0] for x in got.values()}) > 8
