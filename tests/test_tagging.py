"""Tags above tags and synonyms, against loops."""

import random

import numpy as np

from reverie.operators import tagging


def test_parents_and_merges_as_in_a_loop(spark):
    rng = random.Random(7)
    names = [f"t{i}" for i in range(14)]
    tags = {u: rng.sample(names, 12 if u != "poor" else 4) for u in ("a", "b", "c", "poor")}
    synthetic = {u: rng.sample(names, 2) + ["Up"] for u in ("a", "b")}
    clusters = [(u, p, rng.choice([" New ", "new", "up", "", None, "other", "third", "t1", "t9", "fourth", "fifth", "sixth"]), [rng.choice([" T%d ", "t%d"]) % rng.randint(0, 16) for _ in range(rng.randint(0, 5))] + ([None] if p % 5 == 0 else [])) for u in tags for p in range(25)]
    frame = lambda d: spark.createDataFrame([(u, x) for u, xs in d.items() for x in xs], "user_id string, tag string")
    asked = spark.createDataFrame(clusters, "user_id string, pos int, tag string, members array<string>")
    form = lambda x: (x or "").strip().lower()
    want = set()
    for u, own in tags.items():
        out = []
        for _, _, tag, members in [c for c in clusters if c[0] == u]:
            up, tag = {form(x) for x in synthetic.get(u, [])}, form(tag)
            real = list(dict.fromkeys(form(m) for m in members if form(m) in own and form(m) not in up))
            if tag and tag not in own and tag not in up and tag not in [t for t, _ in out] and len(real) >= 2 and len(out) < 5 and len(own) >= 6:
                out.append((tag, tuple(real)))
        want |= {(u, t, m) for t, m in out}
    got = tagging.valid_parents(asked, frame(tags), frame(synthetic)).collect()
    assert {(r.user_id, r.tag, tuple(r.members)) for r in got} == want and len(want) > 6
    edges = tagging.parent_edges(tagging.valid_parents(asked, frame(tags), frame(synthetic)), spark.createDataFrame([], "user_id string, broader string, narrower string"))
    assert {tuple(r) for r in edges.collect()} == {(u, t, m) for u, t, ms in want for m in ms}

    obvious = {u: rng.sample(names, 2) for u in ("a", "c")}
    merged = []
    for u, own in tags.items():
        used = {form(x) for x in obvious.get(u, [])}
        for _, _, canonical, variants in [c for c in clusters if c[0] == u]:
            free = list(dict.fromkeys(form(v) for v in variants if form(v) in own and form(v) not in used))
            if len(free) >= 2:
                merged.append((u, form(canonical) if form(canonical) in free else free[0], tuple(free)))
                used |= set(free)
    renamed = asked.withColumnsRenamed({"tag": "canonical", "members": "variants"})
    assert sorted((r.user_id, r.canonical, tuple(r.variants)) for r in tagging.valid_merges(renamed, frame(tags), frame(obvious)).collect()) == sorted(merged) and len(merged) > 6
    nothing = frame({})
    assert tagging.valid_parents(asked, nothing, nothing).count() == 0 and tagging.valid_merges(renamed, nothing, nothing).count() == 0


def test_clusters_as_in_a_loop(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(4, 5))
    rows = [(u, f"t{i:02}", (middle[i % 4] + rng.normal(0, 0.3, 5)).tolist(), int(rng.integers(1, 9))) for u in ("u", "v") for i in range(14)] + [("u", "none", None, 3), ("w", "only", [1.0] * 5, 1)]
    want = {}
    for u in ("u", "v", "w"):
        now = {t: (np.array(v), n) for x, t, v, n in rows if x == u and v}
        of = {t: t for x, t, _, _ in rows if x == u}
        while True:
            unit = {t: v / np.linalg.norm(v) for t, (v, _) in now.items()}
            near = {t: min((-round(float(unit[t] @ unit[o]), 9), o) for o in now if o != t) for t in now} if len(now) > 1 else {}
            pairs = [(t, o) for t, (s, o) in near.items() if t < o and near[o][1] == t and -s >= 0.5]
            if not pairs:
                break
            for t, o in pairs:
                (a, n), (b, m) = now[t], now.pop(o)
                now[t] = ((a * n + b * m) / (n + m), n + m)
                of = {x: t if c == o else c for x, c in of.items()}
        want |= {(u, t): c for t, c in of.items()}
    table = spark.createDataFrame(rows, "user_id string, tag string, embedding array<double>, n int")
    got = {(r.user_id, r.tag): r.cluster for r in tagging.tag_clusters(table, 0.5).collect()}
    assert got == want and 3 < len(set(got.items())) and len({c for (u, _), c in got.items() if u == "u"}) < 9
    proposed = tagging.proposed_parents(table, 0.5).collect()
    assert all(len(r.members) >= 2 and r.tag == f"{r.members[0]} (group)" for r in proposed) and {r.user_id for r in proposed} == {"u", "v"}
