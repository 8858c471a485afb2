"""The network against a word-by-word version, its gradient against differences, and very long texts."""

import collections
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reverie.llm import gru, gru_lm
from tests.conftest import DATA


def small(seed=0, hidden=5, dtype=np.float32):
    rng = np.random.default_rng(seed)
    w = gru.initial(np.arange(8) + 1.0, np.array([3.0, 4.0, 1.0]), 4, hidden=hidden)
    return w.over(rng.normal(0, 0.7, w.flat().size).astype(dtype))


def plain(w, words):
    """Natural logs of each word, one word at a time, in plain loops over the definition."""
    squash = lambda x: x / (1 + abs(x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    n, (groups, per) = w.u.shape[1], w.wb.shape
    h, out = np.zeros(n), []
    for word in map(int, words):
        cls = word // per if word < groups * per else word - groups * per + groups
        p = softmax(w.cw.astype(float) @ h + w.cb)[cls]
        if cls < groups:
            p *= softmax(w.ww[cls].astype(float) @ h + w.wb[cls])[word - cls * per]
        out.append(math.log(p))
        x, g = w.x.astype(float) @ w.embed[:, word], w.u.astype(float) @ h
        z, r = (0.5 + 0.5 * squash(x[k * n : k * n + n] + g[k * n : k * n + n]) for k in (0, 1))
        cand = squash(x[2 * n :] + r * g[2 * n :])
        h = z * h + (1 - z) * cand
    return out


@pytest.mark.parametrize("lanes, window", [(1, 3), (4, 16), (64, 7)])
def test_scores_are_those_of_a_word_by_word_model(lanes, window):
    rng, w = np.random.default_rng(1), small()
    docs = [rng.integers(0, 11, n) for n in (1, 40, 3, 17, 1, 90, 2)]
    assert gru.score(w, docs, lanes, window) == pytest.approx([sum(plain(w, d)) for d in docs], rel=1e-4)


def test_gradient_agrees_with_differences():
    rng, w = np.random.default_rng(2), small(3, 4, np.float64)
    run = gru.dealt([rng.integers(0, 11, n) for n in (9, 4, 5, 2)], 3)
    (k, place, there), *_ = run.windows(12)
    words, starts, h0 = run.words[place], run.starts[place], rng.normal(0, 0.3, (4, k))
    flat = w.flat()
    w, g = w.over(flat), np.zeros_like(flat)
    loss = lambda: -gru.gradients(w, h0.copy(), words, starts, there, w.over(np.zeros_like(flat)))[1] / there.sum()
    gru.gradients(w, h0.copy(), words, starts, there, w.over(g))
    own = g.copy()
    for i in range(len(flat)):
        was = flat[i]
        flat[i] = was + 1e-5
        up = loss()
        flat[i] = was - 1e-5
        assert own[i] == pytest.approx((up - loss()) / 2e-5, abs=2e-7)
        flat[i] = was


def test_a_very_long_text_beside_many_short_ones():
    rng, w = np.random.default_rng(4), small()
    docs = [rng.integers(0, 11, 300_000)] + [rng.integers(0, 11, 5) for _ in range(2_000)]
    tracemalloc.start()
    got = gru.score(w, docs, lanes=512, window=64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # a matrix of the longest text by the lanes would take 600 MB
    assert got[1:9] == pytest.approx([sum(plain(w, d)) for d in docs[1:9]], rel=1e-4)
    gru.train(w, docs[:1] + docs[1:50], lanes=32, window=256)


def test_query_against_a_plain_model(spark):
    """Every column of the query at the smallest scale, the score by the trained network word by word."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    held = gru_lm.fold_of(F.col("doc_id"), gru_lm.FOLDS) == gru_lm.HELD_OUT
    language, counts = gru_lm.counted(docs.where(~held))
    role = F.when(held, gru_lm.HELD).otherwise(gru_lm.round_of(F.col("doc_id")))
    numbered = gru_lm.numbered(docs.withColumn("role", role), language)
    language = gru_lm.train_network(numbered, language)
    got = {r.doc_id: r for r in gru_lm.score_numbered(numbered, language, counts).collect()}
    seen = gru_lm.query(spark, DATA).toPandas().set_index("doc_id")
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    c = collections.Counter()
    for d, t in texts.items():
        if got[d].role != gru_lm.HELD:
            c.update([*t, b""])
    n, v = sum(c.values()), len(c)
    others = [x for x in c if x.decode() not in language.vocabulary]
    shares = np.ones(gru_lm.OTHERS)
    for x in others:
        shares[gru_lm.other_class(x.decode())] += c[x] + 1
    for d, t in texts.items():
        words = [x.decode() for x in [*t, b""]]
        ids = [language.vocabulary[x] if x in language.vocabulary else gru_lm.VOCABULARY + gru_lm.other_class(x) for x in words]
        long = len(ids) > 200 and d % 10  # word by word takes long
        want = (gru.score(language.weights, [np.array(ids)])[0] if long else sum(plain(language.weights, ids))) / math.log(10)
        want += sum(math.log10((c[x.encode()] + 1) / shares[gru_lm.other_class(x)]) for x in words if x not in language.vocabulary)
        base = sum(math.log10((c[x.encode()] + 1) / (n + v + 1)) for x in words)
        assert got[d].score == pytest.approx(want, rel=1e-4) and got[d].base_score == pytest.approx(base, rel=1e-9)
        row = seen.loc[d]
        assert (row.n_tokens, row.n_known, row.train_tokens, row.held_out) == (len(words), sum(c[x.encode()] > 0 for x in words), n, got[d].role == gru_lm.HELD)
        assert row.base_score == pytest.approx(base, rel=1e-9) and row.score == pytest.approx(want, rel=1e-3)


def test_a_step_lies_in_one_piece():
    """The cost of a step of few lanes is that of its calls, so none may go row by row."""
    rng, w = np.random.default_rng(5), small()
    words, starts = rng.integers(0, 11, (7, 3)), np.zeros((7, 3), bool)
    starts[[0, 4], [2, 1]] = True
    states, x, held = gru._forward(w, w.x @ w.embed, rng.normal(0, 0.3, (5, 3)).astype(np.float32), words, starts)
    assert all(a[t].flags.c_contiguous and a[t].shape == (rows, 3) for a, rows in ((states, 5), (x, 15), (held, 5)) for t in range(7))
    assert not states[0, :, 2].any() and not states[4, :, 1].any() and states[4, :, 0].all() and len(states) == 8


@pytest.mark.parametrize("size", [1, 12, 40, 400])
def test_logits_of_any_size(size):
    """On either side of what counts as tame, and far beyond what an exponential holds."""
    rng, w = np.random.default_rng(6), small()
    for a in (w.cw, w.cb, w.ww, w.wb):
        a *= size
    assert gru._tame(w.cw, w.cb) == (size < 40)
    docs = [rng.integers(0, 11, n) for n in (30, 5)]
    with np.errstate(over="raise", invalid="raise"):
        got = gru.score(w, docs)
        gru.train(w, docs)
    plain_log = [sum(_logs(w, d)) for d in docs]
    assert got == pytest.approx(plain_log, rel=1e-4)


def test_blocks_change_nothing(monkeypatch):
    rng, w = np.random.default_rng(8), small(3, 4, np.float64)
    docs = [rng.integers(0, 11, n) for n in (30, 5, 19)]
    want, trained = gru.score(w, docs), gru.train(w, docs).flat()
    monkeypatch.setattr(gru, "BLOCK", 3)
    assert gru.score(w, docs) == pytest.approx(want) and gru.train(w, docs).flat() == pytest.approx(trained)


def _logs(w, words):
    """As plain, with logs of sums that hold any logit."""
    logs = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    groups, per = w.wb.shape
    run = gru.dealt([np.asarray(words)], 1)
    states, _, _ = gru._forward(w, w.x @ w.embed, np.zeros((w.u.shape[1], 1), np.float32), run.words[:, None], run.starts[:, None])
    for t, word in enumerate(map(int, words)):
        h = states[t, :, 0].astype(float)
        cls = word // per if word < groups * per else word - groups * per + groups
        yield logs(w.cw.astype(float) @ h + w.cb)[cls] + (logs(w.ww[cls].astype(float) @ h + w.wb[cls])[word - cls * per] if cls < groups else 0)


def test_endings_are_looked_at_once(monkeypatch):
    """Numbers and counts of a run's words come from whole columns; a word's class is worked out once for its ending."""
    words = [f"word{i}ng" for i in range(3_000)] + ["é", "a😀", "x"]
    language = gru_lm.Language({"": 3, "word7ng": 2, "é": 1}, {"": 0, "word7ng": 1}, np.ones(gru_lm.OTHERS), 6, 3, small())
    asked, plain_class = [], gru_lm.other_class
    monkeypatch.setattr(gru_lm, "other_class", lambda w: asked.append(w) or plain_class(w))
    numbers, counts = gru_lm._looker(language)(pa.array(words, pa.large_string()))
    assert len(asked) == 4
    assert numbers.tolist() == [language.vocabulary.get(w, gru_lm.VOCABULARY + plain_class(w)) for w in words]
    assert counts.tolist() == [language.known.get(w, -1) for w in words]
    empty = gru_lm._looker(language)(pa.array([], pa.large_string()))
    assert [len(a) for a in empty] == [0, 0]
