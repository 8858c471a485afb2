"""Registered queries without SQL, whole results on the smallest tables, against plain versions of what they say."""

import collections
import zlib

import numpy as np
import pytest

import corpus_pipeline
from reverie.llm import common, compression, mixing, span_hash, weighted_minhash
from reverie.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.test_operators import ids_of, idf_of, raw


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def test_token_files_against_the_library(spark, texts):
    got, start = {r.doc_id: r for r in QUERIES["op4_token_codes"](spark, DATA).collect()}, 0
    for d in sorted(texts):
        ids = ids_of(texts[d])
        assert tuple(got[d])[:4] == (d, start, len(ids), zlib.crc32(raw(ids)))
        start += len(ids)
    assert len(got) == len(texts)


def test_packing_against_the_library(spark, texts):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in QUERIES["op7_histogram_packing"](spark, DATA).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for d, own in pieces.items():
        ids, at = ids_of(texts[d]), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(raw(ids[at : at + r.length])))
            at += r.length
        assert at == len(ids)
    pad = 0
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
        pad += 0 if end & (end - 1) == 0 else 2048 - end
    assert pad <= 2048 + 0.02 * 2048 * len(sequences)


def test_quality_scores_by_hand(spark, texts):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = compression.train(docs, labels)
    for r in QUERIES["op2_compression_quality"](spark, DATA).collect():
        data = texts[r.doc_id].encode()
        sizes = [sum(len(compression._compressor(d).compress(data[i : i + compression.BLOCK])) for i in range(0, len(data), compression.BLOCK)) for d in (model.bad, model.good)]
        odds = np.dot(model.weights, [1, (sizes[0] - sizes[1]) / len(data) if data else 0, 1 / (1 + len(data) / compression.SHORT_BYTES)])
        assert r.score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9) and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_near_duplicates_by_all_pairs(spark, texts):
    grams, idf = idf_of([t for t in texts.values() if t.split()])
    weight = {}
    for d, t in texts.items():
        if t.split():
            weight[d] = collections.Counter()
            for g in grams(t):
                weight[d][g] += idf[g]
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(weight)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = weight[a], weight[b]
            if x.keys() & y.keys() and sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: r.class_id for r in QUERIES["op8_weighted_minhash"](spark, DATA).collect()}
    assert [d for d in texts if got[d] != root(d)] == []


def test_fingerprints_by_hand(spark, texts):
    order = sorted(texts)
    got = {r.doc_id: r for r in QUERIES["op10_span_hash"](spark, DATA).collect()}
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        t, n = texts[d], len(texts[d]) // 2
        edited, r = t[: len(t) - n] + texts[after][:n], got[d]
        one, two, three = map(span_hash.PrefixHash, (t, edited, texts[after]))
        assert (r.fingerprint, r.edited_fingerprint) == (span_hash.fingerprint(one), span_hash.fingerprint(two))
        # a spliced text has no seeds over its seam; that can cost a few code points
        assert r.near_next == pytest.approx(span_hash.agreement(one, three)) and r.near_edited == pytest.approx(span_hash.agreement(one, two), abs=0.02 + 64 / max(1, len(t)))
        assert r.near_edited >= (len(t) - n) / max(1, len(t), len(edited)) - 1e-9


def test_pipeline_stage_by_stage(spark):
    """Each stage's rows from those of its predecessor, by the operator's own decisions."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {"": docs}
    before = ""
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = common.written(stage(spark, kept[before], DATA), "t")
        before = name
    rows = lambda df: collections.Counter(map(tuple, df.collect()))
    model = compression.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scored = {r.doc_id: r.predicted for r in compression.score_quality(docs.select("doc_id", "text"), model).collect()}
    assert rows(kept["quality"]) == collections.Counter({k: n for k, n in rows(docs).items() if scored[k[docs.columns.index("doc_id")]]})
    classes = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(kept["line_dedup"]).collect()}
    blank = sorted(r.doc_id for r in kept["line_dedup"].collect() if not (r.text or "").split())
    classes.update(dict.fromkeys(blank, blank[0]) if blank else {})
    assert rows(kept["near_dedup"]) == collections.Counter({k: n for k, n in rows(kept["line_dedup"]).items() if classes[k[0]] == k[0]})
    sized = kept["near_dedup"].select("doc_id", "source", mixing.word_count(kept["near_dedup"]["text"]).alias("size"))
    copies = {r.doc_id: r.copies for r in mixing.copies_to_targets(sized).collect()}  # ids are distinct here
    assert rows(kept["mixture"]) == collections.Counter({k: n * copies[k[0]] for k, n in rows(kept["near_dedup"]).items() if copies[k[0]]})
    ids = collections.Counter()
    for r in kept["mixture"].collect():
        ids[r.doc_id, len(ids_of(r.text))] += len(ids_of(r.text))
    got = collections.Counter()
    for r in kept["packed"].collect():
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == ids
