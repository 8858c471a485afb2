"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import functools
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reverie.llm import common, compression, gru, gru_lm, hamming, line_chunks, mixing, packing, span_hash, token_codes, url_rules, weighted_minhash
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, _gone string, score string, key string"
P1 = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
PASSAGE = "\n".join(f"shared line number {i * i}" for i in range(16))


def rows():
    texts = {
        0: P1, 1: P1, 2: P1 + " phi", 3: "", 4: None, 5: LONG, 6: LONG + " end", 7: "a b", 8: "a  B", 9: "word", 10: "intro\n" + PASSAGE + "\noutro x",
        11: "other\nthings\n" + PASSAGE + "\nfin", 12: "\n\n\n", 13: "é ß 😀 İ <|endoftext|> don't", 14: "the the the the the the the the",
    }
    out = [(i, t, "en", ["b", "a", None, "é"][i % 4], len(t or ""), 7, 1, "x", "y", "k") for i, t in texts.items()]
    out += [(None, P1, "en", None, 1, None, None, None, None, None), (20, "twice told tale of the same id and text here", "en", "a", 1, 1, 1, "", "", "")] * 2
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hamming(spark):
    rng = random.Random(3)
    base = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(400)] + [(i, 5) for i in range(400, 520)] + [(7, 9), (None, 1), (401, 5)]
    table = spark.createDataFrame(base, "id long, code long")
    got = collections.defaultdict(list)
    for r in hamming.nearest(table, table.where("id % 20 = 0"), 6).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.id))
    known = sorted({x for x in base if x[0] is not None})
    for q, code in known:
        if q % 20 == 0:
            want = sorted((bin((code ^ c) & (2**64 - 1)).count("1"), i) for i, c in known if i != q)[:6]
            assert got[q] == want
    empty = table.where("false")
    assert hamming.nearest(empty, empty).count() == 0
    two = spark.createDataFrame([(0, 1), (1, 3)], "id long, code long")
    assert [tuple(r) for r in hamming.nearest(two, two, 5).orderBy("query_id").collect()] == [(0, 1, 1, 1), (1, 1, 0, 1)]


def test_sign_codes(spark):
    table = spark.createDataFrame([(1, [0.5, -1.0, None, 2.0]), (2, None), (3, [])], "id long, v array<double>")
    assert [tuple(r) for r in hamming.sign_codes(table, "id", "v").orderBy("id").collect()] == [(1, 9), (2, 0), (3, 0)]
    with pytest.raises(Exception, match="more than 64"):
        hamming.sign_codes(spark.createDataFrame([(1, [1.0] * 65)], "id long, v array<double>"), "id", "v").collect()


def test_quality(spark, docs, none):
    good = [(100 + i, " ".join(random.Random(i).choices(P1.split(), k=40)), 1) for i in range(60)]
    bad = [(200 + i, "###".join(random.Random(i).choices(["buy", "now", "win", "$$$"], k=40)), 0) for i in range(60)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (100, 1), (5, None)], "doc_id long, quality int")
    model = compression.train(texts, labels)
    scored = {r.doc_id: r for r in compression.score_quality(texts, model).collect()}
    assert np.mean([scored[i].predicted == q for i, _, q in good + bad]) > 0.97
    out = compression.score_quality(docs, model).collect()
    assert len(out) == len(rows()) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text}) == 1
    assert compression.score_quality(none, model).count() == 0
    assert compression.train(none, labels).weights == (0.0, 0.0, 0.0)
    assert [r.predicted for r in compression.score_quality(docs.limit(1), compression.train(texts, labels.where("quality = 1"))).collect()] == [1]


def test_quality_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(compression, "SAMPLE_BYTES", 5_000)
    held, plain = [], compression.features
    monkeypatch.setattr(compression, "features", lambda t, good, bad: held.append(len(t.encode())) or plain(t, good, bad))
    texts = spark.createDataFrame([(i, f"é{i} " * 100) for i in range(200)], "doc_id long, text string")
    compression.train(texts, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int"))
    assert 0 < sum(held) <= 2 * 5_000  # what calibrates, of two classes
    many = [bytes([i % 250]) * 400 for i in range(2_000)]
    data = compression._dictionary([b"x", b"y"]), compression._dictionary(many)
    assert data[0] == b"xy" and 0 < len(data[1]) <= compression.DICTIONARY_BYTES


def brute_chunks(lines):
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        r = ((h[i - 1] if i else 0) % line_chunks.MODULUS * line_chunks.BASE + h[i] % line_chunks.MODULUS) % line_chunks.MODULUS
        long = any(len(x) >= line_chunks.LONG_CHUNK for x in lines[i : i + 2])
        if r % line_chunks.DIVISOR == 0 or long or i == len(lines) - 1:
            out.append((start, i + 1 - start))
            start = i + 1
    return out


def test_line_chunks(spark, docs, none):
    known = {r[0]: (r[1] or "").split("\n") for r in rows() if r[0] is not None}
    places = collections.defaultdict(list)
    for d, lines in known.items():
        for s, n in brute_chunks(lines):
            if n > 1 or len(lines[s]) >= line_chunks.LONG_CHUNK:
                places["\n".join(lines[s : s + n])].append((d, s, n))
    gone = {x for own in places.values() for x in sorted(own)[1:]}
    want = {d: "\n".join(x for i, x in enumerate(lines) if not any(g == d and s <= i < s + n for g, s, n in gone)) for d, lines in known.items()}
    out = line_chunks.drop_repeated_chunks(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == len(rows()) and {r._gone for r in got} == {"x", "", None}
    assert {r.doc_id: r.text for r in got if r.doc_id is not None} == want
    assert any(r.n_removed for r in got) and all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert line_chunks.drop_repeated_chunks(none).count() == 0


def test_a_long_line_goes_whatever_stands_around_it(spark):
    passage, short = "word " * 51, "a line that many texts share"
    texts = [f"one\ntwo\n{passage}\nthree", f"{passage}\n{short}", f"four\n{short}\n{passage}", f"{passage}and more", f"{short}\n\nfive"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_chunks.drop_repeated_chunks(docs).collect()}
    assert got == {0: texts[0], 1: short, 2: f"four\n{short}", 3: texts[3], 4: texts[4]}


@functools.lru_cache(maxsize=1)
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.word_bpe_path())


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_token_files(spark, docs, none, tmp_path):
    path = f"file://{tmp_path}/t"
    token_codes.write_token_files(docs, path, common.word_bpe_path(), shard_tokens=500)
    got = token_codes.read_token_files(spark, path).orderBy("start").collect()
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, want in zip(got, order, strict=True):
        assert (r.doc_id, r.start, bytes(r.ids)) == (want[0], start, raw(ids_of(want[1])))
        start += len(r.ids) // 4
    stream = b"".join(bytes(r.ids) for r in got)
    at = spark.createDataFrame([(i,) for i in (0, 3, start - 1, start, start // 2)], "position long")
    assert dict(map(tuple, token_codes.tokens_at(spark, path, at).collect())) == {i: int.from_bytes(stream[4 * i : 4 * i + 4], "little") for i in (0, 3, start - 1, start // 2)}
    token_codes.write_token_files(none, f"file://{tmp_path}/n", common.word_bpe_path())
    assert token_codes.read_token_files(spark, f"file://{tmp_path}/n").count() == 0


def test_shard_access():
    ids = np.random.default_rng(0).choice([3, 255, 256, 65_535, 65_536, 1 << 31], 200_000).astype("<u4")
    data = token_codes.encode_shard(ids, [None, 4], np.array([0, 9, len(ids)]))
    shard = token_codes.Shard.of(data)
    assert (shard.all() == ids).all() and shard.documents()[0] == [None, 4] and shard.documents()[1].tolist() == [0, 9, len(ids)]
    took = []
    shard.read = lambda at, size: took.append(size) or data[at : at + size]
    for at in np.random.default_rng(1).integers(0, len(ids), 400):
        took.clear()
        assert shard.get(int(at)) == ids[at]
        # a code byte, a block of the bitmap and a directory entry a level, of a shard of half a megabyte
        assert sum(took) <= token_codes.LEVELS * (1 + token_codes.RANK_BLOCK // 8 + 4)
    with pytest.raises(IndexError):
        shard.get(len(ids))


def test_one_access_reads_a_few_bytes_of_a_file(spark, docs, tmp_path, monkeypatch):
    path, took = f"file://{tmp_path}/t", []
    token_codes.write_token_files(docs, path, common.word_bpe_path())
    files = [r for r in spark.read.parquet(f"{path}/manifest").collect()]
    assert {r.file.rpartition("/")[2] for r in files} == {f for f in os.listdir(tmp_path / "t") if f.endswith(".dac")}
    plain = token_codes._Files.bytes_of
    monkeypatch.setattr(token_codes._Files, "bytes_of", lambda self, file, at, size: took.append(size) or plain(self, file, at, size))
    big = max(files, key=lambda r: r.size)
    (frame,) = token_codes._tokens_at(iter([pd.DataFrame({"base": [0], "file": [big.file], "at": [big["at"]], "position": [big.n_tokens - 2]})]))
    assert len(frame) == 1 and sum(took) < 400 < 100_000 < big.size


@pytest.mark.parametrize("text", ["a<|endoftext|>b <|ENDOFTEXT|> I'LL 's it's... &&&. Á é,\x1c\x85 İ. ΣΑΣ. '. .'s", "word.' c'.d é. ß! 10. 3.14.", " \n\x0b", "x" * 3000])
def test_words_to_ids(text):
    assert common.token_bytes([text, None], common.word_bpe_path()) == [raw(ids_of(text)), raw([1])]


def test_mixing(spark, docs, none):
    sized = [(r[0], r[3], len((r[1] or "").split())) for r in rows()]
    words = collections.Counter()
    for _, s, n in sized:
        words[s] += n
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:  # the contract's rounds
        left = 1.5 * sum(words.values()) - sum(target.values())
        now = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if now[s] > 2 * words[s]}
        if not over:
            target.update(now)
            break
        target.update({s: 2.0 * words[s] for s in over})
        free -= over
    table = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.copies_to_targets(table).collect()
    assert sum(r.n_rows for r in got) == len(rows())
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == words[r.source] and 0 <= r.copies <= 2 * r.n_rows
    again = mixing.copies_to_targets(table.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counted = collections.Counter((r.doc_id, r.text) for r in mixed.collect())
    assert max(counted.values()) <= 4
    assert mixing.mix(none).count() == 0 and mixing.copies_to_targets(none.select("doc_id", "source", "size")).count() == 0


def test_mix_of_rows_without_id_meets_targets(spark):
    """A class of many equal rows is no lump: its rows differ by one copy, none takes more than two, and rows are spread over tasks."""
    texts = ["one two three four five", "six seven eight nine ten", "a b c d e"]
    rows = [(None, texts[i % 3 if i % 2 else 0], "en", "z", i) for i in range(9000)] + [(i, " ".join("w" * (i % 30)), "en", "b", i) for i in range(3000)] + [(7, "x y", "en", "b", n) for n in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    table = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    target = {r.source: r.target for r in mixing.copies_to_targets(table).collect()}
    assert len(target) == 2 and 0.9 * 45000 < target["z"] < 1.2 * 45000 and target["z"] % 45000
    taken, copies = collections.Counter(), collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r.source] += len(r.text.split())
        copies[r.source, r.n_chars, r.doc_id] += 1
    assert max(copies.values()) == 2 and all(abs(taken[s] - t) <= 60 for s, t in target.items())


def test_the_query_spreads_equal_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 100)
    rows = [(None, "one two three four five", "en", "a", 1)] * 2000 + [(1, "x", "en", "b", 1), (1, "x", "en", "b", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.query(spark, str(tmp_path))
    each = got.select("doc_id", "taken", "target", F.spark_partition_id().alias("task")).collect()
    assert len(each) == 2002 and len({r.task for r in each if r.doc_id is None}) > 1
    assert {r.taken for r in each if r.doc_id is None} <= {0, 5, 10}
    assert abs(sum(r.taken for r in each if r.doc_id is None) - next(r.target for r in each if r.doc_id is None)) <= 5


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    table = spark.createDataFrame([(i, f"s{i % 4}", rng.randint(1, 40) ** 2) for i in range(3000)], "doc_id long, source string, size long")
    taken, target = collections.Counter(), {}
    for r in mixing.copies_to_targets(table, lane=64).collect():
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - t) < 0.001 * t + 50 for s, t in target.items())


def dense_rates(sizes, target, cap, base=1.0):
    """Rates min(cap, base * exp(l * size)) that meet the target, by bisection."""
    sizes = np.asarray(sizes, float)
    rate = lambda lam: np.minimum(cap, base * np.exp(np.clip(lam * sizes, -700, 700)))
    low, high = -50.0, 50.0
    for _ in range(300):
        lam = (low + high) / 2
        low, high = (lam, high) if (rate(lam) * sizes).sum() < target else (low, lam)
    return rate(low)


@pytest.mark.parametrize("share, cap", [(1.5, 2), (0.4, 2), (60.0, 500), (0.02, 3)])
def test_rates_are_the_dense_solution(spark, share, cap):
    rng = random.Random(6)
    rows = [(i, f"s{i % 3}", 0 if i % 50 == 0 else rng.randint(1, 30) ** (1 + i % 3)) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.copies_to_targets(table, share=share, cap=cap).toPandas()
    for _, own in got.groupby("source"):
        target, positive = own["target"].iloc[0], own[own["size"] > 0]
        assert (positive["rate"] * positive["size"]).sum() == pytest.approx(target, rel=1e-6)
        if target < cap * own["source_size"].iloc[0] * (1 - 1e-9):
            assert np.allclose(positive["rate"], dense_rates(positive["size"], target, cap), rtol=1e-4, atol=1e-9)
            assert positive["rate"].nunique() > 10  # tilted by document
        assert abs((own["copies"] * own["size"]).sum() - target) < 0.01 * target + 30


def test_base_rates_tilt_too(spark):
    table = spark.createDataFrame([(i, "a", 10 + i % 7, 1.5 if i % 2 else 0.5) for i in range(200)] + [(500, "b", 900, 1.0)], "doc_id long, source string, size long, base double")
    got = mixing.copies_to_targets(table, share=1.0, weights=(1,), cap=3).where("source = 'a'").toPandas()
    base = np.where(got["doc_id"] % 2, 1.5, 0.5)
    assert np.allclose(got["rate"], dense_rates(got["size"], got["target"].iloc[0], 3, base), rtol=1e-4)


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/x?y", "https://example.net", "x://net/", "y://b.org/fr/", "z://org/fr/#f", "https://example.com/de/1", "q://notexample.com/de/1", "http://cheap-pills.example.com/a", "spam.com/x", None, "", "://", "h://u/é\n/a", "x://a.net/en/", "x://a.net?q=/", "https://m.ads-track.io", "HTTP://EXAMPLE.NET/EN/"]
    pages = spark.createDataFrame([(i, u, "h", "p", 1) for i, u in enumerate(urls)] + [(3, urls[3], "h", "p", 2)], "page_id long, url string, host string, verdict string, best int")
    rules = url_rules.CONTRACT_RULES + url_rules.METHOD_RULES
    few = url_rules.judge_urls(pages, rules).select("page_id", "host", "path", F.col("best.name"), "verdict")
    got = sorted(map(tuple, few.collect()))
    assert len(got) == len(urls) + 1
    odd = pages.select("page_id", "url", *[F.lit(i).alias(c) for i, c in enumerate(("_h", "_p", "_best", "row", "token", "address", "regex"))])
    again = url_rules.judge_urls(odd, rules)
    assert sorted(map(tuple, again.select("page_id", "host", "path", F.col("best.name"), "verdict").collect())) == got and again.columns[2:9] == odd.columns[2:]
    by = {r[0]: r[1:] for r in got}
    assert by[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and by[1] == ("example.net", "", None, "allow")
    assert by[2][2:] == ("net/", "block") and by[3][2:] == by[4][2:] == ("org/fr/", "allow") and by[5][2:] == ("example.com/de/", "block")
    assert by[6][2:] == (None, "allow") and by[7][3] == by[15][3] == "block" and by[9] == by[10] == ("", "", None, "allow") and by[14][2] is None and by[16][2] == "net/"
    assert url_rules.judge_urls(pages.where("false"), rules).count() == 0 and url_rules.judge_urls(pages, ()).count() == len(urls) + 1


def test_thousands_of_pattern_rules_by_their_rarest_token(spark):
    rng = random.Random(13)
    words = ["com", "net", "img", "ads", "track", *(f"w{i}" for i in range(300))]
    pick = lambda: words[min(len(words) - 1, int(rng.expovariate(0.1)))]
    lines = set()
    while len(lines) < 3000:
        lines.add(rng.choice([lambda: f"||{pick()}{rng.randint(0, 40)}.{pick()}^", lambda: f"/{pick()}/*/{pick()}{rng.randint(0, 90)}.", lambda: f"@@||{pick()}.{pick()}/{pick()}/", lambda: f"-{pick()}^{pick()}*", lambda: f"|{pick()}.{pick()}/{pick()}|"])())
    rules = tuple(map(url_rules.pattern_rule, sorted(lines)))
    urls = [f"https://{pick()}{rng.choice(['', '', rng.randint(0, 40)])}.{pick()}/{pick()}/{pick()}/{pick()}{rng.randint(0, 90)}.{rng.choice(['gif', 'html'])}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge_urls(pages, rules).collect()}
    fitted, compiled = 0, [re.compile(r.regex) for r in rules]
    for i, u in enumerate(urls):
        address = u.removeprefix("https://")
        fits = [(r.tier, r.length, r.name, r.verdict) for r, x in zip(rules, compiled, strict=True) if x.search(address)]
        fitted += len(fits)
        assert (tuple(got[i].best) if got[i].best else None) == (max(fits) if fits else None)
    assert fitted > 30
    host, path = url_rules.url_parts(F.col("url"))
    tokens = pages.select(F.explode(url_rules.tokens_of(F.concat(host, path))).alias("token"))
    filed = {r.name: r.token for r in url_rules.filed_rules(spark, tokens, rules).collect()}
    held = collections.Counter(t for u in urls for t in set(re.findall("[A-Za-z0-9]+", u.removeprefix("https://"))))
    assert len(filed) == 3000 and all(filed[r.name] == min(r.tokens, key=lambda t: (held[t], t)) for r in rules if r.tokens)
    assert any(held[filed[r.name]] < max(held[t] for t in r.tokens) for r in rules if r.tokens)


def test_the_shipped_patterns_and_their_exceptions(spark, tmp_path):
    blocked = ["banner.shop.com/x", "a.adserver.b.net/", "h.com/pagead/x", "best-online-casino.com/", "cheap-pills-now.org/", "h.com/a/replica-watches/b", "h.com/get-keygen/", "h.com/free-spins-today", "h.com/ad/x/banner/", "h.com/wp-login.php", "win-big.com/my/prize", "h.com/download/a/b.exe", "h.com/impression/7/x.gif", "h.com/history/online-bingo-x"]
    clean = ["h.com/pageady/x", "bannerman.com/", "h.com/history/1/online-bingo/", "h.com/law/us/payday-loan-act", "h.com/wiki/keygen", "tracker.health.gov/", "h.com/spins-today", "h.com/wp-login.php/x", "h.com/download/a.exe.html", "adx.com/", "h.com/Warez/", "who.int/a/weight-loss-pills", "h.com/reading/banner", "h.com/en/1.html"]
    pages = spark.createDataFrame([(i, f"https://{u}") for i, u in enumerate(blocked + clean)], "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge_urls(pages, url_rules.METHOD_RULES).collect()}
    rules = [(r, re.compile(r.regex)) for r in url_rules.METHOD_RULES]
    assert len(rules) > 300 and all(r.tokens for r, _ in rules) and len({r.name for r, _ in rules}) == len(rules)
    for i, u in enumerate(blocked + clean):
        fits = [(r.tier, r.length, r.name, r.verdict) for r, x in rules if x.search(u)]
        assert (tuple(got[i].best) if got[i].best else None) == (max(fits) if fits else None)
        assert (u, got[i].verdict) == (u, "block" if i < len(blocked) else "allow")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    sql = duckdb.sql(url_rules.ORACLE.replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    want = url_rules.query(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(sql) == sorted(map(tuple, want))


def test_pattern_rules_derive_their_literals():
    rule = url_rules.pattern_rule
    assert rule("||ads.example.com^*/banner/").tokens == ("ads", "example", "com", "banner") and rule("ad*").tokens == () and rule("*x.y*").tokens == ()
    assert rule("@@||a.b/c|").tokens == ("a", "b", "c") and rule("@@||a.b/c|").verdict == "allow" and rule("|a.b").tokens == ("a",)
    fits = lambda line, address: bool(re.search(rule(line).regex, address))
    assert fits("||b.com^", "a.b.com/x") and fits("||b.com^", "b.com") and not fits("||b.com^", "ab.com/") and not fits("||b.com^", "b.com.net/")
    assert fits("/x/*.gif|", "h/x/y.gif") and not fits("/x/*.gif|", "h/x/y.gif/z") and fits("|b.", "b.com") and not fits("|b.", "a.b.com")


def test_packing(spark, docs, none):
    got = packing.pack(docs, common.word_bpe_path(), 512).collect()
    sequences, own = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        assert len(r.ids) == 4 * r.length
    for v in sequences.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= 512
    for d, _ in {(r[0], r[1]) for r in rows()}:
        copies = [raw(ids_of(r[1])) for r in rows() if r[0] == d]
        assert sorted(b"".join(copies)) == sorted(b"".join(x[1] for x in own[d]))
    assert packing.pack(none, common.word_bpe_path()).count() == 0


def test_histogram_packing():
    rng = random.Random(1)
    counts = collections.Counter(rng.choice([rng.randint(1, 2048), rng.randint(1, 300)]) for _ in range(20_000))
    placed = packing.pack_histogram(dict(counts))
    assert {n: sum(hi - lo for k, lo, hi, _, _ in placed if k == n) for n in counts} == dict(counts)
    lack, sequences = packing.padding(placed)
    assert lack < 0.02 * 2048 * sequences and len(placed) < 20_000
    assert packing.pack_histogram({}) == []


def near(one, two):
    grams = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (one.lower().split(), two.lower().split())]
    return sum((grams[0] & grams[1]).values()) / sum((grams[0] | grams[1]).values())


def idf_of(texts):
    """The operator's weight of each shingle, from distinct texts."""
    grams = lambda t: [tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))]
    distinct = {" ".join(t.lower().split()) for t in texts}
    df = collections.Counter(g for t in distinct for g in set(grams(t)))
    low, seldom = weighted_minhash.LEAST_IDF, weighted_minhash.SELDOM
    return grams, {g: low + (1 - low) * np.log(max(seldom, (n - 1) / len(distinct))) / np.log(seldom) for g, n in df.items()}


def test_weights_do_not_depend_on_the_number_of_texts(monkeypatch):
    """In a sketch with a hundred times the load a rare shingle keeps its weight, and one of a tenth of the texts its own."""
    monkeypatch.setattr(weighted_minhash, "WIDTH", 1 << 14)
    rng, rare, common = np.random.default_rng(4), [], []
    for n in (500, 5_000, 50_000):
        sketch = weighted_minhash._Sketch()
        for at in range(0, n, 500):
            own = [np.append(rng.integers(1 << 8, 1 << 32, 150, dtype=np.uint32), np.uint32(7)) if i % 10 == 0 else rng.integers(1 << 8, 1 << 32, 150, dtype=np.uint32) for i in range(min(500, n))]
            sketch.add(own, np.ones(len(own), np.int64))
        table = weighted_minhash._idf(sketch.table, sketch.docs)
        rare.append(float(np.mean(weighted_minhash.weighted(rng.integers(1 << 8, 1 << 32, 4000, dtype=np.uint32), table)[1])))
        common.append(float(weighted_minhash.weighted(np.array([7], np.uint32), table)[1][0]))
    assert min(rare) > 0.985 and rare[2] > 0.995
    low, seldom = weighted_minhash.LEAST_IDF, weighted_minhash.SELDOM
    assert common == pytest.approx([low + (1 - low) * np.log(0.1) / np.log(seldom)] * 3, abs=0.01)


def test_weights_of_shingles_decide(spark):
    """Classes by brute force over all pairs with TF-IDF weights, which here differ from those without."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    common_part, texts = [word() for _ in range(80)], []
    for _ in range(120):
        texts.append(" ".join(common_part + [word() for _ in range(rng.randint(6, 12))]))
    for i in range(60):
        own = [word() for _ in range(100)]
        texts.append(" ".join(own))
        for k in range(2):
            edited = list(own)
            for at in rng.sample(range(100), rng.randint(1, 5)):
                edited[at] = f"new{i}x{k}x{at}"
            texts.append(" ".join(edited))
    grams, idf = idf_of(texts)
    weight = [collections.Counter() for _ in texts]
    for i, t in enumerate(texts):
        for g in grams(t):
            weight[i][g] += idf[g]
    plain = [collections.Counter(grams(t)) for t in texts]
    jaccard = lambda x, y: sum((x & y).values()) / sum((x | y).values())
    pairs, unweighted = set(), set()
    for i in range(len(texts)):
        for j in range(i):
            if plain[i].keys() & plain[j].keys():
                if jaccard(weight[i], weight[j]) >= 0.8:
                    pairs.add((j, i))
                if jaccard(plain[i], plain[j]) >= 0.8:
                    unweighted.add((j, i))
    assert len(unweighted - pairs) > 20  # without the weights other pairs would pass
    table = spark.createDataFrame([*enumerate(texts)] + [(1000 + k, texts[130]) for k in range(40)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(table).collect()}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j, i in sorted(pairs):
        parent[max(root(i), root(j))] = min(root(i), root(j))
    wrong = [i for i in range(len(texts)) if got[i] != root(i)]
    assert len(wrong) <= 0.02 * len(texts), wrong  # bands find a pair at 0.8 with 99.8 %
    assert all(got[1000 + k] == got[130] for k in range(40))


def test_ids_beyond_floating_numbers_stay_whole(spark):
    big = (1 << 62) + 1
    table = spark.createDataFrame([(big, "one two three"), (None, "four"), (big + 2, "five six")], "doc_id long, text string").coalesce(1)
    want = {big, big + 2, None}
    assert {r.doc_id for r in weighted_minhash.near_duplicates(table).collect()} == {r.doc_id for r in span_hash.fingerprints(table).collect()} == {r.doc_id for r in packing.pack(table, common.word_bpe_path()).collect()} == want


def test_keep_one_loses_no_text(spark):
    a, b = P1, "entirely other words stand in this one text that nobody else has at all"
    table = spark.createDataFrame([(3, a, 1), (7, a, 2), (7, b, 3), (7, b, 3), (None, a, 4), (9, "", 5), (9, None, 6), (11, b + " more", 7), (12, " \n", 8), (7, "", 9), (14, None, 10)], "doc_id long, text string, one int")
    kept = sorted((r.doc_id or 0, r.text or "", r.one) for r in weighted_minhash.keep_one(table).collect())
    assert kept == sorted([(3, a, 1), (7, b, 3), (7, b, 3), (0, a, 4), (7, "", 9)])  # 11 is near b; texts without words are one class


def test_near_duplicates(spark, docs, none):
    got = [tuple(r) for r in weighted_minhash.near_duplicates(docs).collect()]
    assert len(got) == len(rows())
    by = {r[0]: r for r in got}
    assert by[0][1:3] == by[1][1:3] == (0, 2) and by[2][1] == 0 and by[6][1] == by[5][1] == 5 and by[8][1] == 7
    assert by[3][1:] == (3, 1, 0) and by[4][1:] == (4, 1, 0) and [r[1] for r in got if r[0] is None] == [None, None] and by[20][1:3] == (20, 2)
    assert weighted_minhash.near_duplicates(none).count() == 0
    kept = [r.doc_id for r in weighted_minhash.keep_one(docs).collect()]
    assert {1, 2, 6, 8}.isdisjoint(kept) and kept.count(None) == 2 and kept.count(20) == 2


def test_near_duplicates_of_a_large_group(spark):
    """Every text differs from the others, so that a few pivots must join all of them, and others that share a passage must stay apart."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, passage = [word() for _ in range(200)], [word() for _ in range(60)]
    texts = []
    for i in range(150):
        own = list(base)
        own[rng.randrange(200)] = f"edit{i}"
        texts.append(" ".join(own))
    texts += [" ".join([word() for _ in range(60)] + passage) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(table).collect()}
    for i, a in enumerate(texts):
        for j in range(i):
            if near(a, texts[j]) >= 0.8:
                assert classes[i] == classes[j]
    assert all(classes[i] == i for i in range(150, 210)) and {classes[i] for i in range(150)} == {0}


def test_consistent_samples_estimate_similarity():
    rng = np.random.default_rng(4)
    u = np.unique(rng.integers(0, 1 << 32, 4000).astype(np.uint32))
    a, b = u[:2000], u[1000:3000]
    with np.errstate(over="ignore"):
        one, two = (weighted_minhash.band_keys(x, np.ones(len(x))) for x in (a, a))
        assert (one == two).all() and not (weighted_minhash.band_keys(b, np.ones(len(b))) == one).all()
    assert weighted_minhash.similarity((a, np.ones(2000)), (b, np.ones(2000))) == pytest.approx(1 / 3)


def test_language_model(spark, docs, none):
    learn_on = docs.where("doc_id <> 5 OR doc_id IS NULL")
    language, counts = gru_lm.learn(learn_on)
    c = collections.Counter()
    for r in rows():
        if r[0] != 5:
            c.update((r[1] or "").encode().lower().split() + [b""])
    n, v = sum(c.values()), len(c)
    assert (language.tokens, language.types) == (n, v)
    got = gru_lm.score(docs, language, counts).collect()
    assert len(got) == len(rows())
    want = sorted((r[0] is not None, r[0] or 0, len(t), sum(c[x] > 0 for x in t), round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in t), 4)) for r in rows() for t in [(r[1] or "").encode().lower().split() + [b""]])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert gru_lm.score(none, language, counts).count() == 0
    unseen, nothing = gru_lm.learn(none)
    assert {r.n_known for r in gru_lm.score(docs, unseen, nothing).collect()} == {0}


def test_network_gradient_and_probabilities():
    rng = np.random.default_rng(0)
    w = gru.initial(np.arange(8) + 1.0, np.array([3.0, 4.0]), 4, hidden=5)
    w = w.filled(rng.normal(0, 0.5, w.flat().size))
    total = sum(np.exp(gru.score(w, [np.array([3, 9, 1, k], np.int32)])[0] - gru.score(w, [np.array([3, 9, 1], np.int32)])[0]) for k in range(10))
    assert total == pytest.approx(1, abs=1e-4)
    whole = gru.score(w, [np.tile(np.array([3, 9, 1, 7], np.int32), 60), np.array([2], np.int32)], window=16)
    assert whole[0] == pytest.approx(gru.score(w, [np.tile(np.array([3, 9, 1, 7], np.int32), 60)], window=1000)[0], rel=1e-5)


def test_fingerprints(spark, docs, none):
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = collections.Counter(tuple(r)[:5] for r in span_hash.fingerprints(docs).collect())
    show = lambda t: span_hash.fingerprint(span_hash.PrefixHash(t))
    want = collections.Counter()
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        text, after = r[1] or "", after[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want[r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), show(text), show(edited)] += 1
    assert got == want
    assert span_hash.fingerprints(none).count() == 0
    one = span_hash.fingerprints(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_extensions_and_likeness():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abé😀", k=rng.randint(0, 50))) for _ in range(2))
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        back = next((k for k in range(min(i, j)) if a[i - 1 - k] != b[j - 1 - k]), min(i, j))
        h, g = span_hash.PrefixHash(a), span_hash.PrefixHash(b)
        assert h.extension(i, g, j) == n and h.extension_back(i, g, j) == back
    like = lambda x, y: span_hash.likeness(span_hash.fingerprint(span_hash.PrefixHash(x)), span_hash.fingerprint(span_hash.PrefixHash(y)))
    text = " ".join(str(i) for i in range(3000))
    assert like(text, text) == 1 and like("", "") == 1 and like(text, "") == 0 and like(text, text[::-1]) < 0.05
    assert like(text, text[:5000] + "x" + text[5000:]) > 0.9 and like(text, text[:5000] + "#" + text[5001:]) > 0.9 and 0.4 < like(text, text[: len(text) // 2] + "q" * (len(text) // 2)) < 0.6


def test_agreement_finds_shared_spans():
    like = lambda x, y: span_hash.agreement(span_hash.PrefixHash(x), span_hash.PrefixHash(y))
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefghijklmnop ", k=6400))
    assert like("abcdefg", "abcdefh") == pytest.approx(6 / 7) and like("abcdefgh", "xbcdefgh") == pytest.approx(7 / 8)
    spread = list(text)
    for at in range(100, 6400, 200):
        spread[at] = "#"
    assert like(text, "".join(spread)) == pytest.approx(1 - 32 / 6400)
    inserted = text[:50] + "#" + text[50:3000] + "#" + text[3000:6300] + "#" + text[6300:]
    assert like(text, inserted) == pytest.approx(6400 / 6403)
    moved = text[3200:] + text[:3200]
    assert 0.49 < like(text, moved) < 0.52
    other = "".join(random.Random(10).choices("abcdefghijklmnop ", k=6400))
    assert like(text, other) < 0.01 and like(text, text) == 1 and like("", "") == 1 and like("", "a") == 0
    assert like("ab" * 4000, "ab" * 3000) == pytest.approx(0.75) and like("a" * 5000, "a" * 2000 + "b" + "a" * 2999) > 0.99


def test_agreement_is_never_above_the_longest_common_subsequence():
    rng = random.Random(11)
    for _ in range(60):
        x, y = ("".join(rng.choices("ab", k=rng.randint(1, 60))) for _ in range(2))
        row = [0] * (len(y) + 1)
        for p in x:
            before = 0
            for j, q in enumerate(y, 1):
                row[j], before = (before + 1 if p == q else max(row[j], row[j - 1])), row[j]
        got = span_hash.agreement(span_hash.PrefixHash(x), span_hash.PrefixHash(y)) * max(len(x), len(y))
        assert got <= row[-1] + 1e-9


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = "".join(random.Random(12).choices("abé😀", k=3000))
    whole = span_hash.PrefixHash(text)
    monkeypatch.setattr(span_hash, "PIECE", 37)
    pieces = span_hash.PrefixHash(text)
    assert all((a == b).all() for a, b in zip(whole.prefix, pieces.prefix, strict=True)) and all((a == b).all() for a, b in zip(whole.seeds(16), pieces.seeds(16), strict=True))
    value = sum((ord(c) + 1) * pow(span_hash.BASES[1], j, span_hash.PRIMES[1]) for j, c in enumerate(text)) % span_hash.PRIMES[1]
    assert int(whole.prefix[1][-1]) == value


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = common.written(stage(spark, before, DATA), "t")
        if name != "packed":
            assert kept.columns == docs.columns and 0 < kept.count()
        if name in ("quality", "line_dedup", "near_dedup"):
            assert kept.count() <= before.count() and kept.join(before, "doc_id", "left_anti").count() == 0
    assert kept.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert corpus_pipeline.run(spark, DATA).count() == kept.count()
    assert os.path.exists(os.path.join(os.path.dirname(corpus_pipeline.__file__), "corpus_pipeline.py"))


def test_fold_matches_crc(spark):
    got = spark.range(30).select("id", common.fold_of(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


@pytest.mark.parametrize("rows_there", [True, False])
def test_stages_on_odd_rows(spark, docs, none, rows_there):
    kept = docs if rows_there else none
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, common.written(stage(spark, kept, DATA), "odd")
        if name != "packed":
            assert kept.columns == docs.columns
            assert kept.select("_gone", "score").subtract(docs.select("_gone", "score")).count() == 0
        if name == "near_dedup" and rows_there:
            assert kept.where("doc_id IS NULL").count() == before.where("doc_id IS NULL").count()
    assert (kept.count() > 0) == rows_there
