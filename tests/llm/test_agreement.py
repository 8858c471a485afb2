"""near_edited and near_next find equal spans at any offset, in texts of any length."""

import random

import pytest

from reverie.llm import span_hash


def agreed(a, b):
    return span_hash.agreement(span_hash.PrefixHash(a), span_hash.PrefixHash(b))


def brute(a, b):
    """Longest common subsequence, which no alignment exceeds."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[j - 1]))
        row = new
    return row[-1] / max(len(a), len(b), 1)


def test_agreement_at_any_offset():
    text = " ".join(str(i * i) for i in range(4_000))[:30_000]
    assert agreed(text, text[:90] + "inserted " + text[90:-70] + " added" + text[-70:]) > 0.999
    edits = list(text)
    for i in range(400, len(text), 900):
        edits[i] = "#"
    assert 0.99 < agreed(text, "".join(edits)) < 1
    assert agreed(text, text) == agreed("", "") == 1 and agreed(text, "") == 0 and agreed(text, "#" * 300) == 0
    assert agreed(text, text[:10_000] + text[20_000:]) == pytest.approx(2 / 3, abs=0.01)
    assert agreed("the " * 500, "the " * 200 + "a " + "the " * 300) > 0.99


def test_agreement_stays_under_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(150):
        a = "".join(rng.choices("ab\u00e9\U0001f600", k=rng.randint(0, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choices("abx", k=rng.randint(0, 3))
        b = "".join(b)
        got = agreed(a, b)
        assert (got <= brute(a, b) + 1e-9 or not a + b) and (got == 1) == (a == b)


@pytest.mark.parametrize("n", range(2, 15))
def test_short_texts(spark, n):
    rows = [(1, "abcdefghijklmn"[:n]), (2, "opqrstuvwxyz!?"[:n])]
    got = {r.doc_id: r for r in span_hash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_edited == got[2].near_edited == (n - n // 2) / n and got[1].near_next == 0


def test_query_columns_read_the_prefix_arrays(spark):
    text = " ".join(str(i * i) for i in range(4_000))[:30_000]
    rows = [(1, text), (2, "an extra word " + text[:-50] + "another one" + text[-50:])]
    got = span_hash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert min(r.near_next for r in got) > 0.999
