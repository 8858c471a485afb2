"""The pipeline drops repeated passages whole."""

import random

import corpus_pipeline
from tests.conftest import DATA


#: Blank lines, braces and bullets that texts share.
SHORT = {
    70: "Intro one\n\n\nBody of one", 71: "Intro two\n\n\nBody of two", 72: "}\n\nx = 1\n}\n\ny = 2", 73: "}\n\nz = 1\n}\n\nw = 2",
    74: "- one\n- two\n- three", 75: "- zero\n- one\n- two", 76: "\n" * 300, 77: "\n" * 200 + "end",
}


def test_line_dedup_drops_whole_passages(spark):
    """Passages of one long line, and of several, in otherwise different documents, wherever cuts would fall."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [[line(60)], [line(8), line(8)], [line(5) for _ in range(9)], [line(60), line(3)]]
    texts, rest = {0: "\n".join(x for p in passages for x in (line(6), *p))}, {}
    for d in range(1, 41):
        before, after = [line(6) for _ in range(d % 4)], [line(6) for _ in range(1 + d % 3)]
        texts[d], rest[d] = "\n".join([*before, *passages[d % 4], *after]), "\n".join([*before, *after])
    a, p = line(12), "\n".join((line(9), "", line(9)))
    texts |= {50: "\n".join([a] * 5), 51: "x\ny", 52: "y\nx", **SHORT}
    same_id = [(60, f"{p}\n1"), (60, f"r\n{p}\n2"), (60, f"{p}\n1")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in [*texts.items(), *same_id]], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.line_dedup(spark, docs, DATA).collect()
    got = {r.doc_id: r.text for r in rows if r.doc_id != 60}
    assert got == {0: texts[0], **rest, 50: f"{a}\n{a}", 51: "x\ny", 52: "y\nx", **SHORT} and all(r.n_chars == len(r.text) for r in rows)
    assert sorted(r.text for r in rows if r.doc_id == 60) in (["1", "1", f"r\n{p}\n2"], [f"{p}\n1", f"{p}\n1", "r\n2"])
