"""The queries of this subpackage and their SQL, by registered name."""

from __future__ import annotations

from pyspark.sql import functions as F

from reverie.llm import ball_kmeans, compression, digest_runs, gru_lm, hamming, hard_negatives, line_chunks, mixing, packing, span_hash, token_codes, url_rules, weighted_minhash
from reverie.llm.common import fold_of, load


def mix_targets(spark, sf_dir: str):
    """What op5 aims at, of every document; its copies are not for SQL."""
    return mixing.query(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def edited_texts(spark, sf_dir: str):
    """What op10 edits, of every document; its fingerprints are not for SQL."""
    return span_hash.query(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def base_scores(spark, sf_dir: str):
    """What op9's counts alone give, of every document; its network is not for SQL."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold_of(F.col("doc_id"), gru_lm.FOLDS) == gru_lm.HELD_OUT
    language, counts = gru_lm.counted(docs.where(~held))
    rows = gru_lm.numbered(docs.withColumn("role", F.when(held, gru_lm.HELD).otherwise(0)), language)
    known = gru_lm.with_rare_words(rows.where("ids IS NOT NULL").select("row", "doc_id", "role", "n_tokens", "n_known", "base", F.lit(0.0).alias("model")), rows, counts)
    return known.select("doc_id", (F.col("role") == gru_lm.HELD).alias("held_out"), "n_tokens", "n_known", F.lit(language.tokens).cast("long").alias("train_tokens"), F.round("base_score", 5).alias("base_score"))


SIZES = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS words FROM d GROUP BY source), w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
c AS (SELECT *, 2.0 * words / weight AS ratio, sum(2.0 * words) OVER o - 2.0 * words AS capped, sum(weight) OVER () - sum(weight) OVER o + weight AS left_ FROM w WINDOW o AS (ORDER BY 2.0 * words / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (1.5 * sum(words) OVER () - capped) / left_ AS level FROM c), f AS (SELECT min_by(level, ratio) AS level FROM l WHERE level <= ratio)
"""
TARGETS = SIZES + "SELECT doc_id, size, CAST(words AS BIGINT) AS source_size, round(CAST(least(2.0 * words, coalesce(weight * f.level, 2.0 * words)) AS DOUBLE), 3) AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, f"
EDITED = """WITH n AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS following FROM documents)
SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 2) || left(following, length(text) // 2)) AS edited_sha256 FROM n"""
BASE = r"""WITH t AS (SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS w FROM documents), long AS (SELECT doc_id, unnest(w) AS w FROM t),
held AS (SELECT doc_id FROM documents WHERE xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda d, j: CASE WHEN d & 1 = 1 THEN xor(d >> 1, CAST(3988292384 AS BIGINT)) ELSE d >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 7 = 2), c AS (SELECT w, count(*) AS n FROM long WHERE doc_id NOT IN (SELECT doc_id FROM held) GROUP BY 1), a AS (SELECT sum(n) AS n, count(*) AS v FROM c)
SELECT doc_id, doc_id IN (SELECT doc_id FROM held) AS held_out, count(*) AS n_tokens, count(c.n) AS n_known, CAST(any_value(a.n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c.n, 0) + 1) / (a.n + a.v + 1)::DOUBLE)), 5) AS base_score FROM long LEFT JOIN c USING (w), a GROUP BY doc_id"""

QUERIES = {
    "op1_multi_index_search": hamming.query,
    "op2_compression_quality": compression.query,
    "op3_line_chunks": line_chunks.query,
    "op4_token_codes": token_codes.query,
    "op5_entropy_mix": mixing.query,
    "op6_url_rules": url_rules.query,
    "op7_histogram_packing": packing.query,
    "op8_weighted_minhash": weighted_minhash.query,
    "op9_gru_lm": gru_lm.query,
    "op10_span_hash": span_hash.query,
    "op11_ball_kmeans": ball_kmeans.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_digest_runs": digest_runs.query,
    "mix_targets": mix_targets,
    "edited_texts": edited_texts,
    "lm_base_scores": base_scores,
}

ORACLES = {
    "op1_multi_index_search": hamming.ORACLE,
    "op3_line_chunks": line_chunks.ORACLE,
    "op6_url_rules": url_rules.ORACLE,
    "op11_ball_kmeans": ball_kmeans.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_digest_runs": digest_runs.ORACLE,
    "mix_targets": TARGETS,
    "edited_texts": EDITED,
    "lm_base_scores": BASE,
}
