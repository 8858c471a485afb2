"""Every training document trains the network, at any size."""

from pyspark.sql import functions as F

from reverie.llm import gru_lm


def test_network_trains_on_every_document(spark, monkeypatch):
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
    trained, plain = [], gru_lm.written
    monkeypatch.setattr(gru_lm, "written", lambda df, name, *a: trained.append(plain(df, name, *a)) or trained[-1])
    language, _ = gru_lm.learn(docs)
    seen = [f.agg(F.sum("tokens")).first()[0] for f in trained if "weights" in f.columns]
    assert len(seen) == gru_lm.ROUNDS and sum(seen) == language.tokens == 2 * n
