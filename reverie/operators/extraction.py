"""Facts out of model replies, and new facts against stored ones."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reverie.functions import scoring, text

FACTS = "struct<facts: array<struct<content: string, type: string, importance: string, categories: array<string>, relations: array<struct<subject: string, predicate: string, object: string>>>>>"


def _first_object(reply: str | None) -> str | None:
    """The first balanced JSON object in a reply that reads as JSON."""
    reply = reply or ""
    start = reply.find("{")
    while start >= 0:
        try:
            _, end = json.JSONDecoder().raw_decode(reply[start:])
            return reply[start : start + end]
        except ValueError:
            start = reply.find("{", start + 1)
    return None


def _rescued(replies: pd.Series) -> pd.Series:
    return replies.map(_first_object)


def replies(raw: DataFrame, reply: str = "reply") -> DataFrame:
    """raw with `facts`: its reply's JSON, without the fence around it; only replies that don't read as JSON go to Python."""
    bare = F.trim(F.regexp_replace(F.col(reply), r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", ""))
    tried = raw.withColumn("_json", bare)
    fine = F.expr("try_parse_json(_json)").isNotNull() & F.col("_json").startswith("{")
    good = tried.where(fine)
    bad = tried.where(F.coalesce(~fine, F.lit(True))).withColumn("_json", F.pandas_udf(_rescued, "string")(F.col(reply)))
    return good.unionByName(bad).withColumn("facts", F.from_json("_json", FACTS)["facts"]).drop("_json")


def candidates(parsed: DataFrame) -> DataFrame:
    """A row for each fact with content: kinds and importance made valid, predicates in one form, self relations dropped."""
    f = parsed.select(*[c for c in parsed.columns if c != "facts"], F.explode("facts").alias("f"))
    edges = F.filter(F.coalesce("f.relations", F.array().cast("array<struct<subject: string, predicate: string, object: string>>")), lambda r: text.normal(r["subject"]) != text.normal(r["object"]))
    named = F.transform(edges, lambda r: F.struct(F.trim(r["subject"]).alias("subject"), F.regexp_replace(text.normal(r["predicate"]), " +", "_").alias("predicate"), F.trim(r["object"]).alias("object")))
    keep = [c for c in parsed.columns if c != "facts"]
    return f.where(F.trim(F.coalesce("f.content", F.lit(""))) != "").select(*keep, F.trim("f.content").alias("content"), scoring.memory_type(F.col("f.type")).alias("memory_type"), scoring.importance(F.col("f.importance")).alias("importance"), "f.categories", named.alias("relations"))
