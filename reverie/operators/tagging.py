"""Tags above tags and synonyms among them: proposals as data, validated, and a proposer that needs no model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reverie.functions import text
from reverie.operators import bulk_search, graph


def _of(known: DataFrame, tag: str) -> DataFrame:
    """user_id and the tag's form of known (user_id, tag), without empty ones, under another name."""
    return known.select("user_id", text.normal(F.col("tag")).alias(tag)).where(F.col(tag) != "").distinct()


def valid_parents(clusters: DataFrame, tags: DataFrame, synthetic: DataFrame, min_tags: int = 6, min_members: int = 2, most: int = 5) -> DataFrame:
    """user_id, tag, members, place of clusters (user_id, pos, tag, members) that may become parents of tags (user_id, tag).

    Tags compare trimmed and in lower case. A parent is new: no tag of its user, and none of synthetic (user_id,
    tag: parents that are there). Members are tags of the user, none of them synthetic, each once, in order; with fewer than
    min_members the cluster is none. Of equal parents the first valid one counts, and of a user's
    the first `most`. Users of fewer than min_tags tags have none.
    """
    known = _of(tags, "m")
    rich = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_tags).select("user_id")
    asked = clusters.select("user_id", "pos", text.normal(F.coalesce("tag", F.lit(""))).alias("tag"), "members").where("tag <> ''").join(rich, "user_id", "left_semi")
    for taken in (known.withColumnRenamed("m", "tag"), _of(synthetic, "tag")):
        asked = asked.join(taken, ["user_id", "tag"], "left_anti")
    each = asked.select("user_id", "pos", "tag", F.posexplode("members").alias("at", "m")).withColumn("m", text.normal(F.col("m")))
    real = each.join(known, ["user_id", "m"], "left_semi").join(_of(synthetic, "m"), ["user_id", "m"], "left_anti")
    once = real.groupBy("user_id", "pos", "tag", "m").agg(F.min("at").alias("at"))
    grouped = once.groupBy("user_id", "pos", "tag").agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("members")).where(F.size("members") >= min_members)  # those of one cluster
    first = grouped.groupBy("user_id", "tag").agg(F.min_by(F.struct("pos", "members"), "pos").alias("c")).select("user_id", "tag", "c.pos", F.transform("c.members", lambda x: x["m"]).alias("members"))
    return graph.per_key(first, "user_id", [F.col("pos")], most).select("user_id", "tag", "members", "place")


def parent_edges(parents: DataFrame, relations: DataFrame) -> DataFrame:
    """user_id, broader, narrower that parents (user_id, tag, members) add to relations; labels are not copied to memories."""
    new = parents.select("user_id", F.col("tag").alias("broader"), F.explode("members").alias("narrower")).where("broader <> narrower").distinct()
    return new.join(relations.select("user_id", "broader", "narrower"), ["user_id", "broader", "narrower"], "left_anti")


def valid_merges(groups: DataFrame, tags: DataFrame, obvious: DataFrame) -> DataFrame:
    """user_id, canonical, variants of groups (user_id, pos, canonical, variants) of synonyms among tags (user_id, tag).

    Variants are tags of the user, each once, that neither obvious (user_id, tag: those of obvious
    merges) nor an earlier valid group has; with fewer than two a group is none. The canonical tag is one of
    them, else the first. A user's groups, which come in one reply, are settled in order.
    """
    each = groups.select("user_id", "pos", text.normal(F.coalesce("canonical", F.lit(""))).alias("canonical"), F.posexplode("variants").alias("at", "v")).withColumn("v", text.normal(F.col("v")))
    real = each.join(_of(tags, "v"), ["user_id", "v"], "left_semi").join(_of(obvious, "v"), ["user_id", "v"], "left_anti")
    once = real.groupBy("user_id", "pos", "canonical", "v").agg(F.min("at").alias("at"))
    listed = once.groupBy("user_id", "pos", "canonical").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("vs")).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "canonical", "vs"))).alias("groups"))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<canonical: string, variants: array<string>>>").alias("out"))

    def settle(acc: Column, g: Column) -> Column:
        free = F.array_except(g["vs"], acc["used"])
        canonical = F.when(F.array_contains(free, g["canonical"]), g["canonical"]).otherwise(F.get(free, F.lit(0)))
        more = F.struct(F.concat(acc["used"], free).alias("used"), F.array_append(acc["out"], F.struct(canonical.alias("canonical"), free.alias("variants"))).alias("out"))
        return F.when(F.size(free) >= 2, more).otherwise(acc)

    return listed.select("user_id", F.inline(F.aggregate("groups", start, settle)["out"]))


def tag_clusters(centroids: DataFrame, least: float, rounds: int = 30) -> DataFrame:
    """user_id, tag, cluster (its first tag by letters) of centroids (user_id, tag, embedding, n: memories) by agglomeration.

    In a round every cluster asks for its nearest other one of its user, by cosine of the means;
    two that are each other's nearest, and least or more alike, become one. It ends when none do.
    Null and all-zero centroids stay alone.
    """
    key = F.concat_ws("\u0001", "user_id", "cluster")
    own = graph.kept(centroids.select("user_id", "tag", F.col("tag").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "n"), "tags")
    members, now = own.select("user_id", "tag", "cluster"), own.select("user_id", "cluster", "embedding", "n")
    for _ in range(rounds):
        keyed = now.withColumn("id", key)
        rows = keyed.select("id", F.col("user_id").alias("scope"), "embedding")
        near = bulk_search.best_by_vectors(rows, rows.withColumnRenamed("id", "query"), 2).where("query <> id")
        first = graph.kept(near.groupBy("query").agg(F.min_by(F.struct("id", "score"), "place").alias("x")).select("query", "x.id", "x.score").where(F.col("score") >= least), "nearest")
        both = first.alias("a").join(first.alias("b"), (F.col("a.query") == F.col("b.id")) & (F.col("a.id") == F.col("b.query"))).where("a.query < a.id").select(F.col("a.query").alias("into"), F.col("a.id").alias("gone"))
        merges = graph.kept(both, "merges")
        if merges.isEmpty():
            break
        target = merges.select(F.col("gone").alias("id"), "into")
        led = keyed.join(target, "id", "left").withColumn("cluster", F.coalesce(F.element_at(F.split("into", "\u0001"), -1), "cluster"))
        pieces = led.select("user_id", "cluster", "n", F.posexplode("embedding").alias("at", "x"))
        mean = pieces.groupBy("user_id", "cluster", "at").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n"))
        now = graph.kept(mean.groupBy("user_id", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("embedding"), F.max("n").alias("n")).unionByName(led.where(F.col("embedding").isNull()).select("user_id", "cluster", "embedding", "n")), "clusters")
        moved = members.withColumn("id", key).join(target, "id", "left")
        members = graph.kept(moved.select("user_id", "tag", F.coalesce(F.element_at(F.split("into", "\u0001"), -1), "cluster").alias("cluster")), "members")
    return members


def proposed_parents(centroids: DataFrame, least: float) -> DataFrame:
    """user_id, pos, tag, members for valid_parents, without a model: clusters of several tags under the name of the one with most memories, marked as a group."""
    found = tag_clusters(centroids, least).join(centroids.select("user_id", "tag", "n"), ["user_id", "tag"])
    grouped = found.groupBy("user_id", "cluster").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "tag"))).alias("all")).where(F.size("all") >= 2)
    return grouped.select("user_id", F.xxhash64("cluster").alias("pos"), F.concat(F.get("all", F.lit(0))["tag"], F.lit(" (group)")).alias("tag"), F.transform("all", lambda x: x["tag"]).alias("members"))
