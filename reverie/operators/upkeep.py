"""Duplicates, tags and entities: finding what to merge, and merging it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.functions import scoring, text
from reverie.operators import bulk_search, graph, search


def obvious_tags(tags: DataFrame) -> DataFrame:
    """tag, canonical of stored tags (tag) that differ in case, separators or a plural alone: two at least to a group.

    The canonical tag is the group's key where that is stored, else the one with the fewest
    separators, then the shortest, then the first.
    """
    own = tags.select(text.normal(F.col("tag")).alias("tag")).where("tag <> ''").distinct().withColumn("key", text.tag_key(F.col("tag"))).where("key <> ''")
    marks = F.length("tag") - F.length(F.translate("tag", "-_", ""))
    best = F.min(F.struct((F.col("tag") != F.col("key")).alias("other"), marks.alias("marks"), F.length("tag").alias("size"), "tag"))
    groups = own.groupBy("key").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.join(groups, "key").select("tag", F.col("best.tag").alias("canonical"))


def retag(memories: DataFrame, remove: list[str], add: str | None) -> DataFrame:
    """Active memories whose categories lose remove and gain add at the end; the others as they are."""
    hit = F.col("invalid_at").isNull() & F.exists("categories", lambda c: text.normal(c).isin(*remove))
    left = F.filter("categories", lambda c: ~text.normal(c).isin(*remove))
    gained = left if add is None else F.when(F.array_contains(left, add), left).otherwise(F.array_append(left, F.lit(add)))
    return memories.withColumn("categories", F.when(hit, gained).otherwise(F.col("categories")))


def retagged_relations(relations: DataFrame, remove: list[str], add: str | None) -> DataFrame:
    """relations (broader, narrower) whose ends among remove become add, or go where nothing is added; none that closes on itself stays, none twice."""
    end = lambda c: F.when(F.col(c).isin(*remove), F.lit(add)).otherwise(F.col(c)).alias(c)
    moved = relations.select(end("broader"), end("narrower"))
    return moved.where("broader <> narrower").distinct()


def mapped_tags(tagged: DataFrame, merges: DataFrame) -> DataFrame:
    """tagged (id, place, tag) with each tag's canonical one, kept at its first place."""
    moved = tagged.join(merges, "tag", "left").select("id", "place", F.coalesce("canonical", "tag").alias("tag"))
    return moved.groupBy("id", "tag").agg(F.min("place").alias("place"))


def _sums(batches):
    """Vector sums and counts by tag within a task: one row for each tag and batch goes into the shuffle, not one for each element."""
    for frame in batches:
        if len(frame):
            x = np.array(frame["embedding"].tolist(), np.float64).reshape(len(frame), -1)
            codes, tags = pd.factorize(frame["tag"])
            total = np.zeros((len(tags), x.shape[1]))
            np.add.at(total, codes, x)
            yield pd.DataFrame({"tag": tags, "n": np.bincount(codes), "total": list(total)})


def tag_centroids(vectors: DataFrame, least: int = 2) -> DataFrame:
    """tag, n, centroid: mean vector of each tag with that many vectors."""
    kind = vectors.schema["tag"].dataType.simpleString()
    sums = vectors.where("embedding IS NOT NULL AND tag IS NOT NULL").select("tag", "embedding").mapInPandas(_sums, f"tag {kind}, n long, total array<double>")
    spread = sums.select("tag", "n", F.posexplode("total"))
    means = spread.groupBy("tag", "pos").agg((F.sum("col") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    folded = means.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("centroid"), F.max("n").alias("n"))
    return folded.where(F.col("n") >= least)


def split_tags(centroids: DataFrame, together: DataFrame, labels: DataFrame | None = None, strong: float = 0.93, weak: float = 0.75, alike: float = 0.62, most_together: float = 0.25, most: int | None = 20) -> DataFrame:
    """canonical, variant, similarity of tags (tag, n, centroid) that mean the same and rarely stand together (a, b, n).

    Centroids are strongly similar, or weakly where labels (tag, label: a vector of the name) are
    alike. The tag of more memories is the canonical one, of equals the first.
    """
    numbered = graph.kept(centroids.withColumn("id", F.row_number().over(W.orderBy("tag")).cast("long")), "tags")  # one row a tag
    found = search.similarity_pairs(numbered.select("id", F.col("centroid").alias("embedding")), strong if labels is None else min(strong, weak))
    side = lambda key, tag, n: numbered.select(F.col("id").alias(key), F.col("tag").alias(f"tag_{key}"), F.col("n").alias(n))
    pairs = found.join(side("a", "tag_a", "na"), "a").join(side("b", "tag_b", "nb"), "b").select(F.col("tag_a").alias("a"), F.col("tag_b").alias("b"), "na", "nb", "similarity")
    if labels is not None:
        name = lambda c: labels.select(F.col("tag").alias(c), F.col("label").alias(f"label_{c}"))
        named = F.coalesce(scoring.cosine(F.col("label_a"), F.col("label_b")), F.lit(0.0))
        pairs = pairs.join(name("a"), "a", "left").join(name("b"), "b", "left").where((F.col("similarity") >= strong) | ((F.col("similarity") >= weak) & (named >= alike)))
    apart = pairs.join(together, ["a", "b"], "left").where(F.coalesce("n", F.lit(0)) / F.least("na", "nb") <= most_together)
    first = F.col("na") >= F.col("nb")
    out = apart.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("canonical"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("variant"), F.round("similarity", 4).alias("similarity"))
    return out if most is None else out.orderBy(F.desc("similarity"), "canonical", "variant").limit(most)


def vocabulary(tagged: DataFrame, query: Column, most: int = 120, near: int = 60) -> DataFrame:
    """tag: all tags of tagged (tag, embedding) where they are few, else those nearest to the query's vector and the most frequent rest, most in all."""
    counted = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.max(F.round(scoring.cosine(F.col("embedding"), query), 9)).alias("near"))
    counted = graph.kept(counted, "tags")
    few = near if counted.limit(most + 1).count() > most else 0
    first = counted.orderBy(F.desc("near"), "tag").limit(few).select("tag")
    rest = counted.join(first, "tag", "left_anti").orderBy(F.desc("n"), "tag").limit(most - few).select("tag")
    return first.union(rest)


def groups_of(pairs: DataFrame, most: int = 6) -> DataFrame:
    """node, component, size of the groups that pairs (a, b) make; a group above most members is left out whole."""
    parts = graph.components(pairs)
    sized = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size").between(2, most))
    return parts.join(sized, "component").select("node", "component", "size")


def representatives(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key that speaks for it: most important, then longest, then oldest, then by id."""
    order = W.partitionBy(key).orderBy(F.desc("importance"), F.desc(F.length("content")), "created_at", "seq")
    return rows.withColumn("_first", F.row_number().over(order)).where("_first = 1").drop("_first")


def merged_rows(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: text of its representative, greatest importance, oldest time and its type, all tags in order of time."""
    first = F.struct("created_at", "seq")
    best = representatives(rows, key).select(F.col(key).alias("_key"), "content")
    tags = rows.select(key, "created_at", "seq", F.posexplode_outer("categories")).groupBy(key, "col").agg(F.min(F.struct("created_at", "seq", "pos")).alias("at")).where("col IS NOT NULL")
    ordered = tags.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "col"))), lambda x: x["col"]).alias("categories"))
    folded = rows.groupBy(key).agg(F.max("importance").alias("importance"), F.min("created_at").alias("created_at"), F.min_by("memory_type", first).alias("memory_type"), F.count(F.lit(1)).alias("n"))
    return folded.join(ordered, key, "left").join(best, F.col(key) == F.col("_key")).drop("_key")


def consolidated(rows: DataFrame, key: str) -> DataFrame:
    """A row for each key: merged_rows with the speaker's seq, whether all have one wording, and the ids it would replace."""
    merged = merged_rows(rows, key)
    speaker = representatives(rows, key).select(key, F.col("seq").alias("speaker"))
    told = rows.groupBy(key).agg((F.count_distinct(text.restated(F.col("content"))) == 1).alias("same"), F.sort_array(F.collect_list("id")).alias("originals"))
    return merged.join(speaker, key).join(told, key)


def first_of(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key, pre-aggregated before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_first", rank).where("_first = 1").drop("_first")


def same_entity(left_name: Column, right_name: Column, left_type: Column, right_type: Column, left_facts: Column, right_facts: Column) -> Column:
    """Names of two words at least that are equal, types that don't conflict, and facts that share telling words."""
    one, two = text.words(left_name), text.words(right_name)
    typed = F.coalesce(left_type == right_type, F.lit(True))
    return (F.size(one) >= 2) & (one == two) & typed & same_context(text.context_words(left_facts, left_name), text.context_words(right_facts, right_name))


def same_context(a: Column, b: Column) -> Column:
    """Whether telling words (arrays) share two, or a long one that is a fair part of the fewer."""
    shared = F.array_intersect(a, b)
    long = F.coalesce(F.array_max(F.transform(shared, F.length)), F.lit(0)) >= 6
    share = F.size(shared) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)) >= 0.12
    return (F.size(shared) >= 2) | ((F.size(shared) > 0) & long & share)


def no_evidence(left_name: Column, right_name: Column, left_type: Column, right_type: Column, left_facts: Column, left_description: Column) -> Column:
    """Equal names and types that don't conflict, where the known entity has neither facts nor a description."""
    typed = F.coalesce(left_type == right_type, F.lit(True))
    return (text.normal(left_name) == text.normal(right_name)) & typed & (F.coalesce(left_facts, F.lit("")) == "") & (F.trim(F.coalesce(left_description, F.lit(""))) == "")


def unordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]


def same_name_pairs(entities: DataFrame, proposals: DataFrame, most: int | None = 50) -> DataFrame:
    """low, high: each name's latest entity with its others, where the pair was never proposed."""
    live = entities.where("merged_into IS NULL")
    anchor = W.partitionBy("normalized").orderBy(F.desc("updated"), "id")
    placed = live.select("id", F.first("id").over(anchor).alias("anchor")).where("id <> anchor").select(*unordered(F.col("anchor"), F.col("id")))
    asked = proposals.select(*unordered(F.col("entity_a"), F.col("entity_b"))).distinct()
    new = placed.join(asked, ["low", "high"], "left_anti")
    return new if most is None else new.orderBy("low", "high").limit(most)


def orphans(ids: DataFrame, *uses: DataFrame) -> DataFrame:
    """ids (id) that none of uses (id) has."""
    for used in uses:
        ids = ids.join(used.select("id").distinct(), "id", "left_anti")
    return ids


def new_edges(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming edges that no active stored edge equals in ends, predicate and user; repeats among them count once."""
    key = ["subject", "predicate", "object", "user_id"]
    live = stored.where("invalid_at IS NULL").select(*key).distinct()
    return incoming.dropDuplicates(key).join(live, key, "left_anti")


def apart_from_stored(rows: DataFrame, stored: DataFrame, least: float = 0.97) -> DataFrame:
    """rows (place, user_id, embedding) that no stored vector (user_id, embedding) of their user is that similar to; rows without a vector stay.

    Each new vector asks for its nearest stored one; stored vectors are not compared with each other.
    """
    user = F.concat(F.lit("u"), F.coalesce(F.concat(F.lit(":"), "user_id"), F.lit("")))  # no user is a user too
    old = stored.select(F.xxhash64("user_id", "embedding").alias("id"), user.alias("scope"), "embedding")
    asked = rows.select(F.col("place").cast("string").alias("query"), user.alias("scope"), "embedding")
    near = bulk_search.best_by_vectors(old, asked, 1).where(F.col("score") >= least).select(F.col("query").alias("_near"))
    return rows.join(near, F.col("place").cast("string") == F.col("_near"), "left_anti").select(*rows.columns)


def imported(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """rows (place, content, user_id, categories, memory_type, importance: text) ready to store.

    Contents are trimmed and empty ones dropped, categories split at commas, kinds and importance
    made valid; a text that its user has stored, or that stood further up, is left out.
    """
    key = [F.coalesce("user_id", F.lit("")), F.lower(F.trim("content"))]
    clean = rows.where(F.trim(F.coalesce("content", F.lit(""))) != "").select(
        "place", F.trim("content").alias("content"), "user_id", F.filter(F.transform(F.split(F.coalesce("categories", F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "").alias("categories"),
        scoring.memory_type(F.col("memory_type")).alias("memory_type"), scoring.importance(F.col("importance"), clamp=False).alias("importance"),
    )
    firsts = first_of(clean, key, [F.col("place")]).withColumn("_u", key[0]).withColumn("_c", key[1])
    old = stored.select(key[0].alias("_u"), key[1].alias("_c")).distinct()
    return firsts.join(old, ["_u", "_c"], "left_anti").drop("_u", "_c")
