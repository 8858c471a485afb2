"""Walks over typed relations, merges and shared mentions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.functions import text


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; the warehouse stands in for it only in local mode, where all share one disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage is cut, and any executor can read it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame, a: str = "subject", b: str = "object") -> DataFrame:
    return edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a)))


def touching(edges: DataFrame, ids: DataFrame, a: str = "subject", b: str = "object") -> DataFrame:
    """Edges with either end among ids (id): two semi-joins, not a join on OR."""
    left = edges.join(ids.select(F.col("id").alias(a)), a, "left_semi").select(*edges.columns)
    right = edges.join(ids.select(F.col("id").alias(b)), b, "left_semi").select(*edges.columns)
    return left.union(right).distinct()


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """id, hop of what seeds (id) reach over edges in either direction, at the least number of hops; seeds are left out."""
    step = undirected(edges)
    seen = seeds.select("id", F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        reached = front.join(step, front["id"] == step["u"]).select(F.col("v").alias("id")).distinct()
        front = kept(reached.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)), "hop")
        seen = seen.union(front)
    return seen.where("hop > 0")


def two_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    """start, end over an edge (a, b) of first and then one of second."""
    return first.select(F.col("a").alias("start"), F.col("b").alias("mid")).join(second.select(F.col("a").alias("mid"), F.col("b").alias("end")), "mid").select("start", "end").distinct()


def roots(entities: DataFrame) -> DataFrame:
    """id, root: each entity's survivor along merged_into; null over a cycle or a missing one.

    Pointers jump, so that a chain of n needs about log2(n) rounds; a pointer that never
    comes to rest is a cycle's.
    """
    now = entities.select("id", F.coalesce("merged_into", "id").alias("to"), F.col("merged_into").isNull().alias("rests"))
    known = now
    for _ in range(40):
        nxt = known.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("rests").alias("far_rests"), F.lit(True).alias("found"))
        joined = known.join(nxt, "to", "left")
        moved = kept(joined.select("id", F.when(F.col("found"), F.col("far")).alias("to"), F.coalesce("far_rests", F.lit(True)).alias("rests"), (F.col("to") != F.coalesce("far", "to")).alias("changed")), "roots")
        known = moved.select("id", "to", "rests")
        if not moved.where("changed AND NOT rests").limit(1).count():
            break
    return known.select("id", F.when(F.col("rests"), F.col("to")).alias("root"))


def closure(relations: DataFrame, nodes: DataFrame, depth: int = 8) -> DataFrame:
    """root, id of all under each of nodes (id) along broader to narrower, itself included, fewer than depth steps down.

    One plan by Spark's recursion, whose limit of rows LIMIT ALL lifts. Its rows are walks, made
    distinct at the end, so a cycle goes round until depth, and a node of several parents counts
    once for each way to it.
    """
    walk = """
    WITH RECURSIVE under (root, id, depth) AS (
      SELECT id, id, 0 FROM {nodes}
      UNION ALL SELECT root, narrower, depth + 1 FROM under JOIN {relations} ON broader = under.id WHERE depth < {last})
    SELECT root, id FROM under LIMIT ALL"""
    steps = relations.select("broader", "narrower").distinct()
    return nodes.sparkSession.sql(walk, nodes=nodes.select("id").distinct(), relations=steps, last=depth - 1).distinct()


def phrases(query: Column, most: int = 128, longest: int = 6) -> Column:
    """Runs of the query's words, long ones first, of three characters at least, the first most of them."""
    w = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"), F.lit(0))

    def run(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.size(w))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    runs = [run(n) for n in range(longest, 0, -1)]
    return F.slice(F.array_distinct(F.filter(F.concat(*runs), lambda p: F.length(p) >= 3)), 1, most)


def detect(query: str, names: DataFrame, most: int = 50) -> DataFrame:
    """Entities (id, updated) that names (name, id, updated) find for a phrase of the query, latest first."""
    asked = names.sparkSession.range(1).select(F.explode(phrases(F.lit(query))).alias("name"))
    hits = names.join(F.broadcast(asked), "name", "left_semi")  # 128 phrases at most
    return hits.groupBy("id").agg(F.max("updated").alias("updated")).orderBy(F.desc("updated"), "id").limit(most)


def candidates(asked: DataFrame, names: DataFrame, entities: DataFrame) -> DataFrame:
    """name, id, tier of asked (name): what names (name, id) find, and for the others living entities that have the name among their aliases (an array)."""
    own = asked.select(text.normal(F.col("name")).alias("name")).distinct()
    first = kept(names.join(own, "name", "left_semi").select("name", "id", F.lit(0).alias("tier")).distinct(), "named")
    rest = own.join(first.select("name"), "name", "left_anti")
    aliases = entities.where("merged_into IS NULL").select("id", F.explode("aliases").alias("alias")).select("id", text.normal(F.col("alias")).alias("name"))
    return first.union(aliases.join(rest, "name").select("name", "id", F.lit(1).alias("tier")).distinct())


def identities(entities: DataFrame, mentions: DataFrame, root: DataFrame) -> DataFrame:
    """name, id, updated: canonical names, mention surfaces and merged names, each leading to a survivor."""
    live = entities.where("merged_into IS NULL").select("id", F.col("updated"))
    own = entities.where("merged_into IS NULL").select(F.col("normalized").alias("name"), "id")
    surfaces = mentions.select(text.normal(F.col("surface")).alias("name"), F.col("entity_id").alias("id")).distinct()
    merged = entities.where("merged_into IS NOT NULL").select(F.col("normalized").alias("name"), "id").join(root, "id").select("name", F.col("root").alias("id"))
    return own.union(surfaces).union(merged).distinct().join(live, "id").select("name", "id", "updated")


def per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The n first rows of each key; Spark cuts them before the shuffle too."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with `rank`, from 0, in an order that tells all rows apart: ranges of it are numbered side by side, and each begins where the one before ends."""
    ranged = kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = F.sum("n").over(W.orderBy("_part")) - F.col("n")  # a row a partition
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", before.alias("_before"))
    nth = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_nth", nth).join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_before") + F.col("_nth") - 1).cast("int").alias("rank"))


def shared_counts(links: DataFrame, group: str, member: str) -> DataFrame:
    """a < b, n: how many groups hold both members."""
    own = links.select(group, member).distinct()
    left, right = own.select(group, F.col(member).alias("a")), own.select(group, F.col(member).alias("b"))
    return left.join(right, group).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """id, rank: personalised PageRank of weighted edges (u, v, weight), restarting at seeds (id); written out every fifth round."""
    out = edges.groupBy("u").agg(F.sum("weight").alias("total"))
    steps = kept(edges.join(out, "u").select("u", "v", (F.col("weight") / F.col("total")).alias("p")), "steps")
    start = seeds.distinct().select("id", (F.lit(1.0) / F.lit(float(max(1, seeds.distinct().count())))).alias("start"))
    rank = start.select("id", F.col("start").alias("rank"))
    for k in range(rounds):
        flow = rank.join(steps, rank["id"] == steps["u"]).groupBy("v").agg((F.lit(damping) * F.sum(F.col("rank") * F.col("p"))).alias("flow")).withColumnRenamed("v", "id")
        rank = flow.join(start, "id", "full_outer").select("id", (F.coalesce("flow", F.lit(0.0)) + F.lit(1 - damping) * F.coalesce("start", F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            rank = kept(rank, "rank")
    return rank


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of links (a, b), by least labels whose pointers jump."""
    both = kept(undirected(links, "a", "b").distinct(), "edges")
    label = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("c")).select(F.col("u").alias("node"), "c")
    while True:
        near = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("c").alias("m"))
        step = label.join(near, label["node"] == near["u"]).select("node", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        jump = step.select(F.col("node").alias("c"), F.col("c").alias("far"))
        moved = kept(step.join(jump, "c").select("node", F.least("c", "far").alias("c"), "was"), "labels")
        label = moved.select("node", "c")
        if moved.where("c <> was").isEmpty():
            return label.withColumnRenamed("c", "component")
