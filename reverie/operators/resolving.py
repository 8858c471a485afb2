"""Entities: what mentions and open proposals resolve to, merges with all that follows them, hubs and near ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.functions import text
from reverie.operators import alike, graph, upkeep

#: Fixed value: the confidence from which a judgement settles a question.
SURE = 0.9
#: Mentions of a name that a round settles among themselves; mentions that meet its entities in a group; telling words of either at most, but for a single mention with more.
FIRSTS, GROUP, WORDS = 2048, 2048, 500_000


def facts_of(mentions: DataFrame, memories: DataFrame, most: int) -> DataFrame:
    """id, facts of each entity: the texts of the latest of memories (memory_id, content, updated_at) that mention it, latest first."""
    own = mentions.select("entity_id", "memory_id").distinct().join(memories.select("memory_id", "updated_at"), "memory_id")
    few = graph.per_key(own, "entity_id", [F.desc("updated_at"), F.col("memory_id")], most).join(memories.select("memory_id", "content"), "memory_id")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda x: x["content"])
    return few.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(texts, " / ").alias("facts"))


def _side(entities: DataFrame, facts: DataFrame, suffix: str) -> DataFrame:
    own = entities.where("merged_into IS NULL").join(facts, "id", "left")
    return own.select(F.col("id").alias(f"root_{suffix}"), *[F.col(c).alias(f"{c}_{suffix}") for c in ("name", "entity_type", "description", "facts")])


def open_proposals(entities: DataFrame, proposals: DataFrame, facts: DataFrame, judgements: DataFrame | None = None) -> DataFrame:
    """id, keep, merge, fate of proposals that are open, after following both ends through merges.

    An end that leads nowhere rejects, one root for both confirms. Equal names where one side has
    no evidence merge, into the one that has; so do obviously same entities and sure judgements
    (a, b: ends in either order) unless a sure judgement tells them apart, which rejects. The rest is kept.
    """
    root = graph.kept(graph.roots(entities), "roots")
    end = lambda c, name: root.select(F.col("id").alias(c), F.col("root").alias(name))
    asked = proposals.where("status = 'proposed'").select("id", "entity_a", "entity_b").join(end("entity_a", "root_a"), "entity_a", "left").join(end("entity_b", "root_b"), "entity_b", "left")
    both = asked.join(_side(entities, facts, "a"), "root_a", "left").join(_side(entities, facts, "b"), "root_b", "left")
    if judgements is not None:
        said = judgements.select(*upkeep.unordered(F.col("a"), F.col("b")), "verdict", "confidence").dropDuplicates(["low", "high"])
        both = both.withColumns({"low": F.least("root_a", "root_b"), "high": F.greatest("root_a", "root_b")}).join(said, ["low", "high"], "left")
    else:
        both = both.withColumns({"verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    c = F.col
    sure = F.coalesce(c("confidence") >= SURE, F.lit(False))
    no_proof = upkeep.no_evidence(c("name_a"), c("name_b"), c("entity_type_a"), c("entity_type_b"), c("facts_a"), c("description_a")) | upkeep.no_evidence(c("name_b"), c("name_a"), c("entity_type_b"), c("entity_type_a"), c("facts_b"), c("description_b"))
    apart = sure & (c("verdict") == "different")
    same = upkeep.same_entity(c("name_a"), c("name_b"), c("entity_type_a"), c("entity_type_b"), c("facts_a"), c("facts_b")) | (sure & (c("verdict") == "same"))
    missing = c("root_a").isNull() | c("root_b").isNull()
    fate = F.when(missing, "rejected").when(c("root_a") == c("root_b"), "confirmed").when(F.coalesce(no_proof, F.lit(False)), "merged").when(F.coalesce(apart, F.lit(False)), "rejected").when(F.coalesce(same, F.lit(False)), "merged").otherwise("kept")
    first = ~F.coalesce(no_proof, F.lit(False)) | (F.coalesce("facts_a", F.lit("")) != "") | (F.coalesce("facts_b", F.lit("")) == "")
    return both.select("id", F.when(first, c("root_a")).otherwise(c("root_b")).alias("keep"), F.when(first, c("root_b")).otherwise(c("root_a")).alias("merge"), fate.alias("fate"))


def merged_roots(merges: DataFrame) -> DataFrame:
    """id, root of all that merges (keep, merge) join: many merges at once, chains and rings among them, end at the least id."""
    return graph.components(merges.where("keep <> merge").select(F.col("keep").alias("a"), F.col("merge").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("root"))


def surviving(merges: DataFrame) -> DataFrame:
    """id, root as merged_roots, but of all that are joined the one that no merge takes away stays; the least id of several such, or of a ring."""
    parts = graph.kept(merged_roots(merges), "joined")
    lost = merges.where("keep <> merge").select(F.col("merge").alias("id")).distinct().withColumn("lost", F.lit(1))
    first = parts.join(lost, "id", "left").groupBy("root").agg(F.min(F.struct(F.coalesce("lost", F.lit(0)).alias("lost"), "id"))["id"].alias("stays"))
    return parts.join(first, "root").select("id", F.col("stays").alias("root"))


def after_merges(entities: DataFrame, mentions: DataFrame, relations: DataFrame, proposals: DataFrame, moved: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The four tables after entities moved (id, root; ids as relations' ends have them in `end`, `end_root`).

    Mentions, relations and proposals lead to the roots; a relation that closes on itself ends now,
    a proposal whose ends are one is confirmed, and a survivor's description is stale.
    """
    new = moved.where("id <> root")
    to = lambda c, key="id", value="root": new.select(F.col(key).alias(c), F.col(value).alias(f"{c}_to"))
    follow = lambda df, *cs, key="id", value="root": _followed(df, [to(c, key, value) for c in cs], cs)
    survivors = new.select(F.col("root").alias("id"), F.lit(True).alias("grew")).distinct()
    own = entities.join(new, "id", "left").join(survivors, "id", "left")
    kept = own.select(*[c for c in entities.columns if c not in ("merged_into", "description")], F.coalesce("root", "merged_into").alias("merged_into"), "description", (F.coalesce("grew", F.lit(False)) | F.col("root").isNotNull()).alias("stale"))
    edges = follow(relations, "subject", "object", key="end", value="end_root")
    ended = F.when((F.col("subject") == F.col("object")) & F.col("invalid_at").isNull(), now).otherwise(F.col("invalid_at"))
    asked = follow(proposals, "entity_a", "entity_b")
    status = F.when((F.col("entity_a") == F.col("entity_b")) & (F.col("status") == "proposed"), "confirmed").otherwise(F.col("status"))
    return {"entities": kept, "mentions": follow(mentions, "entity_id"), "relations": edges.withColumn("invalid_at", ended), "proposals": asked.withColumn("status", status)}


def _followed(df: DataFrame, maps: list[DataFrame], columns: tuple[str, ...]) -> DataFrame:
    out = df
    for m, c in zip(maps, columns, strict=True):
        out = out.join(m, c, "left").withColumn(c, F.coalesce(f"{c}_to", c)).drop(f"{c}_to")
    return out.select(*df.columns)


def without(entities: DataFrame, mentions: DataFrame, relations: DataFrame, proposals: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The four tables without entities gone (id, end), those merged into them, and all that names either."""
    tombs = entities.join(gone.select(F.col("id").alias("merged_into")), "merged_into", "left_semi").select("id")
    all_ = gone.select("id").union(tombs).distinct()
    ends = gone.select("end").distinct()
    less = lambda df, c, ids, name: df.join(ids.select(F.col(name).alias(c)), c, "left_anti").select(*df.columns)
    return {
        "entities": less(entities, "id", all_, "id"), "mentions": less(mentions, "entity_id", all_, "id"),
        "relations": less(less(relations, "subject", ends, "end"), "object", ends, "end"), "proposals": less(less(proposals, "entity_a", all_, "id"), "entity_b", all_, "id"),
    }


def cleaned(entities: DataFrame, mentions: DataFrame, relations: DataFrame, proposals: DataFrame, facts: DataFrame, end: Callable[[Column], Column], now: Column, judgements: DataFrame | None = None) -> dict[str, DataFrame]:
    """The four tables after a whole clean-up; end makes an entity's id what relations' ends hold.

    Open proposals (new ones are the caller's to add) are settled and what is the same is merged;
    living entities that then nothing mentions, no relation ends in and none was merged into go, and so do
    those whose names can be no entity's, with all that names them.
    """
    settled = graph.kept(open_proposals(entities, proposals, facts, judgements), "settled")
    moved = graph.kept(surviving(settled.where("fate = 'merged'").select("keep", "merge")), "moved")
    mapped = moved.withColumns({"end": end(F.col("id")), "end_root": end(F.col("root"))})
    fates = settled.where("fate <> 'kept'").select("id", F.when(F.col("fate") == "rejected", "rejected").otherwise("confirmed").alias("_fate"))
    asked = proposals.join(fates, "id", "left").withColumn("status", F.coalesce("_fate", "status")).select(*proposals.columns)
    new = after_merges(entities, mentions, relations, asked, mapped, now)
    live = new["entities"].where("merged_into IS NULL").select("id", end(F.col("id")).alias("end"), "name")
    ends = new["relations"].select(F.explode(F.array("subject", "object")).alias("end")).distinct().join(live, "end").select("id")
    tombs = new["entities"].where("merged_into IS NOT NULL").select(F.col("merged_into").alias("id"))
    lost = upkeep.orphans(live.select("id"), new["mentions"].select(F.col("entity_id").alias("id")), ends, tombs)
    junk = live.where(text.no_referent(F.col("name")).isNotNull()).select("id")
    gone = graph.kept(live.join(lost.union(junk).distinct(), "id", "left_semi").select("id", "end"), "gone")
    return without(new["entities"], new["mentions"], new["relations"], new["proposals"], gone)


def resolved_mentions(texts: DataFrame, entities: DataFrame, mentions: DataFrame, root: DataFrame, facts: DataFrame) -> DataFrame:
    """memory_id, name, entity_id, is_new, proposed (ids) of what is mentioned in texts (memory_id, content, mentioned: an array of name, surface, entity_type), each name of a memory once.

    Candidates have the name, by whichever of their names. The latest is taken of those that have that very name
    without evidence, or that are obviously the same by their facts and the memory's text, in any of the forms in which
    the memory has the name; else the name is a new entity, which every candidate is proposed to be.

    Telling words are found once a text and once an entity. A name's mentions meet its candidates in groups of bounded
    size, the latest candidate first; those after one that is anyone's take no part.
    """
    c = F.col
    seen = graph.kept(_told_beside(texts).where("name <> ''").select("memory_id", "name", c("entity_type").alias("kind"), "n_words", "telling"), "seen")
    names = graph.kept(graph.identities(entities, mentions, root).join(seen.select("name").distinct(), "name", "left_semi"), "identities")
    told = c("facts") != ""
    own = entities.where("merged_into IS NULL").join(names.select("id").distinct(), "id", "left_semi").join(facts.select("id", F.coalesce("facts", F.lit("")).alias("facts")), "id", "left").withColumn("facts", F.coalesce("facts", F.lit("")))
    sides = own.select("id", c("name").alias("full"), c("entity_type").alias("of_kind"), (~told & (F.trim(F.coalesce("description", F.lit(""))) == "")).alias("unknown"), F.when(told, text.context_words(c("facts"), c("name"))).alias("t"))
    sides = graph.kept(sides.select("id", "full", "of_kind", "unknown", F.coalesce(F.size("t"), F.lit(0)).alias("n_words"), F.coalesce(F.array_join("t", " "), F.lit("")).alias("telling")), "sides")
    words = text.words(c("full"))
    proof = (F.size(words) >= 2) & (words == text.words(c("name"))) & (c("telling") != "")
    fit = names.join(sides, "id").withColumns({"bare": c("unknown") & (text.normal(c("full")) == c("name")), "proof": proof}).where("bare OR proof")
    running = W.partitionBy("name").orderBy(F.desc_nulls_last("updated"), "id")
    numbered = fit.select("name", "id", "updated", c("of_kind").alias("kind"), "bare", "n_words", "telling").withColumn("place", F.row_number().over(running).cast("long"))
    of_name, of_kind = W.partitionBy("name"), W.partitionBy("name", "kind")
    stop = F.min(F.when(c("bare") & c("kind").isNull(), c("place"))).over(of_name)
    first = F.min(F.when(c("bare"), c("place"))).over(of_kind)
    few = numbered.withColumns({"stop": stop, "first": first}).where("(stop IS NULL OR place <= stop) AND (NOT bare OR place = first)")
    block = (F.floor(F.sum("n_words").over(W.partitionBy("name").orderBy("place")) / WORDS) + F.floor(c("place") / FIRSTS)).cast("int")
    candidates = graph.kept(few.select("name", "id", "place", "kind", "bare", "telling", block.alias("block")), "candidates")
    blocks = candidates.groupBy("name").agg(F.collect_set("block").alias("blocks"))
    shards = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n_words") / WORDS), F.lit(1)).cast("int")
    sizes = graph.kept(seen.groupBy("name").agg(shards.alias("shards")), "sizes")
    asks = seen.join(sizes, "name").join(blocks, "name").select("name", "memory_id", "kind", "telling", F.explode("blocks").alias("block"), F.pmod(F.xxhash64("memory_id"), c("shards")).cast("int").alias("shard"))
    spread = candidates.drop("id").join(sizes, "name").withColumn("shard", F.explode(F.sequence(F.lit(0), c("shards") - 1))).drop("shards")
    key = ["name", "block", "shard"]
    id_type = seen.schema["memory_id"].dataType.simpleString()
    met = spread.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(alike.met, f"name string, memory_id {id_type}, place long")
    taken = met.where("place IS NOT NULL").groupBy("memory_id", "name").agg(F.min("place").alias("place")).join(candidates.select("name", "place", "id"), ["name", "place"])
    out = seen.select("memory_id", "name").distinct().join(taken.select("memory_id", "name", c("id").alias("entity_id")), ["memory_id", "name"], "left").withColumn("is_new", c("entity_id").isNull())
    listed = names.groupBy("name").agg(F.sort_array(F.collect_set("id")).alias("all")).withColumn("is_new", F.lit(True))
    none = F.array().cast(f"array<{entities.schema['id'].dataType.simpleString()}>")
    return out.join(listed, ["name", "is_new"], "left").select("memory_id", "name", "entity_id", "is_new", F.coalesce("all", none).alias("proposed"))


def new_entities(new: DataFrame) -> DataFrame:
    """memory_id, name, first, twin_of of mentions that found no stored entity: new (memory_id, name, surface, entity_type, content), a row for each memory and name.

    Mentions arrive by memory_id. One is the earliest entity of its name that came before it and is
    obviously the same, by its first mention's text, or that nothing is known of (an empty text); else it
    makes an entity of its own. first is the memory whose mention made the entity. The entities of one name
    beside its first may still be that one: twin_of is then the first's memory, to be proposed, else null.
    """
    each = F.collect_list(F.struct("name", "surface", "entity_type"))
    return settled_names(new.groupBy("memory_id", "content").agg(each.alias("mentioned")))


def _told_beside(texts: DataFrame) -> DataFrame:
    """memory_id, name, entity_type, bare, n_words, telling of each of mentioned (an array of name, surface, entity_type) in texts (memory_id, content): the telling words beside the name as one string, none for a name of a single word, which is no proof; a text's words are found once."""
    c = F.col
    told = texts.select("memory_id", (F.trim(F.coalesce("content", F.lit(""))) == "").alias("bare"), text.told_words(c("content")).alias("told"), "mentioned")
    each = told.select("memory_id", "bare", "told", F.explode("mentioned").alias("m")).select("memory_id", "bare", "told", "m.name", "m.surface", "m.entity_type")
    telling = F.when(F.size(text.words(c("surface"))) >= 2, text.beside_name(c("told"), c("surface"))).otherwise(F.array().cast("array<string>"))
    return each.select("memory_id", "name", "surface", "entity_type", "bare", telling.alias("t")).select("memory_id", "name", "entity_type", "bare", F.size("t").alias("n_words"), F.array_join("t", " ").alias("telling"))


def settled_names(texts: DataFrame) -> DataFrame:
    """As new_entities, of texts (memory_id, content, mentioned: an array of name, surface, entity_type).

    A round takes the next FIRSTS mentions of each name, settles them among themselves, and compares
    all later ones with those that make entities, in groups of bounded size. What is the same as none goes
    into the next round; so the rounds are those of the name with the most mentions that are the same as
    none of the entities before their round.
    """
    c = F.col
    rows = _told_beside(texts).where("name IS NOT NULL")
    left = kept_ = graph.kept(rows.select("memory_id", "name", c("entity_type").alias("kind"), "bare", "n_words", "telling"), "new-names")
    id_type = left.schema["memory_id"].dataType.simpleString()
    running = W.partitionBy("name").orderBy("memory_id")  # FIRSTS rows at most

    done = []
    while True:
        firsts = graph.per_key(left.select("name", "memory_id", "n_words"), "name", [c("memory_id")], FIRSTS).withColumn("sum", F.sum("n_words").over(running))
        last = firsts.where((c("sum") <= WORDS) | (c("place") == 1)).groupBy("name").agg(F.max("memory_id").alias("last"), F.count(F.lit(1)).alias("taken"))
        sizes = left.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words"))
        shards = F.greatest(F.ceil(c("n") / GROUP), F.ceil(c("n_words") / WORDS), F.lit(1)).cast("int")
        ends = graph.kept(last.join(sizes, "name").select("name", "last", "taken", "n", shards.alias("shards")), "ends")
        if ends.isEmpty():
            break
        placed = left.join(ends, "name")
        single = placed.where("taken = 1 AND memory_id <= last").select("memory_id", "name", c("memory_id").alias("first"), "kind", "bare", "telling")  # nothing to compare
        several = placed.where("taken > 1 AND memory_id <= last").select("name", "memory_id", "kind", "bare", "telling")
        met = several.groupBy("name").applyInPandas(alike.settled, f"name string, memory_id {id_type}, kind string, bare boolean, telling string, first {id_type}")
        makers = c("first") == c("memory_id")
        told = graph.kept(single.unionByName(met.select("memory_id", "name", "first", *[F.when(makers, c(x)).alias(x) for x in ("kind", "bare", "telling")])), "settled")
        done.append(told.select("memory_id", "name", "first"))
        more = ends.where("n > taken").select("name", "shards")
        if more.isEmpty():
            break
        own = told.where(makers).withColumn("place", F.row_number().over(running))
        candidates = own.select("name", "place", "kind", "bare", "telling").join(more, "name").withColumn("shard", F.explode(F.sequence(F.lit(0), c("shards") - 1)))
        later = placed.where("memory_id > last").select("name", "memory_id", "kind", "telling", F.pmod(F.xxhash64("memory_id"), c("shards")).cast("int").alias("shard"))
        asked = candidates.groupBy("name", "shard").cogroup(later.groupBy("name", "shard"))
        places = graph.kept(asked.applyInPandas(alike.met, f"name string, memory_id {id_type}, place long"), "met")
        done.append(places.where("place IS NOT NULL").join(own.select("name", "place", c("memory_id").alias("first")), ["name", "place"]).select("memory_id", "name", "first"))
        left = graph.kept(left.join(places.where("place IS NULL").select("name", "memory_id"), ["name", "memory_id"], "left_semi").select(*left.columns), "left")
    if not done:
        return kept_.select("memory_id", "name", c("memory_id").alias("first"), c("memory_id").alias("twin_of"))
    all_ = graph.kept(reduce(DataFrame.unionByName, done), "joined")
    anchors = all_.groupBy("name").agg(F.min("first").alias("anchor"))
    return all_.join(anchors, "name").select("memory_id", "name", "first", F.when((c("first") == c("memory_id")) & (c("first") != c("anchor")), c("anchor")).alias("twin_of"))


def hubs(entities: DataFrame, mentions: DataFrame, relations: DataFrame, memories: DataFrame, most: int = 20) -> DataFrame:
    """id, name, aliases, memories (the latest most), edges (subject, predicate, object by name) of each living entity.

    relations have subject_id and object_id, null where an end is no entity; of the entities in a
    third of all edges only their own edges are gathered, as a hub shows them.
    """
    live = entities.where("merged_into IS NULL").select("id", "name")
    said = mentions.select(F.col("entity_id").alias("id"), text.normal(F.col("surface")).alias("alias"))
    merged = entities.where("merged_into IS NOT NULL").select(F.col("merged_into").alias("id"), F.col("normalized").alias("alias"))
    aliases = said.union(merged).distinct().groupBy("id").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))
    own = mentions.select("entity_id", "memory_id").distinct().join(memories.select("memory_id", "updated_at"), "memory_id")
    few = graph.per_key(own, "entity_id", [F.desc("updated_at"), F.col("memory_id")], most).groupBy(F.col("entity_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "memory_id"))), lambda x: x["memory_id"]).alias("memories"))
    named = lambda c: live.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name"))
    shown = relations.where("invalid_at IS NULL").join(named("subject"), "subject_id", "left").join(named("object"), "object_id", "left")
    edge = F.concat_ws(" ", F.coalesce("subject_name", "subject"), "predicate", F.coalesce("object_name", "object"))
    ends = shown.select(F.explode(F.array_compact(F.array_distinct(F.array("subject_id", "object_id")))).alias("id"), edge.alias("edge"))
    edges = ends.groupBy("id").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    return live.join(aliases, "id", "left").join(few, "id", "left").join(edges, "id", "left")


def near_by_cooccurrence(mentions: DataFrame, memories: DataFrame, seeds: DataFrame, hops: int = 2, per_entity: int = 25) -> DataFrame:
    """id, rank of entities that share memories with seeds (id), within hops steps over each entity's latest memories, by personalised PageRank.

    A memory reached from two entities of a step counts for both.
    """
    own = mentions.select("entity_id", "memory_id").distinct()
    dated = own.join(memories.select("memory_id", "updated_at"), "memory_id")
    latest = graph.kept(graph.per_key(dated, "entity_id", [F.desc("updated_at"), F.col("memory_id")], per_entity).select("entity_id", "memory_id"), "latest")
    front = reached = graph.kept(seeds.select("id").distinct(), "front")
    links = None
    for _ in range(hops):
        visits = front.join(latest, front["id"] == latest["entity_id"]).select("memory_id").groupBy("memory_id").agg(F.count(F.lit(1)).alias("visits"))
        members = own.join(visits, "memory_id")
        pairs = members.select("memory_id", "visits", F.col("entity_id").alias("u")).join(own.select("memory_id", F.col("entity_id").alias("v")), "memory_id").where("u <> v").groupBy("u", "v").agg(F.sum("visits").alias("weight"))
        links = pairs if links is None else links.union(pairs)
        front = graph.kept(members.select(F.col("entity_id").alias("id")).distinct().join(reached, "id", "left_anti"), "front")
        reached = reached.union(front)
    edges = graph.kept(links.groupBy("u", "v").agg(F.sum("weight").cast("double").alias("weight")), "weights")
    return graph.pagerank(edges, seeds).join(seeds, "id", "left_anti")


def expanded(relations: DataFrame, seeds: DataFrame, fallback, hops: int = 2) -> DataFrame:
    """id, hop of what typed relations reach from seeds; only where they reach nothing, what fallback() (id, rank) gives, by its order."""
    typed = graph.expand(relations, seeds, hops)
    if not typed.isEmpty():
        return typed
    order = W.orderBy(F.desc("rank"), "id")
    return fallback().orderBy(F.desc("rank"), "id").limit(500).select("id", F.row_number().over(order).alias("hop"))
