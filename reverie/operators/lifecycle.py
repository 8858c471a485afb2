"""Memories over time: change log, snapshots, fading, backup and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.functions import scoring


def fold(changes: DataFrame) -> DataFrame:
    """State of each id after changes (id, ts, seq, op, content, importance), in order of ts and seq.

    insert and update set what they give (null gives nothing); invalidate and supersede stamp
    active rows; revalidate clears the stamp, but not of a row that was superseded since it was inserted;
    delete drops the row, purge does so where the row has ended; either stands unless the row is inserted again later.
    """
    born, own = F.struct("ts", "seq"), W.partitionBy("id")
    before = own.orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)
    replaced = F.last(F.when(F.col("op") == "supersede", True).when(F.col("op") == "insert", False), ignorenulls=True).over(before)
    allowed = changes.withColumn("at", born).withColumn("replaced", F.coalesce(replaced, F.lit(False))).where("NOT (op = 'revalidate' AND replaced)")
    turn = F.when(F.col("op").isin("invalidate", "supersede"), F.lit(1)).when(F.col("op").isin("revalidate", "insert"), F.lit(0))
    turned = allowed.withColumn("turn", turn).withColumn("before", F.coalesce(F.last("turn", ignorenulls=True).over(before), F.lit(0)))
    drops = (F.col("op") == "delete") | ((F.col("op") == "purge") & (F.col("before") == 1))
    marked = turned.withColumn("gone", F.max(F.when(drops, F.col("at"))).over(own)).where("gone IS NULL OR at > gone")
    given = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & F.col("op").isin("insert", "update"), F.col("at"))).alias(c)
    first_stamp = F.when((F.col("turn") == 1) & (F.col("before") == 0), F.col("ts"))
    state = marked.groupBy("id").agg(
        given("content"), given("importance"), F.min(F.when(F.col("op") == "insert", F.col("ts"))).alias("created_at"),
        F.max(F.when(~F.col("op").isin("touch", "purge"), F.col("ts"))).alias("updated_at"),
        F.max_by("turn", F.when(F.col("turn").isNotNull(), F.col("at"))).alias("off"), F.max(first_stamp).alias("stamp"),
    )
    return state.where("created_at IS NOT NULL").select("id", "content", "importance", "created_at", "updated_at", F.when(F.col("off") == 1, F.col("stamp")).alias("invalid_at"))


def forget_all(memories: DataFrame, scope: Column, ts: Column) -> DataFrame:
    """The changes (id, ts, op) that end every active memory of a scope."""
    return memories.where(scope & F.col("invalid_at").isNull()).select("id", ts.alias("ts"), F.lit("invalidate").alias("op"))


def as_of(memories: DataFrame, moment: str) -> DataFrame:
    """Memories that were valid at that time."""
    at = F.expr(f"timestamp_ntz'{moment}'")
    return memories.where((F.col("valid_from") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)))


def faded(memories: DataFrame, now: str, threshold: float = 0.1, **how) -> DataFrame:
    """Active memories whose effective importance fell under the threshold."""
    score = scoring.effective_importance(F.col("importance"), F.col("memory_type"), F.col("updated_at"), F.expr(f"timestamp_ntz'{now}'"), **how)
    return memories.where("invalid_at IS NULL").withColumn("effective", score).where(F.col("effective") < threshold)


def within_budget(ranked: DataFrame, budget: int, place: str = "place", cost: str = "tokens") -> DataFrame:
    """The rows that fit a token budget: from the first that fits alone on, up to the first that overflows.

    Every row costs a token at least, so only as many rows as the budget has tokens can fit; the
    running sum is over these, however long the ranked table is.
    """
    start = ranked.where(F.col(cost) <= budget).agg(F.min(place)).first()[0]
    few = ranked.where(F.col(place) >= F.lit(start)).orderBy(place).limit(budget + 1)
    run = F.sum(cost).over(W.orderBy(place).rowsBetween(W.unboundedPreceding, W.currentRow))
    return few.withColumn("used", run).where(F.col("used") <= budget)


def fitted(costs: DataFrame, budget: int, key: str, place: str = "place", cost: str = "tokens") -> DataFrame:
    """place of the rows that fit each key's budget when those that do not are skipped; for a few rows a key."""
    listed = costs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(place, cost))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def take(state: Column, row: Column) -> Column:
        fits = state["used"] + row[cost] <= budget
        return F.struct(F.when(fits, state["used"] + row[cost]).otherwise(state["used"]).cast("long").alias("used"), F.when(fits, F.array_append(state["kept"], row[place].cast("int"))).otherwise(state["kept"]).alias("kept"))

    return listed.select(key, F.explode(F.aggregate("rows", start, take, lambda s: s["kept"])).alias(place))


def entity_blocks(found: DataFrame, described: DataFrame, budget: int, header: int = 7) -> DataFrame:
    """id, line, tokens, place of the entities found (id, updated; a few) whose described lines (id, name, entity_type, description) fit the budget after the header, latest first.

    A line that does not fit is left out, and the next one is tried.
    """
    label = F.concat("name", F.when(F.col("entity_type").isNotNull(), F.concat(F.lit(" ("), "entity_type", F.lit(")"))).otherwise(""))
    lines = found.join(described.where(F.coalesce("description", F.lit("")) != ""), "id").select("id", "updated", F.concat(F.lit("- "), label, F.lit(": "), "description").alias("line"))
    placed = lines.select("id", "line", (tokens(F.col("line")) + 1).alias("tokens"), F.row_number().over(W.orderBy(F.desc("updated"), "id")).alias("place"), F.lit(1).alias("query"))
    fits = fitted(placed, budget - header, "query")
    return placed.join(fits, ["query", "place"]).select("id", "line", "tokens", "place")


def composed(blocks: DataFrame, told: DataFrame, memories: DataFrame, most: int = 20) -> DataFrame:
    """id, place (from 0): the latest of each block's memories (blocks: id, place; told: entity_id, id; most an entity), and then memories (id, place); each once, where it comes first. told has updated_at."""
    theirs = blocks.select(F.col("id").alias("entity_id"), F.col("place").alias("block")).join(told, "entity_id")
    latest = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("updated_at"), "id"))
    first = theirs.withColumn("nth", latest).where(F.col("nth") <= most).select("id", F.struct(F.lit(0).alias("part"), F.col("block").alias("block"), F.col("nth").alias("nth")).alias("at"))
    then = memories.select("id", F.struct(F.lit(1).alias("part"), F.col("place").cast("int").alias("block"), F.lit(0).alias("nth")).alias("at"))
    once = first.union(then).groupBy("id").agg(F.min("at").alias("at"))  # some dozens of rows: what a budget holds
    return once.select("id", (F.row_number().over(W.orderBy("at")) - 1).alias("place"))


def tokens(content: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(content) / 4).cast("int"))


def context_line(kind: Column, updated: Column, content: Column) -> Column:
    return F.concat(F.lit("- ["), kind, F.lit(" · "), F.date_format(updated, "yyyy-MM-dd"), F.lit("] "), content)


def latest_event(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """memory_id, last (created_at, id, actor) of each memory's latest event of these kinds."""
    return events.where(F.col("event").isin(*kinds)).groupBy("memory_id").agg(F.max(F.struct("created_at", "id", "actor")).alias("last"))


def repaired(memories: DataFrame, events: DataFrame) -> DataFrame:
    """id, updated_at as the content's events say: the later of creation and the latest event that changed the content."""
    last = latest_event(events, ("ADD", "UPDATE", "SUPERSEDE")).select(F.col("memory_id").alias("id"), F.col("last.created_at").alias("changed"))
    return memories.join(last, "id", "left").select("id", "updated_at", F.greatest("created_at", "changed").alias("right"))


def compared(incoming: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """key, fate of incoming rows: insert, unchanged, or conflict where a stored row of that key differs in any column."""
    names = [c for c in incoming.columns if c != key]
    new = incoming.select(F.col(key).alias("new_key"), F.struct(*names).alias("new"))
    old = stored.select(F.col(key).alias("old_key"), F.struct(*names).alias("old"))
    joined = new.join(old, F.col("new_key") == F.col("old_key"), "left")
    fate = F.when(F.col("old_key").isNull(), "insert").when(F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("conflict")
    return joined.select(F.col("new_key").alias(key), fate.alias("fate"))


def restored(incoming: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """stored with incoming's new rows; fails whole if any row conflicts."""
    fate = compared(incoming, stored, key)
    clash = fate.where("fate = 'conflict'").limit(1).count()
    if clash:
        raise ValueError("a row of the backup differs from the stored row of its key")
    new = incoming.join(fate.where("fate = 'insert'").select(key), key, "left_semi")
    return stored.unionByName(new.select(*stored.columns))
