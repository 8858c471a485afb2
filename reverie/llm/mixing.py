"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Each source gets a target of words T. Its documents take the rates w that stay closest, in
relative entropy, to their base rates q while 0 <= w <= cap and their words meet the target:
w = min(cap, q * exp(lambda * size)), where lambda is the source's multiplier in the convex dual.
Newton iterations find all sources' multipliers side by side: one aggregate over all
documents' sizes gives gradient and Hessian, the next multipliers are a small table, and the
iterations stop by the gradient. So a source that gives less than it has gives up long documents
first, one that repeats takes long ones twice first, and the short ones stay near one copy.

The rates then become whole copies, the rounding error of a document passing to the next,
smaller one of its lane, so that a source ends within about half of its smallest documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.llm.common import WORD, boxed, load, maybe_among, partitions, written

#: Documents of a lane, on average; a source has as many lanes as it needs, so no group holds a hot source.
LANE = 512
#: Parts by which the rows of a class are numbered, and rows of one that a task lists at a time.
PARTS, RUN = 64, 1 << 16
#: The gradient at which a source's iterations end, as a share of its target, and the most iterations that are tried.
TOLERANCE, MOST_ROUNDS = 1e-9, 200
#: Sums are of decimals, so that they don't depend on the order of rows.
EXACT = "decimal(28,6)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """sources (source, words: a row each) with `no` (its place), `weight` and `target`.

    Weights go round by code point order of the source, null last. A target stops at cap times
    the source's words; the excess is shared by weight among the rest until none is above. The
    loop brings two sums a round to the driver.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = written(sources.withColumns({"no": place, "weight": weight}), "mix-sources", 16)
    most = F.col("words") * F.lit(float(cap))
    row = table.agg(F.sum("words"), F.sum("weight")).first()
    if not row[1]:
        return table.withColumn("target", F.lit(0.0))
    budget, level = share * (row[0] or 0), 0.0
    fixed, free = 0.0, row[1]
    while free:
        level = (budget - fixed) / free
        above = F.col("weight") * F.lit(level) > most
        now = table.agg(F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if now[1] == free:
            break
        fixed, free = now
    return table.withColumn("target", F.least(most, F.col("weight") * F.lit(level)) if free else most)


def document_rate(lam: Column, scale: Column, size: Column, base: Column, target: Column, cap: float) -> Column:
    """The tilted rate of a document; lam null stands for a source that gives all it may."""
    tilted = F.least(F.lit(float(cap)), base * F.exp(lam * size / scale))
    return F.when(target <= 0, 0.0).when(lam.isNull() & (size > 0), float(cap)).when(lam.isNull(), F.least(F.lit(float(cap)), base)).otherwise(tilted)


def multipliers(sizes: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """no, lam of each source, after Newton iterations on the dual of sizes (no, size, base, n: that many documents) for sources (no, words, n, target).

    lam multiplies a document's size over the mean size of its source. Newton's step is that of
    the gradient's logarithm, which is exact where all sizes are equal; where it leaves what is
    known to hold the root, the middle of that is tried. A source whose target is all it may give has no finite multiplier: null.
    """
    words, scale = F.col("words").cast("double"), F.col("words") / F.col("n")
    full = F.col("target") >= cap * words * (1 - 1e-12)
    fixed = ["no", "target", "scale"]
    start = sources.select("no", "target", scale.alias("scale"), full.alias("full"))
    inf = F.lit(float("inf"))
    state = start.where(~F.col("full") & (F.col("target") > 0)).select(*fixed, F.lit(0.0).alias("lam"), (-inf).alias("low"), inf.alias("high"), F.lit(False).alias("done"))
    state = written(state, "multipliers", 16)
    for _ in range(MOST_ROUNDS):
        if not state.where("NOT done").limit(1).count():
            break
        held = sizes.join(state, "no")
        rate = document_rate(F.col("lam"), F.col("scale"), F.col("size"), F.col("base"), F.col("target"), cap)
        own = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, own * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = held.groupBy(*fixed, "lam", "low", "high").agg(F.sum(own.cast(EXACT)).cast("double").alias("given"), F.sum(slope.cast(EXACT)).cast("double").alias("slope"))
        over = F.col("given") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        step = -F.log(F.col("given") / F.col("target")) * F.col("given") / F.col("slope")
        bounded = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.when(F.col("slope") > 0, step).otherwise(F.when(over, -8.0).otherwise(8.0))))
        near = sums.select(*fixed, "lam", low.alias("low"), high.alias("high"), (F.abs(F.col("given") - F.col("target")) <= TOLERANCE * F.col("target") + 1e-3).alias("done"), (F.col("lam") + bounded).alias("next"))
        inside = (F.col("next") > F.col("low")) & (F.col("next") < F.col("high"))
        middle = F.when((F.col("low") == -inf) | (F.col("high") == inf), F.col("next")).otherwise((F.col("low") + F.col("high")) / 2)
        tight = F.col("done") | (F.col("high") - F.col("low") <= 1e-13 * F.abs(F.col("lam")))
        state = written(near.select(*fixed, F.when(tight, F.col("lam")).when(inside, F.col("next")).otherwise(middle).alias("lam"), "low", "high", tight.alias("done")), "multipliers", 16)
    found = state.select("no", "lam")
    rest = start.where(F.col("full") | (F.col("target") <= 0)).select("no", F.lit(None).cast("double").alias("lam"))
    return found.unionByName(rest)


def copies_to_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: int = 2, lane: int = LANE) -> DataFrame:
    """sizes (doc_id, source, size, and base where documents have base rates above 0, else 1) to a row for each distinct one: with `n_rows`, `source_size`, `target`, `rate` and `copies` (of all its rows together, up to cap a row).

    copies_of_row says how many each of the n_rows takes. Null ids and null sources are values
    like others, so that many rows without id may be one class. Documents of size 0 take their
    rounded base rate, which adds no words. The result depends on the rows alone, so that reruns
    agree. An empty table gives an empty one.
    """
    if "base" not in sizes.columns:
        sizes = sizes.withColumn("base", F.lit(1.0))
    classes = written(sizes.groupBy("doc_id", "source", "size", "base").agg(F.count(F.lit(1)).alias("n_rows")), "mix-classes", 4)
    sources = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("words"), F.sum("n_rows").alias("n"), F.count(F.lit(1)).alias("n_classes"))
    targets = source_targets(sources, share, weights, cap)
    same = F.col("source").eqNullSafe(F.col("_source"))
    named = targets.select(F.col("source").alias("_source"), "no")
    counted = classes.groupBy("source", "size", "base").agg(F.sum("n_rows").alias("n")).join(named, same).select("no", "size", "base", "n")
    lams = multipliers(written(counted, "mix-sizes", 16), targets, cap)
    tilts = targets.join(lams, "no").select(F.col("source").alias("_source"), F.col("words").alias("source_size"), "target", "lam", (F.col("words") / F.col("n")).alias("scale"), F.ceil(F.col("n_classes") / lane).alias("lanes"))
    rate = document_rate(F.col("lam"), F.col("scale"), F.col("size"), F.col("base"), F.col("target"), cap)
    known = classes.join(tilts, same).withColumn("rate", F.coalesce(rate, F.lit(0.0))).drop("_source", "lam", "scale")
    laned = (
        known.withColumn("lane", F.pmod(F.xxhash64("doc_id", "size"), F.col("lanes")))
        .groupBy("source", "source_size", "target", "lane")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "doc_id", "size", "n_rows", "rate"))).alias("docs"))
    )

    def place(state: Column, doc: Column) -> Column:
        size, rows = doc["size"].cast("double"), doc["n_rows"].cast("double")
        want = state["carry"] + doc["rate"] * size * rows
        n = F.when(size > 0, F.least(cap * rows, F.greatest(F.lit(0.0), F.round(want / size)))).otherwise(rows * F.least(F.lit(float(cap)), F.round(doc["rate"])))
        return F.struct((want - n * size).alias("carry"), F.array_append(state["copies"], n.cast("long")).alias("copies"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<bigint>").alias("copies"))
    done = laned.withColumn("copies", F.aggregate("docs", start, place, lambda s: s["copies"]))
    return done.select("source", "source_size", "target", F.inline(F.arrays_zip("docs", "copies"))).select("docs.doc_id", "source", "docs.size", "docs.n_rows", "source_size", "target", "docs.rate", "copies")


def copies_of_row(i: Column) -> Column:
    """Copies of the i-th row, from 0, of a class of n_rows with so many copies in all: whole numbers that differ by one at most."""
    return F.floor(F.col("copies") / F.col("n_rows")) + F.when(i < F.col("copies") % F.col("n_rows"), 1).otherwise(0)


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: int = 2) -> DataFrame:
    """docs (doc_id, text, source and any others) with each row repeated as often as the mix takes it; the same columns.

    Rows of one doc_id, source and size are numbered only where they don't all take equally many
    copies: by parts of a table of theirs, so that no task holds a large class.
    """
    key = ["doc_id", "source", "size"]
    sized = boxed(docs, "doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("key", F.xxhash64(*key))
    chosen = copies_to_targets(sized.select(*key), share, weights, cap).where("copies > 0").select(*[F.col(c).alias(f"_{c}") for c in key], "n_rows", "copies")
    chosen = written(chosen, "mix-copies", 4)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    even = F.col("copies") % F.col("n_rows") == 0
    alike = sized.join(chosen.where(even), same).withColumn("times", F.floor(F.col("copies") / F.col("n_rows")))
    uneven = chosen.where(~even)
    some = maybe_among(sized, uneven.select(F.xxhash64(*[f"_{c}" for c in key]).alias("key"))).join(uneven, same)
    unlike = written(some.withColumn("text_hash", F.xxhash64("row")).withColumn("part", F.struct(F.pmod("text_hash", F.lit(PARTS)).alias("hash"), F.spark_partition_id().alias("task"))), "mix-uneven")
    parts = unlike.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select(*[F.col(c).alias(f"of_{c}") for c in key], F.col("part").alias("of_part"), (F.sum("n").over(W.partitionBy(*key).orderBy("part")) - F.col("n")).alias("before"))
    there = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key] + [F.col("part") == F.col("of_part")]
    nth = F.row_number().over(W.partitionBy(*key, "part").orderBy("text_hash")) - 1
    placed = unlike.withColumn("nth", nth).join(before, there).withColumn("times", copies_of_row(F.col("before") + F.col("nth")))
    taken = alike.select("row", "times").unionByName(placed.select("row", "times")).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = copies_to_targets(docs)
    run = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_rows") - 1) / RUN).cast("int")))
    several = mixed.where("n_rows > 1").withColumn("run", run).repartition(partitions(spark), "doc_id", "source", "size", "run")
    rows = F.explode(F.sequence(F.col("run").cast("long") * RUN, F.least(F.col("n_rows"), (F.col("run").cast("long") + 1) * RUN) - 1))
    each = mixed.where("n_rows = 1").withColumn("taken", F.col("copies")).unionByName(several.withColumn("i", rows).withColumn("taken", copies_of_row(F.col("i"))).drop("run", "i"))
    return each.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("taken")).cast("long").alias("taken"))
