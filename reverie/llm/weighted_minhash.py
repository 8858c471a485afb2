"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles of five words weigh their count times a damped inverse document frequency.
Consistent samples of them agree between two texts with the probability of their weighted
Jaccard similarity; bands of samples are bucket keys, and pairs from buckets are verified on
the whole texts' weights. Links make classes as connected components.

Document frequencies count texts of different words, so that exact copies weigh nothing, in a
count-min sketch over all documents. From each counter the mean load of the others is taken, so
that what is left errs by a share of the texts that shrinks as they grow in number. A shingle of
one text weighs 1, and so does one that fewer than SELDOM of the texts have; from there the weight
falls with the logarithm of that share to LEAST_IDF for one that all texts have. So a weight
depends on the share of texts, not on their number. The range is wide enough to prefer what is
rare, and narrow enough that a large group of near copies, whose common shingles are frequent
because of the group, keeps its similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reverie.llm.common import boxed, load, runs_of, small_batches, written
from reverie.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 12
ROWS = 4
#: Sketch of document frequencies: rows and counters of a row.
DEPTH, WIDTH = 2, 1 << 18
CHUNK = 1 << 13
#: Inverse document frequency of a shingle that all texts have, and the share of texts up to which it is 1.
LEAST_IDF, SELDOM = 0.8, 1e-3
#: Sampling draws (r, c, beta) come from a table of this many, picked by a hash of shingle and draw.
POOL = 1 << 14
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(texts) -> list[tuple[np.ndarray, int, int]]:
    """For each text its shingles (32-bit hashes in order, repeats kept) and two hashes of its whole word sequence.

    Words are lower-cased and split at ASCII white space. One to four words are one shingle; no
    words, none.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    data = pc.utf8_lower(pc.fill_null(pa.array(texts, pa.large_string(), from_pandas=True), ""))
    split = pc.ascii_split_whitespace(data)
    coded = split.flatten().dictionary_encode()
    of = coded.indices.to_numpy(zero_copy_only=False)
    unique = coded.dictionary.to_pandas()
    hashes = _mixed(pd.util.hash_array(unique.to_numpy(object), categorize=False).astype(np.uint64)) if len(unique) else np.zeros(0, np.uint64)
    there = (unique != "").to_numpy(bool)[of] if len(unique) else np.zeros(0, bool)
    bounds = np.concatenate(([0], np.cumsum(there)))[split.offsets.to_numpy()]
    words = hashes[of[there]]
    n = len(words)
    full = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            full = full * _ODD + words[k : n - SHINGLE + 1 + k]
        full = (_mixed(full) >> np.uint64(32)).astype(np.uint32)
        place = np.arange(n, dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
        one, two = _mixed(words + place * _ODD), _mixed((words ^ _ODD) + place * np.uint64(0xC2B2AE3D27D4EB4F))
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                own = full[a : b - SHINGLE + 1]
            elif b > a:
                own = (_mixed(np.array([np.bitwise_xor.reduce(one[a:b]) + np.uint64(b - a)])) >> np.uint64(32)).astype(np.uint32)
            else:
                own = np.zeros(0, np.uint32)
            out.append((own, int(one[a:b].sum(dtype=np.uint64).astype(np.int64)), int(two[a:b].sum(dtype=np.uint64).astype(np.int64))))
    return out


def _counters(u: np.ndarray) -> tuple[np.ndarray, ...]:
    x = _mixed(u.astype(np.uint64) + np.uint64(1))
    return (x % np.uint64(WIDTH)).astype(np.int64), ((x >> np.uint64(32)) % np.uint64(WIDTH)).astype(np.int64)


class _Sketch:
    """Document frequencies in DEPTH rows of WIDTH counters."""

    def __init__(self):
        self.table, self.docs = np.zeros((DEPTH, WIDTH), np.int64), 0

    def add(self, texts: list[np.ndarray], times: np.ndarray) -> None:
        own = [np.unique(s) for s in texts]
        weight = np.repeat(times.astype(float), [len(s) for s in own])
        self.docs += int(times.sum())
        for row, at in zip(self.table, _counters(np.concatenate([np.zeros(0, np.uint32), *own])), strict=True):
            row += np.bincount(at, weight, WIDTH).astype(np.int64)

    def rows(self, part: int) -> pd.DataFrame:
        flat = self.table.ravel()
        chunks = range(0, len(flat), CHUNK)
        return pd.DataFrame({"part": [part] * len(chunks), "chunk": [i // CHUNK for i in chunks], "docs": self.docs, "counts": [flat[i : i + CHUNK].tobytes() for i in chunks]})


def _keys_and_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document with the hashes of its words, null without words, and the task's sketch."""
    from pyspark import TaskContext

    sketch = _Sketch()
    columns = ["doc_id", "one", "two", "part", "chunk", "docs", "counts"]
    kinds = dict.fromkeys(columns[:-1], "Int64") | {"counts": object}
    for frame in frames:
        for run in runs_of(frame["text"]):
            ids, own = frame["doc_id"].to_numpy(np.int64)[run], shingles_of(frame["text"].iloc[run])
            known, worded = frame["known"].to_numpy(bool)[run], np.array([len(s) > 0 for s, _, _ in own], bool)
            counts = worded & known
            sketch.add([s for (s, _, _), c in zip(own, counts, strict=True) if c], np.ones(int(counts.sum()), np.int64))
            key = lambda k: pd.array([x[k] if w else None for x, w in zip(own, worded, strict=True)], "Int64")  # noqa: E731, B023
            yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids, ~known), "one": key(1), "two": key(2)}).reindex(columns=columns).astype(kinds)
    if sketch.docs:
        yield sketch.rows(TaskContext.get().partitionId()).reindex(columns=columns).astype(kinds)


def _less_copies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sketch of what copies counted too often: texts (vector, times)."""
    from pyspark import TaskContext

    sketch, seen = _Sketch(), False
    for frame in frames:
        seen = seen or len(frame) > 0
        for a in range(0, len(frame), 256):
            sketch.add([np.frombuffer(v, "<u4") for v in frame["vector"].iloc[a : a + 256]], frame["times"].to_numpy(np.int64)[a : a + 256])
    if seen:
        yield sketch.rows(TaskContext.get().partitionId())


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(b, np.int64) for b in frame["counts"]], 0)
    return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "chunk": [int(frame["chunk"].iloc[0])], "docs": [int(frame["docs"].sum())], "counts": [total.tobytes()]})


SKETCH = "part int, chunk int, docs long, counts binary"


def weights_table(sketches: DataFrame) -> np.ndarray:
    """The shingle weights by sketch counter, from tasks' sketches: DEPTH * WIDTH floats, whatever the input.

    Sketches are added 64 at a time until 64 are left, so that no group grows with the input.
    """
    parts = sketches
    while (parts.agg(F.max("part")).first()[0] or 0) >= 64:
        parts = written(parts.withColumn("part", (F.col("part") / 64).cast("int")).groupBy("part", "chunk").applyInPandas(_add, SKETCH), "sketch")
    rows = parts.withColumn("part", F.lit(0)).groupBy("part", "chunk").applyInPandas(_add, SKETCH).collect()  # DEPTH * WIDTH counters
    if not rows:
        return np.ones((DEPTH, WIDTH), np.float32)
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["chunk"])]).reshape(DEPTH, WIDTH)
    return _idf(counts, max(1, rows[0]["docs"])).astype(np.float32)


def _idf(counts: np.ndarray, n: int) -> np.ndarray:
    """Weights by counter: of the share of other texts that have a shingle, less what other shingles bring to a counter on average."""
    load = counts.sum(1, keepdims=True)
    others = np.round(counts - (load - counts) / (counts.shape[1] - 1)) - 1
    share = np.clip(others / n, SELDOM, 1.0)
    return LEAST_IDF + (1 - LEAST_IDF) * np.log(share) / np.log(SELDOM)


def weighted(shingles: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their TF-IDF weights."""
    u, tf = np.unique(shingles, return_counts=True)
    a, b = _counters(u)
    return u, tf * np.maximum(table[0][a], table[1][b]).astype(np.float64)


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20_240_501)
    r, c, beta = rng.gamma(2, 1, POOL), np.log(rng.gamma(2, 1, POOL)), rng.random(POOL)
    odd = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    return r, c, beta, c - r * (1 - beta), odd


def band_keys(u: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A key for each band, from its ROWS consistent samples (shingle, step)."""
    r, c, beta, plain, odd = _draws()
    x = _mixed(u.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(11))
    best, pick = np.full(len(odd), np.inf), np.zeros(len(odd), np.int64)
    log = np.log(weight)
    for at in range(0, len(u), 2048):  # blocks that stay in the CPU's cache
        draw = ((x[at : at + 2048, None] * odd) >> np.uint64(50)).astype(np.intp)
        a = plain[draw]
        rest = np.flatnonzero(log[at : at + 2048])
        if len(rest):
            d = draw[rest]
            step = np.floor(log[at : at + 2048][rest, None] / r[d] + beta[d])
            a[rest] = c[d] - r[d] * (step - beta[d] + 1)
        first = a.argmin(0)
        least = a[first, np.arange(len(odd))]
        better = least < best
        best[better], pick[better] = least[better], first[better] + at
    draw = ((x[pick] * odd) >> np.uint64(50)).astype(np.intp)
    step = np.floor(log[pick] / r[draw] + beta[draw]).astype(np.int64)
    sample = _mixed(u[pick].astype(np.uint64) * _ODD + step.astype(np.uint64))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * _ODD + sample[k::ROWS])
    return key.astype(np.int64)


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of the lesser over sum of the greater weights."""
    (u, a), (v, b) = one, two
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = np.minimum(a[i], b[j]).sum()
    either = a.sum() + b.sum() - both
    return float(both / either) if either else 0.0


def _bands(frames: Iterator[pd.DataFrame], table: np.ndarray) -> Iterator[pd.DataFrame]:
    with np.errstate(over="ignore"):
        for frame in frames:
            for run in runs_of(frame["text"]):
                own = [x for x in shingles_of(frame["text"].iloc[run]) if len(x[0])]
                if own:
                    yield pd.DataFrame({"one": [x[1] for x in own], "two": [x[2] for x in own], "keys": [band_keys(*weighted(x[0], table)).tolist() for x in own]})


def _vectors(frames: Iterator[pd.DataFrame], table: np.ndarray | None) -> Iterator[pd.DataFrame]:
    """The shingles, sorted, of texts that have the words of their node, and with table what they weigh."""
    for frame in frames:
        for run in runs_of(frame["text"]):
            own, f = shingles_of(frame["text"].iloc[run]), frame.iloc[run]
            same = [(x[1], x[2]) == (a, b) for x, a, b in zip(own, f["one"], f["two"], strict=True)]
            kept = [x[0] for x, s in zip(own, same, strict=True) if s]
            with np.errstate(over="ignore"):
                total = [0.0 if table is None else float(weighted(x, table)[1].sum()) for x in kept]
            yield pd.DataFrame({"node": f["node"].to_numpy()[np.array(same, bool)], "vector": [np.sort(x).astype("<u4").tobytes() for x in kept], "total": total})


def _verify(frames: Iterator[pd.DataFrame], table: np.ndarray) -> Iterator[pd.DataFrame]:
    seen: dict[int, tuple] = {}

    def vector(node: int, data: bytes) -> tuple:
        if node not in seen:
            if len(seen) >= 256:
                seen.clear()
            seen[node] = weighted(np.frombuffer(data, "<u4"), table)
        return seen[node]

    with np.errstate(over="ignore"):
        for frame in frames:
            sims = [similarity(vector(a, x), vector(b, y)) for a, b, x, y in zip(frame["a"], frame["b"], frame["x"], frame["y"], strict=True)]
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "similarity": sims})


def _spread(frames: Iterator[pd.DataFrame], table: np.ndarray) -> Iterator[pd.DataFrame]:
    with np.errstate(over="ignore"):
        for frame in frames:
            for node, data in zip(frame["node"], frame["vector"], strict=True):
                u, weight = weighted(np.frombuffer(data, "<u4"), table)
                yield pd.DataFrame({"shingle": u.view(np.int32), "node": node, "weight": weight})


def _bounded(state: DataFrame, pivots: DataFrame, tested: DataFrame, vectors: DataFrame, table: np.ndarray, least: float) -> DataFrame:
    """Rows of state (key, node, part) whose node may reach the similarity with another of its bucket, with t, u and b.

    t is the text's weight, u that of its shingles that no other text here has, b what it shares with
    its bucket's first pivot (key, pivot; tested has the similarities). Two texts share at most
    the lesser t - u, and a union weighs at least the lightest text of the bucket, m, and u; so a
    similarity is at most (t - u) / (max(m, t - u) + u), and rows that fall short are left out.
    """
    nodes = state.select("node").union(pivots.join(state.select("key"), "key", "left_semi").select("pivot")).distinct()
    own = vectors.join(nodes, "node", "left_semi")
    spread = own.select("node", "vector").mapInPandas(partial(_spread, table=table), "shingle int, node long, weight double")
    single = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight")).where("n = 1")
    alone = single.groupBy("node").agg(F.sum("weight").alias("u"))
    known = written(own.select("node", F.col("total").alias("t")).join(alone, "node", "left").select("node", "t", F.coalesce("u", F.lit(0.0)).alias("u")), "bounds", 16)
    beside = state.join(known, "node").join(pivots, "key").withColumn("a", F.least("node", "pivot")).withColumn("b", F.greatest("node", "pivot"))
    rated = beside.join(tested, ["a", "b"]).join(known.select(F.col("node").alias("pivot"), F.col("t").alias("pivot_t")), "pivot")
    shared = F.col("similarity") * (F.col("t") + F.col("pivot_t")) / (1 + F.col("similarity"))
    rated = written(rated.select("key", "node", "part", "t", "u", shared.alias("b")), "rated", 16)
    lightest = rated.groupBy("key").agg(F.min("t").alias("m"))
    most = (F.col("t") - F.col("u")) / (F.greatest("m", F.col("t") - F.col("u")) + F.col("u"))
    return rated.join(lightest, "key").where(most >= least - 1e-9).drop("m")


def _may_link(least: float):
    """Whether two of a bucket (t, u, b; the other's with pivot_) may reach the similarity.

    Of what they share, the first pivot has at most the lesser b; the rest lies in neither's
    share with it and in neither's own shingles, so it is at most the lesser t - b - u.
    """
    rest = F.least(F.col("t") - F.col("b") - F.col("u"), F.col("pivot_t") - F.col("pivot_b") - F.col("pivot_u"))
    shared = F.least("b", "pivot_b") + F.greatest(rest, F.lit(0.0))
    return shared / (F.col("t") + F.col("pivot_t") - shared) >= least - 1e-9


def _links(members: DataFrame, vectors: DataFrame, table: np.ndarray, least: float) -> tuple[DataFrame | None, DataFrame | None]:
    """Links between members (key, node) of the same buckets that join all components, and node, component.

    A round picks pivots of each bucket and verifies them against its other members. Two members
    that share a component need no further test, and a pivot has had all of its own; so a bucket
    is done when its members that were no pivots are of one component. The first pivot is the
    member that most others meet in their buckets, as is the original of a group of copies; what
    each shares with it then rules out most other pairs. Later pivots come from the smaller
    components first, eight times as many with each round. So every pair of a bucket is tested,
    ruled out or joined already, without a large group being paired out.
    """

    def verified(pairs: DataFrame) -> DataFrame:
        texts = pairs.join(vectors.select(F.col("node").alias("a"), F.col("vector").alias("x")), "a").join(vectors.select(F.col("node").alias("b"), F.col("vector").alias("y")), "b")
        return written(texts.mapInPandas(partial(_verify, table=table), "a long, b long, similarity double"), "tested", 4)

    def still_open(state: DataFrame) -> DataFrame:
        parts = state.groupBy("key").agg((F.max("part") > F.min("part")).alias("open")).where("open").select("key")
        return written(state.join(parts, "key", "left_semi"), "buckets", 16)

    linked = F.col("similarity") >= least - 1e-9  # sums of weights are rounded
    if members.isEmpty():
        return None, None
    met = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").groupBy("node").agg(F.sum("n").alias("met"))
    best = F.max_by("node", F.struct("met", F.xxhash64("node"), "node")).alias("pivot")
    firsts = written(members.join(met, "node").groupBy("key").agg(best), "pivots", 16)
    pairs = members.join(firsts, "key").where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    tested = verified(pairs)
    found = tested.where(linked)
    parts = components(found)
    rest = members.join(firsts, "key").where("node <> pivot").select("key", "node")
    state = still_open(rest.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")))
    if not state.isEmpty():
        state = still_open(_bounded(state, firsts, tested, vectors, table, least))
    pivots = 8
    while not state.isEmpty():
        sized = state.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
        order = W.partitionBy("key").orderBy("n", F.xxhash64("node"), "node")
        ranked = state.join(sized, ["key", "part"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots)
        chosen = written(ranked.select("key", F.col("node").alias("pivot"), F.col("part").alias("own"), *[F.col(c).alias(f"pivot_{c}") for c in "tub"]), "pivots", 16)
        listed = state.join(state.groupBy("node").agg(F.collect_set("key").alias("keys")), "node")  # BANDS keys at most
        asking = chosen.join(chosen.groupBy("pivot").agg(F.collect_set("key").alias("pivot_keys")), "pivot")
        once = F.col("key") == F.array_min(F.array_intersect("keys", "pivot_keys"))
        apart = listed.join(asking, "key").where((F.col("part") != F.col("own")) & _may_link(least) & once)
        new = verified(apart.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()).where(linked)
        found = written(found.union(new).dropDuplicates(["a", "b"]), "links", 16)
        parts = components(found)
        rest = state.join(chosen.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti").drop("part")
        state = still_open(rest.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"))
        pivots *= 8
    return found, parts


def _classed(docs: DataFrame, least: float) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, class_id, n_copies, n_links, the hashes of its words (one, two), and whether it stands for its class.

    A node is a text: the least doc_id that has it, or a hash where that id has several texts.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
    read = written(named.mapInPandas(_keys_and_counts, f"doc_id long, one long, two long, {SKETCH}"), "keys")
    keyed, there = read.where("part IS NULL").select("doc_id", "one", "two"), "one IS NOT NULL AND doc_id IS NOT NULL"
    grouped = keyed.where(there).groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_copies"))
    place = F.row_number().over(W.partitionBy("first").orderBy("one", "two"))
    classes = written(grouped.withColumn("node", F.when(place == 1, F.col("first")).otherwise(F.xxhash64("one", "two", "first"))), "classes", 4)

    def vectors_of(nodes: DataFrame, table: np.ndarray | None = None) -> DataFrame:
        """node, vector, total of nodes (node, first, one, two)."""
        texts = docs.join(nodes, docs["doc_id"] == nodes["first"]).select("node", "one", "two", "text")
        return written(texts.mapInPandas(partial(_vectors, table=table), "node long, vector binary, total double").dropDuplicates(["node"]), "vectors")

    copied = classes.where("n_copies > 1")
    copies = vectors_of(copied.select("node", "first", "one", "two")).join(copied.select("node", (1 - F.col("n_copies")).alias("times")), "node").select("vector", "times")
    sketches = read.where("part IS NOT NULL").select("part", "chunk", "docs", "counts").union(written(copies.mapInPandas(_less_copies, SKETCH), "sketch"))
    table = weights_table(sketches)
    bands = docs.where("doc_id IS NOT NULL").select("text").mapInPandas(partial(_bands, table=table), "one long, two long, keys array<long>")
    filed = written(bands.dropDuplicates(["one", "two"]).join(classes, ["one", "two"]).select("node", F.explode("keys").alias("key")), "bands", 4)
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = written(filed.join(shared, "key", "left_semi").distinct(), "members", 8)
    wanted = classes.select("node", "first", "one", "two").join(members.select("node").distinct(), "node", "left_semi")
    links, parts = _links(members, vectors_of(wanted, table), table, least)
    if links is None:
        known = classes.select("one", "two", "n_copies", F.lit(0).cast("long").alias("n_links"), F.struct("first", "one", "two").alias("stands"))
    else:
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
        joined = classes.join(parts.join(ends, "node", "left"), "node", "left")
        stands = joined.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("first", "one", "two")).alias("stands"))
        known = joined.join(stands, "component", "left").select("one", "two", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("stands", F.struct("first", "one", "two")).alias("stands"))
    kept = (F.col("doc_id") == F.col("stands.first")) & (F.col("one") == F.col("stands.one")) & (F.col("two") == F.col("stands.two"))
    judged = keyed.where(there).join(known, ["one", "two"]).select("doc_id", F.col("stands.first").alias("class_id"), "n_copies", "n_links", "one", "two", kept.alias("kept"))
    alone = keyed.where(f"NOT ({there})").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), "one", "two", F.lit(True).alias("kept"))
    return judged.unionByName(alone)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, class_id, n_copies, n_links.

    class_id is the least doc_id of those that are joined by links of at least that similarity, or
    have the same words; n_copies counts the rows with just these words, n_links the other texts
    they are linked to. Texts without words (null, empty) are classes of their own, and so are
    rows without doc_id, whose class_id is null; rows that share a doc_id and differ in text are
    judged by their texts. An empty table gives an empty one.
    """
    return _classed(docs, least).select("doc_id", "class_id", "n_copies", "n_links")


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for run in runs_of(frame["text"]):
            own, f = shingles_of(frame["text"].iloc[run]), frame.iloc[run]
            key = lambda k: [x[k] if len(x[0]) else 0 for x in own]  # noqa: E731, B023
            yield pd.DataFrame({"gone": f["gone"].to_numpy(np.int64), "text_hash": f["text_hash"].to_numpy(), "one": key(1), "two": key(2)})


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs less the rows of each class but those that have its least doc_id and that one's words; rows without doc_id stay.

    Texts without words are equal texts: of these the rows of the least doc_id stay. Where every doc_id has
    one text, ids alone say what goes; only the rows of ids with several are also told apart by their texts.
    """
    blank = F.col("one").isNull() & F.col("doc_id").isNotNull()
    judged = written(_classed(docs, least).select("doc_id", F.coalesce("one", F.lit(0)).alias("one"), F.coalesce("two", F.lit(0)).alias("two"), "kept", blank.alias("blank")), "judged")
    first = judged.where("blank").agg(F.min("doc_id")).first()[0]
    judged = judged.withColumn("kept", F.when(F.col("blank"), F.col("doc_id") == F.lit(first).cast("long")).otherwise(F.col("kept")))
    key = F.struct("one", "two")
    several = judged.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("gone")).agg((F.min(key) < F.max(key)).alias("several")).where("several").select("gone")
    gone = judged.where("NOT kept")
    own = boxed(docs, F.col("doc_id").cast("long").alias("gone"), F.xxhash64("text").alias("text_hash"), "text")
    if several.isEmpty():
        return own.join(gone.select(F.col("doc_id").alias("gone")).distinct(), "gone", "left_anti").select("row.*")
    single = own.join(several, "gone", "left_anti").join(gone.select(F.col("doc_id").alias("gone")).distinct(), "gone", "left_anti")
    many = own.join(several, "gone", "left_semi")
    hashed = many.select("gone", "text_hash", "text").mapInPandas(_hashed, "gone long, text_hash long, one long, two long").distinct()
    out = hashed.join(gone.select(F.col("doc_id").alias("gone"), "one", "two").distinct(), ["gone", "one", "two"]).select("gone", "text_hash")
    return single.select("row.*").union(many.join(out, ["gone", "text_hash"], "left_anti").select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
