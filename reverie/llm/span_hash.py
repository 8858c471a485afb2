"""Document fingerprints from prefix polynomial hashes.

prefix[i] = sum over j < i of (code point j + 1) * BASE ** j, modulo a prime. Any span's hash
is then a difference of two entries, brought to exponent 0, so that spans are compared in
constant time wherever they stand and the longest common extension of two positions is found
by binary search. A fingerprint keeps the length, a 62-bit hash of the whole text and the
prefix values on a grid from the start and from the end, so that two fingerprints can tell
roughly how much of their texts agrees. Where both prefix arrays are at hand, agreement() reads
these instead and finds equal spans at any offset.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reverie.llm.common import by_id, load, small_batches, written

#: Two primes under 2 ** 31, so that products fit into 64 bits, and their bases.
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 998_244_353)
#: A grid has at most this many cells.
CELLS = 32
SMALLEST_CELL = 8
#: Code points of the spans that start an alignment anew after a difference, in long texts.
SEED = 32
#: Code points that are hashed at a time.
PIECE = 1 << 18
_MASK = np.uint64((1 << 31) - 1)


def _reduced(x: np.ndarray, k: int) -> np.ndarray:
    """x modulo the prime, in place: both primes are a little less than 2 ** 31, so high bits are folded onto the low ones."""
    prime, less = np.uint64(PRIMES[k]), np.uint64((1 << 31) - PRIMES[k])
    for _ in range(2):
        high = x >> np.uint64(31)
        high *= less
        x &= _MASK
        x += high
    np.subtract(x, prime, out=x, where=x >= prime)
    return x


class _Powers:
    """Powers of a base, grown as needed."""

    def __init__(self, base: int, k: int):
        self.base, self.k, self.table = base, k, np.ones(1, np.uint32)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            m = len(self.table)
            more = _reduced(self.table.astype(np.uint64) * np.uint64(pow(self.base, m, PRIMES[self.k])), self.k)
            self.table = np.concatenate((self.table, more.astype(np.uint32)))
        return self.table[:n]


@lru_cache(maxsize=None)
def _powers(k: int, inverse: bool = False) -> _Powers:
    return _Powers(pow(BASES[k], -1, PRIMES[k]) if inverse else BASES[k], k)


class PrefixHash:
    """Prefix arrays of one text under both primes, four bytes a code point each."""

    def __init__(self, text: str | None):
        text = text or ""
        self.n, self.parts, self._seeds = len(text), None, {}
        self.prefix = [np.zeros(self.n + 1, np.uint32) for _ in PRIMES]
        for at in range(0, self.n, PIECE):
            points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            points += np.uint64(1)
            end = at + len(points)
            for k, own in enumerate(self.prefix):
                terms = _reduced(points * _powers(k).upto(end)[at:], k)
                np.cumsum(terms, out=terms)
                terms += np.uint64(own[at])
                own[at + 1 : end + 1] = _reduced(terms, k)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Hash of the code points a to b - 1, the same wherever they stand."""
        return tuple((int(x[b]) - int(x[a])) * pow(BASES[k], -a, p) % p for k, (x, p) in enumerate(zip(self.prefix, PRIMES, strict=True)))

    def same(self, a: int, other: PrefixHash, c: int, size: int) -> bool:
        """Whether span() agrees for size code points from a here and c there; moves one difference to the other's exponents."""
        for k, (x, y, p) in enumerate(zip(self.prefix, other.prefix, PRIMES, strict=True)):
            u, v, shift = int(x[a + size]) - int(x[a]), int(y[c + size]) - int(y[c]), pow(BASES[k], abs(a - c), p)
            if ((u * shift - v) if a < c else (u - v * shift)) % p:
                return False
        return True

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Code points that agree from i here and j there on, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(i, other, j, mid) else (low, mid - 1)
        return low

    def extension_back(self, i: int, other: PrefixHash, j: int) -> int:
        """Code points that agree before i here and j there."""
        low, high = 0, min(i, j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(i - mid, other, j - mid, mid) else (low, mid - 1)
        return low

    def spliced(self, keep: int, other: PrefixHash, take: int) -> PrefixHash:
        """Of the first keep code points here and the first take there, without reading either again."""
        out = PrefixHash.__new__(PrefixHash)
        out.n, out.parts, out._seeds = keep + take, (self, keep, other, take), {}
        out.prefix = []
        for k, (x, y, p) in enumerate(zip(self.prefix, other.prefix, PRIMES, strict=True)):
            shifted = y[1 : take + 1] * np.uint64(pow(BASES[k], keep, p))
            shifted += np.uint64(x[keep])
            out.prefix.append(np.concatenate((x[: keep + 1], _reduced(shifted, k).astype(np.uint32))))
        return out

    def seeds(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the spans of that size that may start an alignment, the same spans in every text.

        These are the ones whose hash (of the first prime, at exponent 0) is a multiple of an
        eighth of the size. A spliced text has those of its two parts.
        """
        if size not in self._seeds:
            if self.parts:
                one, keep, two, take = self.parts
                (p, x), (q, y) = one.seeds(size), two.seeds(size)
                m, n = np.searchsorted(p, keep - size, "right"), np.searchsorted(q, take - size, "right")
                self._seeds[size] = np.concatenate((p[:m], q[:n] + keep)), np.concatenate((x[:m], y[:n]))
            else:
                x, step, found = self.prefix[0], np.uint64(max(1, size // 8) - 1), []
                for a in range(0, max(0, self.n - size + 1), PIECE):
                    b = min(a + PIECE, self.n - size + 1)
                    value = x[a + size : b + size] + np.uint64(PRIMES[0])
                    value -= x[a:b]
                    value *= _powers(0, True).upto(b)[a:]
                    value = _reduced(value, 0)
                    at = np.flatnonzero((value & step) == 0)
                    found.append((at + a, value[at]))
                none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
                self._seeds[size] = tuple(map(np.concatenate, zip(*found, strict=True))) if found else none
        return self._seeds[size]


def cell_of(n: int) -> int:
    """The smallest power of two, SMALLEST_CELL at least, that cuts n into CELLS cells at most."""
    cell = SMALLEST_CELL
    while cell * CELLS < n:
        cell *= 2
    return cell


def fingerprint(h: PrefixHash) -> str:
    """length:hash:values from the start:values from the end (hexadecimal, eight digits a value)."""
    cell = cell_of(h.n)
    at = np.arange(1, h.n // cell + 1) * cell
    x = h.prefix[0]
    show = lambda v: "".join(f"{int(i):08x}" for i in v)
    return f"{h.n}:{int(h.prefix[0][h.n]):08x}{int(h.prefix[1][h.n]):08x}:{show(x[at])}:{show(x[h.n - at])}"


def _parsed(f: str) -> tuple[int, str, np.ndarray, np.ndarray]:
    n, whole, a, b = f.split(":")
    values = lambda s: np.array([int(s[i : i + 8], 16) for i in range(0, len(s), 8)], np.int64)
    return int(n), whole, values(a), values(b)


def likeness(f: str, g: str) -> float:
    """Share of the longer text that lies in cells agreeing at the same distance from the start or from the end; 1 for equal texts, 0 if just one is empty.

    Both grids are read at the wider cell. The run of agreeing cells from either side is found by
    binary search over the prefix values; the cells between are compared one by one.
    """
    (n, whole, a, za), (m, other, b, zb) = _parsed(f), _parsed(g)
    if n == m and whole == other:
        return 1.0
    if not n or not m:
        return 0.0
    cell = max(cell_of(n), cell_of(m))
    k = min(n, m) // cell
    if not k:
        return 0.0
    p = PRIMES[0]
    grid = lambda v, x: v[cell // cell_of(x) - 1 :: cell // cell_of(x)][:k]
    a, b, za, zb = grid(a, n), grid(b, m), grid(za, n), grid(zb, m)
    # cells from the start: differences of prefix values at the same exponents
    front = np.diff(a, prepend=0) % p == np.diff(b, prepend=0) % p
    run = _run(a == b)
    front[:run] = True
    # cells from the end: the shorter text's values are moved to the exponents of the longer
    total = lambda w: int(w[:8], 16)
    ends = lambda v, w: (np.concatenate(([total(w)], v[:-1])) - v) % p
    ea, eb = ends(za, whole), ends(zb, other)
    shift = pow(BASES[0], abs(n - m), p)
    if n < m:
        ea = ea * shift % p
    else:
        eb = eb * shift % p
    back = ea == eb
    # in the longer text: cells from the start cover [i * cell, ..), those from the end [n - (i + 1) * cell, ..)
    covered, top = [], max(n, m)
    for i in range(k):
        if front[i]:
            covered.append((i * cell, (i + 1) * cell))
        if back[i]:
            covered.append((top - (i + 1) * cell, top - i * cell))
    end = got = 0
    for x, y in sorted(covered):
        got += max(0, y - max(x, end))
        end = max(end, y)
    return min(got, min(n, m)) / top


def _run(equal: np.ndarray) -> int:
    """Length of the agreeing run at the start: prefix values agree up to the first difference, so binary search finds its end."""
    low, high = 0, len(equal)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if equal[mid - 1] else (low, mid - 1)
    return low


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and for each in that order the key with how often it stood before."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order, (own << np.uint64(32)) | rank.astype(np.uint64)


def _rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence."""
    ends, places, before = [], [], [0] * len(values)
    for i, v in enumerate(values):
        t = bisect_left(ends, v)
        before[i] = places[t - 1] if t else -1
        if t == len(ends):
            ends.append(v)
            places.append(i)
        else:
            ends[t], places[t] = v, i
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _equal(h: PrefixHash, a: np.ndarray, g: PrefixHash, c: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Whether spans agree by the prime k: each difference is moved by the exponent of the other."""
    x, y, p, power = h.prefix[k], g.prefix[k], np.uint64(PRIMES[k]), _powers(k).upto(max(h.n, g.n) + 1)
    u, v = x[a + size] + p, y[c + size] + p
    u -= x[a]
    v -= y[c]
    u *= power[c]
    v *= power[a]
    return _reduced(u, k) == _reduced(v, k)


def _extensions(h: PrefixHash, i: np.ndarray, g: PrefixHash, j: np.ndarray, most: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Longest common extensions of many places at once, most at most, where back before them: binary searches side by side."""
    at = lambda size: (h, i - back * size, g, j - back * size, size)
    low, high = np.where(_equal(*at(most), 0), most, 0), most.copy()
    high[low < most] -= 1
    while (low < high).any():
        mid = (low + high + 1) // 2
        equal = _equal(*at(mid), 0)
        low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
    for t in np.flatnonzero(~_equal(*at(low), 1)):  # the second prime disagrees: search again under both
        own = h.extension_back(int(i[t]), g, int(j[t])) if back[t] else h.extension(int(i[t]), g, int(j[t]))
        low[t] = min(own, most[t])
    return low


def _aligned(h: PrefixHash, a: int, b: int, g: PrefixHash, c: int, d: int) -> int:
    """Code points from a to b here and c to d there that equal spans pair, in the same order on both sides.

    The r-th occurrence of a seed here meets the r-th there; a longest chain of such meetings
    is kept, and between its seeds the longest common extensions forward and back.
    """
    least = min(b - a, d - c)
    if least <= 0:
        return 0
    size = min(SEED, max(least.bit_length(), least // 32))
    (p, x), (q, y) = h.seeds(size), g.seeds(size)
    mine, theirs = slice(*np.searchsorted(p, (a, b - size + 1))), slice(*np.searchsorted(q, (c, d - size + 1)))
    p, x, q, y = p[mine], x[mine], q[theirs], y[theirs]
    if not len(p) or not len(q):
        return 0
    (p_order, x), (q_order, y) = _ranked(x), _ranked(y)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0
    i, j = p[p_order[i]], q[q_order[j]]
    order = np.argsort(i)
    i, j = i[order], j[order]
    real = _equal(h, i, g, j, np.full(len(i), size), 1)
    i, j = i[real], j[real]
    chain = _rising(j.tolist())
    if not chain:
        return 0
    i, j = i[chain], j[chain]
    # gaps before the first seed, between neighbours and after the last: where they begin and end on both sides
    ends = lambda v, first, last: (np.concatenate(([first], v + size)), np.concatenate((v, [last])))
    (i0, i1), (j0, j1) = ends(i, a, b), ends(j, c, d)
    room = np.minimum(i1 - i0, j1 - j0)
    got = size * len(i) + int(np.minimum(room, 0).sum())
    open_ = room > 0
    i0, i1, j0, j1, room = i0[open_], i1[open_], j0[open_], j1[open_], room[open_]
    if len(room):
        n, back = len(room), np.repeat((False, True), len(room))
        both = _extensions(h, np.concatenate((i0, i1)), g, np.concatenate((j0, j1)), np.concatenate((room, room)), back)
        got += int(np.minimum(both[:n] + both[n:], room).sum())
    return got


def agreement(h: PrefixHash, g: PrefixHash) -> float:
    """Share of the longer text that agrees with the other in the same order, at whatever offset; 1 for equal texts, 0 if just one is empty.

    The longest common extensions from both ends are found by binary search; between them, the
    alignment starts anew after each difference at spans that are equal, and extends from these.
    """
    n, m = h.n, g.n
    if not n or not m:
        return float(n == m)
    front = h.extension(0, g, 0)
    back = min(h.extension_back(n, g, m), min(n, m) - front)
    return (front + back + _aligned(h, front, n - back, g, front, m - back)) / max(n, m)


ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, edge string, text string"


def _edited(doc_id, text: str, h: PrefixHash, after: str, g: PrefixHash) -> tuple:
    """A row: the last half of text's code points gives way to the first as many of the next document."""
    half = h.n // 2
    take = min(half, g.n)
    changed = text[: h.n - half] + after[:take]
    edited = h.spliced(h.n - half, g, take)
    digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
    return (doc_id, h.n, digest, fingerprint(h), fingerprint(edited), agreement(h, edited), agreement(h, g))


_COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def _with_next(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted documents to rows; a part's first text and its last document, which awaits the next part's first, go out as edges."""
    from pyspark import TaskContext

    part, held = TaskContext.get().partitionId(), None
    for frame in frames:
        rows = []
        for d, t in zip(frame["doc_id"], frame["text"], strict=True):
            d, t = None if pd.isna(d) else int(d), t or ""
            h = PrefixHash(t)
            if held is None:
                rows.append((None,) * 7 + (part, "first", t))
            else:
                rows.append(_edited(*held, t, h) + (part, None, None))
            held = (d, t, h)
        yield pd.DataFrame(rows, columns=_COLUMNS, dtype=object).astype({"doc_id": "Int64", "n_chars": "Int64"})
    if held is not None:
        yield pd.DataFrame([(held[0],) + (None,) * 6 + (part, "last", held[1])], columns=_COLUMNS, dtype=object).astype({"doc_id": "Int64", "n_chars": "Int64"})


def _edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [_edited(None if pd.isna(d) else int(d), t or "", PrefixHash(t), a or "", PrefixHash(a)) for d, t, a in zip(frame["doc_id"], frame["text"], frame["after"], strict=True)]
        yield pd.DataFrame(rows, columns=_COLUMNS[:7], dtype=object).astype({"doc_id": "Int64"})


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next doc_id, null ids first and equal ids by a hash of the
    text; after the last comes the first. Null texts count as empty; a single document follows
    itself; an empty table gives an empty one. Documents move once, by ranges of doc_id and that
    hash, so that rows of one id, or without one, are spread too; each range leaves two documents, its edges, which
    are joined to those of the neighbouring range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = written(by_id(docs).mapInPandas(_with_next, ROWS), "fingerprints")
    parts = sorted(r["part"] for r in rows.where("edge = 'first'").select("part").collect())  # the non-empty ranges, n at most
    after = dict(zip(parts, parts[1:] + parts[:1], strict=True))
    done = rows.where("edge IS NULL").select(*_COLUMNS[:7])
    if not parts:
        return done
    link = spark.createDataFrame(list(after.items()), "part int, following int")
    last = rows.where("edge = 'last'").select("doc_id", "text", "part").join(link, "part")
    first = rows.where("edge = 'first'").select(F.col("part").alias("following"), F.col("text").alias("after"))
    return done.unionByName(last.join(first, "following").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "after").mapInPandas(_edges, ", ".join(ROWS.split(", ")[:7])))


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents"))
