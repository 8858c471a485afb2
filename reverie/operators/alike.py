"""Who is the first of several candidates of a name that a mention is obviously the same as.

Mentions of one name meet its candidates in groups of bounded size; the telling words of either
travel as one string.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd

#: Candidates that a mention is compared with one by one before it looks up its words in all of them.
NEAR = 8


def same_context(a: set[str], b: set[str]) -> bool:
    """As upkeep.same_context: whether telling words share two, or a long one that is a fair part of the fewer."""
    shared = a & b
    return len(shared) >= 2 or (len(shared) == 1 and len(next(iter(shared))) >= 6 and 1 / max(min(len(a), len(b)), 1) >= 0.12)


class Candidates:
    """Candidates of one name in their order: what each is (None: unknown), whether it is anyone's, its telling words."""

    def __init__(self):
        self.kinds: list[str | None] = []
        self.telling: list[set[str]] = []
        self.bare: dict[str | None, int] = {}  # the first of each kind that is anyone's
        self.having: dict[str, list[int]] = {}
        self.words: dict[str, str] = {}  # a word's one object

    def add(self, kind: str | None, bare: bool, telling: str) -> None:
        k = len(self.kinds)
        own = {self.words.setdefault(w, w) for w in telling.split()}
        self.kinds.append(kind)
        self.telling.append(own)
        if bare:
            self.bare.setdefault(kind, k)
        for w in own:
            self.having.setdefault(w, []).append(k)

    def first(self, kind: str | None, telling: str) -> int | None:
        """The first candidate whose kind does not conflict and that is anyone's or has the same context."""
        anyone = [k for of, k in self.bare.items() if of is None or kind is None or of == kind]
        end, words = min(anyone, default=len(self.kinds)), set(telling.split())
        for k in range(min(NEAR, end)):
            if self._typed(k, kind) and same_context(self.telling[k], words):
                return k
        if end > NEAR:
            shared = Counter(k for w in words if w in self.having for k in self.having[w])
            for k in sorted(shared):
                if k >= end:
                    break
                if self._typed(k, kind) and (shared[k] >= 2 or same_context(self.telling[k], words)):
                    return k
        return end if anyone else None

    def _typed(self, k: int, kind: str | None) -> bool:
        return kind is None or self.kinds[k] is None or self.kinds[k] == kind


def known(x):
    """None for what pandas has in a missing string's place."""
    return x if isinstance(x, str) else None


def settled(rows: pd.DataFrame) -> pd.DataFrame:
    """rows (name, memory_id, kind, bare, telling) of one name, each with the mention that it is the same as (first), in their order; its own where it makes an entity."""
    rows = rows.sort_values("memory_id", kind="stable").reset_index(drop=True)
    made, makers, first = Candidates(), [], []
    for i, (kind, bare, telling) in enumerate(zip(rows["kind"], rows["bare"], rows["telling"], strict=True)):
        k = made.first(known(kind), telling)
        if k is None:
            k = len(makers)
            makers.append(i)
            made.add(known(kind), bool(bare), telling)
        first.append(makers[k])
    return rows.assign(first=rows["memory_id"].to_numpy()[first])


def met(candidates: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """rows (name, memory_id, kind, telling), each with the place of the first of candidates (place, kind, bare, telling) that it is the same as, else null."""
    candidates, own = candidates.sort_values("place", kind="stable"), Candidates()
    for kind, bare, telling in zip(candidates["kind"], candidates["bare"], candidates["telling"], strict=True):
        own.add(known(kind), bool(bare), telling)
    places = candidates["place"].tolist()
    found = [own.first(known(kind), telling) for kind, telling in zip(rows["kind"], rows["telling"], strict=True)]
    return rows[["name", "memory_id"]].assign(place=pd.array([None if k is None else places[k] for k in found], "Int64"))
