"""Queries without SQL read their whole table."""

from reverie.plans import QUERIES
from reverie.sources import store
from tests.conftest import DATA


def test_benchmark_pagerank_ranks_all_relations(spark):
    live = [(r.subject, r.object) for r in store.Store(spark, DATA).relations.where("invalid_at IS NULL").collect()]
    beside: dict[str, set[str]] = {}
    for a, b in live:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    reached, edge = set(), {min(a for a, _ in live)}
    while edge:
        reached |= edge
        edge = {y for x in edge for y in beside[x]} - reached
    assert reached <= {r.id for r in QUERIES["g5_benchmark_pagerank"](spark, DATA).collect()} <= set(beside)
