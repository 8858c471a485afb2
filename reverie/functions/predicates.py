"""Boolean columns over memories and what hangs on them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def scoped(user_id: str | None = None, agent_id: str | None = None, run_id: str | None = None) -> Column:
    """Equality with each of these that is given; true if none is."""
    given = {"user_id": user_id, "agent_id": agent_id, "run_id": run_id}
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in given.items() if v is not None], F.lit(True))


def active() -> Column:
    return F.col("invalid_at").isNull()


def owned(user_id: Column, owner: str | None) -> Column:
    """An owner ending in :: is a prefix, any other an exact name; None owns all, and nobody owns rows without user."""
    if owner is None:
        return F.lit(True)
    mine = user_id.startswith(owner) if owner.endswith("::") else user_id == owner
    return F.coalesce(mine & (user_id != ""), F.lit(False))


def within(moment: Column, since: str | None = None, until: str | None = None) -> Column:
    """Whether a time lies from since on and before until; a bare date as until takes in that day.

    A bound that is no date or time is no bound, and a row without time is kept.
    """
    kept = F.lit(True)
    for bound, upper in ((since, False), (until, True)):
        text = (bound or "").strip()
        if not text:
            continue
        day = bool(re.fullmatch(r"\d{4}-\d\d-\d\d", text))
        at = F.try_to_timestamp(F.lit(text)).cast("timestamp_ntz")
        if upper and day:
            at = (at + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
        kept = kept & F.coalesce(moment < at if upper else moment >= at, F.lit(True))
    return kept


def pending(metadata: Column, due: str | None = None) -> Column:
    """Whether metadata (JSON) awaits distillation, and its next attempt is not after due."""
    waits = F.coalesce(F.get_json_object(metadata, "$.pending_distillation") == "true", F.lit(False))
    if due is None:
        return waits
    at = F.get_json_object(metadata, "$._enrichment.next_attempt_at")
    return waits & (at.isNull() | (at <= due))


def due(last: Column, now: Column, hours: float) -> Column:
    """Whether maintenance is due: never or unreadably stamped, or at least that long ago."""
    then = F.try_to_timestamp(last)
    return then.isNull() | ((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(3.6e9) >= hours)
