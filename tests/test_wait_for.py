"""A loop with much to do is waited for as long as it moves."""

import pytest

from reverie.streaming import retrying


class Moving:
    """A query whose batches come one a look, with events until the eighth."""

    def __init__(self, spark):
        self.sparkSession, self.looks, self.stopped = spark, 0, False

    def exception(self):
        return None

    def stop(self):
        self.stopped = True

    @property
    def lastProgress(self):  # noqa: N802
        self.looks += 1
        return {"batchId": self.looks, "numInputRows": 5 if self.looks < 8 else 0}


def test_waits_while_events_come_and_no_longer(spark, monkeypatch):
    rows = {"n": 0}

    class Done:
        def count(self):
            rows["n"] += 1
            return rows["n"]

    monkeypatch.setattr(retrying, "finished", lambda *_: Done())
    query = Moving(spark)
    retrying.wait_for(query, "", 6, 1.2)  # six looks take three seconds
    assert query.stopped and query.looks == 6
    query, rows["n"] = Moving(spark), -1000
    with pytest.raises(TimeoutError, match="no event came"):
        retrying.wait_for(query, "", 6, 1.2)
    assert query.stopped and query.looks >= 8
