"""Sessions with expiry, over restarts from the checkpoint."""

from __future__ import annotations

import datetime
import json

from ladingspark.streaming import folder, sessions

START = datetime.datetime(2026, 1, 1)


def test_sessions_are_asked_for_or_expire(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def batch(*events):
        """Each call is a run of its own, which takes up the state that the one before has left."""
        rows = [(s, START + datetime.timedelta(minutes=m), action, name, text) for s, m, action, name, text in events]
        spark.createDataFrame(rows, sessions.EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(sessions.EVENT).parquet(source)
        folder.process(stream, lambda s: sessions.gathered(s, idle_seconds=1800), out, checkpoint).awaitTermination(120)
        return sorted((r["session"], r["outcome"], json.loads(r["papers"])) for r in spark.read.schema(sessions.OUTCOME).parquet(out).collect())

    batch(("a", 0, "put", "1", "one"), ("b", 0, "put", "1", "other"), ("c", 0, "put", "x", None), ("c", 1, "clear", None, None), (None, 0, "put", "1", "one"), ("d", 2, "ask", None, None), ("e", 0, "put", "y", ""))
    first = [("d", "asked", {})]
    assert batch(("a", 5, "put", "2", "two"), ("a", 6, "put", "1", "one again"), ("e", 7, "drop", "y", None)) == first
    asked = [("a", "asked", {"1": "one again", "2": "two"}), *first]
    assert batch(("a", 20, "ask", None, None), ("b", 21, "put", "2", "later")) == asked
    # b is left alone for half an hour; an event of another session tells the time.
    batch(("z", 60, "put", "1", "z"))
    assert batch(("z", 61, "ask", None, None)) == sorted([*asked, ("b", "expired", {"1": "other", "2": "later"}), ("z", "asked", {"1": "z"})])
