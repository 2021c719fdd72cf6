"""Papers of a session, held until they are asked for, cleared, or left alone for too long: keyed state of a stream, on no disk but the checkpoint's.

Events: session, at (timestamp), action (`put`, `ask`, `drop`, `clear`), name, text. `put` takes a paper in, or in place of
the one of that name; `drop` lets one go; `ask` gives all and forgets them; `clear` forgets them unseen. After `idle` without an
event, by the events' own time, a session expires and its papers are forgotten too. Null sessions are left out; a session
without papers has no state. A session's papers are held by one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "session string, at timestamp, action string, name string, text string"
OUTCOME = "session string, at timestamp, outcome string, papers string"


def gathered(events: DataFrame, idle_seconds: int = 1800, late: str = "1 minute") -> DataFrame:
    """session, at, outcome (`asked`, `expired`), papers: a JSON object of names and texts, in the order in which they came."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        papers, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, None)
        out = []
        if state.hasTimedOut:
            out.append((key[0], pd.Timestamp(last, unit="us"), "expired", json.dumps(papers, ensure_ascii=False)))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("at", kind="stable")
            for row in rows.itertuples():
                last = max(last or 0, row.at.value // 1000)
                if row.action == "put":
                    papers[str(row.name_)] = row.text
                elif row.action == "drop":
                    papers.pop(str(row.name_), None)
                else:
                    if row.action == "ask":
                        out.append((key[0], row.at, "asked", json.dumps(papers, ensure_ascii=False)))
                    papers = {}
            if papers:
                state.update((json.dumps(papers, ensure_ascii=False), last))
                state.setTimeoutTimestamp(max(last // 1000 + 1000 * idle_seconds, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["session", "at", "outcome", "papers"])

    given = events.select("session", "at", "action", F.col("name").alias("name_"), "text").filter("session is not null and at is not null").withWatermark("at", late)
    return given.groupBy("session").applyInPandasWithState(step, OUTCOME, "papers string, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
