"""The stateful operators over streams: pairing with time limits, exactly-once delivery."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pairing import DONE, END, START

OUT = "session_id long, call_id long, status string, start_id long, done_id long, duration_ms double"


def pair_stream(events: DataFrame, ttl_seconds: int = 3600, late: str = "1 minute") -> DataFrame:
    """pair_calls() for a stream: a session's open starts are its state; what stays open for ttl_seconds of event time goes out as an orphan.

    events: session_id, id, kind, call_id, ts (timestamp). Rows of a batch are taken in order of (ts, id).
    """

    def step(key: tuple, batches, state: GroupState):
        session = key[0]
        pending = dict(zip(*[state.get[0], zip(*[state.get[1], state.get[2]])])) if state.exists else {}
        out = []
        orphan = lambda call, entry, status="orphan": out.append((session, call, status, entry[0], None, None))
        if state.hasTimedOut:
            limit = state.getCurrentWatermarkMs() * 1000 - ttl_seconds * 1_000_000
            for call in [c for c, e in pending.items() if e[1] <= limit]:
                orphan(call, pending.pop(call))
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable")
            for ts, kind, call, own in zip(rows["ts"], rows["kind"], rows["call_id"], rows["id"], strict=True):
                at = int(ts.value // 1000)
                if kind == START:
                    if call in pending:
                        orphan(call, pending.pop(call), "displaced")
                    pending[call] = (own, at)
                elif kind == DONE:
                    entry = pending.pop(call, None)
                    out.append((session, call, "paired" if entry else "lone", entry[0] if entry else None, own, max(0, at - entry[1]) / 1000.0 if entry else None))
                elif kind == END:
                    for open_call in list(pending):
                        orphan(open_call, pending.pop(open_call))
        if pending:
            state.update(([int(c) for c in pending], [int(e[0]) for e in pending.values()], [int(e[1]) for e in pending.values()]))
            state.setTimeoutTimestamp(max(min(e[1] for e in pending.values()) // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"start_id": "Int64", "done_id": "Int64"})

    held = "calls array<long>, ids array<long>, times array<long>"
    return events.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(step, OUT, held, "append", GroupStateTimeout.EventTimeTimeout)


def delivered_once(events: DataFrame, key: str = "id", within: str = "1 hour") -> DataFrame:
    """The stream without repeats of a key inside the time that state is kept for."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def counts_by_hour(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """kind and hour with their counts, late rows up to the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("hour"), "kind").agg(F.count(F.lit(1)).alias("n"))
