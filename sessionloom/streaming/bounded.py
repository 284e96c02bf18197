"""Pairing of calls as a stream whose state is bounded in time and in size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.pairing import DONE, END, START, micros

OUT = "shard int, session_id long, call_id long, status string, start_id long, done_id long"
MOST_OPEN = 4096


class Waiting(StatefulProcessor):
    """A shard's open starts, oldest first by place. A place is the number of the start in its shard."""

    def __init__(self, ttl_seconds: float | None, most_open: int | None, drain: bool):
        self.ttl = None if ttl_seconds is None else int(ttl_seconds * 1_000_000)
        self.most, self.drain = most_open, drain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "place long", "session_id long, call_id long, id long, at long")
        self.next = handle.getValueState("next", "place long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = {place: entry for (place,), entry in self.open.iterator()}
        place = self.next.get()[0] if self.next.exists() else 0
        waiting = {(kept[p][0], kept[p][1]): (p, kept[p][2], kept[p][3]) for p in sorted(kept)}
        table = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable", na_position="first")
        out: list[tuple] = []
        orphan = lambda name: out.append((key[0], *name, "orphan", waiting.pop(name)[1], None))
        columns = [table[c].astype("Int64").astype(object).where(table[c].notna(), None) for c in ("session_id", "call_id", "id", "at")]
        for session, call, own, at, kind in zip(*columns, table["kind"], strict=True):
            name = (session, call)
            if kind == START:
                if name in waiting:
                    orphan(name)
                waiting[name] = (place, own, at)
                place += 1
            elif kind == DONE:
                start = waiting.pop(name, None)
                out.append((key[0], session, call, "paired" if start else "lone", start[1] if start else None, own))
            elif kind == END and self.drain:
                for other in [n for n in waiting if n[0] == session]:
                    orphan(other)
            if self.ttl is not None and at is not None:
                self._expire(waiting, at, orphan)
            while self.most is not None and len(waiting) > self.most:
                orphan(next(iter(waiting)))
        now = {p: (*name, own, at) for name, (p, own, at) in waiting.items()}
        for p in kept.keys() - now.keys():
            self.open.removeKey((p,))
        for p in now.keys() - kept.keys():
            self.open.updateValue((p,), now[p])
        self.next.update((place,))
        if self.ttl is not None and now and (ages := [at for *_, at in now.values() if at is not None]):
            self._alarm(min(ages), timerValues.getCurrentWatermarkInMs())
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Starts that other shards' events have left behind: the watermark takes the stream time's place."""
        mark = timerValues.getCurrentWatermarkInMs()
        out, left = [], []
        for (place,), (session, call, own, at) in list(self.open.iterator()):
            if at is not None and mark * 1000 - at > self.ttl:
                self.open.removeKey((place,))
                out.append((key[0], session, call, "orphan", own, None))
            elif at is not None:
                left.append(at)
        if left:
            self._alarm(min(left), mark)
        yield self._frame(sorted(out, key=lambda r: r[4]))

    def close(self) -> None:
        pass

    def _expire(self, waiting: dict, now: int, orphan) -> None:
        """Starts of later places can be older only if a batch came late, so the first that is young enough doesn't end the search then."""
        for name in [n for n, (_, _, at) in waiting.items() if at is not None and now - at > self.ttl]:
            orphan(name)

    def _alarm(self, oldest: int, mark: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(max((oldest + self.ttl) // 1000 + 1, mark + 1))

    @staticmethod
    def _frame(out: Iterable[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        frame = pd.DataFrame(list(out), columns=names)
        return frame.astype({n: "Int64" for n in names if n not in ("status", "shard")} | {"shard": "int32", "status": "object"})


def bounded_pairs(events: DataFrame, ttl_seconds: float | None = None, most_open: int | None = MOST_OPEN, shards: int = 200, drain: bool = True, late: str = "1 minute") -> DataFrame:
    """Pairs, orphans and lone results of a stream, with at most most_open starts waiting in each shard, each for at most ttl_seconds.

    events: session_id, call_id, id, kind, ts (timestamp). Sessions are dealt out to shards, whose state is a map kept in the state store, so
    that memory is bounded by shards times most_open whatever the number of sessions. After each event the shard lets go of starts that the
    event's time has left more than ttl_seconds behind, then of the oldest beyond most_open; each goes out as an orphan, once. Shards
    without new events let go by the watermark. None switches a bound off. With drain a session's end lets go of what it has open. A new
    start of a waiting call makes the earlier one an orphan. Rows of a batch are taken in order of (ts, id), those without a time first;
    rows behind the watermark are dropped by Spark, so that a result among them leaves its start to expire. Needs the RocksDB state store.
    """
    if ttl_seconds is not None and ttl_seconds <= 0:
        raise ValueError(f"ttl_seconds must be positive or None, not {ttl_seconds}")
    if most_open is not None and most_open < 1:
        raise ValueError(f"most_open must be at least 1 or None, not {most_open}")
    shard = F.pmod(F.xxhash64("session_id"), F.lit(shards)).cast("int")
    rows = events.withWatermark("ts", late).select(shard.alias("shard"), "session_id", "call_id", "id", "kind", micros("ts").alias("at"), "ts")
    return rows.groupBy("shard").transformWithStateInPandas(Waiting(ttl_seconds, most_open, drain), OUT, "Append", "EventTime" if ttl_seconds is not None else "None")
