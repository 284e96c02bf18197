"""Pairing of tool calls with their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, DONE, END = "tool.call.started", "tool.call.completed", "session.ended"


def session_order():
    return Window.partitionBy("session_id").orderBy("ts", "id")


def micros(ts):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def pair_calls(events: DataFrame) -> DataFrame:
    """A row for each call: status paired, orphan (a start without result), displaced (an orphan because a newer start took its key) or
    lone (a result without start); start_id, done_id, duration_ms (null unless paired, never below 0), value (the result's, else the
    start's).

    Keys are (session, call); a session's end closes what is open, so pairs never cross it. A start is matched if the next start or
    result of its key in the same stretch is a result. One shuffle by session serves all windows.
    """
    stretch = F.sum(F.when(F.col("kind") == END, 1).otherwise(0)).over(session_order().rowsBetween(Window.unboundedPreceding, 0))
    calls = events.withColumn("stretch", stretch).where(F.col("kind").isin(START, DONE))
    key = Window.partitionBy("session_id", "call_id", "stretch").orderBy("ts", "id")
    ahead = calls.withColumns({f"next_{c}": F.lead(c).over(key) for c in ("kind", "id", "ts", "value")} | {"last_kind": F.lag("kind").over(key)})
    rows = ahead.where((F.col("kind") == START) | (F.col("last_kind").isNull()) | (F.col("last_kind") == DONE))
    paired = (F.col("kind") == START) & (F.coalesce(F.col("next_kind"), F.lit("")) == DONE)
    status = F.when(paired, "paired").when(F.col("kind") == DONE, "lone").when(F.col("next_kind") == START, "displaced").otherwise("orphan")
    apart = F.greatest(F.lit(0), micros("next_ts") - micros("ts")) / 1000.0
    return rows.select(
        "session_id", "call_id", "tool", status.alias("status"), F.when(F.col("kind") == START, F.col("id")).alias("start_id"),
        F.when(paired, F.col("next_id")).when(F.col("kind") == DONE, F.col("id")).alias("done_id"),
        F.when(paired, apart).alias("duration_ms"), F.when(paired, F.coalesce("next_value", "value")).otherwise(F.col("value")).alias("value"),
    )


def pair_by_place(events: DataFrame) -> DataFrame:
    """The n-th start of a tool in a session with its n-th result, where calls have no ids."""
    place = F.row_number().over(Window.partitionBy("session_id", "tool", "kind").orderBy("ts", "id"))
    side = lambda kind, name: events.where(F.col("kind") == kind).select("session_id", "tool", place.alias("n"), F.col("id").alias(name))
    return side(START, "start_id").join(side(DONE, "done_id"), ["session_id", "tool", "n"]).select("session_id", "tool", F.col("n").cast("long").alias("n"), "start_id", "done_id")


def time_before(events: DataFrame, width: int = 600) -> DataFrame:
    """Adds before_: the latest time, in microseconds, of all events before this one in order of (ts, id), whatever their session; null for
    the first.

    Distinct times are what is ordered, by bins of so many seconds; over all bins only their last times are, a row for each stretch of time.
    """
    at = micros("ts")
    times = events.where("ts is not null").select(at.alias("at_"), "id").groupBy("at_").agg(F.min("id").alias("first_")).withColumn("bin_", F.floor(F.col("at_") / (width * 1_000_000)))
    ends = times.groupBy("bin_").agg(F.max("at_").alias("end_")).select("bin_", F.lag("end_").over(Window.orderBy("bin_")).alias("carried_"))
    times = times.withColumn("last_", F.lag("at_").over(Window.partitionBy("bin_").orderBy("at_"))).join(ends, "bin_")
    times = times.select(F.col("at_"), "first_", F.coalesce("last_", "carried_").alias("last_"))
    rows = events.withColumn("at_", at).join(times, "at_", "left")
    return rows.withColumn("before_", F.when(F.col("id") > F.col("first_"), F.col("at_")).otherwise(F.col("last_"))).drop("at_", "first_", "last_")


def pair_bounded(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """pair_calls() where a start that any session's event has left more than ttl_seconds behind no longer waits: session_id, call_id, status
    (paired, orphan or lone), start_id, done_id.

    A result finds its start only if no event before it, in order of (ts, id) over all sessions, is that much later than the start. One
    that comes too late is lone, its start an orphan. Rows without a time come first and neither expire nor let expire.
    """
    if ttl_seconds <= 0:
        raise ValueError(f"ttl_seconds must be positive, not {ttl_seconds}")
    rows = time_before(events)
    stretch = F.sum(F.when(F.col("kind") == END, 1).otherwise(0)).over(session_order().rowsBetween(Window.unboundedPreceding, 0))
    calls = rows.withColumn("stretch", stretch).where(F.col("kind").isin(START, DONE))
    key = Window.partitionBy("session_id", "call_id", "stretch").orderBy("ts", "id")
    met = calls.withColumns({"next_kind": F.lead("kind").over(key), "next_id": F.lead("id").over(key), "next_before": F.lead("before_").over(key), "last_kind": F.lag("kind").over(key)})
    met = met.where((F.col("kind") == START) | F.col("last_kind").isNull() | (F.col("last_kind") == DONE))
    late = F.coalesce(F.col("next_before") - micros("ts") > ttl_seconds * 1_000_000, F.lit(False))
    started, answered = F.col("kind") == START, F.coalesce(F.col("next_kind") == DONE, F.lit(False))
    none = F.lit(None).cast("long")
    line = lambda status, start, done: F.struct(F.lit(status).alias("status"), start.alias("start_id"), done.alias("done_id"))
    own = F.col("id").cast("long")
    lines = (
        F.when(~started, F.array(line("lone", none, own)))
        .when(answered & late, F.array(line("orphan", own, none), line("lone", none, F.col("next_id").cast("long"))))
        .when(answered, F.array(line("paired", own, F.col("next_id").cast("long"))))
        .otherwise(F.array(line("orphan", own, none)))
    )
    return met.select("session_id", "call_id", F.inline(lines))
