"""What holds over a session so far: budgets, drift, information flow, integrity, exactly-once, and the rules that follow from it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pairing import DONE, START, pair_calls, session_order
from .sequence import PHASES, divergence, trailing, up_to_here

#: Bonus points of a change of phase.
TURNS = {("testing", "implementation"): 10, ("verification", "implementation"): 10, ("testing", "destructive"): 18, ("verification", "destructive"): 18, ("exploration", "network"): 15, ("exploration", "deployment"): 12}
WARM_UP, OSCILLATION, OSCILLATION_POINTS, MOST_DRIFT = 5, 5, 20, 25
#: From this divergence on it counts, with so many points for 1 and at most so many.
DIVERGED, DIVERGENCE_POINTS, MOST_DIVERGENCE = 0.3, 25, 15
CLEARANCE = ("public", "internal", "confidential", "secret")
ACTIONS = ("allow", "warn", "escalate", "deny")


def budgets(calls: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """id, n_calls, and for each dimension the session's calls so far with this one's value."""
    out = calls.withColumn("n_calls", F.count(F.lit(1)).over(up_to_here()))
    for d in dims:
        own = Window.partitionBy("session_id", d).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"n_{d}", F.count(F.lit(1)).over(own))
    return out


def phase_shares(events: DataFrame, phase: str = "phase", phases: tuple[str, ...] = PHASES) -> DataFrame:
    """One row: the share of each phase among all events that have one, as share_<phase>."""
    return events.where(F.col(phase).isNotNull()).agg(*[(F.count(F.when(F.col(phase) == p, 1)) / F.count(F.lit(1))).alias(f"share_{p}") for p in phases])


def drift(events: DataFrame, baseline: DataFrame | None = None, phase: str = "phase", window: int = 20, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """Adds n_turns (changes of phase in the trailing window), divergence (of the window's phases from the baseline) and drift (bonus points for
    the last change, for many changes and for the divergence; 0 in the first events of a session).

    baseline: one row of phase_shares; without it nothing diverges.
    """
    w = session_order()
    turns = events.withColumn("last_phase", F.lag(phase).over(w)).withColumn("turned", F.when(F.col("last_phase").isNotNull() & ~F.col(phase).eqNullSafe(F.col("last_phase")), 1).otherwise(0))
    # a change counts if both of its events are inside the window
    turns = turns.withColumn("n_turns", F.coalesce(F.sum("turned").over(w.rowsBetween(2 - window, 0)), F.lit(0))).withColumn("n_seen", F.count(F.lit(1)).over(trailing(window)))
    turns = turns.withColumns({f"seen_{p}": F.count(F.when(F.col(phase) == p, 1)).over(trailing(window)) for p in phases})
    if baseline is None:
        turns = turns.withColumns({f"share_{p}": F.lit(0.0) for p in phases})
    else:
        turns = turns.crossJoin(F.broadcast(baseline))  # one row
    apart = divergence({p: F.col(f"seen_{p}") for p in phases}, {p: F.col(f"share_{p}") for p in phases})
    turns = turns.withColumn("divergence", apart).drop(*[f"{k}_{p}" for k in ("seen", "share") for p in phases])
    bonus = F.lit(0)
    for (a, b), points in TURNS.items():
        bonus = F.when((F.col("last_phase") == a) & (F.col(phase) == b), points).otherwise(bonus)
    diverged = F.when(F.col("divergence") > DIVERGED, F.least(F.floor(F.col("divergence") * DIVERGENCE_POINTS), F.lit(MOST_DIVERGENCE))).otherwise(0)
    points = F.least(bonus + F.when(F.col("n_turns") > OSCILLATION, OSCILLATION_POINTS).otherwise(0) + diverged, F.lit(MOST_DRIFT))
    return turns.withColumn("drift", F.when(F.col("n_seen") < WARM_UP, 0).otherwise(points).cast("long")).drop("turned", "n_seen")


def dispatched(events: DataFrame) -> DataFrame:
    """The events that governance looks at: a session's begin and end, every result, and starts with a call id that no result will answer
    (orphans and displaced ones). Other starts are seen with their results."""
    open_ = pair_calls(events).where(F.col("status").isin("orphan", "displaced") & F.col("call_id").isNotNull()).select(F.col("start_id").alias("id"))
    kind = F.col("kind")
    return events.where((kind == DONE) | kind.startswith("session.")).unionByName(events.where(kind == START).join(open_, "id", "left_semi"))


def clearance_rank(path: Column) -> Column:
    """Place in CLEARANCE of what a path or command touches."""
    return F.when(path.rlike(r"id_rsa|\.pem|/etc/shadow|\.env"), 3).when(path.rlike("/etc/passwd|/etc/cron"), 2).when(path.rlike("src|README"), 1).otherwise(0)


def taint(calls: DataFrame, text: str = "command") -> DataFrame:
    """Adds rank (what the call touches), taint (the highest so far) and violation: something confidential was seen before, and this writes."""
    w = session_order()
    ranked = calls.withColumn("rank", clearance_rank(F.col(text)))
    before = F.max("rank").over(w.rowsBetween(Window.unboundedPreceding, -1))
    writes = F.col(text).rlike("> |curl|nc |wget|rm |dd ")
    return ranked.withColumns({"taint": F.max("rank").over(up_to_here()).cast("long"), "violation": (F.coalesce(before, F.lit(0)) >= 2) & writes})


def content_changes(writes: DataFrame, key: str, order: str, content: str, block: int = 4096) -> DataFrame:
    """Adds hash, last_hash and tampered: the content differs from what was last seen under the key, in the order of a number (null first).

    Each key is cut into ranges of `block` of that number; a range's first row takes the last hash of the range before, so a key that has
    most of the rows is many groups.
    """
    hashed = writes.withColumn("hash", F.sha2(F.col(content), 256)).withColumn("block_", F.floor(F.col(order) / block))
    ends = hashed.groupBy(key, "block_").agg(F.max(F.struct(order, "hash"))["hash"].alias("end_"))
    before = ends.select(F.col(key).alias("key_"), F.col("block_").alias("of_"), F.lag("end_").over(Window.partitionBy(key).orderBy(F.col("block_").asc_nulls_first())).alias("carried_"))
    inside = F.lag(F.struct("hash")).over(Window.partitionBy(key, "block_").orderBy(F.col(order).asc_nulls_first(), "hash"))
    rows = hashed.withColumn("inside_", inside).join(before, F.col(key).eqNullSafe(F.col("key_")) & F.col("block_").eqNullSafe(F.col("of_")))
    rows = rows.withColumn("last_hash", F.when(F.col("inside_").isNotNull(), F.col("inside_.hash")).otherwise(F.col("carried_")))
    return rows.withColumn("tampered", F.coalesce(F.col("last_hash") != F.col("hash"), F.lit(False))).drop("block_", "key_", "of_", "carried_", "inside_")


def first_delivery(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("nth_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("nth_ = 1").drop("nth_")


def seq_gaps(rows: DataFrame) -> DataFrame:
    """session_id, after_seq, before_seq, n_missing for each hole in a session's numbers."""
    w = Window.partitionBy("session_id").orderBy("seq")
    return rows.select("session_id", F.lag("seq").over(w).alias("after_seq"), F.col("seq").alias("before_seq")).where("before_seq - after_seq > 1").withColumn("n_missing", F.col("before_seq") - F.col("after_seq") - 1)


def first_rule(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The outcome of the first rule whose condition holds."""
    out = F
    for condition, outcome in rules:
        out = out.when(condition, outcome)
    return out.otherwise(otherwise)


def most_severe(*actions: Column) -> Column:
    ranks = [F.array_position(F.array(*map(F.lit, ACTIONS)), F.coalesce(a, F.lit(ACTIONS[0]))) for a in actions]
    return F.element_at(F.array(*map(F.lit, ACTIONS)), F.greatest(*ranks).cast("int") if len(ranks) > 1 else ranks[0].cast("int"))


def glob_pattern(glob: str) -> str:
    """A glob as a pattern for whole paths: ** crosses folders, * and ? don't; without a slash it is about the last part."""
    body = re.sub(r"\\\*\\\*/?|\\\*|\\\?", lambda m: {"\\*": "[^/]*", "\\?": "[^/]"}.get(m[0], ".*"), re.escape(glob))
    return f"(?i)^{'(.*/)?' if '/' not in glob else ''}{body}$"


def active_grants(events: DataFrame, grants: DataFrame) -> DataFrame:
    """Events of a session while one of its grants holds: [granted_at, expires_at)."""
    e, g = events.alias("e"), grants.alias("g")
    inside = (F.col("g.granted_at") <= F.col("e.ts")) & (F.col("e.ts") < F.col("g.expires_at"))
    return e.join(g, (F.col("e.session_id") == F.col("g.session_id")) & inside, "left_semi")


def action_hash(columns: dict[str, Column]) -> Column:
    """sha-256 of compact JSON with sorted keys; null values are written, so absence and null differ."""
    pairs = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.to_json(F.array(v)), F.lit("[null]"))) for k, v in sorted(columns.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")), 256)

#: Points by severity, and what each kind of label can add at most.
SEVERITY_POINTS = {"critical": 20, "warning": 10, "info": 5}
SECRET = r"AKIA[0-9A-Z]{16}|(?i:(?:password|token|secret|api_key))\s*[=:]\s*\S+"


def labels(rows: DataFrame) -> DataFrame:
    """Adds labels (sorted) and points of events with violation, drift, n_calls and tampered: what each contributes is bounded."""
    found = F.array(F.when(F.col("violation"), "ifc_violation"), F.when(F.col("drift") > 0, "phase_anomaly"), F.when(F.col("n_calls") >= 20, "budget_pressure"))
    points = F.when(F.col("violation"), 10).otherwise(0) + F.least(F.col("drift"), F.lit(20)) + F.when(F.col("n_calls") >= 20, 5).otherwise(0)
    return rows.withColumns({"labels": F.array_sort(F.array_compact(found)), "points": points.cast("long")})


def evidence(text: Column, most: int = 500) -> Column:
    """An excerpt with secrets masked."""
    return F.substring(F.regexp_replace(text, SECRET, "[MASKED]"), 1, most)


def suggestion(payload: Column, path: str, value: str) -> Column:
    """What a rule would change: the field it is about, what is there, and what should be; null if the field isn't there."""
    now = F.get_json_object(payload, f"$.{path}")
    return F.when(now.isNotNull(), F.struct(F.lit(path).alias("field"), now.alias("current"), F.lit(value).alias("proposed")))


def preview(state: DataFrame, candidates: DataFrame, most_calls: int) -> DataFrame:
    """For candidates (session_id, ...) what would hold after them: n_calls, and the action; state (session_id, n_calls) isn't written. A session that
    isn't known has made no calls."""
    joined = candidates.join(state.select("session_id", F.col("n_calls").alias("so_far")), "session_id", "left").withColumn("n_calls", F.coalesce("so_far", F.lit(0)) + 1).drop("so_far")
    return joined.withColumn("action", F.when(F.col("n_calls") > most_calls, "escalate").otherwise("allow"))


def alerts(rows: DataFrame) -> DataFrame:
    """A row for each alert of an event (alerts: array of {severity, what}), with its points."""
    points = F.create_map(*[F.lit(x) for pair in SEVERITY_POINTS.items() for x in pair])
    return rows.select("session_id", "id", F.explode("alerts").alias("a")).select("session_id", "id", "a.severity", "a.what", F.try_element_at(points, F.col("a.severity")).cast("long").alias("points"))
