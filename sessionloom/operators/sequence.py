"""Order inside sessions: numbering, inheritance of phases, segments, runs, trailing windows, and the ordered folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pairing import session_order

PHASES = ("planning", "exploration", "implementation", "verification", "review")


def up_to_here(order=None):
    return (order or session_order()).rowsBetween(Window.unboundedPreceding, 0)


def trailing(n: int, order=None):
    return (order or session_order()).rowsBetween(1 - n, 0)


def phase_of(kind: Column, tool: Column) -> Column:
    """The phase that an event's own content shows; null for plumbing."""
    return (
        F.when(kind == "message.user", "planning")
        .when(~kind.startswith("tool."), F.lit(None))
        .when(tool.isin("read_file", "grep", "list_dir", "web_search"), "exploration")
        .when(tool.isin("write_file", "edit-file"), "implementation")
        .when(tool == "bash", "verification")
        .otherwise("review")
    )


def numbered(events: DataFrame) -> DataFrame:
    """Adds seq, from 0 in each session."""
    return events.withColumn("seq", (F.row_number().over(session_order()) - 1).cast("long"))


def inherit_phase(events: DataFrame) -> DataFrame:
    """Adds phase: an event without own phase has that of the one before it, leading ones that of the first with one."""
    own = phase_of(F.col("kind"), F.col("tool"))
    ahead = session_order().rowsBetween(0, Window.unboundedFollowing)
    return events.withColumn("own_phase", own).withColumn("phase", F.coalesce(F.last("own_phase", ignorenulls=True).over(up_to_here()), F.first("own_phase", ignorenulls=True).over(ahead)))


def gap_features(events: DataFrame) -> DataFrame:
    """For each two neighbours of a session: what changes from one to the next. The boundary stands on the later one."""
    w = session_order()
    ahead = events.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("id", "kind", "tool", "phase")}).where(F.col("next_id").isNotNull())
    return ahead.withColumns({f"changed_{c}": ~F.col(c).eqNullSafe(F.col(f"next_{c}")) for c in ("kind", "tool", "phase")})


def segments(events: DataFrame, activity: Column, step: Column) -> DataFrame:
    """Adds activity_id and step_id: the event that opened them. A session's first event opens both; an activity opens a step too."""
    w = session_order()
    first = F.row_number().over(w) == 1
    marked = events.withColumn("opens_activity", first | F.coalesce(activity, F.lit(False))).withColumn("opens_step", first | F.coalesce(activity, F.lit(False)) | F.coalesce(step, F.lit(False)))
    last = lambda flag: F.last(F.when(F.col(flag), F.col("id")), ignorenulls=True).over(up_to_here())
    return marked.withColumns({"activity_id": last("opens_activity"), "step_id": last("opens_step")}).drop("opens_activity", "opens_step")


def entropy(events: DataFrame, category: str, values, n: int) -> DataFrame:
    """Adds entropy: of the categories of the last n events, in bits."""
    total = F.count(F.col(category)).over(trailing(n))
    out = F.lit(0.0)
    for v in values:
        share = F.sum(F.when(F.col(category) == v, 1).otherwise(0)).over(trailing(n)) / total
        out = out - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    return events.withColumn("entropy", F.round(out, 6))


def majority(events: DataFrame, category: str, n: int) -> DataFrame:
    """Adds majority: the most frequent category of the last n events, of equals the latest."""
    seen = F.filter(F.collect_list(F.coalesce(F.col(category), F.lit(""))).over(trailing(n)), lambda x: x != "")
    rank = lambda w: F.transform(F.array_distinct(F.reverse(w)), lambda c: F.struct(F.size(F.filter(w, lambda x: x == c)).alias("n"), (-F.array_position(F.reverse(w), c)).alias("late"), c.alias("c")))
    return events.withColumn("seen_", seen).withColumn("majority", F.array_max(rank(F.col("seen_")))["c"]).drop("seen_")


def runs(events: DataFrame, category: str) -> DataFrame:
    """A row for each run of equal categories: session_id, block, category, n_events, start_id, start, end."""
    w = session_order()
    changed = F.when(F.col(category).eqNullSafe(F.lag(category).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    blocks = events.withColumn("changed_", changed).withColumn("block", F.sum("changed_").over(up_to_here()).cast("long"))
    return blocks.groupBy("session_id", "block", F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n_events"), F.min(F.struct("ts", "id"))["id"].alias("start_id"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def transitions(blocks: DataFrame) -> DataFrame:
    """from_phase, to_phase, n over neighbouring blocks."""
    after = F.lead("category").over(Window.partitionBy("session_id").orderBy("block"))
    return blocks.select(F.col("category").alias("from_phase"), after.alias("to_phase")).where("to_phase is not null").groupBy("from_phase", "to_phase").agg(F.count(F.lit(1)).alias("n"))


class ChangePoint:
    """Online Bayesian change points of a categorical sequence: constant hazard, symmetric Dirichlet counts, run lengths up to a limit."""

    def __init__(self, categories: int, hazard: float = 0.02, alpha: float = 0.5, longest: int = 60):
        self.k, self.hazard, self.alpha, self.longest = categories, hazard, alpha, longest
        self.weights, self.recent = [1.0], []

    def push(self, x: int) -> tuple[float, float]:
        """(probability of a change here, expected run length as a share of the limit)"""
        total = sum(self.weights) or 1.0
        seen, evidence = 0, []
        for r, weight in enumerate(self.weights):
            if r:
                seen += self.recent[-r] == x
            evidence.append(weight / total * (seen + self.alpha) / (r + self.k * self.alpha))
        new = [self.hazard * sum(evidence), *(e * (1 - self.hazard) for e in evidence)]
        norm = sum(new) or 1.0
        new = [v / norm for v in new]
        expected = sum(r * v for r, v in enumerate(new)) / self.longest
        self.weights = new[: self.longest + 1]
        self.recent = [*self.recent[1 - self.longest :], x] if self.longest > 1 else [x]
        return new[0], expected


class PhaseFold:
    """The debounced phase of a session: the mode of the last few phases (of equals the latest) must differ often enough in a row."""

    def __init__(self, window: int = 3, debounce: int = 2):
        self.window, self.debounce, self.recent, self.current, self.streak = window, debounce, [], None, 0

    def push(self, phase: str) -> str:
        self.recent = [*self.recent, phase][-self.window :]
        if self.current is None:
            self.current = phase
            return phase
        mode = max(reversed(self.recent), key=self.recent.count)
        self.streak = 0 if mode == self.current else self.streak + 1
        if self.streak >= self.debounce:
            self.current, self.streak = mode, 0
        return self.current


def decoded(scored: DataFrame, thresholds: dict[str, float], least_gaps: dict[str, int]) -> DataFrame:
    """Adds boundary to scored events (session_id, ts, id, ..., and a score named after each class). The first class of `thresholds` whose score
    reaches its threshold claims the event; it is `noise` if that class spoke fewer than its least gap of events ago, or if none claims
    it. The events of a session are folded in their order; a null score is 0."""
    names = list(thresholds)
    claim = F.coalesce(*[F.when(F.coalesce(F.col(n), F.lit(0.0)) >= thresholds[n], n) for n in names], F.lit("noise"))
    kinds = {"ts": "", "id": ""} | {f.name: f.dataType.simpleString() for f in scored.schema.fields if f.name != "session_id"}
    events = F.array_sort(F.collect_list(F.struct(*kinds, claim.alias("claim"))))
    none = F.array().cast(f"array<struct<{','.join(f'{n}:{k}' for n, k in kinds.items())},boundary:string>>")
    start = F.struct(none.alias("out"), F.lit(0).alias("at"), *[F.lit(-(10**9)).alias(n) for n in names])

    def step(state, e):
        speaks = {n: (e["claim"] == n) & (state["at"] - state[n] >= least_gaps.get(n, 1)) for n in names}
        label = F.coalesce(*[F.when(s, n) for n, s in speaks.items()], F.lit("noise"))
        own = F.struct(*[e[c].alias(c) for c in kinds], label.alias("boundary"))
        return F.struct(F.concat(state["out"], F.array(own)).alias("out"), (state["at"] + 1).alias("at"), *[F.when(s, state["at"]).otherwise(state[n]).alias(n) for n, s in speaks.items()])

    return scored.groupBy("session_id").agg(F.aggregate(events, start, step)["out"].alias("out")).select("session_id", F.inline("out"))


def folded(events: DataFrame) -> DataFrame:
    """session_id, id, tracked_phase, change, run_length, boundary: the three folds over each session's phases, in order. Each step depends on
    what was emitted before, so a session is folded as a whole; sessions run in parallel, many to a group by their hash."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for session, own in rows.sort_values(["session_id", "ts", "id"], kind="stable").groupby("session_id", sort=False):
            points, phases = ChangePoint(len(PHASES)), PhaseFold()
            for key, ts, phase in zip(own["id"], own["ts"], own["phase"], strict=True):
                phase = phase if isinstance(phase, str) else PHASES[0]
                change, length = points.push(PHASES.index(phase))
                out.append((session, key, ts, phases.push(phase), round(change, 9), round(length, 9)))
        return pd.DataFrame(out, columns=["session_id", "id", "ts", "tracked_phase", "change", "run_length"])

    own = events.select("session_id", "ts", "id", "phase")
    bins = F.pmod(F.xxhash64("session_id"), F.lit(4 * int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    tracked = own.groupBy(bins).applyInPandas(fold, f"session_id {kinds['session_id']}, id {kinds['id']}, ts {kinds['ts']}, tracked_phase string, change double, run_length double")
    bounds = decoded(tracked.withColumns({"activity": F.col("change"), "step": F.col("change")}), {"activity": 0.5, "step": 0.1}, {"activity": 8, "step": 3})
    return bounds.select("session_id", "id", "tracked_phase", "change", "run_length", "boundary")


def divergence(counts: dict[str, Column], shares: dict[str, Column]) -> Column:
    """Jensen-Shannon divergence, in nats, of counted categories from given shares; 0 where there is nothing to compare."""
    total = sum(counts.values(), F.lit(0))
    part = lambda x, y: F.when(x > 0, x * F.ln(x / ((x + y) / 2))).otherwise(0.0)
    out = F.lit(0.0)
    for name, n in counts.items():
        p, q = n / total, F.coalesce(shares[name], F.lit(0.0))
        out = out + (part(p, q) + part(q, p)) / 2
    known = sum((F.coalesce(q, F.lit(0.0)) for q in shares.values()), F.lit(0.0)) > 0
    return F.when((total > 0) & known, out).otherwise(0.0)
