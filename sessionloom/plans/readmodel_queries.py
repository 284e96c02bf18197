"""Queries of the read model: fleet, runs, triage, coverage, cost."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import risk
from ..operators.attribution import most_frequent, usage_by
from ..operators.sequence import inherit_phase
from ..functions import tools
from .attribution_queries import usage
from .enrichment_queries import _GOLDEN, NORM
from .governance_queries import RULES, SCORED, ruled
from .lens import COMMANDS, EV, MSG, USAGE, messages, session_events
from .register import query
from .sequence_queries import PHASED, SEGMENTS, segmented

LEVEL = "CASE WHEN score <= 20 THEN 'safe' WHEN score <= 45 THEN 'caution' WHEN score <= 75 THEN 'danger' ELSE 'critical' END"
ALL_SCORED = f"{EV}, g(i, score) AS (VALUES {_GOLDEN}), sc AS (SELECT ev.*, CASE WHEN kind = 'tool.call.started' THEN score END AS score FROM ev JOIN g ON k % {len(COMMANDS)} = i)"
RUNS = f"""{ALL_SCORED}, runs AS (SELECT session_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts, CAST(max(score) AS BIGINT) AS peak_risk, count(*) FILTER (kind = 'tool.call.failed') AS n_failed, bool_or(kind = 'session.ended') AS ended FROM sc GROUP BY session_id)"""


def scored(read):
    rows = risk.shell_risk(session_events(read("events")))
    return rows.withColumn("score", F.when(F.col("kind") == "tool.call.started", F.col("score")))


def runs(read):
    return scored(read).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("score").alias("peak_risk"), F.count(F.when(F.col("kind") == "tool.call.failed", 1)).alias("n_failed"), F.bool_or(F.col("kind") == "session.ended").alias("ended"))


@query("run_ids", f"WITH {EV} SELECT session_id FROM ev GROUP BY session_id ORDER BY max(ts) DESC, session_id LIMIT 50 OFFSET 10")
def run_ids(read):
    return session_events(read("events")).groupBy("session_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "session_id").offset(10).limit(50).select("session_id")


@query("run_summary", f"WITH {RUNS} SELECT * FROM runs")
def run_summary(read):
    return runs(read)


@query("run_full", f"WITH {RUNS}, {USAGE}, u AS (SELECT session_id, CAST(sum(cost_cents) AS BIGINT) AS cost_cents, count(*) AS n_usage FROM usage GROUP BY session_id) SELECT runs.session_id, n_events, peak_risk, cost_cents, coalesce(n_usage, 0) AS n_usage FROM runs LEFT JOIN u USING (session_id)")
def run_full(read):
    costs = usage_by(usage(read), "session_id").select("session_id", "cost_cents", F.col("n").alias("n_usage"))
    return runs(read).join(costs, "session_id", "left").select("session_id", "n_events", "peak_risk", "cost_cents", F.coalesce("n_usage", F.lit(0)).alias("n_usage"))


@query("event_label", f"WITH {MSG} SELECT session_id, seq, upper(substr(split_part(kind, '.', 2), 1, 1)) || substr(split_part(kind, '.', 2), 2) AS label, trim(substr(replace(text, chr(10), ' '), 1, 140)) AS summary FROM msg")
def event_label(read):
    name = F.substring_index("kind", ".", -1)
    return messages(read("conversations")).select("session_id", "seq", F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2))).alias("label"), F.trim(F.substring(F.regexp_replace("text", "\n", " "), 1, 140)).alias("summary"))


@query("read_event", f"WITH {SCORED} SELECT id, round(score / 100.0, 2)::DOUBLE AS score, CASE {LEVEL} WHEN 'safe' THEN 0 WHEN 'caution' THEN 1 WHEN 'danger' THEN 2 ELSE 3 END::BIGINT AS ordinal, coalesce(nullif({RULES}, 'allow'), 'allow') AS action FROM sc")
def read_event(read):
    place = F.array_position(F.array(*map(F.lit, ("safe", "caution", "danger", "critical"))), F.col("level")) - 1
    return ruled(read).select("id", F.round(F.col("score") / 100.0, 2).alias("score"), place.alias("ordinal"), "action")


SEGMENT_RISK = f"{SEGMENTS}, g(i, score) AS (VALUES {_GOLDEN}), r AS (SELECT session_id, activity_id, step_id, CASE WHEN kind = 'tool.call.started' THEN score END AS score FROM sg JOIN g ON k % {len(COMMANDS)} = i)"


@query("segment_risk", f"WITH {SEGMENT_RISK} SELECT 'step' AS kind, step_id AS segment_id, CAST(max(score) AS BIGINT) AS risk FROM r GROUP BY step_id UNION ALL SELECT 'activity', activity_id, CAST(max(score) AS BIGINT) FROM r GROUP BY activity_id UNION ALL SELECT 'session', session_id, CAST(max(score) AS BIGINT) FROM r GROUP BY session_id")
def segment_risk(read):
    rows = risk.shell_risk(segmented(read)).withColumn("score", F.when(F.col("kind") == "tool.call.started", F.col("score")))
    steps = rows.groupBy("session_id", "activity_id", "step_id").agg(F.max("score").alias("risk"))
    part = lambda kind, column: steps.groupBy(F.lit(kind).alias("kind"), F.col(column).alias("segment_id")).agg(F.max("risk").alias("risk"))
    return part("step", "step_id").unionByName(part("activity", "activity_id")).unionByName(part("session", "session_id"))


@query("chapters", f"WITH {SEGMENTS} SELECT session_id, activity_id, step_id, count(*) AS n_events, array_to_string(list(id ORDER BY ts, id), ',') AS event_ids FROM sg GROUP BY session_id, activity_id, step_id")
def chapters(read):
    return segmented(read).groupBy("session_id", "activity_id", "step_id").agg(F.count(F.lit(1)).alias("n_events"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "id"))), lambda x: x["id"].cast("string")), ",").alias("event_ids"))


@query("fleet_totals", f"WITH {RUNS} SELECT count(*) AS n_runs, count(*) FILTER (NOT ended) AS n_live, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(n_failed) AS BIGINT) AS n_failed, count(*) FILTER (peak_risk > 45) AS n_triage FROM runs")
def fleet_totals(read):
    return runs(read).agg(F.count(F.lit(1)).alias("n_runs"), F.count(F.when(~F.col("ended"), 1)).alias("n_live"), F.sum("n_events").alias("n_events"), F.sum("n_failed").alias("n_failed"), F.count(F.when(F.col("peak_risk") > 45, 1)).alias("n_triage"))


@query("fleet_rail", f"WITH {USAGE} SELECT 'input' AS class, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM usage UNION ALL SELECT 'output', CAST(sum(output_tokens) AS BIGINT) FROM usage")
def fleet_rail(read):
    sums = usage(read).agg(F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"))
    return sums.select(F.expr("stack(2, 'input', input, 'output', output) as (class, tokens)")).where("tokens is not null")


@query("fleet_search", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '7') OR contains(lower(c_mktsegment), 'auto')")
def fleet_search(read):
    return read("customer").where(F.lower("c_name").contains("7") | F.lower("c_mktsegment").contains("auto")).select("c_custkey", "c_name", "c_mktsegment").orderBy(F.desc("c_custkey"))


@query("triage_queue", f"WITH {SCORED} SELECT id, session_id, CAST(score AS BIGINT) AS score FROM sc WHERE score > 45")
def triage_queue(read):
    return scored(read).where("score > 45").select("id", "session_id", "score").orderBy(F.desc("score"), "id")


@query("risk_by_agent", f"WITH {SCORED}, l AS (SELECT session_id % 7 AS agent, {LEVEL} AS level FROM sc) SELECT agent, count(*) FILTER (level = 'safe') AS safe, count(*) FILTER (level = 'caution') AS caution, count(*) FILTER (level = 'danger') AS danger, count(*) FILTER (level = 'critical') AS critical FROM l GROUP BY agent")
def risk_by_agent(read):
    rows = scored(read).where("score is not null").select((F.col("session_id") % 7).alias("agent"), "level")
    return rows.groupBy("agent").pivot("level", ["safe", "caution", "danger", "critical"]).count().na.fill(0)


@query("technique_top", f"WITH {EV}, t AS (SELECT CASE {' '.join(f'WHEN regexp_matches(command, {p!r}) THEN {t!r}' for p, _, _, t in risk.PATTERNS)} END AS technique FROM ev WHERE kind = 'tool.call.started') SELECT technique, count(*) AS n FROM t WHERE technique IS NOT NULL GROUP BY technique ORDER BY n DESC, technique LIMIT 6".replace("\\\\", "\\"))
def technique_top(read):
    first = F.try_element_at(risk.techniques(F.col("command")), F.lit(1))
    rows = session_events(read("events")).where("kind = 'tool.call.started'").select(first.alias("technique")).where("technique is not null")
    return rows.groupBy("technique").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "technique").limit(6)


@query("activity_hour", f"WITH {PHASED}, top AS (SELECT phase FROM ph WHERE phase IS NOT NULL GROUP BY phase ORDER BY count(*) DESC, phase LIMIT 3) SELECT hour(ts) AS hour, phase, count(*) AS n FROM ph WHERE phase IN (SELECT phase FROM top) GROUP BY ALL")
def activity_hour(read):
    rows = inherit_phase(session_events(read("events"))).select(F.hour("ts").cast("long").alias("hour"), "phase").where("phase is not null")
    counts = rows.groupBy("hour", "phase").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("phase").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "phase").limit(3).select("phase")
    return counts.join(top, "phase", "left_semi").select("hour", "phase", "n")


@query("coverage_stats", f"WITH {EV}, n AS (SELECT kind, tool, {NORM} AS name FROM ev), b AS (SELECT CASE WHEN kind LIKE 'session.%' THEN 'lifecycle' WHEN kind LIKE 'message.%' THEN 'hook' WHEN name IN ({', '.join(repr(x) for x in tools.KNOWN)}) THEN 'classified' ELSE 'unclassified' END AS bucket FROM n) SELECT bucket, count(*) AS n FROM b GROUP BY bucket")
def coverage_stats(read):
    rows = tools.classify(session_events(read("events")))
    bucket = F.when(F.col("kind").startswith("session."), "lifecycle").when(F.col("kind").startswith("message."), "hook").when(F.col("name").isin(*tools.KNOWN), "classified").otherwise("unclassified")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("low_conf", f"WITH {EV}, n AS (SELECT {NORM} AS name, CASE WHEN {NORM} IN ({', '.join(repr(x) for x in tools.KNOWN)}) THEN 0.95 ELSE 0.6 END::DOUBLE AS conf FROM ev WHERE kind LIKE 'tool.%') SELECT name, min(conf) AS conf, count(*) AS n FROM n WHERE conf < 0.9 GROUP BY name")
def low_conf(read):
    rows = tools.classify(session_events(read("events")).where("kind like 'tool.%'")).withColumn("conf", F.when(F.col("name").isin(*tools.KNOWN), 0.95).otherwise(0.6))
    return rows.where("conf < 0.9").groupBy("name").agg(F.min("conf").alias("conf"), F.count(F.lit(1)).alias("n"))


@query("cost_models", f"WITH {USAGE} SELECT model, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM usage GROUP BY model")
def cost_models(read):
    return usage_by(usage(read), "model").orderBy(F.desc(F.coalesce("cost_cents", F.lit(-1))), "model")


@query("cost_totals", f"WITH {USAGE} SELECT CAST(sum(cost_cents) AS BIGINT) AS cost_cents, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, round(100.0 * sum(output_tokens) / (sum(input_tokens) + sum(output_tokens)))::BIGINT AS output_pct FROM usage")
def cost_totals(read):
    share = F.round(100.0 * F.sum("output_tokens") / (F.sum("input_tokens") + F.sum("output_tokens"))).cast("long")
    return usage(read).agg(F.sum("cost_cents").alias("cost_cents"), F.sum("input_tokens").alias("input_tokens"), share.alias("output_pct"))


@query("dist_peak", f"WITH {SCORED}, l AS (SELECT {LEVEL} AS level, score FROM sc) SELECT level, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM l))::BIGINT AS pct, CAST(max(score) AS BIGINT) AS peak FROM l GROUP BY level")
def dist_peak(read):
    rows = scored(read).where("score is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("peak"))
    total = F.sum("n").over(Window.partitionBy())  # four levels
    return rows.select("level", "n", F.round(100.0 * F.col("n") / total).cast("long").alias("pct"), "peak")


@query("identity", "SELECT c_custkey, split_part(c_name, '#', 1) AS agent, split_part(c_name, '#', 2) AS model, n_name AS repo FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def identity(read):
    joined = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("agent"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("model"), F.col("n_name").alias("repo"))


@query("title_latest", "WITH v AS (SELECT conv_id AS segment_id, role AS kind, turn AS version, text AS title FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY segment_id, kind ORDER BY version DESC) AS p FROM v) SELECT segment_id, kind, version, title FROM r WHERE p = 1")
def title_latest(read):
    rows = read("conversations").select(F.col("conv_id").alias("segment_id"), F.col("role").alias("kind"), F.col("turn").alias("version"), F.col("text").alias("title"))
    return rows.groupBy("segment_id", "kind").agg(F.max(F.struct("version", "title")).alias("t")).select("segment_id", "kind", "t.version", "t.title")


@query("title_join", f"WITH {SEGMENTS}, t AS (SELECT conv_id AS segment_id, arg_max(text, turn) AS title FROM conversations GROUP BY conv_id) SELECT sg.id, coalesce(t.title, 'untitled') AS title FROM sg LEFT JOIN t ON sg.step_id = t.segment_id")
def title_join(read):
    titles = read("conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("title"))
    rows = segmented(read)
    return rows.join(titles, F.col("step_id") == F.col("conv_id"), "left").select("id", F.coalesce("title", F.lit("untitled")).alias("title"))


@query("dominant_tool", f"WITH {EV}, c AS (SELECT session_id, tool, count(*) AS n FROM ev GROUP BY session_id, tool), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, tool) AS p FROM c) SELECT session_id, tool FROM r WHERE p = 1")
def dominant_tool(read):
    return most_frequent(session_events(read("events")), "session_id", "tool")
