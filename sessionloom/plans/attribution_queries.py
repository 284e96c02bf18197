"""Queries of cost, latency and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import attribution as att
from .lens import EV, MSG, SPANS, USAGE, messages, session_events, spans, usage_records
from .register import query


def usage(read):
    return usage_records(read("lineitem"), read("orders"))


def rolled(read):
    return att.rollups(spans(read("lineitem"), read("orders")), usage(read))


_SIDES = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS key, 1 AS sc, (epoch_us(end_time) - epoch_us(start_time)) // 1000 AS du, 0 AS uc, 0 AS cc, 0 AS it, 0 AS ot FROM spans WHERE {d} IS NOT NULL UNION ALL SELECT '{d}', {d}, 0, 0, 1, cost_cents, input_tokens, output_tokens FROM usage WHERE {d} IS NOT NULL" for d in att.DIMENSIONS)
ROLLED = f"{USAGE}, {SPANS}, sides AS ({_SIDES}), rolled AS (SELECT dimension, key, CAST(sum(sc) AS BIGINT) AS span_count, CAST(sum(du) AS BIGINT) AS total_duration_ms, CAST(sum(uc) AS BIGINT) AS usage_count, CAST(sum(cc) AS BIGINT) AS cost_cents, CAST(sum(it) AS BIGINT) AS input_tokens, CAST(sum(ot) AS BIGINT) AS output_tokens FROM sides GROUP BY dimension, key)"


@query("attr_rollup", f"WITH {ROLLED} SELECT * FROM rolled")
def attr_rollup(read):
    return rolled(read)


@query("anomaly_thr", f"WITH {ROLLED} SELECT dimension, key, 'cost_cents' AS metric, cost_cents AS value FROM rolled WHERE cost_cents > 100000000 UNION ALL SELECT dimension, key, 'duration_ms', total_duration_ms FROM rolled WHERE total_duration_ms > 1000000000")
def anomaly_thr(read):
    return att.threshold_anomalies(rolled(read), 1_000_000_000, 100_000_000)


@query("anomaly_z", f"""WITH {ROLLED}, m AS (SELECT dimension, key, 'duration_ms' AS metric, total_duration_ms AS v FROM rolled UNION ALL SELECT dimension, key, 'cost_cents', cost_cents FROM rolled),
 s AS (SELECT *, count(*) OVER w AS n, avg(v) OVER w AS a, stddev_pop(v) OVER w AS d FROM m WINDOW w AS (PARTITION BY dimension, metric)) SELECT dimension, key, metric, round((v - a) / d, 6) AS score FROM s WHERE n >= 3 AND d > 0 AND (v - a) / d >= 0.5""")
def anomaly_z(read):
    return att.z_anomalies(rolled(read), 0.5)


@query("cost_breakdown", f"WITH {USAGE} SELECT msg_id, turn, cost_cents, coalesce(cost_cents * input_tokens // nullif(input_tokens + output_tokens, 0), 0) AS input_cents, cost_cents - coalesce(cost_cents * input_tokens // nullif(input_tokens + output_tokens, 0), 0) AS output_cents FROM usage")
def cost_breakdown(read):
    return att.cost_breakdown(usage(read)).select("msg_id", "turn", "cost_cents", "input_cents", "output_cents")


@query("usage_breakdown", f"WITH {USAGE} SELECT session_id, model, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM usage GROUP BY session_id, model")
def usage_breakdown(read):
    return att.usage_by(usage(read), "session_id", "model")


@query("usage_bridge", f"WITH {USAGE} SELECT msg_id, turn, CASE WHEN model = '3-MEDIUM' THEN '' ELSE model END AS model, input_tokens + output_tokens AS total_in FROM usage WHERE input_tokens + output_tokens + cost_cents > 0")
def usage_bridge(read):
    return usage(read).where("input_tokens + output_tokens + cost_cents > 0").select("msg_id", "turn", F.when(F.col("model") == "3-MEDIUM", "").otherwise(F.col("model")).alias("model"), (F.col("input_tokens") + F.col("output_tokens")).alias("total_in"))


@query("usage_dedup", f"WITH {USAGE}, r AS (SELECT msg_id, turn, row_number() OVER (PARTITION BY msg_id ORDER BY turn) AS n FROM usage) SELECT msg_id, turn FROM r WHERE n = 1 OR msg_id IS NULL")
def usage_dedup(read):
    n = F.row_number().over(Window.partitionBy("msg_id").orderBy("turn"))
    return usage(read).select("msg_id", "turn", n.alias("n")).where("n = 1 or msg_id is null").drop("n")


@query("dominant_model", f"WITH {USAGE}, c AS (SELECT session_id, model, count(*) AS n FROM usage WHERE trim(model) <> '' GROUP BY session_id, model), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, model) AS p FROM c) SELECT session_id, model FROM r WHERE p = 1")
def dominant_model(read):
    return att.most_frequent(usage(read), "session_id", "model")


@query("kind_hist", f"WITH {EV} SELECT kind, count(*) AS n FROM ev GROUP BY kind")
def kind_hist(read):
    return session_events(read("events")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("session_summary_fmt", f"WITH {EV} SELECT session_id, tool, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, tool) AS p FROM (SELECT session_id, tool, count(*) AS n FROM ev WHERE kind LIKE 'tool.%' GROUP BY session_id, tool)) WHERE p <= 5")
def session_summary_fmt(read):
    counts = session_events(read("events")).where("kind like 'tool.%'").groupBy("session_id", "tool").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "tool"))).where("p <= 5").drop("p")


@query("density_fmt", f"WITH {EV} SELECT id, '[' || kind || '] ' || tool || ': ' || substr(command, 1, 20) AS line FROM ev WHERE kind LIKE 'tool.%'")
def density_fmt(read):
    return session_events(read("events")).where("kind like 'tool.%'").select("id", F.concat(F.lit("["), "kind", F.lit("] "), "tool", F.lit(": "), F.substring("command", 1, 20)).alias("line"))


@query("status_counts", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'usage', count(*) FROM lineitem UNION ALL SELECT 'sessions', count(*) FROM orders UNION ALL SELECT 'messages', count(*) FROM conversations")
def status_counts(read):
    out = None
    for name, table in (("events", "events"), ("usage", "lineitem"), ("sessions", "orders"), ("messages", "conversations")):
        one = read(table).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


QUALITY = f"{EV}, q AS (SELECT session_id, count(*) AS n_events, count(DISTINCT tool) AS n_tools, count(*) FILTER (tool IN ('write_file', 'edit-file')) AS n_changes FROM ev GROUP BY session_id)"


def quality(read):
    return session_events(read("events")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("tool").alias("n_tools"), F.count(F.when(F.col("tool").isin("write_file", "edit-file"), 1)).alias("n_changes"))


@query("quality_signals", f"WITH {QUALITY} SELECT * FROM q")
def quality_signals(read):
    return quality(read)


@query("quality_rank", f"WITH {QUALITY}, r AS (SELECT session_id, rank() OVER (ORDER BY n_events) + (count(*) OVER (PARTITION BY n_events) - 1) / 2.0 AS a, rank() OVER (ORDER BY n_changes) + (count(*) OVER (PARTITION BY n_changes) - 1) / 2.0 AS b, count(*) OVER () AS n FROM q) SELECT session_id, round(CASE WHEN n = 1 THEN 0.5 ELSE (((a - 1) / (n - 1)) + ((b - 1) / (n - 1))) / 2 END, 6)::DOUBLE AS score FROM r")
def quality_rank(read):
    """The mean of the signals' percentile ranks, ties at their average. Ranks come from counts of the distinct values, so no window holds all
    sessions."""
    rows = quality(read)
    out = rows
    for c in ("n_events", "n_changes"):
        counts = rows.groupBy(c).agg(F.count(F.lit(1)).alias("same"))
        below = F.coalesce(F.sum("same").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = counts.select(F.col(c), (below + (F.col("same") - 1) / 2.0).alias(f"r_{c}"))
        out = out.join(ranks, c)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    share = lambda c: F.col(f"r_{c}") / (F.col("n") - 1)
    return out.crossJoin(F.broadcast(n)).select("session_id", F.round(F.when(F.col("n") == 1, 0.5).otherwise((share("n_events") + share("n_changes")) / 2), 6).alias("score"))


@query("select_floor", f"WITH {QUALITY} SELECT session_id FROM q WHERE n_changes >= 12")
def select_floor(read):
    return quality(read).where("n_changes >= 12").select("session_id")


@query("select_topn", f"WITH {QUALITY} SELECT session_id, n_changes FROM q ORDER BY n_changes DESC, session_id LIMIT 25")
def select_topn(read):
    return quality(read).select("session_id", "n_changes").orderBy(F.desc("n_changes"), "session_id").limit(25)


@query("stratify")
def stratify(read):
    """Sessions of each size class up to a quota, in the order of a seeded hash."""
    sized = quality(read).withColumn("bucket", F.when(F.col("n_events") < 60, "small").when(F.col("n_events") < 70, "middle").otherwise("large"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("session_id", F.lit(7)), "session_id"))
    return sized.withColumn("place", place).where("place <= 10").select("bucket", "session_id")


@query("groupkfold", f"WITH {EV} SELECT id, session_id % 5 AS fold FROM ev")
def groupkfold(read):
    return session_events(read("events")).select("id", (F.col("session_id") % 5).alias("fold"))


GUESSED = "c AS (SELECT l.quality AS truth, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS guess FROM documents d JOIN labels l USING (doc_id))"
_RATIO = "CASE WHEN coalesce({b}, 0) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END"
REPORT = f"""{GUESSED}, k AS (SELECT truth AS class FROM c UNION SELECT guess FROM c),
 n AS (SELECT class, count(*) FILTER (truth = class AND guess = class) AS hits, count(*) FILTER (guess = class) AS guesses, count(*) FILTER (truth = class) AS support FROM k, c WHERE class IS NOT NULL GROUP BY class),
 r AS (SELECT *, round({_RATIO.format(a="hits", b="guesses")}, 6) AS precision, round({_RATIO.format(a="hits", b="support")}, 6) AS recall, round({_RATIO.format(a="2 * hits", b="(guesses + support)")}, 6) AS f1 FROM n)"""


def guessed(read):
    return read("documents").join(read("labels"), "doc_id").select(F.col("quality").alias("truth"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("guess"))


@query("clf_report", f"WITH {REPORT} SELECT * FROM r")
def clf_report(read):
    return att.class_report(guessed(read), "truth", "guess")


@query("clf_confusion", f"WITH {GUESSED} SELECT truth, guess, count(*) AS n FROM c GROUP BY truth, guess")
def clf_confusion(read):
    """The confusion matrix, without its empty cells."""
    return guessed(read).groupBy("truth", "guess").agg(F.count(F.lit(1)).alias("n"))


@query("clf_macro", f"WITH {REPORT} SELECT count(*) AS n_classes, round(avg({_RATIO.format(a='2 * hits', b='(guesses + support)')}), 6) AS f1_macro, round(CAST(sum(2 * hits) AS DOUBLE) / sum(guesses + support), 6) AS f1_micro FROM r")
def clf_macro(read):
    return att.averaged(att.class_report(guessed(read), "truth", "guess"))


@query("pilot_eval", f"WITH {MSG} SELECT kind, count(*) AS n, count(DISTINCT session_id) AS n_sessions, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM msg GROUP BY kind")
def pilot_eval(read):
    return messages(read("conversations")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("n_sessions"), F.sum(F.length("text")).cast("long").alias("n_chars"))
