"""Queries of pairing, classification and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shell, tools
from ..operators import pairing, risk
from .lens import COMMANDS, EV, session_events
from .register import query

PAIRED = f"""{EV}, st AS (SELECT *, sum(CASE WHEN kind = 'session.ended' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS stretch FROM ev),
 nx AS (SELECT *, lead(kind) OVER w AS nk, lead(id) OVER w AS ni, lead(ts) OVER w AS nt, lead(value) OVER w AS nv, lag(kind) OVER w AS pk FROM st WHERE kind IN ('tool.call.started', 'tool.call.completed')
   WINDOW w AS (PARTITION BY session_id, call_id, stretch ORDER BY ts, id)),
 paired AS (SELECT session_id, call_id, tool, CASE WHEN kind = 'tool.call.started' AND nk = 'tool.call.completed' THEN 'paired' WHEN kind = 'tool.call.completed' THEN 'lone' WHEN nk = 'tool.call.started' THEN 'displaced' ELSE 'orphan' END AS status,
   CASE WHEN kind = 'tool.call.started' THEN id END AS start_id, CASE WHEN kind = 'tool.call.completed' THEN id WHEN nk = 'tool.call.completed' THEN ni END AS done_id,
   CASE WHEN kind = 'tool.call.started' AND nk = 'tool.call.completed' THEN greatest(0, epoch_us(nt) - epoch_us(ts)) / 1000.0::DOUBLE END AS duration_ms,
   CASE WHEN kind = 'tool.call.started' AND nk = 'tool.call.completed' THEN coalesce(nv, value) ELSE value END AS value
   FROM nx WHERE kind = 'tool.call.started' OR pk IS NULL OR pk = 'tool.call.completed')"""


@query("pair_calls", f"WITH {PAIRED} SELECT * FROM paired")
def pair_calls(read):
    return pairing.pair_calls(session_events(read("events")))


@query("pair_orphan", f"WITH {PAIRED} SELECT session_id, start_id, tool FROM paired WHERE status IN ('orphan', 'displaced')")
def pair_orphan(read):
    return pairing.pair_calls(session_events(read("events"))).where(F.col("status").isin("orphan", "displaced")).select("session_id", "start_id", "tool")


@query("pair_dup", f"WITH {PAIRED} SELECT session_id, call_id, count(*) AS n_displaced FROM paired WHERE status = 'displaced' GROUP BY session_id, call_id")
def pair_dup(read):
    return pairing.pair_calls(session_events(read("events"))).where("status = 'displaced'").groupBy("session_id", "call_id").agg(F.count(F.lit(1)).alias("n_displaced"))


@query("duration", f"WITH {PAIRED} SELECT tool, count(*) AS n, max(duration_ms) AS longest_ms, min(duration_ms) AS shortest_ms FROM paired WHERE status = 'paired' GROUP BY tool")
def duration(read):
    return pairing.pair_calls(session_events(read("events"))).where("status = 'paired'").groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.max("duration_ms").alias("longest_ms"), F.min("duration_ms").alias("shortest_ms"))


@query("pair_bounds", f"""WITH {EV}, s AS (SELECT *, epoch_us(ts) AS us, max(epoch_us(ts)) OVER (ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  sum(CASE WHEN kind = 'session.ended' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, id) AS stretch FROM ev),
 n AS (SELECT *, lead(kind) OVER w AS nk, lead(id) OVER w AS ni, lead(before) OVER w AS nb, lag(kind) OVER w AS pk FROM s WHERE kind IN ('tool.call.started', 'tool.call.completed') WINDOW w AS (PARTITION BY session_id, call_id, stretch ORDER BY ts, id)),
 m AS (SELECT *, kind = 'tool.call.started' AND nk IS NOT DISTINCT FROM 'tool.call.completed' AS answered, nb - us > 86400000000 AS late FROM n)
SELECT session_id, call_id, 'paired' AS status, id AS start_id, ni AS done_id FROM m WHERE answered AND NOT late
UNION ALL SELECT session_id, call_id, 'orphan', id, NULL FROM m WHERE kind = 'tool.call.started' AND (NOT answered OR late)
UNION ALL SELECT session_id, call_id, 'lone', NULL, ni FROM m WHERE answered AND late
UNION ALL SELECT session_id, call_id, 'lone', NULL, id FROM m WHERE kind = 'tool.call.completed' AND (pk IS NULL OR pk = 'tool.call.completed')""")
def pair_bounds(read):
    """Starts wait for a day of the stream's time."""
    return pairing.pair_bounded(session_events(read("events")), 86_400)


@query("pair_fifo", f"""WITH {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id, tool, kind ORDER BY ts, id) AS n FROM ev)
SELECT a.session_id, a.tool, a.n, a.id AS start_id, b.id AS done_id FROM o a JOIN o b ON a.session_id = b.session_id AND a.tool = b.tool AND a.n = b.n
WHERE a.kind = 'tool.call.started' AND b.kind = 'tool.call.completed'""")
def pair_fifo(read):
    return pairing.pair_by_place(session_events(read("events")))


@query("visibility", f"WITH {EV} SELECT id, CASE WHEN kind IN ('session.started', 'session.ended') THEN 'system' ELSE 'visible' END AS visibility FROM ev")
def visibility(read):
    return session_events(read("events")).select("id", F.when(F.col("kind").isin("session.started", "session.ended"), "system").otherwise("visible").alias("visibility"))


NORM = "replace(lower(regexp_replace(tool, '^mcp__[A-Za-z0-9]+__', '')), '-', '_')"


@query("norm_tool", f"WITH {EV} SELECT DISTINCT tool, {NORM} AS name FROM ev")
def norm_tool(read):
    return session_events(read("events")).select("tool", tools.normalized(F.col("tool")).alias("name")).distinct()


_CASES = " ".join(f"WHEN name = '{n}' THEN '{e}'" for n, (_, e, _) in tools.KNOWN.items())
_VERBS = " ".join(f"WHEN name = '{v}' OR starts_with(name, '{v}_') THEN '{e}'" for v, e in tools.VERBS)


@query("classify_tool", f"WITH {EV}, n AS (SELECT id, tool, {NORM} AS name FROM ev WHERE kind LIKE 'tool.%') SELECT id, name, CASE WHEN starts_with(tool, 'mcp__') THEN 'mcp' WHEN name IN ({', '.join(repr(x) for x in tools.KNOWN)}) THEN 'native' ELSE 'unknown' END AS mechanism, CASE {_CASES} {_VERBS} END AS effect FROM n")
def classify_tool(read):
    return tools.classify(session_events(read("events")).where("kind like 'tool.%'")).select("id", "name", "mechanism", "effect")


@query("verb_infer", f"WITH {EV}, n AS (SELECT DISTINCT {NORM} AS name FROM ev) SELECT name, CASE {_VERBS} END AS effect FROM n")
def verb_infer(read):
    return session_events(read("events")).select(tools.normalized(F.col("tool")).alias("name")).distinct().withColumn("effect", tools.verb_effect(F.col("name")))


@query("classify_permission", f"WITH {EV} SELECT id, CASE k % 4 WHEN 0 THEN 'read_only' WHEN 1 THEN 'mutating' WHEN 2 THEN 'mutating' END AS effect FROM ev")
def classify_permission(read):
    kinds = F.element_at(F.array(*map(F.lit, ("read", "write", "shell", "other"))), (F.col("k") % 4 + 1).cast("int"))
    return session_events(read("events")).select("id", tools.permission_effect(kinds).alias("effect"))


@query("tool_display", f"WITH {EV} SELECT DISTINCT tool, upper(substr({NORM}, 1, 1)) || replace(substr({NORM}, 2), '_', ' ') AS label FROM ev")
def tool_display(read):
    return session_events(read("events")).select("tool", tools.display(F.col("tool")).alias("label")).distinct()


@query("taxonomy", "WITH t AS (SELECT DISTINCT p_type AS path FROM part) SELECT a.path AS ancestor, count(*) AS n FROM (SELECT DISTINCT split_part(path, ' ', 1) AS path FROM t) a JOIN t b ON b.path = a.path OR starts_with(b.path, a.path || ' ') GROUP BY a.path")
def taxonomy(read):
    paths = read("part").select(F.regexp_replace("p_type", " ", ".").alias("path")).distinct()
    return tools.descendants(paths).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))


#: The published scores of these commands, in the order of the lens.
GOLDEN = (66, 66, 66, 72, 88, 28, 43, 72, 61, 28, 28, 46, 12, 12, 12, 12, 12, 12, 28, 28, 28)
_GOLDEN = ", ".join(f"({i}, {s})" for i, s in enumerate(GOLDEN))


@query("risk_shell", f"WITH {EV}, g(i, score) AS (VALUES {_GOLDEN}) SELECT id, CAST(score AS BIGINT) AS score, CASE WHEN score <= 20 THEN 'safe' WHEN score <= 45 THEN 'caution' WHEN score <= 75 THEN 'danger' ELSE 'critical' END AS level FROM ev JOIN g ON k % {len(COMMANDS)} = i WHERE kind = 'tool.call.started'")
def risk_shell(read):
    return risk.shell_risk(session_events(read("events")).where("kind = 'tool.call.started'")).select("id", "score", "level")


@query("risk_patterns", f"WITH {EV} SELECT id, CAST(least(25, " + " + ".join(f"CASE WHEN regexp_matches(command, '{p}') THEN {s} ELSE 0 END" for p, s, _, _ in risk.PATTERNS) + f") AS BIGINT) AS bonus FROM ev WHERE kind = 'tool.call.started'")
def risk_patterns(read):
    return session_events(read("events")).where("kind = 'tool.call.started'").select("id", risk.pattern_bonus(F.col("command")).alias("bonus"))


_PERSISTENT = "(/etc/cron|/var/spool/cron|/etc/systemd/|/etc/profile|(~|/root|/home/[^/\\s]+)/\\.(bashrc|profile|zshrc))"


@query("hazards", f"""WITH {EV} SELECT id, regexp_matches(command, '(?i)(\\bof=|>>?\\s*)/dev/(sd|nvme|disk|hd|vd|mmcblk|xvd)') AS raw_device,
 regexp_matches(command, '(^|[|;&]\\s*)(mkfs(\\.\\w+)?|mke2fs|mkswap|wipefs)\\b') AS fs_format, regexp_matches(command, '>>?\\s*{_PERSISTENT}|\\b(tee|cp|mv|install|ln)\\b.*{_PERSISTENT}|(^|[|;&]\\s*)crontab\\b') AS persistence,
 regexp_matches(command, ':\\s*\\(\\)\\s*\\{{[^{{}}]*:[^{{}}]*\\|[^{{}}]*:[^{{}}]*&[^{{}}]*\\}}\\s*;\\s*:') AS fork_bomb FROM ev""")
def hazards(read):
    return shell.with_commands(session_events(read("events"))).select("id", *[x.alias(n) for n, x in risk.hazards(F.col("commands")).items()])


@query("risk_tool", f"""WITH {EV}, n AS (SELECT id, tool, {NORM} AS name FROM ev WHERE kind LIKE 'tool.%'), e AS (SELECT id, name, CASE {_CASES} {_VERBS} END AS effect FROM n)
SELECT id, CAST(least(100, CASE effect WHEN 'read_only' THEN 8 WHEN 'destructive' THEN 42 ELSE 24 END + CASE name {' '.join(f"WHEN '{n}' THEN {risk.capability_weight(c)}" for n, (_, _, c) in tools.KNOWN.items() if c)} ELSE 0 END + 4) AS BIGINT) AS score FROM e""")
def risk_tool(read):
    return risk.tool_risk(tools.classify(session_events(read("events")).where("kind like 'tool.%'"))).select("id", "score")
