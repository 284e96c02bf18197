"""Queries of governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance as gov
from ..operators import ledger, risk
from ..operators.sequence import PHASES, inherit_phase, numbered
from .enrichment_queries import _GOLDEN, PAIRED
from .lens import COMMANDS, EV, session_events
from .register import query
from .sequence_queries import PHASED, W

CALLS = f"{EV}, calls AS (SELECT * FROM ev WHERE kind IN ('tool.call.started', 'tool.call.completed'))"


def calls(read):
    return session_events(read("events")).where("kind in ('tool.call.started', 'tool.call.completed')")


@query("gov_dispatch", f"WITH {PAIRED} SELECT id, kind FROM ev WHERE kind = 'tool.call.completed' OR kind LIKE 'session.%' UNION ALL SELECT start_id AS id, 'tool.call.started' AS kind FROM paired WHERE status IN ('orphan', 'displaced') AND call_id IS NOT NULL")
def gov_dispatch(read):
    return gov.dispatched(session_events(read("events"))).select("id", "kind")


@query("budget", f"WITH {CALLS} SELECT id, count(*) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n_calls, count(*) OVER (PARTITION BY session_id, tool ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n_tool FROM calls")
def budget(read):
    return gov.budgets(calls(read), ("tool",)).select("id", "n_calls", "n_tool")


@query("pressure", f"WITH {CALLS}, b AS (SELECT id, count(*) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n, count(*) OVER (PARTITION BY session_id, tool ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS t FROM calls) SELECT id FROM b WHERE n >= 20 OR t >= 5")
def pressure(read):
    return gov.budgets(calls(read), ("tool",)).where("n_calls >= 20 or n_tool >= 5").select("id")


@query("cost_ceiling", f"WITH {CALLS}, b AS (SELECT id, count(*) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n FROM calls) SELECT id, CASE WHEN n > 40 THEN 'deny' WHEN n >= 20 THEN 'escalate' ELSE 'allow' END AS action FROM b")
def cost_ceiling(read):
    n = F.col("n_calls")
    return gov.budgets(calls(read), ()).select("id", gov.first_rule([(n > 40, "deny"), (n >= 20, "escalate")], "allow").alias("action"))


_TURNS = " ".join(f"WHEN lp = '{a}' AND phase = '{b}' THEN {n}" for (a, b), n in reversed(gov.TURNS.items()))
_SEEN = ", ".join(f"count(*) FILTER (phase = '{p}') OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS c_{p}" for p in PHASES)
_ALL = " + ".join(f"c_{p}" for p in PHASES)
_BASE = ", ".join(f"count(*) FILTER (phase = '{p}') / count(phase) AS q_{p}" for p in PHASES)
_JS = " + ".join(f"CASE WHEN c_{p} > 0 THEN c_{p} / w * ln(c_{p} / w / ((c_{p} / w + q_{p}) / 2)) / 2 ELSE 0 END + CASE WHEN q_{p} > 0 THEN q_{p} * ln(q_{p} / ((c_{p} / w + q_{p}) / 2)) / 2 ELSE 0 END" for p in PHASES)
DRIFT = f"""{PHASED}, base AS (SELECT {_BASE} FROM ph WHERE phase IS NOT NULL), l AS (SELECT *, lag(phase) OVER {W} AS lp FROM ph), t AS (SELECT *, CASE WHEN lp IS NOT NULL AND phase IS DISTINCT FROM lp THEN 1 ELSE 0 END AS turned FROM l),
 n AS (SELECT *, sum(turned) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS n_turns, count(*) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS seen, {_SEEN} FROM t),
 js AS (SELECT *, CASE WHEN w > 0 THEN {_JS} ELSE 0 END AS apart FROM (SELECT *, {_ALL} AS w FROM n), base),
 dr AS (SELECT session_id, ts, id, command, kind, CAST(n_turns AS BIGINT) AS n_turns, CAST(CASE WHEN seen < 5 THEN 0 ELSE least(25, CASE {_TURNS} ELSE 0 END + CASE WHEN n_turns > 5 THEN 20 ELSE 0 END + CASE WHEN apart > 0.3 THEN least(15, floor(25 * apart)) ELSE 0 END) END AS BIGINT) AS drift FROM js)"""


def drifting(read):
    """Events with their drift from the phases of all sessions."""
    events = inherit_phase(session_events(read("events")))
    return gov.drift(events, gov.phase_shares(events))


@query("drift", f"WITH {DRIFT} SELECT id, n_turns, drift FROM dr")
def drift(read):
    return drifting(read).select("id", "n_turns", "drift")


RANK = "CASE WHEN regexp_matches(command, 'id_rsa|\\.pem|/etc/shadow|\\.env') THEN 3 WHEN regexp_matches(command, '/etc/passwd|/etc/cron') THEN 2 WHEN regexp_matches(command, 'src|README') THEN 1 ELSE 0 END"


@query("taint", f"WITH {CALLS}, r AS (SELECT *, {RANK} AS rank FROM calls) SELECT id, CAST(max(rank) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS taint FROM r")
def taint(read):
    return gov.taint(calls(read)).select("id", "taint")


@query("ifc_label", f"WITH {CALLS}, r AS (SELECT *, {RANK} AS rank FROM calls), b AS (SELECT *, max(rank) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) SELECT id, command FROM b WHERE coalesce(before, 0) >= 2 AND regexp_matches(command, '> |curl|nc |wget|rm |dd ')")
def ifc_label(read):
    return gov.taint(calls(read)).where("violation").select("id", "command")


@query("integrity", "WITH h AS (SELECT source, doc_id, sha256(text) AS hash FROM documents), l AS (SELECT *, lag(hash) OVER (PARTITION BY source ORDER BY doc_id) AS last_hash FROM h) SELECT doc_id, hash, last_hash IS NOT NULL AND last_hash <> hash AS tampered FROM l")
def integrity(read):
    return gov.content_changes(read("documents").select("doc_id", "source", "text"), "source", "doc_id", "text").select("doc_id", "hash", "tampered")


@query("mcp_drift", f"WITH {EV}, p AS (SELECT id, tool, session_id, ts, sha256(command) AS h FROM ev WHERE starts_with(tool, 'mcp__')), f AS (SELECT *, first_value(h) OVER (PARTITION BY tool ORDER BY ts, id) AS h0 FROM p) SELECT tool, count(*) AS n_seen, count(*) FILTER (h <> h0) AS n_drifted FROM f GROUP BY tool")
def mcp_drift(read):
    """Fingerprints against the first seen of the tool. The first is found by an aggregate, so a tool of any size is not one group."""
    seen = session_events(read("events")).where("tool like 'mcp!_!_%' escape '!'").withColumn("h", F.sha2("command", 256))
    first = seen.groupBy("tool").agg(F.min(F.struct("ts", "id", "h"))["h"].alias("h0"))
    return seen.join(first, "tool").groupBy("tool").agg(F.count(F.lit(1)).alias("n_seen"), F.count(F.when(F.col("h") != F.col("h0"), 1)).alias("n_drifted"))


@query("idempotency", f"WITH {EV}, r AS (SELECT session_id, kind, call_id, id, row_number() OVER (PARTITION BY session_id, kind, call_id ORDER BY ts, id) AS n FROM ev) SELECT session_id, kind, call_id, id FROM r WHERE n = 1")
def idempotency(read):
    return gov.first_delivery(session_events(read("events")), ["session_id", "kind", "call_id"], ["ts", "id"]).select("session_id", "kind", "call_id", "id")


DELIVERIES = f"""{EV}, dl AS (SELECT session_id, call_id, ts, id, CASE WHEN kind = 'session.ended' THEN 'refused' WHEN kind = 'tool.call.failed' THEN 'failed' WHEN kind = 'tool.call.completed' THEN 'ok' ELSE 'crashed' END AS outcome FROM ev)"""


@query("delivery_ledger", f"""WITH {DELIVERIES}, f AS (SELECT *, row_number() OVER (PARTITION BY session_id, call_id, outcome ORDER BY ts, id) AS nth, row_number() OVER (PARTITION BY session_id, call_id ORDER BY ts, id) AS place FROM dl),
 k AS (SELECT session_id, call_id, count(*) AS deliveries, min(place) FILTER (outcome <> 'refused') AS reserved, min(place) FILTER (outcome = 'ok') AS ok, min(place) FILTER (outcome = 'failed' AND nth = 3) AS dead FROM f GROUP BY session_id, call_id),
 c AS (SELECT k.*, least(coalesce(ok, dead), coalesce(dead, ok)) AS closed FROM k)
SELECT c.session_id, c.call_id, CASE WHEN reserved IS NULL THEN 'discarded' WHEN closed IS NULL THEN 'reserved' WHEN closed = ok THEN 'finalized' ELSE 'dead_letter' END AS state, deliveries,
 (SELECT count(*) FROM f WHERE f.session_id = c.session_id AND f.call_id = c.call_id AND f.outcome = 'failed' AND (c.closed IS NULL OR f.place <= c.closed)) AS attempts, r.id AS reserved_id, e.id AS closed_id
FROM c LEFT JOIN f r ON r.session_id = c.session_id AND r.call_id = c.call_id AND r.place = c.reserved LEFT JOIN f e ON e.session_id = c.session_id AND e.call_id = c.call_id AND e.place = c.closed""")
def delivery_ledger(read):
    """Events of one session and call as deliveries of one key."""
    kind = F.col("kind")
    outcome = F.when(kind == "session.ended", ledger.REFUSED).when(kind == "tool.call.failed", ledger.FAILED).when(kind == "tool.call.completed", ledger.OK).otherwise(ledger.CRASHED)
    rows = ledger.delivery_ledger(session_events(read("events")).withColumn("outcome", outcome), ["session_id", "call_id"], ["ts", "id"])
    return rows.select("session_id", "call_id", "state", "deliveries", "attempts", F.col("reserved_at.id").alias("reserved_id"), F.col("closed_at.id").alias("closed_id"))


@query("event_key", f"WITH {EV} SELECT id, CASE WHEN kind LIKE 'session.%' THEN session_id || ':' || kind WHEN kind LIKE 'tool.%' THEN session_id || ':' || kind || ':' || call_id ELSE sha256(session_id || '|' || kind || '|' || k) END AS event_key FROM ev")
def event_key(read):
    s = F.col("session_id").cast("string")
    key = F.when(F.col("kind").startswith("session."), F.concat_ws(":", s, "kind")).when(F.col("kind").startswith("tool."), F.concat_ws(":", s, "kind", F.col("call_id").cast("string"))).otherwise(F.sha2(F.concat_ws("|", s, "kind", F.col("k").cast("string")), 256))
    return session_events(read("events")).select("id", key.alias("event_key"))


@query("canonical_hash", f"""WITH {EV} SELECT id, sha256('{{"command":[' || to_json(command) || '],"tool":[' || to_json(tool) || ']}}') AS hash FROM ev WHERE kind LIKE 'tool.%'""")
def canonical_hash(read):
    rows = session_events(read("events")).where("kind like 'tool.%'")
    return rows.select("id", gov.action_hash({"tool": F.col("tool"), "command": F.col("command")}).alias("hash"))


@query("session_summary", f"WITH {EV}, e AS (SELECT session_id, id, ts, row_number() OVER {W} AS n FROM ev WHERE kind = 'session.ended') SELECT session_id, id, ts FROM e WHERE n = 1")
def session_summary(read):
    return gov.first_delivery(session_events(read("events")).where("kind = 'session.ended'"), ["session_id"], ["ts", "id"]).select("session_id", "id", "ts")


@query("backpressure_gaps", f"WITH {EV}, s AS (SELECT session_id, id, row_number() OVER {W} - 1 AS seq FROM ev), k AS (SELECT * FROM s WHERE id % 13 <> 0), l AS (SELECT session_id, lag(seq) OVER (PARTITION BY session_id ORDER BY seq) AS after_seq, seq AS before_seq FROM k) SELECT *, before_seq - after_seq - 1 AS n_missing FROM l WHERE before_seq - after_seq > 1")
def backpressure_gaps(read):
    return gov.seq_gaps(numbered(session_events(read("events"))).where("id % 13 <> 0"))


RULES = "CASE WHEN regexp_matches(command, 'mkfs|dd if=') THEN 'deny' WHEN score >= 60 THEN 'deny' WHEN regexp_matches(command, 'curl|wget|nc ') THEN 'escalate' WHEN score >= 28 THEN 'warn' ELSE 'allow' END"
SCORED = f"{EV}, g(i, score) AS (VALUES {_GOLDEN}), sc AS (SELECT ev.*, score FROM ev JOIN g ON k % {len(COMMANDS)} = i WHERE kind = 'tool.call.started')"


def ruled(read):
    scored = risk.shell_risk(session_events(read("events")).where("kind = 'tool.call.started'"))
    command, score = F.col("command"), F.col("score")
    return scored.withColumn("action", gov.first_rule([(command.rlike("mkfs|dd if="), "deny"), (score >= 60, "deny"), (command.rlike("curl|wget|nc "), "escalate"), (score >= 28, "warn")], "allow"))


@query("rules", f"WITH {SCORED} SELECT id, {RULES} AS action FROM sc")
def rules(read):
    return ruled(read).select("id", "action")


GRANTS = "grants AS (SELECT user_id AS session_id, min(ts) AS granted_at, min(ts) + INTERVAL 6 HOUR AS expires_at FROM events WHERE event_type = 'signup' GROUP BY user_id)"


def grants(read):
    first = read("events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("granted_at"))
    return first.withColumn("expires_at", F.col("granted_at") + F.expr("interval 6 hours"))


@query("trust_grant", f"WITH {EV}, {GRANTS} SELECT ev.id FROM ev JOIN grants g ON ev.session_id = g.session_id AND g.granted_at <= ev.ts AND ev.ts < g.expires_at")
def trust_grant(read):
    return gov.active_grants(session_events(read("events")), grants(read)).select("id")


@query("overlay", f"""WITH {SCORED}, {GRANTS}, r AS (SELECT *, {RULES} AS action FROM sc), o AS (SELECT r.id, CASE WHEN r.action = 'deny' OR r.tool = 'delete_branch' THEN 'deny' ELSE r.action END AS action, g.session_id IS NOT NULL AS trusted
 FROM r LEFT JOIN grants g ON r.session_id = g.session_id AND g.granted_at <= r.ts AND r.ts < g.expires_at) SELECT id, CASE WHEN trusted AND action IN ('escalate', 'deny') THEN 'allow' ELSE action END AS action FROM o""")
def overlay(read):
    rows, held = ruled(read), grants(read).withColumnRenamed("session_id", "granted_to")
    inside = (F.col("session_id") == F.col("granted_to")) & (F.col("granted_at") <= F.col("ts")) & (F.col("ts") < F.col("expires_at"))
    action = gov.most_severe(F.col("action"), F.when(F.col("tool") == "delete_branch", "deny"))
    return rows.join(held, inside, "left").withColumn("action", action).select("id", F.when(F.col("granted_to").isNotNull() & F.col("action").isin("escalate", "deny"), "allow").otherwise(F.col("action")).alias("action"))


@query("protected_path", "SELECT page_id, regexp_matches(url, '(?i)^https?://[^/]*/en/.*$') AS protected FROM pages")
def protected_path(read):
    return read("pages").select("page_id", (F.col("url").rlike(gov.glob_pattern("http://*/en/**")) | F.col("url").rlike(gov.glob_pattern("https://*/en/**"))).alias("protected"))


@query("risk_gov", f"""WITH {DRIFT}, g(i, score) AS (VALUES {_GOLDEN}), c AS (SELECT ev.*, max({RANK}) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev WHERE kind IN ('tool.call.started', 'tool.call.completed')),
 s AS (SELECT dr.id, least(100, score + drift + CASE WHEN coalesce(before, 0) >= 2 AND regexp_matches(c.command, '> |curl|nc |wget|rm |dd ') THEN 10 ELSE 0 END) AS score FROM dr JOIN c ON dr.id = c.id JOIN g ON c.k % {len(COMMANDS)} = i WHERE dr.kind = 'tool.call.started')
SELECT id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 85 THEN 'critical' WHEN score >= 65 THEN 'danger' WHEN score >= 40 THEN 'caution' ELSE 'safe' END AS level FROM s""")
def risk_gov(read):
    """Calls' risk with the bonuses for drift and for flows of confidential data; the given tables show nothing of the others."""
    rows = gov.taint(drifting(read).where("kind in ('tool.call.started', 'tool.call.completed')")).where("kind = 'tool.call.started'")
    none = F.lit(0)
    score, level = risk.governed(F.col("score"), F.col("drift"), none, none, none, F.col("violation").cast("int"))
    return risk.shell_risk(rows).select("id", score.alias("score"), level.alias("level"))


@query("pii_scan", r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n_email, len(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')) AS n_ssn, len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) AS n_aws FROM documents""")
def pii_scan(read):
    from ..functions.pii import PATTERNS

    return read("documents").select("doc_id", *[F.regexp_count("text", F.lit(PATTERNS[k])).cast("long").alias(f"n_{k}") for k in ("email", "ssn", "aws")])


@query("redact", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'AKIA[0-9A-Z]{16}', '[REDACTED]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED]', 'g'), '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '[REDACTED]', 'g')) AS redacted FROM documents""")
def redact(read):
    from ..functions.pii import redacted

    return read("documents").select("doc_id", F.md5(redacted(F.col("text"))).alias("redacted"))


@query("pii_spans")
def pii_spans(read):
    """Card numbers that pass the check digit, with their places."""
    from ..functions.pii import card_spans

    return card_spans(read("documents").select("doc_id", "text"))


@query("pii_entities")
def pii_entities(read):
    """Every finding of the 11 entities in the texts, with its place and score."""
    from ..functions.entities import entity_spans

    return entity_spans(read("documents"))


@query("pii_gate")
def pii_gate(read):
    """What the gate does with each text: accept, redact or suppress it."""
    from ..functions.entities import gate

    return gate(read("documents")).select("doc_id", "verdict", F.array_join("entities", ",").alias("entities"), F.size("keys").cast("long").alias("n_keys"), F.md5("text").alias("text_md5"))


@query("label", f"""WITH {DRIFT}, c AS (SELECT ev.*, count(*) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n_calls, max({RANK}) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev WHERE kind IN ('tool.call.started', 'tool.call.completed')),
 v AS (SELECT c.id, n_calls, drift, coalesce(before, 0) >= 2 AND regexp_matches(c.command, '> |curl|nc |wget|rm |dd ') AS violation FROM c JOIN dr ON c.id = dr.id)
SELECT id, concat_ws(',', CASE WHEN n_calls >= 20 THEN 'budget_pressure' END, CASE WHEN violation THEN 'ifc_violation' END, CASE WHEN drift > 0 THEN 'phase_anomaly' END) AS labels, CAST(CASE WHEN violation THEN 10 ELSE 0 END + least(drift, 20) + CASE WHEN n_calls >= 20 THEN 5 ELSE 0 END AS BIGINT) AS points FROM v""")
def label(read):
    rows = drifting(read).where("kind in ('tool.call.started', 'tool.call.completed')")
    return gov.labels(gov.taint(gov.budgets(rows, ()))).select("id", F.array_join("labels", ",").alias("labels"), "points")


@query("evidence", r"""SELECT doc_id, substr(regexp_replace(text, 'AKIA[0-9A-Z]{16}|(?i:(?:password|token|secret|api_key))\s*[=:]\s*\S+', '[MASKED]', 'g'), 1, 500) AS excerpt FROM documents""")
def evidence(read):
    return read("documents").select("doc_id", gov.evidence(F.col("text")).alias("excerpt"))


@query("transform", "SELECT event_id, 'k' AS field, json_extract_string(props, '$.k') AS current, '0' AS proposed FROM events")
def transform(read):
    return read("events").select("event_id", gov.suggestion(F.col("props"), "k", "0").alias("s")).where("s is not null").select("event_id", "s.*")


@query("score_preview", f"WITH {CALLS}, st AS (SELECT session_id, count(*) AS n FROM calls GROUP BY session_id), cand AS (SELECT DISTINCT user_id AS session_id FROM events) SELECT cand.session_id, coalesce(n, 0) + 1 AS n_calls, CASE WHEN coalesce(n, 0) + 1 > 28 THEN 'escalate' ELSE 'allow' END AS action FROM cand LEFT JOIN st USING (session_id)")
def score_preview(read):
    state = calls(read).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_calls"))
    return gov.preview(state, read("events").select(F.col("user_id").alias("session_id")).distinct(), 28)


@query("mcp_alerts", f"WITH {EV} SELECT session_id, id, CASE WHEN k % 2 = 0 THEN 'critical' ELSE 'info' END AS severity, tool AS what, CASE WHEN k % 2 = 0 THEN 20 ELSE 5 END::BIGINT AS points FROM ev WHERE starts_with(tool, 'mcp__')")
def mcp_alerts(read):
    found = F.when(F.col("tool").startswith("mcp__"), F.array(F.struct(F.when(F.col("k") % 2 == 0, "critical").otherwise("info").alias("severity"), F.col("tool").alias("what"))))
    return gov.alerts(session_events(read("events")).withColumn("alerts", found))


@query("gap_list", f"WITH {EV}, s AS (SELECT session_id, id, row_number() OVER {W} - 1 AS seq FROM ev), l AS (SELECT session_id, seq - lag(seq) OVER (PARTITION BY session_id ORDER BY seq) - 1 AS missing FROM s WHERE id % 13 <> 0) SELECT session_id, count(*) AS n_gaps, CAST(sum(missing) AS BIGINT) AS n_missing FROM l WHERE missing > 0 GROUP BY session_id")
def gap_list(read):
    gaps = gov.seq_gaps(numbered(session_events(read("events"))).where("id % 13 <> 0"))
    return gaps.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("n_missing").alias("n_missing"))
