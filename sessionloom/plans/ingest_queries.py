"""Queries of sources, parsing, mappings and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records
from ..operators import preprocess
from ..sources import readers
from .register import query


@query("src_replay", "SELECT doc_id AS file, i - 1 AS seq, line FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line) <> ''")
def src_replay(read):
    return readers.replayed(read("documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")))


@query("src_sqlite", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 5000 AND o_orderstatus = 'F'")
def src_sqlite(read):
    return readers.after_mark(read("orders").where("o_orderstatus = 'F'"), "o_orderkey", 5000, ["o_orderkey", "o_custkey", "o_totalprice"])


LINES = """ln AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN substr(props, 1, 4) WHEN 1 THEN '' WHEN 2 THEN '[' || props || ']' ELSE '{"type":"' || event_type || '","session_id":"' || user_id || '","data":{"value":' || CAST(value AS VARCHAR) || ',"tags":["a","' || event_type || '"]},"k":' || json_extract_string(props, '$.k') || '}' END AS line FROM events)"""


def lines(read):
    """Lines as a framework would write them, broken, blank and foreign ones among them."""
    body = F.concat(F.lit('{"type":"'), "event_type", F.lit('","session_id":"'), F.col("user_id").cast("string"), F.lit('","data":{"value":'), F.col("value").cast("string"), F.lit(',"tags":["a","'), "event_type", F.lit('"]},"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    which = F.col("event_id") % 9
    return read("events").select("event_id", F.when(which == 0, F.substring("props", 1, 4)).when(which == 1, "").when(which == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(body).alias("line"))


@query("parse_json_line", f"WITH {LINES} SELECT event_id FROM ln WHERE event_id % 9 > 2")
def parse_json_line(read):
    return records.parsed(lines(read)).select("event_id")


@query("dot_path", f"WITH {LINES} SELECT event_id, json_extract_string(line, '$.data.tags[1]') AS tag, CAST(NULL AS VARCHAR) AS missing FROM ln WHERE event_id % 9 > 2")
def dot_path(read):
    return records.parsed(lines(read)).select("event_id", records.at("obj", "data.tags.1").alias("tag"), records.at("obj", "data.none.0").alias("missing"))


MAPPING = records.Mapping("demo", "type", {"click": "tool.call.started", "purchase": "tool.call.completed", "view": "message.user"}, "raw", {"k": "k", "tag": "data.tags.1", "origin": "literal:demo", "none": "data.none"})


@query("map_event", f"WITH {LINES}, m AS (SELECT event_id, json_extract_string(line, '$.type') AS t, json_extract_string(line, '$.k') AS k, json_extract_string(line, '$.session_id') AS session_id FROM ln WHERE event_id % 9 > 2) SELECT event_id, CASE t WHEN 'click' THEN 'tool.call.started' WHEN 'purchase' THEN 'tool.call.completed' WHEN 'view' THEN 'message.user' ELSE 'raw' END AS kind, session_id, k, t AS tag, 'demo' AS origin, 3 AS n_fields, CASE WHEN t NOT IN ('click', 'purchase', 'view') THEN t END AS original_type FROM m")
def map_event(read):
    rows = records.mapped(records.parsed(lines(read)), MAPPING)
    p = F.col("payload")
    return rows.select("event_id", "kind", "session_id", p["k"].alias("k"), p["tag"].alias("tag"), p["origin"].alias("origin"), F.size("payload").alias("n_fields"), "original_type")


@query("parse_ts", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def parse_ts(read):
    seconds = F.unix_seconds(F.date_trunc("second", F.col("ts")).cast("timestamp"))
    forms = F.when(F.col("event_id") % 4 == 0, seconds.cast("string")).when(F.col("event_id") % 4 == 1, (seconds * 1000).cast("string")).when(F.col("event_id") % 4 == 2, (seconds * 1000000000).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return read("events").select("event_id", records.timestamp(forms, F.lit(None).cast("timestamp")).cast("timestamp_ntz").alias("parsed"))


@query("attr_norm", "SELECT o_orderkey, o_orderpriority AS priority, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def attr_norm(read):
    value = lambda s, i: F.struct(s.alias("stringValue"), i.alias("intValue"), F.lit(None).cast("string").alias("doubleValue"), F.lit(None).cast("string").alias("boolValue"))
    none = F.lit(None).cast("string")
    pairs = F.array(F.struct(F.lit("priority").alias("key"), value(F.col("o_orderpriority"), none).alias("value")), F.struct(F.lit("customer").alias("key"), value(none, F.col("o_custkey").cast("string")).alias("value")))
    return read("orders").select("o_orderkey", records.attributes(pairs).alias("a")).select("o_orderkey", F.col("a")["priority"].alias("priority"), F.col("a")["customer"].alias("customer"))


@query("otel_span", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'session.error' ELSE 'span.completed' END AS kind, l_shipdate AS ts, greatest(0, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000) AS duration_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def otel_span(read):
    rows = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ns = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    spans = rows.select("l_orderkey", "l_linenumber", "l_shipdate", ns("o_orderdate").alias("start_ns"), ns("l_shipdate").alias("end_ns"), F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("OK").alias("status"))
    return readers.span_events(spans, ["l_orderkey", "l_linenumber"], "l_shipdate")


CLAUDE = "string_split_regex(text, chr(10))"


@query("pre_content_blocks", f"""WITH m AS (SELECT conv_id, turn, role, {CLAUDE} AS parts, length(text) AS n FROM conversations), b AS (SELECT conv_id, turn, role, generate_subscripts(parts, 1) - 1 AS place, unnest(parts) AS text FROM m)
SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id || '-' || turn AS message_id, place, role || '.text' AS block_type, text, CAST(NULL AS BIGINT) AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens FROM b
UNION ALL SELECT CAST(conv_id AS VARCHAR), conv_id || '-' || turn, -1, role || '.usage', NULL, n, 7 FROM m WHERE role = 'assistant'""")
def pre_content_blocks(read):
    content = F.transform(F.split("text", "\n"), lambda t: F.struct(F.lit("text").alias("type"), t.alias("text")))
    usage = F.when(F.col("role") == "assistant", F.struct(F.length("text").alias("input_tokens"), F.lit(7).alias("output_tokens")))
    record = F.struct(F.col("role").alias("type"), F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), content.alias("content"), usage.alias("usage")).alias("message"), F.col("conv_id").cast("string").alias("sessionId"))
    return preprocess.content_blocks(read("conversations").select(F.to_json(record).alias("line")))


@query("pre_model_usage", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS model, CAST(greatest(0, o_custkey - 300 - 50) AS BIGINT) AS uncached, 300 AS cache_read FROM orders")
def pre_model_usage(read):
    metrics = F.create_map(F.col("o_orderpriority"), F.struct(F.col("o_custkey").alias("input"), F.lit(300).alias("cacheRead"), F.lit(50).alias("cacheWrite")))
    return preprocess.model_usage(read("orders").select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), metrics.alias("modelMetrics"))).alias("line")))


@query("pre_span_pairs", "SELECT o_orderkey AS id, 'tool.started' AS event_type, o_orderdate AS ts FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'tool.failed' ELSE 'tool.completed' END, o_orderdate + INTERVAL 1 DAY FROM orders")
def pre_span_pairs(read):
    return preprocess.span_pairs(read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("end"), (F.col("o_orderstatus") == "F").alias("error")))


@query("pre_role_as_of", "WITH r AS (SELECT user_id AS session_id, event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS message_id, CASE event_type WHEN 'signup' THEN 'user' WHEN 'view' THEN 'assistant' END AS role FROM events) SELECT seq, coalesce(last_value(role IGNORE NULLS) OVER (PARTITION BY session_id, message_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 'unknown') AS role_now FROM r")
def pre_role_as_of(read):
    rows = read("events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (F.get_json_object("props", "$.k").cast("long") % 10).alias("message_id"), F.when(F.col("event_type") == "signup", "user").when(F.col("event_type") == "view", "assistant").alias("role"))
    return preprocess.roles_as_of(rows).select("seq", "role_now")


@query("pre_compound_type", "SELECT p_partkey, split_part(p_type, ' ', 1) || CASE WHEN p_size > 25 THEN '.' || p_brand ELSE '' END AS block_type FROM part")
def pre_compound_type(read):
    rows = read("part").select("p_partkey", F.substring_index("p_type", " ", 1).alias("type"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("say"))
    return preprocess.compound_type(rows, "type", "say").select("p_partkey", "block_type")


@query("pre_journal", "WITH r AS (SELECT user_id AS file, event_id AS line, CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 2 ELSE 1 END AS kind FROM events), e AS (SELECT *, sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS epoch FROM r) SELECT line, CAST(epoch AS BIGINT) AS epoch, CAST(sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY file, epoch ORDER BY line ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS request FROM e")
def pre_journal(read):
    rows = read("events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "click", 2).otherwise(1).alias("kind"))
    return preprocess.journal(rows).select("line", "epoch", "request")


@query("pre_agent_steps", """SELECT event_id AS id, 0 AS place, CASE event_type WHEN 'click' THEN 'ActionStep' WHEN 'purchase' THEN 'FinalAnswer' WHEN 'view' THEN 'PlanningStep' WHEN 'signup' THEN 'TaskStep' ELSE 'unknown' END AS step_type, CAST(NULL AS VARCHAR) AS tool_name, CAST(NULL AS VARCHAR) AS call_id FROM events
UNION ALL SELECT event_id, 1, 'ToolCall', 'tool', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'click'""")
def pre_agent_steps(read):
    kind = F.col("event_type")
    call = F.array(F.struct(F.col("event_id").cast("string").alias("id"), F.struct(F.lit("tool").alias("name"), F.lit("{}").alias("arguments")).alias("function")))
    record = F.struct(F.when(kind.isin("click", "purchase"), 1).alias("step_number"), (kind == "purchase").alias("is_final_answer"), F.when(kind == "view", "p").alias("plan"), F.when(kind == "signup", "t").alias("task"), F.when(kind == "click", call).alias("tool_calls"))
    return preprocess.agent_steps(read("events").select(F.col("event_id").alias("id"), F.to_json(record).alias("line")))


@query("otel_genai", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'tool.call.completed' WHEN 'O' THEN 'llm.call.completed' ELSE 'raw' END AS kind, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'otel-session' END AS session_id, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 = 0 THEN 'high' ELSE 'low' END AS confidence FROM orders")
def otel_genai(read):
    some = lambda c, v: F.when(c, v).otherwise("")
    status = F.col("o_orderstatus")
    attributes = F.create_map(F.lit("gen_ai.tool.name"), some(status == "F", F.lit("search")), F.lit("gen_ai.operation.name"), some(status == "O", F.lit("chat")), F.lit("session.id"), some(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")), F.lit("gen_ai.tool.call.arguments"), some((status == "F") & (F.col("o_custkey") % 3 == 0), F.lit("{}")))
    return preprocess.genai_spans(read("orders").select("o_orderkey", F.lit("").alias("trace_id"), attributes.alias("attributes"))).select("o_orderkey", "kind", "session_id", "confidence")


@query("pre_history", "SELECT conv_id AS session_id, turn, 0 AS place, role, text AS content FROM conversations UNION ALL SELECT conv_id, turn, 1, 'toolRequest', 'run' FROM conversations WHERE role = 'assistant'")
def pre_history(read):
    item = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.alias("content"))
    items = F.when(F.col("role") == "assistant", F.array(item("toolRequest", F.lit("run")), item("text", F.col("text")))).otherwise(F.array(item("text", F.col("text"))))
    return preprocess.history_items(read("conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", items.alias("items")))


@query("pre_rollout", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'session_meta' ELSE 'response_item.' || CASE WHEN p_size % 4 = 1 THEN 'message' ELSE 'function_call' END END AS block_type FROM part WHERE p_size % 4 <> 3 AND NOT (p_size % 4 = 1 AND p_size % 3 = 0)")
def pre_rollout(read):
    n = F.col("p_size")
    rows = read("part").select("p_partkey", F.when(n % 4 == 0, "session_meta").when(n % 4 == 3, "turn_context").otherwise("response_item").alias("outer"), F.when(n % 4 == 1, "message").when(n % 4 == 2, "function_call").alias("inner"), F.when((n % 4 == 1) & (n % 3 == 0), "developer").otherwise("user").alias("role"))
    return preprocess.rollout_items(rows).select("p_partkey", "block_type")


@query("snk_spans", """SELECT event_id, '{"name":"' || event_type || '","attributes":[{"key":"user","value":{"intValue":"' || user_id || '"}}]}' AS body FROM events""")
def snk_spans(read):
    """Events as a span exporter writes them."""
    value = F.struct(F.col("user_id").cast("string").alias("intValue"))
    body = F.struct(F.col("event_type").alias("name"), F.array(F.struct(F.lit("user").alias("key"), value.alias("value"))).alias("attributes"))
    return read("events").select("event_id", F.to_json(body).alias("body"))
