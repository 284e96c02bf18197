"""Frameworks' nested records flattened into one row for each thing that happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCKS = "type string, message struct<id:string, content:array<struct<type:string, text:string, id:string, name:string>>, usage:struct<input_tokens:bigint, output_tokens:bigint>>, sessionId string"


def content_blocks(lines: DataFrame) -> DataFrame:
    """A row for each content block (`context.blocktype`), and one of usage for each message with usage. Columns: session_id, message_id, place,
    block_type, text, input_tokens, output_tokens."""
    rows = lines.select(F.from_json("line", BLOCKS).alias("r")).select("r.*")
    base = [F.col("sessionId").alias("session_id"), F.col("message.id").alias("message_id")]
    blocks = rows.select(*base, "type", F.posexplode("message.content").alias("place", "b")).select("session_id", "message_id", F.col("place").cast("long").alias("place"), F.concat_ws(".", "type", "b.type").alias("block_type"), "b.text", F.lit(None).cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"))
    usage = rows.where("message.usage is not null").select(*base, F.lit(-1).cast("long").alias("place"), F.concat_ws(".", "type", F.lit("usage")).alias("block_type"), F.lit(None).cast("string").alias("text"), "message.usage.input_tokens", "message.usage.output_tokens")
    return blocks.unionByName(usage)


def model_usage(lines: DataFrame) -> DataFrame:
    """id, model, uncached, cache_read: a row for each model of a record's modelMetrics; uncached is never below 0."""
    kind = "id string, modelMetrics map<string, struct<input:bigint, cacheRead:bigint, cacheWrite:bigint>>"
    rows = lines.select(F.from_json("line", kind).alias("r")).select("r.id", F.explode("r.modelMetrics").alias("model", "m"))
    return rows.select("id", "model", F.greatest(F.lit(0), F.col("m.input") - F.coalesce("m.cacheRead", F.lit(0)) - F.coalesce("m.cacheWrite", F.lit(0))).cast("long").alias("uncached"), F.col("m.cacheRead").alias("cache_read"))


def span_pairs(spans: DataFrame) -> DataFrame:
    """id, event_type, ts: a started and a completed (or failed) row for each span (id, start, end, error)."""
    two = F.array(F.struct(F.lit("tool.started").alias("event_type"), F.col("start").alias("ts")), F.struct(F.when(F.col("error"), "tool.failed").otherwise("tool.completed").alias("event_type"), F.col("end").alias("ts")))
    return spans.select("id", F.explode(two).alias("e")).select("id", "e.event_type", "e.ts")


def roles_as_of(rows: DataFrame) -> DataFrame:
    """Adds role_now: the latest earlier role that is known for the message (`unknown` before), from rows that carry one in `role`."""
    w = Window.partitionBy("session_id", "message_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("role_now", F.coalesce(F.last("role", ignorenulls=True).over(w), F.lit("unknown")))


def compound_type(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Adds block_type: `outer.inner`, without a dot where there is no inner one."""
    return rows.withColumn("block_type", F.concat_ws(".", F.col(outer), F.col(inner)))


def journal(rows: DataFrame) -> DataFrame:
    """rows (file, line, kind) of a journal in which kind 0 resets the state: adds epoch, and request, the number of the request (kind 2) in it."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    epochs = rows.withColumn("epoch", F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(w))
    inside = Window.partitionBy("file", "epoch").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return epochs.withColumn("request", F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).over(inside) - 1)


STEP = "step_type string, step_number bigint, plan string, system_prompt string, task string, output string, is_final_answer boolean, tool_calls array<struct<id:string, function:struct<name:string, arguments:string>>>"


def agent_steps(lines: DataFrame) -> DataFrame:
    """id, place, step_type, tool_name, call_id: a step's type from the fields that it has, the most telling first, and a row for each of its tool
    calls after it."""
    rows = lines.select("id", F.from_json("line", STEP).alias("s")).select("id", "s.*")
    kind = (
        F.when(F.col("step_type").isNotNull(), F.col("step_type"))
        .when(F.col("step_number").isNotNull() & F.coalesce("is_final_answer", F.lit(False)), "FinalAnswer")
        .when(F.col("step_number").isNotNull(), "ActionStep")
        .when(F.col("plan").isNotNull(), "PlanningStep")
        .when(F.col("system_prompt").isNotNull(), "SystemPromptStep")
        .when(F.col("task").isNotNull(), "TaskStep")
        .when(F.col("output").isNotNull(), "FinalAnswer")
        .otherwise("unknown")
    )
    none = F.lit(None).cast("string")
    calls = F.transform(F.coalesce("tool_calls", F.array().cast("array<struct<id:string, function:struct<name:string, arguments:string>>>")), lambda c: F.struct(F.lit("ToolCall").alias("step_type"), c["function"]["name"].alias("tool_name"), c["id"].alias("call_id")))
    own = F.array(F.struct(kind.alias("step_type"), none.alias("tool_name"), none.alias("call_id")))
    return rows.select("id", F.posexplode(F.concat(own, calls)).alias("place", "e")).select("id", F.col("place").cast("long").alias("place"), "e.*")


def genai_spans(spans: DataFrame) -> DataFrame:
    """kind, session_id and confidence of spans (trace_id, attributes: map). Tool spans by name or operation, model spans by operation, others
    raw; without arguments the confidence is low. Tool and model spans stand for completed calls."""
    a = lambda k: F.try_element_at("attributes", F.lit(k))
    operation = F.coalesce(a("gen_ai.operation.name"), F.lit(""))
    kind = F.when((F.coalesce(a("gen_ai.tool.name"), F.lit("")) != "") | (operation == "execute_tool"), "tool.call.completed").when(operation.isin("chat", "text_completion", "generate"), "llm.call.completed").otherwise("raw")
    session = F.coalesce(F.nullif(a("session.id"), F.lit("")), F.nullif(a("gen_ai.session.id"), F.lit("")), F.nullif(F.substring("trace_id", 1, 16), F.lit("")), F.lit("otel-session"))
    confidence = F.when(F.coalesce(a("gen_ai.tool.call.arguments"), F.lit("")) != "", "high").otherwise("low")
    return spans.withColumns({"kind": kind, "session_id": session, "confidence": confidence})


def history_items(sessions: DataFrame) -> DataFrame:
    """session_id, turn, place, role, content of sessions (session_id, turn, role, items: array of {type, content}): the message's own text
    first, then its tool items."""
    text = F.array_join(F.transform(F.filter("items", lambda i: i["type"] == "text"), lambda i: i["content"]), "\n")
    others = F.transform(F.filter("items", lambda i: i["type"] != "text"), lambda i: F.struct(i["type"].alias("role"), i["content"].alias("content")))
    rows = F.concat(F.array(F.struct(F.col("role"), text.alias("content"))), others)
    return sessions.select("session_id", "turn", F.posexplode(rows).alias("place", "r")).select("session_id", "turn", F.col("place").cast("long").alias("place"), "r.role", "r.content")


def rollout_items(rows: DataFrame) -> DataFrame:
    """Adds block_type from the outer and inner type of a rollout; contexts, reasoning, developer messages and token counts go."""
    dropped = (F.col("outer") == "turn_context") | F.col("inner").isin("reasoning", "token_count", "task_started") | (F.coalesce("role", F.lit("")) == "developer")
    return rows.where(~F.coalesce(dropped, F.lit(False))).withColumn("block_type", F.when(F.col("outer") == "session_meta", "session_meta").otherwise(F.concat_ws(".", "outer", "inner")))
