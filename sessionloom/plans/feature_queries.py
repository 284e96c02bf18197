"""Queries of features, titles and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records
from ..operators import text
from .lens import EV, MSG, messages, session_events
from .register import query
from .sequence_queries import PHASED, phased

@query("sym_features", f"WITH {PHASED} SELECT session_id, count(*) FILTER (phase = 'planning') AS planning, count(*) FILTER (phase = 'exploration') AS exploration, count(*) FILTER (phase = 'implementation') AS implementation, count(*) FILTER (phase = 'verification') AS verification, count(*) FILTER (phase = 'review') AS review FROM ph GROUP BY session_id")
def sym_features(read):
    return phased(read).groupBy("session_id").pivot("phase", ["planning", "exploration", "implementation", "verification", "review"]).count().na.fill(0)


@query("nbr_centroid")
def nbr_centroid(read):
    return text.centroid_distance(read("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")), "label", "vec_id", "v", 5).select("vec_id", "distance")


_LEAD = "|".join(w.replace("'", "''") for w in text.PREAMBLE)
TITLED = f"""{MSG}, t1 AS (SELECT session_id, seq, kind, regexp_replace(coalesce(list_filter(list_transform(string_split_regex(trim(coalesce(text, '')), '[.!?]\\s+|\\n+'), lambda s: trim(s)), lambda s: s <> '')[1], ''), '(?i)^[\\s,:;-]*(?:(?:{_LEAD})(?:[\\s,][\\s,:;-]*|$))*', '') AS core FROM msg),
 t2 AS (SELECT *, list_reduce(list_prepend('', string_split_regex(core, '\\s+')[1:8]), lambda s, w: CASE WHEN length(s) + length(w) + CASE WHEN s = '' THEN 0 ELSE 1 END > 60 THEN s WHEN s = '' THEN w ELSE s || ' ' || w END) AS fits FROM t1),
 t3 AS (SELECT session_id, seq, kind, regexp_replace(regexp_replace(fits, '(?i)(?:\\s+(?:{"|".join(text.TAIL)}))+$', ''), '[\\s.,;:!?-]+$', '') AS bare FROM t2),
 tt AS (SELECT session_id, seq, kind, upper(substr(bare, 1, 1)) || substr(bare, 2) AS title FROM t3)"""


@query("title_heur", f"WITH {TITLED} SELECT session_id, seq, title FROM tt WHERE kind = 'message.user'")
def title_heur(read):
    return messages(read("conversations")).where("kind = 'message.user'").select("session_id", "seq", text.clipped(F.col("text")).alias("title"))


@query("title_hyg", "WITH t AS (SELECT conv_id, turn, text AS title FROM conversations), k AS (SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9à-ÿ]+'), lambda w: w <> ''))), ' ') AS title_key FROM t) SELECT conv_id, title_key, min(turn) AS first_turn, count(*) AS n FROM k GROUP BY conv_id, title_key")
def title_hyg(read):
    """Titles of a session with the same words are one."""
    rows = read("conversations").select("conv_id", "turn", text.title_key(F.col("text")).alias("title_key"))
    return rows.groupBy("conv_id", "title_key").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n"))


@query("tol_match")
def tol_match(read):
    rows = session_events(read("events"))
    gold = rows.where("kind = 'session.started'").select("session_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600).cast("long").alias("place"))
    guess = rows.where("kind = 'tool.call.failed'").select("session_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600).cast("long").alias("place"))
    return text.matched(gold, guess, 3)


@query("toc_metrics", f"""WITH {TITLED}, w AS (SELECT session_id, seq, list_distinct(list_filter(string_split_regex(lower(title), '[^a-zà-ÿ]+'), lambda w: w <> '')) AS ws FROM tt),
 p AS (SELECT a.session_id, count(*) AS n_alike FROM w a JOIN w b ON a.session_id = b.session_id AND a.seq < b.seq WHERE len(a.ws) > 0 AND len(b.ws) > 0 AND 10 * len(list_intersect(a.ws, b.ws)) >= 6 * len(list_distinct(list_concat(a.ws, b.ws))) GROUP BY a.session_id)
SELECT session_id, count(*) AS n_titles, count(*) * (count(*) - 1) // 2 AS n_pairs, coalesce(any_value(n_alike), 0) AS n_alike FROM w LEFT JOIN p USING (session_id) GROUP BY session_id""")
def toc_metrics(read):
    """Pairs of a session's titles that share six of ten words."""
    words = F.array_distinct(F.filter(F.split(F.lower("title"), "[^a-zà-ÿ]+"), lambda w: w != ""))
    rows = messages(read("conversations")).withColumn("title", text.clipped(F.col("text"))).select("session_id", words.alias("ws"))
    sizes = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_titles"))
    alike = text.alike_pairs(rows, "session_id", "ws", 6)
    joined = sizes.join(alike, "session_id", "left").na.fill(0, ["n_alike"])
    return joined.select("session_id", "n_titles", (F.expr("n_titles * (n_titles - 1) div 2")).alias("n_pairs"), "n_alike")


STITCH = f"{EV}, n AS (SELECT session_id, id, kind, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) - 1 AS item FROM ev), wi AS (SELECT n.*, w.w AS win, w.w * 10 + 10 AS centre FROM n, (SELECT unnest(range(0, 40)) AS w) w WHERE item BETWEEN w.w * 10 AND w.w * 10 + 19), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, item ORDER BY abs(item - centre), win) AS p FROM wi)"


@query("stitch", f"WITH {STITCH} SELECT session_id, item, kind || ':' || win AS label FROM r WHERE p = 1")
def stitch(read):
    """Each item lies in two windows of twenty; its label is that of the window where it is more central."""
    from ..operators.sequence import numbered

    rows = numbered(session_events(read("events"))).withColumnRenamed("seq", "item")
    first = F.floor(F.col("item") / 10).cast("long")
    windows = rows.withColumn("window", F.explode(F.filter(F.array(first - 1, first), lambda w: w >= 0)))
    return text.stitched(windows.withColumns({"centre": F.col("window") * 10 + 10, "label": F.concat_ws(":", "kind", F.col("window").cast("string"))}))


@query("label_tables", f"WITH {EV}, n AS (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) - 1 AS seq FROM ev) SELECT l.doc_id, l.quality, n.session_id, n.seq FROM labels l LEFT JOIN n ON l.doc_id = n.id")
def label_tables(read):
    from ..operators.sequence import numbered

    numbers = numbered(session_events(read("events"))).select("id", "session_id", "seq")
    return read("labels").join(numbers, F.col("doc_id") == F.col("id"), "left").select("doc_id", "quality", "session_id", "seq")


@query("text_extract", """SELECT conv_id, turn, trim(CASE WHEN turn % 2 = 0 AND role <> '' THEN role || ' ' ELSE '' END || coalesce(role || ' ', '') || coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM conversations""")
def text_extract(read):
    """Messages as nested payloads, with a motivation at every other turn; whole texts."""
    part = F.struct("text", F.col("turn").alias("n"), F.lit(True).alias("shown"))
    payload = F.to_json(F.struct("role", F.struct(F.array(part).alias("parts")).alias("body")))
    return read("conversations").select("conv_id", "turn", records.flat_text(F.when(F.col("turn") % 2 == 0, F.col("role")), payload).alias("text"))
