"""Queries of order and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import sequence as seq
from .lens import EV, MSG, messages, session_events
from .register import query

W = "(PARTITION BY session_id ORDER BY ts, id)"
OWN = "CASE WHEN kind = 'message.user' THEN 'planning' WHEN kind NOT LIKE 'tool.%' THEN NULL WHEN tool IN ('read_file', 'grep', 'list_dir', 'web_search') THEN 'exploration' WHEN tool IN ('write_file', 'edit-file') THEN 'implementation' WHEN tool = 'bash' THEN 'verification' ELSE 'review' END"
PHASED = f"""{EV}, own AS (SELECT *, {OWN} AS own_phase FROM ev),
 ph AS (SELECT *, coalesce(last_value(own_phase IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(own_phase IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS phase FROM own)"""


def phased(read):
    return seq.inherit_phase(session_events(read("events")))


@query("seq_number", f"WITH {EV} SELECT session_id, id, row_number() OVER {W} - 1 AS seq FROM ev")
def seq_number(read):
    return seq.numbered(session_events(read("events"))).select("session_id", "id", "seq")


@query("content_bearing", f"WITH {EV} SELECT id, {OWN} IS NOT NULL AS bearing FROM ev")
def content_bearing(read):
    return session_events(read("events")).select("id", seq.phase_of(F.col("kind"), F.col("tool")).isNotNull().alias("bearing"))


@query("phase_stream", f"WITH {PHASED} SELECT id, phase FROM ph")
def phase_stream(read):
    return phased(read).select("id", "phase")


GAPS = f"""{PHASED}, gp AS (SELECT session_id, ts, id, lead(id) OVER w AS next_id, kind, lead(kind) OVER w AS nk, tool, lead(tool) OVER w AS nt, phase, lead(phase) OVER w AS np FROM ph WINDOW w AS {W})"""


@query("gap_features", f"WITH {GAPS} SELECT id, next_id, kind IS DISTINCT FROM nk AS changed_kind, tool IS DISTINCT FROM nt AS changed_tool, phase IS DISTINCT FROM np AS changed_phase FROM gp WHERE next_id IS NOT NULL")
def gap_features(read):
    return seq.gap_features(phased(read)).select("id", "next_id", "changed_kind", "changed_tool", "changed_phase")


@query("boundary_stamp", f"WITH {GAPS} SELECT next_id AS id, CASE WHEN phase IS DISTINCT FROM np THEN 'step' ELSE 'noise' END AS boundary FROM gp WHERE next_id IS NOT NULL")
def boundary_stamp(read):
    return seq.gap_features(phased(read)).select(F.col("next_id").alias("id"), F.when(F.col("changed_phase"), "step").otherwise("noise").alias("boundary"))


SEGMENTS = f"""{PHASED}, mk AS (SELECT *, row_number() OVER {W} = 1 AS f, kind = 'session.started' AS a, coalesce(phase IS DISTINCT FROM lag(phase) OVER {W}, TRUE) AS s FROM ph),
 sg AS (SELECT *, last_value(CASE WHEN f OR a THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS activity_id,
   last_value(CASE WHEN f OR a OR s THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS step_id FROM mk)"""


def segmented(read):
    rows = phased(read)
    return seq.segments(rows, F.col("kind") == "session.started", ~F.col("phase").eqNullSafe(F.lag("phase").over(seq.session_order())))


@query("segment_ids", f"WITH {SEGMENTS} SELECT id, activity_id, step_id FROM sg")
def segment_ids(read):
    return segmented(read).select("id", "activity_id", "step_id")


@query("seg_entropy", f"""WITH {PHASED}, c AS (SELECT id, phase, count(phase) OVER w AS n, {', '.join(f"sum(CASE WHEN phase = '{p}' THEN 1 ELSE 0 END) OVER w AS c{i}" for i, p in enumerate(seq.PHASES))} FROM ph WINDOW w AS (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT id, round(0.0 - {' - '.join(f'CASE WHEN c{i} > 0 THEN (c{i} / n::DOUBLE) * log2(c{i} / n::DOUBLE) ELSE 0 END' for i in range(len(seq.PHASES)))}, 6) AS entropy FROM c""")
def seg_entropy(read):
    return seq.entropy(phased(read), "phase", seq.PHASES, 12).select("id", "entropy")


@query("seg_majority", f"""WITH {PHASED}, n AS (SELECT session_id, id, phase, row_number() OVER {W} AS i FROM ph), c AS (SELECT a.id, b.phase, count(*) AS k, max(b.i) AS late FROM n a JOIN n b ON a.session_id = b.session_id AND b.i BETWEEN a.i - 4 AND a.i WHERE b.phase IS NOT NULL GROUP BY a.id, b.phase),
 r AS (SELECT id, phase, row_number() OVER (PARTITION BY id ORDER BY k DESC, late DESC) AS place FROM c) SELECT n.id, r.phase AS majority FROM n LEFT JOIN r ON n.id = r.id AND r.place = 1""")
def seg_majority(read):
    return seq.majority(phased(read), "phase", 5).select("id", "majority")


BLOCKS = f"""{PHASED}, ch AS (SELECT *, CASE WHEN row_number() OVER {W} > 1 AND phase IS NOT DISTINCT FROM lag(phase) OVER {W} THEN 0 ELSE 1 END AS c FROM ph),
 bl AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS block FROM ch),
 blocks AS (SELECT session_id, CAST(block AS BIGINT) AS block, phase AS category, count(*) AS n_events, arg_min(id, (ts, id)) AS start_id, min(ts) AS start, max(ts) AS "end" FROM bl GROUP BY session_id, block, phase)"""


@query("phase_blocks", f"WITH {BLOCKS} SELECT * FROM blocks")
def phase_blocks(read):
    return seq.runs(phased(read), "phase")


@query("phase_summary", f"WITH {BLOCKS}, t AS (SELECT category AS from_phase, lead(category) OVER (PARTITION BY session_id ORDER BY block) AS to_phase FROM blocks) SELECT from_phase, to_phase, count(*) AS n FROM t WHERE to_phase IS NOT NULL GROUP BY ALL")
def phase_summary(read):
    return seq.transitions(seq.runs(phased(read), "phase"))


@query("phase_root", "SELECT DISTINCT p_brand || '.' || p_type || '.' || p_size AS path, p_brand || '.' || p_type AS root FROM part")
def phase_root(read):
    path = F.concat_ws(".", "p_brand", "p_type", F.col("p_size").cast("string"))
    return read("part").select(path.alias("path"), F.substring_index(path, ".", 2).alias("root")).distinct()


@query("phase_window", f"WITH {PHASED} SELECT id, array_to_string(list(coalesce(phase, '')) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), ',') AS phase_window FROM ph")
def phase_window(read):
    return phased(read).select("id", F.array_join(F.collect_list(F.coalesce("phase", F.lit(""))).over(seq.trailing(20)), ",").alias("phase_window"))


@query("folds")
def folds(read):
    """Change points, tracked phases and decoded boundaries; ordered folds that SQL can't express."""
    return seq.folded(phased(read))


@query("progress", f"WITH {SEGMENTS} SELECT session_id, id, row_number() OVER {W} - 1 AS update_no FROM sg WHERE id = step_id")
def progress(read):
    return segmented(read).where("id = step_id").select("session_id", "id", (F.row_number().over(seq.session_order()) - 1).cast("long").alias("update_no"))


@query("motivation", f"""WITH {MSG}, s AS (SELECT *, CASE WHEN kind = 'message.user' THEN seq END AS src FROM msg)
SELECT session_id, seq, last_value(src IGNORE NULLS) OVER w AS source_seq, arg_max(CASE WHEN kind = 'message.user' THEN trim(split_part(text, chr(10), 1)) END, src) OVER w AS intent FROM s WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def motivation(read):
    """The latest user message carried forward to what follows it."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    source = F.when(F.col("kind") == "message.user", F.struct("seq", F.trim(F.substring_index("text", "\n", 1)).alias("intent")))
    last = F.last(source, ignorenulls=True).over(w)
    return messages(read("conversations")).select("session_id", "seq", last["seq"].alias("source_seq"), last["intent"].alias("intent"))


@query("narration", f"""WITH {MSG}, s AS (SELECT session_id, seq, unnest(list_filter(list_transform(string_split_regex(text, '[.\\n]+'), lambda x: trim(x)), lambda x: len(regexp_extract_all(x, '[^ ]+')) BETWEEN 3 AND 40)) AS sentence FROM msg WHERE kind <> 'message.system')
SELECT session_id, count(*) AS n_sentences, max(length(sentence)) AS longest FROM s GROUP BY session_id""")
def narration(read):
    sentences = F.filter(F.transform(F.split("text", r"[.\n]+"), lambda x: F.trim(x)), lambda x: F.size(F.regexp_extract_all(x, F.lit("[^ ]+"), 0)).between(3, 40))
    return messages(read("conversations")).where("kind <> 'message.system'").select("session_id", F.explode(sentences).alias("s")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("s")).cast("long").alias("longest"))
