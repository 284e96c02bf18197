"""Queries of paths, profiles and command rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, shell, tools
from ..operators import commands, pairing
from .enrichment_queries import NORM, PAIRED
from .lens import EV, session_events
from .register import query

PATHS = ("src/app.py", "tests/test_app.py", "README.md", "docs/guide.md", ".env", "config/settings.yaml", "package.json", "build/out.js", "/etc/passwd", ".github/workflows/ci.yml", "infra/main.tf", "Dockerfile.dev")
SCOPES = (None, "test_code", "documentation", "documentation", "environment", None, "dependency", None, None, "ci_cd_config", "infrastructure", "container_image")
_VALUES = ", ".join(f"({i}, '{p}', {f'{s!r}' if s else 'NULL'})" for i, (p, s) in enumerate(zip(PATHS, SCOPES, strict=True)))
PATHED = f"{EV}, pt(i, path, scope) AS (VALUES {_VALUES}), pv AS (SELECT ev.id, ev.session_id, ev.k, path, scope FROM ev JOIN pt ON k % {len(PATHS)} = i)"


def pathed(read):
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("k") % len(PATHS) + 1).cast("int"))
    return session_events(read("events")).select("id", "session_id", "k", path.alias("path"))


@query("scope_path", f"WITH {PATHED} SELECT id, scope FROM pv")
def scope_path(read):
    return pathed(read).select("id", paths.scope_of(F.col("path")).alias("scope"))


@query("path_extract", f"WITH {PATHED} SELECT id, CASE k % 3 WHEN 0 THEN path WHEN 1 THEN path END AS path FROM pv")
def path_extract(read):
    empty = F.map_from_arrays(F.array(F.lit("path")), F.array(F.lit("")))
    payload = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("file"), F.col("path"))).when(F.col("k") % 3 == 1, F.create_map(F.lit("path"), F.lit(""), F.lit("arguments.file_path"), F.col("path"))).otherwise(empty)
    return pathed(read).select("id", paths.first_path(payload).alias("path"))


@query("risk_ctx", f"WITH {PATHED} SELECT id, CAST(CASE WHEN k % 5 = 0 THEN 4 WHEN starts_with(path, '/') THEN 15 WHEN k % 5 = 1 THEN 15 ELSE -8 END AS BIGINT) AS points FROM pv")
def risk_ctx(read):
    target = F.when(F.col("path").startswith("/"), F.col("path")).when(F.col("k") % 5 == 1, F.concat(F.lit("a/../../"), "path")).otherwise(F.concat(F.lit("./b/../"), "path"))
    return pathed(read).select("id", paths.context_points(target, F.when(F.col("k") % 5 != 0, F.lit("/work/project"))).cast("long").alias("points"))


@query("phases", f"WITH {EV}, n AS (SELECT id, kind, {NORM} AS name FROM ev) SELECT id, CASE WHEN kind LIKE 'message.%' THEN 'planning' WHEN kind NOT LIKE 'tool.%' THEN '' WHEN name IN ('read_file', 'grep', 'list_dir', 'web_search') THEN 'exploration' WHEN name = 'bash' THEN 'implementation,verification' ELSE 'implementation' END AS phases FROM n")
def phases(read):
    """The set of phases that an event can belong to."""
    name, kind = tools.normalized(F.col("tool")), F.col("kind")
    rules = F.array(F.when(kind.startswith("message."), "planning"), F.when(kind.startswith("tool.") & name.isin("read_file", "grep", "list_dir", "web_search"), "exploration"), F.when(kind.startswith("tool.") & ~name.isin("read_file", "grep", "list_dir", "web_search"), "implementation"), F.when(kind.startswith("tool.") & (name == "bash"), "verification"))
    return session_events(read("events")).select("id", F.array_join(F.array_sort(F.array_distinct(F.array_compact(rules))), ",").alias("phases"))


@query("merge_meta", f"WITH {PAIRED} SELECT start_id, value FROM paired WHERE status = 'paired'")
def merge_meta(read):
    return pairing.pair_calls(session_events(read("events"))).where("status = 'paired'").select("start_id", "value")


@query("repo_field", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS repo FROM pages")
def repo_field(read):
    return read("pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("repo"))


#: Server profiles with their default effect.
PROFILES = {"github": "read_only", "db": "read_only"}


@query("classify_mcp", f"WITH {EV}, n AS (SELECT id, tool, split_part(tool, '__', 2) AS server, {NORM} AS name FROM ev WHERE starts_with(tool, 'mcp__')) SELECT id, server, CASE WHEN name = 'create_issue' THEN 'mutating' ELSE 'read_only' END AS effect FROM n")
def classify_mcp(read):
    """The server's default effect, raised by the verb of the tool, never lowered."""
    rows = session_events(read("events")).where("tool like 'mcp!_!_%' escape '!'").withColumns({"server": F.split_part("tool", F.lit("__"), F.lit(2)), "name": tools.normalized(F.col("tool"))})
    default = F.try_element_at(F.create_map(*[F.lit(x) for pair in PROFILES.items() for x in pair]), F.col("server"))
    return rows.select("id", "server", tools.worst(F.array_compact(F.array(default, tools.verb_effect(F.col("name"))))).alias("effect"))


@query("agg_effect", f"WITH {EV}, n AS (SELECT session_id, CASE WHEN tool = 'delete_branch' THEN 3 WHEN tool IN ('bash', 'write_file', 'edit-file', 'mcp__github__create_issue') THEN 2 ELSE 1 END AS r FROM ev WHERE kind LIKE 'tool.%') SELECT session_id, CASE max(r) WHEN 3 THEN 'destructive' WHEN 2 THEN 'mutating' ELSE 'read_only' END AS effect FROM n GROUP BY session_id")
def agg_effect(read):
    rows = tools.classify(session_events(read("events")).where("kind like 'tool.%'"))
    return rows.groupBy("session_id").agg(tools.worst(F.collect_set("effect")).alias("effect"))


def lines(read):
    return session_events(read("events")).where("kind = 'tool.call.started'").where(~F.col("command").startswith(":("))


PARTS = f"{EV}, ln AS (SELECT id, command, string_split_regex(command, '\\s*(\\|\\||&&|\\||;)\\s*') AS parts FROM ev WHERE kind = 'tool.call.started' AND NOT starts_with(command, ':(')), pc AS (SELECT id, generate_subscripts(parts, 1) - 1 AS place, unnest(parts) AS part FROM ln), cm AS (SELECT id, place, part, split_part(part, ' ', 1) AS bin, CASE WHEN split_part(part, ' ', 2) NOT LIKE '-%' THEN nullif(split_part(part, ' ', 2), '') END AS sub FROM pc WHERE part <> '')"


@query("classify_cmd", f"WITH {PARTS} SELECT id, place, bin AS program, sub AS subcommand FROM cm")
def classify_cmd(read):
    return commands.commands_of(lines(read)).select("id", "place", F.col("binary").alias("program"), "subcommand")


@query("match_rule", f"WITH {PARTS} SELECT id, place, CASE WHEN bin = 'git' AND sub IN ('status', 'diff', 'log') THEN 'exploration' WHEN bin = 'git' THEN 'version_control' WHEN bin = 'python' AND contains(part, ' -m ') THEN 'verification' WHEN bin = 'npm' AND sub = 'run' THEN 'verification' WHEN bin = 'rm' AND contains(part, '-rf') THEN 'cleanup' WHEN bin = 'rm' THEN 'modification' WHEN bin = 'curl' AND contains(part, '-X') THEN 'upload' WHEN bin = 'curl' THEN 'retrieval' WHEN bin = 'grep' THEN 'exploration' ELSE 'implementation' END AS activity FROM cm")
def match_rule(read):
    rows = lines(read)
    rules = rows.sparkSession.createDataFrame([tuple(list(x) if isinstance(x, tuple) else x for x in r) for r in commands.RULES], commands.RULE)
    return commands.first_rule(commands.commands_of(rows), rules)


_EFFECT = "CASE WHEN bin IN ('rm', 'dd', 'mkfs.ext4') THEN 3 WHEN bin IN ('chmod', 'wget', 'nc') THEN 2 WHEN bin IN ('curl', 'cat', 'ls', 'git', 'pwd', 'grep') THEN 1 END"


@query("effect_override", f"WITH {PARTS} SELECT id, place, CASE {_EFFECT} WHEN 3 THEN 'destructive' WHEN 2 THEN 'mutating' WHEN 1 THEN 'read_only' END AS effect FROM cm")
def effect_override(read):
    return commands.effects(commands.commands_of(lines(read))).select("id", "place", "effect")


@query("build_cls", f"WITH {PARTS} SELECT id, string_agg(bin, ',' ORDER BY place) AS binaries, CASE max({_EFFECT}) WHEN 3 THEN 'destructive' WHEN 2 THEN 'mutating' WHEN 1 THEN 'read_only' END AS effect, count(*) AS n_commands FROM cm GROUP BY id")
def build_cls(read):
    return commands.whole_line(commands.commands_of(lines(read)))


@query("risk_flags", f"WITH {PARTS} SELECT id, place, CAST(CASE bin WHEN 'rm' THEN CASE WHEN contains(part, '-rf') THEN 20 ELSE 0 END WHEN 'dd' THEN 15 WHEN 'curl' THEN CASE WHEN contains(part, '-X') THEN 12 ELSE 0 END ELSE 0 END AS BIGINT) AS points FROM cm")
def risk_flags(read):
    return commands.flag_points(commands.commands_of(lines(read))).select("id", "place", "points")


@query("risk_gtfo", f"WITH {PARTS} SELECT id, place, CAST(CASE WHEN bin IN ('curl', 'wget', 'nc') THEN 10 ELSE 0 END AS BIGINT) AS points FROM cm")
def risk_gtfo(read):
    return commands.reach_points(commands.commands_of(lines(read))).select("id", "place", "points")


@query("risk_taint", f"WITH {PARTS} SELECT a.id, a.bin AS source, b.bin AS sink FROM cm a JOIN cm b ON a.id = b.id AND b.place = a.place + 1 WHERE b.bin IN ('nc', 'ncat', 'curl', 'wget', 'socat', 'telnet', 'ssh', 'scp')")
def risk_taint(read):
    return commands.pipes_to_senders(commands.commands_of(lines(read)))


@query("risk_conf", f"WITH {PARTS} SELECT id, place, CASE WHEN {_EFFECT} IS NOT NULL THEN CASE WHEN regexp_matches(part, '(^|\\s)-') THEN 'high' ELSE 'medium' END ELSE 'medium' END AS confidence FROM cm")
def risk_conf(read):
    rows = commands.effects(commands.commands_of(lines(read)))
    return rows.select("id", "place", commands.confidence(F.col("binary"), F.col("effect"), F.col("flags")).alias("confidence"))


@query("risk_paths", f"WITH {PATHED} SELECT id, CASE WHEN path = '.env' THEN 'secrets' WHEN path = '/etc/passwd' THEN 'system' END AS sensitivity FROM pv")
def risk_paths(read):
    path = F.col("path")
    secret = path.rlike(r"(^|/)\.env$|\.pem$|\.key$|\.p12$|\.netrc$|terraform\.tfstate$|\.tfvars$|\.aws/(credentials|config)$|\.kube/config$")
    return pathed(read).select("id", F.when(secret, "secrets").when(path.isin("/etc/passwd", "/etc/shadow", "/etc/sudoers", "/etc/hosts"), "system").alias("sensitivity"))


@query("structure", f"WITH {EV} SELECT id, contains(command, '|') AS piped, regexp_matches(command, '[^>]>\\s*[^&>]') AS redirected, regexp_matches(command, ';|&&') AS sequential FROM ev WHERE kind = 'tool.call.started'")
def structure(read):
    of = commands.structure_of(F.col("commands"))
    rows = shell.with_commands(session_events(read("events")).where("kind = 'tool.call.started'"))
    return rows.select("id", *[of[k].alias(k) for k in ("piped", "redirected", "sequential")])


UPGRADED = f"""{PARTS}, wl AS (SELECT id, coalesce(max({_EFFECT}), 0) AS rank, bool_or(bin IN ({", ".join(repr(b) for b in commands.SENDERS)})) AS sends FROM cm GROUP BY id),
 up AS (SELECT ln.id, contains(command, ' > ') AS written, sends, CASE greatest(rank, CASE WHEN contains(command, ' > ') THEN 2 ELSE 0 END) WHEN 3 THEN 'destructive' WHEN 2 THEN 'mutating' WHEN 1 THEN 'read_only' END AS effect FROM ln JOIN wl USING (id))"""


@query("shell_post", f"WITH {UPGRADED} SELECT id, effect, written, sends FROM up")
def shell_post(read):
    has = lambda tag: F.array_contains("capability", tag)
    return commands.upgraded(lines(read)).select("id", "effect", has("filesystem_write").alias("written"), has("network_outbound").alias("sends"))


@query("gov_phase", f"WITH {UPGRADED} SELECT up.id, CASE WHEN sends THEN 'network' WHEN effect = 'destructive' THEN 'destructive' WHEN effect = 'mutating' THEN CASE WHEN regexp_matches(lower(tool), 'test|verify|check') THEN 'testing' WHEN regexp_matches(lower(tool), 'deploy|publish') THEN 'deployment' ELSE 'implementation' END ELSE 'exploration' END AS phase FROM up JOIN ev USING (id)")
def gov_phase(read):
    rows = commands.upgraded(lines(read).select("id", "command", "tool"), keep=("tool",))
    return rows.select("id", commands.phase_of_call(F.col("capability"), F.col("effect"), F.col("tool")).alias("phase"))
