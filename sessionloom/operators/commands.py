"""Rule tables of commands as joins: the first rule that fits, effects, and what a line of several commands adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shell import short_flags, with_commands
from .risk import BINARIES, FLAGS, GTFOBINS, SENDERS, hazards

RULE = "place int, binary string, subcommands array<string>, requires array<string>, rejects array<string>, activity string"
#: Fixed values.
RULES = (
    (0, "git", ("status", "diff", "log"), None, None, "exploration"),
    (1, "git", ("push",), None, ("--dry-run",), "delivery"),
    (2, "git", None, None, None, "version_control"),
    (3, "python", None, ("-m",), None, "verification"),
    (4, "npm", ("run",), None, None, "verification"),
    (5, "rm", None, ("-r",), None, "cleanup"),
    (6, "rm", None, None, None, "modification"),
    (7, "curl", None, ("-X",), None, "upload"),
    (8, "curl", None, None, None, "retrieval"),
    (9, "grep", None, None, None, "exploration"),
)
MAIN = {"destructive": 3, "mutating": 2, "read_only": 1}


def commands_of(calls: DataFrame, command: str = "command") -> DataFrame:
    """A row for each command of a line: place, binary (behind wrappers), subcommand, flags, connector to the next, redirects, elevated. Quotes, substitutions
    and here-documents are read as a shell does. Lines without commands give no rows."""
    rows = with_commands(calls.select("id", command), command)
    rows = rows.select("id", F.posexplode(F.filter("commands", lambda c: c["binary"] != "")).alias("place", "c"))
    return rows.select("id", F.col("place").cast("long").alias("place"), "c.binary", "c.subcommand", short_flags(F.col("c.flags")).alias("flags"), "c.connector", "c.redirects", "c.elevated")


def first_rule(commands: DataFrame, rules: DataFrame) -> DataFrame:
    """activity of the first rule that fits each command; `implementation` where none does. A required short flag is met by one that begins with it."""
    r = F.broadcast(rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns]))  # a rule table, fixed in size
    met = lambda need: F.exists("flags", lambda f: (f == need) | (need.rlike("^-[^-]$") & f.startswith(need)))
    fits = (F.col("r_subcommands").isNull() | F.array_contains("r_subcommands", F.coalesce("subcommand", F.lit("")))) & (F.col("r_requires").isNull() | F.forall("r_requires", met)) & (F.col("r_rejects").isNull() | ~F.arrays_overlap("r_rejects", "flags"))
    joined = commands.join(r, (F.col("binary") == F.col("r_binary")) & fits, "left")
    best = joined.groupBy("id", "place").agg(F.min_by("r_activity", "r_place").alias("activity"))
    return best.withColumn("activity", F.coalesce("activity", F.lit("implementation")))


def effects(commands: DataFrame) -> DataFrame:
    """Adds effect: that of the binary; with --dry-run nothing changes."""
    of = F.create_map(*[F.lit(x) for b, (e, _) in BINARIES.items() for x in (b, e)])
    return commands.withColumn("effect", F.when(F.array_contains("flags", "--dry-run"), "read_only").otherwise(F.try_element_at(of, F.col("binary"))))


def whole_line(commands: DataFrame) -> DataFrame:
    """A row for each line: binaries in order, the worst effect, number of commands."""
    rank = F.create_map(*[F.lit(x) for pair in MAIN.items() for x in pair])
    ranked = effects(commands).withColumn("rank", F.try_element_at(rank, F.col("effect")))
    binaries = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "binary"))), lambda x: x["binary"]), ",")
    return ranked.groupBy("id").agg(binaries.alias("binaries"), F.max_by("effect", "rank").alias("effect"), F.count(F.lit(1)).alias("n_commands"))


def flag_points(commands: DataFrame) -> DataFrame:
    """Adds points for flags of the binary; a rule without flags counts for its mere presence."""
    total = F.lit(0)
    for binary, rules in FLAGS.items():
        own = F.lit(0)
        for wanted, points in rules:
            own = own + (F.when(F.arrays_overlap("flags", F.array(*map(F.lit, wanted))), points).otherwise(0) if wanted else F.lit(points))
        total = total + F.when(F.col("binary") == binary, own).otherwise(0)
    return commands.withColumn("points", total.cast("long"))


def reach_points(commands: DataFrame) -> DataFrame:
    """Adds points for binaries that can reach out."""
    return commands.withColumn("points", F.when(F.col("binary").isin(*[b for b, (_, c) in BINARIES.items() if c]), GTFOBINS).otherwise(0).cast("long"))


def pipes_to_senders(commands: DataFrame) -> DataFrame:
    """id, source, sink: neighbours of which the second sends what it gets; an equi-join of places."""
    after = commands.select("id", (F.col("place") - 1).alias("place"), F.col("binary").alias("sink")).where(F.col("sink").isin(*SENDERS))
    return commands.where(F.col("connector").isin("|", "|&")).select("id", "place", F.col("binary").alias("source")).join(after, ["id", "place"]).select("id", "source", "sink")


def structure_of(commands: Column) -> dict[str, Column]:
    """How the parsed commands of a line hang together: by pipes, with output to files, one after the other, or one only if another fails."""
    joined = lambda *by: F.exists(commands, lambda c: c["connector"].isin(*by))
    later = F.exists(F.slice(commands, 1, F.greatest(F.size(commands) - 1, F.lit(0))), lambda c: c["connector"] == "&")
    written = F.exists(commands, lambda c: F.exists(c["redirects"], lambda r: r["op"].isin(">", ">>", ">|", "&>", "&>>")))
    return {"piped": joined("|", "|&"), "redirected": written, "sequential": joined(";", "&&") | later, "conditional": joined("||")}


def confidence(binary: Column, effect: Column, flags: Column) -> Column:
    return F.when(binary.isNotNull() & effect.isNotNull(), F.when(F.size(flags) > 0, "high").otherwise("medium")).when(binary.isNotNull() | effect.isNotNull(), "medium").otherwise("low")


def upgraded(lines: DataFrame, command: str = "command", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, what else is to be kept, effect and capability (sorted) of each command line with what only the line as a whole shows: output to files makes a read-only
    line a mutating one that writes the file system, a wrapper that elevates and every hazard are capabilities, and so are the binaries that
    send. A line without commands has no effect, and a null one neither."""
    rank = F.create_map(*[F.lit(x) for pair in MAIN.items() for x in pair])
    of = F.create_map(*[F.lit(x) for b, (e, _) in BINARIES.items() for x in (b, e)])
    rows = with_commands(lines.select("id", command, *keep), command)
    run = F.filter(F.coalesce("commands", F.array()), lambda c: c["binary"] != "")
    effect = lambda c: F.when(F.array_contains(c["flags"], "--dry-run"), "read_only").otherwise(F.try_element_at(of, c["binary"]))
    ranks = F.transform(run, lambda c: F.coalesce(F.try_element_at(rank, effect(c)), F.lit(0)))
    written = F.coalesce(structure_of(F.col("commands"))["redirected"], F.lit(False))
    worst = F.greatest(F.coalesce(F.array_max(ranks), F.lit(0)), F.when(written, MAIN["mutating"]).otherwise(0))
    names = F.element_at(F.array(F.lit(None), *map(F.lit, sorted(MAIN, key=MAIN.get))), worst + 1)
    some = lambda test: F.exists(run, lambda c: F.coalesce(test(c), F.lit(False)))
    tags = [F.when(written, "filesystem_write"), F.when(some(lambda c: c["elevated"]), "elevated_privilege"), F.when(some(lambda c: c["binary"].isin(*SENDERS)), "network_outbound")]
    tags += [F.when(found, name) for name, found in hazards(F.col("commands")).items()]
    return rows.select("id", *keep, names.alias("effect"), F.array_sort(F.array_compact(F.array(*tags))).alias("capability"))


def phase_of_call(capability: Column, effect: Column, tool: Column) -> Column:
    """The phase that a classified call belongs to: what goes out to the network first, then what its effect says; a call that changes things is
    testing or deployment if its tool's name says so. Without an effect it is exploration."""
    named = lambda *parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(F.coalesce(tool, F.lit(""))), p))
    changes = F.when(named("test", "verify", "check"), "testing").when(named("deploy", "publish"), "deployment").otherwise("implementation")
    return F.when(F.coalesce(F.array_contains(capability, "network_outbound"), F.lit(False)), "network").when(effect == "destructive", "destructive").when(effect == "mutating", changes).otherwise("exploration")
