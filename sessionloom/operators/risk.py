"""Additive risk scores of commands and tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shell import short_flags, with_commands

#: Fixed values of the scoring model.
INTENT = {"read_only": 8, "mutating": 24, "destructive": 42, "unknown": 24}
CAPABILITY = {"network_outbound": 10, "network_inbound": 8, "subprocess": 12, "uses_credentials": 15, "elevated_privilege": 18}
NO_CONTEXT, GTFOBINS, MOST_PATTERNS = 4, 10, 25
PATTERNS = (
    (r"\beval\s", 20, "eval_usage", "T1059.004"),
    (r"\|\s*(?:bash|sh|zsh|fish|dash|ksh|python[23]?|perl|ruby|node)\b", 20, "pipe_to_shell", "T1204.002"),
    (r"\b(?:bash|sh|zsh|dash|ksh)\s+-c\s", 18, "shell_inline_exec", "T1059.004"),
    (r"\b(?:python[23]?|perl|ruby|node)\s+-[ce]\s", 18, "interpreter_inline_exec", "T1059"),
    (r"\bxargs\b.*\b(?:sh|bash|zsh)\s+-c", 18, "xargs_shell_exec", "T1059.004"),
    (r"\$\([^)]+\)|`[^`]+`", 10, "command_substitution", "T1059.004"),
    (r"LD_PRELOAD", 20, "ld_preload", "T1574.006"),
    (r"/dev/(?:tcp|udp)/", 20, "dev_tcp_udp", "T1071.001"),
    (r"chmod\s+(-R\s+)?[0-7]*7[0-7]{2}\s", 15, "permission_broadening", "T1222.002"),
    (r"HISTFILE|HISTSIZE=0|unset\s+HISTFILE", 12, "history_manipulation", "T1070.003"),
    (r"/proc/self/environ", 15, "proc_environ", "T1082"),
    (r"\\x[0-9a-fA-F]{2}", 10, "hex_escape", "T1027"),
)
#: binary: (effect, capability that lets it reach out)
BINARIES = {
    "rm": ("destructive", None), "dd": ("destructive", None), "mkfs.ext4": ("destructive", None), "chmod": ("mutating", None), "curl": ("read_only", "network_outbound"),
    "wget": ("mutating", "network_outbound"), "cat": ("read_only", None), "ls": ("read_only", None), "git": ("read_only", None), "pwd": ("read_only", None), "grep": ("read_only", None), "nc": ("mutating", "network_outbound"),
}
#: binary: (flags that call for it, or none for its mere presence; points)
FLAGS = {"rm": ((("-r", "--recursive"), 12), (("-f", "--force"), 8), (("--no-preserve-root",), 20)), "dd": (((), 15),), "curl": ((("-X", "--request", "-d", "--data"), 12),), "find": ((("-delete",), 18), (("-exec", "-execdir"), 12)), "kill": ((("-9", "-KILL"), 10),)}
SHELLS = ("sh", "bash", "zsh", "dash", "ksh", "python", "python3", "perl", "ruby", "node")
SENDERS, FETCHERS = ("nc", "ncat", "curl", "wget", "socat", "telnet", "ssh", "scp"), ("curl", "wget", "nc", "ncat")
SYSTEM_PATHS = ("/etc/passwd", "/etc/shadow", "/etc/sudoers", "/etc/hosts")


def _in(x: Column, values) -> Column:
    return F.coalesce(x.isin(*values), F.lit(False))


def pattern_bonus(command: Column) -> Column:
    total = F.lit(0)
    for pattern, score, _, _ in PATTERNS:
        total = total + F.when(command.rlike(pattern), score).otherwise(0)
    return F.least(total, F.lit(MOST_PATTERNS)).cast("long")


def techniques(command: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*[F.when(command.rlike(p), t) for p, _, _, t in PATTERNS]), lambda x: x.isNotNull()))


#: Classes of block devices, binaries that make or wipe file systems, those that change partition tables and the words by which they do.
BLOCK_DEVICES = ("sd", "nvme", "disk", "hd", "vd", "mmcblk", "xvd")
FORMATTERS, PARTITIONERS = ("mkfs", "mke2fs", "mkswap", "wipefs"), ("parted", "sfdisk", "sgdisk")
PARTITION_CHANGES = ("mklabel", "mkpart", "--zap-all", "--zap", "-z", "--delete", "--new")
#: Where things are started from, in the system and below a home folder.
STARTED_FROM = ("/etc/cron", "/var/spool/cron", "/etc/systemd/", "/run/systemd/", "/lib/systemd/", "/usr/lib/systemd/", "/etc/profile", "/etc/bash.bashrc", "/etc/zsh/", "/etc/zprofile", "/etc/zshrc")
STARTED_AT_HOME = (".bashrc", ".bash_profile", ".bash_login", ".profile", ".zshrc", ".zprofile", ".zlogin", ".zshenv", ".config/systemd", ".config/autostart")
WRITES, COPIERS = (">", ">>", ">|", "&>", "&>>"), ("cp", "mv", "install", "ln")


def _starts(path: Column, *beginnings: str) -> Column:
    return F.exists(F.array(*map(F.lit, beginnings)), lambda x: path.startswith(x))


def _below_home(path: Column) -> Column:
    """What follows the home folder in a path; null for others."""
    parts = F.split(path, "/", -1)
    rest = lambda n: F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), "/")
    return F.when(_starts(path, "~/", "$HOME/", "${HOME}/"), rest(1)).when(path.startswith("/root/"), rest(2)).when(path.startswith("/home/"), rest(3))


def hazards(commands: Column) -> dict[str, Column]:
    """What a parsed command line would do beyond its own effect: write to a block device, make or wipe a file system, write where things are started
    from, or fork without end. Told by the parsed commands: targets of redirects, `of=` of dd, files of tee, the last word of cp, mv, install
    and ln, and functions that are called and call themselves twice in a pipe in the background. Binaries are seen behind sudo, env and assignments;
    a here-document's body is no command. Null commands have none."""
    some = lambda test: F.coalesce(F.exists(commands, lambda c: F.coalesce(test(c), F.lit(False))), F.lit(False))
    written = lambda c: F.transform(F.filter(c["redirects"], lambda r: r["op"].isin(*WRITES)), lambda r: r["target"])
    arguments = lambda c: F.slice(c["words"], 2, F.greatest(F.size(c["words"]) - 1, F.lit(0)))
    files = lambda c: F.filter(arguments(c), lambda w: ~w.startswith("-"))
    out_files = lambda c: F.transform(F.filter(arguments(c), lambda w: F.lower(w).startswith("of=")), lambda w: F.substr(w, F.lit(4)))

    def device(path):
        return _starts(F.lower(path), *[f"/dev/{d}" for d in BLOCK_DEVICES])

    def started(path):
        return _starts(path, *STARTED_FROM) | F.coalesce(_starts(_below_home(path), *STARTED_AT_HOME), F.lit(False))

    def persists(c):
        last = F.slice(files(c), -1, 1)
        to = F.concat(written(c), F.when(c["binary"] == "tee", files(c)).when(c["binary"].isin(*COPIERS) & (F.size(files(c)) > 0), last).otherwise(F.array().cast("array<string>")))
        return (c["binary"] == "crontab") | F.exists(to, started)

    def formats(c):
        changes = F.exists(arguments(c), lambda w: F.exists(F.array(*map(F.lit, PARTITION_CHANGES)), lambda x: (F.lower(w) == x) | F.lower(w).startswith(F.concat(x, F.lit("=")))))
        return c["binary"].isin(*FORMATTERS) | c["binary"].startswith("mkfs.") | (c["binary"].isin(*PARTITIONERS) & changes)

    def bomb(c):
        body = F.filter(commands, lambda x: x["inside"] == c["binary"])
        calls = F.size(F.filter(body, lambda x: x["binary"] == c["binary"]))
        return (c["inside"] == "") & (c["binary"] != "") & (calls >= 2) & F.exists(body, lambda x: x["connector"].isin("|", "|&")) & F.exists(body, lambda x: x["connector"] == "&")

    return {
        "raw_device": some(lambda c: F.exists(F.concat(written(c), out_files(c)), device)),
        "fs_format": some(formats),
        "persistence": some(persists),
        "fork_bomb": some(bomb),
    }


def level(score: Column) -> Column:
    return F.when(score <= 20, "safe").when(score <= 45, "caution").when(score <= 75, "danger").otherwise("critical")


#: Methods by which a request changes something, and options that name one or send data.
_CHANGING, _METHOD, _SENDING = ("POST", "PUT", "PATCH", "DELETE"), ("-X", "--request"), ("-d", "--data", "--data-raw", "--data-binary", "-F", "--form", "-T", "--upload-file")


def shell_risk(calls: DataFrame) -> DataFrame:
    """Adds score and level to calls with a command, from the parsed commands of the line and rules in literals. The first command's binary, behind its wrappers, decides flags and reach;
    the worst effect of all commands is the intent, writing to a file or sending a request that changes something is mutating at least; a wrapper that elevates adds its weight;
    taint follows pipes. A null command is scored as an unknown one."""
    rows = with_commands(calls, "command", "cmds").withColumn("cmds", F.filter("cmds", lambda c: c["binary"] != ""))
    first = F.try_element_at("cmds", F.lit(1))
    flags = F.coalesce(short_flags(first["flags"]), F.array().cast("array<string>"))
    rank = {"read_only": 1, "mutating": 2, "destructive": 3}
    of = F.create_map(*[x for b, (e, _) in BINARIES.items() for x in (F.lit(b), F.lit(rank[e]))])

    def severity_of(c):
        written = F.exists(c["redirects"], lambda r: r["op"].isin(*WRITES) & (r["target"] != "/dev/null"))
        method = F.exists(F.sequence(F.lit(1), F.greatest(F.size(c["words"]) - 1, F.lit(1))), lambda i: c["words"][i - 1].isin(*_METHOD) & F.coalesce(F.try_element_at(c["words"], (i + 1).cast("int")).isin(*_CHANGING), F.lit(False)))
        sends = (c["binary"] == "curl") & (method | F.arrays_overlap(c["flags"], F.array(*map(F.lit, _SENDING))))
        return F.greatest(F.coalesce(F.try_element_at(of, c["binary"]), F.lit(0)), F.when(written | sends, 2).otherwise(0))

    severity = F.coalesce(F.array_max(F.transform("cmds", severity_of)), F.lit(0))
    intent = F.when(severity == 1, INTENT["read_only"]).when(severity == 3, INTENT["destructive"]).otherwise(INTENT["mutating"])
    flag_bonus = F.lit(0)
    for binary, rules in FLAGS.items():
        own = F.lit(0)
        for wanted, points in rules:
            own = own + (F.when(F.arrays_overlap(flags, F.array(*map(F.lit, wanted))), points).otherwise(0) if wanted else F.lit(points))
        flag_bonus = flag_bonus + F.when(first["binary"] == binary, own).otherwise(0)
    reaches = _in(first["binary"], [b for b, (_, c) in BINARIES.items() if c])
    elevated = F.exists("cmds", lambda c: c["elevated"])
    on_system = lambda c: F.exists(c["words"], lambda w: w.isin(*SYSTEM_PATHS))
    system = F.exists("cmds", on_system)
    short = F.greatest(F.size("cmds") - 1, F.lit(0))
    pairs = F.filter(F.arrays_zip(F.slice("cmds", 1, short).alias("a"), F.slice("cmds", 2, short).alias("b")), lambda p: p["a"]["connector"].isin("|", "|&"))

    def escalation(p):
        source = F.when(on_system(p["a"]), "sensitive").when(p["a"]["binary"].isin(*FETCHERS), "network").otherwise("any")
        run, send = p["b"]["binary"].isin(*SHELLS), p["b"]["binary"].isin(*SENDERS)
        return F.when(run & (source == "network"), 30).when(run & (source == "sensitive"), 22).when(run, 12).when(send & (source == "sensitive"), 30).otherwise(0)

    taint = F.coalesce(F.array_max(F.transform(pairs, escalation)), F.lit(0))
    points = [F.when(system, 14).otherwise(0), F.when(reaches, GTFOBINS).otherwise(0), F.when(elevated, CAPABILITY["elevated_privilege"]).otherwise(0), F.coalesce(pattern_bonus(F.col("command")), F.lit(0)), taint]
    total = intent + flag_bonus + sum(points, F.lit(NO_CONTEXT))
    score = F.least(F.greatest(total, F.lit(0)), F.lit(100)).cast("long")
    return rows.withColumn("score", score).withColumn("level", level(F.col("score"))).drop("cmds")


def capability_weight(capabilities) -> int:
    return sum(CAPABILITY.get(c, 0) for c in capabilities)


def tool_risk(classified: DataFrame) -> DataFrame:
    """Adds score, level to calls with effect and capability."""
    weights = F.create_map(*[F.lit(x) for pair in CAPABILITY.items() for x in pair])
    caps = F.aggregate("capability", F.lit(0), lambda s, c: s + F.coalesce(F.try_element_at(weights, c), F.lit(0)))
    intent = F.when(F.col("effect") == "read_only", INTENT["read_only"]).when(F.col("effect") == "destructive", INTENT["destructive"]).otherwise(INTENT["mutating"])
    score = F.least(intent + caps + NO_CONTEXT, F.lit(100)).cast("long")
    return classified.withColumn("score", score).withColumn("level", level(F.col("score")))


def governed(base: Column, drift: Column, mcp: Column, integrity: Column, budget: Column, ifc: Column) -> tuple[Column, Column]:
    """Score with the session's bonuses, and its level in the wider bands of governance."""
    score = F.least(base + drift + mcp + integrity + budget + F.least(10 * ifc, F.lit(30)), F.lit(100)).cast("long")
    return score, F.when(score >= 85, "critical").when(score >= 65, "danger").when(score >= 40, "caution").otherwise("safe")
