"""Operators on small inputs: ties, nulls, empty tables, ordered folds, streams."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions import pii, records, shell
from sessionloom.operators import governance, pairing, risk, sequence, text
from sessionloom.plans.enrichment_queries import GOLDEN
from sessionloom.plans.lens import COMMANDS
from sessionloom.sources import readers, sinks
from sessionloom.streaming import sessions

EVENT = "id long, session_id long, ts timestamp_ntz, kind string, call_id long, tool string, value double"
T0 = dt.datetime(2024, 1, 1)


def events(spark, *rows):
    return spark.createDataFrame([(i, s, T0 + dt.timedelta(seconds=t), kind, call, "bash", v) for i, s, t, kind, call, v in rows], EVENT)


def test_pairs_orphans_displaced_and_lone(spark):
    S, C, E = pairing.START, pairing.DONE, pairing.END
    rows = events(spark, (1, 1, 0, S, 7, 1.0), (2, 1, 1, S, 7, 2.0), (3, 1, 3, C, 7, None), (4, 1, 4, C, 7, 4.0), (5, 1, 5, S, 8, 5.0), (6, 1, 6, E, None, None), (7, 1, 7, C, 8, 7.0), (8, 2, 0, S, 7, None))
    got = {(r.start_id, r.done_id): (r.status, r.duration_ms, r.value) for r in pairing.pair_calls(rows).collect()}
    assert got == {(1, None): ("displaced", None, 1.0), (2, 3): ("paired", 2000.0, 2.0), (None, 4): ("lone", None, 4.0), (5, None): ("orphan", None, 5.0), (None, 7): ("lone", None, 7.0), (8, None): ("orphan", None, None)}
    assert pairing.pair_calls(rows.limit(0)).count() == 0


def test_published_scores(spark):
    rows = spark.createDataFrame(list(enumerate(COMMANDS)), "i int, command string")
    got = {r.i: r.score for r in risk.shell_risk(rows).collect()}
    assert [got[i] for i in range(len(COMMANDS))] == list(GOLDEN)


def test_change_points_follow_the_plain_recursion():
    rng = random.Random(1234)
    seen, fold, weights = [], sequence.ChangePoint(5, longest=200), [1.0]
    for _ in range(60):
        x = rng.randrange(5)
        # all run lengths, written out
        joint = [w * ((seen[len(seen) - r :].count(x) + 0.5) / (r + 2.5)) for r, w in enumerate(weights)]
        new = [0.02 * sum(joint), *(0.98 * j for j in joint)]
        weights = [v / sum(new) for v in new]
        seen.append(x)
        assert fold.push(x)[0] == pytest.approx(weights[0])


def test_the_tracked_phase_needs_two_in_a_row():
    fold = sequence.PhaseFold()
    assert [fold.push(p) for p in "aabbbab"] == list("aaaabbb")


def test_a_boundary_is_silent_for_a_while(spark):
    rows = [(1, T0, i, a, 0.2) for i, a in enumerate((0.9, 0.9, 0.1, 0.1, 0.9))] + [(2, T0, 9, None, None)]
    scored = spark.createDataFrame(rows, "session_id int, ts timestamp, id long, activity double, step double")
    got = sequence.decoded(scored, {"activity": 0.5, "step": 0.1}, {"activity": 3, "step": 2}).orderBy("id").collect()
    assert [r.boundary for r in got] == ["activity", "noise", "step", "noise", "activity", "noise"]


def test_globs(spark):
    rows = spark.createDataFrame([("src/a/b.py",), ("b.py",), ("src/b.txt",)], "p string")
    of = lambda g: [r[0] for r in rows.where(F.col("p").rlike(governance.glob_pattern(g))).collect()]
    assert of("*.py") == ["src/a/b.py", "b.py"]
    assert of("src/*.py") == []
    assert of("src/**/*.py") == ["src/a/b.py"]


def test_times_and_paths(spark):
    rows = records.parsed(spark.createDataFrame([('{"a":{"b":[1,{"c":"x"}]},"t":"1704067200000"}',), ("[1]",), ("",), (None,), ("{",)], "line string"))
    got = rows.select(records.at("obj", "a.b.1.c").alias("c"), records.at("obj", "a.z").alias("z"), records.timestamp(records.at("obj", "t"), F.lit(None).cast("timestamp")).alias("t")).collect()
    assert [(r.c, r.z, r.t) for r in got] == [("x", None, T0)]


def test_mapping_drops_what_has_no_kind(spark):
    rows = records.parsed(spark.createDataFrame([('{"type":"a","v":null,"session_id":"s"}',), ('{"type":"b"}',)], "line string"))
    kept = records.mapped(rows, records.Mapping("f", "type", {"a": "x"}, payload={"v": "v", "l": "literal:1"})).collect()
    assert [(r.kind, r.session_id, r.payload) for r in kept] == [("x", "s", {"l": "1"})]


def test_check_digits(spark):
    rows = spark.createDataFrame([(1, "card 4111 1111 1111 1111 and 4111 1111 1111 1112"), (2, None)], "doc_id int, text string")
    assert [(r.doc_id, r.start, r.span) for r in pii.card_spans(rows).collect()] == [(1, 6, "4111 1111 1111 1111")]


def test_cards_behind_other_digits_and_twice(spark):
    card = "4111 1111 1111 1111"
    rows = spark.createDataFrame([(1, f"order 12 {card} x {card}"), (2, f"1234 {card}"), (3, "4111111111111111."), (4, "378282246310005 3782-822463-10005"), (5, "14111111111111111")], "doc_id int, text string")
    got = sorted((r.doc_id, r.start, r.span) for r in pii.card_spans(rows).collect())
    assert got == [(1, 10, card), (1, 32, card), (2, 6, card), (3, 1, "4111111111111111"), (4, 1, "378282246310005"), (4, 17, "3782-822463-10005")]


def test_divergence(spark):
    rows = spark.createDataFrame([(2, 2, 0.5, 0.5), (4, 0, 0.0, 1.0), (0, 0, 0.5, 0.5), (3, 1, 0.25, 0.75)], "a int, b int, p double, q double")
    got = [r[0] for r in rows.select(sequence.divergence({"a": F.col("a"), "b": F.col("b")}, {"a": F.col("p"), "b": F.col("q")})).collect()]
    assert got[0] == 0 and abs(got[1] - math.log(2)) < 1e-12 and got[2] == 0
    assert abs(got[3] - (0.75 * math.log(0.75 / 0.5) + 0.25 * math.log(0.25 / 0.5))) < 1e-12


def test_drift_counts_turns_and_divergence(spark):
    phases = ["exploration"] * 6 + ["verification", "implementation"]
    events = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=i), i, p) for i, p in enumerate(phases)], "session_id int, ts timestamp, id long, phase string")
    plain = [r.drift for r in governance.drift(events).orderBy("id").collect()]
    assert plain == [0, 0, 0, 0, 0, 0, 0, 10]
    base = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 0.0)], ", ".join(f"share_{p} double" for p in sequence.PHASES))
    got = [r.drift for r in governance.drift(events, base).orderBy("id").collect()]
    assert got[:4] == [0] * 4 and got[4] == 15 and got[7] == 10 + min(15, int(25 * (0.5 * math.log(1 / (9 / 16)) + 0.5 * (0.75 * math.log(2) + 0.125 * math.log(2) + 0.125 * math.log(0.125 / (9 / 16))))))


def test_starts_without_result_are_dispatched(spark):
    kinds = [("session.started", None), ("tool.call.started", 1), ("tool.call.started", 1), ("tool.call.completed", 1), ("tool.call.started", 2), ("tool.call.started", None), ("message.user", None)]
    events = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=i), i, k, c, "bash", 0.0) for i, (k, c) in enumerate(kinds)], "session_id int, ts timestamp, id long, kind string, call_id int, tool string, value double")
    assert sorted(r.id for r in governance.dispatched(events).collect()) == [0, 1, 3, 4]


def test_content_changes_go_over_ranges(spark):
    rows = [(s, i, f"v{i // 3 % 4}") for s in ("a", "b", None) for i in range(50)] + [("a", None, "v0")]
    table = spark.createDataFrame(rows, "s string, i long, t string")
    one, cut = (sorted((str(r.s), str(r.i), str(r.last_hash), r.tampered) for r in governance.content_changes(table, "s", "i", "t", block).collect()) for block in (1000, 7))
    assert len(cut) == len(rows) and cut == one and any(r[3] for r in cut)


HAZARDS = {
    "dd if=/dev/zero of=/dev/sda": "raw_device", "echo x > /dev/sda": "raw_device", "cat a >> /dev/nvme0n1": "raw_device", "dd if=/dev/sda of=b.img": "", "echo x > /dev/null": "", "ls /dev/sda": "",
    "mkfs.ext4 /dev/sda1": "fs_format", "sudo -u root mkswap /dev/sdb": "fs_format", "A=1 wipefs -a /dev/sdb": "fs_format", "/sbin/mke2fs /dev/sdb": "fs_format", "parted /dev/sda mklabel gpt": "fs_format", "parted -l": "", "echo mkfs": "", "true; mkfs /dev/sdb": "fs_format", "echo 'a; mkfs b'": "", "cat <<EOF\nmkfs.ext4 /dev/sda\nEOF": "", "sgdisk --zap-all /dev/sda": "fs_format", "sfdisk -l": "", "echo \"> /dev/sda\"": "", "dd if=a of='/dev/sda'": "raw_device", "sudo dd if=a of=/dev/xvda1": "raw_device",
    "mv ~/.bashrc b": "", "ln -s a /etc/systemd/system/x.service": "persistence", "install -m 644 a $HOME/.config/autostart/a.desktop": "persistence", "echo a >> \"$HOME/.zshrc\"": "persistence", "tee /tmp/x < /etc/profile": "", "echo a > /home/u/.profile": "persistence", "echo a > /root/.zshenv": "persistence", "cp": "",
    "f(){ f | f & }; g": "", "x() { x|x& } ; x": "fork_bomb",
    "echo x > /etc/cron.d/x": "persistence", "cat /etc/cron.d/x": "", "cp a ~/.bashrc": "persistence", "crontab f": "persistence", "env crontab f": "persistence", "echo a | tee -a /etc/profile": "persistence", "cat ~/.bashrc": "",
    ":(){ :|:& };:": "fork_bomb", "b(){ b|b& };b": "fork_bomb", "f(){ echo; };f": "", "ls | grep a &": "",
}


def test_hazards(spark):
    rows = spark.createDataFrame([(c,) for c in [*HAZARDS, None]], "c string")
    for r in shell.with_commands(rows, "c").select("c", *[x.alias(n) for n, x in risk.hazards(F.col("commands")).items()]).collect():
        assert " ".join(n for n, x in r.asDict().items() if n != "c" and x) == HAZARDS.get(r.c, ""), r


def test_shell_words(spark):
    lines = {"sudo env A='b c' rm -rf \"x y\"": ["rm"], "time nohup /usr/bin/git status && FOO=1 make | tee log": ["git", "make", "tee"], "a 2>&1 | b": ["a", "b"], "echo 'x | y' ; \"my cmd\" z": ["echo", "my cmd"], "nice -n 5 timeout 3s cat f": ["cat"], "": []}
    got = {r.c: r.b for r in shell.with_commands(spark.createDataFrame([(c,) for c in lines], "c string"), "c").select("c", shell.binaries(F.col("commands")).alias("b")).collect()}
    assert got == lines
    words = spark.createDataFrame([("rm -rf \"x y\" a\\ b'c d'",)], "c string").select(shell.parsed(F.col("c"))[0]["words"]).first()[0]
    assert words == ["rm", "-rf", "x y", "a bc d"]


COMMAND_LINES = {
    "echo $(ls | wc -l); cat x": "echo; cat", "echo `ls | wc` | cat": "echo| cat", "cat <<EOF\nmkfs.ext4 /dev/sda\nEOF\nls": "cat; ls", "cat <<-'E' > f && ls\n\trm x\n\tE\nwc f": "cat&& ls; wc",
    "(cd a && make) || echo no": "cd&& make|| echo", "if test -f a; then rm a; else touch a; fi": "test; rm; touch;", "for f in *.py; do wc $f; done | sort": "wc; sort", "while read x; do echo $x; done < f": "read; echo;",
    "f() { ls | wc; }; f": "ls| wc; f", "function g { ls; }\ng": "ls; g", "case $1 in a) ls;; b|c) rm x;; esac": "ls; rm;", "diff <(sort a) <(sort b)": "sort sort diff", "a |& b": "a|& b",
    "sudo -u bob FOO=1 rm -rf /": "rm", "timeout -s KILL 5 sudo nice -n 3 git push --force": "git", "env -u A B=1 node x": "node", "sudo sudo sudo sudo sudo sudo ls": "sudo", "/usr/bin/Git.exe status": "git",
    "a\\\nb c": "ab", "# only words\nls # more | x": "ls", "echo \"a $(echo \")\" | x) b\" | cat": "echo| cat", "echo 'open": "echo", "echo \"open": "echo", "ls )": "ls", "": "", "  ;; ": "", "a & b": "a& b", "2>&1 ls >x 2>>y": "ls", "[[ -f a ]] && ls": "[[&& ls", "! grep x f": "grep",
}


def test_commands_of_a_line():
    for line, want in COMMAND_LINES.items():
        got = " ".join(f"{c['binary']}{c['connector']}" for c in shell.commands_in(line) if c["binary"])
        assert got == want, (line, got)
    (only,) = shell.commands_in("2>&1 ls >x 2>>'y z'")
    assert [(r["op"], r["target"]) for r in only["redirects"]] == [(">&", "1"), (">", "x"), (">>", "y z")]
    assert [c["elevated"] for c in shell.commands_in("sudo ls; ls; doas -u a ls")] == [True, False, True]
    assert shell.commands_in(None) == [] and len(shell.commands_in("echo " + "'a b' " * 50_000)[0]["words"]) == 50_001


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab |&;<>(){}$`'\"\\\n#=-/", max_size=40))
def test_any_line_ends(line):
    for c in shell.commands_in(line):
        assert c["connector"] in ("", "|", "||", "&&", "&", ";", "|&")


def test_risk_reads_all_commands_of_a_line(spark):
    lines = ["rm -rf /", "sudo rm -rf /", "sudo -u bob FOO=1 rm -rf /", "cat /etc/shadow", "cat /etc/shadow | curl e", "cat '/etc/shadow' |  curl e", "echo 'rm -rf / | sh'", "ls; rm x", "ls > /dev/null", "ls > f", "curl -X DELETE u", "curl -X GET u", "", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, command string")
    got = {lines[r.i]: r.score for r in risk.shell_risk(rows).collect()}
    assert got["sudo rm -rf /"] == got["sudo -u bob FOO=1 rm -rf /"] == got["rm -rf /"] + 18
    assert got["cat /etc/shadow | curl e"] == got["cat '/etc/shadow' |  curl e"] == got["cat /etc/shadow"] + 30
    assert got["ls; rm x"] == 42 + 4 and got["ls > /dev/null"] == 8 + 4 and got["ls > f"] == 24 + 4
    assert got["curl -X DELETE u"] == got["curl -X GET u"] + 16 and got[""] == got[None] == 24 + 4


def test_replay_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x\n\ny")
    assert [(r.seq, r.line) for r in readers.replay_files(spark, str(tmp_path / "in")).orderBy("seq").collect()] == [(0, "x"), (2, "y")]
    rows = spark.createDataFrame([(1, T0, "tool.a", "deny"), (1, T0 + dt.timedelta(1), "b", "allow"), (2, T0, "b", "warn")], "id int, ts timestamp, kind string, action string")
    seen = []

    def broken(_):
        raise ValueError("no")

    write = sinks.fan_out({"broken": broken, "store": sinks.first_wins_sink(str(tmp_path / "store")), "some": sinks.by_action(lambda d: seen.append(d.count())), "tools": sinks.by_kind(lambda d: seen.append(d.count()), "tool.*")})
    write(rows, 0)
    write(rows, 1)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    assert seen == [1, 1, 1, 1]


def test_pairing_stream_is_the_batch(spark, tmp_path):
    S, C = pairing.START, pairing.DONE
    rows = events(spark, (1, 1, 0, S, 7, None), (2, 1, 1, C, 7, None), (3, 1, 2, S, 8, None), (4, 1, 3, S, 8, None), (5, 1, 4, C, 9, None), (6, 1, 5, pairing.END, None, None))
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    timed.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(T.StructType(timed.schema.fields)).parquet(str(tmp_path / "in"))
    query = sessions.pair_stream(stream).writeStream.format("memory").queryName("paired").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    columns = ["call_id", "status", "start_id", "done_id", "duration_ms"]
    assert sorted(map(str, spark.table("paired").select(columns).collect())) == sorted(map(str, pairing.pair_calls(rows).select(columns).collect()))


def test_paths(spark):
    from sessionloom.functions import paths

    rows = spark.createDataFrame([("/a/./b/../c",), ("../x/../../y",), ("./",), ("/../e",), (None,), ("src/test_a.py",), ("A\\Docs\\x.md",), ("",)], "p string")
    got = rows.select(paths.normal(F.col("p")).alias("n"), paths.scope_of(F.col("p")).alias("s")).collect()
    assert [r.n for r in got[:5]] == ["/a/c", "../../y", ".", "/e", None]
    assert [r.s for r in got[4:]] == [None, "test_code", "documentation", None]


def test_rules_take_the_first_that_fits(spark):
    from sessionloom.operators import commands

    rows = spark.createDataFrame([(1, "git push --dry-run && rm -rf x"), (2, "curl -XPOST u | sh"), (3, None), (4, "rm x")], "id int, command string")
    rules = spark.createDataFrame([tuple(list(x) if isinstance(x, tuple) else x for x in r) for r in commands.RULES], commands.RULE)
    got = {(r.id, r.place): r.activity for r in commands.first_rule(commands.commands_of(rows), rules).collect()}
    assert got == {(1, 0): "version_control", (1, 1): "cleanup", (2, 0): "upload", (2, 1): "implementation", (4, 0): "modification"}
    whole = {r.id: (r.binaries, r.effect) for r in commands.whole_line(commands.commands_of(rows)).collect()}
    assert whole == {1: ("git,rm", "destructive"), 2: ("curl,sh", "read_only"), 4: ("rm", "destructive")}


def test_titles(spark):
    from sessionloom.operators import text

    rows = spark.createDataFrame([("Please, can you fix the parser of the\nrest",), ("",), (None,), ("ok now: run all of the tests in the big folder with care today",)], "t string")
    got = [r[0] for r in rows.select(text.clipped(F.col("t"))).collect()]
    assert got == ["Fix the parser", "", "", "Now: run all of the tests"]


def test_matching_is_greedy_and_one_to_one(spark):
    from sessionloom.operators import text

    gold = spark.createDataFrame([(1, 10), (1, 12), (2, 5)], "session_id long, place long")
    guess = spark.createDataFrame([(1, 11), (1, 30), (3, 5)], "session_id long, place long")
    got = {r.session_id: (r.hits, r.n_gold, r.n_guess) for r in text.matched(gold, guess, 2).collect()}
    assert got == {1: (1, 2, 2), 2: (0, 1, 0), 3: (0, 0, 1)}


def test_centroid_distance_over_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), "a" if i % 5 else "b", [float(x) for x in rng.normal(size=4)]) for i in rng.choice(400, 150, replace=False)]
    got = {r.id: r.distance for r in text.centroid_distance(spark.createDataFrame(rows, "id long, g string, v array<double>"), "g", "id", "v", 3, block=16).collect()}
    assert len(got) == len(rows)
    for name in "ab":
        own = sorted(r for r in rows if r[1] == name)
        assert got[own[0][0]] is None
        for i, (key, _, v) in enumerate(own[1:], 1):
            mean = np.mean([r[2] for r in own[max(0, i - 3) : i]], axis=0)
            assert abs(got[key] - (1 - np.dot(v, mean) / np.linalg.norm(v) / np.linalg.norm(mean))) < 1e-4
