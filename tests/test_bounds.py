"""Bounded pairing, the ledger of deliveries, reports of classes and upgrades of lines against plain versions."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.operators import ledger, pairing
from sessionloom.streaming import bounded

T0 = dt.datetime(2024, 1, 1)
S, D, E = pairing.START, pairing.DONE, pairing.END


def plain_pairs(rows, ttl=None, most=None):
    """rows in order: (id, session, seconds, kind, call). A list of what waits, gone through for each event."""
    waiting, out = [], []

    def go(w):
        waiting.remove(w)
        out.append((w[1], w[4], "orphan", w[0], None))

    for row in rows:
        own, session, at, kind, call = row
        same = next((w for w in waiting if (w[1], w[4]) == (session, call)), None)
        if kind == S:
            if same:
                go(same)
            waiting.append(row)
        elif kind == D:
            if same:
                waiting.remove(same)
            out.append((session, call, "paired" if same else "lone", same[0] if same else None, own))
        elif kind == E:
            for w in [w for w in waiting if w[1] == session]:
                go(w)
        if ttl is not None:
            for w in [w for w in waiting if at - w[2] > ttl]:
                go(w)
        while most is not None and len(waiting) > most:
            go(waiting[0])
    return out, [(w[1], w[4], "orphan", w[0], None) for w in waiting]


def made(seed, n=300, sessions=6):
    rng, at, rows = random.Random(seed), 0, []
    for own in range(n):
        at += rng.choice([0, 0, 1, 2, 30])
        kind = rng.choices([S, D, E, "message.user"], [8, 6, 1, 2])[0]
        rows.append((own, rng.randrange(sessions), at, kind, rng.randrange(4) if rng.random() < 0.95 else None))
    return rows


def table(spark, rows):
    schema = "id long, session_id long, ts timestamp, kind string, call_id long"
    return spark.createDataFrame([(i, s, T0 + dt.timedelta(seconds=at), k, c) for i, s, at, k, c in rows], schema)


def plain_set(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("ttl", [1, 20, 100_000])
def test_bounded_batch_is_the_plain_queue(spark, ttl):
    rows = made(ttl)
    out, left = plain_pairs(rows, ttl)
    got = pairing.pair_bounded(table(spark, random.Random(1).sample(rows, len(rows))), ttl).collect()
    assert plain_set(tuple(r) for r in got) == plain_set(out + left)


def test_bounded_batch_of_nothing_and_of_no_times(spark):
    empty = table(spark, []).limit(0)
    assert pairing.pair_bounded(empty, 5).count() == 0
    rows = spark.createDataFrame([(1, 1, None, S, 1), (2, 1, T0, D, 1), (3, 1, None, D, 2), (4, None, T0, S, None)], empty.schema)
    assert plain_set(tuple(r) for r in pairing.pair_bounded(rows, 5).collect()) == plain_set([(1, 1, "paired", 1, 2), (1, 2, "lone", None, 3), (None, None, "orphan", 4, None)])
    with pytest.raises(ValueError):
        pairing.pair_bounded(rows, 0)


def streamed(spark, folder, batches, **how):
    """Runs the batches one by one, each in a query of its own that goes on from the checkpoint."""
    stream = None
    for n, batch in enumerate(batches):
        table(spark, batch).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(T.StructType(table(spark, batch).schema.fields)).parquet(str(folder / "in"))
        query = bounded.bounded_pairs(stream, **how).writeStream.format("parquet").option("path", str(folder / "out")).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(folder / "cp")).start()
        assert query.awaitTermination(120), n
    return [tuple(r) for r in spark.read.parquet(str(folder / "out")).select("session_id", "call_id", "status", "start_id", "done_id").collect()]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("ttl, most", [(None, 3), (25, None), (25, 4)])
def test_bounded_stream_over_restarts_is_the_plain_queue(rocks, tmp_path, ttl, most):
    rows = made(7, 120)
    out, left = plain_pairs(rows, ttl, most)
    got = streamed(rocks, tmp_path, [rows[:50], rows[50:]], ttl_seconds=ttl, most_open=most, shards=1, late="1000 seconds")
    assert plain_set(got) == plain_set(out)
    assert most is None or len(left) <= most


def test_a_quiet_shard_lets_go_by_the_watermark(rocks, tmp_path):
    quiet = (1, 1, 0, S, 1)
    busy = [(n, 2, 100 * n, "message.user", None) for n in range(2, 6)]
    got = streamed(rocks, tmp_path, [[quiet, *busy[:2]], busy[2:], [(9, 2, 900, "message.user", None)]], ttl_seconds=60, shards=64, late="10 seconds")
    assert got == [(1, 1, "orphan", 1, None)]


@pytest.mark.parametrize("bad", [{"ttl_seconds": 0}, {"ttl_seconds": -1}, {"most_open": 0}])
def test_bounds_must_be_positive(spark, bad):
    with pytest.raises(ValueError):
        bounded.bounded_pairs(table(spark, []), **bad)


def plain_ledger(outcomes):
    """state, attempts, place of the reservation and of the close, by going through one key's deliveries."""
    reserved = closed = None
    attempts, state = 0, "discarded"
    for place, outcome in enumerate(outcomes):
        if closed is not None or outcome == "refused":
            continue
        if reserved is None:
            reserved, state = place, "reserved"
        if outcome == "failed":
            attempts += 1
            if attempts == 3:
                state, closed = "dead_letter", place
        elif outcome == "ok":
            state, closed = "finalized", place
    return state, attempts, reserved, closed


def test_ledger_of_all_short_histories(spark):
    histories = [h for n in range(1, 6) for h in itertools.product(["refused", None, "failed", "ok"], repeat=n)]
    rows = [(k, place, outcome) for k, h in enumerate(histories) for place, outcome in enumerate(h)]
    random.Random(2).shuffle(rows)
    got = {r.k: (r.state, r.attempts, r.reserved_at and r.reserved_at.place, r.closed_at and r.closed_at.place, r.deliveries) for r in ledger.delivery_ledger(spark.createDataFrame(rows, "k int, place int, outcome string"), ["k"], ["place"]).collect()}
    assert got == {k: (*plain_ledger(["crashed" if o is None else o for o in h]), len(h)) for k, h in enumerate(histories)}


def test_ledger_takes_null_keys_and_nothing(spark):
    rows = spark.createDataFrame([(None, 1, "failed"), (None, 2, "ok"), (3, 1, "refused")], "k int, place int, outcome string")
    got = {r.k: (r.state, r.attempts) for r in ledger.delivery_ledger(rows, ["k"], ["place"]).collect()}
    assert got == {None: ("finalized", 1), 3: ("discarded", 0)}
    assert ledger.delivery_ledger(rows.limit(0), ["k"], ["place"]).count() == 0


def test_alike_pairs_are_those_of_a_full_comparison(spark):
    from sessionloom.operators import text

    rng = random.Random(5)
    sets = [(rng.randrange(3), [f"w{rng.randrange(12)}" for _ in range(rng.randrange(9))]) for _ in range(150)] + [(None, ["a"]), (None, ["a"]), (1, None)]
    got = {r.g: r.n_alike for r in text.alike_pairs(spark.createDataFrame(sets, "g int, ws array<string>"), "g", "ws", 6).collect()}
    want = {}
    for (g, a), (h, b) in itertools.combinations(sets, 2):
        if g == h and a and b and 10 * len(set(a) & set(b)) >= 6 * len(set(a) | set(b)):
            want[g] = want.get(g, 0) + 1
    assert got == want


def test_report_counts_nulls_as_misses(spark):
    from sessionloom.operators import attribution as att

    rows = [("a", "a")] * 3 + [("a", "b"), ("b", "b"), ("b", None), (None, "a"), ("c", "a"), (None, None)]
    table = spark.createDataFrame(rows, "truth string, guess string")
    report = att.class_report(table, "truth", "guess")
    got = {r["class"]: r.asDict() for r in report.collect()}
    for c in "abc":
        hits, told, true = (sum(test(t, g) for t, g in rows) for test in (lambda t, g: t == g == c, lambda t, g: g == c, lambda t, g: t == c))
        f1 = round(2 * hits / (told + true), 6)
        assert got[c] == {"class": c, "hits": hits, "guesses": told, "support": true, "precision": round(hits / told, 6) if told else 0.0, "recall": round(hits / true, 6), "f1": f1}
    one = att.averaged(report).first()
    assert one.n_classes == 3 and one.f1_macro == round((6 / 9 + 2 / 4 + 0) / 3, 6) and one.f1_micro == round(8 / 14, 6)
    assert att.class_report(table.limit(0), "truth", "guess").count() == 0 and att.averaged(att.class_report(table.limit(0), "truth", "guess")).first().n_classes == 0


def test_lines_are_upgraded_by_what_they_write_and_reach(spark):
    from sessionloom.operators import commands

    lines = {1: "cat a > b", 2: "sudo rm x | nc h 1", 3: "ls 2>&1", 4: None, 5: "", 6: "git push --dry-run", 7: "mkfs.ext4 /dev/sda", 8: "unheard of"}
    rows = commands.upgraded(spark.createDataFrame(list(lines.items()), "id int, command string"))
    got = {r.id: (r.effect, set(r.capability)) for r in rows.collect()}
    assert got[1] == ("mutating", {"filesystem_write"})
    assert got[2] == ("destructive", {"elevated_privilege", "network_outbound"})
    assert got[3] == ("read_only", set()) and got[6] == ("read_only", set())
    assert got[4] == got[5] == got[8] == (None, set())
    assert got[7][0] == "destructive" and len(got[7][1]) >= 1


def test_phase_of_a_call_by_reach_effect_and_name(spark):
    from sessionloom.operators import commands

    rows = [(["network_outbound"], "destructive", "x", "network"), ([], "destructive", "test", "destructive"), (None, "mutating", "Run_Tests", "testing"), ([], "mutating", "publish_it", "deployment"), ([], "mutating", None, "implementation"), ([], None, "check", "exploration"), ([], "informational", "x", "exploration")]
    table = spark.createDataFrame(rows, "capability array<string>, effect string, tool string, want string")
    got = table.select(commands.phase_of_call(F.col("capability"), F.col("effect"), F.col("tool")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
