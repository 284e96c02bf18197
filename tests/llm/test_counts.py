"""Divergence of sources, phrases and MinHash classes against their SQL and plain versions, on small and odd inputs."""

from itertools import combinations
from math import comb

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import divergence, minhash, near, phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, langs=None, ids=None):
    n = len(texts)
    rows = list(zip(ids or range(n), texts, langs or ["en"] * n, sources or ["s"] * n, [len(t or "") for t in texts], strict=True))
    return spark.createDataFrame(rows, DOCS)


def words_of(seed, n, vocabulary=60):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).zipf(1.3, n) % vocabulary)


def same_as_sql(table, got, sql):
    documents = table.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    db = duckdb.connect()
    db.register("documents", documents)
    want = db.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted((tuple("" if v is None or v is pd.NA or v != v else str(v) for v in r) for r in x))
    assert rows(got.select(*columns).collect()) == rows(want.select(", ".join(columns)).fetchall())


def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, letters outside ASCII, marks inside words, clashing columns."""
    texts = [f"{words_of(i, 200)}. The-End, Élan{'’' * (i % 2)}s (THE end) w1's w2." for i in range(70)]
    texts += [None, "", " \n\t", "A", "a b", words_of(900, 40_000), *["same text here again"] * 40, "ÀB àb ß x y  z"]
    n = len(texts)
    sources = [None if i % 11 == 0 else "" if i % 13 == 0 else f"s{i % 5}" for i in range(n)]
    langs = [None if i % 9 == 0 else "und" if i % 17 == 0 else "en" if i % 3 else "de" for i in range(n)]
    table = docs(spark, texts, sources, langs, [None if i == 3 else i for i in range(n)])
    for c in ("term", "chunk", "row", "phrase", "w1", "a", "n", "set", "unit", "block"):
        table = table.withColumn(c, F.lit("own"))
    return table


def test_divergence_of_odd_rows(spark, monkeypatch):
    table = odd(spark)
    same_as_sql(table, divergence.divergence(table), divergence.OP11_SQL)
    monkeypatch.setattr(divergence, "TERMS_A_BIN", 7)
    monkeypatch.setattr(divergence, "SOURCES_A_BLOCK", 2)
    same_as_sql(table.repartition(7), divergence.divergence(table.repartition(7)), divergence.OP11_SQL)
    assert divergence.divergence(table.limit(0)).count() == 0


def test_documents_of_rare_chunks_are_told_apart(spark):
    # each chunk is in 20 documents, alone or two to a document: `foo` is in 40 documents, `bar` in 29 though its chunks have 40
    texts = [f"foo{m} x{i}" for m in (",", ".") for i in range(20)] + ["bar, bar."] * 11 + ["bar,"] * 9 + ["bar."] * 9
    table = docs(spark, texts)
    got = {r["term"]: r["n"] for r in divergence.term_counts(table).collect()}
    assert got == {"foo": 40, "x": 40}
    same_as_sql(table, divergence.divergence(table), divergence.OP11_SQL)


def test_shares_are_exact(spark):
    table = spark.createDataFrame([(9_000_000_000_000_000, 9_100_000_000_000_001, 77), (0, 0, 1)], "n long, total long, kept long")
    got = [r[0] for r in table.select(divergence._share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in table.collect()]


@pytest.mark.parametrize(("best", "start"), [(2000, 2), (8, 1), (30, 1)])
def test_phrases_of_odd_rows(spark, best, start):
    table = odd(spark)
    sql = phrases.OP12_SQL.replace(f"rank <= {phrases.BEST}", f"rank <= {best}")
    same_as_sql(table, phrases.collocations(table, best, start), sql)
    assert phrases.collocations(table.limit(0)).count() == 0


def test_frontier_grows_until_the_last_phrase_is_settled(spark):
    # the pairs that score best are all inside a longer phrase, so that the first frontiers leave too few
    own = [" ".join(f"p{k}{c}" for c in "abcd") + "." for k in range(6) for _ in range(40)]
    loose = [f"x{i % 7} y{i % 5}." for i in range(2000)]
    table = docs(spark, own + loose)
    sql = phrases.OP12_SQL.replace(f"rank <= {phrases.BEST}", "rank <= 12")
    same_as_sql(table, phrases.collocations(table, 12, 1), sql)


def test_scores_are_exact(spark):
    table = spark.createDataFrame([(4_700_000_000_000_000, 4_700_000_000_000_001, 4_800_000_000_000_007)], "a long, l long, r long")
    a, l, r = table.first()
    assert table.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 2_000_000 * a // (l + r)


def classes_by_hand(texts, ids):
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    least = {}
    for x, d in zip(label, ids, strict=True):
        least[x] = d if least.get(x) is None else least[x] if d is None else min(least[x], d)
    return sorted((-1 if d is None else d, len(s), -1 if least[x] is None else least[x], d == least[x]) for d, s, x in zip(ids, sets, label, strict=True))


def near_texts(seed, groups, copies, size=80, changes=3):
    rng, out = np.random.default_rng(seed), []
    for g in range(groups):
        base = [f"t{x}" for x in rng.integers(0, 50_000, size)]
        for _ in range(copies):
            own = list(base)
            for at in rng.integers(0, size, rng.integers(0, changes + 1)):
                own[at] = f"c{rng.integers(0, 10**9)}"
            out.append(" ".join(own))
    return out


def found(table):
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2], r[3]) for r in minhash.near_dedup(table).select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize(("block", "few"), [(512, 2048), (6, 2048), (6, 3)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, block, few):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "FEW", few)
    texts = near_texts(1, 4, 40) + near_texts(2, 30, 3, 30, 2) + [f"{words_of(1, 300)} {words_of(i + 5, 30)}" for i in range(60)]
    texts += [None, "", " \n", "a", "A", "a b", "b a", "Same Text here now", "same text here now"] + [words_of(77, 30_000)] * 2
    ids = [None if i == 3 else i for i in range(len(texts))]
    assert found(docs(spark, texts, ids=ids)) == classes_by_hand(texts, ids)


def test_null_and_repeated_ids_are_classes_by_text(spark):
    a, b, c = near_texts(3, 3, 1)
    texts, ids = [a, a, b, b, c, a], [None, None, None, 4, 4, 4]
    assert found(docs(spark, texts, ids=ids)) == classes_by_hand(texts, ids)
    alone = minhash.near_dedup(docs(spark, [a, a, b], ids=[None] * 3)).collect()
    assert [(r.component_id, r.kept) for r in alone] == [(None, True)] * 3
    assert minhash.near_dedup(docs(spark, [a]).limit(0)).count() == 0


def test_stars_of_random_edges(spark):
    rng = np.random.default_rng(23)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(k + 1, k) for k in range(500, 560)] + [(k, k + 1) for k in range(600, 640)] + [(7, 7), (901, 900), (901, 900), (900, 901)]
    label = {x: x for pair in pairs for x in pair}
    for a, b in pairs:
        one, two = label[a], label[b]
        label = {x: min(one, two) if y in (one, two) else y for x, y in label.items()}
    got = [tuple(r) for r in near.stars(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()]
    assert sorted(got) == sorted((x, y) for x, y in label.items() if x != y)


def test_few_tables_are_written_for_a_group_of_near_copies(spark, monkeypatch):
    # every table costs several stages of as many tasks as there are partitions; with 35 tables here the run on check_h was stopped
    monkeypatch.setattr(minhash, "BLOCK", 6)
    written = []
    for module in (minhash, near):
        monkeypatch.setattr(module, "materialize", lambda df, name, f=near.materialize: written.append(name) or f(df, name))
    texts = near_texts(4, 1, 30)
    assert found(docs(spark, texts)) == classes_by_hand(texts, range(len(texts)))
    assert len(written) <= 20


def test_posterior_is_the_tail_of_a_beta_distribution():
    grid = np.linspace(0, 1, 200_001)
    for same, of in ((8, 16), (20, 32), (50, 64)):
        density = comb(of, same) * (of + 1) * grid**same * (1 - grid) ** (of - same)
        assert minhash._posterior(same, of) == pytest.approx(density[160_000:].sum() / 200_000, rel=1e-2)
    i = np.zeros(4000, np.int64)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 16, minhash.HASHES).astype(np.uint16)
    other = np.where(rng.random((4000, minhash.HASHES)) < 0.8, base, base + 1).astype(np.uint16)
    assert len(minhash.survivors(np.vstack([base, other]), i, i + 1 + np.arange(4000))) >= 3995  # pairs at 0.8 stay
    far = np.where(rng.random((4000, minhash.HASHES)) < 0.3, base, base + 1).astype(np.uint16)
    assert len(minhash.survivors(np.vstack([base, far]), i, i + 1 + np.arange(4000))) < 40
