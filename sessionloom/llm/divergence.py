"""How far the sources of a language diverge in their terms: terms of whitespace chunks, each distinct chunk tokenized once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, remove, table
from .filters import holds, key_filter
from .words import Words, mix

#: A term: letters of ASCII and everything outside ASCII. A to Z are folded.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a kept term is in; smoothing and scale of shares; terms a report names.
LEAST_DOCS, PRIOR, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50
#: Characters of texts whose chunks are counted together.
BLOCK_CHARS = 8_000_000
#: Terms (by hash) and sources of one comparison of shares.
TERMS_A_BIN, SOURCES_A_BLOCK = 2000, 128


def _read(docs: DataFrame) -> DataFrame:
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), F.xxhash64(lang, source).alias("g"), F.col("text").cast("binary").alias("text"))


def _blocks(batches):
    """row, lang, lang_key, g and text of some documents, as lists, by blocks of BLOCK_CHARS."""
    held, chars = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            held.append(row)
            chars += len(row[-1] or b"")
            if chars >= BLOCK_CHARS:
                yield tuple(zip(*held, strict=True))
                held, chars = [], 0
    if held:
        yield tuple(zip(*held, strict=True))


def _chunks(texts: tuple, lang_keys: tuple, seed: int) -> tuple[Words, np.ndarray]:
    """The chunks of texts, and a hash of each and of its language."""
    words = Words([t or b"" for t in texts])
    salt = mix(np.array(lang_keys, np.int64).view(np.uint64) ^ np.uint64(seed))
    return words, mix(words.hash ^ salt[words.doc])


def _grouped(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by value, and for each place in it the number of its value."""
    order = np.argsort(value)
    new = np.zeros(len(order), np.int64)
    new[1:] = value[order[1:]] != value[order[:-1]]
    return order, np.cumsum(new)


def chunk_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, chunk, h (a hash of both), docs (documents with it): the distinct chunks of each document, added up within blocks of texts."""

    def run(batches):
        for _, langs, lang_keys, _, texts in _blocks(batches):
            words, h = _chunks(texts, lang_keys, seed)
            order, at = _grouped(h)
            code = np.sort((at << 32) | words.doc[order])
            n = np.bincount(code[np.r_[True, code[1:] != code[:-1]]] >> 32) if len(code) else np.zeros(0, np.int64)
            some = order[np.flatnonzero(np.r_[True, at[1:] != at[:-1]])] if len(order) else order
            begin, length = words.begin[some], words.length[some]
            ends = np.cumsum(length)
            place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + length, length)
            chunk = pa.StringArray.from_buffers(len(some), pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(words.data[place]))
            names = sorted(set(langs))
            number = {x: k for k, x in enumerate(names)}
            lang = pa.DictionaryArray.from_arrays(pa.array(np.array([number[x] for x in langs], np.int32)[words.doc[some]]), pa.array(names, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, chunk, pa.array(h[some].view(np.int64)), pa.array(n, pa.int64())], names=["lang", "chunk", "h", "docs"])

    return _read(docs).mapInArrow(run, "lang string, chunk string, h long, docs long")


def document_chunks(docs: DataFrame, seed: int, passed) -> DataFrame:
    """h, row: the chunks of each document that the filter passes."""

    def run(batches):
        for rows, _, lang_keys, _, texts in _blocks(batches):
            words, h = _chunks(texts, lang_keys, seed)
            at = np.flatnonzero(holds(passed.value, h))
            order, number = _grouped(h[at])
            code = np.sort((number << 32) | words.doc[at[order]])
            code = code[np.r_[True, code[1:] != code[:-1]]] if len(code) else code
            value = h[at[order[np.flatnonzero(np.r_[True, number[1:] != number[:-1]])]]] if len(order) else h[at]
            yield pa.RecordBatch.from_arrays([pa.array(value[code >> 32].view(np.int64)), pa.array(np.array(rows, np.int64)[code & 0xFFFFFFFF])], names=["h", "row"])

    return _read(docs).mapInArrow(run, "h long, row long")


def source_counts(docs: DataFrame, seed: int, kept) -> DataFrame:
    """h, g (a hash of language and source), n: occurrences of the chunks that the filter `kept` passes, added up within blocks of texts."""

    def run(batches):
        for _, _, lang_keys, g, texts in _blocks(batches):
            words, h = _chunks(texts, lang_keys, seed)
            pass_ = np.flatnonzero(holds(kept.value, h))
            h = h[pass_]
            names, number = np.unique(np.array(g, np.int64), return_inverse=True)
            order, at = _grouped(h)
            code = np.sort((at << 32) | number[words.doc[pass_[order]]])
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else code
            value = h[order[np.flatnonzero(np.r_[True, at[1:] != at[:-1]])]] if len(order) else h
            own = code[starts]
            yield pa.RecordBatch.from_arrays([pa.array(value[own >> 32].view(np.int64)), pa.array(names[own & 0xFFFFFFFF]), pa.array(np.diff(np.r_[starts, len(code)]))], names=["h", "g", "n"])

    return _read(docs).mapInArrow(run, "h long, g long, n long")


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n: occurrences of each kept term, where there are any. A term is kept in a language if at least least_docs documents
    have it.

    Chunks are counted document by document, each distinct chunk is tokenized once, and its terms are joined back. A chunk that is in enough
    documents settles its terms; so do chunks that are not in enough all together. Only for terms in between, whose chunks are all rare,
    their documents are looked up and told apart. The chunks of kept terms are then counted for each source. Chunks go to their terms by
    a hash, once that is checked to part them all. Hot chunks are a few counted rows a block, and all joins are by chunk or term."""
    once = F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), F.lit(0))
    for seed in range(1, 9):
        # all rows of a chunk are in one partition, where its terms are found once for all languages
        chunks = chunk_counts(docs, seed).repartition("chunk").groupBy("chunk", "lang", "h").agg(F.sum("docs").alias("docs"))
        chunks = chunks.groupBy("chunk").agg(F.collect_list(F.struct("lang", "h", "docs")).alias("own")).select("own", F.xxhash64("chunk").alias("id"), once.alias("terms"))
        times = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("times")))
        each = chunks.select("own", "id", F.explode_outer(times).alias("x")).select(F.explode("own").alias("o"), "id", "x").select("o.lang", "o.h", "o.docs", "id", "x.term", "x.times")
        each = materialize(each, "divergence-chunks", "zstd")
        one = F.xxhash64("id", "lang")
        if not each.groupBy("h").agg(F.min(one).alias("least"), F.max(one).alias("most")).where("least <> most").take(1):
            break
    else:
        raise ValueError("no seed parts the hashes of all chunks")
    bounds = each.where("term is not null").groupBy("lang", "term").agg(F.max("docs").alias("low"), F.sum("docs").alias("high")).where(F.col("high") >= least_docs)
    of = each.join(bounds.select("lang", "term", (F.col("low") < least_docs).alias("open")), ["lang", "term"]).select("h", "lang", "term", "times", "open")
    of = materialize(of, "divergence-terms", "zstd")
    open_ = of.where("open")
    found = document_chunks(docs, seed, key_filter(open_, ["h"])).join(open_, "h").select("lang", "term", "row").distinct()
    settled = found.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term")
    kept = materialize(of.where("not open").unionByName(open_.join(settled, ["lang", "term"], "left_semi")).drop("open"), "divergence-kept", "zstd")
    remove(each, of)
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct().withColumn("g", F.xxhash64("lang", "source"))
    # rows of a chunk travel together: they are added up, and meet the chunk's terms, without another shuffle
    n = source_counts(docs, seed, key_filter(kept, ["h"])).repartition("h").groupBy("h", "g").agg(F.sum("n").alias("n"))
    terms = n.join(kept.hint("merge"), "h").groupBy("g", "lang", "term").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    out = terms.join(groups.select("g", "source", F.col("lang").alias("lang_")), "g").where("lang = lang_").select("lang", "source", "term", "n")
    return materialize(out, "divergence-kept-counts", "zstd")


def _share(n, total, kept):
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), in whole numbers of up to 38 places."""
    wide = lambda x: x.cast("decimal(19,0)")
    above = (wide(n) + F.lit(PRIOR).cast("decimal(19,0)")).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)")
    below = (wide(total) + wide(kept) * F.lit(PRIOR).cast("decimal(2,0)")).cast("decimal(22,0)")
    return F.call_function("div", above.cast("decimal(32,0)"), below).cast("long") + 1


def _distances(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of the distances of the shares of every two sources, over the terms that the rows of a unit have, and their number."""
    out = []
    for (lang, i, j), own in rows.groupby(["lang", "i", "j"], sort=False):
        source, names = pd.factorize(own["source"])
        term, _ = pd.factorize(own["term"])
        shares = np.zeros((len(names), term.max() + 1), np.int64)
        shares[:] = own.groupby(source)["p0"].first().to_numpy()[:, None]
        shares[source, term] = own["p"]
        block = own.groupby(source)["block"].first().to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for a in left:
            value = np.abs(shares[right] - shares[a]).sum(1)
            out.append(pd.DataFrame({"lang": lang, "source": names[a], "item": names[right], "value": value, "seen": shares.shape[1]}))
    got = pd.concat(out) if out else pd.DataFrame({"lang": [], "source": [], "item": [], "value": [], "seen": []}).astype({"lang": str, "source": str, "item": str})
    return got[got["source"] != got["item"]]


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and the terms it has more of.

    docs: lang, source, text (null is ''); other columns aren't read. Shares of the kept terms are smoothed and whole numbers. Part `pair`: the
    sum of the distances of all shares to each other source of the language, all of them; part `term`: the MOST_TERMS terms whose share is
    furthest above the language's. Ties are by item, as UTF-8. A source without terms still has smoothed shares; a language without kept
    terms has distances of 0. Repeated rows are documents of their own; an empty table gives no rows.

    Distances are counted for bins of terms and blocks of sources, so that a unit has at most about TERMS_A_BIN terms and two blocks of
    SOURCES_A_BLOCK sources; terms that neither of two blocks has add the distance of the shares of a count of 0.
    """
    counts = term_counts(docs)
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    language = counts.groupBy("lang").agg(F.countDistinct("term").alias("kept"), F.sum("n").alias("lang_total"))
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    size = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES_A_BLOCK).cast("int").alias("blocks"))
    of = groups.join(language, "lang", "left").join(total, ["lang", "source"], "left").join(size, "lang").fillna(0, ["kept", "lang_total", "total"])
    p0 = F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0)
    of = materialize(of.withColumn("p0", p0).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")), "divergence-groups")
    shares = counts.join(of, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))

    bins = F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS_A_BIN)).cast("int")
    unit = shares.select("lang", "source", "block", "term", "p", "p0", F.pmod(F.xxhash64("term"), bins).alias("bin"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    unit = unit.withColumn("pair", F.when(F.col("block") == F.col("other"), F.array(F.struct(F.col("block").alias("i"), F.col("other").alias("j")))).otherwise(F.array(F.struct(F.col("block").alias("i"), F.col("other").alias("j")), F.struct(F.col("other").alias("i"), F.col("block").alias("j")))))
    unit = unit.select("lang", "source", "block", "term", "p", "p0", "bin", F.explode("pair").alias("x")).select("*", "x.i", "x.j").drop("x")
    part = unit.groupBy("lang", "bin", "i", "j").applyInPandas(_distances, "lang string, source string, item string, value long, seen long")
    seen = part.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # every two sources of a language are rows of the result
    one, two = of.select("lang", "source", "kept", F.col("p0").alias("one")), of.select("lang", F.col("source").alias("item"), F.col("p0").alias("two"))
    pairs = one.join(two, "lang").where("source <> item").join(seen, ["lang", "source", "item"], "left")
    value = F.coalesce("value", F.lit(0)) + (F.col("kept") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("one") - F.col("two"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(language, "lang").select("lang", "term", _share(F.col("n"), F.col("lang_total"), F.col("kept")).alias("q"))
    terms = shares.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(best))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= MOST_TERMS))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """divergence of all documents; nulls are '', repeated rows count, an empty table gives no rows, other columns aren't read."""
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
each AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY lang, source, term),
full_ AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT f.lang, f.source, f.term, f.n,
    CAST(1 + ({SCALE}::HUGEINT * (f.n + {PRIOR})) // (sum(f.n) OVER (PARTITION BY f.lang, f.source) + {PRIOR} * v.v) AS BIGINT) AS p
  FROM full_ f JOIN v ON f.lang = v.lang),
lt AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term),
q AS (
  SELECT lt.lang, lt.term, CAST(1 + ({SCALE}::HUGEINT * (lt.n + {PRIOR})) // (sum(lt.n) OVER (PARTITION BY lt.lang) + {PRIOR} * v.v) AS BIGINT) AS q
  FROM lt JOIN v ON lt.lang = v.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= {MOST_TERMS}
"""
