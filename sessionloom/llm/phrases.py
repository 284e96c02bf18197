"""Collocations by best-first growth: phrases are counted only where the counts of their first and last words still let them be among the best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table
from .filters import holds, key_filter, key_of
from .words import KEY_BYTES, Words, keys_of, mix, powers

#: Occurrences of a candidate; share (in hundredths) of them within a longer candidate at which it goes; phrases of a language.
LEAST, INSIDE, BEST = 30, 80, 2000
SCALE, LONGEST = 2_000_000, 4
#: Pairs of words of a language that the first round follows, in multiples of BEST; each further round follows GROWTH times as many.
START, GROWTH = 2, 4
#: Characters of texts whose phrases are counted together.
BLOCK_CHARS = 5_000_000
_CUTS = np.zeros(256, bool)
_CUTS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS = _CUTS.copy()
_GAPS[[9, 32]] = True


class _Pieces(Words):
    """Words of texts with the piece that each is in."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, seed: int):
        """langs: a hash of each text's language, which the words' hashes hold too."""
        super().__init__(texts, _GAPS)
        self.piece = np.cumsum(_CUTS[self.data], dtype=np.int32)[self.begin] if len(self.begin) else np.zeros(0, np.int64)
        low, high = keys_of(self.data, self.begin, self.length) if len(self.begin) else (np.zeros(0, np.uint64),) * 2
        own = mix(low ^ mix(high ^ np.uint64(seed)))
        long = np.flatnonzero(self.length > KEY_BYTES)
        if len(long):
            size = self.length[long]
            at = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(at, size)
            values = mix(self.data[place + np.repeat(self.begin[long], size)].astype(np.uint64) + np.uint64(seed + 1)) * powers(int(size.max()))[place]
            own[long] = mix(own[long] ^ np.add.reduceat(values, at))
        self.hash = mix(own ^ langs[self.doc]) if len(own) else own

    def runs(self, n: int) -> np.ndarray:
        """Places at which n words of a piece begin."""
        k = len(self.hash) - n + 1
        return np.flatnonzero(self.piece[:k] == self.piece[n - 1 :]) if k > 0 else np.zeros(0, np.int64)


def _blocks(batches):
    """Texts (bytes, A to Z folded), languages and hashes of languages, by blocks of BLOCK_CHARS."""
    texts, langs, hashes, chars = [], [], [], 0
    for batch in batches:
        for lang, hash_, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            texts.append((text or b"").lower())
            langs.append(lang)
            hashes.append(hash_)
            chars += len(text or b"")
            if chars >= BLOCK_CHARS:
                yield texts, langs, np.array(hashes, np.int64).view(np.uint64)
                texts, langs, hashes, chars = [], [], [], 0
    if texts:
        yield texts, langs, np.array(hashes, np.int64).view(np.uint64)


def _read(docs: DataFrame) -> DataFrame:
    lang = F.coalesce("lang", F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("hash"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, w1 (a hash of both), f: how often the words of each language occur."""

    def run(batches):
        for texts, langs, hashes in _blocks(batches):
            words = _Pieces(texts, hashes, seed)
            value, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            begin, length = words.begin[first], words.length[first]
            ends = np.cumsum(length)
            place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + length, length)
            word = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(words.data[place]))
            names, code = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
            lang = pa.DictionaryArray.from_arrays(pa.array(code[words.doc[first]], pa.int32()), pa.array(names.tolist(), pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, word, pa.array(value.view(np.int64)), pa.array(n)], names=["lang", "word", "w1", "f"])

    counted = _read(docs).mapInArrow(run, "lang string, word string, w1 long, f long")
    return counted.groupBy("lang", "word", "w1").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, n: int, seed: int, either: list, both: list | None = None) -> DataFrame:
    """w1 ... wn, a: phrases of n words with LEAST occurrences or more, of those whose first or last n - 1 words either[0] or either[1] holds,
    or of which both[0] holds the first and both[1] the last n - 1 words. Filters pass more than they hold at times; what is counted is
    counted in full. For n = 2 the filters are of words, and both words must pass."""

    def run(batches):
        for texts, _, hashes in _blocks(batches):
            words = _Pieces(texts, hashes, seed)
            at = words.runs(n)
            parts = [words.hash[at + k] for k in range(n)]
            ask = lambda filters: (holds(filters[0].value, *parts[:-1]), holds(filters[1].value, *parts[1:]))
            one, two = ask(either)
            keep = one & two if n == 2 else one | two
            if both:
                one, two = ask(both)
                keep |= one & two
            parts = [p[keep] for p in parts]
            order = np.argsort(key_of(*parts), kind="stable")
            parts = [p[order] for p in parts]
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([p[1:] != p[:-1] for p in parts]) if len(order) > 1 else new[1:]
            starts = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([*[pa.array(p[starts].view(np.int64)) for p in parts], pa.array(np.diff(np.r_[starts, len(order)]))], names=[*names, "a"])

    names = [f"w{k}" for k in range(1, n + 1)]
    counted = _read(docs).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "a"]))
    return counted.groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= LEAST)


def _score(a, l, r):
    """floor(SCALE * a / (l + r)), in whole numbers of up to 38 places."""
    above = a.cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(8,0)")
    return F.call_function("div", above.cast("decimal(28,0)"), (l + r).cast("decimal(28,0)"))


def _bounded(phrases: DataFrame, first, last) -> DataFrame:
    """Adds the best score of a phrase that begins (up) or ends (down) with these words and one or more others: it occurs `a` times at most, and
    is cut behind its first or before its last word among others."""
    return phrases.withColumns({"up": _score(F.col("a"), first, F.col("a")), "down": _score(F.col("a"), last, F.col("a"))})


def _scored(phrases: DataFrame, n: int, counts: dict[int, DataFrame]) -> DataFrame:
    """Adds f1 and fn (its first and last word's counts), k, l, r and score of the lowest-scoring cut. A phrase of which a part isn't counted can't
    reach the score that is looked for (part of its bound), and gets none."""
    names = [f"w{k}" for k in range(1, n + 1)]
    for size in range(1, n):
        for at, what in ((1, "l"), (n - size + 1, "r")):
            to = {f"w{k}": f"w{at + k - 1}" for k in range(1, size + 1)}
            part = counts[size].select(*[F.col(a).alias(b) for a, b in to.items()], F.col("f" if size == 1 else "a").alias(f"{what}{size}"))
            phrases = phrases.join(part, list(to.values()), "inner" if size == 1 else "left")
    cuts = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{n - k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{n - k}").alias("r")) for k in range(1, n)]
    known = F.lit(True)
    for k in range(1, n):
        known = known & F.col(f"l{k}").isNotNull() & F.col(f"r{k}").isNotNull()
    least = F.when(known, F.array_min(F.array(*cuts)))
    return phrases.withColumn("cut", least).select(*names, "a", F.col("l1").alias("f1"), F.col("r1").alias("fn"), "cut.score", "cut.l", "cut.r")


def _without_inner(phrases: DataFrame, longer: DataFrame, n: int) -> DataFrame:
    """Phrases (n words) that no longer candidate holds INSIDE hundredths of. One word more is enough to look at: what is inside a phrase is at
    least as frequent."""
    names = [f"w{k}" for k in range(1, n + 1)]
    ends = [longer.select(*[F.col(f"w{k + shift}").alias(f"w{k}") for k in range(1, n + 1)], F.col("a").alias("outer")) for shift in (0, 1)]
    most = ends[0].unionByName(ends[1]).groupBy(*names).agg(F.max("outer").alias("outer"))
    return phrases.join(most, names, "left").where(F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * INSIDE)).drop("outer")


def collocations(docs: DataFrame, best: int = BEST, start: int = START) -> DataFrame:
    """Each language's `best` collocations: lang, rank, phrase, a, l, r, n, score.

    docs: lang (null is `und`), text (null is empty); other columns aren't read. Phrases have 2 to 4 words of a piece of text and LEAST
    occurrences; the score is that of the cut at which it is lowest. Those mostly inside a longer candidate go.

    Growth is best-first. Words and pairs of words are counted. A longer phrase occurs at most as often as those it begins or ends with, which bounds its
    score; only phrases whose bounds reach a score t are counted, along with all that hold a phrase with a score of t by one word more. So all candidates of score t or more are known,
    and which of them go. t is first the score of a language's start * best-th pair; where fewer than
    `best` phrases are left at t, the frontier grows GROWTH times and the language is counted again, until its best-th phrase, ties included,
    is settled or nothing is left to follow. All counts are exact: words are known by hashes that are checked to be distinct. Languages with
    fewer phrases give fewer; repeated rows count; an empty table gives no rows.
    """
    for seed in range(1, 9):
        words = materialize(word_counts(docs, seed), "phrases-words", "zstd")
        if not words.groupBy("w1").agg(F.count(F.lit(1)).alias("k")).where("k > 1").take(1):
            break
    else:
        raise ValueError("no seed parts the hashes of all words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = materialize(words.where(F.col("f") >= LEAST), "phrases-frequent", "zstd")
    known = key_filter(frequent, ["w1"])
    pairs = phrase_counts(docs, 2, seed, [known, known])
    own = frequent.select(F.col("w1"), F.col("lang"))
    pairs = materialize(_bounded(_scored(pairs, 2, {1: frequent}).join(own, "w1"), F.col("f1"), F.col("fn")), "phrases-pairs", "zstd")

    place = Window.partitionBy("lang").orderBy(F.desc("score"))
    open_, follow, settled = frequent.select("lang").distinct(), start * best, []
    while True:
        # each open language's score t, a row a language
        nth = pairs.join(open_, "lang").withColumn("place", F.row_number().over(place)).where(F.col("place") <= follow)
        t = nth.groupBy("lang").agg(F.count(F.lit(1)).alias("k"), F.min("score").alias("t"))
        t = materialize(open_.join(t, "lang", "left").select("lang", F.when(F.col("k") >= follow, F.col("t")).otherwise(0).cast("long").alias("t")), "phrases-bounds")
        two = pairs.join(t, "lang")
        either = [key_filter(two.where("up >= t"), ["w1", "w2"]), key_filter(two.where("down >= t"), ["w1", "w2"])]
        three = _scored(phrase_counts(docs, 3, seed, either), 3, {1: frequent, 2: pairs})
        three = materialize(_bounded(three.join(own, "w1").join(t, "lang"), F.col("f1"), F.col("fn")), "phrases-threes", "zstd")
        inner = key_filter(three.where("score >= t"), ["w1", "w2", "w3"])
        four = phrase_counts(docs, 4, seed, [inner, inner], [key_filter(three.where("up >= t"), ["w1", "w2", "w3"]), key_filter(three.where("down >= t"), ["w1", "w2", "w3"])])
        four = materialize(_scored(four, 4, {1: frequent, 2: pairs, 3: three}).join(own, "w1").join(t, "lang"), "phrases-fours", "zstd")
        found = []
        for n, phrases, longer in ((2, two, three), (3, three, four), (4, four, None)):
            left = phrases.where("score >= t")
            left = left if longer is None else _without_inner(left, longer, n)
            found.append(left.select("lang", "t", *[F.col(f"w{k}") if k <= n else F.lit(None).cast("long").alias(f"w{k}") for k in range(1, LONGEST + 1)], "a", "l", "r", "score"))
        found = materialize(found[0].unionByName(found[1]).unionByName(found[2]), "phrases-found", "zstd")
        got = t.join(found.groupBy("lang").agg(F.count(F.lit(1)).alias("got")), "lang", "left")
        short = materialize(got.where((F.coalesce("got", F.lit(0)) < best) & (F.col("t") > 0)).select("lang"), "phrases-open")
        settled.append(found.join(short, "lang", "left_anti"))
        if not short.take(1):
            break
        open_, follow = short, follow * GROWTH
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    # only phrases that score no less than the best-th need their words
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    out = out.withColumn("place", F.rank().over(order)).where(F.col("place") <= best)
    for k in range(1, LONGEST + 1):
        out = out.join(frequent.select(F.col("w1").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    out = out.withColumn("phrase", F.concat_ws(" ", *[f"word{k}" for k in range(1, LONGEST + 1)])).join(total, "lang")
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= best)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collocations of all documents: a null lang is `und`, null texts are empty, repeated rows count, an empty table gives no rows, other columns
    aren't read."""
    return collocations(table(spark, sf_dir, "documents"))


def _grams(n: int) -> str:
    words = [f"list_extract(ws, i + {k})" for k in range(n)]
    cuts = [f"concat_ws(' ', {', '.join(words[:k])})" for k in range(1, n)]
    rest = [f"concat_ws(' ', {', '.join(words[k:])})" for k in range(1, n)]
    return f"SELECT lang, {n} AS size, concat_ws(' ', {', '.join(words)}) AS p, [{', '.join(cuts)}]::VARCHAR[] AS firsts, [{', '.join(rest)}]::VARCHAR[] AS rests FROM (SELECT lang, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM pieces WHERE len(ws) >= {n})"


OP12_SQL = rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)),
f AS MATERIALIZED (SELECT lang, p, any_value(size) AS size, any_value(firsts) AS firsts, any_value(rests) AS rests, count(*) AS a FROM ({" UNION ALL ".join(_grams(n) for n in range(1, LONGEST + 1))}) GROUP BY lang, p),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
often AS MATERIALIZED (SELECT * FROM f WHERE a >= {LEAST}),
c AS MATERIALIZED (SELECT * FROM often WHERE size > 1),
inner_ AS MATERIALIZED (
  SELECT lang, part, max(a) AS outer_ FROM (SELECT lang, a, unnest([firsts[size - 1], rests[1]]) AS part FROM c WHERE size > 2) GROUP BY lang, part),
cuts AS MATERIALIZED (SELECT lang, p, a, unnest(range(1, size)) AS k, unnest(firsts) AS one, unnest(rests) AS two FROM c),
scored AS (
  SELECT c.lang, c.p, c.a, k, x.a AS l, y.a AS r, ({SCALE}::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.p = c.one JOIN often y ON y.lang = c.lang AND y.p = c.two),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS nth FROM scored),
best AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.p) AS rank, s.p AS phrase, a, l, r, CAST(score AS BIGINT) AS score
  FROM least s LEFT JOIN inner_ i ON i.lang = s.lang AND i.part = s.p WHERE nth = 1 AND (outer_ IS NULL OR 100 * outer_ < {INSIDE} * a))
SELECT best.lang, rank, phrase, a, l, r, n, score FROM best JOIN total ON best.lang = total.lang WHERE rank <= {BEST}
"""
