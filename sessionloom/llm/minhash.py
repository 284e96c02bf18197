"""Near-dedup by MinHash bands, with sequential Bayesian verification of the candidates and an exact check of what is left."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, folded_bytes, materialize, remove, table
from .near import _components, _shared, connected, stars
from .words import Words, mix

#: Words of a shingle; sets are linked if 100 times their shared shingles is at least SIMILAR times all of both.
WORDS, SIMILAR = 4, 80
#: A pair at 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, 3 in a million.
BANDS, ROWS = 24, 4
#: Hashes of a signature, those compared at a time, and the posterior probability of a link under which a pair is dropped.
HASHES, BATCH, MISS = 64, 16, 1e-6
#: Sets (and shingles) compared with one another in a task, and sets that all others of a larger group are compared with as well.
BLOCK, BLOCK_SHINGLES, PIVOTS = 512, 500_000, 8
#: A bucket in which more sets than this stay apart from its largest class is dealt out once more, by bands of the signature.
FEW = 2048
_SEEDS = mix(np.arange(1001, 1001 + BANDS * ROWS + HASHES, dtype=np.uint64)) | np.uint64(1)


def _posterior(same: int, of: int, least: float = SIMILAR / 100) -> float:
    """P(similarity >= least) after `same` of `of` hashes agreed, from a uniform prior: the tail of a beta distribution, which is a binomial sum."""
    return sum(comb(of + 1, k) * least**k * (1 - least) ** (of + 1 - k) for k in range(same + 1))


#: Agreeing hashes that a pair needs after each batch.
LEAST = [next(m for m in range(n + 1) if _posterior(m, n) >= MISS) for n in range(BATCH, HASHES + 1, BATCH)]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, a and b (128 bits that name the set of shingles; null without words), n (its size), bands (a hash of each band's
    least values), signature (HASHES least values, 16 bits each)."""

    def run(batches):
        for part in chunks(batches, most_chars=1_000_000):
            n = len(part)
            value, doc = Words(folded_bytes(part["text"])).shingles(WORDS)
            have = np.flatnonzero(np.bincount(doc, minlength=n)) if len(doc) else np.zeros(0, np.int64)
            a, b = pd.array([pd.NA] * n, "Int64"), pd.array([pd.NA] * n, "Int64")
            size, bands, signature = np.zeros(n, np.int64), [None] * n, [None] * n
            if len(have):
                starts = np.searchsorted(doc, have)
                least = np.empty((len(have), len(_SEEDS)), np.uint64)
                for k, seed in enumerate(_SEEDS):
                    least[:, k] = np.minimum.reduceat(value * seed, starts)
                band = np.zeros((len(have), BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band + least[:, r : BANDS * ROWS : ROWS])
                band = mix(band + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)
                low = (least[:, BANDS * ROWS :] >> np.uint64(40)).astype(np.uint16)
                for row, (d, i, j) in enumerate(zip(have.tolist(), starts.tolist(), [*starts[1:].tolist(), len(doc)], strict=True)):
                    own = np.unique(value[i:j])
                    sums = np.array([mix(own).sum(dtype=np.uint64), mix(own ^ _SEEDS[1]).sum(dtype=np.uint64)]) + np.uint64(len(own))
                    a[d], b[d] = mix(sums).view(np.int64).tolist()
                    size[d], bands[d], signature[d] = len(own), band[row], low[row].tobytes()
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "text_key": part["text_key"].array, "a": a, "b": b, "n": size, "bands": bands, "signature": signature})

    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    return own.mapInPandas(run, "doc_id long, text_key long, a long, b long, n long, bands array<long>, signature binary")


def _pairs(low: np.ndarray, high: np.ndarray, most: int = 1 << 20):
    """Every place with each of the places from low to high, some pairs at a time."""
    count = np.maximum(high - low, 0)
    ends, start = np.cumsum(count), 0
    while start < len(count):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        own = count[start:stop]
        yield np.repeat(np.arange(start, stop), own), np.arange(int(own.sum())) + np.repeat(low[start:stop] - np.cumsum(own) + own, own)
        start = stop


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each one's component, of the edges a, b."""
    label = np.arange(n)
    while True:
        one, two = label[a], label[b]
        open_ = one != two
        if not open_.any():
            return label
        a, b, one, two = a[open_], b[open_], one[open_], two[open_]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label[label] != label).any():
            label = label[label]


def survivors(signature: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of the pairs that may be linked: after each batch of hashes those stay whose posterior probability is MISS or more."""
    alive, same = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, least in enumerate(LEAST):
        at = slice(k * BATCH, (k + 1) * BATCH)
        same = same + (signature[i[alive], at] == signature[j[alive], at]).sum(1)
        stay = same >= least
        alive, same = alive[stay], same[stay]
    return alive


def _compare(rows: pd.DataFrame, two_sided: bool) -> pd.DataFrame:
    """Edges of a forest over the sets of each unit that may be linked. two_sided: only rows with `few` meet all others, of another root."""
    rows = rows.sort_values(["unit", "few", "set"] if two_sided else ["unit", "set"], kind="stable")
    sets, signature = rows["set"].to_numpy(), np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(-1, HASHES)
    starts = np.flatnonzero(np.r_[True, np.diff(rows["unit"].to_numpy()) != 0])
    unit = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
    if two_sided:
        few = rows["few"].to_numpy()
        low, high = starts[unit], np.where(few, starts[unit] + np.bincount(unit, ~few)[unit].astype(np.int64), 0)
        root = rows["root"].to_numpy()
    else:
        low, high = np.arange(1, len(rows) + 1), np.r_[starts[1:], len(rows)][unit]
    found = []
    for i, j in _pairs(low, high):
        if two_sided:
            other = root[i] != root[j]
            i, j = i[other], j[other]
        at = survivors(signature, i, j)
        found.append((i[at], j[at]))
    label = _forest(len(rows), *(np.concatenate(x) for x in zip(*found, strict=True))) if found else np.arange(len(rows))
    at = np.flatnonzero(label != np.arange(len(rows)))
    return pd.DataFrame({"a": sets[at], "b": sets[label[at]]}).query("a != b").drop_duplicates()


def _in_blocks(rows: DataFrame, group: str, blocks) -> DataFrame:
    """unit, set: what is compared in a task, a block of a group, with the group's PIVOTS besides if it has several blocks."""
    block = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    rows = rows.select(group, "set", blocks.alias("blocks"))
    place = F.xxhash64("set", F.lit("pivot"))
    pivots = rows.where("blocks > 1").groupBy(group, "blocks").agg(*[F.min(F.when(F.pmod(place, F.lit(PIVOTS)) == i, F.struct(place.alias("h"), "set")))["set"].alias(f"p{i}") for i in range(PIVOTS)])
    pivots = pivots.select(group, "blocks", F.explode(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("set")).where(F.col("set").isNotNull())
    again = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("block") != block)
    return rows.withColumn("block", block).unionByName(again).select(F.xxhash64(group, "block").alias("unit"), "set")


def _few_against_all(rows: DataFrame, group: str, root: DataFrame, most: int | None = None) -> tuple[DataFrame | None, int, DataFrame | None]:
    """What _in_blocks leaves open: sets that aren't in their group's largest class, with all sets of their group. root: of `stars`. Returns rows
    with unit, few and root (None if no group is open) and how many they are, and the groups that have over `most` such sets, if any."""
    rows = rows.join(root.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    sizes = rows.groupBy(group, "root").agg(F.count(F.lit(1)).alias("k")).groupBy(group).agg(F.sum("k").alias("m"), F.max(F.struct("k", "root")).alias("main"))
    open_ = materialize(sizes.where("m > main.k").select(group, "m", (F.col("m") - F.col("main.k")).alias("u"), F.col("main.root").alias("main")), "minhash-open")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    ends = F.lit(True) if most is None else F.col("u") <= most
    size = F.col("m") * blocks("u") + F.col("u") * blocks("m")
    n, wide = open_.agg(F.sum(F.when(ends, size)), F.count(F.when(~ends, 1))).first()
    wide = open_.where(~ends) if wide else None
    if not n:
        return None, 0, wide
    rows = rows.join(open_.where(ends), group)
    place = lambda n: F.pmod(F.xxhash64("set"), blocks(n)).cast("int")
    all_ = rows.withColumn("j", place("m")).withColumn("i", F.explode(F.sequence(F.lit(0), blocks("u") - 1))).withColumn("few", F.lit(False))
    few = rows.where("root <> main").withColumn("i", place("u")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks("m") - 1))).withColumn("few", F.lit(True))
    return all_.unionByName(few.select(all_.columns)).withColumn("unit", F.xxhash64(group, "i", "j")), n, wide


def _in_bins(units: DataFrame, n: int, columns: list[str], function, a_bin: int = 20_000) -> DataFrame:
    """function over bins of whole units; n: about how many rows these have."""
    bins = F.pmod(F.xxhash64("unit"), F.lit(max(8, n // a_bin)))
    return materialize(units.select(*columns).groupBy(bins).applyInPandas(function, "a long, b long"), "minhash-edges")


def candidates(sets: DataFrame) -> DataFrame:
    """a, b: edges that connect all sets which may be linked (sets: set, bands, signature; one row a set).

    Sets that share a band are one bucket. Those of a bucket are compared by their signatures, BATCH hashes at a time, in blocks of BLOCK
    sets and some pivots; of the pairs that may be linked a forest leaves a task. Between blocks only sets that are still apart from the
    bucket's largest class are compared, with all of it, in blocks: a group of any number of near copies is one class by then. Where more
    than FEW sets are apart (a bucket of many unlike texts, as around a very common passage) they are first dealt out again by other bands,
    of the signature. Nothing is capped.
    """
    signed, every = sets.select("set", "signature"), []
    rows = sets.select("set", F.explode("bands").alias("bucket"))
    while True:
        last = bool(every)
        m = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        rows = materialize(rows.join(m, "bucket"), "minhash-buckets")
        units = _in_blocks(rows, "bucket", F.ceil(F.col("m") / BLOCK).cast("int")).join(signed, "set")
        edges = _in_bins(units, rows.count(), ["unit", "set", "signature"], lambda rows: _compare(rows, False))
        large = rows.where(F.col("m") > BLOCK).select("bucket", "set")
        if not large.take(1):
            every.append(edges)
            break
        root = stars(edges)
        every.append(root.select(F.col("node").alias("a"), F.col("root").alias("b")))
        few, n, wide = _few_against_all(large, "bucket", root, None if last else FEW)
        if few is not None:
            every.append(_in_bins(few.join(signed, "set"), n, ["unit", "set", "signature", "few", "root"], lambda rows: _compare(rows, True)))
        if wide is None:
            break
        # 16 bands of 4: of pairs at 0.8 that share a wide bucket, all but 2 in 10,000 share one of these as well
        value = lambda k: F.substring("signature", 2 * k + 1, 2)
        bands = F.array(*[F.xxhash64(F.lit(k), *[value(k + i) for i in range(ROWS)]) for k in range(0, HASHES, ROWS)])
        rows = large.join(wide.select("bucket"), "bucket").select("set").distinct().join(signed, "set").select("set", F.explode(bands).alias("bucket"))
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out


def _links(rows: pd.DataFrame, two_sided: bool) -> pd.DataFrame:
    """Edges of a forest of links over the sets of each unit, by all of their shingles."""
    out = []
    for _, own in rows.groupby("unit", sort=False):
        own = own.drop_duplicates(["set", "few"] if two_sided else "set").sort_values("set")
        if len(own) < 2:
            continue
        sets = [np.frombuffer(v, np.uint64) for v in own["shingles"]]
        n, both, ids = np.array([len(s) for s in sets]), np.rint(_shared(sets)).astype(np.int64), own["set"].to_numpy()
        linked = 100 * both >= SIMILAR * (n[:, None] + n - both)
        if two_sided:
            few, root = own["few"].to_numpy(), own["root"].to_numpy()
            linked &= (few[:, None] != few) & (root[:, None] != root)
        label = _components(len(sets), linked)
        out.append(pd.DataFrame({"a": ids, "b": ids[label]}))
    return pd.concat(out).query("a != b") if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def linked(docs: DataFrame, sets: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root (as of stars): classes of the sets that links connect, confirmed on all shingles. Sets that edges connect (a component) are compared in blocks
    and with pivots, then what is apart from the component's largest class with all of it."""
    component = connected(edges).select(F.col("node").alias("set"), F.col("root").alias("component"))
    own = sets.select("set", "n", F.col("first.doc_id").alias("own_id"), F.col("first.text_key").alias("own_key"))
    members = materialize(component.join(own, "set"), "minhash-members")
    blocks = members.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks_"))

    def shingle(batches):
        for part in chunks(batches):
            value, doc = Words(folded_bytes(part["text"])).shingles(WORDS)
            cut = np.searchsorted(doc, np.arange(1, len(part)))
            yield part[["set"]].assign(shingles=[np.unique(v).tobytes() for v in np.split(value, cut)])

    # always a merge join: members are a share of all documents
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(members.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))).select("set", "text")
    shingles = materialize(texts.mapInPandas(shingle, "set long, shingles binary").dropDuplicates(["set"]), "minhash-shingles")
    rows = materialize(members.join(blocks, "component").select("set", "component", "blocks_"), "minhash-rows")
    units = _in_blocks(rows, "component", F.col("blocks_"))
    found = _in_bins(units.join(shingles, "set"), rows.count(), ["unit", "set", "shingles"], lambda rows: _links(rows, False), 2000)
    classes = stars(found)
    large = rows.where("blocks_ > 1").select("component", "set")
    if large.take(1):
        few, n, _ = _few_against_all(large, "component", classes)
        if few is not None:
            more = _in_bins(few.join(shingles, "set"), n, ["unit", "set", "shingles", "few", "root"], lambda rows: _links(rows, True), 2000)
            classes = stars(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    remove(members, rows, shingles)
    return classes


def near_dedup(docs: DataFrame) -> DataFrame:
    """Each document's class of near copies: doc_id, n_shingles, component_id, kept.

    docs: doc_id, text; other columns aren't read. Words are parted by ASCII white space, A to Z folded; a set is a text's distinct WORDS-word
    shingles, or the whole sequence where it has fewer words. Documents with the same set are one from the start. component_id is the least
    doc_id that links reach, the own included; kept tells that it is the own. A text without words (null, empty) is linked with nothing.
    A null doc_id is greater than every other: a class of null ids alone has a null component_id, and all its rows are kept. Rows that
    repeat a kept doc_id are kept too. An empty table gives no rows.
    """
    seen = materialize(signatures(docs), "minhash-signatures")
    sets = seen.where(F.col("a").isNotNull()).groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    sets = materialize(sets.withColumn("set", F.monotonically_increasing_id()), "minhash-sets")  # written once, so the numbers stay
    root = linked(docs, sets, candidates(sets))
    classes = sets.select("set", "a", "b", "least").join(root.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    classes = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("a", "b", "component_id")
    out = seen.select("doc_id", "a", "b", F.col("n").alias("n_shingles")).join(classes, ["a", "b"], "left")
    component = F.when(F.col("a").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_dedup of all documents: null and empty texts are classes of their own, repeated rows are copies, a null id comes after all others,
    an empty table gives no rows, other columns aren't read."""
    return near_dedup(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [ws] ELSE list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: ws[i:i + {WORDS - 1}]) END) AS s FROM w),
each AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5(unnest(s)::VARCHAR) AS h FROM sets),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM each x JOIN each y ON x.h = y.h AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {SIMILAR} * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sets s JOIN least ON s.doc_id = a
"""
