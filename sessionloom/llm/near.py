"""Similarity join on word shingles by chosen paths, and the classes of near duplicates that follow from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fresh, materialize, remove, table, texts_of
from .words import Words, mix

WORDS, SIMILAR = 5, 0.8
#: Coordinates of a sketch, and coordinates that a node splits on. A pair at 0.8 shares a node of one run with probability over 0.93 at any
#: depth (1 - (1 - 0.8 q) squared = q for two coordinates).
COORDINATES, SPLITS = 64, 2
#: Runs are added until this share of planted pairs at SIMILAR meets in one; about so many sets at most get a planted partner; most runs.
RECALL, PLANTED, MOST_RUNS = 0.999, 2000, 6
#: Levels that all sets walk before nodes are looked at.
START = 2
#: Nodes of at most SMALL sets are compared pair by pair; what is still larger after DEPTH splits is compared in blocks. Blocks of an exact
#: comparison have BLOCK sets or BLOCK_SHINGLES shingles.
SMALL, DEPTH, BLOCK, BLOCK_SHINGLES = 64, 8, 512, 500_000
#: Sets that all others of a large node are compared with. A node in which at most FEW sets aren't linked to them, or of at most 2 * FEW sets,
#: ends there.
PIVOTS, FEW = 8, 1000
#: Sets whose sketches agree in this share of places may be at 0.8 (5 standard deviations below).
MAYBE = 0.55
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, a and b (two 64-bit hashes of the set of shingles; null without words), n (its size), sketch (the least value of
    each of COORDINATES permutations of it)."""

    def run(batches):
        for part in chunks(batches):
            words = Words(texts_of(part["text"]))
            value, doc = words.shingles(WORDS)
            n = len(part)
            have = np.flatnonzero(np.bincount(doc, minlength=n)) if len(doc) else np.zeros(0, np.int64)
            sketch, size = [None] * n, np.zeros(n, np.int64)
            a, b = pd.array([pd.NA] * n, "Int64"), pd.array([pd.NA] * n, "Int64")
            if len(have):
                starts = np.searchsorted(doc, have)
                least = np.empty((len(have), COORDINATES), np.uint32)
                for k in range(COORDINATES):
                    least[:, k] = np.minimum.reduceat(value * _SEEDS[k], starts) >> np.uint64(32)
                for row, (d, low, high) in enumerate(zip(have.tolist(), starts.tolist(), [*starts[1:].tolist(), len(doc)], strict=True)):
                    own = np.unique(value[low:high])
                    sums = np.array([mix(own).sum(dtype=np.uint64), mix(own ^ _SEEDS[1]).sum(dtype=np.uint64)]) + np.uint64(len(own))
                    a[d], b[d] = mix(sums).astype(np.int64).tolist()
                    size[d], sketch[d] = len(own), least[row].view(np.int32)
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "row_key": part["row_key"].array, "a": a, "b": b, "n": size, "sketch": sketch})

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInPandas(run, "doc_id long, row_key long, a long, b long, n long, sketch array<int>")


def _children(node, sketch, level: int):
    """The nodes to which a set goes from a node, by the values of its sketch at coordinates that the node chooses."""

    def child(k):
        at = F.pmod(F.xxhash64(node, k, F.lit(level)), F.lit(COORDINATES)).cast("int")
        return F.xxhash64(node, k, F.element_at(sketch, at + 1))

    return F.transform(F.sequence(F.lit(0), F.lit(SPLITS - 1)), child)


def _first_nodes(sketch, run):
    """A set's nodes of a run after START levels."""
    nodes = F.array(F.xxhash64(run))
    for level in range(START):
        nodes = F.flatten(F.transform(nodes, _walk(sketch, level)))
    return nodes


def _walk(sketch, level: int):
    return lambda node: _children(node, sketch, level)


def runs_for(sets: DataFrame, target: float = RECALL) -> int:
    """How many runs find `target` of the pairs at SIMILAR: measured on planted pairs, each a set's sketch and one in which every place is
    kept with probability SIMILAR. A bounded sample of the sets is planted."""
    some = sets.select("set", "sketch").where(F.pmod(F.xxhash64("set"), F.lit(max(1, sets.count() // PLANTED))) == 0)
    keep = lambda x, i: F.when(F.pmod(F.xxhash64("set", F.lit("planted"), i), F.lit(1000)) < int(1000 * SIMILAR), x).otherwise(F.hash("set", i))
    both = some.withColumn("other", F.transform("sketch", keep))
    met = [F.arrays_overlap(_first_nodes(F.col("sketch"), F.lit(r)), _first_nodes(F.col("other"), F.lit(r))) for r in range(MOST_RUNS)]
    found = both.select(F.array_position(F.array(*met), True).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()
    total, by = sum(r["n"] for r in found), {r["run"]: r["n"] for r in found}
    return next((k for k in range(1, MOST_RUNS + 1) if sum(by.get(r, 0) for r in range(1, k + 1)) >= target * total), MOST_RUNS)


def _agree(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / COORDINATES


def _components(n: int, linked: np.ndarray) -> np.ndarray:
    """Least member of each one's component; linked: n by n."""
    label = np.arange(n)
    while True:
        least = np.where(linked, label, n).min(1)
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _compare_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges of a forest over those sets of each node whose sketches agree enough."""
    out = []
    for _, own in rows.groupby("node", sort=False):
        if len(own) < 2:
            continue
        sets, s = own["set"].to_numpy(), np.array(own["sketch"].tolist(), np.int32)
        same = np.zeros((len(s), len(s)), np.uint8)
        for k in range(s.shape[1]):
            same += s[:, k, None] == s[None, :, k]
        label = _components(len(s), same >= MAYBE * COORDINATES)
        at = np.flatnonzero(label != np.arange(len(s)))
        out += zip(sets[at].tolist(), sets[label[at]].tolist(), strict=True)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def candidate_edges(sets: DataFrame, runs: int) -> DataFrame:
    """a, b: edges that connect all sets which may be similar (set, sketch; one row a set), few for each set.

    Chosen paths: every node of the tree picks SPLITS coordinates, and a set goes down with its values there, so that similar sets meet
    again and others part. Nodes of one set end. Small nodes are compared pair by pair. In a larger one all sets are compared with PIVOTS
    of them and linked to those with which they agree enough. Pivots that a set links are one group with it; the sets linked to the largest
    such group are connected already, so a group of any number of near copies is linked to pivots, not paired. Where at most FEW sets of
    a node are outside it (or it has 2 * FEW at most), these are compared with all others of it, in blocks, and the node ends; it also
    ends without any. Nothing else
    ends a path; what is still large at the last level is compared in blocks, all against all.
    """
    bits = [F.lit(1 << i) for i in range(PIVOTS)]
    sketched = sets.select("set", "sketch")
    root = sketched.select("set", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: _first_nodes(F.col("sketch"), r)))).alias("node"))
    rows, edges, small, old = materialize(root, "near-nodes"), [], [], []
    for level in range(START, DEPTH + 1):
        size = rows.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        live = materialize(rows.join(size, "node"), "near-live")
        old += [rows, live]
        small.append(live.where(F.col("m") <= SMALL).select("node", "set"))
        big = live.where(F.col("m") > SMALL)
        if not big.take(1):
            break
        if level == DEPTH:  # the last level's large nodes
            last = big.withColumn("blocks", F.ceil(F.col("m") / SMALL).cast("int")).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
            small.append(_block_pairs(last, "node").select(F.xxhash64("node", "one", "two").alias("node"), "set"))
            break
        place = F.xxhash64("set", F.lit(level))
        pivots = big.groupBy("node").agg(*[F.min(F.when(F.pmod(place, F.lit(PIVOTS)) == i, F.struct(place.alias("h"), "set")))["set"].alias(f"p{i}") for i in range(PIVOTS)])
        pivots = pivots.select("node", F.posexplode(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("i", "pivot")).where(F.col("pivot").isNotNull())
        pivots = pivots.join(sketched.select(F.col("set").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot")
        pivots = materialize(pivots.groupBy("node").agg(F.collect_list(F.struct("i", "pivot", "pivot_sketch")).alias("pivots")), "near-pivots")  # PIVOTS a node
        link = F.aggregate("pivots", F.lit(0), lambda got, p: got + F.when(_agree(F.col("sketch"), p["pivot_sketch"]) >= MAYBE, F.element_at(F.array(*bits), p["i"] + 1)).otherwise(0))
        own = F.map_from_entries(F.transform("pivots", lambda p: F.struct(p["i"], p["pivot"])))
        near = big.join(sketched, "set").join(pivots, "node").select("node", "set", "m", link.alias("links"), own.alias("pivots"))
        near = materialize(near, "near-big")
        # a set's first pivot, and every other pivot that it links with that one
        to = F.filter(F.transform(F.array(*bits), lambda bit: F.when(F.col("links").bitwiseAND(bit) > 0, F.element_at("pivots", F.log2(bit).cast("int")))), lambda p: p.isNotNull())
        linked = near.where("links > 0").select("set", to.alias("to"), "links", "node")
        edges.append(linked.select(F.col("set").alias("a"), F.col("to")[0].alias("b")))
        edges.append(linked.dropDuplicates(["node", "links"]).select(F.explode("to").alias("a"), F.col("to")[0].alias("b")))
        # the largest group of pivots that sets link, as bits; 2 ** PIVOTS patterns of links a node at most
        by = near.groupBy("node", "links").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "links")), asc=False).alias("by"))
        grow = lambda group: F.aggregate("by", group, lambda got, x: F.when(got.bitwiseAND(x["links"]) > 0, got.bitwiseOR(x["links"])).otherwise(got))
        main = F.filter("by", lambda x: x["links"] > 0)[0]["links"]
        for _ in range(PIVOTS):
            main = grow(main)
        rest = by.withColumn("main", main).withColumn("rest", F.aggregate("by", F.lit(0).cast("long"), lambda got, x: got + F.when(x["links"].bitwiseAND(F.col("main")) > 0, 0).otherwise(x["n"])))
        rest = materialize(rest.where("rest > 0").select("node", "main", "rest"), "near-rest")
        near = near.join(rest, "node").withColumn("inside", F.col("links").bitwiseAND(F.col("main")) > 0)
        ends = (F.col("rest") <= FEW) | (F.col("m") <= 2 * FEW)
        few = near.where(ends).withColumn("blocks", F.ceil(F.col("m") / F.greatest(F.lit(SMALL), "rest")).cast("int")).withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
        block = F.when(F.col("inside"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        small.append(few.select("node", "set", F.explode(block).alias("block")).select(F.xxhash64("node", "block").alias("node"), "set"))
        down = near.where(~ends).select("node", "set").join(sketched, "set")
        rows = materialize(down.select("set", F.explode(_children(F.col("node"), F.col("sketch"), level)).alias("node")), "near-nodes")
    met = small[0]
    for x in small[1:]:
        met = met.unionByName(x)
    met = materialize(met.join(sketched, "set"), "near-met")
    bins = max(8, met.count() // 1000)
    edges.append(met.groupBy(F.pmod(F.xxhash64("node"), F.lit(bins))).applyInPandas(_compare_nodes, "a long, b long"))
    out = edges[0]
    for x in edges[1:]:
        out = out.unionByName(x)
    out = materialize(out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges")
    remove(met, *old)
    return out


def _block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """Every row once for each pair of blocks of its group that its block is in (one <= two)."""
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other")


def _open_stars(down: DataFrame) -> int:
    """Nodes that keep edges (a > b) from being stars: those with two lesser neighbours, or with a lesser and a greater one."""
    ends = down.select(F.col("a").alias("node"), "b", F.lit(False).alias("inner")).unionByName(down.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("b"), F.lit(True).alias("inner")))
    return ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max("inner").alias("inner")).where("low <> high OR (low IS NOT NULL AND inner)").count()


def stars(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for nodes with edges (a, b) that aren't the least themselves. edges are read several
    times, so they should be a written table. Small and large stars take turns until nothing but stars is left; every step is a join and a
    minimum, each edge gives one edge, and no star is ever one group of rows."""
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    written = []
    while _open_stars(down):
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = materialize(small.distinct(), "near-edges")
        both = small.unionByName(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        down = materialize(small.join(least, "b").select("a", F.col("m").alias("b")), "near-edges")
        remove(small, *written)
        written = [down]
    return down.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def connected(edges: DataFrame) -> DataFrame:
    """node, root: as of stars, and the least nodes with themselves."""
    root = stars(edges)
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Number of values that each two sets share."""
    if len(sets) == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    owner, at = owner[keep], place[at[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, b = np.searchsorted(at, (low, low + 4096))
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[a:b], at[a:b] - low] = 1
        out += m @ m.T
    return out


def _exact(rows: pd.DataFrame) -> pd.DataFrame:
    """set, links (documents that its sets here are linked to), root (of a forest of links) for each set of each (component, one, two)."""
    out = []
    for (_, one, two), own in rows.groupby(["component", "one", "two"], sort=False):
        own = own.sort_values("set")
        sets = [np.frombuffer(v, np.uint64) for v in own["shingles"]]
        if len(sets) < 2:
            continue
        n, both = np.array([len(s) for s in sets]), _shared(sets)
        linked = both >= SIMILAR * (n[:, None] + n - both) - 1e-6
        np.fill_diagonal(linked, False)
        if one != two:  # pairs inside a block belong to the pair of the block with itself
            block = own["block"].to_numpy()
            linked &= block[:, None] != block
        if linked.any():
            label, ids = _components(len(sets), linked), own["set"].to_numpy()
            out.append(pd.DataFrame({"set": ids, "links": linked @ own["copies"].to_numpy(), "root": ids[label]})[linked.any(1)])
    return pd.concat(out) if out else pd.DataFrame({"set": [], "links": [], "root": []}, dtype="int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Classes and links of all documents at a similarity of SIMILAR or more of their sets of WORDS-word shingles.

    docs: doc_id, text; other columns aren't read. Returns a row a document: doc_id, row_key (a hash of doc_id and text), copy_id (the least
    doc_id with the same shingles), class_id (the least doc_id of those that links connect), class_key (each class's own number, also where
    ids are null or stand on several texts; null without words), n_links (other documents at SIMILAR or more,
    copies counted). Documents with the same shingles (128 bits of hash) are one set from the start and never paired. A text of fewer words
    than WORDS has one shingle, of all of them; texts without words (null, empty) have none, no links, and are classes of their own. Equal
    rows are copies. Candidates are connected first; the exact similarity of every two sets of a component is then counted once, in blocks
    of bounded size, and only counts and a forest of links leave a block. An empty table gives no rows.
    """
    seen = materialize(sketches(docs), "near-sketches")
    sets = seen.where(F.col("a").isNotNull()).groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row_key")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = materialize(sets.withColumn("set", F.monotonically_increasing_id()), "near-sets")  # written once, so the numbers stay
    edges = candidate_edges(sets, runs_for(sets))
    component = materialize(connected(edges), "near-components")
    remove(edges)

    members = component.select(F.col("node").alias("set"), F.col("root").alias("component"))
    members = members.join(sets.select("set", "copies", "n", F.col("first.doc_id").alias("own_id"), F.col("first.row_key").alias("own_key")), "set")
    size = members.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = materialize(members.join(size, "component"), "near-members")
    key = F.xxhash64(docs["doc_id"], docs["text"])
    # always a merge join: members are a share of all documents, so a table that happens to be small enough to broadcast won't stay so
    texts = docs.select("doc_id", "text", key.alias("row_key")).join(members.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row_key") == F.col("own_key"))).drop("doc_id", "row_key", "own_id", "own_key", "n")

    def shingle(batches):
        for part in chunks(batches):
            value, doc = Words(texts_of(part["text"])).shingles(WORDS)
            cut = np.searchsorted(doc, np.arange(1, len(part)))
            yield part.drop(columns="text").assign(shingles=[np.unique(v).tobytes() for v in np.split(value, cut)])

    own = texts.mapInPandas(shingle, "component long, set long, copies long, blocks int, shingles binary")
    units = _block_pairs(own.dropDuplicates(["set"]).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")), "component")
    bins = max(8, (members.agg(F.sum("n").alias("n")).first()["n"] or 0) // BLOCK_SHINGLES)
    bin_ = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.xxhash64("component", "one", "two"))
    found = units.groupBy(bin_).applyInPandas(_exact, "set long, links long, root long")
    found = materialize(found, "near-links")
    root = connected(found.select(F.col("set").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    classes = sets.select("set", "a", "b", "copies", "least").join(root.withColumnRenamed("node", "set"), "set", "left").join(links, "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = classes.join(least, "root").select("a", "b", F.col("least").alias("copy_id"), "class_id", F.col("root").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = seen.drop("sketch", "n").join(classes, ["a", "b"], "left")
    own_id = lambda c: F.when(F.col("a").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", "row_key", own_id("copy_id"), own_id("class_id"), "class_key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id (null first, then the least hash of id and text); columns as in docs, whatever their
    names. Classes are told apart by their texts, so null ids and ids that stand on several texts lose nothing. Texts without words all
    stay, and of repeated rows of a class one. An empty table gives no rows."""
    found = materialize(near_duplicates(docs), "near-found")
    id_, key, one, nth = fresh(docs, "kept_id", "kept_key", "one", "nth_copy")
    alone = found.where(F.col("n_links") == 0).select("doc_id", "row_key")
    first = found.where(F.col("n_links") > 0).groupBy("class_key").agg(F.min(F.struct("doc_id", "row_key")).alias("own")).select("own.doc_id", "own.row_key")
    keep = alone.distinct().withColumn(one, F.lit(False)).unionByName(first.withColumn(one, F.lit(True))).select(F.col("doc_id").alias(id_), F.col("row_key").alias(key), one)
    joined = docs.join(keep, docs["doc_id"].eqNullSafe(keep[id_]) & (F.xxhash64(docs["doc_id"], docs["text"]) == keep[key]))
    # a third of all rows may be one row: the first of equal rows is found without bringing them together
    row, least = fresh(joined, "row", "least")
    joined = materialize(joined.withColumn(row, F.monotonically_increasing_id()), "near-kept")
    firsts = joined.where(F.col(one)).groupBy(id_, key).agg(F.min(row).alias(least)).select(least)
    out = joined.where(~F.col(one)).unionByName(joined.join(firsts, F.col(row) == F.col(least), "left_semi"))
    return out.select(*docs.columns)


def op7_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents: null and empty texts are classes of their own without links, repeated rows are copies, null ids and an
    id on several texts are classes by their texts (class_key), an empty table gives no rows, other columns aren't read."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")
