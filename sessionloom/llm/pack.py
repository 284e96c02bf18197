"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, materialize, remove, table, texts_of
from .tokens import ids_of

TOKENIZER, CAPACITY, END = "byte_bpe_50k.json", 2048, 0
#: Items that one population packs; islands with the same items; times that elites migrate; generations between.
DEME, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 6000, 2, 2, 4, 4


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and ids (array of int) if asked for.

    A document is its text's ids (null: none) and then `end`. Over `capacity` ids it is cut into full pieces, and what doesn't fill
    one comes first. Nothing is ever cut elsewhere, and no text is cropped.
    """
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches):
        tok = ids_of(tokenizer)
        for part in chunks(batches):
            ids, sizes = tok.encode(texts_of(part["text"]), end)
            n = 1 + (sizes - 1) // capacity
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = sizes - (n - 1) * capacity
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            edge = np.cumsum(length)
            raw = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(edge.tolist(), length.tolist(), strict=True)]
            out = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array[doc], "piece": piece, "start": start, "length": length, "ids_crc32": crcs})
            yield out.assign(ids=np.split(ids.astype(np.int32), edge[:-1])) if with_ids else out

    return docs.select("doc_id", "text").mapInPandas(cut, kind)


def best_fit(sizes: np.ndarray, order, capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Each item in turn goes to the fullest bin that has room for it, or to a new one."""
    bins = bins or []
    room = sorted((capacity - int(sizes[b].sum()), k) for k, b in enumerate(bins))
    for i in order:
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, len(bins)
            bins.append([])
        bins[k].append(int(i))
        if left > size:
            insort(room, (left - size, k))
    return bins


def fitness(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins that are filled unevenly: one with much room left is easier to empty."""
    fill = np.array([sizes[b].sum() for b in bins], float) / capacity
    return -len(bins), float((fill * fill).sum())


def crossover(one, other, sizes, capacity: int, rng) -> list[list[int]]:
    """Injects the well-filled bins of `other` whole; bins of `one` that share an item with them are dissolved, their other items best-fitted."""
    if not one or not other:
        return [list(b) for b in one or other]
    fill = np.array([sizes[b].sum() for b in other])
    share = rng.uniform(0.2, 0.6)
    good = np.flatnonzero(fill >= np.quantile(fill, 1 - share))
    kept = [list(other[k]) for k in good]
    taken = np.zeros(len(sizes), bool)
    for b in kept:
        taken[b] = True
    displaced = []
    for b in one:
        if taken[b].any():
            displaced += [i for i in b if not taken[i]]
        else:
            kept.append(list(b))
    displaced.sort(key=lambda i: -int(sizes[i]))
    return best_fit(sizes, displaced, capacity, kept)


def mutate(bins, sizes, capacity: int, rng) -> list[list[int]]:
    """Dissolves the emptiest bins and a few others, and best-fits their items anew."""
    fill = np.array([sizes[b].sum() for b in bins])
    out = {*np.argsort(fill)[: max(1, len(bins) // 50)].tolist(), *rng.choice(len(bins), max(1, len(bins) // 50)).tolist()}
    loose = [i for k in out for i in bins[k]]
    loose.sort(key=lambda i: -int(sizes[i]))
    return best_fit(sizes, loose, capacity, [list(b) for k, b in enumerate(bins) if k not in out])


def evolve(sizes: np.ndarray, capacity: int, seed: int, elite: list[list[list[int]]], generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best packing after some generations; elite: packings that others found. Ends early where no packing can be smaller."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    down = np.argsort(-sizes, kind="stable")
    pool = [*elite, best_fit(sizes, down, capacity)]
    rank = lambda p: fitness(p, sizes, capacity)
    if len(max(pool, key=rank)) > least:
        while len(pool) < population:
            pool.append(best_fit(sizes, np.argsort(-sizes * rng.uniform(0.7, 1.3, len(sizes)), kind="stable"), capacity))
        for _ in range(generations):
            pool = heapq.nlargest(population, pool, key=rank)
            if len(pool[0]) <= least:
                break
            a, b = rng.choice(len(pool), 2, replace=False)
            child = crossover(pool[a], pool[b], sizes, capacity, rng)
            pool += [child, mutate(child, sizes, capacity, rng)]
    return max(pool, key=rank)


def _round(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """Every (deme, island) evolves for itself from the packings it holds; bin is the item's bin in its own best one, migrant in its guest's."""

    def island(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable").reset_index(drop=True)
        sizes = rows["length"].to_numpy()
        elite = []
        for name in ("bin", "migrant"):
            if rows[name].iat[0] >= 0:
                groups = rows.groupby(name).indices
                elite.append([g.tolist() for g in groups.values()])
        best = evolve(sizes, capacity, seed * 7919 + int(rows["deme"].iat[0]) * 31 + int(rows["island"].iat[0]), elite)
        own = np.empty(len(rows), np.int64)
        for k, b in enumerate(best):
            own[b] = k
        return rows.assign(bin=own, migrant=np.int64(-1), bins=np.int64(len(best)))

    return items.groupBy("deme", "island").applyInPandas(island, items.schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, deme: int = DEME, islands: int = ISLANDS, rounds: int = ROUNDS, seed: int = 11) -> DataFrame:
    """item, sequence_id and offset for each piece (item: a number of its own; length).

    Full pieces are sequences by themselves. The others are dealt by hash into demes of about `deme` items, so a source or a group of
    copies of any size spreads evenly; `islands` populations for each deme evolve side by side, and between rounds the elite packing of
    an island migrates to the next one of its deme. Of the islands' packings the smallest is kept. Then all bins but the full ones
    (those under 99.5 %), with what they hold, are dealt out once more to larger demes, so that what is left over in single demes comes
    together. The number of demes follows the number of items; all of them run in parallel. A sequence's number is made of its deme's and
    its bin's numbers, or of its one piece's, so that no two share one.
    """
    full = pieces.where(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select("item", "length")

    def settle(rest: DataFrame, per_deme: int, salt: int) -> DataFrame:
        demes = max(1, -(-rest.count() // per_deme))
        none = F.lit(-1).cast("long")
        items = rest.withColumn("deme", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(demes)))
        items = items.withColumns({"island": F.explode(F.sequence(F.lit(0), F.lit(islands - 1))), "bin": none, "migrant": none, "bins": none})
        for r in range(rounds):
            before, items = items, materialize(_round(items, capacity, seed + salt + r), "pack-round")
            if r:
                remove(before)
            if r < rounds - 1:  # a ring: each island gets the elite of the one before it
                guests = items.select("item", ((F.col("island") + 1) % islands).alias("island"), F.col("bin").alias("guest"))
                items = items.join(guests, ["item", "island"]).withColumn("migrant", F.col("guest")).select(items.columns)
        best = items.groupBy("deme").agg(F.min(F.struct("bins", "island")).alias("won"))
        return items.join(best, "deme").where(F.col("island") == F.col("won.island")).select("item", "length", "deme", "bin")

    first = materialize(settle(rest, deme, 0), "pack-first")
    fill = first.groupBy("deme", "bin").agg(F.sum("length").alias("fill"))
    low = materialize(fill.where(F.col("fill") < capacity * 0.995).select("deme", "bin"), "pack-low")
    again = materialize(first.join(low, ["deme", "bin"], "left_semi").select("item", "length"), "pack-again")
    last = settle(again, 4 * deme, 1)
    number = lambda turn: (F.shiftleft(F.col("deme"), 33) + F.shiftleft(F.col("bin"), 1) + turn).alias("sequence_id")
    kept = first.join(low, ["deme", "bin"], "left_anti").select("item", "length", number(0))
    placed = kept.unionByName(last.select("item", "length", number(1)))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "item")
    return full.unionByName(placed.select("item", "sequence_id", (F.sum("length").over(order) - F.col("length")).alias("offset")))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Packs documents into sequences of at most `capacity` tokens.

    Returns a row a piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for), sequence_id, offset. Null and empty texts
    are the end token alone; null doc_ids are kept. Equal rows are packed as often as they are there. An empty table gives no rows.
    Other columns of docs are not read.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end, with_ids)
    pieces = materialize(pieces.withColumn("item", F.monotonically_increasing_id()), "pack-pieces")  # written once, so the numbers stay
    return pieces.join(pack_pieces(pieces.select("item", "length"), capacity), "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (of pack(..., with_ids=True)): sequence_id, ids, doc_ids in order."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack of all documents: null and empty texts are one end token, null doc_ids and repeated rows are packed like others, ties in size
    are broken by a piece's number, an empty table gives no rows, other columns aren't read."""
    return pack(table(spark, sf_dir, "documents"))
