"""Titles and how good they are; labels matched with tolerance; vectors against what came before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values.
PREAMBLE = ("please", "can you", "could you", "i want you to", "i need you to", "hi", "hello", "ok", "now", "let's")
TAIL = ("the", "a", "an", "of", "to", "and", "or", "in", "on", "for", "with", "by")


def clipped(text: Column, most_words: int = 8, most_chars: int = 60) -> Column:
    """The first sentence without what leads up to it, cut to words and characters, not ending in a function word."""
    first = F.try_element_at(F.filter(F.transform(F.split(F.trim(text), r"[.!?]\s+|\n+"), lambda s: F.trim(s)), lambda s: s != ""), F.lit(1))
    core = F.regexp_replace(F.coalesce(first, F.lit("")), rf"(?i)^[\s,:;-]*(?:(?:{'|'.join(PREAMBLE)})(?=[\s,]|$)[\s,:;-]*)*", "")
    words = F.slice(F.split(core, r"\s+"), 1, most_words)
    fits = F.aggregate(words, F.lit(""), lambda s, w: F.when(F.length(s) + F.length(w) + F.when(s == "", 0).otherwise(1) <= most_chars, F.when(s == "", w).otherwise(F.concat(s, F.lit(" "), w))).otherwise(s))
    bare = F.regexp_replace(F.regexp_replace(fits, rf"(?i)(?:\s+(?:{'|'.join(TAIL)}))+$", ""), r"[\s.,;:!?-]+$", "")
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))


def title_key(title: Column) -> Column:
    """Equal for titles of the same set of words."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower(title), r"[^a-z0-9à-ÿ]+"), lambda w: w != ""))), " ")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def alike_pairs(sets: DataFrame, group: str, words: str, tenths: int) -> DataFrame:
    """group, n_alike: how many pairs of its sets have a Jaccard similarity of so many tenths at least; groups without such a pair are left
    out. Empty and null sets are like nothing.

    Equal sets are counted, then one, so copies make no pairs. Two alike sets share one of the first words of both in order of hashes: of n
    words the first n - ceil(tenths * n / 10) + 1, and only sets that share one are compared.
    """
    order = lambda ws: F.transform(F.array_sort(F.transform(ws, lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), lambda x: x["w"])
    classes = sets.where(F.size(words) > 0).select(F.col(group).alias("g_"), order(F.array_distinct(words)).alias("ws_")).groupBy("g_", "ws_").agg(F.count(F.lit(1)).alias("n_"))
    classes = classes.withColumn("key_", F.xxhash64(F.array_join("ws_", " ")))
    own = classes.groupBy("g_").agg(F.sum(F.expr("n_ * (n_ - 1) div 2")).alias("n_alike"))
    size = F.size("ws_")
    first = classes.withColumn("word_", F.explode(F.slice("ws_", 1, size - F.ceil(size * tenths / 10).cast("int") + 1)))
    other = first.select("g_", "word_", F.col("ws_").alias("ws2_"), F.col("n_").alias("n2_"), F.col("key_").alias("key2_"))
    shared = F.size(F.array_intersect("ws_", "ws2_"))
    met = first.join(other, ["g_", "word_"]).where((F.col("key_") < F.col("key2_")) & (10 * F.least(size, F.size("ws2_")) >= tenths * F.greatest(size, F.size("ws2_"))))
    # a pair counts at the first of the words that both begin with
    mine, theirs = (F.slice(c, F.lit(1), F.size(c) - F.ceil(F.size(c) * tenths / 10).cast("int") + 1) for c in ("ws_", "ws2_"))
    met = met.where((F.col("word_") == F.array_intersect(mine, theirs)[0]) & (10 * shared >= tenths * (size + F.size("ws2_") - shared)))
    across = met.groupBy("g_").agg(F.sum(F.col("n_") * F.col("n2_")).alias("n_alike"))
    return own.unionByName(across).groupBy(F.col("g_").alias(group)).agg(F.sum("n_alike").alias("n_alike")).where("n_alike > 0")


def matched(gold: DataFrame, guess: DataFrame, within: int) -> DataFrame:
    """session_id, hits, n_gold, n_guess: each gold place, in order, takes the first free guess that is near enough. Greedy, so a fold over
    a session's two lists."""
    both = gold.select("session_id", "place", F.lit(True).alias("gold")).unionByName(guess.select("session_id", "place", F.lit(False).alias("gold")))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        want, free = np.sort(rows.place[rows.gold]), np.sort(rows.place[~rows.gold]).tolist()
        hits = 0
        for w in want:
            near = next((k for k, g in enumerate(free) if abs(g - w) <= within), None)
            if near is not None:
                free.pop(near)
                hits += 1
        return pd.DataFrame({"session_id": [rows.session_id.iat[0]], "hits": [hits], "n_gold": [len(want)], "n_guess": [int((~rows.gold).sum())]})

    return both.groupBy("session_id").applyInPandas(fold, "session_id long, hits long, n_gold long, n_guess long")


def centroid_distance(vectors: DataFrame, group: str, order: str, vector: str, n: int, block: int = 10_000) -> DataFrame:
    """Adds distance: 1 - cosine of each vector and the mean of the n before it in its group; null for the first.

    order is a number. A group is cut into blocks of so many of its values, each sorted by itself, and the n rows before a block go into it
    too, so that a group which holds much of the table isn't one task. Only each block's last n rows are ordered over a whole group.
    """
    parts = vectors.withColumns({"block_": F.floor(F.col(order) / block), "carried_": F.lit(False)})
    own = Window.partitionBy(group, "block_")
    tails = parts.withColumn("nth_", F.row_number().over(own.orderBy(F.desc(order)))).where(F.col("nth_") <= n)
    tails = tails.withColumn("rows_", F.collect_list(F.struct(order, vector)).over(Window.partitionBy(group).orderBy(order).rowsBetween(-n, -1)))
    heads = tails.groupBy(group, "block_").agg(F.min_by("rows_", order).alias("rows_"))
    carried = heads.select(group, "block_", F.inline("rows_"), F.lit(True).alias("carried_"))
    parts = parts.unionByName(carried, allowMissingColumns=True)
    before = F.collect_list(vector).over(own.orderBy(order).rowsBetween(-n, -1))
    mean = F.when(F.size("before_") > 0, F.transform(F.col("before_")[0], lambda _, i: F.aggregate("before_", F.lit(0.0), lambda s, v: s + v[i]) / F.size("before_")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = parts.withColumn("before_", before).where("not carried_").withColumn("mean_", mean)
    cosine = dot(F.col(vector), F.col("mean_")) / F.sqrt(dot(F.col(vector), F.col(vector)) * dot(F.col("mean_"), F.col("mean_")))
    return rows.withColumn("distance", F.round(1 - cosine, 4)).drop("before_", "mean_", "block_", "carried_")


def stitched(labels: DataFrame) -> DataFrame:
    """Of the labels that overlapping windows give an item, that of the window whose centre is nearest, of equals the earlier one."""
    away = F.abs(F.col("item") - F.col("centre"))
    return labels.groupBy("session_id", "item").agg(F.min_by("label", F.struct(away, F.col("window"))).alias("label"))
