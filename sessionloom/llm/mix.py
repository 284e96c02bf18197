"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialize, table, word_count

#: Weights by the rank of a source (code points, null last), repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
SLICES = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_passes: int = MOST_PASSES) -> DataFrame:
    """Words that each source gives to the mix.

    sizes: source (any, null too; one row each), source_size. The sources share `share` times all words by weight. Nothing gives more
    than most_passes times its own size; what is over goes to the others by weight until none is above. That is the level t at which
    sum(min(cap, t * weight)) is the budget: with the sources in order of cap / weight, t follows from running sums, so no loop is needed.
    Adds target (double; 0 for sources without words).
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # Spark compares UTF-8 bytes, which is code point order
    by_level = Window.orderBy("level", "rank")
    names = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", names).withColumn("cap", F.col("source_size") * F.lit(float(most_passes)))
    levels = ranked.withColumn("level", F.col("cap") / F.col("weight")).withColumn("budget", F.least(F.sum("source_size").over(everything) * share, F.sum("cap").over(everything)))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    open_ = levels.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    # the first source that isn't full at its own level sets the water level for itself and all after it
    at = open_.withColumn("t", (F.col("budget") - F.col("full")) / F.col("left"))
    level = at.withColumn("water", F.max(F.when(F.col("t") <= F.col("level"), F.col("t"))).over(everything))
    return level.select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_passes: int = MOST_PASSES, seed: int = 7, slices: int = SLICES, row: str | None = None) -> DataFrame:
    """The queue of the mix: a row for each time a document could be taken.

    Every source's documents stand shuffled by a hash of (doc_id, seed, pass), a pass after the other. An entry's virtual finish time is
    the source's words so far divided by its target; entries are taken in order of it while the words before them, over all sources, are
    below the budget (the sum of the targets). Running sums go over hash slices of a source and over slices of time, so a source that
    has a third of all rows is spread over `slices` groups for each pass, and only the slice in which the budget ends is sorted.

    docs: doc_id, text, source; other columns are left alone, but for `row`, a column of distinct numbers, if named. Returns doc_id, row_key (equal for equal rows), row (that, or each row's own, not the same in another run), source, size,
    source_size, target, pass (from 0), finish (double), taken (boolean). Null or empty texts have size 0 and are taken when their turn
    comes. Repeated doc_ids count as different rows; the same input gives the same mix. An empty table gives an empty queue.
    """
    base = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("doc_id", "text").alias("row_key"), (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"))
    rows = materialize(base, "mix-sizes")
    sizes = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most_passes), "mix-targets")
    sized = rows.join(sizes.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")), "inner").drop("source_")
    passes = F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.least(F.lit(most_passes), F.ceil(F.try_divide("target", "source_size")).cast("int")))).otherwise(1)
    queue = sized.withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1))).withColumn("place", F.xxhash64("doc_id", "row_key", F.lit(seed), "pass"))
    queue = queue.withColumn("slice", F.col("pass") * slices + F.shiftrightunsigned("place", 64 - (slices - 1).bit_length()))
    sums = queue.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    ordered = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(F.col("source").alias("source_"), F.col("slice").alias("slice_"), F.coalesce(F.sum("words").over(ordered), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    timed = queue.withColumn("run", F.sum("size").over(inside)).join(ahead, F.col("source").eqNullSafe(F.col("source_")) & (F.col("slice") == F.col("slice_")), "inner")
    timed = timed.withColumn("finish", F.coalesce(F.try_divide(F.col("ahead") + F.col("run"), F.col("target")), F.lit(0.0)))
    timed = materialize(timed.select("doc_id", "row_key", "row", "source", "size", "source_size", "target", "pass", "finish"), "mix-queue")

    # Range cut: finish times are even within a source, and 1 is where each source reaches its target.
    slot = F.least(F.lit(4 * slices), F.floor(F.col("finish") * slices)).cast("int")
    budget = sizes.agg(F.sum("target").alias("budget"))
    by_slot = timed.groupBy(slot.alias("slot")).agg(F.sum("size").alias("words"))
    until = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    cut = by_slot.withColumn("start", F.coalesce(F.sum("words").over(until), F.lit(0))).crossJoin(F.broadcast(budget))  # one row: a sum
    cut = cut.select("slot", "start", F.when(F.col("start") + F.col("words") <= F.col("budget"), "all").when(F.col("start") >= F.col("budget"), "none").otherwise("part").alias("state"), "budget")
    placed = timed.withColumn("slot", slot).join(cut, "slot")
    part = placed.where("state = 'part'")
    run = Window.partitionBy("slot").orderBy("finish", F.col("source").isNull(), "source", "pass", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("taken", F.col("start") + F.sum("size").over(run) - F.col("size") < F.col("budget"))
    out = placed.where("state <> 'part'").withColumn("taken", F.col("state") == "all").unionByName(part)
    return out.select("doc_id", "row_key", "row", "source", "size", "source_size", "target", "pass", "finish", "taken")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: a row that is taken twice is there twice, each of equal rows as often as the queue took it. Columns as in docs,
    whatever their names; rows go by a number of their own, so null and repeated ids lose and add nothing. An empty table gives no rows."""
    row, own, times, copy = fresh(docs, "mix_row", "mix_own", "mix_times", "mix_copy")
    held = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")  # written, so the numbers stay
    taken = mix_sources(held, row=row, **how).where("taken").groupBy(F.col("row").alias(own)).agg(F.count(F.lit(1)).cast("int").alias(times))
    joined = held.join(taken, F.col(row) == F.col(own))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated rows and null ids too. Null and empty texts have size 0, a null source is one of its own and the last; ties in
    finish time are broken by source, pass and id; an empty table gives no rows; other columns aren't read."""
    queue = mix_sources(table(spark, sf_dir, "documents"))
    grouped = queue.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken"), F.min("finish").alias("first_finish"))
    return grouped.drop("row")
