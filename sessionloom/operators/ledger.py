"""What became of each delivered key: reserved once, tried again after failures, finalized or given up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a delivery met: refused before anything was kept, ended after the reservation, failed in the assessment, or went through.
REFUSED, CRASHED, FAILED, OK = "refused", "crashed", "failed", "ok"
MOST_ATTEMPTS = 3


def delivery_ledger(deliveries: DataFrame, key: list[str], order: list[str], most: int = MOST_ATTEMPTS) -> DataFrame:
    """A row for each key: state, deliveries, attempts (assessments that failed), reserved_at and closed_at (order's columns as a struct).

    deliveries: key, order (together unique) and outcome. The first delivery that isn't refused reserves the key, so that what it changes is
    changed once whatever comes later. The first that goes through finalizes it; the most-th failure before that makes it a dead letter.
    Nothing after that counts. A key whose deliveries were all refused is discarded, and stays open for the next; a null outcome is a crash;
    a null key is a key like others. Failures are cut to the first few of each key before the shuffle, everything else is a minimum or a
    count, so a key may have any number of deliveries.
    """
    at, outcome = F.struct(*order), F.coalesce("outcome", F.lit(CRASHED))
    rows = deliveries.select(*key, at.alias("at_"), outcome.alias("outcome_"))
    whole = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("deliveries"),
        F.min(F.when(F.col("outcome_") != REFUSED, F.col("at_"))).alias("reserved_at"),
        F.min(F.when(F.col("outcome_") == OK, F.col("at_"))).alias("ok_"),
    )
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("at_"))
    failures = rows.where(F.col("outcome_") == FAILED).withColumn("nth_", nth).where(F.col("nth_") <= most)
    failures = failures.groupBy(*[F.col(k).alias(f"{k}_") for k in key]).agg(F.sort_array(F.collect_list("at_")).alias("failures_"))
    joined = whole.join(failures, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in key], "left")
    last = F.when(F.size("failures_") >= most, F.col("failures_")[most - 1])
    dead = last.isNotNull() & (F.col("ok_").isNull() | (last < F.col("ok_")))
    before = F.when(F.col("ok_").isNull(), F.size("failures_")).otherwise(F.size(F.filter("failures_", lambda a: a < F.col("ok_"))))
    state = F.when(F.col("reserved_at").isNull(), "discarded").when(dead, "dead_letter").when(F.col("ok_").isNotNull(), "finalized").otherwise("reserved")
    return joined.select(*key, state.alias("state"), "deliveries", F.coalesce(before, F.lit(0)).cast("long").alias("attempts"), "reserved_at", F.when(dead, last).otherwise(F.col("ok_")).alias("closed_at"))
