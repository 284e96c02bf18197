"""Cost and latency by the dimensions of a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pairing import micros

DIMENSIONS = ("phase", "turn", "tool")


def _by_dimension(rows: DataFrame, measures: list[str]) -> DataFrame:
    """A row for each dimension that the record carries: single-dimension grouping sets without a pass for each."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("key")) for d in DIMENSIONS])
    return rows.select(F.explode(F.filter(pairs, lambda p: p["key"].isNotNull())).alias("d"), *measures).select("d.dimension", "d.key", *measures)


def rollups(spans: DataFrame, usage: DataFrame) -> DataFrame:
    """dimension, key, span_count, total_duration_ms, usage_count, cost_cents, input_tokens, output_tokens: spans and usage that carry a
    value of the dimension. Both sides are summed before they meet, in one shuffle of few rows."""
    timed = spans.withColumn("duration_ms", ((micros("end_time") - micros("start_time")) / 1000).cast("long"))
    measures = ["span_count", "total_duration_ms", "usage_count", "cost_cents", "input_tokens", "output_tokens"]
    zero = F.lit(0).cast("long")
    a = _by_dimension(timed, ["duration_ms"]).select("dimension", "key", F.lit(1).cast("long").alias("span_count"), F.col("duration_ms").alias("total_duration_ms"), *[zero.alias(m) for m in measures[2:]])
    b = _by_dimension(usage, ["cost_cents", "input_tokens", "output_tokens"]).select("dimension", "key", zero.alias("span_count"), zero.alias("total_duration_ms"), F.lit(1).cast("long").alias("usage_count"), *measures[3:])
    return a.unionByName(b).groupBy("dimension", "key").agg(*[F.sum(m).alias(m) for m in measures])


def threshold_anomalies(rolled: DataFrame, duration_ms: int | None = None, cost_cents: int | None = None) -> DataFrame:
    """dimension, key, metric, value for each bucket strictly above a limit."""
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"), F.lit(limit).cast("long").alias("limit")) for m, c, limit in (("duration_ms", "total_duration_ms", duration_ms), ("cost_cents", "cost_cents", cost_cents)) if limit is not None])
    return rolled.select("dimension", "key", F.explode(metrics).alias("m")).where("m.value > m.limit").select("dimension", "key", "m.metric", "m.value")


def z_anomalies(rolled: DataFrame, at_least: float, least_buckets: int = 3) -> DataFrame:
    """dimension, key, metric, score: buckets that many population deviations above the mean of their dimension."""
    w = Window.partitionBy("dimension")
    out = None
    for metric, column in (("duration_ms", "total_duration_ms"), ("cost_cents", "cost_cents")):
        spread = F.stddev_pop(column).over(w)
        scored = rolled.select("dimension", "key", F.lit(metric).alias("metric"), F.count(F.lit(1)).over(w).alias("n"), F.when(spread > 0, (F.col(column) - F.avg(column).over(w)) / spread).alias("score"))
        scored = scored.where((F.col("n") >= least_buckets) & (F.col("score") >= at_least)).select("dimension", "key", "metric", F.round("score", 6).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def cost_breakdown(usage: DataFrame) -> DataFrame:
    """Adds input_cents and output_cents: the cost by share of tokens, the rest to the output; no tokens, no input cost."""
    total = F.col("input_tokens") + F.col("output_tokens")
    split = F.coalesce(F.floor(F.try_divide(F.col("cost_cents") * F.col("input_tokens"), total)), F.lit(0)).cast("long")
    return usage.withColumn("input_cents", split).withColumn("output_cents", F.col("cost_cents") - F.col("input_cents"))


def usage_by(usage: DataFrame, *keys: str) -> DataFrame:
    """Sums by keys; a sum stays null until some row has a value."""
    return usage.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_cents").alias("cost_cents"))


def most_frequent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and its most frequent value that isn't blank; of equals the first by name."""
    counts = rows.where(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), value))[value].alias(value))


def _part(a: Column, b: Column) -> Column:
    return F.when(F.coalesce(b, F.lit(0)) == 0, 0.0).otherwise(a.cast("double") / b)


def class_report(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """class, hits, guesses, support, precision, recall, f1 of each class that is the truth or the guess somewhere; a ratio of nothing is 0.

    The confusion matrix is counted first, so no row is looked at twice and a class may hold nearly all of them. A null truth or guess is a
    miss of the other side's class.
    """
    cells = rows.groupBy(F.col(truth).alias("t_"), F.col(guess).alias("g_")).agg(F.count(F.lit(1)).alias("n_"))
    sides = cells.withColumn("class", F.explode(F.array_distinct(F.array("t_", "g_")))).where("class is not null")
    of = lambda c: F.sum(F.when(c, F.col("n_")).otherwise(0)).cast("long")
    true, told = (F.col(c).eqNullSafe(F.col("class")) for c in ("t_", "g_"))
    counts = sides.groupBy("class").agg(of(true & told).alias("hits"), of(told).alias("guesses"), of(true).alias("support"))
    ratios = {"precision": _part(F.col("hits"), F.col("guesses")), "recall": _part(F.col("hits"), F.col("support")), "f1": _part(2 * F.col("hits"), F.col("guesses") + F.col("support"))}
    return counts.withColumns({k: F.round(v, 6) for k, v in ratios.items()})


def averaged(report: DataFrame) -> DataFrame:
    """n_classes, f1_macro (each class counts alike), f1_micro (each row does) of a class_report()."""
    f1 = _part(2 * F.col("hits"), F.col("guesses") + F.col("support"))
    micro = F.sum(2 * F.col("hits")).cast("double") / F.sum(F.col("guesses") + F.col("support"))
    return report.agg(F.count(F.lit(1)).alias("n_classes"), F.round(F.avg(f1), 6).alias("f1_macro"), F.round(micro, 6).alias("f1_micro"))
