"""Metric aggregates, histogram buckets, windowed rates and alert rules.

Samples are reduced to (label, window) rows first, so everything that needs an
order (runs of breaches, running depth) works on rows whose number depends on
the covered time, not on the number of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentflow.functions.text import col, ratio


def labelled_counts(df: DataFrame, labels: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias(out))


def latest_value(df: DataFrame, labels: list[str], value: str, order: Column, out: str = "value") -> DataFrame:
    return df.groupBy(*labels).agg(F.max_by(value, order).alias(out))


def zero_filled(counts: DataFrame, dimension: DataFrame, key: str, measure: str) -> DataFrame:
    """Every member of the dimension, with zero where nothing was counted."""
    return dimension.join(counts, key, "left").withColumn(measure, F.coalesce(measure, F.lit(0)))


def bucket_columns(value, bounds: list[float]) -> list[Column]:
    """One cumulative count per bound: a single pass, no shuffle beyond the grouping."""
    return [F.count_if(col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]


def histogram(df: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets in long form (``le`` as text, last one +Inf), with sum and count."""
    agg = df.groupBy(*labels).agg(
        *bucket_columns(value, bounds), F.sum(value).alias("sum"), F.count(value).alias("count"))
    rows = F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"le_{i}").alias("bucket")) for i, b in enumerate(bounds)],
                   F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket")))
    return agg.select(*labels, F.explode(rows).alias("b"), "sum", "count").select(*labels, "b.le", "b.bucket", "sum", "count")


def quantile_from_buckets(counts: list[Column], total: Column, bounds: list[float], q: float) -> Column:
    """Linear interpolation inside cumulative buckets; above the last bound, that bound."""
    rank = total * q
    out = F.when(total == 0, F.lit(None).cast("double"))
    low, below = F.lit(0.0), F.lit(0)
    for b, c in zip(bounds, counts):
        inside = F.nullif(c - below, F.lit(0))
        out = out.when(c >= rank, low + (b - low) * (rank - below) / inside)
        low, below = F.lit(b), c
    return out.otherwise(F.lit(bounds[-1]))


def summary(df: DataFrame, labels: list[str], value: str) -> DataFrame:
    return df.groupBy(*labels).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def success_rate(ok: Column) -> list[Column]:
    good, bad = F.count_if(ok), F.count_if(~ok)
    return [good.alias("successes"), bad.alias("failures"), (100 * ratio(good, good + bad)).alias("success_rate")]


def elapsed_seconds(ts: str) -> Column:
    return (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1000000


# --- windows ------------------------------------------------------------------------

def windowed(df: DataFrame, ts: str, labels: list[str], aggs: list[Column], minutes: int = 5,
             slide: int | None = None) -> DataFrame:
    """Aggregates per window and label. Works on batch frames and, with a
    watermark set by the caller, on streams."""
    w = F.window(ts, f"{minutes} minutes", f"{slide} minutes") if slide else F.window(ts, f"{minutes} minutes")
    return df.groupBy(w, *labels).agg(*aggs).withColumn("window_start", F.col("window.start")).drop("window")


def grid(windows: DataFrame, minutes: int = 5) -> DataFrame:
    """All window starts between the first and the last one."""
    ends = windows.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"))
    return ends.select(F.explode(F.expr(f"sequence(a, b, interval {minutes} minutes)")).alias("window_start"))


def fill_windows(windows: DataFrame, measures: list[str], minutes: int = 5) -> DataFrame:
    """Windows without samples appear with zero."""
    out = grid(windows, minutes).join(windows, "window_start", "left")
    return out.withColumns({m: F.coalesce(m, F.lit(0)) for m in measures})


def breach_runs(windows: DataFrame, keys: list[str], breach: Column, hold_minutes: int, minutes: int = 5) -> DataFrame:
    """``run`` = breaching windows in a row so far, ``firing`` once they span the hold time."""
    w = Window.partitionBy(*keys).orderBy("window_start")
    marked = windows.withColumn("breach", F.coalesce(breach, F.lit(False)))
    marked = marked.withColumn("_island", F.sum(F.when(F.col("breach"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(*keys, "_island").orderBy("window_start")
    run = F.when(F.col("breach"), F.sum(F.col("breach").cast("int")).over(inside)).otherwise(0)
    return (marked.withColumn("run", run.cast("bigint"))
            .withColumn("firing", F.col("breach") & ((F.col("run") - 1) * minutes >= hold_minutes)).drop("_island"))


def apply_rules(metric_windows: DataFrame, rules: DataFrame, minutes: int = 5) -> DataFrame:
    """Generic threshold rules over ``(window_start, metric, value)``.

    ``rules(rule, metric, comparator, threshold, hold_minutes)`` is a small user table."""
    j = metric_windows.join(F.broadcast(rules), "metric")
    v, limit, c = F.col("value"), F.col("threshold"), F.col("comparator")
    breach = F.when(c == ">", v > limit).when(c == "<", v < limit).when(c == ">=", v >= limit).when(c == "==", v == limit)
    runs = breach_runs(j, ["rule"], breach, 0, minutes)
    return runs.withColumn("firing", F.col("breach") & ((F.col("run") - 1) * minutes >= F.col("hold_minutes")))


def alert_events(runs: DataFrame, rule: str, level: str, title: str, message: str) -> DataFrame:
    """One event per start of a firing run."""
    w = Window.partitionBy(rule).orderBy("window_start")
    starts = runs.withColumn("_before", F.lag("firing").over(w)).filter(F.col("firing") & ~F.coalesce("_before", F.lit(False)))
    return starts.select(
        F.lit(level).alias("level"), F.lit(title).alias("title"), F.lit(message).alias("message"),
        F.create_map(F.lit("rule"), F.col(rule).cast("string"), F.lit("windows"), F.col("run").cast("string")).alias("metadata"),
        F.col("window_start").alias("ts"))
