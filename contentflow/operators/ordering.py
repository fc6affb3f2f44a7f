"""Numbering, previous-row and sliding-frame operators that have no single hot task.

A plain window over everything (or over one hot key) sorts in one task. Here the rows are first dealt into ranges
of the whole order by Spark's sampled range partitioning, on the values themselves, and written once; only one
small row for each range is then put in sequence. There are as many ranges as shuffle partitions, so a range
holds the same share of the rows at every size, and a hot first column is cut by the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentflow.session import cut_lineage

LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row number in the partition below


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` dealt into ranges of ``order`` with ``_range`` and ``_row`` (from 0, in order inside the range)."""
    count = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(count, *order).sortWithinPartitions(*order)
    mark = F.monotonically_increasing_id()
    return cut_lineage(placed.withColumn("_row", mark)).withColumn("_range", F.shiftright("_row", LOCAL_BITS)).withColumn(
        "_row", F.col("_row") - F.shiftleft(F.col("_range"), LOCAL_BITS))


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None, out: str = "n",
             ranges: int | None = None, weight: str | None = None) -> DataFrame:
    """1-based position of every row in ``order`` (ascending), per ``by`` key if given.

    With ``weight`` a row counts that often, and its position is that of its last count."""
    by = by or []
    cut = in_ranges(df, [*by, *order], ranges)
    keyed = [*by, "_range"]
    if weight:
        inside = Window.partitionBy(*keyed).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
        cut, size = cut.withColumn("_local", F.sum(weight).over(inside)), F.sum(weight)
    else:
        size = F.count(F.lit(1))
    counts = cut.groupBy(*keyed).agg(size.alias("_size"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keyed, "_first", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    if not by:
        offsets = F.broadcast(offsets)  # one row per range
    placed = cut.join(offsets, keyed)
    local = F.col("_local") if weight else F.col("_row") - F.col("_first") + 1
    return placed.withColumn(out, (F.col("_before") + local).cast("bigint")).drop("_range", "_row", "_local", "_before", "_first")


def with_frame(df: DataFrame, position: str, size: int, agg: Column, out: str, chunk: int = 100_000) -> DataFrame:
    """``agg`` over the last ``size`` rows of an already numbered frame.

    Rows are cut into chunks, at least as long as a frame; the last ``size - 1`` rows of a
    chunk are also shown to the next one, so every frame is complete inside its chunk."""
    chunk = max(chunk, size)
    at = F.col(position) - 1
    home = F.floor(at / chunk)
    shared = (at % chunk) >= chunk - (size - 1)
    spread = df.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.when(shared, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    frame = Window.partitionBy("_chunk").orderBy(position).rowsBetween(-(size - 1), 0)
    return (spread.withColumn(out, agg.over(frame)).filter(F.col("_chunk") == F.col("_home"))
            .drop("_home", "_chunk"))


def carry_max(df: DataFrame, keys: list[str], ts: str, tie: str, value: Column, out: str, inclusive: bool,
              ranges: int | None = None) -> DataFrame:
    """Greatest ``value`` among the earlier rows of the same key (with ``inclusive``, this row too).

    The rows are dealt into ranges of (key, time), so a hot key spreads over as many tasks as
    its share of the rows asks for; the greatest value of each part (one row per key and range)
    is carried into the later parts."""
    sliced = in_ranges(df.withColumn("_value", value), [*keys, ts, tie], ranges)
    tops = sliced.groupBy(*keys, "_range").agg(F.max("_value").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = tops.select(*keys, "_range", F.max("_top").over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        sliced.withColumn("_seen", F.max("_value").over(inside))
        .join(heads, [*keys, "_range"])
        .withColumn(out, F.coalesce("_seen", "_carried"))
        .drop("_range", "_row", "_value", "_seen", "_carried")
    )


def with_previous(df: DataFrame, keys: list[str], ts: str, tie: str, out: str = "prev_ts",
                  ranges: int | None = None) -> DataFrame:
    """Time of the previous row of the same key (null for the first)."""
    return carry_max(df, keys, ts, tie, F.col(ts), out, inclusive=False, ranges=ranges)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark cuts each task's rows to ``n`` per key before
    the shuffle (window group limit), so a hot key does not travel whole."""
    name = out or "_pos"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.filter(F.col(name) <= n)
    return ranked if out else ranked.drop(name)


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float, out: str) -> DataFrame:
    """The value at index floor(n * share) of the sorted values of each key, exactly.

    Equal values are counted first, so a frequent value is one row."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    placed = numbered(counts, [value], by=by, out="_pos", weight="_c").join(sizes, by)
    target = F.least(F.floor(F.col("_n") * share), F.col("_n") - 1) + 1
    return (placed.filter((F.col("_pos") >= target) & (F.col("_pos") - F.col("_c") < target))
            .select(*by, F.col(value).alias(out)))
