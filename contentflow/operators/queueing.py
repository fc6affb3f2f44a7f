"""Queue semantics as set operations: order, capacity, batches, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.operators.ordering import numbered


def take_next(queue: DataFrame, n: int, rank: str = "rank", arrival: list[str] | None = None) -> DataFrame:
    """The next ``n`` rows: highest priority first, oldest first inside a priority."""
    arrival = arrival or ["published", "id"]
    return queue.orderBy(F.col(rank).desc(), *[F.col(a).asc() for a in arrival]).limit(n)


def keep_within_capacity(arrivals: DataFrame, capacity: int, rank: str = "rank",
                         arrival: list[str] | None = None) -> DataFrame:
    """Every arrival with ``kept``: a full queue evicts the newest row of the lowest
    level below the newcomer, else refuses the newcomer. For arrivals alone the
    survivors are the first ``capacity`` rows by priority, then arrival.

    Each task sends at most ``capacity`` rows for the last place of the queue, and every arrival is compared with that
    place; nothing is sorted or numbered as a whole. ``arrival`` must tell rows apart: rows that share a place are kept
    or refused together."""
    place = F.struct((-F.col(rank)).alias("_down"), *[F.col(a) for a in arrival or ["published", "id"]])
    if capacity <= 0:
        return arrivals.withColumn("kept", F.lit(False))
    queue = arrivals.select(place.alias("_place")).orderBy("_place").limit(capacity)
    last = queue.agg(F.max("_place").alias("_last")).scalar()
    return arrivals.withColumn("kept", F.coalesce(place <= last, F.lit(False)))


def overflow_counts(arrivals: DataFrame, by: list[str], capacity: int) -> DataFrame:
    """Rows beyond the capacity of a queue that never evicts, per key."""
    return arrivals.groupBy(*by).agg(F.count(F.lit(1)).alias("arrived")).withColumn(
        "overflow", F.greatest(F.col("arrived") - capacity, F.lit(0)))


def without(queue: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """The queue after removing the listed ids."""
    return queue.join(removed.select(key).distinct(), key, "left_anti")


def assign_batches(df: DataFrame, order: list[str], size: int, out: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``size`` rows in the given order; also keeps ``n``."""
    return numbered(df, order, out="n").withColumn(out, F.floor((F.col("n") - 1) / size))


def batch_payloads(df: DataFrame, order: list[str], size: int, item: Column) -> DataFrame:
    """One JSON payload ``{"items": [...]}`` per batch; a batch holds at most ``size`` rows."""
    batches = assign_batches(df.withColumn("_item", item), order, size)
    body = F.transform(F.sort_array(F.collect_list(F.struct("n", "_item"))), lambda x: x["_item"])
    return (
        batches.groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("n_items"), F.to_json(F.struct(body.alias("items"))).alias("payload"))
        .withColumn("payload_bytes", F.octet_length("payload"))
    )


def sent_until_failure(batches: DataFrame, ok: str, batch: str = "batch_id") -> DataFrame:
    """Batches up to and including the first failed one (a scalar subquery, then a filter)."""
    first_bad = batches.agg(F.min(F.when(~F.col(ok), F.col(batch)))).scalar()
    return batches.filter(first_bad.isNull() | (F.col(batch) <= first_bad))


def retry_state(attempts: DataFrame, key: str = "item_id", max_retries: int = 3) -> DataFrame:
    """Where each item stands after its failures; retries wait 2^n seconds at low priority."""
    state = attempts.groupBy(key).agg(
        F.count_if(~F.col("ok")).alias("retry_count"),
        F.max(F.when(~F.col("ok"), F.col("ts"))).alias("last_failure"))
    retrying = F.col("retry_count") <= max_retries
    return state.filter("retry_count > 0").select(
        key, "retry_count",
        F.when(retrying, "retrying").otherwise("failed").alias("status"),
        F.when(retrying, "low").alias("queue_priority"),
        F.when(retrying, F.timestamp_micros(
            F.unix_micros("last_failure") + (F.pow(F.lit(2.0), F.col("retry_count")) * 1000000).cast("bigint"))
        ).alias("next_attempt"))


def requeue_failed(batch_items: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """Items of failed batches go back with one more retry."""
    return batch_items.join(delivered.select(key).distinct(), key, "left_anti").withColumn(
        "retry_count", F.coalesce(F.col("retry_count"), F.lit(0)) + 1)


def full_groups(df: DataFrame, order: list[str], size: int, out: str = "group_no") -> DataFrame:
    """Groups of exactly ``size`` accepted rows in order; leftovers wait for more input."""
    full = df.agg(F.floor(F.count(F.lit(1)) / size)).scalar()
    return assign_batches(df, order, size, out).filter(F.col(out) < full)
