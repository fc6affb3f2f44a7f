"""Micro-batch ingestion: landed pages or pushed items to a deduplicated store."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from contentflow import schemas
from contentflow.functions import checks
from contentflow.operators import metrics, normalize
from contentflow.sources.files import page_items


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Items with ``errors`` from a folder that pages keep landing in."""
    pages = (spark.readStream.schema(schemas.READING_LIST).option("multiLine", True)
             .option("maxFilesPerTrigger", files_per_batch).json(path))
    return page_items(pages)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_of_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row (by ``order``, nulls first) of every key that no earlier micro-batch had.

    A key is one flag in the state store, so a micro-batch costs what its own keys cost, however many were stored
    before. The rows of a key pass through in chunks; one row is held."""

    def step(_, frames, state):
        known, best = state.exists, None
        for pdf in frames:
            if not known:
                rows_ = pdf if best is None else pd.concat([best, pdf])
                best = rows_.sort_values(order, na_position="first", kind="stable").head(1)
        if best is not None:
            state.update((True,))
            yield best

    return rows.groupBy(key).applyInPandasWithState(step, rows.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


class BatchMetrics(StreamingQueryListener):
    """Hands the observed metrics of one query to ``tell(batch id, {name: value})`` and keeps their running totals."""

    def __init__(self, name: str, tell: Callable[[int, dict], None] | None = None):
        self.name, self.tell, self.totals = name, tell, Counter()
        self._last = -1

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row, batch = event.progress.observedMetrics.get(self.name), event.progress.batchId
        if row is not None and batch > self._last:
            self._last = batch
            told = {k: v or 0 for k, v in row.asDict().items()}
            self.totals.update(told)
            if self.tell is not None:
                self.tell(batch, told)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed(items: DataFrame, name: str) -> DataFrame:
    """Counts rows and rows with errors on the way through; a :class:`BatchMetrics` of that name receives them, no
    second pass over a micro-batch is made."""
    return items.observe(name, F.count(F.lit(1)).alias("seen"), F.count_if(F.size("errors") > 0).alias("quarantined"))


def ingest(items: DataFrame, store: str, quarantine: str, checkpoint: str, interval: str | None = None,
           on_batch: Callable[[int, dict], None] | None = None, name: str = "ingest") -> StreamingQuery:
    """Normalise, keep broken rows aside, and store every link once.

    ``interval`` such as ``60 seconds`` runs forever; None takes what is there and ends. Links that were stored are
    known from keyed state, the store is never read. A failed batch is retried by the engine on the state before it, and
    both folders are named by the batch id and overwritten, so a replay changes nothing."""
    spark = items.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    good, bad = checks.split_valid(observed(items, name))
    flat = normalize.db_record(normalize.content_item(good)).filter(F.col("original_url").isNotNull())
    new = first_of_key(flat, "original_url", ["publish_date", "feed_id"])
    broken = bad.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema], F.to_json(F.struct("*")).alias("_bad"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.filter("_bad is null").drop("_bad").write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
            batch.filter("_bad is not null").select("_bad").write.mode("overwrite").text(f"{quarantine}/batch={batch_id}")
        finally:
            batch.unpersist()

    if on_batch is not None:
        spark.streams.addListener(BatchMetrics(name, on_batch))
    rows = new.withColumn("_bad", F.lit(None).cast("string")).unionByName(broken)
    writer = rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def live_counts(items: DataFrame, label: str, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Running totals per label. Update mode: a micro-batch writes the labels that it changed, under its own id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = (items.groupBy(label).agg(F.count(F.lit(1)).alias("n")).writeStream.outputMode("update").foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def live_table(spark: SparkSession, path: str, label: str) -> DataFrame:
    """The latest total of every label."""
    rows = spark.read.schema(f"`{label}` string, n bigint, batch bigint").parquet(path)
    return rows.groupBy(label).agg(F.max_by("n", "batch").alias("n"))


def windowed_counts(events: DataFrame, ts: str, labels: list[str], minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Per-window counts and rates; windows close once the watermark has passed them."""
    counted = metrics.windowed(events.withWatermark(ts, late), ts, labels, [F.count(F.lit(1)).alias("increase")], minutes)
    return counted.withColumn("rate", F.col("increase") / (minutes * 60))


def distinct_within(events: DataFrame, key: str, ts: str, window: str = "1 hour") -> DataFrame:
    """Built-in dedup: one row per key while its state lives."""
    return events.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])
