"""Queue queries: order, capacity, removal, batches, retries and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.operators import ordering, queueing
from contentflow.plans.records import ASOF_SQL
from contentflow.plans.registry import query
from contentflow.sources.views import ATTEMPTS_SQL, CONTENT_SQL, ITEMS_SQL, as_of


@query("G2_take_by_priority", "WITH " + ITEMS_SQL + "SELECT id, CAST(rank AS INTEGER) AS rank FROM items ORDER BY rank DESC, published, id LIMIT 100")
def take_by_priority(t):
    return queueing.take_next(t.items().select("id", "rank", "published"), 100).select("id", "rank")


@query("G3_capacity_with_eviction", "WITH " + ITEMS_SQL + """
SELECT id, rn <= 500 AS kept FROM (SELECT id, row_number() OVER (ORDER BY rank DESC, published, id) AS rn FROM items)""")
def capacity_with_eviction(t):
    return queueing.keep_within_capacity(t.items().select("id", "rank", "published"), 500).select("id", "kept")


@query("G4_overflow_count", "WITH " + ITEMS_SQL + """
SELECT feed, count(*) AS arrived, greatest(count(*) - 50, 0) AS overflow FROM items GROUP BY 1""")
def overflow_count(t):
    return queueing.overflow_counts(t.items(), ["feed"], 50)


@query("G5_remove_by_id", "WITH " + ITEMS_SQL + "SELECT id FROM items WHERE id NOT IN (SELECT id FROM items WHERE value > 50)")
def remove_by_id(t):
    return queueing.without(t.items().select("id"), t.items().filter("value > 50").select("id"))


@query("G6_purge_old", "WITH " + ITEMS_SQL + f" SELECT id FROM items WHERE published >= {ASOF_SQL} - INTERVAL 10 DAY")
def purge_old(t):
    from contentflow.operators.storage import keep_recent
    return keep_recent(t.items().select("id", "published"), "published", as_of(), 10).select("id")


@query("G14_rolling_batch_mean", "WITH " + ITEMS_SQL + """
SELECT id, round(avg(value) OVER (ORDER BY published, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS mean_last_100 FROM items""")
def rolling_batch_mean(t):
    n = ordering.numbered(t.items().select("published", "id", "value"), ["published", "id"])
    out = ordering.with_frame(n, "n", 100, F.avg("value"), "mean_last_100", chunk=2000)
    return out.select("id", F.round("mean_last_100", 6).alias("mean_last_100"))


@query("G15_recent_errors", """SELECT event_id FROM events WHERE event_type='error' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def recent_errors(t):
    return t.errors().orderBy(F.col("ts").desc(), F.col("error_no").desc()).limit(100).select(F.col("error_no").alias("event_id"))


@query("G17_minimum_gap", "WITH " + ATTEMPTS_SQL + """
SELECT attempt_id, round(greatest(0, 600 - coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY service ORDER BY ts, attempt_id)), 600000000)/1000000.0), 6) AS required_delay FROM attempts""")
def minimum_gap(t):
    """Delay each call would have needed to keep 600 seconds from the previous one."""
    p = ordering.with_previous(t.attempts().select("attempt_id", "service", "ts"), ["service"], "ts", "attempt_id")
    gap = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / 1000000
    return p.select("attempt_id", F.round(F.greatest(F.lit(0.0), 600 - F.coalesce(gap, F.lit(600.0))), 6).alias("required_delay"))


@query("I4_retry_lifecycle", "WITH " + ATTEMPTS_SQL + """,
f AS (SELECT item_id, count(*) AS retry_count, max(ts) AS last_failure FROM attempts WHERE NOT ok GROUP BY 1)
SELECT item_id, retry_count, CASE WHEN retry_count <= 3 THEN 'retrying' ELSE 'failed' END AS status,
 CASE WHEN retry_count <= 3 THEN 'low' ELSE '-' END AS queue_priority,
 CASE WHEN retry_count <= 3 THEN CAST(epoch_us(last_failure) + CAST(pow(2, retry_count) AS BIGINT) * 1000000 AS BIGINT) ELSE -1 END AS next_attempt_us FROM f""")
def retry_lifecycle(t):
    s = queueing.retry_state(t.attempts())
    return s.select("item_id", "retry_count", "status", F.coalesce("queue_priority", F.lit("-")).alias("queue_priority"),
                    F.coalesce(F.unix_micros("next_attempt"), F.lit(-1)).alias("next_attempt_us"))


@query("I5_requeue_failed_batches", "WITH " + ITEMS_SQL + """,
b AS (SELECT CAST((row_number() OVER (ORDER BY published, id) - 1) // 50 AS BIGINT) AS batch_id, id, value FROM items)
SELECT id, CAST(1 AS INTEGER) AS retry_count FROM b WHERE batch_id IN (SELECT batch_id FROM b GROUP BY 1 HAVING max(value) >= 150)""")
def requeue_failed_batches(t):
    b = queueing.assign_batches(t.items().select("published", "id", "value"), ["published", "id"], 50)
    b = b.select("batch_id", "id", "value").withColumn("retry_count", F.lit(0))
    ok = b.groupBy("batch_id").agg(F.max("value").alias("m")).filter("m < 150")
    return queueing.requeue_failed(b, ok, "batch_id").select("id", "retry_count")


@query("I6_full_groups_of_five", """
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS total FROM documents WHERE length(text) >= 100)
SELECT doc_id, CAST((n-1)//5 AS BIGINT) AS group_no FROM a WHERE (n-1)//5 < total//5""")
def full_groups_of_five(t):
    a = t.documents().filter(F.length("text") >= 100).select("doc_id")
    return queueing.full_groups(a, ["doc_id"], 5).select("doc_id", "group_no")


@query("F27_queue_statistics", f"""
SELECT count(*) AS size, CAST(1000 AS BIGINT) AS max_size, CAST(3600 AS BIGINT) AS dedup_window,
 count(DISTINCT CASE WHEN ts >= {ASOF_SQL} - INTERVAL 3600 SECOND THEN props END) AS recent_hashes, count(DISTINCT props) AS hashes FROM events""")
def queue_statistics(t):
    i = t.items()
    recent = F.col("published") >= as_of() - F.expr("INTERVAL 3600 SECONDS")
    h = F.sha2("payload", 256)
    return i.agg(F.count(F.lit(1)).alias("size"), F.max(F.lit(1000)).cast("bigint").alias("max_size"),
                 F.max(F.lit(3600)).cast("bigint").alias("dedup_window"),
                 F.count_distinct(F.when(recent, h)).alias("recent_hashes"), F.count_distinct(h).alias("hashes"))


@query("F28_feed_check_stats", "WITH " + ITEMS_SQL + f"""
SELECT feed, strftime(max(published), '%Y-%m-%d %H:%M:%S') AS last_check,
 CAST(count(*) FILTER (WHERE published >= {ASOF_SQL} - INTERVAL 1 DAY) AS BIGINT) AS checks_in_window FROM items GROUP BY 1""")
def feed_check_stats(t):
    recent = F.col("published") >= as_of() - F.expr("INTERVAL 1 DAY")
    return t.items().groupBy("feed").agg(F.date_format(F.max("published"), "yyyy-MM-dd HH:mm:ss").alias("last_check"),
                                         F.count_if(recent).alias("checks_in_window"))


@query("F31_delivery_summary", "WITH " + ATTEMPTS_SQL + """
SELECT service, count(*) AS total, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS succeeded, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed,
 round(avg(seconds),6) AS mean_seconds, CAST(arg_max(CASE WHEN NOT ok THEN status_code END, CASE WHEN NOT ok THEN attempt_id END) AS INTEGER) AS last_error FROM attempts GROUP BY 1""")
def delivery_summary(t):
    bad = ~F.col("ok")
    return t.attempts().groupBy("service").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("ok")).alias("succeeded"), F.count_if(bad).alias("failed"),
        F.round(F.avg("seconds"), 6).alias("mean_seconds"),
        F.max_by(F.when(bad, F.col("status_code")), F.when(bad, F.col("attempt_id"))).alias("last_error"))


@query("F32_oldest_item_age", "WITH " + ITEMS_SQL + f"""
SELECT feed, round((epoch_us({ASOF_SQL}) - epoch_us(min(published)))/1000000.0, 6) AS oldest_age, count(*) AS queue_size, count(DISTINCT payload) AS distinct_contents FROM items GROUP BY 1""")
def oldest_item_age(t):
    return t.items().groupBy("feed").agg(
        F.round((F.unix_micros(as_of()) - F.unix_micros(F.min("published"))) / 1000000, 6).alias("oldest_age"),
        F.count(F.lit(1)).alias("queue_size"), F.count_distinct("payload").alias("distinct_contents"))
