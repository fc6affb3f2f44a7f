"""Metric, error-statistics and alert queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contentflow.operators import metrics as m
from contentflow.operators import ordering
from contentflow.plans.registry import query
from contentflow.sources.views import ATTEMPTS_SQL, ERRORS_SQL, ITEMS_SQL, SAMPLES_SQL, small_table
from contentflow.vocab import DURATION_BOUNDS, ERROR_CATEGORIES, SIZE_BOUNDS

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(c):
    return F.date_format(c, STAMP)


def r6(c):
    return F.round(c, 6)


@query("F2_labelled_counters", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def labelled_counters(t):
    return m.labelled_counts(t.samples(), ["status"])


@query("F3_gauge_latest", "WITH " + SAMPLES_SQL + " SELECT status, arg_max(value, sample_id) AS value FROM samples GROUP BY 1")
def gauge_latest(t):
    return m.latest_value(t.samples(), ["status"], "value", F.struct("ts", "sample_id"))


LE = "VALUES ('0.1',0.1),('0.5',0.5),('1',1.0),('2',2.0),('5',5.0),('+Inf',1e300)"


@query("F4_histogram_buckets", "WITH " + SAMPLES_SQL + f"""
SELECT status, b.le, CAST(count(*) FILTER (WHERE value <= b.bound) AS BIGINT) AS bucket, round(sum(value),4) AS sum, count(*) AS count
FROM samples, ({LE}) b(le, bound) GROUP BY 1, 2
UNION ALL SELECT 'bytes', b.le, CAST(count(*) FILTER (WHERE strlen(text) <= b.bound) AS BIGINT), CAST(sum(strlen(text)) AS DOUBLE), count(*)
FROM documents, (VALUES ('1000',1e3),('10000',1e4),('100000',1e5),('1e+06',1e6),('+Inf',1e300)) b(le, bound) GROUP BY 1, 2""")
def histogram_buckets(t):
    durations = m.histogram(t.samples(), ["status"], "value", DURATION_BOUNDS).withColumn("sum", F.round("sum", 4))
    sizes = t.documents().select(F.lit("bytes").alias("status"), F.octet_length("text").cast("double").alias("size"))
    return durations.unionByName(m.histogram(sizes, ["status"], "size", SIZE_BOUNDS))


@query("F5_metric_summary", "WITH " + SAMPLES_SQL + """
SELECT status, count(*) AS n, round(avg(value),6) AS mean, min(value) AS low, max(value) AS high FROM samples GROUP BY 1""")
def metric_summary(t):
    return m.summary(t.samples(), ["status"], "value").withColumn("mean", r6("mean"))


@query("F6_metrics_snapshot", "WITH " + SAMPLES_SQL + """,
s AS (SELECT * FROM samples WHERE ts <= TIMESTAMP '2024-01-15 12:00:00')
SELECT 'items_total' AS metric, status, CAST(count(*) AS DOUBLE) AS value FROM s GROUP BY 2
UNION ALL SELECT 'last_seconds', status, arg_max(value, sample_id) FROM s GROUP BY 2
UNION ALL SELECT 'mean_seconds', status, round(avg(value),6) FROM s GROUP BY 2""")
def metrics_snapshot(t):
    """Counter, gauge and summary in one aggregate, then turned to long form."""
    s = t.samples().filter(F.col("ts") <= F.lit("2024-01-15 12:00:00").cast("timestamp"))
    wide = s.groupBy("status").agg(
        F.count(F.lit(1)).cast("double").alias("items_total"),
        F.max_by("value", F.struct("ts", "sample_id")).alias("last_seconds"), r6(F.avg("value")).alias("mean_seconds"))
    return wide.unpivot("status", ["items_total", "last_seconds", "mean_seconds"], "metric", "value")


@query("F7_error_metrics", "WITH " + ERRORS_SQL + """
SELECT c.category, count(e.error_no) AS n FROM (VALUES ('api_error'),('processing_error'),('delivery_error'),('rate_limit_error'),('system_error')) c(category)
LEFT JOIN errors e USING (category) GROUP BY 1""")
def error_metrics(t):
    dim = small_table(t.spark, [(c,) for c in ERROR_CATEGORIES], "category string")
    return m.zero_filled(m.labelled_counts(t.errors(), ["category"]), dim, "category", "n")


@query("F8_counts_by_priority", "WITH " + ITEMS_SQL + """
SELECT p.priority, count(i.id) AS n FROM (VALUES ('low',0),('normal',1),('high',2),('urgent',3)) p(priority, r) LEFT JOIN items i ON i.rank = p.r GROUP BY 1
UNION ALL SELECT 'total', count(*) FROM items""")
def counts_by_priority(t):
    names = F.element_at(F.array(F.lit("low"), F.lit("normal"), F.lit("high")), F.col("rank") + 1)
    counts = m.labelled_counts(t.items().select(names.alias("priority")), ["priority"])
    dim = small_table(t.spark, [("low",), ("normal",), ("high",), ("urgent",)], "priority string")
    filled = m.zero_filled(counts, dim, "priority", "n")
    return filled.unionByName(counts.agg(F.sum("n").alias("n")).select(F.lit("total").alias("priority"), "n"))


@query("F9_success_rate", "WITH " + ATTEMPTS_SQL + """
SELECT service, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS successes, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failures,
 round(100.0 * count(*) FILTER (WHERE ok) / count(*), 6) AS success_rate, round((epoch_us(max(ts)) - epoch_us(min(ts)))/1000000.0, 6) AS elapsed FROM attempts GROUP BY 1""")
def success_rate(t):
    out = t.attempts().groupBy("service").agg(*m.success_rate(F.col("ok")), r6(m.elapsed_seconds("ts")).alias("elapsed"))
    return out.withColumn("success_rate", r6("success_rate"))


@query("F10_processing_summary", "WITH " + ITEMS_SQL + """
SELECT CAST(count(*) FILTER (WHERE category <> 'error') AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE category = 'error') AS BIGINT) AS failed,
 CAST(count(*) FILTER (WHERE category = 'view') AS BIGINT) AS queued, CAST(count(*) FILTER (WHERE category = 'purchase') AS BIGINT) AS delivered,
 round(count(*) * 1.0 / count(DISTINCT date_trunc('hour', published)), 6) AS mean_batch_size,
 strftime(max(CASE WHEN category <> 'error' THEN published END), '%Y-%m-%d %H:%M:%S') AS last_processed,
 strftime(max(CASE WHEN category = 'purchase' THEN published END), '%Y-%m-%d %H:%M:%S') AS last_delivered FROM items""")
def processing_summary(t):
    """One hour's items are one batch; hourly partial sums keep the distinct count cheap."""
    kind = F.col("category")
    hourly = t.items().groupBy(F.date_trunc("hour", "published").alias("hour")).agg(
        F.count(F.lit(1)).alias("size"), F.count_if(kind == "error").alias("failed"), F.count_if(kind == "view").alias("queued"),
        F.count_if(kind == "purchase").alias("delivered"),
        F.max(F.when(kind != "error", F.col("published"))).alias("p"), F.max(F.when(kind == "purchase", F.col("published"))).alias("d"))
    return hourly.agg(
        (F.sum("size") - F.sum("failed")).alias("processed"), F.sum("failed").alias("failed"), F.sum("queued").alias("queued"),
        F.sum("delivered").alias("delivered"), r6(F.avg("size")).alias("mean_batch_size"),
        stamp(F.max("p")).alias("last_processed"), stamp(F.max("d")).alias("last_delivered"))


def attempts_reached(failures, count):
    """(attempt, n): how many rows reached each attempt number. Rows are counted by their number of failures first,
    so the sequences are as many as there are distinct numbers, whatever the rows."""
    sizes = failures.groupBy(F.col(count).cast("bigint").alias("_most")).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.select("_rows", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_most"))).alias("attempt")).groupBy(
        "attempt").agg(F.sum("_rows").alias("n"))


@query("F11_retries_by_attempt", "WITH " + ATTEMPTS_SQL + """,
f AS (SELECT item_id, count(*) AS n FROM attempts WHERE NOT ok GROUP BY 1)
SELECT CAST(a AS BIGINT) AS attempt, count(*) AS n FROM (SELECT unnest(range(1, n + 1)) AS a FROM f) GROUP BY 1""")
def retries_by_attempt(t):
    """Attempt numbers follow from the failure count per item, so nothing is ranked."""
    f = t.attempts().filter(~F.col("ok")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return attempts_reached(f, "n").select(F.col("attempt"), "n")


W5 = "time_bucket(INTERVAL 5 MINUTE, ts)"
FMT = "'%Y-%m-%d %H:%M:%S'"


@query("F12_mean_latency", "WITH " + SAMPLES_SQL + f"""
SELECT strftime({W5}, {FMT}) AS window_start, status, round(sum(value)/count(*), 6) AS mean_seconds FROM samples GROUP BY {W5}, status""")
def mean_latency(t):
    w = m.windowed(t.samples(), "ts", ["status"], [(F.sum("value") / F.count("value")).alias("mean_seconds")])
    return w.select(stamp("window_start").alias("window_start"), "status", r6("mean_seconds").alias("mean_seconds"))


@query("F13_nearest_rank_p95", "WITH " + SAMPLES_SQL + """
SELECT status, value AS p95 FROM (SELECT status, value, row_number() OVER (PARTITION BY status ORDER BY value) AS rn, count(*) OVER (PARTITION BY status) AS n FROM samples)
WHERE rn = least(CAST(floor(n*0.95) AS BIGINT), n-1) + 1""")
def nearest_rank_p95(t):
    return ordering.nearest_rank(t.samples(), ["status"], "value", 0.95, "p95")


@query("F14_throughput", "WITH " + ATTEMPTS_SQL + """
SELECT service, round(CASE WHEN max(ts) > min(ts) THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts)))/1000000.0) ELSE 0 END, 9) AS per_second FROM attempts GROUP BY 1""")
def throughput(t):
    return t.attempts().groupBy("service").agg(
        F.round(F.coalesce(F.try_divide(F.count(F.lit(1)).cast("double"), m.elapsed_seconds("ts")), F.lit(0.0)), 9).alias("per_second"))


@query("F29_errors_by_class", "WITH " + ERRORS_SQL + " SELECT category, severity, service, count(*) AS n FROM errors GROUP BY ALL")
def errors_by_class(t):
    return m.labelled_counts(t.errors(), ["category", "severity", "service"])


@query("I8_windowed_rate", f"""
SELECT strftime({W5}, {FMT}) AS window_start, event_type AS status, count(*) AS increase, round(count(*)/300.0, 6) AS rate FROM events GROUP BY {W5}, event_type""")
def windowed_rate(t):
    w = m.windowed(t.samples(), "ts", ["status"], [F.count(F.lit(1)).alias("increase")])
    return w.select(stamp("window_start").alias("window_start"), "status", "increase", r6(F.col("increase") / 300).alias("rate"))


def GRID_SQL(agg, minutes=5):
    return f"""agg AS (SELECT time_bucket(INTERVAL {minutes} MINUTE, ts) AS w, {agg} FROM events GROUP BY 1),
grid AS (SELECT unnest(generate_series((SELECT min(w) FROM agg), (SELECT max(w) FROM agg), INTERVAL {minutes} MINUTE)) AS w)"""


RUN_SQL = """isl AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (ORDER BY w) AS island FROM flagged),
runs AS (SELECT *, CASE WHEN breach THEN row_number() OVER (PARTITION BY island, breach ORDER BY w) ELSE 0 END AS run FROM isl)"""


@query("I9_stalled_alert", "WITH " + GRID_SQL("count(*) FILTER (WHERE event_type='purchase') AS stored") + f""",
flagged AS (SELECT g.w, coalesce(a.stored,0) = 0 AS breach FROM grid g LEFT JOIN agg a USING (w)), {RUN_SQL}
SELECT strftime(w, {FMT}) AS window_start, CAST(run AS BIGINT) AS run, breach AND (run-1)*5 >= 10 AS firing FROM runs""")
def stalled_alert(t):
    """No stored item in a window, held for ten minutes."""
    w = m.windowed(t.samples(), "ts", [], [F.count_if(F.col("status") == "purchase").alias("stored")])
    full = m.fill_windows(w, ["stored"]).withColumn("rule", F.lit("stalled"))
    return m.breach_runs(full, ["rule"], F.col("stored") == 0, 10).select(stamp("window_start").alias("window_start"), "run", "firing")


@query("I10_error_ratio_alert", "WITH " + GRID_SQL("count(*) AS n, count(*) FILTER (WHERE event_type='error') AS bad", 60) + f""",
flagged AS (SELECT g.w, coalesce(a.bad * 1.0 / a.n > 0.1, false) AS breach, round(coalesce(a.bad * 1.0 / a.n, 0), 6) AS error_ratio FROM grid g LEFT JOIN agg a USING (w)), {RUN_SQL}
SELECT strftime(w, {FMT}) AS window_start, error_ratio, CAST(run AS BIGINT) AS run, breach AND (run-1)*60 >= 60 AS firing FROM runs""")
def error_ratio_alert(t):
    """More than a tenth of the samples are errors; hourly windows held for an hour."""
    w = m.windowed(t.samples(), "ts", [], [F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("bad")], 60)
    full = m.fill_windows(w, ["n", "bad"], 60).withColumn("rule", F.lit("errors"))
    full = full.withColumn("error_ratio", F.coalesce(F.try_divide(F.col("bad").cast("double"), F.col("n")), F.lit(0.0)))
    return m.breach_runs(full, ["rule"], F.col("error_ratio") > 0.1, 60, 60).select(
        stamp("window_start").alias("window_start"), r6("error_ratio").alias("error_ratio"), "run", "firing")


@query("I11_queue_size_alert", "WITH " + GRID_SQL("sum(CASE WHEN event_type IN ('view','signup') THEN 1 WHEN event_type='click' THEN -1 ELSE 0 END) AS delta") + f""",
depth AS (SELECT g.w, CAST(sum(coalesce(a.delta,0)) OVER (ORDER BY g.w) AS BIGINT) AS depth FROM grid g LEFT JOIN agg a USING (w)),
flagged AS (SELECT w, depth, depth > 100 AS breach FROM depth), {RUN_SQL}
SELECT strftime(w, {FMT}) AS window_start, depth, CAST(run AS BIGINT) AS run, breach AND (run-1)*5 >= 5 AS firing FROM runs""")
def queue_size_alert(t):
    """Depth = running sum of arrivals minus departures; alert above 100 held five minutes."""
    s = F.col("status")
    delta = F.sum(F.when(s.isin("view", "signup"), 1).when(s == "click", -1).otherwise(0)).alias("delta")
    full = m.fill_windows(m.windowed(t.samples(), "ts", [], [delta]), ["delta"]).withColumn("rule", F.lit("depth"))
    full = full.withColumn("depth", F.sum("delta").over(Window.partitionBy("rule").orderBy("window_start")))
    return m.breach_runs(full, ["rule"], F.col("depth") > 100, 5).select(stamp("window_start").alias("window_start"), "depth", "run", "firing")


B = ["0.1", "0.5", "1.0", "2.0", "5.0"]
QSQL = "CASE WHEN c0 >= r THEN 0.1*r/c0 " + " ".join(
    f"WHEN c{i} >= r THEN {B[i-1]} + ({B[i]}-{B[i-1]})*(r-c{i-1})/(c{i}-c{i-1})" for i in range(1, 5)) + " ELSE 5.0 END"


@query("I12_bucket_quantile_alert", "WITH " + SAMPLES_SQL + """,
agg AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, """ + ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS c{i}" for i, b in enumerate(B)) + """, count(*) * 0.95::DOUBLE AS r FROM samples GROUP BY 1),
grid AS (SELECT unnest(generate_series((SELECT min(w) FROM agg), (SELECT max(w) FROM agg), INTERVAL 5 MINUTE)) AS w),
q AS (SELECT w, """ + QSQL + """ AS p95 FROM agg),
flagged AS (SELECT w, coalesce(p95 > 2, false) AS breach, round(coalesce(p95, 0), 6)::DOUBLE AS p95 FROM grid LEFT JOIN q USING (w)), """ + RUN_SQL + f"""
SELECT strftime(w, {FMT}) AS window_start, p95, CAST(run AS BIGINT) AS run, breach AND (run-1)*5 >= 5 AS firing FROM runs""")
def bucket_quantile_alert(t):
    """p95 interpolated in cumulative buckets, above two seconds held five minutes."""
    w = m.windowed(t.samples(), "ts", [], [*m.bucket_columns("value", DURATION_BOUNDS), F.count(F.lit(1)).alias("n")])
    p95 = m.quantile_from_buckets([F.col(f"le_{i}") for i in range(5)], F.col("n"), DURATION_BOUNDS, 0.95)
    full = m.fill_windows(w.select("window_start", p95.alias("p95")), []).withColumn("rule", F.lit("p95"))
    return m.breach_runs(full, ["rule"], F.col("p95") > 2, 5).select(
        stamp("window_start").alias("window_start"), r6(F.coalesce("p95", F.lit(0.0))).alias("p95"), "run", "firing")


# Fixed values: (rule, metric, comparator, threshold, hold minutes).
RULES = [
    ("error rate", "error_ratio", ">", 0.01, 0),
    ("latency", "mean_seconds", ">", 5.0, 60),
    ("any failure", "failures", ">", 0.0, 60),
    ("rate drop", "rate_change", "<", -0.2, 0),
]


@query("I13_threshold_rules", "WITH " + SAMPLES_SQL + """,
agg AS (SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS w, count(*) AS n, count(*) FILTER (WHERE status='error') AS bad, avg(value) AS mean_seconds FROM samples GROUP BY 1),
lagged AS (SELECT *, lag(n) OVER (ORDER BY w) AS prev FROM agg),
long AS (SELECT w, 'error_ratio' AS metric, bad*1.0/n AS value FROM lagged UNION ALL SELECT w, 'mean_seconds', mean_seconds FROM lagged
 UNION ALL SELECT w, 'failures', bad FROM lagged UNION ALL SELECT w, 'rate_change', (n-prev)*1.0/prev FROM lagged),
flagged AS (SELECT rule, w, hold, coalesce(CASE cmp WHEN '>' THEN value > lim ELSE value < lim END, false) AS breach FROM long
 JOIN (VALUES ('error rate','error_ratio','>',0.01,0),('latency','mean_seconds','>',5.0,60),('any failure','failures','>',0.0,60),('rate drop','rate_change','<',-0.2,0)) r(rule,metric,cmp,lim,hold) USING (metric)),
isl AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (PARTITION BY rule ORDER BY w) AS island FROM flagged),
runs AS (SELECT *, CASE WHEN breach THEN row_number() OVER (PARTITION BY rule, island, breach ORDER BY w) ELSE 0 END AS run FROM isl)
SELECT rule, count(*) AS windows, CAST(count(*) FILTER (WHERE breach) AS BIGINT) AS breaches, CAST(count(*) FILTER (WHERE breach AND (run-1)*60 >= hold) AS BIGINT) AS firing, CAST(max(run) AS BIGINT) AS longest FROM runs GROUP BY 1""")
def threshold_rules(t):
    w = m.windowed(t.samples(), "ts", [], [F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("bad"),
                                           F.avg("value").alias("mean_seconds")], 60)
    prev = F.lag("n").over(Window.partitionBy(F.lit(1)).orderBy("window_start"))
    wide = w.withColumn("rate_change", (F.col("n") - prev) / prev).select(
        "window_start", (F.col("bad") / F.col("n")).alias("error_ratio"), "mean_seconds", F.col("bad").cast("double").alias("failures"), "rate_change")
    long = wide.unpivot("window_start", ["error_ratio", "mean_seconds", "failures", "rate_change"], "metric", "value")
    rules = small_table(t.spark, RULES, "rule string, metric string, comparator string, threshold double, hold_minutes int")
    runs = m.apply_rules(long, rules, 60)
    return runs.groupBy("rule").agg(F.count(F.lit(1)).alias("windows"), F.count_if("breach").alias("breaches"),
                                    F.count_if("firing").alias("firing"), F.max("run").alias("longest"))
