"""Streams give the same rows as the batch forms over the same data."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from contentflow.operators import metrics, stateful
from contentflow.sources.files import page_items, reading_list_pages
from contentflow.streaming import ingest
from contentflow.streaming import stateful as live

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, key string, ts timestamp, ok boolean"


def landed(spark, tmp_path, n=90, parts=3):
    """Rows in event order, landed as consecutive files."""
    rng = random.Random(11)
    rows, t = [], 0
    for i in range(n):
        t += rng.randrange(0, 240)
        rows.append((i, rng.choice("abc"), START + dt.timedelta(seconds=t), rng.random() > 0.4))
    for p in range(parts):
        chunk = rows[p * n // parts:(p + 1) * n // parts]
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.createDataFrame(rows, SCHEMA)


def stream(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(df, tmp_path, name, mode="append"):
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def rows_of(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_state_machines_match_batch(spark, tmp_path):
    batch = landed(spark, tmp_path)
    s = stream(spark, tmp_path)
    got = drain(live.accept_spaced(s, "key", "ts", "id", 600, True), tmp_path, "spaced")
    assert rows_of(got, ["id", "accepted"]) == rows_of(stateful.accept_spaced(batch, ["key"], "ts", "id", 600, True), ["id", "accepted"])
    cols = ["id", "state_before", "allowed", "state_after"]
    got = drain(live.breaker(s, "key", "ts", "id", "ok", 2, 300), tmp_path, "breaker")
    assert rows_of(got, cols) == rows_of(stateful.breaker_log(batch, "key", "ts", "id", "ok", 2, 300), cols)
    got = drain(live.token_bucket(s, "key", "ts", "id", 0.005, 2.0).withColumn("w", F.round("wait_seconds", 6)), tmp_path, "bucket")
    want = stateful.token_bucket_log(batch, "key", "ts", "id", 0.005, 2.0).withColumn("w", F.round("wait_seconds", 6))
    assert rows_of(got, ["id", "throttled", "w"]) == rows_of(want, ["id", "throttled", "w"])
    groups = drain(live.full_groups(s, "key", "ts", "id", 5), tmp_path, "groups")
    sizes = {(r.key, r.group_no): r.n for r in groups.groupBy("key", "group_no").agg(F.count("*").alias("n")).collect()}
    closed = {(r.key, r.group_no) for r in groups.filter("closes").collect()}
    assert closed == {k for k, n in sizes.items() if n == 5} and max(sizes.values()) == 5


def test_windows_match_batch(spark, tmp_path):
    batch = landed(spark, tmp_path)
    got = drain(ingest.windowed_counts(stream(spark, tmp_path), "ts", ["key"]), tmp_path, "win", "complete")
    want = metrics.windowed(batch, "ts", ["key"], [F.count(F.lit(1)).alias("increase")])
    assert rows_of(got, ["window_start", "key", "increase"]) == rows_of(want, ["window_start", "key", "increase"])
    once = drain(ingest.distinct_within(stream(spark, tmp_path), "key", "ts", "10 days"), tmp_path, "once")
    assert once.count() == 3


def page(token, nxt, ids, broken=()):
    items = [{"id": f"i{i}", "title": f"t{i}", "published": 1700000000 + i, "summary": {"content": "c"},
              "canonical": [{"href": f"https://example.com/{i % 4}"}], "tags": []} for i in ids]
    items += [{"id": f"b{i}", "published": 1} for i in broken]
    return json.dumps({"page_token": token, "continuation": nxt, "items": items})


def test_ingest_stores_every_link_once(spark, tmp_path):
    inbox = tmp_path / "pages"
    inbox.mkdir()
    (inbox / "1.json").write_text(page("", "p", range(3), broken=[0]))
    seen, sizes = [], []

    def run(i):
        q = ingest.ingest(ingest.page_stream(spark, str(inbox), 1), str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / "chk"),
                          on_batch=lambda b, r: seen.append((b, r)), name=f"ingest{i}")
        q.awaitTermination(120)
        assert q.exception() is None
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])

    run(0)
    (inbox / "2.json").write_text(page("p", None, range(2, 8)))
    run(1)
    stored = spark.read.parquet(str(tmp_path / "store"))
    rows = {r.original_url: r.publish_date for r in stored.collect()}
    assert stored.count() == 4 and sorted(rows) == [f"https://example.com/{i}" for i in range(4)]
    assert min(rows.values()) == rows["https://example.com/0"]  # the first of a link by date
    assert spark.read.text(str(tmp_path / "bad")).count() == 1
    assert sizes == [3, 4]  # one row of state for every link
    for _ in range(100):  # listeners are told after the query has ended
        if sum(r["seen"] for _, r in seen) == 10:
            break
        time.sleep(0.1)
    assert sum(r["seen"] for _, r in seen) == 10 and sum(r["quarantined"] for _, r in seen) == 1


def test_a_failed_batch_is_replayed(spark, tmp_path, monkeypatch):
    """The batch fails after its rows were written; the next run repeats it with the same id and state."""
    inbox = tmp_path / "pages"
    inbox.mkdir()
    items = lambda: ingest.page_stream(spark, str(inbox), 1)
    places = [str(tmp_path / n) for n in ("store", "bad", "chk")]
    (inbox / "1.json").write_text(page("", "p", range(3)))
    ingest.ingest(items(), *places).awaitTermination(120)
    (inbox / "2.json").write_text(page("p", None, range(2, 8), broken=[1]))
    writer = type(spark.range(1).write)
    text = writer.text

    def broken_text(self, path, **kinds):
        text(self, path, **kinds)
        raise OSError("the store went away")

    monkeypatch.setattr(writer, "text", broken_text)
    q = ingest.ingest(items(), *places)
    with pytest.raises(Exception, match="went away"):
        q.awaitTermination(120)
    monkeypatch.setattr(writer, "text", text)
    ingest.ingest(items(), *places).awaitTermination(120)
    links = [r.original_url for r in spark.read.parquet(places[0]).collect()]
    assert sorted(links) == [f"https://example.com/{i}" for i in range(4)]
    assert spark.read.text(places[1]).count() == 1


def test_live_counters_equal_the_batch(spark, tmp_path):
    inbox = tmp_path / "pages"
    inbox.mkdir()
    status = F.when(F.size("errors") > 0, "error").otherwise("success")
    counters = ingest.BatchMetrics("status")
    spark.streams.addListener(counters)
    for i, ids in enumerate((range(3), range(3, 5), ())):
        (inbox / f"{i}.json").write_text(page(str(i), str(i + 1), ids, broken=[i] if i < 2 else []))
        items = ingest.observed(ingest.page_stream(spark, str(inbox), 1), "status").withColumn("status", status)
        ingest.live_counts(items, "status", str(tmp_path / "live"), str(tmp_path / "lc")).awaitTermination(120)
    batch = page_items(reading_list_pages(spark, str(inbox))).groupBy(status.alias("status")).count()
    want = {r["status"]: r["count"] for r in batch.collect()}
    assert {r["status"]: r["n"] for r in ingest.live_table(spark, str(tmp_path / "live"), "status").collect()} == want == {"success": 5, "error": 2}
    for _ in range(100):
        if counters.totals["seen"] == 7:
            break
        time.sleep(0.1)
    spark.streams.removeListener(counters)
    assert dict(counters.totals) == {"seen": 7, "quarantined": 2}
