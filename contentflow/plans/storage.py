"""Stored-table queries: dedup, upsert, tag bridge, listing, retention, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.functions import rules, text
from contentflow.operators import normalize, ordering, queueing
from contentflow.operators import storage as st
from contentflow.plans.records import CATALOG_SQL, CTYPE_SQL, catalog, stamp
from contentflow.plans.registry import query
from contentflow.sources.views import AS_OF, ATTEMPTS_SQL, CONTENT_SQL, ERRORS_SQL, ITEMS_SQL, as_of

NEW_SQL = ITEMS_SQL + ", stored AS (SELECT DISTINCT url FROM items WHERE published < TIMESTAMP '2024-01-02 00:00:00')"


def new_and_stored(t):
    """Items of the first day are stored already; the rest arrive as one batch."""
    i = t.items()
    cut = F.lit("2024-01-02 00:00:00").cast("timestamp")
    return i.filter(F.col("published") >= cut), i.filter(F.col("published") < cut).select("url").distinct()


@query("B1_insert_if_new", "WITH " + NEW_SQL + """
SELECT id, url FROM (SELECT id, url, row_number() OVER (PARTITION BY url ORDER BY published, id) AS rn FROM items
 WHERE published >= TIMESTAMP '2024-01-02 00:00:00' AND url NOT LIKE 'not a link%') WHERE rn = 1 AND url NOT IN (SELECT url FROM stored)
UNION ALL SELECT id, '-' FROM items WHERE published >= TIMESTAMP '2024-01-02 00:00:00' AND url LIKE 'not a link%'""")
def insert_if_new(t):
    """First row per link, links not stored yet; rows without a link are all kept."""
    batch, stored = new_and_stored(t)
    batch = batch.select("id", "published", F.when(~F.col("url").startswith("not a link"), F.col("url")).alias("url"))
    return st.insert_if_new(batch, stored, "url", ["published", "id"]).select("id", F.coalesce("url", F.lit("-")).alias("url"))


@query("B2_upsert_by_id", "WITH " + ITEMS_SQL + """
SELECT feed, id, title FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY published >= TIMESTAMP '2024-01-20 00:00:00' DESC, likes DESC, id DESC) AS rn FROM items) WHERE rn = 1""")
def upsert_by_id(t):
    """Rows from a date on replace what was stored before it; inside either part the most liked row is the last write."""
    i = t.items().select("feed", "likes", "id", "title", "published")
    new = F.col("published") >= F.lit("2024-01-20 00:00:00").cast("timestamp")
    return st.upsert(i.filter(~new).drop("published"), i.filter(new).drop("published"), ["feed"], ["likes", "id"]).drop("likes")


@query("B3_tag_bridge", "WITH " + ITEMS_SQL + """,
pairs AS (SELECT DISTINCT feed AS feed_id, category || (k % 10) AS name FROM items),
known AS (SELECT row_number() OVER (ORDER BY name) AS tag_id, name FROM (SELECT DISTINCT name FROM pairs WHERE name LIKE 'view%')),
tags AS (SELECT * FROM known UNION ALL SELECT (SELECT max(tag_id) FROM known) + row_number() OVER (ORDER BY name), name
         FROM (SELECT DISTINCT name FROM pairs WHERE name NOT LIKE 'view%'))
SELECT p.feed_id, t.tag_id, t.name FROM pairs p JOIN tags t USING (name)""")
def tag_bridge(t):
    pairs = t.items().select(F.col("feed").alias("feed_id"), F.concat("category", (F.col("k") % 10).cast("string")).alias("name"))
    known = ordering.numbered(pairs.filter("name LIKE 'view%'").select("name").distinct(), ["name"], out="tag_id")
    tags, bridge = st.maintain_tags(pairs, known)
    return bridge.join(tags, "tag_id").select("feed_id", "tag_id", "name")


@query("B4_error_log", "WITH " + ERRORS_SQL + """
SELECT error_no, category AS error_type, message AS error_message, strftime(ts,'%Y-%m-%d') AS day FROM errors""")
def error_log(t):
    """Rows of the append-only log; ``day`` is the partition column of the sink."""
    return t.errors().select("error_no", F.col("category").alias("error_type"), F.col("message").alias("error_message"),
                             F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("B5_external_record", """
SELECT substring(regexp_extract(html,'<title>(.*?)</title>',1),1,99) AS "Title", 'BLOG' AS "Content Type",
 substring(regexp_replace(html,'<[^>]+>','','g'),1,500) AS "Description", 'page' || page_id AS "FeedID", url AS "Link",
 strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(page_id AS INTEGER)), '%Y-%m-%d') AS "PublishDate", '' AS "Author" FROM pages""")
def external_record(t):
    published = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("page_id") * 3600000000)
    return t.pages().select(*normalize.external_record(
        F.regexp_extract("html", "<title>(.*?)</title>", 1), rules.content_type_of_url("url"), "html",
        F.concat(F.lit("page"), F.col("page_id").cast("string")), "url", published, F.lit(None).cast("string")))


@query("B6_storage_batches", "WITH " + ITEMS_SQL + """
SELECT CAST((row_number() OVER (ORDER BY published, id) - 1) // 50 AS BIGINT) AS batch_id, id FROM items""")
def storage_batches(t):
    return queueing.assign_batches(t.items().select("published", "id"), ["published", "id"], 50).select("batch_id", "id")


@query("B7_webhook_batches", "WITH " + ITEMS_SQL + """,
b AS (SELECT CAST((row_number() OVER (ORDER BY published, id) - 1) // 50 AS BIGINT) AS batch_id, published, id, to_json({'id': id, 'title': title}) AS j FROM items)
SELECT batch_id, count(*) AS n_items, '{"items":[' || string_agg(j, ',' ORDER BY published, id) || ']}' AS payload,
 CAST(strlen('{"items":[' || string_agg(j, ',' ORDER BY published, id) || ']}') AS BIGINT) AS payload_bytes FROM b GROUP BY 1""")
def webhook_batches(t):
    out = queueing.batch_payloads(t.items().select("published", "id", "title"), ["published", "id"], 50, F.struct("id", "title"))
    return out.withColumn("payload_bytes", F.col("payload_bytes").cast("bigint"))


@query("B8_stop_at_first_failure", "WITH " + ITEMS_SQL + """,
b AS (SELECT CAST((row_number() OVER (ORDER BY published, id) - 1) // 50 AS BIGINT) AS batch_id, value FROM items),
s AS (SELECT batch_id, count(*) AS n_items, max(value) < 400 AS ok FROM b GROUP BY 1)
SELECT batch_id, n_items, ok FROM s WHERE batch_id <= coalesce((SELECT min(batch_id) FROM s WHERE NOT ok), 9223372036854775807)""")
def stop_at_first_failure(t):
    b = queueing.assign_batches(t.items().select("published", "id", "value"), ["published", "id"], 50)
    s = b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_items"), (F.max("value") < 400).alias("ok"))
    return queueing.sent_until_failure(s, "ok")


@query("B10_retention", "WITH " + ITEMS_SQL + f"""
SELECT published >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY AS kept, count(*) AS n FROM items GROUP BY 1""")
def retention(t):
    """Rows kept and removed by a 20-day retention."""
    i = t.items()
    kept = st.keep_recent(i, "published", as_of(), 20)
    gone = i.filter(F.col("published") < as_of() - F.expr("INTERVAL 20 DAYS"))
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit(True).alias("kept"), "n").unionByName(
        gone.agg(F.count(F.lit(1)).alias("n")).select(F.lit(False).alias("kept"), "n"))


@query("B11_error_projections", "WITH " + ERRORS_SQL + """
SELECT error_no, 'Error[' || error_no || ']: ' || category || ' (severity=' || severity || ') - ' || message AS line,
 '{"category":"' || category || '","message":"' || regexp_replace(regexp_replace(regexp_replace(message,'token=[a-zA-Z0-9_-]+','token=REDACTED','g'),
 'password=[a-zA-Z0-9_-]+','password=REDACTED','g'),'key=[a-zA-Z0-9_-]+','key=REDACTED','g') || '"}' AS reduced FROM errors""")
def error_projections(t):
    return t.errors().select(
        "error_no",
        F.format_string("Error[%s]: %s (severity=%s) - %s", F.col("error_no"), F.col("category"), F.col("severity"), F.col("message")).alias("line"),
        F.to_json(F.struct("category", rules.redact("message").alias("message"))).alias("reduced"))


@query("E1_outer_join_through_bridge", "WITH " + CATALOG_SQL + """
SELECT f.id, coalesce(n.name, '-') AS name FROM feeds f LEFT JOIN (SELECT * FROM names WHERE name NOT IN ('en','src0')) n ON n.feed_id = f.id""")
def outer_join_through_bridge(t):
    """Feeds without a matching tag survive."""
    feeds, bridge, tags = catalog(t)
    some = bridge.join(tags.filter(~F.col("name").isin("en", "src0")), "tag_id")
    return feeds.select("id").join(some, feeds["id"] == some["feed_id"], "left").select("id", F.coalesce("name", F.lit("-")).alias("name"))


@query("E2_dedup_by_stored_url", "WITH " + NEW_SQL + """
SELECT CASE WHEN url IN (SELECT url FROM stored) THEN 'duplicate' ELSE 'new' END AS status, count(*) AS n
FROM items WHERE published >= TIMESTAMP '2024-01-02 00:00:00' GROUP BY 1""")
def dedup_by_stored_url(t):
    batch, stored = new_and_stored(t)
    known = stored.select("url").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("known"), "duplicate").otherwise("new").alias("status")
    return batch.join(known, "url", "left").groupBy(status).agg(F.count(F.lit(1)).alias("n"))


@query("E3_trusted_sources", "WITH " + ITEMS_SQL + """
SELECT id FROM items WHERE lower(feed) IN (SELECT lower('FEED/' || c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')""")
def trusted_sources(t):
    trusted = t.read("customer").filter("c_mktsegment = 'BUILDING'").select(
        F.lower(F.concat(F.lit("FEED/"), F.col("c_custkey").cast("string"))).alias("source"))
    return t.items().select("id", F.lower("feed").alias("source")).join(trusted, "source", "left_semi").select("id")


@query("F1_tags_per_feed", "WITH " + CATALOG_SQL + """
SELECT feed_id, string_agg(DISTINCT name, ',' ORDER BY name) AS tags FROM names GROUP BY 1""")
def tags_per_feed(t):
    _, bridge, tags = catalog(t)
    return bridge.join(tags, "tag_id").groupBy("feed_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tags"))


@query("G1_newest_first_page", "WITH " + CATALOG_SQL + """
SELECT id, strftime(pub_date,'%Y-%m-%d %H:%M:%S') AS pub_date FROM feeds ORDER BY feeds.pub_date DESC, id LIMIT 15 OFFSET 10""")
def newest_first_page(t):
    feeds, _, _ = catalog(t)
    return feeds.orderBy(F.col("pub_date").desc(), "id").offset(10).limit(15).select("id", stamp("pub_date").alias("pub_date"))


@query("G21_newest_per_feed", "WITH " + ITEMS_SQL + """
SELECT feed, id FROM (SELECT feed, id, row_number() OVER (PARTITION BY feed ORDER BY published DESC, id DESC) AS rn FROM items) WHERE rn <= 30""")
def newest_per_feed(t):
    return ordering.top_per_key(t.items().select("feed", "id", "published"), ["feed"], [F.col("published").desc(), F.col("id").desc()], 30).select("feed", "id")


@query("I3_stored_once", "WITH " + ITEMS_SQL + """
SELECT url, arg_min(id, {'b': id % 3, 'i': id}) AS id FROM items GROUP BY 1""")
def stored_once(t):
    """Three batches, one after the other, through the insert rule: the stored state is the first item of every link."""
    i = t.items().select("url", "id")
    stored = i.limit(0)
    for batch in range(3):
        stored = stored.unionByName(st.insert_if_new(i.filter(F.col("id") % 3 == batch), stored, "url", ["id"]).select("url", "id"))
    return stored
