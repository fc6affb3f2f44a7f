"""Landed files (reading lists, subscriptions, stored documents, the feed registry) and the projections made from their items."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from contentflow.operators import knowledge as kn
from contentflow.operators import normalize, summaries
from contentflow.plans.knowledge import CLAIM_SQL, claim_table, page_entities
from contentflow.plans.records import ASOF_SQL, FMT, RAW_SQL, raw_items, stamp
from contentflow.plans.registry import query
from contentflow.plans.textstats import EXTRACT_SQL, STOP, tok_sql
from contentflow.session import landed_json, landed_text
from contentflow.sinks import writers
from contentflow.sources import files
from contentflow.sources.views import ERRORS_SQL, ITEMS_SQL, as_of

PAGE = 20  # items of a reading-list page


def landed_reading_list(t):
    """Pages of twenty items as JSON lines; every seventh item lacks its summary, every eleventh its link."""
    i = raw_items(t).withColumn("_n", F.substring("id", 5, 20).cast("bigint"))
    i = i.withColumns({
        "summary": F.when(F.col("_n") % 7 != 3, F.col("summary")),
        "canonical": F.when(F.col("_n") % 11 == 4, F.array().cast("array<struct<href:string>>")).otherwise(F.col("canonical"))})
    item = F.struct("_n", "id", "title", "author", "published", "summary", "canonical", "categories", "tags")
    pages = i.groupBy(F.floor(F.col("_n") / PAGE).alias("_page")).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    token = lambda c: F.concat(F.lit("p"), c.cast("string"))
    return landed_json(pages.select(
        token(F.col("_page")).alias("page_token"), token(F.col("_page") + 1).alias("continuation"),
        F.transform("_items", lambda e: e.dropFields("_n")).alias("items")), "reading-list")


@query("A1_reading_list", "WITH " + RAW_SQL + f""",
landed AS (SELECT *, CAST(substr(id, 5) AS BIGINT) AS n FROM raw)
SELECT id, 'p' || (n // {PAGE}) AS page_token, title, author, published, CASE WHEN n % 7 <> 3 THEN content END AS content, CASE WHEN n % 11 <> 4 THEN url END AS url,
 concat_ws('; ', CASE WHEN n % 7 = 3 THEN 'Missing required fields' END, CASE WHEN n % 11 = 4 THEN 'Invalid canonical URL format' END) AS errors FROM landed""")
def reading_list(t):
    """Every item of every landed page, with what is wrong with it."""
    items = files.page_items(files.reading_list_pages(t.spark, landed_reading_list(t), multiline=False))
    return items.select("id", "page_token", "title", "author", "published", F.col("summary.content").alias("content"),
                        F.get("canonical", F.lit(0))["href"].alias("url"), F.array_join("errors", "; ").alias("errors"))


@query("A6_subscriptions", """
SELECT 'feed/' || c_custkey AS id, c_name AS title, 'https://feeds.example/' || c_custkey AS url, CASE WHEN c_acctbal > 0 THEN 'https://www.example/' || c_mktsegment END AS "htmlUrl"
FROM customer WHERE c_custkey // 25 % 7 <> 3 AND c_custkey // 25 % 7 <> 5""")
def subscription_list(t):
    """Subscriptions of customers, twenty-five to a document; answers that are no JSON, or have another body, give none."""
    n = F.col("c_custkey")
    sub = F.struct(F.concat(F.lit("feed/"), n).alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("https://feeds.example/"), n).alias("url"),
                   F.when(F.col("c_acctbal") > 0, F.concat(F.lit("https://www.example/"), "c_mktsegment")).alias("htmlUrl"))
    docs = t.read("customer").groupBy(F.floor(n / 25).alias("_d")).agg(F.collect_list(sub).alias("subscriptions"))
    body = (F.when(F.col("_d") % 7 == 3, F.lit("<html>busy</html>")).when(F.col("_d") % 7 == 5, F.lit('{"error": "denied"}'))
            .otherwise(F.to_json(F.struct("subscriptions"))))
    path = landed_text(docs.select(body.alias("value")), "subscription-answers")
    return files.subscriptions(t.spark, path, multiline=False)


STORED = "doc_id BIGINT, lang STRING, n_chars BIGINT"


@query("A15_stored_documents", """
SELECT doc_id, lang, n_chars, source AS name FROM documents WHERE source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 1)""")
def stored_documents(t):
    """Documents stored by source, read by names from a table; some of the names were never stored."""
    root = landed_json(t.read("documents").select("doc_id", "lang", "n_chars", F.col("source").alias("name")).filter("name is not null"), "stored", ["name"])
    names = t.read("nation").filter("n_regionkey = 1").select(F.concat(F.lit("src"), "n_nationkey").alias("name"))
    return files.documents_named(t.spark, root, names, STORED).select("doc_id", "lang", "n_chars", "name")


REGISTRY_SQL = """
registry AS (SELECT 'feed/' || s_suppkey AS url, s_name AS name, CASE s_nationkey % 3 WHEN 0 THEN 'BLOG' WHEN 1 THEN 'VIDEO' ELSE 'SOCIAL' END AS content_type,
 CASE WHEN d % 2 = 0 THEN 300 ELSE 60 + d END::INTEGER AS fetch_interval_seconds, CASE WHEN d % 3 = 0 THEN 30 ELSE 5 + d % 10 END::INTEGER AS max_items_per_fetch, 60::INTEGER AS retry_interval_seconds
 FROM (SELECT *, s_suppkey // 10 AS d FROM supplier))"""


def landed_registry(t):
    """Feeds of ten suppliers to a settings document; what a document doesn't state keeps its default."""
    d = F.floor(F.col("s_suppkey") / 10)
    kind = F.element_at(F.array(F.lit("BLOG"), F.lit("VIDEO"), F.lit("SOCIAL")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    feed = F.struct(F.concat(F.lit("feed/"), "s_suppkey").alias("url"), F.col("s_name").alias("name"), kind.alias("content_type"))
    docs = t.read("supplier").groupBy(d.alias("d")).agg(F.collect_list(feed).alias("feeds"))
    return landed_json(docs.select("feeds", F.when(F.col("d") % 2 != 0, 60 + F.col("d")).cast("int").alias("fetch_interval_seconds"),
                                   F.when(F.col("d") % 3 != 0, 5 + F.col("d") % 10).cast("int").alias("max_items_per_fetch")), "feed-settings")


@query("A16_feed_registry", "WITH " + REGISTRY_SQL.strip() + " SELECT * FROM registry")
def feed_registry(t):
    return files.feed_registry(t.spark, landed_registry(t), multiline=False)


@query("A16_newest_within_cap", "WITH " + ITEMS_SQL + "," + REGISTRY_SQL + """
SELECT feed, id, published FROM (SELECT i.feed, i.id, strftime(i.published, '%Y-%m-%d %H:%M:%S') AS published, max_items_per_fetch AS cap,
 row_number() OVER (PARTITION BY i.feed ORDER BY i.published DESC, i.id DESC) AS place FROM items i JOIN registry r ON r.url = i.feed) WHERE place <= cap""")
def newest_within_cap(t):
    """The newest items of each registered feed, up to the cap of its settings."""
    registry = files.feed_registry(t.spark, landed_registry(t), multiline=False)
    return files.capped_per_feed(t.items().select("feed", "id", "published"), registry, "published", "id").select("feed", "id", stamp("published").alias("published"))


@query("H55_labels", "WITH " + ITEMS_SQL + " SELECT id, category || '|' AS labels FROM items")
def label_arrays(t):
    """Labels of struct arrays; the second one of every item is missing."""
    return raw_items(t).select(F.substring("id", 5, 20).cast("bigint").alias("id"), F.array_join(normalize.labels("categories"), "|").alias("labels"))


@query("B12_alert_messages", "WITH " + ERRORS_SQL + """
SELECT error_no, '{"text":"*' || category || '*\\n' || message || '","attachments":[{"color":"' ||
 CASE severity WHEN 'critical' THEN '#7b001c' WHEN 'high' THEN '#ff0000' WHEN 'medium' THEN '#ffa500' ELSE '#36a64f' END ||
 '","fields":[{"title":"service","value":"' || service || '","short":true},{"title":"severity","value":"' || severity || '","short":true}],"ts":' ||
 CAST(floor(epoch(ts)) AS BIGINT) || '}]}' AS payload FROM errors""")
def alert_messages(t):
    """Error log entries as outgoing alert messages."""
    level = F.when(F.col("severity") == "critical", "critical").when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warning").otherwise("info")
    events = t.errors().select("error_no", level.alias("level"), F.col("category").alias("title"), "message",
                               F.create_map(F.lit("service"), "service", F.lit("severity"), "severity").alias("metadata"), "ts")
    return writers.alert_messages(events).select("error_no", "payload")


@query("C3_legacy_payload", "WITH " + RAW_SQL + f"""
SELECT 'BLOG' AS "contentType", title, trim(substr(content, 1, 200)) || '...' AS brief, url AS original_url, strftime(make_timestamp(published * 1000000), '%Y-%m-%dT%H:%M:%S') AS publish_date,
 CASE WHEN category = 'error' THEN 'High' WHEN epoch_us({ASOF_SQL}) - published * 1000000 < 86400000000 THEN 'Medium' ELSE 'Low' END AS priority, author, category AS tags, substr(id, 5) AS feed_id FROM raw""")
def legacy_payload(t):
    """Items in the first delivery format."""
    raw = raw_items(t)
    important = F.when(raw["categories"][0]["label"] == "error", "important")
    flat = raw.select("title", F.col("summary").alias("content"), F.array_compact(F.array(raw["categories"][0]["label"], important)).alias("categories"),
                      F.struct(F.substring("id", 5, 20).alias("streamId")).alias("origin"), F.transform("canonical", lambda c: c["href"]).alias("canonical"), "published", "author")
    out, m = normalize.legacy_payload(flat, as_of()), F.col("sourceMetadata")
    return out.select("contentType", "title", "brief", m["originalUrl"].alias("original_url"), m["publishDate"].alias("publish_date"), "priority", m["author"].alias("author"),
                      m["tags"][0].alias("tags"), m["feedId"].alias("feed_id"))


@query("C4_feed_header", "WITH " + ITEMS_SQL + f"""
SELECT CASE WHEN k % 2 = 0 THEN 'id:' ELSE 'guid:' END || id AS id, title, payload AS "full", left(repeat(title || ' ', 150), 2000) AS brief, 'html' AS format, feed AS feed_id,
 CASE WHEN k % 4 = 0 THEN 'id:' || id ELSE url END AS url, CASE WHEN k % 5 <> 0 THEN strftime(published, {FMT}) END AS publish_date, '' AS author, 'en' AS language,
 category AS tags, 'pending' AS status, 'Medium' AS priority FROM items""")
def feed_header(t):
    """Headers of RSS feeds: id or guid, link or id, a date that doesn't parse becomes null."""
    i, k = t.items(), F.col("k")
    none = F.lit(None).cast("string")
    raw = i.select(
        F.when(k % 2 == 0, F.concat(F.lit("id:"), "id")).alias("id"), F.concat(F.lit("guid:"), "id").alias("guid"), "title", F.col("payload").alias("content"),
        F.repeat(F.concat("title", F.lit(" ")), 150).alias("summary"), F.when(k % 4 != 0, F.col("url")).alias("link"), none.alias("author"), F.lit("en").alias("language"),
        F.col("feed").alias("feed_id"), F.array("category").alias("tags"), none.alias("updated"), none.alias("date_published"),
        F.when(k % 5 == 0, "some day").otherwise(F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss '+0000'")).alias("pubDate"))
    out = normalize.feed_header(raw, "rss", as_of())
    s = F.col("metadata.source")
    return out.select("id", "title", "content.full", "content.brief", "content.format", s["feedId"].alias("feed_id"), s["url"].alias("url"), stamp(s["publishDate"]).alias("publish_date"),
                      s["author"].alias("author"), s["language"].alias("language"), F.array_join(s["tags"], ",").alias("tags"), F.col("metadata.processing.status").alias("status"), "analysis.priority")


@query("H29_abstractive_summary", EXTRACT_SQL + """,
o AS (SELECT *, sum(n_words) OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM r)
SELECT doc_id, string_agg(sentence, '. ' ORDER BY pos) AS summary FROM o WHERE total <= 60 OR rn = 1 GROUP BY 1""")
def abstractive_summary(t):
    """Without a model the summary is the extractive one within the same budget."""
    return summaries.abstractive_summary(t.documents().select("doc_id", "text"), ["doc_id"], max_words=60)


LEAD = 40  # words that the model of J2 keeps


def leading_words(texts):
    """A stand-in for a text model: a list of texts to the list of their openings."""
    return [None if s is None else " ".join(re.findall(r"[^ \t\n\r\f]+", s)[:LEAD]) for s in texts]


@query("J2_text_model", f"SELECT doc_id, array_to_string(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')[1:{LEAD}], ' ') AS summary FROM documents")
def text_model(t):
    """Summaries by a model of the caller's, one call for each Arrow batch."""
    return summaries.abstractive_summary(t.documents().select("doc_id", "text"), ["doc_id"], model=leading_words)


@query("J4_evidence_classes", "WITH " + CLAIM_SQL + f""",
js AS (SELECT *, list_distinct(list_filter({tok_sql('claim')}, lambda w: w NOT IN {STOP})) AS own, list_distinct({tok_sql('evidence')}) AS body FROM evd),
jd AS (SELECT *, CASE WHEN len(own)=0 THEN 0 ELSE len(list_intersect(own, body))::DOUBLE/len(own) END AS score,
 (len(list_filter({tok_sql('claim')}, lambda w: w IN ('not','no','never','none','neither'))) > 0) <> (len(list_filter({tok_sql('evidence')}, lambda w: w IN ('not','no','never','none','neither'))) > 0) AS neg FROM js)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, entity, source, CASE WHEN neg THEN 'contradicts' ELSE 'supports' END AS verdict, round(score, 6)::DOUBLE AS score FROM jd WHERE score > 0.1""")
def evidence_classes(t):
    """Each claim with the pages about its entities: what supports it and what contradicts it."""
    pages = page_entities(t).select("name", F.col("page_id").alias("source"), "body").distinct()
    judged = kn.judge_evidence(kn.claim_evidence(claim_table(t), pages, ["doc_id", "pos"]), relevant_above=0.1)
    return judged.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "entity", "source", "verdict", F.round("score", 6).alias("score"))
