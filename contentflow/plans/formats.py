"""Feed documents, pushed items, payload forms and alert events derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.functions import checks, dates, rules
from contentflow.operators import metrics, normalize
from contentflow.plans.metrics import GRID_SQL, RUN_SQL
from contentflow.plans.records import AS_OF, RAW_SQL, raw_items, stamp
from contentflow.plans.registry import query
from contentflow.sinks import writers
from contentflow.sources import feeds, files
from contentflow.session import shared_table
from contentflow.sources.views import CONTENT_SQL, as_of


ITEMS_PER_FEED = 5

FEEDS_SQL = f"""
w AS (SELECT doc_id, doc_id // {ITEMS_PER_FEED} AS feed, lang, source, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+') AS w, date_trunc('second', ts) AS ts
      FROM documents LEFT JOIN events ON event_id = doc_id),
e AS (SELECT feed, doc_id, nullif(array_to_string(w[1:6], ' '), '') AS title, 'https://feeds.example/item/' || doc_id AS link,
      CASE WHEN len(w) >= 30 THEN array_to_string(w[1:30], ' ') END AS summary, source = 'src9' AS bad, ts FROM w),
x AS (SELECT feed, bool_or(bad) AS bad, arg_min(bad, doc_id) AS first_bad, sum((title IS NULL)::INT) AS untitled, sum((length(title) > 100)::INT) AS long_titles,
      max(length(title)) AS longest, max(length(summary)) AS longest_summary, sum((summary IS NULL)::INT) AS bare, sum((length(summary) > 5000)::INT) AS long_summaries,
      sum((bad OR ts IS NOT NULL)::INT) AS dated, sum(bad::INT) AS n_bad FROM e GROUP BY 1),
h AS (SELECT w.feed AS doc_id, CASE lang WHEN 'en' THEN 'rss' WHEN 'de' THEN 'atom' WHEN 'fr' THEN 'json' END AS kind, nullif(array_to_string(w[1:4], ' '), '') AS title,
      CASE WHEN source IN ('src3', 'src7') THEN 'feeds/' ELSE 'https://feeds.example/' END || w.feed AS link, CASE WHEN len(w) >= 12 THEN array_to_string(w[5:12], ' ') END AS description,
      CASE WHEN lang = 'fr' THEN first_bad ELSE source = 'src5' END AS bad_date, w.ts, x.* EXCLUDE (feed)
      FROM w JOIN x ON x.feed = w.feed WHERE w.doc_id = (SELECT min(doc_id) FROM w v WHERE v.feed = w.feed)),
f AS (SELECT *, kind IS NOT NULL AND NOT (kind = 'rss' AND title IS NULL) AND NOT bad_date AND NOT bad AS is_valid FROM h)"""


def feed_docs(t):
    """A feed document for every five documents: titles, summaries and dates come from the documents and events, what is
    missing or broken follows from them too. The language of the first one chooses RSS, Atom, JSON Feed or bare text."""
    d = t.documents().select("doc_id", "lang", "source", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)).alias("w"))
    d = d.withColumn("w", F.slice("w", 1, 30)).join(t.events().select(F.col("event_id").alias("doc_id"), "ts"), "doc_id", "left")

    def words(a, b):
        return F.nullif(F.array_join(F.slice("w", a, b - a + 1), " "), F.lit(""))

    iso, rfc = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    rows = d.select(
        F.floor(F.col("doc_id") / ITEMS_PER_FEED).alias("feed"), F.struct(
            "doc_id", "lang", "source", words(1, 6).alias("title"), words(1, 4).alias("head"), F.when(F.size("w") >= 12, words(5, 12)).alias("about"),
            F.when(F.size("w") >= 30, words(1, 30)).alias("summary"), iso.alias("iso"), rfc.alias("rfc")).alias("e"))
    feed = rows.groupBy("feed").agg(F.sort_array(F.collect_list("e")).alias("es")).withColumn("f", F.element_at("es", 1))

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def tag(name, value):
        return F.when(value.isNotNull(), text(f"<{name}>", value, f"</{name}>")).otherwise("")

    def pair(name, value):
        return F.when(value.isNotNull(), text(f'"{name}": "', value, '"'))

    def joined(*parts):
        return F.array_join(F.array_compact(F.array(*parts)), ", ")

    f, number = F.col("f"), F.col("feed").cast("string")
    link = F.when(f["source"].isin("src3", "src7"), text("feeds/", number)).otherwise(text("https://feeds.example/", number))
    item = lambda e: text("https://feeds.example/item/", e["doc_id"].cast("string"))
    day = lambda e, form, wrong: F.when(e["source"] == wrong, "some day").otherwise(e[form])
    rss = text("<rss><channel>", tag("title", f["head"]), tag("link", link), tag("description", f["about"]), tag("pubDate", day(f, "rfc", "src5")), F.array_join(
        F.transform("es", lambda e: text("<item>", tag("title", e["title"]), tag("link", item(e)), tag("description", e["summary"]), tag("pubDate", day(e, "rfc", "src9")), "</item>")), ""),
        "</channel></rss>")
    atom = text('<feed xmlns="http://www.w3.org/2005/Atom">', tag("title", f["head"]), '<link href="', link, '"/>', tag("updated", day(f, "iso", "src5")), F.array_join(
        F.transform("es", lambda e: text("<entry>", tag("title", e["title"]), '<link href="', item(e), '"/>', tag("summary", e["summary"]), tag("updated", day(e, "iso", "src9")), "</entry>")), ""),
        "</feed>")
    js = text("{", joined(F.lit('"version": "https://jsonfeed.org/version/1.1"'), pair("title", f["head"]), pair("home_page_url", link)), ', "items": [', F.array_join(
        F.transform("es", lambda e: text("{", joined(pair("title", e["title"]), pair("url", item(e)), pair("content_text", e["summary"]), pair("date_published", day(e, "iso", "src9"))), "}")), ", "),
        "]}")
    bare = F.coalesce(f["summary"], F.lit(""))
    kind = f["lang"]
    docs = feed.select(F.col("feed").alias("doc_id"), F.when(kind == "en", rss).when(kind == "de", atom).when(kind == "fr", js).otherwise(bare).alias("doc"))
    return shared_table(docs, "feed-documents")[0]  # landed once, as feeds are


@query("A10_feed_documents", "WITH" + FEEDS_SQL + """
SELECT doc_id, coalesce(kind, '-') AS feed_type, is_valid, CASE WHEN kind IS NULL THEN '-' ELSE coalesce(title, '-') END AS title, CASE WHEN kind IS NULL THEN '-' ELSE link END AS link,
 CASE WHEN kind IS NULL OR bad_date THEN '-' ELSE coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), '-') END AS updated FROM f""")
def feed_documents(t):
    f = F.col("feed")
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return feeds.parse_feeds(feed_docs(t)).select("doc_id", dash(F.col("feed_type")).alias("feed_type"), "is_valid", dash(f["title"]).alias("title"),
                                                  dash(f["link"]).alias("link"), dash(stamp(f["updated"])).alias("updated"))


ENTRY_SQL = "WITH" + FEEDS_SQL + """
SELECT f.doc_id, e.title, e.link, e.summary, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS updated, kind AS feed_type FROM f JOIN e ON e.feed = f.doc_id WHERE is_valid AND kind = '{kind}'"""


def entries_of(t, kind):
    parsed = feeds.parse_feeds(feed_docs(t))
    rows = feeds.feed_entries(parsed.withColumn("is_valid", F.col("is_valid") & (F.col("feed_type") == kind)))
    return rows.select("doc_id", "title", "link", "summary", stamp("updated").alias("updated"), "feed_type")


@query("A7_rss_entries", ENTRY_SQL.format(kind="rss"))
def rss_entries(t):
    return entries_of(t, "rss")


@query("A8_atom_entries", ENTRY_SQL.format(kind="atom"))
def atom_entries(t):
    return entries_of(t, "atom")


@query("A9_json_feed_entries", ENTRY_SQL.format(kind="json"))
def json_feed_entries(t):
    return entries_of(t, "json")


@query("D3_header_fields", "WITH" + FEEDS_SQL + """
SELECT doc_id, CASE kind WHEN 'rss' THEN concat_ws(',', CASE WHEN title IS NULL THEN 'title' END, CASE WHEN description IS NULL THEN 'description' END)
 WHEN 'atom' THEN concat_ws(',', CASE WHEN title IS NULL THEN 'title' END, 'id', CASE WHEN ts IS NULL AND NOT bad_date THEN 'updated' END)
 WHEN 'json' THEN CASE WHEN title IS NULL THEN 'title' ELSE '' END ELSE '' END AS missing FROM f""")
def header_fields(t):
    return feeds.header_errors(feeds.parse_feeds(feed_docs(t))).select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("D12_entry_checks", "WITH" + FEEDS_SQL + """
SELECT doc_id, CAST(CASE WHEN kind IS NULL THEN 1 ELSE (title IS NULL)::INT + CASE WHEN kind = 'rss' THEN (description IS NULL)::INT ELSE 1 END
 + untitled + coalesce(long_titles, 0) + bare + coalesce(long_summaries, 0) + CASE WHEN kind = 'rss' THEN dated ELSE n_bad END END AS BIGINT) AS n_errors FROM f""")
def entry_checks(t):
    """Header fields, then titles, descriptions and dates of all entries; a bare text is unreadable."""
    return feeds.entry_errors(feeds.parse_feeds(feed_docs(t)), as_of()).select("doc_id", F.size("errors").cast("bigint").alias("n_errors"))


@query("D24_worst_error_class", "WITH" + FEEDS_SQL + """
SELECT doc_id, CASE WHEN kind IS NULL THEN 'critical' WHEN title IS NULL THEN 'validation' WHEN bad_date OR bad OR link LIKE 'feeds/%' THEN 'format' ELSE '-' END AS worst FROM f""")
def worst_error_class(t):
    return feeds.document_errors(feeds.parse_feeds(feed_docs(t))).select("doc_id", F.coalesce("worst", F.lit("-")).alias("worst"))


@query("D23_strict_feeds", "WITH" + FEEDS_SQL + """
SELECT doc_id, CASE WHEN kind IS NULL THEN 'critical' WHEN title IS NULL OR length(title) > 200 OR longest > 200 OR longest_summary > 5000 OR (kind = 'rss' AND description IS NULL) THEN 'validation'
 WHEN bad_date OR bad OR link LIKE 'feeds/%' THEN 'format' ELSE '-' END AS worst FROM f""")
def strict_feeds(t):
    found = feeds.document_errors(feeds.parse_feeds(feed_docs(t)), strict=True)
    return found.select("doc_id", F.coalesce("worst", F.lit("-")).alias("worst"))


@query("D23_strict_decoding", """
WITH p AS (SELECT page_id, html, octet_length(encode(html)) AS n, octet_length(encode(html)) // 2 AS k FROM pages),
c AS (SELECT page_id, n, k, len(list_filter(range(1, length(html) + 1), lambda i: octet_length(encode(substr(html, 1, i))) <= k)) AS whole, html FROM p)
SELECT page_id, page_id % 3 = 0 AS is_valid, CASE WHEN page_id % 3 > 0 THEN CAST(octet_length(encode(substr(html, 1, whole))) AS BIGINT) END AS error_at,
 CASE WHEN page_id % 3 = 0 THEN length(html) END AS n_chars FROM c""")
def strict_decoding(t):
    """Pages as bytes, two of three with a byte in the middle that no UTF-8 text has; it may cut a character in two."""
    raw = F.col("html").cast("binary")
    half = F.floor(F.octet_length(raw) / 2).cast("int")
    broken = F.concat(F.substring(raw, F.lit(1), half), F.unhex(F.lit("FF")), F.substring(raw, half + 1, F.octet_length(raw)))
    docs = t.pages().select("page_id", F.when(F.col("page_id") % 3 == 0, raw).otherwise(broken).alias("content"))
    return feeds.decoded(docs, "content").select("page_id", F.col("error_at").isNull().alias("is_valid"), "error_at", F.length("doc").cast("bigint").alias("n_chars"))


@query("A11_pushed_items", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'unknown' WHEN 'click' THEN 'unknown' ELSE CAST(event_id AS VARCHAR) END AS id,
 CASE event_type WHEN 'error' THEN 'No data provided' WHEN 'click' THEN 'Invalid JSON' ELSE '' END AS errors FROM events""")
def pushed_items(t):
    kind, ident = F.col("event_type"), F.col("event_id").cast("string")
    good = F.concat(F.lit('{"id": "'), ident, F.lit('", "title": "'), kind, F.lit('"}'))
    value = F.when(kind == "error", F.lit("")).when(kind == "click", F.concat(F.lit("{oops "), ident)).otherwise(good)
    raw = t.read("events").select("event_id", value.alias("value"))
    return files.pushed_items(raw, keep=["event_id"]).select("event_id", "id", F.array_join("errors", "; ").alias("errors"))


@query("B9_idea_manifest", """
SELECT 'd' || doc_id AS idea_id, area, 'd' || doc_id || '/' || area AS path FROM documents, (SELECT unnest(['research','drafts','media','reviews','final','archive']) AS area)""")
def idea_manifest(t):
    return writers.idea_manifest(t.documents().select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("idea_id")))


@query("B13_queue_record", "WITH " + RAW_SQL + """
SELECT id, title, substring(content,1,2000) AS description, url AS link, strftime(to_timestamp(published) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS pub_date, category AS tags FROM raw""")
def queue_record(t):
    f = F.col("feed")
    return normalize.queue_record(normalize.content_item(raw_items(t))).select(
        "id", f["title"].alias("title"), f["description"].alias("description"), f["link"].alias("link"), f["pubDate"].alias("pub_date"), F.array_join(f["tags"], ",").alias("tags"))


@query("C12_queue_to_content", "WITH " + RAW_SQL + f"""
SELECT id AS feed_id, CASE WHEN category='error' THEN '{AS_OF}' ELSE strftime(to_timestamp(published) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS publish_date, 'BLOG' AS content_type FROM raw""")
def queue_to_content(t):
    q = normalize.queue_record(normalize.content_item(raw_items(t)))
    undated = q.withColumn("feed", F.when(F.col("feed.title").startswith("error"), F.col("feed").withField("pubDate", F.lit(None).cast("string"))).otherwise(F.col("feed")))
    return normalize.queued_to_content(undated, as_of()).select("feed_id", stamp("publish_date").alias("publish_date"), "content_type")


@query("D1_raw_item_shape", "WITH " + RAW_SQL + """
SELECT id, concat_ws('; ', CASE WHEN category = 'error' THEN 'Missing required fields' END, CASE WHEN category IN ('error','click') THEN 'Invalid canonical URL format' END) AS errors FROM raw""")
def raw_item_shape(t):
    r = raw_items(t)
    kind = F.col("categories")[0]["label"]
    r = r.withColumns({"summary": F.when(kind != "error", F.col("summary")), "canonical": F.when(kind == "click", F.slice("canonical", 1, 0)).when(kind != "error", F.col("canonical"))})
    pages = r.select(F.lit("").alias("page_token"), F.array(F.struct(*[c for c in r.columns if c != "at"])).alias("items"))
    return files.page_items(pages).select("id", F.array_join("errors", "; ").alias("errors"))


@query("D10_payload_validation", "WITH " + CONTENT_SQL + """
SELECT doc_id, CASE WHEN feed = 'src1' THEN 'Missing required metadata fields: originalUrl' WHEN feed = 'src2' THEN 'Invalid publish date format' WHEN lang = 'de' THEN 'Invalid content type'
 WHEN length(title) > 255 THEN 'Title must not exceed 255 characters' WHEN length(text) > 2000 THEN 'Brief must not exceed 2000 characters' ELSE 'ok' END AS outcome FROM content""")
def payload_validation(t):
    """Payloads go out as JSON and come back through the declared schema."""
    meta = F.struct(F.col("feed").alias("feedId"), F.when(F.col("feed") != "src1", F.col("item_key")).alias("originalUrl"),
                    F.when(F.col("feed") == "src2", "soon").otherwise("2024-01-05T10:00:00Z").alias("publishDate"))
    body = F.to_json(F.struct("title", F.when(F.col("lang") == "de", "PODCAST").otherwise("BLOG").alias("contentType"), F.col("text").alias("brief"),
                              F.lit("High").alias("priority"), meta.alias("sourceMetadata")))
    c = t.content().select("doc_id", F.from_json(body, schemas.DELIVERY).alias("data"))
    return c.select("doc_id", F.coalesce(checks.payload_error(), F.lit("ok")).alias("outcome"))


@query("H11_feed_dates", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN '-' ELSE strftime(o_orderdate + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders""")
def feed_dates(t):
    d = F.col("o_orderdate").cast("timestamp")
    form = F.col("o_orderkey") % 3
    s = (F.when(form == 0, F.date_format(d, "'Mon, 'dd MMM yyyy HH:mm:ss' -0200'")).when(form == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'-02:00'"))
         .otherwise(F.date_format(d, "'on 'dd/MM")))
    return t.read("orders").select("o_orderkey", F.coalesce(stamp(dates.parse_feed_date(s)), F.lit("-")).alias("parsed"))


@query("I14_alert_events", "WITH " + GRID_SQL("count(*) AS n, count(*) FILTER (WHERE event_type='error') AS bad", 60) + f""",
flagged AS (SELECT g.w, coalesce(a.bad * 1.0 / a.n > 0.1, false) AS breach FROM grid g LEFT JOIN agg a USING (w)), {RUN_SQL}
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, 'warning' AS level,
 '{{"text":"*High error rate*\\nerrors above a tenth","attachments":[{{"color":"#ffa500","fields":[{{"title":"rule","value":"errors","short":true}},{{"title":"windows","value":"2","short":true}}],"ts":' || CAST(epoch(w) AS BIGINT) || '}}]}}' AS payload
FROM runs WHERE breach AND run = 2""")
def alert_events(t):
    """Start of every held breach as a message for the notification channel."""
    w = metrics.windowed(t.samples(), "ts", [], [F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("bad")], 60)
    full = metrics.fill_windows(w, ["n", "bad"], 60).withColumn("rule", F.lit("errors"))
    share = F.coalesce(F.try_divide(F.col("bad").cast("double"), F.col("n")), F.lit(0.0))
    runs = metrics.breach_runs(full, ["rule"], share > 0.1, 60, 60)
    events = metrics.alert_events(runs, "rule", "warning", "High error rate", "errors above a tenth")
    return writers.alert_messages(events).select(stamp("ts").alias("window_start"), "level", "payload")


@query("J1_custom_priority_rule", "SELECT event_id AS id, CASE WHEN value > 100 THEN 'HIGH' ELSE 'LOW' END AS priority FROM events")
def custom_priority_rule(t):
    return rules.with_priority(t.items(), lambda df: F.when(df["value"] > 100, "HIGH").otherwise("LOW")).select("id", "priority")
