"""File sources, feed documents, payload checks and record projections on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.functions import checks, dates, rules
from contentflow.operators import normalize
from contentflow.sinks import writers
from contentflow.sources import feeds, files

NOW = dt.datetime(2024, 12, 20)
def as_of():
    return F.lit("2024-12-20 00:00:00").cast("timestamp")

RSS = """<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>Sample RSS Feed</title>
<link>http://example.com/feed</link><description>A feed</description><pubDate>Mon, 13 Dec 2024 03:01:14 -0800</pubDate>
<item><title>First</title><link>http://example.com/1</link><description>Text</description><pubDate>Fri, 13 Dec 2024 03:01:14 -0800</pubDate></item>
<item><title>Second</title><link>http://example.com/2</link></item></channel></rss>"""
ATOM = """<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Sample Atom</title>
<link href="http://example.org/"/><id>urn:x</id><updated>2024-12-13T03:01:14-08:00</updated>
<entry><title>Entry</title><link href="http://example.org/e"/><id>urn:e</id><updated>2024-12-13T03:01:14-08:00</updated><summary>Sum</summary></entry></feed>"""
JSONF = json.dumps({"version": "https://jsonfeed.org/version/1.1", "title": "J", "home_page_url": "https://example.org/",
                    "items": [{"id": "1", "title": "One", "content_text": "t", "url": "https://example.org/1",
                               "date_published": "2024-12-13T03:01:14-08:00"}]})


def parsed(spark, docs, **kw):
    return feeds.parse_feeds(spark.createDataFrame(list(enumerate(docs)), "doc_id long, doc string"), **kw)


def test_formats_and_errors(spark):
    docs = [RSS, ATOM, JSONF, "This is not a valid feed", "<rss><channel><title>x</title></channel></rss>", "", "<rss><channel><title>",
            "<rss></rss>", '{"version": "other"}', RSS.replace("Mon, 13 Dec 2024 03:01:14 -0800", "someday")]
    rows = {r.doc_id: r for r in parsed(spark, docs).collect()}
    assert [(rows[i].feed_type, rows[i].is_valid) for i in range(3)] == [("rss", True), ("atom", True), ("json", True)]
    assert rows[0].feed.title == "Sample RSS Feed"
    assert rows[0].feed.updated == dt.datetime(2024, 12, 13, 11, 1, 14)
    assert rows[3].feed_type is None and rows[3].error
    assert rows[4].feed_type == "rss" and rows[4].error == "Missing required fields: link"
    assert not rows[5].is_valid and not rows[6].is_valid and rows[6].feed_type is None
    assert rows[7].error == "Missing required channel element"
    assert not rows[8].is_valid
    assert rows[9].error == "Invalid date"


def test_entries_and_headers(spark):
    p = parsed(spark, [RSS, ATOM, JSONF])
    got = {(r.doc_id, r.title): r for r in feeds.feed_entries(p).collect()}
    assert set(got) == {(0, "First"), (0, "Second"), (1, "Entry"), (2, "One")}
    assert got[(0, "Second")].summary is None and got[(1, "Entry")].link == "http://example.org/e"
    missing = {r.doc_id: r.missing for r in feeds.header_errors(parsed(spark, [RSS.replace("<description>A feed</description>", ""), ATOM, JSONF])).collect()}
    assert missing == {0: ["description"], 1: [], 2: []}
    kinds = {r.doc_id: r.feed_type for r in parsed(spark, [RSS, ATOM, JSONF, '{"version":"jsonfeed 1"}'], strict_sniff=True).collect()}
    assert kinds == {0: "rss", 1: "atom", 2: "json", 3: None}


def test_entry_rules(spark):
    doc = RSS.replace("<title>First</title>", "<title>" + "x" * 101 + "</title>").replace("Fri, 13 Dec 2024 03:01:14 -0800", "2030-01-01T00:00:00Z")
    row = feeds.entry_errors(parsed(spark, [doc]), as_of()).first()
    assert row.errors == ["Entry title exceeds maximum length of 100 characters", "Entry has future publication date", "Entry missing description"]
    empty = feeds.entry_errors(parsed(spark, ["<rss><channel><title>t</title><link>http://a.b</link></channel></rss>"]), as_of()).first()
    assert empty.errors == ["Missing required field: description", "Feed contains no entries"]


def test_document_classes(spark):
    item = "<item><title>T</title><link>http://example.com/1</link><description>D</description>{}</item>"
    make = lambda extra, head="<description>D</description>", title="T": (
        f"<rss><channel><title>{title}</title><link>http://example.com</link>{head}{item.format(extra)}</channel></rss>")
    docs = ["", "<rss><channel></channel></rss>", make("", "<description>D</description><pubDate>invalid-date</pubDate>"),
            make("<guid>" + "x" * 513 + "</guid>"), make("<image>not_a_url</image>"), make("<category></category><category>" + "x" * 201 + "</category>"),
            make(""), make("", "", "A" * 201)]
    loose = {r.doc_id: r for r in feeds.document_errors(parsed(spark, docs)).collect()}
    assert [loose[i].worst for i in range(3)] == ["critical", "validation", "format"]
    messages = {i: {e["message"] for e in loose[i].errors} for i in loose}
    assert "GUID exceeds maximum length" in messages[3]
    assert "Invalid image URL format" in messages[4]
    assert {"Category exceeds maximum length", "Empty category found"} <= messages[5]
    assert not messages[6] and not messages[7]
    strict = {r.doc_id: {e["message"] for e in r.errors} for r in feeds.document_errors(parsed(spark, docs), strict=True).collect()}
    assert strict[7] == {"Content length exceeds maximum", "Missing recommended elements"} and not strict[6]
    raw = parsed(spark, [make("")]).withColumn("raw", F.lit(bytearray(b"caf\xe9")))
    assert "Non-UTF8 encoding detected" in {e["message"] for e in feeds.document_errors(raw, "raw", strict=True).first().errors}


def test_reading_list_chain(spark, tmp_path):
    item = lambda i, **kw: {"id": f"i{i}", "title": f"t{i}", "published": 1700000000 + i, "summary": {"content": "c" * 2500},
                            "canonical": [{"href": f"https://youtube.com/watch?v={i}"}], "tags": [{"label": "a"}], **kw}
    pages = [{"page_token": "", "continuation": "p1", "items": [item(1), item(2, canonical=[])]},
             {"page_token": "p1", "continuation": "p2", "items": [item(3)]},
             {"page_token": "p2", "items": [item(4)]},
             {"page_token": "lost", "continuation": "p9", "items": [item(9)]}]
    for n, p in enumerate(pages):
        (tmp_path / f"{n}.json").write_text(json.dumps(p))
    good, bad = files.read_items(spark, str(tmp_path))
    assert {r.id for r in good.collect()} == {"i1", "i3", "i4"}
    assert {r.id for r in bad.collect()} == {"i2"}
    stored = normalize.content_item(good).collect()
    assert {r.content_type for r in stored} == {"VIDEO"} and all(len(r.brief) == 2000 for r in stored)
    rec = normalize.reading_list_item(good, as_of()).filter("id = 'i1'").first()
    assert rec.author == "" and rec.published == "2023-11-14T22:13:21+00:00" and rec.categories == []
    q = normalize.queue_record(normalize.content_item(good))
    assert q.filter("id = 'i3'").first().feed.link.endswith("v=3")
    back = normalize.queued_to_content(q, as_of())
    assert back.filter("feed_id = 'i1'").first().publish_date == dt.datetime(2023, 11, 14, 22, 13, 21)


def test_other_files(spark, tmp_path):
    (tmp_path / "subs.json").write_text(json.dumps({"subscriptions": [{"id": "a", "title": "A"}, {"id": "b"}]}))
    (tmp_path / "broken.json").write_text("<html>")
    assert files.subscriptions(spark, str(tmp_path / "subs.json")).count() == 2
    assert files.subscriptions(spark, str(tmp_path / "broken.json")).count() == 0
    assert files.subscriptions(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "conf.json").write_text(json.dumps({"feeds": [{"url": "u1", "name": "n"}, {"url": "u2", "name": "m"}], "max_items_per_fetch": 2}))
    reg = files.feed_registry(spark, str(tmp_path / "conf.json"))
    assert reg.filter("url = 'u1'").first().asDict()["fetch_interval_seconds"] == 300
    items = spark.createDataFrame([("u1", i, i) for i in range(5)] + [("u2", 7, 7), ("u3", 8, 8)], "feed string, id long, at long")
    assert {(r.feed, r.id) for r in files.capped_per_feed(items, reg, "at", "id").collect()} == {("u1", 4), ("u1", 3), ("u2", 7)}
    docs = tmp_path / "store" / "name=x"
    docs.mkdir(parents=True)
    (docs / "a.json").write_text('{"id": "1"}')
    assert files.document_named(spark, str(tmp_path / "store"), "x", "id string").first().id == "1"
    assert files.document_named(spark, str(tmp_path / "store"), "y", "id string").count() == 0
    pushed = files.pushed_items(spark.createDataFrame([('{"title": "t"}',), ("",), ("{oops",)], "value string"))
    got = {r.value: r for r in pushed.collect()}
    assert got['{"title": "t"}'].id == "unknown" and got['{"title": "t"}'].errors == []
    assert got[""].errors == ["No data provided"] and got["{oops"].errors == ["Invalid JSON"]


def test_payload_check(spark):
    base = {"title": "t", "contentType": "BLOG", "brief": "b", "priority": "High",
            "sourceMetadata": {"feedId": "f", "originalUrl": "u", "publishDate": "2024-12-13T18:44:27-08:00"}}
    cases = [base, {**base, "title": None}, {**base, "contentType": "X"}, {**base, "priority": "Top"},
             {**base, "sourceMetadata": {**base["sourceMetadata"], "publishDate": "bad"}}, {**base, "title": "x" * 256},
             {**base, "brief": "x" * 2001}, {**base, "sourceMetadata": {"feedId": "f", "originalUrl": "u"}}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, j string")
    df = df.withColumn("data", F.from_json("j", schemas.DELIVERY))
    got = {r.i: r.e for r in df.select("i", checks.payload_error().alias("e")).collect()}
    assert got == {0: None, 1: "Missing required fields: title", 2: "Invalid content type", 3: "Invalid priority", 4: "Invalid publish date format",
                   5: "Title must not exceed 255 characters", 6: "Brief must not exceed 2000 characters", 7: "Missing required metadata fields: publishDate"}


def test_constraint_ranges(spark):
    df = spark.sql("""select map('title','t','body','b') as content, 1.5D as q, 50D as r, cast(null as double) as s,
                      array(named_struct('fact','f','confidence',0.5D), named_struct('fact',cast(null as string),'confidence',0.1D)) as facts""")
    row = df.select(
        checks.missing(["title", "body", "url"], F.map_keys("content")).alias("m"), checks.in_range("q", 0, 1).alias("q"),
        checks.in_range("r", 0, 100).alias("r"), checks.in_range("s", -1, 1).alias("s"),
        F.forall("facts", lambda f: f["fact"].isNotNull() & f["confidence"].isNotNull()).alias("f")).first()
    assert (row.m, row.q, row.r, row.s, row.f) == (["url"], False, True, True, False)


def test_migration(spark):
    src = spark.createDataFrame([("1", None, "T", "a b c", None, None, None, None, None, None, None, 0.5)], schemas.OLD_SOURCE)
    out = normalize.migrated_source(src, as_of()).first()
    assert (out.source, out.metadata.language, out.metrics.word_count, out.metrics.read_time, out.processing.status) == ("unknown", "en", 3, 0, "migrated")
    gen = spark.createDataFrame([("2", "1", None, "body", None, None, "p", None, None, None)], schemas.OLD_GENERATED)
    g = normalize.migrated_generated(gen, as_of())
    assert g.first().quality_metrics.coherence_score == 0.0 and g.first().status.review_status == "pending"
    assert g.filter(normalize.migration_complete(g)).count() == 1
    both = (src.withColumn("kind", F.lit("source"))).unionByName(gen.withColumn("kind", F.lit("generated")).withColumn("pstatus", F.col("published")).drop("published"), allowMissingColumns=True)
    both = both.withColumn("published", F.col("pstatus"))
    assert {r.kind: r.content_id for r in normalize.migrate_mixed(both, as_of()).collect()} == {"source": "1", "generated": "2"}
    with pytest.raises(Exception, match="Unknown content type"):
        normalize.migrate_mixed(both.withColumn("kind", F.lit("other")), as_of()).collect()


def test_legacy_and_header_projection(spark):
    raw = spark.sql("""select 't' as title, named_struct('content', repeat('x', 300)) as content, array('important') as categories,
        named_struct('streamId', 's') as origin, array('http://a') as canonical, 1700000000L as published, 'au' as author""")
    out = normalize.legacy_payload(raw, as_of()).first()
    assert out.brief == "x" * 200 + "..." and out.priority == "High" and out.sourceMetadata.feedId == "s"
    head = spark.sql("""select cast(null as string) id, 'g' guid, 't' title, cast(null as string) content, repeat('s', 2100) summary, 'l' link,
        cast(null as string) author, cast(null as string) language, cast(null as string) feed_id, cast(null as array<string>) tags,
        cast(null as string) updated, 'Mon, 13 Dec 2024 03:01:14 -0800' pubDate, cast(null as string) date_published""")
    h = normalize.feed_header(head, "rss", as_of()).first()
    assert h.id == "g" and len(h.content.brief) == 2000 and h.content.format == "html" and h.analysis.priority == "Medium"
    assert h.metadata.source.publishDate == dt.datetime(2024, 12, 13, 11, 1, 14)


def test_dates_and_types(spark):
    texts = ["Mon, 13 Dec 2024 03:01:14 -0800", "2024-12-13T18:44:27-08:00", "2024-12-13T18:44:27Z", "13 Dec 2024 03:01:14 GMT", "nonsense", "2024-13-45T00:00:00Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.d for r in df.select(dates.parse_feed_date("t").alias("d")).collect()]
    assert got == [dt.datetime(2024, 12, 13, 11, 1, 14), dt.datetime(2024, 12, 14, 2, 44, 27), dt.datetime(2024, 12, 13, 18, 44, 27),
                   dt.datetime(2024, 12, 13, 3, 1, 14), None, None]
    urls = spark.createDataFrame([("https://youtube.com/watch?v=123",), ("https://twitter.com/user/status/123",), ("https://example.com/blog",),
                                  ("https://example.com/?u=youtube.com",)], "u string")
    assert [r[0] for r in urls.select(rules.content_type_of_url("u")).collect()] == ["VIDEO", "SOCIAL", "BLOG", "BLOG"]
    assert [r[0] for r in urls.select(rules.content_type_of_url("u", True)).collect()] == ["VIDEO", "SOCIAL", "BLOG", "VIDEO"]


def test_sinks(spark, tmp_path):
    ideas = spark.createDataFrame([("i1", "BLOG", "High", None)], "idea_id string, content_type string, priority string, quality_score double")
    assert writers.idea_manifest(ideas).count() == 6
    writers.write_idea_metadata(ideas, as_of(), str(tmp_path / "ideas"))
    assert spark.read.json(str(tmp_path / "ideas")).first().status == "New"
    ev = spark.sql("select 'critical' level, 'T' title, 'M' message, map('a','1') metadata, timestamp'2024-01-01 00:00:00' ts")
    p = json.loads(writers.alert_messages(ev).first().payload)
    assert p["text"] == "*T*\nM" and p["attachments"][0]["color"] == "#7b001c" and p["attachments"][0]["fields"][0]["title"] == "a"
    errs = spark.sql("select 'x' error_type, timestamp'2024-01-01 10:00:00' ts")
    writers.append_errors(errs, str(tmp_path / "log"))
    writers.append_errors(errs, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_stored_documents_are_pruned_by_names_from_a_table(spark, tmp_path):
    root = str(tmp_path / "stored")
    spark.createDataFrame([(i, f"n{i % 5}") for i in range(50)], "v bigint, name string").write.partitionBy("name").json(root)
    spark.createDataFrame([("n1", 1), ("n3", 2), ("lost", 1), (None, 1)], "name string, kind int").write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names")).filter("kind = 1")
    got = files.documents_named(spark, root, names, "v BIGINT")
    assert sorted(r.v for r in got.collect()) == list(range(1, 50, 5))
    plan = got._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    assert files.documents_named(spark, str(tmp_path / "none"), names, "v BIGINT").count() == 0


def test_strict_decoding_names_the_first_wrong_byte(spark, tmp_path):
    cases = {"a.xml": ("<a>é</a>".encode(), None), "b.xml": (b"\xffab", 0), "c.xml": ("né".encode()[:-1], 1), "d.xml": ("ok é".encode("latin-1"), 3)}
    for name, (raw, _) in cases.items():
        (tmp_path / name).write_bytes(raw)
    rows = {r["doc_id"].rsplit("/", 1)[1]: (r["doc"], r["error_at"]) for r in feeds.binary_feeds(spark, str(tmp_path)).collect()}
    assert rows == {n: (raw.decode() if at is None else None, at) for n, (raw, at) in cases.items()}


def test_landed_feeds_give_a_row_for_each_entry(spark, tmp_path):
    item = '<item><title>T{0}</title><link>https://x.y/{0}</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0100</pubDate><category>a</category><category>b</category></item>'
    items = [item.format(i) for i in range(3000)]
    (tmp_path / "big.xml").write_text("<rss xmlns:m='urn:m'><channel><title>C</title>" + "".join(items) + "<item><title>broken</item></channel></rss>")
    rows = feeds.landed_entries(spark, str(tmp_path / "big.xml")).collect()
    good = [r for r in rows if r["error"] is None]
    assert sorted(r["title"] for r in good) == sorted(f"T{i}" for i in range(3000)) and [r["error"] for r in rows if r["error"]] == ["Malformed entry"]
    assert {(str(r["updated"]), tuple(r["categories"])) for r in good} == {("2024-01-01 09:00:00", ("a", "b"))}
    atom = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:t="urn:t"><title>C</title><t:entry><title>no</title></t:entry><entry><title>A</title><link href="u"/><updated>2024-01-02T00:00:00Z</updated></entry></feed>'
    (tmp_path / "atom.xml").write_text(atom)
    assert [(r["title"], r["link"], str(r["updated"])) for r in feeds.landed_entries(spark, str(tmp_path / "atom.xml"), "atom").collect()] == [("no", None, "None"), ("A", "u", "2024-01-02 00:00:00")]  # prefixes are ignored
