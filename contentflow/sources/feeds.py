"""RSS, Atom and JSON Feed documents as rows, and the checks made on them.

A document is parsed in its row: sniff the format, parse with the matching
schema, unify. Broken documents become rows with an error, never a failed job.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from contentflow import schemas
from contentflow.functions import checks
from contentflow.functions.dates import parse_feed_date

ROOT_RE = r"^\s*(?:<\?xml[^>]*\?>)?\s*(?:<!--(?s:.*?)-->\s*)*<([A-Za-z_][A-Za-z0-9_.:-]*)"
JSON_PREFIX = "https://jsonfeed.org/version/"
XML_OPTIONS = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE", "ignoreNamespace": "true"}


def feed_format(doc) -> Column:
    """json, atom, rss or null: JSON Feed by its version, then the XML root."""
    version = F.lower(F.try_variant_get(F.try_parse_json(doc), "$.version", "string"))
    root = F.regexp_extract(doc, ROOT_RE, 1)
    return (F.when(F.contains(version, F.lit("jsonfeed")), "json")
            .when(root.endswith("feed"), "atom").when(root == "rss", "rss"))


def feed_format_strict(doc) -> Column:
    """XML first, and a JSON Feed needs the published version prefix."""
    version = F.try_variant_get(F.try_parse_json(doc), "$.version", "string")
    root = F.regexp_extract(doc, ROOT_RE, 1)
    return (F.when(root.endswith("feed"), "atom").when(root.isin("rss", "rdf:RDF"), "rss")
            .when(version.startswith(JSON_PREFIX), "json"))


def binary_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc, error_at) of landed files whose encoding is not to be guessed: ``doc_id`` is the file's path."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")
    return decoded(files, "content")


def decoded(docs: DataFrame, raw: str) -> DataFrame:
    """Replaces the binary column ``raw`` by ``doc``, its strict UTF-8 text, and ``error_at``, the offset of the first byte that
    isn't part of one; a broken document is a row without ``doc``. Whole documents are decoded by the engine, only broken
    ones are looked at again."""
    @F.pandas_udf(LongType())
    def first_error(content: pd.Series) -> pd.Series:
        def at(value):
            try:
                value.decode("utf-8")
            except UnicodeDecodeError as fault:
                return fault.start
            return None

        return content.map(at, na_action="ignore").astype("Int64")

    kept = [c for c in docs.columns if c not in (raw, "doc", "error_at")]
    text = F.try_validate_utf8(F.col(raw).cast("string"))
    rows = docs.select(*kept, F.col(raw).alias("_raw"), text.alias("doc"))
    broken = F.when(F.col("doc").isNull(), F.col("_raw"))
    return rows.select(*kept, "doc", first_error(broken).alias("error_at"))


def landed_entries(spark: SparkSession, path: str, kind: str = "rss") -> DataFrame:
    """Entries of landed RSS or Atom files, one row each: the scan streams them out of a file, so no task holds a whole feed.

    Columns as in :func:`feed_entries` without the feed's title; ``error`` marks an entry that isn't XML of the declared form.
    Prefixes of names are ignored."""
    tag, part = ("item", "channel.item") if kind == "rss" else ("entry", "entry")
    fields = spark.createDataFrame([], schemas.RSS if kind == "rss" else schemas.ATOM).select(F.explode(part).alias("e")).select("e.*").schema
    rows = spark.read.format("xml").options(**XML_OPTIONS).option("rowTag", tag).schema(fields.add("_bad", "string")).load(path)
    none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    c = F.col
    entry = (_entry(c("title"), c("link"), c("description"), F.coalesce("pubDate", "published"), c("guid"), c("image"), c("category")) if kind == "rss"
             else _entry(c("title"), c("link._href"), c("summary"), c("updated"), c("id"), none, no_list))
    return rows.select(F.input_file_name().alias("doc_id"), F.lit(kind).alias("feed_type"), F.when(c("_bad").isNotNull(), "Malformed entry").alias("error"), entry.alias("e")).select(
        "doc_id", "feed_type", "error", "e.*")


def _entry(title, link, summary, updated, guid, image, categories) -> Column:
    return F.struct(
        title.alias("title"), link.alias("link"), summary.alias("summary"), updated.alias("updated_text"),
        parse_feed_date(updated).alias("updated"), guid.alias("guid"), image.alias("image"), categories.alias("categories"))


def parse_feeds(docs: DataFrame, doc: str = "doc", strict_sniff: bool = False) -> DataFrame:
    """Adds feed_type, is_valid, error and ``feed`` (title, link, description, id, version, updated, entries)."""
    none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    kind = (feed_format_strict if strict_sniff else feed_format)(F.col(doc))
    d = docs.withColumn("_kind", kind).withColumns({
        "_rss": F.from_xml(F.when(F.col("_kind") == "rss", F.col(doc)), schemas.RSS, XML_OPTIONS),
        "_atom": F.from_xml(F.when(F.col("_kind") == "atom", F.col(doc)), schemas.ATOM, XML_OPTIONS),
        "_json": F.from_json(F.when(F.col("_kind") == "json", F.col(doc)), schemas.JSON_FEED),
    })
    ch = F.col("_rss.channel")
    rss = F.transform(ch["item"], lambda i: _entry(
        i["title"], i["link"], i["description"], F.coalesce(i["pubDate"], i["published"]), i["guid"], i["image"], i["category"]))
    atom = F.transform("_atom.entry", lambda i: _entry(i["title"], i["link"]["_href"], i["summary"], i["updated"], i["id"], none, no_list))
    js = F.transform("_json.items", lambda i: _entry(i["title"], i["url"], i["content_text"], i["date_published"], i["id"], none, no_list))

    def header(title, link, description, ident, version, updated, entries):
        return F.struct(
            title.alias("title"), link.alias("link"), description.alias("description"), ident.alias("id"), version.alias("version"),
            updated.alias("updated_text"), parse_feed_date(updated).alias("updated"), F.coalesce(entries, F.array()).alias("entries"))

    a, j = F.col("_atom"), F.col("_json")
    feed = (
        F.when(F.col("_kind") == "rss", header(ch["title"], ch["link"], ch["description"], none, none, ch["pubDate"], rss))
        .when(F.col("_kind") == "atom", header(a["title"], a["link"]["_href"], none, a["id"], none, a["updated"], atom))
        .when(F.col("_kind") == "json", header(j["title"], j["home_page_url"], none, none, j["version"],
                                               F.get(j["items"], F.lit(0))["date_published"], js)))
    bad_xml = F.coalesce(F.col("_rss._bad"), F.col("_atom._bad")).isNotNull()
    d = d.withColumn("feed", feed)
    lacking = F.when(F.col("_kind") == "rss", checks.missing(["title", "link"], checks.present_fields(
        {"title": F.col("feed.title"), "link": F.col("feed.link")}))).otherwise(F.array().cast("array<string>"))
    bad_date = (F.col("feed.updated_text").isNotNull() & F.col("feed.updated").isNull()) | F.exists(
        "feed.entries", lambda e: e["updated_text"].isNotNull() & e["updated"].isNull())
    error = (
        F.when(F.col("_kind").isNull(), "Unknown feed format")
        .when(bad_xml, "Malformed document")
        .when((F.col("_kind") == "rss") & ch.isNull(), "Missing required channel element")
        .when(F.size(lacking) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(lacking, ", ")))
        .when(bad_date, "Invalid date"))
    return d.withColumn("error", error).select(
        *docs.columns, F.when(~F.coalesce(bad_xml, F.lit(False)), F.col("_kind")).alias("feed_type"),
        F.col("error").isNull().alias("is_valid"), "error", "feed")


def feed_entries(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per entry of the valid documents. Not a filter: that would be pushed below the parser and parse twice."""
    return parsed.select(key, "feed_type", F.col("feed.title").alias("feed_title"), F.inline(F.when(F.col("is_valid"), F.col("feed.entries"))))


def header_errors(parsed: DataFrame) -> DataFrame:
    """Adds ``missing``: header fields the feed type requires."""
    f = F.col("feed")
    present = checks.present_fields({
        "title": f["title"], "link": f["link"], "description": f["description"], "id": f["id"], "updated": f["updated_text"],
        "version": f["version"], "items": F.when(F.size(f["entries"]) > 0, F.lit("x"))})
    return parsed.withColumn("missing", checks.header_missing("feed_type", present))


def entry_errors(parsed: DataFrame, as_of: Column, required=("title", "link", "description"), max_title: int = 100,
                 max_description: int = 5000) -> DataFrame:
    """Adds ``errors``: header fields, presence of entries, then the rules of every entry.

    All of it happens inside the row, entry by entry; nothing is exploded."""
    f = F.col("feed")
    head = F.transform(checks.missing(required, checks.present_fields({r: F.when(checks.filled(f[r]), f[r]) for r in required})),
                       lambda m: F.concat(F.lit("Missing required field: "), m))

    def of_entry(e):
        stamp = F.when(e["updated_text"].rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.try_to_timestamp(e["updated_text"]))
        return F.array_compact(F.array(
            F.when(~checks.filled(e["title"]), "Entry missing title")
            .when(F.length(e["title"]) > max_title, f"Entry title exceeds maximum length of {max_title} characters"),
            F.when(~checks.filled(e["summary"]), "Entry missing description")
            .when(F.length(e["summary"]) > max_description, f"Entry description exceeds maximum length of {max_description} characters"),
            F.when(e["updated_text"].isNotNull() & stamp.isNull(), "Invalid publication date format")
            .when(stamp > as_of, "Entry has future publication date")))

    body = F.when(F.size(f["entries"]) == 0, F.array(F.lit("Feed contains no entries"))).otherwise(
        F.flatten(F.transform(f["entries"], of_entry)))
    unread = F.array(F.concat(F.lit("Feed parsing error: "), F.col("error")))
    return parsed.withColumn("errors", F.when(F.col("feed_type").isNull(), unread).otherwise(F.concat(head, body)))


# Error classes, worst first.
CLASS_RANK = {"critical": 3, "validation": 2, "format": 1}


def document_errors(parsed: DataFrame, raw: str | None = None, strict: bool = False) -> DataFrame:
    """Adds ``errors`` as (class, message) and ``worst``, the worst class of the document.

    ``raw`` names a binary column for the encoding check of the strict mode."""
    f = F.col("feed")

    def err(cond, cls, message):
        return F.when(cond, F.struct(F.lit(cls).alias("class"), F.lit(message).alias("message")))

    def any_entry(test):
        return F.exists(f["entries"], test)

    url_bad = lambda u: u.isNotNull() & ~u.rlike(r"^https?://[^/\s]+")
    rules = [
        err(F.col("feed_type").isNull(), "critical", "Document cannot be read"),
        err(F.col("feed_type").isNotNull() & (~checks.filled(f["title"]) | ~checks.filled(f["link"])), "validation", "Missing required fields"),
        err(F.col("feed_type").isNotNull() & (F.size(f["entries"]) == 0), "validation", "Feed contains no items"),
        err(any_entry(lambda e: F.length(e["guid"]) > 512), "validation", "GUID exceeds maximum length"),
        err(any_entry(lambda e: url_bad(e["image"])), "format", "Invalid image URL format"),
        err(any_entry(lambda e: F.exists(e["categories"], lambda c: c.isNull() | (F.length(c) == 0))), "validation", "Empty category found"),
        err(any_entry(lambda e: F.exists(e["categories"], lambda c: F.length(c) > 200)), "validation", "Category exceeds maximum length"),
        err((f["updated_text"].isNotNull() & f["updated"].isNull())
            | any_entry(lambda e: e["updated_text"].isNotNull() & e["updated"].isNull()), "format", "Invalid date format"),
        err(url_bad(f["link"]) | any_entry(lambda e: url_bad(e["link"])), "format", "Invalid URL format"),
    ]
    if strict:
        long_text = (F.length(f["title"]) > 200) | (F.length(f["description"]) > 5000) | any_entry(
            lambda e: (F.length(e["title"]) > 200) | (F.length(e["summary"]) > 5000))
        rules += [
            err(long_text, "validation", "Content length exceeds maximum"),
            err((F.col("feed_type") == "rss") & ~checks.filled(f["description"]), "validation", "Missing recommended elements"),
        ]
        if raw is not None:
            rules.append(err(~F.is_valid_utf8(F.col(raw)), "format", "Non-UTF8 encoding detected"))
    worst = F.when(F.size("errors") == 0, F.lit(None).cast("string"))
    for cls in CLASS_RANK:
        worst = worst.when(F.array_contains(F.col("errors.class"), cls), cls)
    return parsed.withColumn("errors", F.array_compact(F.array(*rules))).withColumn("worst", worst)
