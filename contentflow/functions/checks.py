"""Validation rules. Each returns an error message or null; ``errors`` collects them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.functions.dates import parse_feed_date
from contentflow.functions.text import col

CONTENT_TYPES = ["BLOG", "VIDEO", "SOCIAL"]
PRIORITIES = ["High", "Medium", "Low"]
# Fields a feed header needs, by feed type.
HEADER_FIELDS = {
    "rss": ["title", "link", "description"],
    "atom": ["title", "id", "updated"],
    "json": ["version", "title", "items"],
}
URL_RE = (r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost"
          r"|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$")
WEBHOOK_URL_RE = r"^https?://[^\s]+$"


def filled(c) -> Column:
    return F.coalesce(F.length(col(c)) > 0, F.lit(False))


def errors(*rules: Column) -> Column:
    """Messages of the broken rules, in rule order."""
    return F.array_compact(F.array(*rules))


def title_error(c) -> Column:
    return (F.when(~filled(c), "Title is required")
            .when(F.length(col(c)) > 255, "Title exceeds maximum length of 255 characters")
            .when(col(c).rlike("<[^>]+>"), "Title contains HTML tags"))


def url_error(c) -> Column:
    return (F.when(~filled(c), "URL is required")
            .when(F.length(col(c)) > 2048, "URL exceeds maximum length of 2048 characters")
            .when(~col(c).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), "Invalid URL format"))


def content_type_error(c) -> Column:
    return F.when(filled(c) & ~col(c).isin(CONTENT_TYPES),
                  "Invalid content type. Must be one of: " + ", ".join(CONTENT_TYPES))


def priority_error(c) -> Column:
    return F.when(filled(c) & ~col(c).isin(PRIORITIES),
                  "Invalid priority. Must be one of: " + ", ".join(PRIORITIES))


def tag_errors(c, most: int = 10, longest: int = 50) -> Column:
    """An array: too many tags, then one message per over-long tag."""
    many = F.when(F.size(col(c)) > most, F.array(F.lit(f"Maximum of {most} tags allowed"))).otherwise(
        F.array().cast("array<string>"))
    long_ones = F.transform(
        F.filter(col(c), lambda t: F.length(t) > longest),
        lambda t: F.concat(F.lit("Tag '"), t, F.lit(f"' exceeds maximum length of {longest} characters")))
    return F.concat(many, F.coalesce(long_ones, F.array().cast("array<string>")))


def record_error(title, content_type, brief, priority) -> Column:
    """First broken constraint of a delivery record."""
    return (F.when(~F.coalesce(col(content_type).isin(CONTENT_TYPES), F.lit(False)), "Invalid content type")
            .when(~F.coalesce(col(priority).isin(PRIORITIES), F.lit(False)), "Invalid priority")
            .when(F.length(col(title)) > 255, "Title must not exceed 255 characters")
            .when(F.length(col(brief)) > 2000, "Brief must not exceed 2000 characters"))


def missing(required, present: Column) -> Column:
    return F.array_except(F.array(*[F.lit(r) for r in required]), present)


def present_fields(columns: dict[str, Column]) -> Column:
    """Names of the non-null columns."""
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in columns.items()]))


def payload_error(data: str = "data") -> Column:
    """First broken rule of an incoming delivery payload struct."""
    d = F.col(data)
    top = missing(["title", "contentType", "brief", "priority", "sourceMetadata"], present_fields(
        {n: d[n] for n in ["title", "contentType", "brief", "priority", "sourceMetadata"]}))
    meta = missing(["feedId", "originalUrl", "publishDate"], present_fields(
        {n: d["sourceMetadata"][n] for n in ["feedId", "originalUrl", "publishDate"]}))
    return (
        F.when(F.size(top) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(top, ", ")))
        .when(F.size(meta) > 0, F.concat(F.lit("Missing required metadata fields: "), F.array_join(meta, ", ")))
        .when(parse_feed_date(d["sourceMetadata"]["publishDate"]).isNull(), "Invalid publish date format")
        .otherwise(record_error(d["title"], d["contentType"], d["brief"], d["priority"]))
    )


def deliverable(title, content_types, brief, allowed=("BLOG",)) -> Column:
    """Delivery check of one item: fields present, an allowed type, a title of at most 255."""
    return F.coalesce(
        col(title).isNotNull() & col(brief).isNotNull()
        & F.arrays_overlap(col(content_types), F.array(*[F.lit(a) for a in allowed]))
        & (F.length(col(title)) <= 255), F.lit(False))


def header_missing(feed_type, present: Column) -> Column:
    """Header fields a feed of this type lacks."""
    out = F
    for kind, fields in HEADER_FIELDS.items():
        out = out.when(col(feed_type) == kind, missing(fields, present))
    return out.otherwise(F.array().cast("array<string>"))


def in_range(c, low: float, high: float) -> Column:
    """Null passes, as an optional field does."""
    return F.coalesce(col(c).between(low, high), F.lit(True))


def _outside(c: Column, low: float, high: float, name: str) -> Column:
    return F.when(~F.coalesce(c.between(low, high), F.lit(True)), f"{name} must be between {low:g} and {high:g}")


def _told(*errors_: Column) -> Column:
    return F.array_compact(F.array(*errors_))


def enhancement_errors(summary, credibility, quality, facts) -> Column:
    """Broken constraints of an enhancement result; ``facts`` is array<struct<fact, confidence>>."""
    whole = F.forall(F.coalesce(col(facts), F.array().cast("array<struct<fact:string,confidence:double>>")),
                     lambda f: f["fact"].isNotNull() & f["confidence"].isNotNull())
    return _told(F.when(F.length(F.trim(F.coalesce(col(summary), F.lit("")))) == 0, "summary must not be empty"),
                 _outside(col(credibility), 0, 1, "credibility"), _outside(col(quality), 0, 1, "quality"),
                 F.when(~whole, "each fact needs fact and confidence"))


def source_content_errors(quality, readability, sentiment, content) -> Column:
    """Broken constraints of a stored source content; ``content`` is a map of its fields."""
    return F.concat(
        _told(_outside(col(quality), 0, 1, "quality"), _outside(col(readability), 0, 100, "readability"), _outside(col(sentiment), -1, 1, "sentiment")),
        F.transform(missing(["title", "body", "url"], F.map_keys(col(content))), lambda f: F.concat(F.lit("content lacks "), f)))


def generated_content_errors(temperature, review, content) -> Column:
    """Broken constraints of a generated content."""
    return F.concat(
        _told(_outside(col(temperature), 0, 1, "temperature"), _outside(col(review), 0, 1, "review score")),
        F.transform(missing(["title", "body"], F.map_keys(col(content))), lambda f: F.concat(F.lit("content lacks "), f)))


def split_valid(df: DataFrame, errors_col: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows): bad rows never stop the good ones."""
    good = df.filter(F.size(errors_col) == 0).drop(errors_col)
    return good, df.filter(F.size(errors_col) > 0)


def at_least(level, floor: str, ranks: dict[str, int]) -> Column:
    """Severity threshold by rank, not by spelling."""
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.try_element_at(table, col(level)) >= ranks[floor]
