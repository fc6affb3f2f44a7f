"""Content type, priority and other labelling rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentflow.functions.text import col
from contentflow.vocab import SOCIAL_HOSTS, VIDEO_HOSTS


def _any_of(text: Column, parts) -> Column:
    return text.rlike("|".join(p.replace(".", r"\.") for p in parts))


def host(url) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def content_type_of_url(url, whole_url: bool = False) -> Column:
    """VIDEO or SOCIAL by known hosts, else BLOG."""
    where = F.lower(col(url)) if whole_url else host(url)
    return F.when(_any_of(where, VIDEO_HOSTS), "VIDEO").when(_any_of(where, SOCIAL_HOSTS), "SOCIAL").otherwise("BLOG")


# Payload keys that give the type away, strongest first.
TYPE_KEYS = [
    ("VIDEO", ["video_url", "youtube_id", "vimeo_id"]),
    ("SOCIAL", ["social_signals", "likes", "shares"]),
    ("NEWS", ["news_score", "article_text"]),
]


def content_type_of_payload(json_text) -> Column:
    """Type by the keys present in a JSON object; a key with a null value counts."""
    keys = F.coalesce(F.json_object_keys(col(json_text)), F.array().cast("array<string>"))
    out = F
    for label, wanted in TYPE_KEYS:
        out = out.when(F.arrays_overlap(keys, F.array(*[F.lit(w) for w in wanted])), label)
    return out.otherwise("GENERAL")


def age_hours(published, as_of) -> Column:
    return (F.unix_micros(col(as_of)) - F.unix_micros(col(published))) / 3.6e9


def priority_score(likes, shares, comments, content_type, published, as_of) -> Column:
    """1..10: base 5, raised by engagement, type and freshness."""
    def bump(cond, n=1):
        return F.when(cond, n).otherwise(0)

    likes, shares, comments, kind = col(likes), col(shares), col(comments), col(content_type)
    age = age_hours(published, as_of)
    total = (
        F.lit(5)
        + bump(likes > 1000) + bump(likes > 5000)
        + bump(shares > 500) + bump(shares > 2000)
        + bump(comments > 100)
        + F.when(kind == "VIDEO", 2).when(kind.isin("NEWS", "SOCIAL"), 1).otherwise(0)
        + F.when(age < 1, 2).when(age < 6, 1).otherwise(0)
    )
    return F.least(F.greatest(total, F.lit(1)), F.lit(10)).cast("bigint")


def priority_level(categories, published, as_of) -> Column:
    """HIGH for breaking news, NORMAL when published today (UTC), else LOW."""
    breaking = F.exists(col(categories), lambda c: F.lower(c) == "breaking news")
    return F.when(breaking, "HIGH").when(col(published) > F.date_trunc("day", col(as_of)), "NORMAL").otherwise("LOW")


def priority_label(categories, published, as_of) -> Column:
    """High for an ``important`` category, Medium inside a day, else Low."""
    age = F.unix_micros(col(as_of)) - F.unix_micros(col(published))
    return F.when(F.array_contains(col(categories), "important"), "High").when(age < 86400 * 1000000, "Medium").otherwise("Low")


def ruleset_priority(title, source, categories, published, as_of, keywords, trusted, high_categories) -> Column:
    """Keyword, trusted-and-fresh, category, then recency."""
    low = F.lower(col(title))
    breaking = F.lit(False)
    for k in keywords:
        breaking = breaking | F.contains(low, F.lit(k))
    age = age_hours(published, as_of)
    in_category = F.arrays_overlap(col(categories), F.array(*[F.lit(c) for c in high_categories]))
    return (
        F.when(breaking | (F.lower(col(source)).isin(list(trusted)) & (age <= 1)) | in_category, "HIGH")
        .when(age <= 24, "NORMAL")
        .otherwise("LOW")
    )


def headline_priority(title) -> Column:
    low = F.lower(col(title))
    return F.when(low.rlike("breaking|urgent"), "High").when(low.rlike("new|update"), "Medium").otherwise("Low")


def fact_category(text) -> Column:
    low = F.lower(col(text))
    return (
        F.when(low.rlike(r"[0-9]+(\.[0-9]+)?( ?%| percent)|[0-9]{2,}"), "STATISTICAL")
        .when(low.rlike(r"(^|[^a-z])(year|years|month|months|week|weeks|today|yesterday|recent|recently|century)($|[^a-z])"),
              "TEMPORAL")
        .otherwise("GENERAL")
    )


def mapped(key, table: dict, default: str) -> Column:
    """Lookup in a small fixed map with a default."""
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), col(key)), F.lit(default))


def extension(path) -> Column:
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1))


def redact(message) -> Column:
    out = col(message)
    for key in ("token", "password", "key"):
        out = F.regexp_replace(out, key + r"=[a-zA-Z0-9_-]+", key + "=REDACTED")
    return out


def drop_keys(details, keys) -> Column:
    hidden = F.array(*[F.lit(k) for k in keys])
    return F.map_filter(col(details), lambda k, v: ~F.array_contains(hidden, k))


def content_hash(payload_map) -> Column:
    """Key order does not matter: entries are sorted before hashing."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(payload_map))))), 256)


def backoff(attempt, base: float, cap: float | None = None) -> Column:
    """base * 2^attempt seconds, optionally capped."""
    delay = F.lit(float(base)) * F.pow(F.lit(2.0), col(attempt))
    return delay if cap is None else F.least(delay, F.lit(float(cap)))


def delivery_outcome(status_code) -> Column:
    c = col(status_code)
    return (F.when(c.isNull(), "request_failed").when(c == 429, "rate_limited").when(c >= 400, "http_error")
            .otherwise("success"))


def error_id(ts, *parts) -> Column:
    """Repeatable id: milliseconds and a four-digit number derived from the row."""
    return F.concat(F.lit("err_"), F.unix_millis(col(ts)).cast("string"), F.lit("_"),
                    (F.conv(F.substring(F.md5(F.concat_ws("|", *[col(p) for p in parts])), 1, 8), 16, 10).cast("bigint") % 9000 + 1000).cast("string"))


def with_priority(items, rule, out: str = "priority"):
    """Items with the priority a user rule gives them; ``rule(items) -> Column``."""
    return items.withColumn(out, rule(items))
