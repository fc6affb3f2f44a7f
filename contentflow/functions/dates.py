"""Feed dates and date mentions inside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentflow.functions.text import col, word_count

# The six kinds of date mention, first match wins.
MENTION_PATTERNS = [
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",
    r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}\b",
    r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
    r"\b(?:yesterday|today|tomorrow)\b",
    r"\b(?:last|next|this)\s+(?:week|month|year)\b",
    r"\b\d{4}\b",
]
MENTION_RE = "(?i)" + "|".join(MENTION_PATTERNS)
# Fixed value: the confidence check is case-sensitive and takes any word starting with a month name.
CONFIDENCE_RE = (
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}\b"
    r"|\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b|\b(?:yesterday|today|tomorrow)\b|\b(?:last|next|this)\s+(?:week|month|year)\b|\b\d{4}\b")

# Days to add for relative mentions.
RELATIVE_DAYS = {
    "yesterday": -1, "today": 0, "tomorrow": 1,
    "last week": -7, "this week": 0, "next week": 7,
    "last month": -30, "this month": 0, "next month": 30,
    "last year": -365, "this year": 0, "next year": 365,
}
FAR_FUTURE = "9999-12-31 23:59:59"


def date_mentions(text) -> Column:
    return F.regexp_extract_all(col(text), F.lit(MENTION_RE), F.lit(0))


def mention_confidence(sentence) -> Column:
    s = col(sentence)
    return (F.when(s.rlike(CONFIDENCE_RE), 0.6).otherwise(0.0)
            + F.when(word_count(s) > 5, 0.4).otherwise(0.0))


def _try(text: Column, shape: str, fmt: str) -> Column:
    """Parse only text of the expected shape, so that lenient parsing cannot guess."""
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)))


def resolve_mention(text, as_of) -> Column:
    """Timestamp of a mention: relative words, then explicit formats, else far future."""
    t = col(text)
    days = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in RELATIVE_DAYS.items() for x in kv]), F.lower(t))
    relative = F.timestamp_micros(F.unix_micros(col(as_of)) + days.cast("bigint") * F.lit(86400000000))
    return F.coalesce(
        relative,
        _try(t, r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
        _try(t, r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
        _try(t, r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
        _try(t, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
        _try(t, r"^[A-Z][a-z]{3,}\s+\d{1,2}, \d{4}$", "MMMM d, y"),
        _try(t, r"^[A-Z][a-z]{2}\s+\d{1,2}, \d{4}$", "MMM d, y"),
        _try(t, r"^\d{4}$", "y"),
        F.lit(FAR_FUTURE).cast("timestamp"),
    )


def parse_feed_date(text) -> Column:
    """ISO-8601 with offset, or RFC-822 whose weekday is ignored; null when neither."""
    t = F.trim(col(text))
    no_day = F.regexp_replace(t, r"^[A-Za-z]{3,9},\s*", "")
    zone = F.regexp_replace(no_day, r"\s(GMT|UTC|UT|Z)$", " +0000")
    iso_shape = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.coalesce(
        F.when(iso_shape, F.try_to_timestamp(t)),
        F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss")),
    )


def utc_date(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def iso_utc(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
