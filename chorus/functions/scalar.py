"""Scalar expressions: ratios, casts, logs, label maps, argmax, ordering helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ID_LABELS, LABEL_IDS, SENTIMENT_ORDER


def engagement_rate(like_count: Column, comment_count: Column, view_count: Column) -> Column:
    """(likes + comments) / views, 0.0 when there are no views (never divides by zero)."""
    return (F.when(view_count != 0,
                   (like_count + comment_count).cast("double") / view_count.cast("double"))
            .otherwise(F.lit(0.0)))


def parse_iso_timestamp(s: Column) -> Column:
    """F8: ISO-8601 text (date alone, blank or T between, offset or Z) -> TIMESTAMP_NTZ in UTC.

    Text that is no ISO timestamp becomes NULL. Wall-clock text is taken as UTC whatever the
    session's time zone is: an offset is applied here, not by the session.
    """
    zone = F.regexp_extract(s, r"[T ].*([+-])(\d{2}):?(\d{2})$", 0) != ""
    minutes = (F.regexp_extract(s, r"([+-])(\d{2}):?(\d{2})$", 2).try_cast("int") * 60
               + F.regexp_extract(s, r"([+-])(\d{2}):?(\d{2})$", 3).try_cast("int"))
    shift = F.when(zone, F.when(F.regexp_extract(s, r"([+-])\d{2}:?\d{2}$", 1) == "-", minutes).otherwise(-minutes)) \
        .otherwise(F.lit(0))
    plain = F.when(zone, F.regexp_replace(s, r"\s*[+-]\d{2}:?\d{2}$", "")).otherwise(F.regexp_replace(s, "Z$", ""))
    iso = plain.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?$")
    full = F.when(plain.rlike(r"[T ]\d{2}$"), F.concat(plain, F.lit(":00"))).otherwise(plain)
    parsed = F.when(iso, full).try_cast("timestamp_ntz")
    return F.timestamp_add("MINUTE", shift, parsed)


def unparsed_timestamps(s: Column) -> Column:
    """F8: how many non-null texts are no timestamp (an aggregate)."""
    return F.count(F.when(s.isNotNull() & parse_iso_timestamp(s).isNull(), 1))


def log_base(x: Column, base: float) -> Column:
    """log of x in the given base (NULL for x <= 0)."""
    return F.ln(x) / F.lit(math.log(base))


def _map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def encode_label(sentiment: Column) -> Column:
    """Positive 0, Neutral 1, Negative 2 (NULL for anything else)."""
    return F.element_at(_map_literal(LABEL_IDS), sentiment)


def decode_label(label: Column) -> Column:
    """F13 inverse: 0 Positive, 1 Neutral, 2 Negative."""
    return F.element_at(_map_literal(ID_LABELS), label.cast("int"))


def argmax(scores: Column) -> Column:
    """0-based index of the first maximum of an array of scores."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def correct_flag(truth: Column, predicted: Column) -> Column:
    """truth equals prediction."""
    return truth == predicted


def sentiment_order(sentiment: Column) -> Column:
    """T4: sort key of the report order Positive, Neutral, Negative."""
    return F.element_at(_map_literal(SENTIMENT_ORDER), sentiment)


def report_round(x: Column, digits: int = 2) -> Column:
    """F16: report value rounded to ``digits`` decimals."""
    return F.round(x, digits)
