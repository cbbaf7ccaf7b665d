"""Timestamps of conversations: ISO texts and three spoken formats, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, trim_or_null

# Formats in which sessions are dated.
SPOKEN_FORMATS = ("h:mm a 'on' d MMMM, yyyy", "h:mm a 'on' d MMM, yyyy", "yyyy-MM-dd")
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def parsed_time(x: ColumnOrName) -> Column:
    """Timestamp of a text in any of the formats; null where none fits. A time without zone is UTC."""
    t = trim_or_null(x)
    iso = F.when(t.rlike(_ISO), F.try_to_timestamp(F.regexp_replace(t, " ", "T")))
    fixed = F.regexp_replace(t, r"(?i)\b(am|pm)\b", "$1")
    spoken = [F.try_to_timestamp(F.regexp_replace(F.regexp_replace(fixed, r"\bam\b", "AM"), r"\bpm\b", "PM"), F.lit(f)) for f in SPOKEN_FORMATS]
    return F.coalesce(iso, *spoken)


def epoch_and_iso(x: ColumnOrName) -> Column:
    """Epoch seconds and ISO text; blank is the epoch itself, a text that can't be read raises."""
    t = trim_or_null(x)
    at = F.when(t.isNull(), F.timestamp_seconds(F.lit(0))).otherwise(parsed_time(x))
    bad = F.raise_error(F.concat(F.lit("unsupported timestamp: "), t))
    seconds = F.when(at.isNull(), bad.cast("long")).otherwise(F.unix_seconds(at))
    return F.struct(seconds.alias("epoch"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("iso"))


def run_stamp(ts: ColumnOrName) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyyMMdd'T'HHmmss'Z'")
