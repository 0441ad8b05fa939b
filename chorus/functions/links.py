"""Video link validation (F6) and key extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import VIDEO_KEY_PATTERN, VIDEO_LINK_PATTERN


def is_video_link(url: Column) -> Column:
    """the url has the shape of a watch link or a short link."""
    return F.coalesce(url.rlike(VIDEO_LINK_PATTERN), F.lit(False))


def video_key(url: Column) -> Column:
    """the 11-character key, NULL when the url carries none."""
    return F.nullif(F.regexp_extract(url, VIDEO_KEY_PATTERN, 1), F.lit(""))
