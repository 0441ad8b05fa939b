"""Hand-made cases (expected values worked out by hand) for the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from chorus.functions import (argmax, char_length, engagement_rate, is_video_link, strip_emoji,
                              video_key, words)
from chorus.functions.scalar import decode_label, encode_label, parse_iso_timestamp
from chorus.schemas import WHITESPACE_CHARS


def one(spark, expr, value, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(expr(F.col("x")).alias("r")).first()["r"]


def test_whitespace_set_is_pythons():
    assert set(WHITESPACE_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


@pytest.mark.parametrize("text,expected", [
    ("a b\x1cc\x85d E.f don't  1x2  q", ["a", "b", "c", "d", "ef", "dont", "x", "q"]),
    ("", []),
    ("!!! 123", []),
    ("Tab\there　wide para", ["tab", "here", "wide", "para"]),
])
def test_words(spark, text, expected):
    assert one(spark, words, text) == expected


def test_words_match_python_split(spark):
    import string
    table = str.maketrans("", "", string.punctuation + "1234567890")
    samples = ["Héllo, Wörld!  ÉTÉ naïve", "x y z", "  lead and trail  ", "ß İ ǅ"]
    for s in samples:
        assert one(spark, words, s) == s.translate(table).lower().split()


def test_char_length_counts_code_points(spark):
    assert one(spark, char_length, "👍😀 é İ ß") == 8


def test_strip_emoji(spark):
    assert one(spark, strip_emoji, "hi 👍😀 there ☀ ok ©") == "hi  there  ok "


@pytest.mark.parametrize("url,valid,key", [
    ("https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1", True, "dQw4w9WgXcQ"),
    ("youtu.be/dQw4w9WgXcQ", True, "dQw4w9WgXcQ"),
    ("https://youtu.be/AAAAAAAAAAA?v=BBBBBBBBBBB", True, "AAAAAAAAAAA"),
    ("https://youtuXbe/dQw4w9WgXcQ", True, None),
    ("https://www.youtube.com/shorts/dQw4w9WgXcQ", False, None),
    ("https://www.youtube.com/watch?list=x&v=dQw4w9WgXcQ", False, "dQw4w9WgXcQ"),
    ("http://m.youtube.com/watch?v=dQw4w9WgXc", False, None),
])
def test_links(spark, url, valid, key):
    assert one(spark, is_video_link, url) is valid
    assert one(spark, video_key, url) == key


def test_engagement_rate(spark):
    df = spark.createDataFrame([(3, 2, 10), (3, 2, 0)], "l long, c long, v long")
    got = [r[0] for r in df.select(engagement_rate(F.col("l"), F.col("c"), F.col("v"))).collect()]
    assert got == [0.5, 0.0]


def test_argmax_first_max(spark):
    assert one(spark, argmax, [0.1, 0.7, 0.7], "x array<double>") == 1


def test_label_maps(spark):
    df = spark.createDataFrame([("Positive",), ("Neutral",), ("Negative",), ("Other",)], "s string")
    got = [tuple(r) for r in df.select(encode_label(F.col("s")), decode_label(encode_label(F.col("s")))).collect()]
    assert got == [(0, "Positive"), (1, "Neutral"), (2, "Negative"), (None, None)]


def test_parse_iso(spark):
    r = one(spark, parse_iso_timestamp, "2024-01-02T03:04:05.123456Z")
    assert r.isoformat() == "2024-01-02T03:04:05.123456"
    assert one(spark, parse_iso_timestamp, "2024-01-02T03:04:05Z").isoformat() == "2024-01-02T03:04:05"
    assert one(spark, parse_iso_timestamp, "not a date") is None
