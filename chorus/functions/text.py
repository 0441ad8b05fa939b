"""Text expressions: word splitting as the comment word counter does it, emoji stripping,
lengths. All of them are single built-in expressions over a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EMOJI_PATTERN, PUNCTUATION_AND_DIGITS, WHITESPACE_CHARS


def words(text: Column) -> Column:
    """Array of words; splits on every Unicode whitespace, never yields empties.

    One ``translate`` pass maps each whitespace character to a space and deletes punctuation
    and digits; the split is then on a literal space (no regex), and empties are removed with
    the built-in ``array_remove`` (no lambda). Same tokens as delete -> lower -> split().
    """
    cleaned = F.translate(text, WHITESPACE_CHARS + PUNCTUATION_AND_DIGITS, " " * len(WHITESPACE_CHARS))
    return F.array_remove(F.split(F.lower(cleaned), " "), "")


def strip_emoji(text: Column) -> Column:
    """remove every code point of the emoji ranges.

    ASCII texts (as many bytes as characters) hold none and are not searched; in others, one look ahead passes over what
    lies below all ranges before these are tried one by one.
    """
    found = F.regexp_replace(text, "(?=[^\\x00-\\xA8])" + EMOJI_PATTERN, "")
    return F.when(F.octet_length(text) > F.char_length(text), found).otherwise(text)


def char_length(text: Column) -> Column:
    """length in code points (astral characters count once)."""
    return F.char_length(text)


def token_length(tokens: Column) -> Column:
    """number of tokens of a token array."""
    return F.size(tokens)
