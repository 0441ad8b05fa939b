"""DuckDB forms of the shared expressions, used by the oracle SQL."""

from __future__ import annotations

from ..schemas import PUNCTUATION_AND_DIGITS, STOPWORDS, WHITESPACE_CLASS


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Delete punctuation and digits, lower-case, split on whitespace, drop empties.
SQL_WORDS = (
    "list_filter(string_split_regex(lower(translate(@COL@, " + sql_str(PUNCTUATION_AND_DIGITS)
    + ", '')), " + sql_str(WHITESPACE_CLASS) + "), lambda w: w <> '')"
)
# The stopword list as a one-column table.
SQL_STOPWORDS = "SELECT unnest([" + ", ".join(sql_str(w) for w in STOPWORDS) + "]) AS word"


def sql_words(col: str) -> str:
    return SQL_WORDS.replace("@COL@", col)
