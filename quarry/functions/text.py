"""Text helpers (C14-C19, C24): token weights, truncation, names.

Token weights are regex counts evaluated in the JVM (D14).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns. WHITESPACE counts runs of non-blank
# characters; WORD_PUNCT counts word runs plus single punctuation marks.
WHITESPACE = r"\S+"
WORD_PUNCT = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"
_BLANKS = "\t\n\x0b\f\r"            # what \\s matches beside the space
# Pieces that each end at one whitespace token, keeping preceding blanks.
_TOKEN_PIECE = r"\s*\S+"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_count(c: str | Column, pattern: str = WHITESPACE) -> Column:
    """C17: number of tokens in a text (``bigint``). Runs of non-blank
    characters are counted by splitting at blanks, without a regex match each."""
    if pattern != WHITESPACE:
        return F.coalesce(F.regexp_count(col_(c), F.lit(pattern)), F.lit(0)).cast("bigint")
    text = col_(c)
    for blank in _BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.coalesce(F.array_size(F.array_remove(F.split(text, " "), "")), F.lit(0)).cast("bigint")


def truncate_tokens(c: str | Column, max_tokens: int) -> Column:
    """The text up to the end of its ``max_tokens``-th whitespace token,
    original spacing preserved; shorter texts are returned whole."""
    pieces = F.regexp_extract_all(col_(c), F.lit(_TOKEN_PIECE), 0)
    return F.when(F.size(pieces) <= max_tokens, col_(c)).otherwise(
        F.array_join(F.slice(pieces, 1, max_tokens), ""))


def truncate_chars(c: str | Column, max_chars: int) -> Column:
    """The first ``max_chars`` characters (the cut is the feature)."""
    return F.substring(col_(c), 1, max_chars)


def base_name(c: str | Column) -> Column:
    """Last path component."""
    return F.regexp_replace(col_(c), r"^.*/", "")


def stem(c: str | Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(c), r"\.[^.]*$", "")


def percent_label(c: str | Column, decimals: int = 2) -> Column:
    """``12.35%`` style label."""
    return F.format_string(f"%.{decimals}f%%", col_(c))
