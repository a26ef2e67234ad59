"""Text expressions built from Spark's own string functions.

Character classes are spelled out (letters, numbers, underscore; all Unicode
white space) because Java's shorthand classes only cover ASCII.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from sitegauge.functions.scalars import col

# Cleaning patterns and replacements, applied in this order.
# (?d) makes "." stop at a line feed only.
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_WORD = r"\p{L}\p{N}_"
CLEANING = [
    (rf"https?://[^{_SPACE}]+", ""),
    (r"(?d)!\[.*?\]\(.*?\)", ""),
    (r"(?d)\[([^\]]+)\]\(.*?\)", "$1"),
    (r"[#*_~`>]", ""),
    (rf"/?(u|r)/[{_WORD}]+", ""),
    # Any white space but a single blank standing alone.
    (rf"[{_SPACE}&&[^ ]][{_SPACE}]*| [{_SPACE}]+", " "),
]
STRICT_MENTION = rf"(?<![{_WORD}])/?(u|r)/[{_WORD}]+"
FORUM_IN_URL = rf"reddit\.com/r/([{_WORD}]+)"
TOPIC_TOKEN = rf"(?<![{_WORD}])[a-z][a-z]+(?![{_WORD}])"


def clean_text(c: str | Column, strict: bool = False) -> Column:
    """Strip links, markdown marks and user or forum mentions; collapse white space.

    Mentions are cut wherever the pattern occurs, also inside a word;
    ``strict`` only cuts those that begin a word.
    """
    out = F.coalesce(col(c), F.lit(""))
    for pattern, replacement in CLEANING:
        if strict and "(u|r)" in pattern:
            pattern = STRICT_MENTION
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def forum_of(url: str | Column) -> Column:
    """Lower-case forum name in a post's address, or null."""
    return F.nullif(F.lower(F.regexp_extract(col(url), FORUM_IN_URL, 1)), F.lit(""))


def place_key(c: str | Column) -> Column:
    return F.lower(F.trim(col(c)))


def lookup_key(place: str | Column, hint: str | Column) -> Column:
    """Cache key of a place and its state hint; a missing hint is empty."""
    return F.concat_ws("|", place_key(place), F.coalesce(col(hint), F.lit("")))


def county_label(c: str | Column) -> Column:
    """Normal form of a county name: lower case, ending in "county"."""
    name = place_key(c)
    return F.when(name.endswith("county"), name).otherwise(F.concat(name, F.lit(" county")))


def topic_tokens(c: str | Column) -> Column:
    """Lower-case runs of two or more plain letters that stand as words."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOPIC_TOKEN), 0)


def without_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    stops = sorted(set(stop_words))
    return F.filter(tokens, lambda t: ~t.isin(stops)) if stops else tokens


def uni_and_bigrams(tokens: Column) -> Column:
    """Single tokens followed by pairs of neighbours joined with a space."""
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(tokens, pairs)
