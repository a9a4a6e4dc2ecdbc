"""Text-body features. NULL text counts as the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_column, ratio

# --- fixed values -------------------------------------------------------------------
URL_PATTERN = r"""https?://[^\s<>"{}|\\^`\[\]]+"""
ADDRESS_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SPAM_PHRASES = [
    "free", "winner", "click here", "act now", "limited time",
    "congratulations", "urgent", "money", "cash", "prize",
    "viagra", "pharmacy", "buy now", "order now", "subscribe",
    "unsubscribe", "remove", "opt-out", "credit card", "wire transfer",
]
# ------------------------------------------------------------------------------------

# Java's \s is ASCII-only unless (?U) is set, and never covers the four separator controls.
_UNICODE = "(?U)"
_NON_SPACE = r"[^\s\x1c-\x1f]"


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(as_column(c), F.lit(""))


def occurrences(c: Column | str, char: str) -> Column:
    """How often one literal character occurs."""
    t = text_or_empty(c)
    return (F.length(t) - F.length(F.replace(t, F.lit(char), F.lit("")))).cast("long")


def letter_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(text_or_empty(c), r"[^\p{L}]+", ""))


def uppercase_count(c: Column | str) -> Column:
    # Capitals are few: cutting them out copies long stretches at once.
    t = text_or_empty(c)
    return F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))


def url_count(c: Column | str) -> Column:
    pattern = _UNICODE + URL_PATTERN.replace(r"\s", r"\s\x1c-\x1f")
    return F.regexp_count(text_or_empty(c), F.lit(pattern)).cast("long")


def address_count(c: Column | str) -> Column:
    # The pattern retries at every character of a word; most texts have no @ to look for.
    t = text_or_empty(c)
    found = F.when(t.contains("@"), F.regexp_count(t, F.lit(ADDRESS_PATTERN))).otherwise(F.lit(0))
    return found.cast("long")


def uppercase_ratio(c: Column | str) -> Column:
    return ratio(uppercase_count(c), letter_count(c))


def words(c: Column | str) -> Column:
    """Whitespace-separated words; one shared expression for count and mean length."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(f"{_UNICODE}{_NON_SPACE}+"), F.lit(0))


def word_count(c: Column | str) -> Column:
    return F.size(words(c)).cast("long")


def avg_word_length(c: Column | str) -> Column:
    return ratio(F.length(F.array_join(words(c), "")), F.size(words(c)))


def char_count(c: Column | str) -> Column:
    return F.length(text_or_empty(c)).cast("long")


def spam_phrase_count(c: Column | str) -> Column:
    """Phrases present at least once; repeats of one phrase count once."""
    t = F.lower(text_or_empty(c))
    total = F.lit(0)
    for phrase in SPAM_PHRASES:
        total = total + t.contains(phrase).cast("int")
    return total.cast("long")


def has_unsubscribe(c: Column | str) -> Column:
    return F.lower(text_or_empty(c)).contains("unsubscribe").cast("int")
