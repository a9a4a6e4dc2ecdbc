"""Subject, header and address features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_column
from .text import letter_count, text_or_empty, uppercase_count


def present(c: Column | str) -> Column:
    """1 when the text is neither NULL nor empty."""
    return (F.length(text_or_empty(c)) > 0).cast("int")


def html_to_text_ratio(text: Column | str, html: Column | str) -> Column:
    n_text = F.length(text_or_empty(text)).cast("double")
    n_html = F.length(text_or_empty(html)).cast("double")
    return F.when(n_text == 0, n_html).otherwise(n_html / F.nullif(n_text, F.lit(0.0)))


def subject_is_reply(c: Column | str) -> Column:
    return F.lower(text_or_empty(c)).startswith("re:").cast("int")


def subject_is_forward(c: Column | str) -> Column:
    s = F.lower(text_or_empty(c))
    return (s.startswith("fwd:") | s.startswith("fw:")).cast("int")


def subject_all_caps(c: Column | str, min_letters: int) -> Column:
    letters = letter_count(c)
    return ((letters >= min_letters) & (uppercase_count(c) == letters)).cast("int")


def domain_of(address: Column | str) -> Column:
    """Text after the last ``@``, or the empty string; case kept."""
    a = text_or_empty(address)
    return F.when(F.instr(a, "@") > 0, F.substring_index(a, "@", -1)).otherwise(F.lit(""))


def serving_domain_of(address: Column | str) -> Column:
    """Lower-cased text after the last ``@``; the whole address when there is none."""
    return F.lower(F.substring_index(text_or_empty(address), "@", -1))


def has_digit(c: Column | str) -> Column:
    return text_or_empty(c).rlike(r"\p{Nd}").cast("int")


def local_part(address: Column | str) -> Column:
    return F.substring_index(text_or_empty(address), "@", 1)


def hop_count(c: Column | str) -> Column:
    return F.coalesce(as_column(c), F.lit(0)).cast("long")


def content_id(content: Column | str) -> Column:
    """First 16 hex digits of SHA-256 of the raw bytes."""
    return F.substring(F.sha2(as_column(content).cast("binary"), 256), 1, 16)


def clip_body(c: Column | str, limit: int = 50_000) -> Column:
    """Stored body text: at most ``limit`` characters, by the table's definition."""
    return F.left(text_or_empty(c), F.lit(limit))


def clip_html(c: Column | str, limit: int = 50_000) -> Column:
    return F.nullif(F.left(text_or_empty(c), F.lit(limit)), F.lit(""))
