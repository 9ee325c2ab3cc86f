"""Tokens, hashed terms and the parsing of free-text answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: number of hash buckets of a text vector.
BUCKETS = 4096
TOKEN = r"([\p{L}\p{N}_]{2,})"


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def term_bucket(term: Column) -> Column:
    """Bucket 0..4095 of a term: its first 32 bits of MD5 modulo 4096, which are three hexadecimal digits of them."""
    return F.conv(F.substring(F.md5(term), 6, 3), 16, 10).cast("int")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _group(text: Column, regex: str) -> Column:
    """First group of the first match; NULL without a match."""
    return F.when(text.rlike(regex), F.regexp_extract(text, regex, 1))


def json_array_text(text: Column) -> Column:
    """From the first opening to the last closing bracket."""
    return _group(text, r"(?s)(\[.*\])")


def confidence(text: Column) -> Column:
    """Number after the word; 0.5 without one, values above 1 read as percent, within [0, 1]."""
    raw = F.coalesce(_group(text, r"(?i)confidence[:\s]+([0-9]*\.?[0-9]+)").cast("double"), F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(raw <= 1, raw).otherwise(raw / 100)))


def suggested_action(text: Column) -> Column:
    return F.coalesce(strip(_group(text, r"(?i)action[:\s]+([^\n]+)")), F.lit(""))


def explanation(text: Column) -> Column:
    """What stands before the confidence line, or everything if that is empty."""
    head = strip(F.substring_index(F.substring_index(text, "Confidence:", 1), "confidence:", 1))
    return F.when(head != "", head).otherwise(strip(text))


def ticket_title(text: Column) -> Column:
    """NULL unless both parts are present."""
    both = text.rlike(r"Title:\s*[^\n]") & text.rlike(r"(?s)Description:\s*.")
    return F.when(both, strip(F.regexp_extract(text, r"Title:\s*([^\n]+)", 1)))


def ticket_description(text: Column) -> Column:
    parsed = strip(F.regexp_extract(text, r"(?s)Description:\s*(.+)", 1))
    return F.when(ticket_title(text).isNotNull(), parsed).otherwise(strip(text))
