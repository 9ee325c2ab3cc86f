"""Named text patterns and the matching predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named patterns in the order in which they are tried; `integer_id`
# therefore also takes five-digit zip codes and phones made of digits only.
NAMED_PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[a-zA-Z]{2,}$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "datetime_iso": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}",
    "integer_id": r"^\d+$",
    "phone": r"^\+?[\d\-\(\) ]{7,15}$",
    "zip_code_us": r"^\d{5}(-\d{4})?$",
}
# Fixed value: share of values that must match before a column gets a pattern name.
PATTERN_MATCH_SHARE = 0.9


def matches(text: Column, regex: str) -> Column:
    """True where the regex matches from the first character on."""
    return text.rlike(f"^(?:{regex})")


def first_pattern(counts: dict[str, Column], total: Column) -> Column:
    """Name of the first pattern that reaches the share, NULL if none does."""
    picked = F.lit(None).cast("string")
    for name in reversed(list(counts)):
        picked = F.when(counts[name] / total >= PATTERN_MATCH_SHARE, F.lit(name)).otherwise(picked)
    return F.when(total > 0, picked)
