"""Qualified names, deterministic ids and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fq_name(source: Column, schema: Column, table: Column) -> Column:
    """Non-empty parts joined by dots."""
    parts = [F.nullif(p, F.lit("")) for p in (source, schema, table)]
    return F.concat_ws(".", *parts)


def resolve_fq(source: Column, schema: Column, table: Column) -> Column:
    """A name that already starts with the source stays as it is."""
    return F.when(F.startswith(table, F.concat(source, F.lit("."))), table).otherwise(
        fq_name(source, schema, table))


def split_name(name: Column, default_schema: Column) -> tuple[Column, Column]:
    """(schema, table): cut at the first dot; without one the default schema applies."""
    dot = F.instr(name, ".")
    schema = F.when(dot > 0, F.substring_index(name, ".", 1)).otherwise(default_schema)
    table = F.when(dot > 0, name.substr(dot + 1, F.length(name))).otherwise(name)
    return schema, table


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix + 12 hex digits that depend only on the parts."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, 12))


def percent(x: Column, digits: int = 2) -> Column:
    """0.1234 -> 12.34%; ties round to even on the binary value."""
    return F.concat(decimals(x * 100, digits), F.lit("%"))


def decimals(x: Column, digits: int) -> Column:
    pattern = "0." + "0" * digits if digits else "0"
    text = F.call_function("format_number", x, F.lit(pattern))
    return (F.when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf"))
            .otherwise(text))


def percent_literal(x: float, digits: int = 2) -> str:
    return f"{x:.{digits}%}"
