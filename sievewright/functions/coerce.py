"""Null handling and type coercion shared by checks and profiles."""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tokens a flat-file reader takes for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    """Booleans count as numbers, as in the profile."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def is_missing(c: Column, dtype: T.DataType) -> Column:
    """NULL or NaN."""
    return (c.isNull() | F.isnan(c)) if is_floating(dtype) else c.isNull()


def present(c: Column, dtype: T.DataType) -> Column:
    return ~is_missing(c, dtype)


def nan_to_null(c: Column, dtype: T.DataType) -> Column:
    return F.when(~F.isnan(c), c) if is_floating(dtype) else c


def to_number(c: Column, dtype: T.DataType) -> Column:
    """Double, or NULL where the value is no number."""
    if is_numeric(dtype):
        return nan_to_null(c.cast("double"), T.DoubleType())
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("double")
    # The guard rejects spellings only the cast would take ("12d").
    return F.when(c.rlike(NUMBER_TEXT), F.trim(c).try_cast("double"))


def to_timestamp(c: Column, dtype: T.DataType) -> Column:
    """Timestamp, or NULL where the value is none; zone-less input reads as UTC."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(dtype, T.StringType):
        return c.try_cast("timestamp")
    return F.lit(None).cast("timestamp")


def value_text(c: Column, dtype: T.DataType) -> Column:
    """One text form per distinct value, NULL for missing ones; the common type of the unpivot."""
    if is_nested(dtype):
        return F.to_json(c) if not isinstance(dtype, T.ArrayType) else F.to_json(F.struct(c.alias("v")))
    if is_floating(dtype):
        # -0.0 equals 0.0, so both must render alike.
        return F.when(~F.isnan(c), F.when(c == 0, F.lit("0.0")).otherwise(c.cast("string")))
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def plain_number(c: Column) -> Column:
    """A double as its shortest text, written out from 1e-4 up to below 1e16 and with an exponent elsewhere."""
    text = c.cast("string")
    size = F.abs(c)
    # At most 17 digits are significant, so the decimal holds them all.
    digits = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.regexp_extract(text, "E(-?)", 1), F.regexp_extract(text, r"E-?(\d+)", 1)
    sign = F.when(power[0] == "-", "-").otherwise("+")
    short = F.concat(F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), F.lit("e"), sign,
                     F.when(F.length(power[1]) < 2, F.lpad(power[1], 2, "0")).otherwise(power[1]))
    written = F.when(c == 0, "0.0").when((size >= 1e-4) & (size < 1e16), digits).when(text.contains("E"), short)
    return F.when(~F.isnan(c), F.coalesce(written, F.lower(F.regexp_replace(text, "inity", ""))))


def pattern_text(c: Column, dtype: T.DataType) -> Column:
    """The text a pattern is tested on: timestamps at midnight read as bare dates, numbers are written out."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        day = c.cast("date")
        return F.when(day.cast(dtype) == c, day.cast("string")).otherwise(c.cast("string"))
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    if is_floating(dtype):
        return plain_number(c)
    return value_text(c, dtype)


def below(c: Column, dtype: T.DataType, bound: float | int) -> Column:
    """c < bound in the column's own type; whole numbers and decimals never pass through doubles."""
    return _beside(c, dtype, bound, "<")


def above(c: Column, dtype: T.DataType, bound: float | int) -> Column:
    return _beside(c, dtype, bound, ">")


def _beside(c: Column, dtype: T.DataType, bound, side: str) -> Column:
    number = float(bound)
    if isinstance(dtype, T.IntegralType) and math.isfinite(number):
        # The nearest whole bound on the passing side means the same.
        whole = math.ceil(bound) if side == "<" else math.floor(bound)
        if not -(2**63) <= whole < 2**63:
            return c.isNotNull() & F.lit((whole > 0) == (side == "<"))
        return c < F.lit(whole) if side == "<" else c > F.lit(whole)
    if isinstance(dtype, T.DecimalType) and math.isfinite(number) and abs(number) < 1e18:
        exact = F.lit(Decimal(repr(bound)))
        return c < exact if side == "<" else c > exact
    x = to_number(c, dtype)
    return x < F.lit(number) if side == "<" else x > F.lit(number)


def of_type(values: list, dtype: T.DataType) -> list:
    """The listed values that a column of the type can equal, in that type; nothing is rounded on the way."""
    if isinstance(dtype, T.StringType):
        return list(dict.fromkeys(v for v in values if isinstance(v, str)))
    numbers = [v for v in values if isinstance(v, (int, float, Decimal)) and v == v]
    if isinstance(dtype, T.BooleanType):
        return sorted({bool(v) for v in numbers if v in (0, 1)})
    if isinstance(dtype, T.IntegralType):
        whole = {int(v) for v in numbers if math.isfinite(v) and v == int(v)}
        bits = 8 * {"tinyint": 1, "smallint": 2, "int": 4}.get(dtype.simpleString(), 8) - 1
        return sorted(v for v in whole if -(2**bits) <= v < 2**bits)
    if isinstance(dtype, T.DecimalType):
        exact = {Decimal(repr(v) if isinstance(v, float) else int(v) if isinstance(v, bool) else v)
                 for v in numbers if math.isfinite(v)}
        step, top = Decimal(1).scaleb(-dtype.scale), Decimal(10) ** (dtype.precision - dtype.scale)
        with localcontext() as context:
            context.prec = 80
            return sorted(v.quantize(step) for v in exact if abs(v) < top and v == v.quantize(step))
    return sorted({float(v) for v in numbers}) if is_floating(dtype) else []


def family(dtype: T.DataType) -> str:
    """Types whose values can be equal share a family; '1' never equals 1."""
    if is_numeric(dtype):
        return "number"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return dtype.simpleString()


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)
