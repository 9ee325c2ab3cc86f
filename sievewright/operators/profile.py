"""Column and table profiles.

The first scan counts values by digest: one shuffle of (column, digest) groups of fixed width gives distinct counts, the
most frequent values, pattern shares and means. Texts do not travel: a second scan, of text columns alone, fetches those
of the most frequent values, known by their digests, and the extremes. Squares around the mean are summed up over the
rows of the numeric columns, without a shuffle; the many groups are not read again for them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import is_floating, is_nested, is_numeric, nan_to_null, value_text
from ..functions.patterns import NAMED_PATTERNS, PATTERN_MATCH_SHARE, matches
from ..session import cut_lineage, local_copy
from .checks import field

# Fixed value: most frequent values kept per column.
TOP_VALUES = 5
# Text columns of one pass of the second scan.
COLUMNS_PER_PASS = 100
# Numbers of three characters each that order the beginnings of texts.
ORDER = 4

PROFILE = T.StructType([T.StructField(n, t) for n, t in (
    ("table_fq_name", T.StringType()), ("position", T.IntegerType()), ("column", T.StringType()),
    ("data_type", T.StringType()), ("row_count", T.LongType()), ("null_count", T.LongType()), ("null_rate", T.DoubleType()),
    ("distinct_count", T.LongType()), ("distinct_rate", T.DoubleType()), ("min_value", T.DoubleType()),
    ("max_value", T.DoubleType()), ("mean", T.DoubleType()), ("stddev", T.DoubleType()), ("min_text", T.StringType()),
    ("max_text", T.StringType()),
    ("top_values", T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("n", T.LongType())]))),
    ("inferred_pattern", T.StringType()), ("is_candidate_key", T.BooleanType()))])


def head_sample(df: DataFrame, limit: int, order_by: list[str] | None = None) -> DataFrame:
    """The first rows; with an order they are the same ones on every run."""
    return (df.orderBy(*order_by) if order_by else df).limit(limit)


@dataclass(frozen=True)
class Measured:
    """A column and how its values are written as numbers of fixed width, if they can be."""

    position: int
    name: str
    dtype: T.DataType

    @property
    def raw(self) -> Column:
        return field(self.name)

    @property
    def text(self) -> Column:
        """One text per distinct value."""
        return value_text(self.raw, self.dtype)

    @property
    def whole(self) -> Column | None:
        """The value as a whole number, for types that have one."""
        if isinstance(self.dtype, (T.IntegralType, T.BooleanType)):
            return self.raw.cast("long") if not isinstance(self.dtype, T.BooleanType) else self.raw.cast("int").cast("long")
        if isinstance(self.dtype, T.DateType):
            return F.unix_date(self.raw).cast("long")
        return F.unix_micros(self.raw) if isinstance(self.dtype, T.TimestampType) else None

    @property
    def by_digest(self) -> bool:
        return self.whole is None and not is_floating(self.dtype)

    def written(self, whole: Column, number: Column) -> Column:
        """The text of a value from its number."""
        if is_floating(self.dtype):
            return value_text(number.cast(self.dtype), self.dtype)
        if isinstance(self.dtype, T.BooleanType):
            return (whole == 1).cast("string")
        if isinstance(self.dtype, T.DateType):
            return F.date_from_unix_date(whole.cast("int")).cast("string")
        return F.timestamp_micros(whole).cast("string") if isinstance(self.dtype, T.TimestampType) else whole.cast("string")

    def cell(self) -> Column:
        """struct(position, d1, x, y, text): a whole number, another number, a number to measure, a text to digest."""
        d1, x, y, text = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("string")
        if self.whole is not None:
            d1 = self.whole
        elif is_floating(self.dtype):
            x = nan_to_null(self.raw, self.dtype).cast("double")
        else:
            text = self.text
            if is_numeric(self.dtype):
                y = self.raw.cast("double")
        return F.struct(F.lit(self.position).alias("position"), d1.alias("d1"), x.alias("x"), y.alias("y"), text.alias("text"))


def text_digest(text: Column) -> tuple[Column, Column]:
    """128 bits of hash of a text."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def text_order(text: Column) -> list[Column]:
    """Numbers that order texts by their first 3 * ORDER characters; a text goes before those it begins."""
    def three(at: int) -> Column:
        parts = [F.ascii(F.substring(text, at + k, 1)).cast("long") for k in range(3)]
        return F.shiftleft(parts[0], 42) + F.shiftleft(parts[1], 21) + parts[2]
    return [three(1 + 3 * i) for i in range(ORDER)]


def measured(df: DataFrame) -> list[Measured]:
    return [Measured(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]


def value_groups(df: DataFrame, columns: list[Measured]) -> DataFrame:
    """(position, d1, d2, x, y, bits, o..., n): rows by column and value, all of fixed width. Missing: no d1 and no x.

    What follows from the value is part of the key, so that every use of the groups reads one and the same shuffle.
    """
    order = [f"o{i}" for i in range(ORDER)]
    cells = df.select(F.inline(F.array(*[c.cell() for c in columns])))
    # Texts are digested behind the cells, by one piece of code for all columns: one for each would be too long to be compiled.
    text, digested = F.col("text"), F.col("text").isNotNull()
    d1, d2 = text_digest(text)
    hits = [F.when(matches(text, regex), F.lit(1 << i)).otherwise(0) for i, regex in enumerate(NAMED_PATTERNS.values())]
    named = digested & _chosen(c for c in columns if isinstance(c.dtype, T.StringType))
    return (cells.select("position", F.when(digested, d1).otherwise(F.col("d1")).alias("d1"), F.when(digested, d2).alias("d2"), "x", "y",
                         F.when(named, functools.reduce(Column.bitwiseOR, hits)).otherwise(0).cast("int").alias("bits"),
                         *[o.alias(name) for name, o in zip(order, text_order(text))])
            .groupBy("position", "d1", "d2", "x", "y", "bits", *order).agg(F.count(F.lit(1)).alias("n")))


def _chosen(columns: Iterable[Measured]) -> Column:
    positions = [c.position for c in columns]
    return F.col("position").isin(positions) if positions else F.lit(False)


def _written(columns: list[Measured]) -> Column:
    """The text of a group's value, for columns whose values are numbers."""
    out = F.lit(None).cast("string")
    for c in columns:
        if not c.by_digest:
            out = F.when(F.col("position") == c.position, c.written(F.col("d1"), F.col("x"))).otherwise(out)
    return out


def _ranked(groups: DataFrame, columns: list[Measured], k: int) -> DataFrame:
    """The k + 1 most frequent values of each column, ties by text as far as it is known."""
    by_count = Window.partitionBy("position").orderBy(F.desc("n"), "value", *[f"o{i}" for i in range(ORDER)], "d1", "d2")
    # The filter involves `n`, so it stays above the grouping, whose shuffle is the one that the sums read.
    here = F.when(F.col("d1").isNotNull() | F.col("x").isNotNull(), F.col("n")) > 0
    return (groups.where(here).withColumn("value", _written(columns))
            .withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= k + 1))


def _statistics(groups: DataFrame, columns: list[Measured], k: int) -> DataFrame:
    """One row per column: counts, moments and the most frequent values; every part reads the same shuffle."""
    here = F.col("d1").isNotNull() | F.col("x").isNotNull()
    whole = _chosen(c for c in columns if c.whole is not None and is_numeric(c.dtype))
    number = F.coalesce("x", "y", F.when(whole, F.col("d1").cast("double")))
    groups = groups.withColumn("v", number)
    weight = F.when(F.col("v").isNotNull(), F.col("n"))
    hits = [F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) > 0, F.col("n"))).alias(f"p{i}") for i in range(len(NAMED_PATTERNS))]
    sums = groups.groupBy("position").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias("present"),
        F.count_if(here).alias("distinct"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("d1").alias("d_lo"),
        F.max("d1").alias("d_hi"), F.sum(weight).alias("numbers"), (F.sum(F.col("v") * F.col("n")) / F.sum(weight)).alias("mean"), *hits)
    top = _ranked(groups.drop("v"), columns, k).groupBy("position").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "value", "n", "d1", "d2", *[f"o{i}" for i in range(ORDER)]))).alias("top"))
    return sums.join(top, "position", "left")


def _deviations(df: DataFrame, columns: list[Measured]) -> dict[int, float | None]:
    """Sample standard deviation of each numeric column, from its rows; None below two numbers."""
    numeric = [c for c in columns if is_numeric(c.dtype)]
    out = {}
    for at in range(0, len(numeric), COLUMNS_PER_PASS):
        part = numeric[at:at + COLUMNS_PER_PASS]
        number = [(nan_to_null(c.raw, c.dtype) if is_floating(c.dtype) else c.raw).cast("double") for c in part]
        row = df.agg(*[F.stddev_samp(x).alias(f"s{c.position}") for c, x in zip(part, number)]).first()
        out.update({c.position: row[f"s{c.position}"] for c in part})
    return out


def _same(value, other) -> bool:
    return value["n"] == other["n"] and all(value[f"o{i}"] == other[f"o{i}"] for i in range(ORDER))


def _tied(df: DataFrame, column: Measured, rank: dict, unique: bool, k: int) -> list[str]:
    """The k least texts among the values of a column that occur as often, and begin, as the one at the cut."""
    rows = df.select(column.text.alias("value")).where(F.col("value").isNotNull())
    if unique:
        return [r.value for r in rows.orderBy("value").limit(k).collect()]
    same = [o == F.lit(rank[f"o{i}"]) for i, o in enumerate(text_order(F.col("value")))]
    d1, d2 = text_digest(F.col("value"))
    alike = (rows.where(functools.reduce(Column.__and__, same)).groupBy(d1.alias("d1"), d2.alias("d2"))
             .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value")).where(F.col("n") == rank["n"]))
    return [r.value for r in alike.orderBy("value").limit(k).collect()]


def _texts(df: DataFrame, columns: list[Measured], wanted: dict[int, list[tuple[int, int]]]) -> dict[int, tuple]:
    """The second scan: by column least and greatest value, and the texts of the wanted digests."""
    out = {}
    for at in range(0, len(columns), COLUMNS_PER_PASS):
        part = columns[at:at + COLUMNS_PER_PASS]
        cells, aggs = [], []
        for c in part:
            n = c.position
            d1, d2 = text_digest(F.col(f"t{n}"))
            cells += [c.raw.alias(f"c{n}"), c.text.alias(f"t{n}")]
            extreme = F.lit(None).cast("string") if is_nested(c.dtype) else F.col(f"c{n}")
            low, high = (value_text(e, c.dtype) if not is_nested(c.dtype) else e for e in (F.min(extreme), F.max(extreme)))
            aggs += [low.alias(f"lo{n}"), high.alias(f"hi{n}")]
            aggs += [F.max(F.when((F.col(f"d{n}") == a) & (F.col(f"e{n}") == b), F.col(f"t{n}"))).alias(f"w{n}_{i}")
                     for i, (a, b) in enumerate(wanted.get(n, ()))]
        flat = df.select(*cells)
        flat = flat.select("*", *[d.alias(f"{name}{c.position}") for c in part
                                  for name, d in zip("de", text_digest(F.col(f"t{c.position}")))])
        row = flat.agg(*aggs).first()
        for c in part:
            n = c.position
            out[n] = (row[f"lo{n}"], row[f"hi{n}"], [row[f"w{n}_{i}"] for i in range(len(wanted.get(n, ())))])
    return out


def _columns(df: DataFrame, columns: list[Measured], k: int) -> list[dict]:
    """Statistics of each column as one dictionary a column; what reaches the driver is k values of each."""
    found = {r["position"]: r.asDict(recursive=True) for r in _statistics(value_groups(df, columns), columns, k).collect()}
    digested = [c for c in columns if c.by_digest]
    wanted, tied = {}, {}
    for c in digested:
        top = (found.get(c.position) or {}).get("top") or []
        cut = k
        if len(top) > k and _same(top[k - 1], top[k]):
            # More values than are wanted stand level as far as their order is known: they are told apart by their texts.
            cut = next(i for i, t in enumerate(top) if _same(t, top[k]))
            facts = found[c.position]
            tied[c.position] = _tied(df, c, top[k], facts["distinct"] == facts["present"], k - cut)
        wanted[c.position] = [(t["d1"], t["d2"]) for t in top[:cut]]
    texts = _texts(df, digested, wanted) if digested and found else {}
    out = []
    for c in columns:
        facts = found.get(c.position) or {}
        top = facts.get("top") or []
        if c.by_digest:
            low, high, values = texts.get(c.position, (None, None, []))
            pairs = list(zip(values, [t["n"] for t in top])) + [(v, top[k]["n"]) for v in tied.get(c.position, ())]
        else:
            low, high = facts.get("d_lo"), facts.get("d_hi")
            pairs = [(t["value"], t["n"]) for t in top[:k]]
        pairs = sorted(pairs, key=lambda p: (-p[1], p[0].encode()))[:k]
        out.append({"column": c, "facts": facts, "low": low, "high": high, "top": pairs})
    return out


def frequent_values(df: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """(position, value, n, rank): the k most frequent values of each column, ties by value."""
    rows = [(one["column"].position, value, n, rank) for one in _columns(df, measured(df), k)
            for rank, (value, n) in enumerate(one["top"], 1)]
    return df.sparkSession.createDataFrame(rows, "position int, value string, n long, rank int")


def _pattern(c: Measured, facts: dict, rows: int) -> str | None:
    present = facts.get("present") or 0
    if isinstance(c.dtype, T.IntegralType):
        return "integer_id" if facts.get("distinct", 0) == present else None
    if isinstance(c.dtype, T.StringType) and present:
        return next((name for i, name in enumerate(NAMED_PATTERNS) if (facts[f"p{i}"] or 0) / present >= PATTERN_MATCH_SHARE), None)
    return None


def profile_columns(df: DataFrame, table: str = "") -> DataFrame:
    """One row per column of `df`, computed now."""
    rows = []
    spark = df.sparkSession
    deviations = _deviations(df, measured(df))
    for one in _columns(df, measured(df), TOP_VALUES):
        c, facts = one["column"], one["facts"]
        n, present, distinct = (facts.get(x) or 0 for x in ("rows", "present", "distinct"))
        lo = hi = mean = dev = None
        if is_numeric(c.dtype) and facts.get("numbers"):
            lo, hi, mean = facts["lo"], facts["hi"], facts["mean"]
            dev = deviations[c.position] if facts["numbers"] > 1 else 0.0
        rows.append((
            table, c.position, c.name, c.dtype.simpleString(), n, n - present, (n - present) / n if n else 0.0, distinct,
            distinct / n if n else 0.0, lo, hi, mean, dev, one["low"] if c.by_digest else None, one["high"] if c.by_digest else None,
            one["top"], _pattern(c, facts, n), n > 0 and distinct == n and present == n, None if c.by_digest else one["low"],
            None if c.by_digest else one["high"]))
    out = spark.createDataFrame(rows, T.StructType([*PROFILE.fields, T.StructField("d_lo", T.LongType()), T.StructField("d_hi", T.LongType())]))
    lo_text, hi_text = F.col("min_text"), F.col("max_text")
    for c in measured(df):
        here = F.col("position") == c.position
        if is_numeric(c.dtype):
            lo_text = F.when(here, F.col("min_value").cast("string")).otherwise(lo_text)
            hi_text = F.when(here, F.col("max_value").cast("string")).otherwise(hi_text)
        elif not c.by_digest:
            lo_text = F.when(here, c.written(F.col("d_lo"), F.lit(None).cast("double"))).otherwise(lo_text)
            hi_text = F.when(here, c.written(F.col("d_hi"), F.lit(None).cast("double"))).otherwise(hi_text)
    return local_copy(out.withColumns({"min_text": lo_text, "max_text": hi_text}).drop("d_lo", "d_hi"))[0]


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.when(whole > 0, whole), F.lit(0.0))


def is_candidate_key(rows: Column, distinct: Column, nulls: Column) -> Column:
    return (rows > 0) & (distinct == rows) & (nulls == 0)


def candidate_grain(profile: DataFrame) -> DataFrame:
    """(table, row_count, candidate_grain): single columns that identify a row, in column order."""
    keys = F.collect_list(F.when(F.col("is_candidate_key"), F.struct("position", "column")))
    return profile.groupBy("table_fq_name").agg(
        F.max("row_count").alias("row_count"),
        F.transform(F.array_sort(keys), lambda k: k["column"]).alias("candidate_grain"))


def profile_table(df: DataFrame, table: str = "", sample_rows: int | None = None,
                  order_by: list[str] | None = None) -> DataFrame:
    """Profile the whole table, or its first `sample_rows` rows, which are the same in both scans."""
    return profile_columns(cut_lineage(head_sample(df, sample_rows, order_by)) if sample_rows else df, table)
