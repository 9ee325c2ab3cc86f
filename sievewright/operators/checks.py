"""Rule compiler and check evaluation.

All row-level rules of a table become one aggregate over one scan. Uniqueness and
referential rules share one shuffle of (rule, digest of the value) groups, counted in
each task first, so a value that fills a third of the table crosses the network once
per task and a text never does. All reference keys are one table of digests beside them.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import (
    above, below, family, is_missing, nan_to_null, of_type, pattern_text, to_number, to_timestamp, value_text,
)
from ..functions.names import decimals, percent, percent_literal
from ..functions.patterns import NAMED_PATTERNS, matches
from ..schemas import CHECK_RESULTS, RULE_TYPES, Rule
from ..session import cut_lineage, local_copy

# Width of the warning zone on the failing side of a threshold.
WARN_BUFFER = 0.15
WARN_FLOOR = 0.01
# Fixed value: violating values kept per result.
SAMPLE_SIZE = 10
# Rules per aggregate, so that the generated code stays small.
RULES_PER_PASS = 100

# Number of the measure that is the number of rows.
ROWS = -1

Resolver = Callable[[str], DataFrame]


def check_status(metric: Column, threshold: Column, higher_is_better: Column) -> Column:
    """pass / warn / fail; the warning zone starts at the threshold. NaN fails."""
    buffer = F.greatest(threshold, F.lit(WARN_FLOOR)) * WARN_BUFFER
    upward = (F.when(metric >= threshold, "pass").when(metric >= threshold - buffer, "warn")
              .otherwise("fail"))
    downward = (F.when(metric <= threshold, "pass").when(metric <= threshold + buffer, "warn")
                .otherwise("fail"))
    return (F.when(metric.isNull(), "error").when(F.isnan(metric), "fail")
            .when(higher_is_better, upward).otherwise(downward))


def field(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@contextlib.contextmanager
def lenient_sql(spark: SparkSession):
    """Resolve user predicates so that bad arithmetic yields NULL and not a failed job."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@dataclass
class _RowCheck:
    """A rule answered by the fused aggregate."""

    rule: Rule
    pos: int
    total: Column
    hits: Column
    violation: Column | None  # text of a violating row, else NULL
    note: str = ""


@dataclass
class _ValueCheck:
    """A rule that groups the values of its column by digest."""

    rule: Rule
    pos: int
    digest: tuple[Column, Column]
    shown: Column  # text of the value
    keys: DataFrame | None = None  # digests (d1, d2) of the reference; None for uniqueness
    source: tuple = ()  # rules of equal source share their keys
    note: str = ""


def _as(c: Column, dtype: T.DataType, common: T.DataType) -> Column:
    return (c.cast("int") if isinstance(dtype, T.BooleanType) else c).cast(common)


@dataclass
class _Broken:
    rule: Rule
    pos: int
    reason: str


def _first_line(exc: Exception) -> str:
    text = exc.getMessage() if isinstance(exc, PySparkException) and exc.getMessage() else str(exc)
    return text.strip().splitlines()[0] if text.strip() else type(exc).__name__


def _regex_error(spark: SparkSession, regex: str) -> str | None:
    try:
        spark.sql("select rlike('', :r)", args={"r": regex}).collect()
        return None
    except PySparkException as exc:
        return _first_line(exc)


def predicate_column(df: DataFrame, expression: str) -> Column:
    """A row is valid where the Spark SQL expression is true; NULL counts as a violation."""
    with lenient_sql(df.sparkSession):
        typed = df.withColumn("__p", F.expr(expression)).schema["__p"].dataType
        if not isinstance(typed, (T.BooleanType, T.NullType)):
            raise ValueError(f"'{expression}' is {typed.simpleString()}, not a boolean")
        valid = F.coalesce(F.expr(expression).cast("boolean"), F.lit(False))
        # As it will be used, beside the row's columns: aggregates and generators fail here, for this rule alone.
        return valid if df.withColumn("__p", valid).schema else valid


def reference_keys(ref: DataFrame, column: str) -> DataFrame:
    """Distinct non-missing values of a reference column, as `ref`."""
    dtype = ref.schema[column].dataType
    return (ref.select(nan_to_null(field(column), dtype).alias("ref"))
            .filter(F.col("ref").isNotNull()).distinct())


def value_digest(c: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """Two whole numbers per distinct value: the value itself if it is whole, else 128 bits of hash. Null for missing ones."""
    if isinstance(dtype, T.IntegralType):
        return c.cast("long"), F.when(c.isNotNull(), F.lit(0).cast("long"))
    text = value_text(c, dtype)
    return F.when(text.isNotNull(), F.xxhash64(text)), F.when(text.isNotNull(), F.xxhash64(F.lit("second"), text))


class CheckPlan:
    """The compiled rules of one table, over one DataFrame."""

    def __init__(self, df: DataFrame, rules: list[Rule], *, batch_col: str | None = None,
                 resolve: Resolver | None = None, as_of: Column | None = None, count_rows: bool = False):
        self.count_rows = count_rows
        self.spark = df.sparkSession
        self.df = df
        self.batch_col = batch_col
        self.resolve = resolve
        self.as_of = as_of if as_of is not None else F.current_timestamp()
        self.rules = list(rules)
        self._ref_cache: dict[tuple[str, str], DataFrame | None] = {}
        self._predicates: dict[str, Column] = {}
        self.row_checks: list[_RowCheck] = []
        self.unique_checks: list[_ValueCheck] = []
        self.ref_checks: list[_ValueCheck] = []
        self.broken: list[_Broken] = []
        for pos, rule in enumerate(self.rules):
            try:
                self._compile(pos, rule)
            except (AnalysisException, ValueError) as exc:
                self.broken.append(_Broken(rule, pos, f"Check errored: {_first_line(exc)}"))
        # Predicates are resolved here, while lenient_sql holds.
        if self._predicates:
            with lenient_sql(self.spark):
                self.df = self.df.withColumns(self._predicates)

    # -- compile ---------------------------------------------------------
    def _compile(self, pos: int, rule: Rule) -> None:
        if rule.rule_type not in RULE_TYPES:
            self.broken.append(_Broken(rule, pos, f"Unknown rule_type {rule.rule_type}"))
            return
        if rule.rule_type == "custom_sql":
            self._compile_custom(pos, rule)
            return
        if rule.column not in self.df.columns:
            raise ValueError(f"column '{rule.column}' not found")
        c, dtype = field(rule.column), self.df.schema[rule.column].dataType
        if rule.rule_type == "completeness":
            self._row(pos, rule, F.count(F.lit(1)), F.count_if(is_missing(c, dtype)), None)
        elif rule.rule_type == "range":
            x = to_number(c, dtype)
            lo, hi = rule.params.get("min"), rule.params.get("max")
            bad = F.lit(False)
            if lo is not None:
                bad = bad | below(c, dtype, lo)
            if hi is not None:
                bad = bad | above(c, dtype, hi)
            shown = c.cast("string") if not isinstance(dtype, T.StringType) else x.cast("string")
            self._row(pos, rule, F.count(x), F.count_if(bad), F.when(bad, shown))
        elif rule.rule_type == "pattern":
            self._compile_pattern(pos, rule, c, dtype)
        elif rule.rule_type == "freshness":
            latest = F.max(to_timestamp(c, dtype))
            self._row(pos, rule, F.count(to_timestamp(c, dtype)), latest, None)
        elif rule.rule_type == "uniqueness":
            self.unique_checks.append(_ValueCheck(rule, pos, value_digest(c, dtype), value_text(c, dtype)))
        else:
            self._compile_reference(pos, rule, c, dtype)

    def _row(self, pos, rule, total, hits, violation) -> None:
        self.row_checks.append(_RowCheck(rule, pos, total, hits, violation))

    def _compile_pattern(self, pos, rule, c, dtype) -> None:
        text = pattern_text(c, dtype)
        regex = rule.params.get("regex") or NAMED_PATTERNS.get(rule.params.get("pattern_name") or "")
        if regex is None:
            self._row(pos, rule, F.count(text), F.lit(None).cast("long"), None)
            return
        if rule.params.get("regex"):
            problem = _regex_error(self.spark, regex)
            if problem:
                raise ValueError(problem)
        good = matches(text, regex)
        self._row(pos, rule, F.count(text), F.count_if(good), F.when(~good, text))

    def _compile_custom(self, pos, rule) -> None:
        expression = rule.params.get("valid_expr")
        if not expression:
            raise ValueError(f"No 'valid_expr' configured for custom rule {rule.rule_id}")
        name = f"__valid_{pos}"
        self._predicates[name] = predicate_column(self.df, expression)
        ok = F.col(name)
        record = F.to_json(F.struct(*[field(c) for c in self.df.columns if c != self.batch_col]))
        self._row(pos, rule, F.count(F.lit(1)), F.count_if(~ok), F.when(~ok, record))

    def _compile_reference(self, pos, rule, c, dtype) -> None:
        keys, note = self._load_reference(rule)
        if keys is None:
            # A list is a reference like any other, in the column's own type.
            values = of_type(rule.params.get("ref_values") or [], dtype)
            keys = self.spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("ref", dtype)]))
            source = (pos,)
        else:
            source = (rule.params["ref_table"], rule.params["ref_column"])
            if family(keys.schema["ref"].dataType) != family(dtype):
                keys = keys.filter(F.lit(False)).select(F.lit(None).cast(dtype).alias("ref"))
                source = (pos,)
        theirs = keys.schema["ref"].dataType
        common = self._common_type(dtype, theirs)
        digest = value_digest(_as(nan_to_null(c, dtype), dtype, common), common)
        refs = value_digest(_as(nan_to_null(F.col("ref"), theirs), theirs, common), common)
        keys = keys.select(refs[0].alias("d1"), refs[1].alias("d2")).filter(F.col("d1").isNotNull())
        self.ref_checks.append(_ValueCheck(rule, pos, digest, value_text(nan_to_null(c, dtype), dtype), keys,
                                           (*source, common.simpleString()), note))

    def _common_type(self, one: T.DataType, other: T.DataType) -> T.DataType:
        """The type in which values of the two are compared; truth values count as whole numbers."""
        one, other = (T.LongType() if isinstance(t, (T.IntegralType, T.BooleanType)) else t for t in (one, other))
        if one == other:
            return one
        both = F.coalesce(F.lit(None).cast(one), F.lit(None).cast(other))
        return self.spark.range(1).select(both.alias("v")).schema["v"].dataType

    def _load_reference(self, rule: Rule) -> tuple[DataFrame | None, str]:
        table, column = rule.params.get("ref_table"), rule.params.get("ref_column")
        if not table or not column:
            note = "" if rule.params.get("ref_values") else " (no reference configured)"
            return None, note
        if (table, column) not in self._ref_cache:
            keys = None
            if self.resolve is not None:
                with contextlib.suppress(AnalysisException, ValueError, KeyError):
                    keys = reference_keys(self.resolve(table), column)
            self._ref_cache[table, column] = keys
        keys = self._ref_cache[table, column]
        return keys, "" if keys is not None else f" (reference {table}.{column} could not be loaded)"

    # -- measures --------------------------------------------------------
    def _batch(self) -> list[Column]:
        return [field(self.batch_col).cast("string").alias("batch_id")] if self.batch_col else []

    def _keys(self) -> list[str]:
        return ["batch_id"] if self.batch_col else []

    def _measured(self, check, total: Column, hits: Column) -> Column:
        """struct(pos, total, hits, metric, message, error) of one rule."""
        rule = check.rule
        limit = percent_literal(rule.threshold)
        share = hits.cast("double") / F.when(total > 0, total)
        empty = None
        error = F.lit(None).cast("string")
        if rule.rule_type == "completeness":
            metric = F.coalesce(share, F.lit(0.0))
            message = F.concat(F.lit("Null rate "), percent(metric), F.lit(f" (max allowed {limit})"))
        elif rule.rule_type == "uniqueness":
            metric = F.coalesce(share, F.lit(1.0))
            message = F.concat(F.lit("Distinct rate "), percent(metric), F.lit(f" (min required {limit})"))
        elif rule.rule_type == "range":
            metric, empty = F.coalesce(share, F.lit(0.0)), "No non-null numeric values to check"
            lo, hi = rule.params.get("min"), rule.params.get("max")
            message = F.concat(percent(metric), F.lit(f" of values outside [{lo}, {hi}]"))
        elif rule.rule_type == "pattern":
            metric, empty = F.coalesce(share, F.lit(1.0)), "No non-null values to check"
            message = F.concat(percent(metric), F.lit(f" matched pattern (min required {limit})"))
            if not rule.params.get("regex") and rule.params.get("pattern_name") not in NAMED_PATTERNS:
                error = F.when(total > 0, F.lit(
                    f"Check errored: No regex/pattern_name configured for rule {rule.rule_id}"))
        elif rule.rule_type == "freshness":
            age = (F.unix_micros(self.as_of) - F.unix_micros(hits)) / F.lit(3.6e9)
            metric, empty = F.coalesce(age, F.lit(float("inf"))), "No valid timestamps found"
            message = F.concat(F.lit(f"Most recent {rule.column} is "), decimals(metric, 1),
                               F.lit(f"h old (max allowed {rule.threshold}h)"))
        elif rule.rule_type == "referential":
            metric, empty = F.coalesce(share, F.lit(0.0)), "No non-null values to check"
            message = F.concat(percent(metric), F.lit(" of values not found in reference set"),
                               F.lit(check.note))
        else:
            metric = F.coalesce(share, F.lit(0.0))
            message = F.concat(percent(metric),
                               F.lit(f" of rows violate '{rule.params.get('valid_expr')}'"))
        if empty:
            message = F.when(total > 0, message).otherwise(F.lit(empty))
        violating = total - hits if rule.rule_type in ("pattern", "uniqueness") else hits
        if rule.rule_type == "freshness":
            violating = F.lit(0)
        return F.struct(
            F.lit(check.pos).alias("pos"),
            total.cast("long").alias("total"),
            F.coalesce(violating.cast("long"), F.lit(0).cast("long")).alias("violations"),
            F.when(error.isNull(), metric).alias("metric_value"),
            F.coalesce(error, message).alias("message"),
        )

    def _row_measures(self) -> list[DataFrame]:
        frames = []
        for start in range(0, len(self.row_checks) or int(self.count_rows), RULES_PER_PASS):
            part = self.row_checks[start:start + RULES_PER_PASS]
            aggs = [F.count(F.lit(1)).alias("rows")]
            for check in part:
                aggs.append(check.total.alias(f"t{check.pos}"))
                aggs.append(check.hits.alias(f"h{check.pos}"))
            wide = self.df.groupBy(*self._batch()).agg(*aggs)
            structs = [self._measured(c, F.col(f"t{c.pos}"), F.col(f"h{c.pos}")) for c in part]
            if self.count_rows and not start:
                structs.append(F.struct(F.lit(ROWS).alias("pos"), F.col("rows").alias("total"), F.lit(0).cast("long").alias("violations"),
                                        F.lit(None).cast("double").alias("metric_value"), F.lit("").alias("message")))
            frames.append(wide.select(*self._keys(), F.inline(F.array(*structs))))
        return frames

    def _value_groups(self) -> DataFrame:
        """(batch, pos, d1, d2, n): rows by rule and value, in one shuffle for all uniqueness and referential rules."""
        cells = [F.struct(F.lit(c.pos).alias("pos"), c.digest[0].alias("d1"), c.digest[1].alias("d2"))
                 for c in (*self.unique_checks, *self.ref_checks)]
        return (self.df.select(*self._batch(), F.inline(F.array(*cells)))
                .groupBy(*self._keys(), "pos", "d1", "d2").agg(F.count(F.lit(1)).alias("n")))

    def _references(self) -> tuple[DataFrame, dict[int, int]]:
        """All reference keys (part, d1, d2), written once so that their size is known, and the part of each rule."""
        parts = {source: i for i, source in enumerate(dict.fromkeys(c.source for c in self.ref_checks))}
        tables = {c.source: c.keys.select(F.lit(parts[c.source]).alias("part"), "d1", "d2") for c in self.ref_checks}
        keys = functools.reduce(DataFrame.unionByName, tables.values()).distinct()
        return keys, {c.pos: parts[c.source] for c in self.ref_checks}

    def _value_judged(self) -> DataFrame:
        """The groups with what is wrong with each: a repeated value, or one that is not in its reference."""
        groups = self._value_groups()
        live, bad = F.col("d1").isNotNull(), F.lit(False)
        if self.unique_checks:
            bad = F.col("pos").isin([c.pos for c in self.unique_checks]) & live & (F.col("n") > 1)
        if self.ref_checks:
            keys, parts = self._references()
            part = F.lit(None).cast("int")
            for pos, number in parts.items():
                part = F.when(F.col("pos") == pos, F.lit(number)).otherwise(part)
            keys = keys.withColumnsRenamed({"part": "__part", "d1": "__d1", "d2": "__d2"}).withColumn("found", F.lit(True))
            groups = groups.withColumn("part", part).join(
                keys, (F.col("part") == F.col("__part")) & (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2")), "left")
            bad = bad | (F.col("pos").isin(list(parts)) & live & F.col("found").isNull())
        return groups.withColumn("bad", bad).select(*self._keys(), "pos", "d1", "d2", "n", "bad")

    def _value_measures(self) -> list[DataFrame]:
        """One row per batch with the counts of all rules, so an empty table has results too."""
        if not (self.unique_checks or self.ref_checks):
            return []
        aggs, cells = [], []
        for check in (*self.unique_checks, *self.ref_checks):
            mine = (F.col("pos") == check.pos) & F.col("d1").isNotNull()
            hits = (F.count_if(mine) if check.keys is None else F.coalesce(F.sum(F.when(mine & F.col("bad"), F.col("n"))), F.lit(0)))
            aggs += [F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias(f"t{check.pos}"), hits.alias(f"h{check.pos}")]
            cells.append(self._measured(check, F.col(f"t{check.pos}"), F.col(f"h{check.pos}")))
        wide = self._value_judged().groupBy(*self._keys()).agg(*aggs)
        return [wide.select(*self._keys(), F.inline(F.array(*cells)))]

    def _value_samples(self, wanted: list[_ValueCheck]) -> DataFrame:
        """(batch, pos, value): texts of the violating values of some rules, each once. Only they are looked up."""
        # The filter involves `n`, so it stays above the grouping, whose shuffle the measures read as well.
        mine = F.when(F.col("bad") & F.col("pos").isin([c.pos for c in wanted]), F.col("n")) > 0
        bad = self._value_judged().filter(mine).select(*self._keys(), "pos", "d1", "d2")
        keys = [*self._keys(), "pos", "d1", "d2"]
        bad = bad.withColumnsRenamed({k: f"__{k}" for k in keys})
        # Null-safe: a batch may lack a name, and no filter for nulls reaches the grouping.
        same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        cells = [F.struct(F.lit(c.pos).alias("pos"), c.digest[0].alias("d1"), c.digest[1].alias("d2"), c.shown.alias("value")) for c in wanted]
        return (self.df.select(*self._batch(), F.inline(F.array(*cells))).join(bad, same, "left_semi")
                .groupBy(*self._keys(), "pos", "d1", "d2").agg(F.min("value").alias("value")).select(*self._keys(), "pos", "value"))

    def _broken_measures(self) -> list[DataFrame]:
        if not self.broken:
            return []
        cells = [
            F.struct(F.lit(b.pos).alias("pos"), F.lit(0).cast("long").alias("total"),
                     F.lit(0).cast("long").alias("violations"),
                     F.lit(None).cast("double").alias("metric_value"), F.lit(b.reason).alias("message"))
            for b in self.broken
        ]
        if self.batch_col:
            base = self.df.select(*self._batch()).distinct()
        else:
            base = self.spark.range(1).select()
        return [base.select(*self._keys(), F.inline(F.array(*cells)))]

    def measures(self) -> DataFrame:
        """(batch, pos, total, violations, metric_value, message), one row per batch and rule."""
        frames = self._row_measures() + self._value_measures() + self._broken_measures()
        if not frames:
            cols = ", ".join([*(["batch_id string"] if self.batch_col else []),
                              "pos int, total long, violations long, metric_value double, message string"])
            return self.spark.createDataFrame([], cols)
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    # -- samples ---------------------------------------------------------
    def samples(self, only: set[str] | None = None) -> DataFrame:
        """(batch, pos, sample_violations): at most ten violating values per rule, by value.

        Each task ranks its own rows first, so no more than ten per rule and task are shuffled.
        """
        def wanted(check) -> bool:
            return only is None or check.rule.rule_id in only

        frames = []
        rows = [c for c in self.row_checks if c.violation is not None and wanted(c)]
        if rows:
            cells = F.array(*[F.struct(F.lit(c.pos).alias("pos"), c.violation.alias("value")) for c in rows])
            frames.append(self.df.select(*self._batch(), F.inline(cells)).filter(F.col("value").isNotNull()))
        values = [c for c in (*self.unique_checks, *self.ref_checks) if wanted(c)]
        if values:
            frames.append(self._value_samples(values))
        if not frames:
            cols = ", ".join([*(["batch_id string"] if self.batch_col else []),
                              "pos int, sample_violations array<string>"])
            return self.spark.createDataFrame([], cols)
        found = frames[0]
        for frame in frames[1:]:
            found = found.unionByName(frame)
        ranked = found.withColumn("rank", F.row_number().over(
            Window.partitionBy(*self._keys(), "pos").orderBy("value")))
        return (ranked.filter(F.col("rank") <= SAMPLE_SIZE)
                .groupBy(*self._keys(), "pos")
                .agg(F.array_sort(F.collect_list("value")).alias("sample_violations")))

    # -- results ---------------------------------------------------------
    def _rule_record(self) -> Column:
        """Attributes of the rule at `pos`; a folded literal, no join."""
        cells = [
            F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.table_fq_name).alias("table_fq_name"),
                     F.lit(r.column).cast("string").alias("column"), F.lit(r.rule_type).alias("rule_type"),
                     F.lit(float(r.threshold)).alias("threshold"), F.lit(r.severity).alias("severity"),
                     F.lit(r.higher_is_better).alias("higher"))
            for r in self.rules
        ]
        return F.element_at(F.array(*cells), F.col("pos") + 1)

    def results(self, measures: DataFrame | None = None, samples: DataFrame | None = None,
                *, batch_id: str | None = None, seq: int | Column = 0) -> DataFrame:
        """check_results rows from measures and, if given, samples."""
        measures = self.measures() if measures is None else measures
        if not self.rules:
            return self.spark.createDataFrame([], CHECK_RESULTS)
        long = measures
        if samples is not None:
            found = samples.withColumnsRenamed({"pos": "__pos", "batch_id": "__batch"})
            same = F.col("pos") == F.col("__pos")
            if self.batch_col:
                # Null-safe: a batch may lack a name, and no filter on it reaches one side only,
                # so both sides go on sharing their shuffles.
                same = same & F.col("batch_id").eqNullSafe(F.col("__batch"))
            long = long.join(found, same, "left")
        else:
            long = long.withColumn("sample_violations", F.lit(None).cast("array<string>"))
        long = long.withColumn("rule", self._rule_record())
        batch = F.col("batch_id") if self.batch_col else F.lit(batch_id or "batch").alias("batch_id")
        return long.select(
            batch, (F.lit(seq) if isinstance(seq, int) else seq).cast("long").alias("seq"),
            "rule.rule_id", "rule.table_fq_name", "rule.column", "rule.rule_type",
            check_status(F.col("metric_value"), F.col("rule.threshold"), F.col("rule.higher")).alias("status"),
            "metric_value", "rule.threshold", "rule.severity", "message",
            F.coalesce("sample_violations", F.array().cast("array<string>")).alias("sample_violations"),
            (F.unix_micros(self.as_of) / F.lit(1e6)).alias("checked_at"),
        )


def evaluate(df: DataFrame, rules: list[Rule], *, batch_id: str | None = None,
             batch_col: str | None = None, resolve: Resolver | None = None,
             as_of: Column | None = None, seq: int | Column = 0, samples: bool = True) -> DataFrame:
    """Run rules on a table, or on every batch of it when `batch_col` names one."""
    plan = CheckPlan(df, rules, batch_col=batch_col, resolve=resolve, as_of=as_of)
    return plan.results(samples=plan.samples() if samples else None, batch_id=batch_id, seq=seq)


def run_checks(df: DataFrame, rules: list[Rule], **kwargs) -> DataFrame:
    """Evaluate now and keep the results in the shared folder."""
    return run_and_count(df, rules, **kwargs)[0]


def run_and_count(df: DataFrame, rules: list[Rule], **kwargs) -> tuple[DataFrame, int]:
    """`run_checks`, and the number of rows, which the checks count on the way.

    If a predicate fails while the job runs, each custom rule is tried alone and the
    ones that fail become ERROR rows, so one bad rule never takes the others with it.
    """
    options = {k: kwargs.pop(k) for k in ("batch_id", "seq") if k in kwargs}

    def keep(frame: DataFrame) -> DataFrame:
        # Without a batch column there is one row per rule.
        return cut_lineage(frame) if kwargs.get("batch_col") else local_copy(frame)[0]

    def attempt(chosen: list[Rule]) -> tuple[DataFrame, int]:
        plan = CheckPlan(df, chosen, count_rows=True, **kwargs)
        everything = keep(plan.measures())
        rows = everything.filter(F.col("pos") == ROWS).agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        measured = everything.filter(F.col("pos") != ROWS)
        # Ids of rules, not data: only these need a second look at the rows.
        dirty = {chosen[r.pos].rule_id
                 for r in measured.filter("violations > 0").select("pos").distinct().collect()}
        samples = plan.samples(dirty) if dirty else None
        return keep(plan.results(measured, samples, **options)), rows

    try:
        return attempt(rules)
    except PySparkException:
        custom = [r for r in rules if r.rule_type == "custom_sql"]
        if not custom:
            raise
    failed: dict[str, str] = {}
    for rule in custom:
        try:
            keep(CheckPlan(df, [rule], **kwargs).measures())
        except PySparkException as exc:
            failed[rule.rule_id] = _first_line(exc)
    if not failed:
        raise RuntimeError("checks failed for a reason outside the custom predicates")
    good, rows = attempt([r for r in rules if r.rule_id not in failed])
    broken = CheckPlan(df, [], **{k: v for k, v in kwargs.items()})
    broken.rules = [r for r in custom if r.rule_id in failed]
    broken.broken = [_Broken(r, i, f"Check errored: {failed[r.rule_id]}")
                     for i, r in enumerate(broken.rules)]
    return good.unionByName(broken.results(**options)), rows
