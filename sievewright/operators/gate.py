"""Gate decisions and the split of data they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def is_critical_failure(error_blocks: bool = False) -> Column:
    failed = F.col("status") == "fail"
    if error_blocks:
        failed = F.col("status").isin("fail", "error")
    return (F.col("severity") == "critical") & failed


def is_problem() -> Column:
    return F.col("status").isin("fail", "warn")


def reason_text(prefix: Column) -> Column:
    return F.concat(prefix, F.lit(": "), F.coalesce("column", F.lit("None")), F.lit(" "),
                    F.col("rule_type"), F.lit(" — "), F.col("message"))


def issues_minus_critical(results: DataFrame, error_blocks: bool = False) -> DataFrame:
    return results.filter(is_problem() & ~is_critical_failure(error_blocks))


def gate(results: DataFrame, error_blocks: bool = False) -> DataFrame:
    """(table, batch, decision, reasons). BLOCK lists the critical failures only.

    ERROR results do not block unless `error_blocks` is set.
    """
    critical = is_critical_failure(error_blocks)
    blocking = F.collect_list(F.when(critical, F.struct(
        "rule_id", reason_text(F.lit("CRITICAL FAIL")).alias("reason"))))
    others = F.collect_list(F.when(is_problem() & ~critical, F.struct(
        "rule_id", reason_text(F.upper("status")).alias("reason"))))
    grouped = results.groupBy("table_fq_name", "batch_id").agg(
        blocking.alias("blocking"), others.alias("others"))
    decision = (F.when(F.size("blocking") > 0, "block")
                .when(F.size("others") > 0, "pass_with_warnings").otherwise("pass"))
    listed = F.when(F.size("blocking") > 0, F.col("blocking")).otherwise(F.col("others"))
    return grouped.select("table_fq_name", "batch_id", decision.alias("decision"),
                          F.transform(F.array_sort(listed), lambda r: r["reason"]).alias("reasons"))


def released(df: DataFrame, decisions: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Rows of batches that may flow on."""
    return df.join(_blocked(decisions, batch_col), batch_col, "left_anti")


def held(df: DataFrame, decisions: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Rows of blocked batches, whole batches at a time."""
    return df.join(_blocked(decisions, batch_col), batch_col, "left_semi")


def _blocked(decisions: DataFrame, batch_col: str) -> DataFrame:
    """Blocked batches, one row each; written out first, so their size is known and the data need not be shuffled."""
    return cut_lineage(decisions.filter(F.col("decision") == "block").select(F.col("batch_id").alias(batch_col)).distinct())
