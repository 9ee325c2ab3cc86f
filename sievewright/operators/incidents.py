"""Incidents and tickets derived from check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import stable_id
from .gate import is_problem


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 2).when(severity == "warn", 1).otherwise(0)


def worst_result(results: DataFrame) -> DataFrame:
    """The gravest problem of each batch: severity, then FAIL over WARN, then the first rule."""
    order = F.struct(-severity_rank(F.col("severity")), F.when(F.col("status") == "fail", 0).otherwise(1),
                     F.col("rule_id"))
    keep = [c for c in results.columns if c not in ("table_fq_name", "batch_id")]
    return (results.filter(is_problem()).groupBy("table_fq_name", "batch_id")
            .agg(F.min_by(F.struct(*keep), order).alias("w")).select("table_fq_name", "batch_id", "w.*"))


def rule_key(rule_ids: Column) -> Column:
    """Equal for equal sets of rule ids."""
    return F.array_join(F.array_sort(F.array_distinct(rule_ids)), ",")


def incidents(results: DataFrame) -> DataFrame:
    """One row per batch with problems."""
    order = F.struct(-severity_rank(F.col("severity")), F.when(F.col("status") == "fail", 0).otherwise(1),
                     F.col("rule_id"))
    return results.filter(is_problem()).groupBy("table_fq_name", "batch_id").agg(
        F.max("seq").alias("seq"),
        F.count(F.lit(1)).alias("problems"),
        F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"),
        F.min_by("rule_id", order).alias("worst_rule_id"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


def tables_named(results: DataFrame, by: list[str]) -> DataFrame:
    """Sorted distinct table names, as the fallback title lists them."""
    return results.filter(is_problem()).groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_set("table_fq_name")), ", ").alias("tables"))


def match_open(found: DataFrame, tickets: DataFrame) -> DataFrame:
    """Incidents that an OPEN ticket with the same table and rule set already covers."""
    return found.withColumn("rule_key", rule_key(F.col("rule_ids"))).join(
        _open_keys(tickets), ["table_fq_name", "rule_key"])


def _open_keys(tickets: DataFrame) -> DataFrame:
    return (tickets.filter(F.col("status") == "open")
            .groupBy("table_fq_name", rule_key(F.col("check_results")).alias("rule_key"))
            .agg(F.min_by("ticket_id", F.struct("created_at", "ticket_id")).alias("ticket_id")))


def create_tickets(found: DataFrame, tickets: DataFrame) -> DataFrame:
    """New tickets only; `found` needs title, description and created_at.

    Several incidents with one rule set open one ticket, that of the first batch.
    """
    keyed = found.withColumn("rule_key", rule_key(F.col("rule_ids")))
    first = keyed.groupBy("table_fq_name", "rule_key").agg(F.min_by(F.struct(
        "batch_id", "title", "description", "severity", "rule_ids", "created_at"),
        F.struct("seq", "batch_id")).alias("f")).select("table_fq_name", "rule_key", "f.*")
    fresh = first.join(_open_keys(tickets), ["table_fq_name", "rule_key"], "left_anti")
    return fresh.select(
        stable_id("tkt_", F.col("table_fq_name"), F.col("rule_key"), F.col("batch_id")).alias("ticket_id"),
        "table_fq_name", "title", "description", "severity", F.col("rule_ids").alias("check_results"),
        F.lit("open").alias("status"), F.col("created_at").cast("double").alias("created_at"))


def list_tickets(tickets: DataFrame, table: str | None = None) -> DataFrame:
    return tickets if table is None else tickets.filter(F.col("table_fq_name") == table)


def resolve_tickets(tickets: DataFrame, ticket_ids: DataFrame) -> DataFrame:
    """Tickets with the named ones resolved."""
    named = ticket_ids.select("ticket_id").distinct().withColumn("__hit", F.lit(True))
    return (tickets.join(named, "ticket_id", "left")
            .withColumn("status", F.when(F.col("__hit"), "resolved").otherwise(F.col("status")))
            .select(*tickets.columns))


def webhook_payload(tickets: DataFrame) -> DataFrame:
    """(ticket_id, payload): the JSON body a consumer of the outbox posts."""
    body = F.struct("ticket_id", F.col("table_fq_name").alias("table"), "title", "description",
                    "severity", F.col("check_results").alias("rule_ids"))
    return tickets.select("ticket_id", F.to_json(body).alias("payload"))
