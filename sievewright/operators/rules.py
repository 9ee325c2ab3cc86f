"""Rule lifecycle on an append-only event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RULE_EVENTS, RULE_STATUSES, RULES, THRESHOLD_HISTORY

# The documented transitions, enforced on request only.
TRANSITIONS = (("proposed", "approved"), ("approved", "active"), ("active", "retired"),
               ("proposed", "rejected"))
_PAYLOAD = [f.name for f in RULES.fields if f.name not in ("rule_id", "created_at", "updated_at", "version")]


def _event(frame: DataFrame) -> DataFrame:
    have = set(frame.columns)
    return frame.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                          for f in RULE_EVENTS.fields])


def add_events(rules: DataFrame, seq: Column, known: DataFrame | None = None) -> DataFrame:
    """Events that add rules; ids the log already holds are left out."""
    fresh = rules if known is None else rules.join(known.select("rule_id").distinct(), "rule_id", "left_anti")
    return _event(fresh.withColumn("at", F.col("created_at")).withColumn("seq", seq)
                  .withColumn("event", F.lit("add")))


def status_events(changes: DataFrame) -> DataFrame:
    """`changes`: seq, rule_id, new_status, at."""
    return _event(changes.filter(F.col("new_status").isin(*RULE_STATUSES)).withColumn("event", F.lit("status")))


def threshold_events(history: DataFrame, seq: Column) -> DataFrame:
    """Events for threshold changes; a change that needs re-approval also demotes the rule."""
    return _event(history.withColumn("seq", seq).withColumn("event", F.lit("threshold"))
                  .withColumn("at", F.col("changed_at"))
                  .withColumn("new_status", F.when(F.col("required_reapproval"), "approved")))


def _last(value: str) -> Column:
    """The last non-null value in log order."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col("seq")))


def current_rules(events: DataFrame) -> DataFrame:
    """The rules table that the log amounts to."""
    added = F.col("event") == "add"
    folded = events.groupBy("rule_id").agg(
        F.max_by(F.struct(*_PAYLOAD), F.when(added, F.col("seq"))).alias("p"),
        _last("new_status").alias("last_status"), _last("new_threshold").alias("last_threshold"),
        F.min(F.when(added, F.col("at"))).alias("created_at"), F.max_by("at", "seq").alias("updated_at"),
        (F.count_if(F.col("event") == "threshold") + 1).cast("int").alias("version"))
    alive = folded.filter(F.col("p").isNotNull())
    return alive.select(
        "rule_id", *[F.col(f"p.{c}") for c in _PAYLOAD], "last_status", "last_threshold",
        "created_at", "updated_at", "version",
    ).withColumns({
        "status": F.coalesce("last_status", "status"),
        "threshold": F.coalesce("last_threshold", "threshold"),
    }).select(*[F.col(f.name).cast(f.dataType) for f in RULES.fields])


def unknown_ids(changes: DataFrame, events: DataFrame) -> DataFrame:
    """Changes that name no rule."""
    return changes.join(events.filter(F.col("event") == "add").select("rule_id").distinct(),
                        "rule_id", "left_anti")


def check_known(changes: DataFrame, events: DataFrame) -> None:
    missing = unknown_ids(changes, events).select("rule_id").limit(1).collect()
    if missing:
        raise KeyError(f"No such rule: {missing[0].rule_id}")


def invalid_transitions(changes: DataFrame, events: DataFrame) -> DataFrame:
    """Status changes outside the documented lifecycle (one change per rule at a time)."""
    current = current_rules(events).select("rule_id", F.col("status").alias("old_status"))
    allowed = F.lit(False)
    for old, new in TRANSITIONS:
        allowed = allowed | ((F.col("old_status") == old) & (F.col("new_status") == new))
    return changes.join(current, "rule_id").filter(~allowed)


def rules_where(rules: DataFrame, table: str | None = None, status: str | None = None) -> DataFrame:
    out = rules
    if table is not None:
        out = out.filter(F.col("table_fq_name") == table)
    if status is not None:
        out = out.filter(F.col("status") == status)
    return out


def pending_rules(rules: DataFrame, table: str | None = None) -> DataFrame:
    return rules_where(rules, table, "proposed")


def activate_approved(rules: DataFrame, table: str | None, seq: Column, at: float) -> DataFrame:
    """Events that make every approved rule active."""
    return status_events(rules_where(rules, table, "approved").select(
        "rule_id", seq.alias("seq"), F.lit("active").alias("new_status"), F.lit(at).alias("at")))


def update_threshold(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """History rows for `changes` (rule_id, new_threshold, changed_at, reason, flags)."""
    return changes.join(rules.select("rule_id", F.col("threshold").alias("old_threshold")), "rule_id").select(
        *[f.name for f in THRESHOLD_HISTORY.fields])


def threshold_history(history: DataFrame, rule_id: str | None = None) -> DataFrame:
    """The audit trail, oldest first."""
    out = history if rule_id is None else history.filter(F.col("rule_id") == rule_id)
    return out.orderBy("rule_id", "changed_at")
