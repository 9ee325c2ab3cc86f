"""State-table schemas, vocabularies and the rule record."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The vocabularies of the data model.
RULE_TYPES = ("completeness", "uniqueness", "range", "pattern", "freshness", "referential", "custom_sql")
RULE_STATUSES = ("proposed", "approved", "active", "rejected", "retired")
SEVERITIES = ("info", "warn", "critical")
CHECK_STATUSES = ("pass", "warn", "fail", "error")
TICKET_STATUSES = ("open", "acknowledged", "resolved")
GATE_DECISIONS = ("pass", "pass_with_warnings", "block")
HIGHER_IS_BETTER = ("uniqueness", "pattern")
CAPPED_AT_ONE = ("completeness", "range", "referential")

_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


RULES = _struct(
    ("rule_id", _S), ("table_fq_name", _S), ("column", _S), ("rule_type", _S), ("threshold", _D),
    ("severity", _S), ("status", _S), ("params", _S), ("rationale", _S), ("adaptive", _B),
    ("created_by", _S), ("created_at", _D), ("updated_at", _D), ("version", _I),
)
# One log row is either a rule being added (the payload columns), a status change
# or a threshold change; `seq` orders the log.
RULE_EVENTS = _struct(
    ("seq", _L), ("rule_id", _S), ("event", _S), ("at", _D), ("new_status", _S),
    ("new_threshold", _D), *[(f.name, f.dataType) for f in RULES.fields if f.name not in
                             ("rule_id", "created_at", "updated_at", "version")],
)
THRESHOLD_HISTORY = _struct(
    ("rule_id", _S), ("old_threshold", _D), ("new_threshold", _D), ("changed_at", _D),
    ("reason", _S), ("auto_adjusted", _B), ("required_reapproval", _B),
)
CHECK_RESULTS = _struct(
    ("batch_id", _S), ("seq", _L), ("rule_id", _S), ("table_fq_name", _S), ("column", _S),
    ("rule_type", _S), ("status", _S), ("metric_value", _D), ("threshold", _D), ("severity", _S),
    ("message", _S), ("sample_violations", T.ArrayType(_S)), ("checked_at", _D),
)
KNOWLEDGE_DOCS = _struct(
    ("doc_id", _S), ("table_fq_name", _S), ("title", _S), ("content", _S),
    ("tags", T.ArrayType(_S)), ("created_at", _D),
)
TICKETS = _struct(
    ("ticket_id", _S), ("table_fq_name", _S), ("title", _S), ("description", _S),
    ("severity", _S), ("check_results", T.ArrayType(_S)), ("status", _S), ("created_at", _D),
)
EWMA_STATE = _struct(("rule_id", _S), ("n", _L), ("mean", _D), ("var", _D), ("last_seq", _L))
LINEAGE_EDGES = _struct(
    ("upstream", _S), ("downstream", _S), ("relationship", _S), ("source_of_info", _S),
)
PROMPTS = _struct(("id", _S), ("kind", _S), ("system", _S), ("prompt", _S))
RESPONSES = _struct(("id", _S), ("text", _S))


@dataclass(frozen=True)
class Rule:
    """One rule as the check compiler sees it; a row of the rules table."""

    rule_id: str
    table_fq_name: str
    column: str | None
    rule_type: str
    threshold: float
    severity: str = "warn"
    params: dict[str, Any] = field(default_factory=dict)
    status: str = "active"
    adaptive: bool = True

    @property
    def higher_is_better(self) -> bool:
        return self.rule_type in HIGHER_IS_BETTER


def rules_from_rows(rules: DataFrame) -> list[Rule]:
    """Bring the configuration rows of one table (never data) to the compiler."""
    picked = rules.orderBy("rule_id").collect()
    return [
        Rule(
            rule_id=r.rule_id, table_fq_name=r.table_fq_name, column=r.column, rule_type=r.rule_type,
            threshold=r.threshold, severity=r.severity,
            params=json.loads(r.params) if r.params else {}, status=r.status,
            adaptive=True if r.adaptive is None else r.adaptive,
        )
        for r in picked
    ]


def rules_to_rows(spark: SparkSession, rules: list[Rule], created_by: str = "system",
                  at: float = 0.0) -> DataFrame:
    rows = [
        (r.rule_id, r.table_fq_name, r.column, r.rule_type, float(r.threshold), r.severity, r.status,
         json.dumps(r.params), "", r.adaptive, created_by, at, at, 1)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULES)
