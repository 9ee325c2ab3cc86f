"""Metrics of the faulty views at sf0.01 that two engines agreed on beforehand."""

import os

import pytest
from pyspark.sql import functions as F

from sievewright import Rule
from sievewright.operators.checks import evaluate
from sievewright.operators.profile import profile_columns
from sievewright.plans.queries.registry import dirty, table

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

ORDERS = [
    ("o_custkey", "completeness", {}, 0.076933333),
    ("o_orderkey", "uniqueness", {}, 0.990066667),
    ("o_totalprice", "range", {"min": 0}, 0.034533333),
    ("o_orderdate_text", "pattern", {"pattern_name": "date_iso"}, 0.9756),
    ("o_orderdate", "freshness", {}, 3672.0),
    ("o_custkey", "referential", {"ref_table": "customer", "ref_column": "c_custkey"}, 0.058861765),
    (None, "custom_sql", {"valid_expr": "o_totalprice > 0 and o_orderpriority <> 'bad'"}, 0.090933333),
]


def metrics(spark, df, cases):
    rules = [Rule(f"r{i}", "t", c, kind, 0.1, "warn", params) for i, (c, kind, params, _) in enumerate(cases)]
    got = evaluate(df, rules, batch_id="b", samples=False, resolve=lambda t: table(spark, SF, t),
                   as_of=F.lit("2002-01-01").cast("timestamp"))
    return [r.metric_value for r in got.orderBy("rule_id").collect()]


def test_orders(spark):
    assert metrics(spark, dirty(spark, SF, "orders_dirty"), ORDERS) == pytest.approx([c[3] for c in ORDERS], abs=1e-9)


def test_customers_and_documents(spark):
    email = [("c_email", "pattern", {"pattern_name": "email"}, 0.909218860)]
    assert metrics(spark, dirty(spark, SF, "customer_dirty"), email) == pytest.approx([0.909218860], abs=1e-9)
    natural = [("doc_id", "referential", {"ref_table": "labels", "ref_column": "doc_id"}, 0.601),
               ("text", "uniqueness", {}, 0.927)]
    assert metrics(spark, table(spark, SF, "documents"), natural) == pytest.approx([0.601, 0.927], abs=1e-9)


def test_event_values(spark):
    row = profile_columns(table(spark, SF, "events").select("value")).first()
    assert row.stddev == pytest.approx(49.102350645, abs=1e-9)


def test_corrupted_keys_block(spark):
    """15 orphans among 2,240 rows break a zero-tolerance rule in spite of its buffer."""
    df = spark.range(2240).select(F.when(F.col("id") < 15, 99999).otherwise(F.col("id") % 100).alias("k"))
    rule = Rule("r", "t", "k", "referential", 0.0, "critical", {"ref_table": "keys", "ref_column": "id"})
    row = evaluate(df, [rule], batch_id="b", resolve=lambda t: spark.range(100)).first()
    assert row.status == "fail" and row.message == "0.67% of values not found in reference set"
