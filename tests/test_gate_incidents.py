import json

from pyspark.sql import functions as F

from sievewright.operators import gate as G, incidents as I
from sievewright.schemas import TICKETS
from sievewright.sources.quarantine import quarantine_folder, write_quarantine

SCHEMA = ("batch_id string, seq long, rule_id string, table_fq_name string, column string, rule_type string, "
          "status string, metric_value double, threshold double, severity string, message string")


def results(spark, *rows):
    """rows: (batch, rule, status, severity)."""
    return spark.createDataFrame(
        [(b, int(b[1:]), r, "src.t", "c", "range", s, 0.5, 0.1, sev, "m") for b, r, s, sev in rows], SCHEMA)


def test_decisions(spark):
    df = results(spark, ("b1", "r1", "pass", "critical"), ("b2", "r1", "fail", "critical"), ("b2", "r2", "warn", "warn"),
                 ("b3", "r1", "warn", "critical"), ("b3", "r2", "fail", "info"), ("b4", "r1", "error", "critical"))
    got = {r.batch_id: (r.decision, r.reasons) for r in G.gate(df).collect()}
    assert got["b1"] == ("pass", [])
    assert got["b2"] == ("block", ["CRITICAL FAIL: c range — m"])
    assert got["b3"] == ("pass_with_warnings", ["WARN: c range — m", "FAIL: c range — m"])
    assert got["b4"][0] == "pass"
    assert {r.batch_id: r.decision for r in G.gate(df, error_blocks=True).collect()}["b4"] == "block"


def test_quarantine_replaces_its_own_batch(spark, tmp_path):
    df = spark.range(7).withColumn("batch_id", F.lit("b1"))
    root = str(tmp_path)
    assert write_quarantine(df, root, "src.t") == 7
    assert write_quarantine(df.limit(3), root, "src.t") == 3
    write_quarantine(df.withColumn("batch_id", F.lit("b2")), root, "src.t")
    folder = quarantine_folder(root, "src.t")
    assert folder.endswith("/src_t")
    assert spark.read.csv(folder, header=True).groupBy("batch_id").count().orderBy("batch_id").collect() == [
        ("b1", 3), ("b2", 7)]


def test_worst_is_severity_then_failure_then_rule(spark):
    df = results(spark, ("b1", "r9", "warn", "critical"), ("b1", "r2", "fail", "critical"), ("b1", "r1", "fail", "critical"),
                 ("b1", "r0", "fail", "warn"), ("b2", "r5", "pass", "critical"))
    assert [r.rule_id for r in I.worst_result(df).collect()] == ["r1"]
    incident = I.incidents(df).first()
    assert (incident.severity, incident.rule_ids, incident.problems) == ("critical", ["r0", "r1", "r2", "r9"], 4)


def found(spark, df):
    return I.incidents(df).withColumns({"title": F.lit("t"), "description": F.lit("d"), "created_at": F.lit(1.0)})


def test_one_ticket_per_open_rule_set(spark):
    none = spark.createDataFrame([], TICKETS)
    df = results(spark, ("b1", "r1", "fail", "warn"), ("b2", "r1", "fail", "warn"), ("b3", "r2", "fail", "warn"))
    opened = I.create_tickets(found(spark, df), none)
    assert sorted(r.check_results for r in opened.collect()) == [["r1"], ["r2"]]
    again = results(spark, ("b4", "r1", "warn", "warn"))
    assert I.create_tickets(found(spark, again), opened).count() == 0
    assert I.match_open(found(spark, again), opened).count() == 1
    resolved = I.resolve_tickets(opened, opened.select("ticket_id"))
    fresh = I.create_tickets(found(spark, again), resolved)
    assert fresh.count() == 1
    assert fresh.join(opened, "ticket_id").count() == 0


def test_payload(spark):
    ticket = spark.createDataFrame([("tkt_1", "src.t", "T", "D", "warn", ["r1"], "open", 1.0)], TICKETS)
    assert json.loads(I.webhook_payload(ticket).first().payload) == {
        "ticket_id": "tkt_1", "table": "src.t", "title": "T", "description": "D", "severity": "warn", "rule_ids": ["r1"]}


def test_data_is_not_shuffled_by_batch(spark):
    """The split by decisions broadcasts them, as their size is known."""
    from sievewright.operators import gate as G
    data = spark.range(100).selectExpr("id", "cast(id % 4 as string) as batch_id")
    decisions = spark.createDataFrame([("t", "1", "block"), ("t", "2", "pass")], "table_fq_name string, batch_id string, decision string")
    for split, rows in ((G.held, 25), (G.released, 75)):
        out = split(data, decisions)
        assert out.count() == rows
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
