import glob

import pytest
from pyspark.sql import functions as F

from sievewright import Rule
from sievewright.plans.monitor import Monitor
from sievewright.schemas import rules_to_rows
from sievewright.sources import CatalogSource
from sievewright.sources.state import StateStore
from sievewright.streaming.stream import file_stream


@pytest.fixture()
def agent(spark, shop, tmp_path):
    return Monitor(CatalogSource(spark, "lake"), StateStore(spark, str(tmp_path / "state")), str(tmp_path / "held"))


ORPHANS = Rule("ref", "lake.orders", "customer_id", "referential", 0.0, "critical",
               {"ref_table": "customers", "ref_column": "customer_id"})


def test_propose_approve_activate_run(spark, agent):
    proposed = agent.propose_rules("customers")
    count = proposed.count()
    assert count > 0 and agent.propose_rules("customers").count() == count
    agent.set_status(agent.pending_rules("customers").select("rule_id"), "approved", strict=True)
    assert agent.pending_rules("customers").count() == 0
    agent.activate_approved("customers")
    report = agent.run_batch("customers")
    assert report.row_count == 5 and report.decision == "pass"
    assert {r.status for r in report.results.collect()} == {"pass"} and report.results.count() == count
    assert report.tickets.count() == 0
    with pytest.raises(KeyError):
        agent.set_status(spark.createDataFrame([("nope",)], "rule_id string"), "active")


def test_orphan_blocks_and_tickets_once(spark, agent, tmp_path):
    agent.add_rules(rules_to_rows(spark, [ORPHANS]))
    report = agent.run_batch("orders", batch_id="day1")
    row = report.results.first()
    assert (row.status, row.metric_value, row.sample_violations) == ("fail", 0.25, ["999"])
    assert (report.decision, report.quarantined_rows) == ("block", 4)
    assert glob.glob(str(tmp_path / "held" / "lake_orders" / "batch_id=day1" / "*.csv"))
    again = agent.run_batch("orders", batch_id="day2")
    assert agent.list_tickets("orders").count() == 1
    assert again.tickets.first().ticket_id == report.tickets.first().ticket_id
    agent.resolve_tickets(agent.list_tickets().select("ticket_id"))
    agent.run_batch("orders", batch_id="day3")
    assert sorted(r.status for r in agent.list_tickets().collect()) == ["open", "resolved"]
    assert agent.store.read("outbox").count() == 2
    assert agent.run_dataframe("orders", spark.table("customers").limit(0).select("customer_id")).decision == "pass"


def test_no_rules_pass(agent):
    assert agent.run_batch("orders").decision == "pass"


def test_statistics_survive_between_runs(spark, agent):
    agent.add_rules(rules_to_rows(spark, [Rule("null", "lake.customers", "email", "completeness", 0.19, "warn")]))
    for n in range(5):
        report = agent.run_batch("customers", batch_id=f"b{n}")
    # Five observations of 0.2: the threshold moves by 5 %, which needs no approval.
    assert report.threshold_changes.first().new_threshold == 0.2
    rule = agent.store.rules().first()
    assert (rule.threshold, rule.status, rule.version) == (0.2, "active", 2)


def test_knowledge_reaches_the_prompt(spark, shop, tmp_path):
    seen = []

    def answer(prompts):
        seen.extend(r.prompt for r in prompts.collect())
        return prompts.select("id", F.lit("Title: Orphans\nDescription: Load customers first").alias("text"))
    agent = Monitor(CatalogSource(spark, "lake"), StateStore(spark, str(tmp_path / "s")), str(tmp_path / "h"), answer=answer)
    agent.add_knowledge(spark.createDataFrame([("d1", "lake.orders", "Refunds", "may be negative", ["x"], 1.0)],
                                              "doc_id string, table_fq_name string, title string, content string, tags array<string>, created_at double"))
    agent.add_rules(rules_to_rows(spark, [ORPHANS]))
    assert agent.run_batch("orders").decision == "block"
    assert any("- Refunds: may be negative" in p for p in seen)
    assert agent.list_tickets().first().title == "Orphans"


def test_stream_restarts_without_duplicates(spark, agent, tmp_path):
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    customers = spark.table("customers")
    for n in range(3):
        customers.filter(f"floor((customer_id - 1) / 2) = {n}").coalesce(1).write.mode("append").parquet(folder)
    agent.add_rules(rules_to_rows(spark, [Rule("null", "lake.customers", "email", "completeness", 0.9, "warn")]))
    stream = lambda: file_stream(spark, folder, customers.schema)
    assert agent.run_stream("customers", stream(), mark, max_batches=1) == 1
    assert agent.run_stream("customers", stream(), mark, max_batches=5) == 2
    assert agent.run_stream("customers", stream(), mark) == 0
    assert agent.run_stream("customers", stream(), mark, max_batches=1) == 0
    commits = agent.store.read("commits")
    assert commits.count() == 3 and commits.agg(F.sum("row_count")).first()[0] == 5
    assert agent.store.read("check_results").count() == 3


def test_many_batches_in_one_micro_batch(spark, agent, tmp_path):
    """Results, decisions, quarantine and commits stay per batch; the micro-batch is one step."""
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    rows = spark.range(100).selectExpr("id", "cast(floor(id / 10) as long) as part", "if(id < 30 and id % 2 = 0, null, 'x') as email")
    rows.coalesce(1).write.parquet(folder)
    rows.createOrReplaceTempView("customers")
    agent.add_rules(rules_to_rows(spark, [Rule("null", "lake.customers", "email", "completeness", 0.1, "critical", adaptive=False)]))
    reports = []
    run = lambda: agent.run_stream("customers", file_stream(spark, folder, rows.schema), mark, on_report=reports.append, batch_col="part")
    assert run() == 1 and run() == 0 and len(reports) == 1
    assert (reports[0].row_count, reports[0].decision, reports[0].quarantined_rows) == (100, "block", 30)
    got = {r.batch_id: r for r in agent.store.read("check_results").collect()}
    assert {b: (r.seq, r.metric_value, r.status) for b, r in got.items()} == {
        f"stream_0_{i}": (i, 0.5 if i < 3 else 0.0, "fail" if i < 3 else "pass") for i in range(10)}
    gates = {r.batch_id: (r.decision, r.quarantined_rows) for r in agent.store.read("gate_results").collect()}
    assert gates == {f"stream_0_{i}": ("block", 10) if i < 3 else ("pass", 0) for i in range(10)}
    assert sorted((r.batch_id, r.seq, r.row_count) for r in agent.store.read("commits").collect()) == [(f"stream_0_{i}", i, 10) for i in range(10)]
    assert agent.list_tickets().count() == 1 and agent.store.next_seq("lake.customers") == 10
    assert len(glob.glob(str(tmp_path / "held" / "lake_customers" / "batch_id=*"))) == 3


def test_streams_do_not_shadow_each_other(spark, agent, tmp_path):
    """Another table under the same stream name, and a new checkpoint, are streams of their own."""
    folder = str(tmp_path / "in")
    customers = spark.table("customers")
    customers.coalesce(1).write.parquet(folder)
    customers.createOrReplaceTempView("others")
    for i, name in enumerate(("customers", "others", "customers")):
        assert agent.run_stream(name, file_stream(spark, folder, customers.schema), str(tmp_path / f"mark{i}")) == 1
    done = [(r.table_fq_name, r.batch_id, r.seq) for r in agent.store.read("commits").collect()]
    assert sorted(done) == [("lake.customers", "stream_0", 0), ("lake.customers", "stream_0", 1), ("lake.others", "stream_0", 0)]


def test_tables_share_a_batch_id(spark, agent):
    rules = [Rule(f"n_{t}", f"lake.{t}", "customer_id", "completeness", 0.1, "warn") for t in ("customers", "orders")]
    agent.add_rules(rules_to_rows(spark, rules))
    for t in ("customers", "orders", "customers"):
        agent.run_batch(t, batch_id="2024-01-01")
    assert sorted(r.rule_id for r in agent.store.read("check_results").collect()) == ["n_customers", "n_orders"]
    assert agent.store.next_seq("lake.orders") == 1


def test_scan_report(agent):
    got = {r["name"]: r for r in agent.scan_report("customers").collect()}
    assert got["email"].null_rate == 0.2 and got["customer_id"].is_candidate_key and got["country"].row_count == 5
    # Every signup date is different, so it identifies a row as well.
    assert {r.candidate_grain for r in got.values()} == {"customer_id, signup_date"} and {r.lineage for r in got.values()} == {""}
