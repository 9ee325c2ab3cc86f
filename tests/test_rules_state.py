import pytest
from pyspark.sql import functions as F

from sievewright import Rule
from sievewright.operators import rules as R
from sievewright.schemas import rules_to_rows
from sievewright.sources.state import LOGS, StateStore, batch_key


def log(spark):
    rules = [Rule(f"r{i}", "src.t", "c", "range", 0.02, "warn", {"min": i}, status="proposed") for i in range(3)]
    return R.add_events(rules_to_rows(spark, rules), F.lit(0))


def change(spark, *rows):
    return R.status_events(spark.createDataFrame(list(rows), "seq long, rule_id string, new_status string, at double"))


def test_lifecycle(spark):
    events = log(spark).unionByName(change(spark, (1, "r0", "approved", 5.0), (2, "r0", "active", 6.0), (1, "r1", "rejected", 5.0)))
    got = {r.rule_id: r for r in R.current_rules(events).collect()}
    assert [got[r].status for r in ("r0", "r1", "r2")] == ["active", "rejected", "proposed"]
    assert (got["r0"].updated_at, got["r0"].version, got["r0"].params) == (6.0, 1, '{"min": 0}')


def test_threshold_change_demotes_only_when_it_must(spark):
    history = spark.createDataFrame(
        [("r0", 0.02, 0.03, 9.0, "x", True, False), ("r1", 0.02, 0.3, 9.0, "x", True, True)],
        "rule_id string, old_threshold double, new_threshold double, changed_at double, reason string, "
        "auto_adjusted boolean, required_reapproval boolean")
    events = log(spark).unionByName(change(spark, (1, "r0", "active", 5.0), (1, "r1", "active", 5.0)))
    events = events.unionByName(R.threshold_events(history, F.lit(2)))
    got = {r.rule_id: (r.status, r.threshold, r.version) for r in R.current_rules(events).collect()}
    assert got["r0"] == ("active", 0.03, 2) and got["r1"] == ("approved", 0.3, 2)


def test_unknown_ids_and_transitions(spark):
    wanted = spark.createDataFrame([("nope", "active"), ("r0", "active")], "rule_id string, new_status string")
    with pytest.raises(KeyError):
        R.check_known(wanted, log(spark))
    assert [r.rule_id for r in R.invalid_transitions(wanted, log(spark)).collect()] == ["r0"]


def test_adding_twice_stores_once(spark):
    known = R.current_rules(log(spark))
    assert R.add_events(known, F.lit(7), known).count() == 0


def test_store_replays_an_epoch(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    assert store.rules().count() == 0 and store.next_seq("src.t") == 0
    for _ in range(2):
        store.append("rule_events", log(spark), "e1")
    store.append("rule_events", change(spark, (1, "r0", "active", 5.0)), "e2")
    assert store.read("rule_events").count() == 4
    assert store.rules(before="e2").filter("status = 'active'").count() == 0
    assert store.rules().filter("status = 'active'").count() == 1
    store.append("tickets", spark.createDataFrame([], "ticket_id string"), "e3", 0)
    assert store.tickets().count() == 0
    assert not store.committed("src.t", "e3")


def test_compaction_keeps_every_row(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    assert store.compact("rule_events") == 0
    store.append("rule_events", log(spark), "e1")
    store.append("rule_events", change(spark, (1, "r0", "active", 5.0)), "e2")
    before = sorted(store.read("rule_events").collect(), key=str)
    assert store.compact("rule_events") == 2
    assert sorted(store.read("rule_events").collect(), key=str) == before
    store.append("rule_events", change(spark, (2, "r1", "active", 6.0)), "e3")
    assert store.compact("rule_events") == 2
    assert store.read("rule_events").count() == len(before) + 1
    assert store.rules().filter("status = 'active'").count() == 2


def rows_of(store, log="check_results"):
    return sorted((r.rule_id, r.batch_id) for r in store.read(log).collect())


def batch(spark, store, table, name, commit=True):
    key = batch_key(table, name)
    store.append("check_results", spark.createDataFrame([(f"{table}.r", name, table)], "rule_id string, batch_id string, table_fq_name string"), key)
    if commit:
        store.append("commits", spark.createDataFrame([(table, name, 0, 1, key)], LOGS["commits"]), key)


@pytest.mark.parametrize("step", ["write", "publish", "sweep"])
def test_compaction_may_stop_anywhere(spark, tmp_path, monkeypatch, step):
    """Stopped after the merged rows, after their publication or in the deletion: nothing is lost or doubled."""
    store = StateStore(spark, str(tmp_path))
    for n in range(3):
        batch(spark, store, "src.t", f"b{n}")
    batch(spark, store, "src.t", "open", commit=False)
    before = rows_of(store)

    class Stop(Exception):
        pass

    def stop(*args):
        raise Stop
    real = StateStore._publish
    if step == "write":
        monkeypatch.setattr(StateStore, "_publish", stop)
    elif step == "publish":
        monkeypatch.setattr(StateStore, "_publish", lambda *a: (real(*a), stop()))
    else:
        sweeps = iter([False, True])
        sweep = StateStore._sweep
        monkeypatch.setattr(StateStore, "_sweep", lambda *a: stop() if next(sweeps) else sweep(*a))
    with pytest.raises(Stop):
        store.compact("check_results")
    monkeypatch.undo()
    again = StateStore(spark, str(tmp_path))
    assert rows_of(again) == before
    again.compact("check_results")
    assert rows_of(again) == before
    # The open batch was left apart, so its replay replaces it; then it is merged too.
    batch(spark, again, "src.t", "open")
    assert rows_of(again) == before and again.compact("check_results") == 2
    assert rows_of(again) == before and again.compact("check_results") == 1


def test_tables_with_one_batch_id_stay_apart(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    for name in ("src.t", "src.u"):
        batch(spark, store, name, "2024-01-01")
    assert rows_of(store) == [("src.t.r", "2024-01-01"), ("src.u.r", "2024-01-01")]
    assert store.committed("src.t", "2024-01-01") and not store.committed("src.t", "2024-01-01", "other stream")
    assert batch_key("a", "b/c") != batch_key("a", "b_c") and "/" not in batch_key("a", "b/c")
