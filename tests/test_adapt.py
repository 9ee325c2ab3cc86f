import random

import pytest
from pyspark.sql import functions as F

from sievewright.operators import adapt as A

GENTLE = [0.018, 0.019, 0.020, 0.021, 0.022, 0.0225, 0.023]
SUDDEN = [0.30, 0.32, 0.29, 0.31, 0.30, 0.33]


def observations(spark, **series):
    rows = [(rule, i, float(x)) for rule, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "rule_id string, seq long, x double")


def rules(spark, *names, rule_type="completeness", threshold=0.02, adaptive=True):
    return spark.createDataFrame([(n, rule_type, threshold, adaptive, "active") for n in names],
                                 "rule_id string, rule_type string, threshold double, adaptive boolean, status string")


def brute(xs):
    mean, var = xs[0], 0.0
    for x in xs[1:]:
        delta = x - mean
        mean += 0.3 * delta
        var = 0.7 * (var + 0.3 * delta ** 2)
    return mean, var


def test_gentle_and_sudden_drift(spark):
    steps = A.adapt_replay(observations(spark, g=GENTLE, s=SUDDEN), rules(spark, "g", "s")).orderBy("seq").collect()
    gentle = [r for r in steps if r.rule_id == "g" and r.change != "none"]
    assert [r.threshold for r in gentle] == [0.023339, 0.024244, 0.024921]
    assert {r.change for r in gentle} == {"auto"} and gentle[-1].status == "active"
    sudden = [r for r in steps if r.rule_id == "s" and r.change != "none"]
    assert [(r.threshold, r.change, r.status) for r in sudden] == [
        (0.319377, "reapproval", "approved"), (0.339545, "auto", "approved")]
    assert sudden[0].relative_change == pytest.approx(14.96885)


def test_clean_data_demotes(spark):
    last = A.adapt_replay(observations(spark, z=[0.0] * 5), rules(spark, "z")).orderBy(F.desc("seq")).first()
    assert (last.threshold, last.change, last.status) == (0.0, "reapproval", "approved")


def test_fold_equals_brute_force_over_many_pieces(spark):
    random.seed(5)
    xs = [1e6 + random.random() for _ in range(5000)]
    got = A.ewma_fold(observations(spark, r=xs)).first()
    mean, var = brute(xs)
    assert got["mean"] == pytest.approx(mean, rel=1e-12) and got["var"] == pytest.approx(var, rel=1e-6)
    assert (got.n, got.last_seq) == (200, 4999)


def test_fold_resumes(spark):
    obs = observations(spark, r=GENTLE, other=[0.5])
    state = A.ewma_fold(obs.filter("seq < 3"))
    got = {r.rule_id: r for r in A.ewma_fold(obs.filter("seq >= 3"), state).collect()}
    mean, var = brute(GENTLE)
    assert got["r"]["mean"] == pytest.approx(mean) and got["r"]["var"] == pytest.approx(var) and got["r"].n == 7
    assert (got["other"].n, got["other"]["mean"]) == (1, 0.5)


def test_replay_over_several_rounds(spark):
    random.seed(3)
    xs = [random.random() / 10 for _ in range(30)]
    wide = observations(spark, r=xs).withColumn("seq", F.col("seq") * 1000)
    narrow = A.adapt_replay(observations(spark, r=xs), rules(spark, "r")).orderBy("seq").collect()
    rounds = A.adapt_replay(wide, rules(spark, "r")).orderBy("seq").collect()
    assert [r.threshold for r in rounds] == [r.threshold for r in narrow]
    assert [r.n for r in rounds] == [r.n for r in narrow]


def results(spark, *rows):
    return spark.createDataFrame(list(rows), "rule_id string, seq long, status string, metric_value double")


def test_only_passes_and_warnings_count(spark):
    got = A.observations(results(spark, ("a", 1, "pass", 0.1), ("a", 2, "fail", 0.9), ("a", 3, "warn", 0.2),
                                 ("a", 4, "error", None)))
    assert sorted(r.seq for r in got.collect()) == [1, 3]


def test_fewer_than_five_change_nothing(spark):
    _, changes = A.adapt_step(results(spark, *[("a", i, "pass", 0.5) for i in range(4)]), rules(spark, "a"), None, 1.0)
    assert changes.count() == 0


def test_step_records_reason_and_guardrail(spark):
    batch = results(spark, *[("a", i, "pass", x) for i, x in enumerate(SUDDEN[:5])])
    state, changes = A.adapt_step(batch, rules(spark, "a"), None, 1.0)
    row = changes.first()
    assert (row.new_threshold, row.required_reapproval) == (0.319377, True)
    assert row.reason == "EWMA-based auto-tune from 5 observations (mean=0.3027, std=0.0083); relative_change=1496.9%"
    assert state.first().n == 5


def test_fixed_rules_never_change(spark):
    batch = results(spark, *[("a", i, "pass", 0.5) for i in range(9)])
    assert A.adapt_step(batch, rules(spark, "a", adaptive=False), None, 1.0)[1].count() == 0
    steps = A.adapt_replay(observations(spark, a=[0.5] * 9), rules(spark, "a", adaptive=False))
    assert {r.change for r in steps.collect()} == {"none"}


def test_never_tighten(spark):
    state = A.ewma_fold(observations(spark, z=[0.0] * 6))
    assert A.suggestions(state, rules(spark, "z")).first().change == "reapproval"
    assert A.suggestions(state, rules(spark, "z"), never_tighten=True).first().change == "none"
