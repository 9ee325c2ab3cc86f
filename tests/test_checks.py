import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sievewright import Rule
from sievewright.operators.checks import CheckPlan, check_status, evaluate, run_checks


def one(df, rule_type, column="c", threshold=0.0, params=None, severity="warn", **kwargs):
    rule = Rule("r1", "t", column, rule_type, threshold, severity, params or {})
    return evaluate(df, [rule], batch_id="b", **kwargs).first()


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def test_completeness(spark):
    r = one(column(spark, ["a", "b", "c", None]), "completeness", threshold=0.5)
    assert (r.status, r.metric_value) == ("pass", 0.25)
    assert r.message == "Null rate 25.00% (max allowed 50.00%)"
    assert one(column(spark, ["a", None, None, None]), "completeness", threshold=0.1).status == "fail"


@pytest.mark.parametrize("nulls, status", [(10, "pass"), (11, "warn"), (12, "fail")])
def test_warning_zone_lies_beyond_the_threshold(spark, nulls, status):
    df = column(spark, ["a"] * (100 - nulls) + [None] * nulls)
    assert one(df, "completeness", threshold=0.10).status == status


def test_nan_counts_as_missing(spark):
    df = column(spark, [1.0, float("nan"), None, 2.0], "double")
    assert one(df, "completeness", threshold=1.0).metric_value == 0.5
    assert one(df, "uniqueness", threshold=0.9).metric_value == 1.0
    assert one(df, "range", params={"min": 0, "max": 5}).metric_value == 0.0


def test_uniqueness(spark):
    r = one(column(spark, [1, 2, 3, 3], "long"), "uniqueness", threshold=0.999)
    assert (r.status, r.metric_value, r.sample_violations) == ("fail", 0.75, ["3"])
    assert one(column(spark, [None, None], "long"), "uniqueness", threshold=0.999).status == "pass"


def test_zeros_of_both_signs_are_one_value(spark):
    assert one(column(spark, [0.0, -0.0], "double"), "uniqueness", threshold=0.9).metric_value == 0.5


def test_range(spark):
    r = one(column(spark, [10, 20, -5, 15], "long"), "range", params={"min": 0, "max": 1000})
    assert (r.status, r.metric_value, r.sample_violations) == ("fail", 0.25, ["-5"])
    assert r.message == "25.00% of values outside [0, 1000]"
    # Text that is no number is no violation.
    r = one(column(spark, ["10", "abc", " 2000 ", "12d", None]), "range", params={"max": 1000})
    assert r.metric_value == 0.5


def test_zero_tolerance_still_has_a_buffer(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 2, -1).otherwise(1).alias("c"))
    assert one(df, "range", params={"min": 0}).status == "warn"


def test_pattern(spark):
    df = column(spark, ["a@x.com", "b@x.com", "bad-email", None])
    r = one(df, "pattern", threshold=0.9, params={"pattern_name": "email"})
    assert (r.status, r.sample_violations) == ("fail", ["bad-email"])
    assert one(df, "pattern", threshold=0.6, params={"regex": "[ab]"}).metric_value == 1.0
    assert one(df, "pattern", params={}).status == "error"
    assert one(df, "pattern", params={"regex": "(("}).status == "error"
    assert one(column(spark, [None]), "pattern", threshold=0.9).status == "pass"


def test_dates_in_timestamps(spark):
    df = column(spark, [dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 1, 7)], "timestamp")
    assert one(df, "pattern", threshold=0.9, params={"pattern_name": "date_iso"}).metric_value == 0.5


def test_freshness(spark):
    now = dt.datetime(2024, 5, 1, 12)
    df = column(spark, [now - dt.timedelta(hours=1), now - dt.timedelta(hours=9)], "timestamp")
    as_of = F.lit("2024-05-01 12:00:00").cast("timestamp")
    r = one(df, "freshness", threshold=24.0, as_of=as_of)
    assert (r.status, r.metric_value) == ("pass", 1.0)
    assert r.message == "Most recent c is 1.0h old (max allowed 24.0h)"
    ahead = one(column(spark, ["2024-05-02 12:00:00", "junk"]), "freshness", threshold=1.0, as_of=as_of)
    assert (ahead.status, ahead.metric_value) == ("pass", -24.0)
    assert one(column(spark, ["junk"]), "freshness", threshold=1.0).metric_value == float("inf")


def test_referential_list(spark):
    r = one(column(spark, [1, 2, 999], "long"), "referential", params={"ref_values": [1, 2, 3]})
    assert (r.status, r.sample_violations) == ("fail", ["999"])
    # No reference at all: everything is missing. Types do not mix.
    assert one(column(spark, [1], "long"), "referential").metric_value == 1.0
    assert one(column(spark, ["1"]), "referential", params={"ref_values": [1]}).metric_value == 1.0


def test_long_reference_list_becomes_a_join(spark):
    df = spark.range(1000).select(F.col("id").alias("c"))
    r = one(df, "referential", params={"ref_values": list(range(900))})
    assert r.metric_value == 0.1


def test_referential_table(spark):
    df = column(spark, [1, 1, 1, 2, None], "long")
    params = {"ref_table": "ref", "ref_column": "k"}
    doubled = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    assert one(df, "referential", params=params, resolve=lambda t: doubled).metric_value == 0.25
    texts = spark.createDataFrame([("1",)], "k string")
    assert one(df, "referential", params=params, resolve=lambda t: texts).metric_value == 1.0

    def missing(name):
        raise ValueError(name)
    r = one(df, "referential", params=params | {"ref_values": [1]}, resolve=missing)
    assert r.metric_value == 0.25 and "could not be loaded" in r.message


def test_custom(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (-1, 30)], "quantity long, price long")
    r = one(df, "custom_sql", None, params={"valid_expr": "quantity >= 0 and price > 0"})
    assert r.metric_value == pytest.approx(1 / 3) and r.status == "fail"
    assert r.sample_violations == ['{"quantity":-1,"price":30}']
    # Bad arithmetic makes a row invalid and does not end the job.
    assert one(df, "custom_sql", None, params={"valid_expr": "10 / (quantity - 1) > 0"}).metric_value == pytest.approx(2 / 3)
    for bad in ({}, {"valid_expr": "nope > 1"}, {"valid_expr": "quantity +"}, {"valid_expr": "quantity + 1"}):
        assert one(df, "custom_sql", None, params=bad).status == "error"


def test_predicate_that_raises_becomes_an_error_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    rules = [Rule("ok", "t", "s", "completeness", 0.5),
             Rule("bad", "t", None, "custom_sql", 0.1, "warn", {"valid_expr": "assert_true(id < 2) is null"})]
    got = {r.rule_id: r.status for r in run_checks(df, rules, batch_id="b").collect()}
    assert got == {"ok": "pass", "bad": "error"}


def test_missing_column_and_unknown_type(spark):
    df = column(spark, [1, 2, 3], "long")
    r = one(df, "completeness", "other")
    assert (r.status, r.metric_value) == ("error", None)
    assert "other" in r.message
    assert one(df, "novelty").message == "Unknown rule_type novelty"


def test_empty_table_has_results_for_every_rule(spark):
    df = spark.createDataFrame([], "c long")
    kinds = {"completeness": 0.0, "uniqueness": 1.0, "range": 0.0, "pattern": 1.0, "referential": 0.0}
    for kind, metric in kinds.items():
        assert one(df, kind, params={"pattern_name": "email"}).metric_value == metric
    assert one(df, "freshness").metric_value == float("inf")


def test_nan_metric_fails(spark):
    df = spark.createDataFrame([(float("nan"),)], "m double")
    got = df.select(check_status(F.col("m"), F.lit(0.5), F.lit(True)).alias("s")).first().s
    assert got == "fail"


def test_batches_in_one_job_equal_batches_one_by_one(spark):
    df = spark.range(300).select(
        F.concat(F.lit("b"), (F.col("id") % 3).cast("string")).alias("b"), (F.col("id") % 50).alias("c"),
        F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("s"))
    rules = [Rule("r1", "t", "s", "completeness", 0.1), Rule("r2", "t", "c", "uniqueness", 0.9),
             Rule("r3", "t", "c", "range", 0.1, "warn", {"max": 40}),
             Rule("r4", "t", "c", "referential", 0.1, "warn", {"ref_table": "k", "ref_column": "id"})]

    def ref(name):
        return spark.range(45)
    together = {(r.batch_id, r.rule_id): (r.metric_value, r.sample_violations)
                for r in evaluate(df, rules, batch_col="b", resolve=ref).collect()}
    for b in ("b0", "b1", "b2"):
        for r in evaluate(df.filter(F.col("b") == b).drop("b"), rules, batch_id=b, resolve=ref).collect():
            assert together[b, r.rule_id] == (r.metric_value, r.sample_violations)


def test_hot_value_agrees_with_brute_force(spark):
    """A third of all rows share one value, which is also an orphan."""
    values = [i if i % 3 else 7_000_000 for i in range(9000)]
    df = column(spark, values, "long")
    rules = [Rule("u", "t", "c", "uniqueness", 0.9),
             Rule("f", "t", "c", "referential", 0.1, "warn", {"ref_table": "k", "ref_column": "id"})]
    got = {r.rule_id: r for r in evaluate(df, rules, batch_id="b", resolve=lambda t: spark.range(8000)).collect()}
    assert got["u"].metric_value == len(set(values)) / len(values)
    assert got["u"].sample_violations == ["7000000"]
    assert got["f"].metric_value == sum(v >= 8000 for v in values) / len(values)
    assert len(got["f"].sample_violations) == 10


def test_plans_stay_cheap(spark, tmp_path):
    path = str(tmp_path / "wide.parquet")
    spark.range(1000).selectExpr("id", "id % 10 as c", "cast(id as string) as s", "id as unused").write.parquet(path)
    df = spark.read.parquet(path)
    rules = [Rule("a", "t", "c", "range", 0.1, "warn", {"max": 5}), Rule("b", "t", "c", "uniqueness", 0.1)]
    plan = CheckPlan(df, rules)
    text = plan.results(samples=plan.samples())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "unused" not in text
    assert "WindowGroupLimit" in text


def test_measures_and_samples_share_their_shuffles(spark, tmp_path):
    path = str(tmp_path / "keys.parquet")
    spark.range(2000).selectExpr("id % 900 as c", "cast(id % 3 as string) as b").write.parquet(path)
    rules = [Rule("u", "t", "c", "uniqueness", 0.9),
             Rule("f", "t", "c", "referential", 0.1, "warn", {"ref_table": "k", "ref_column": "id"})]
    df = evaluate(spark.read.parquet(path), rules, batch_col="b", resolve=lambda t: spark.range(500))
    assert df.count() == 6
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # Both rules share one shuffle by value, which is read twice; the second scan looks up the texts of the samples.
    assert "ReusedExchange" in final and final.count("FileScan") == 2


def test_all_value_rules_take_one_scan_and_no_text_is_a_key(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(900).selectExpr("id % 90 as a", "concat('name ', id % 50) as b", "cast(id % 7 as double) as c", "id").write.parquet(path)
    refs = {"k": spark.range(80).selectExpr("id", "concat('name ', id) as name", "cast(id as decimal(20, 2)) as d")}
    rules = [Rule(f"r{i}", "t", c, "referential", 0.0, "warn", {"ref_table": "k", "ref_column": r})
             for i, (c, r) in enumerate((("a", "id"), ("b", "name"), ("c", "d"), ("id", "id"), ("c", "id")))]
    rules += [Rule("u1", "t", "b", "uniqueness", 1.0), Rule("u2", "t", "id", "uniqueness", 1.0)]
    df = evaluate(spark.read.parquet(path), rules, resolve=refs.get, samples=False)
    got = {r.rule_id: round(r.metric_value, 4) for r in df.collect()}
    assert got == {"r0": round(100 / 900, 4), "r1": 0.0, "r2": 0.0, "r3": round(820 / 900, 4), "r4": 0.0, "u1": round(50 / 900, 4), "u2": 1.0}
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1
    assert all("value" not in k and "name" not in k and "b#" not in k for k in re.findall(r"Exchange hashpartitioning\((.*?)\)", final))


def test_samples_of_all_value_rules(spark):
    df = spark.createDataFrame([(i, f"v{i % 4}", float(i % 3), i % 2 == 0) for i in range(40)] + [(None, None, float("nan"), None)],
                               "a int, b string, c double, d boolean")
    rules = [Rule("a", "t", "a", "referential", 0.0, "warn", {"ref_values": list(range(30))}),
             Rule("b", "t", "b", "referential", 0.0, "warn", {"ref_values": ["v0", "v1"]}),
             Rule("c", "t", "c", "referential", 0.0, "warn", {"ref_values": [0, 1.0]}),
             Rule("d", "t", "d", "referential", 0.0, "warn", {"ref_values": [True]}),
             Rule("u", "t", "b", "uniqueness", 1.0), Rule("w", "t", "a", "uniqueness", 1.0)]
    got = {r.rule_id: r for r in evaluate(df, rules).collect()}
    assert got["a"].sample_violations == [str(i) for i in range(30, 40)] and got["a"].metric_value == 0.25
    assert got["b"].sample_violations == ["v2", "v3"] and got["c"].sample_violations == ["2.0"]
    assert got["d"].sample_violations == ["false"] and got["d"].metric_value == 0.5
    assert got["u"].sample_violations == ["v0", "v1", "v2", "v3"] and got["w"].sample_violations == [] and got["w"].metric_value == 1.0


BIG = 2 ** 53


@pytest.mark.parametrize("extra", [0, 600])
def test_lists_of_any_length_are_exact(spark, extra):
    refs = [BIG] + [-n - 1 for n in range(extra)]
    assert one(column(spark, [BIG + 1], "long"), "referential", params={"ref_values": refs}).metric_value == 1.0
    assert one(column(spark, [BIG], "long"), "referential", params={"ref_values": refs}).metric_value == 0.0
    mixed = [1, 2.0, 2.5, "3", True, None, float("nan"), 2 ** 70] + refs
    r = one(column(spark, [1, 2, 3, None], "long"), "referential", params={"ref_values": mixed})
    assert (round(r.metric_value, 4), r.sample_violations) == (0.3333, ["3"])


def test_bounds_are_exact(spark):
    assert one(column(spark, [BIG + 1], "long"), "range", params={"max": BIG}).metric_value == 1.0
    assert one(column(spark, [BIG, 3, 4], "long"), "range", params={"min": 3.5, "max": float("inf")}).metric_value == pytest.approx(1 / 3)
    assert one(column(spark, [5], "long"), "range", params={"max": 2 ** 80, "min": -2 ** 80}).metric_value == 0.0
    df = spark.sql("select cast(v as decimal(30, 10)) as c from values ('9007199254740993.0000000001'), ('1') t(v)")
    assert one(df, "range", params={"max": BIG + 1}).metric_value == 0.5


def test_numbers_are_written_out_for_patterns(spark):
    from sievewright.functions.coerce import pattern_text
    values = [12345678.0, 1e15, 1e16, 1.5e20, 0.001, 0.00012345, 1e-5, 1.5e-7, 0.0, -0.0, -2.5, 123456789.125, 1 / 3, 1e100, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "c double")
    got = [r[0] for r in df.select(pattern_text(F.col("c"), df.schema["c"].dataType)).collect()]
    assert got == [None if v is None else "0.0" if v == 0 else repr(v) for v in values]
    flags = spark.createDataFrame([(True,), (False,)], "c boolean")
    assert one(flags, "pattern", params={"regex": "True|False"}).metric_value == 1.0
    assert one(column(spark, [12345678.0], "double"), "pattern", params={"regex": r"^\d+\.\d+$"}).metric_value == 1.0


@pytest.mark.parametrize("bad", ["sum(v) > 0", "explode(array(true))", "count(*) > 1"])
def test_one_bad_predicate_leaves_the_others(spark, bad):
    df = spark.createDataFrame([(1,), (2,)], "v long")
    rules = [Rule("a", "t", None, "custom_sql", 0.0, "warn", {"valid_expr": bad}), Rule("b", "t", "v", "completeness", 0.0, "warn")]
    got = {r.rule_id: r.status for r in evaluate(df, rules).collect()}
    assert got == {"a": "error", "b": "pass"}
