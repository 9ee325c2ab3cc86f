import math
import random
import re
from collections import Counter

import pytest

from sievewright.operators import profile as P
from sievewright.operators.profile import candidate_grain, profile_table
from sievewright.operators.suggest import baseline_rules


def by_column(profile):
    return {r["column"]: r for r in profile.collect()}


def test_statistics(spark):
    df = spark.createDataFrame(
        [(1, "a@x.com", 10.0), (2, "b@x.com", 20.0), (3, None, 30.0), (4, "d@x.com", 40.0), (5, "d@x.com", 50.0)],
        "id long, email string, amount double")
    got = by_column(profile_table(df, "src.t"))
    assert got["id"].is_candidate_key and got["id"].inferred_pattern == "integer_id"
    assert got["email"].null_rate == 0.2 and got["email"].distinct_rate == 0.6
    assert (got["amount"].min_value, got["amount"].max_value, got["amount"]["mean"]) == (10.0, 50.0, 30.0)
    assert got["amount"].stddev == pytest.approx(15.811388, abs=1e-6)
    assert [tuple(t) for t in got["email"].top_values] == [("d@x.com", 2), ("a@x.com", 1), ("b@x.com", 1)]
    assert candidate_grain(profile_table(df, "src.t")).first().candidate_grain == ["id", "amount"]


def test_empty_table(spark):
    got = by_column(profile_table(spark.createDataFrame([], "a double"), "t"))
    assert (got["a"].row_count, got["a"].null_rate, got["a"].is_candidate_key) == (0, 0.0, False)
    assert got["a"].stddev is None and got["a"].top_values == []


def test_one_value_has_no_spread(spark):
    got = by_column(profile_table(spark.createDataFrame([(2.0,), (None,)], "a double"), "t"))
    assert got["a"].stddev == 0.0


def test_email_pattern(spark):
    df = spark.createDataFrame([(f"user{i}@example.com",) for i in range(20)], "c string")
    assert by_column(profile_table(df))["c"].inferred_pattern == "email"
    zips = spark.createDataFrame([(f"{10000 + i}",) for i in range(20)], "c string")
    assert by_column(profile_table(zips))["c"].inferred_pattern == "integer_id"


def test_odd_types(spark):
    df = spark.sql("""select true as b, array(1, 2) as a, map('k', 1) as m, struct(1 as x) as s, date'2024-01-01' as d,
                      cast(1.5 as decimal(10, 2)) as n, timestamp_ntz'2024-01-01 00:00:00' as t, binary('x') as bin""")
    got = by_column(profile_table(df))
    assert all(got[c].distinct_count == 1 for c in got)
    assert got["b"].min_value == 1.0 and got["n"].min_value == 1.5 and got["d"].min_text == "2024-01-01"


def test_head_sample(spark):
    df = spark.range(1000).selectExpr("999 - id as k")
    got = by_column(profile_table(df, sample_rows=10, order_by=["k"]))["k"]
    assert (got.row_count, got.max_value) == (10, 9.0)


def test_proposals_follow_the_columns(spark):
    df = spark.createDataFrame([(1, "a@x.com"), (2, "b@x.com")], "id long, email string")
    got = [(r["column"], r.rule_type) for r in
           baseline_rules(profile_table(df, "t")).orderBy("position", "step").collect()]
    assert got == [("id", "completeness"), ("id", "uniqueness"), ("id", "range"), ("id", "pattern"),
                   ("email", "completeness"), ("email", "uniqueness"), ("email", "pattern")]


def test_hot_value(spark):
    df = spark.range(30000).selectExpr("case when id % 3 = 0 then -1 else id end as v")
    got = by_column(profile_table(df))["v"]
    assert got.distinct_count == 20001 and tuple(got.top_values[0]) == ("-1", 10000)


def test_one_scan_counts_and_no_text_is_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(500).selectExpr("id", "concat('text number ', id % 70) as a", "cast(id as string) as b", "id / 7 as x").write.parquet(path)
    df = spark.read.parquet(path)
    stats = P._statistics(P.value_groups(df, P.measured(df)), P.measured(df), 5)
    stats.collect()
    plan = stats._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert keys and all(set(re.sub(r"#\d+L?", "", k).split(", ")) <= {"position", "d1", "d2", "x", "y", "bits", "o0", "o1", "o2", "o3"} for k in keys)


def test_groups_are_read_for_sums_and_ranks_alone(spark):
    """The spread comes from the rows: no join brings the means back to the groups."""
    df = spark.range(500).selectExpr("id", "id / 7 as x", "cast(id % 9 as string) as a")
    stats = P._statistics(P.value_groups(df, P.measured(df)), P.measured(df), 5)
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("count(1) AS n#") == 2 and "squares" not in plan
    assert P._deviations(df, P.measured(df))[0] == pytest.approx(math.sqrt(500 * 501 / 12))


def test_scans_of_a_profile(spark, tmp_path, monkeypatch):
    """Two at most: the counts, and the texts that belong to them."""
    path = str(tmp_path / "t")
    spark.range(300).selectExpr("id", "concat('v', id % 7) as a", "cast(id % 3 as string) as b").write.parquet(path)
    df = spark.read.parquet(path)
    calls = []
    for name in ("value_groups", "_texts", "_tied"):
        monkeypatch.setattr(P, name, lambda *args, f=getattr(P, name), n=name: calls.append(n) or f(*args))
    P.profile_columns(df)
    assert calls == ["value_groups", "_texts"]


@pytest.mark.parametrize("kind", ["unique", "paired", "mixed", "short"])
def test_ties_beyond_the_known_beginning(spark, kind):
    """Texts with a long common beginning that occur equally often are ordered as a whole."""
    r = random.Random(4)
    if kind == "unique":
        values = [f"Customer#{r.randrange(10**9):012d}" for _ in range(400)]
    elif kind == "paired":
        values = [f"Customer#{i * 7919 % 1000:012d}" for i in range(200)] * 2
    elif kind == "mixed":
        values = ["Customer#00000009"] * 9 + ["aaa"] * 4 + [f"Customer#00000{r.randrange(10**4)}é{'x' * (i % 3)}" for i in range(60)] * 2 + ["Customer#000000"] * 2
    else:
        values = ["", "a", "ab", "ab\x00", "abc", "b", "ß", "日本", "😀", "z" * 40] * 3 + [None] * 4
    r.shuffle(values)
    got = by_column(profile_table(spark.createDataFrame([(v,) for v in values], "c string").repartition(3)))["c"]
    counts = Counter(v for v in values if v is not None)
    want = sorted(counts.items(), key=lambda p: (-p[1], p[0].encode()))[:5]
    assert [tuple(t) for t in got.top_values] == want
    assert (got.min_text, got.max_text) == (min(counts, key=str.encode), max(counts, key=str.encode))
    assert got.distinct_count == len(counts) and got.null_count == values.count(None)


def test_numbers_far_from_zero_keep_their_spread(spark):
    df = spark.range(1000).selectExpr("1e9 + (id % 10) as x", "cast(1e12 as bigint) + (id % 4) as n", "cast(id % 5 as decimal(20, 3)) as d",
                                      "if(id % 2 = 0, double('nan'), -0.0) as z", "cast((id % 3) / 3 as float) as f")
    got = by_column(profile_table(df))
    assert got["x"].stddev == pytest.approx(2.8737, abs=1e-3) and got["n"].stddev == pytest.approx(1.1186, abs=1e-3)
    assert got["d"]["mean"] == 2.0 and got["d"].top_values[0].value == "0.000" and got["d"].max_text == "4.0"
    assert (got["z"].null_count, got["z"].distinct_count, got["z"].top_values[0].value, got["z"].min_value) == (500, 1, "0.0", 0.0)
    assert [t.value for t in got["f"].top_values] == ["0.0", "0.33333334", "0.6666667"]


def test_times_and_many_columns(spark):
    df = spark.sql("""select timestamp'2024-03-01 10:00:00' + make_interval(0, 0, 0, id % 3) as t, date'1969-12-30' + cast(id % 4 as int) as d,
                      id % 2 = 0 as b, cast(null as string) as s, cast(null as int) as i from range(40)""")
    got = by_column(profile_table(df))
    assert (got["t"].min_text, got["t"].max_text) == ("2024-03-01 10:00:00", "2024-03-03 10:00:00")
    assert (got["d"].min_text, got["d"].max_text, got["d"].distinct_count) == ("1969-12-30", "1970-01-02", 4)
    assert got["b"].min_text == "0.0" and {t.value for t in got["b"].top_values} == {"true", "false"}
    assert got["s"].null_count == 40 and got["s"].top_values == [] and got["s"].min_text is None and got["s"].inferred_pattern is None
    wide = spark.range(30).selectExpr(*[f"concat('c', id % {n + 1}) as c{n}" for n in range(130)])
    got = by_column(profile_table(wide))
    assert all(got[f"c{n}"].distinct_count == min(n + 1, 30) and got[f"c{n}"].min_text == "c0" for n in range(130))
