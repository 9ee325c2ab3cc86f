"""Adaptive thresholds on daily and monthly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import adapt as A
from .checks import monthly_results, oracle as results_oracle
from .registry import over, query, table, with_views

# Every user stands for a rule; each day gives one observation.
_OBS = """select concat('u', cast(user_id as string)) as rule_id,
    cast(floor((unix_seconds(cast(ts as timestamp)) - unix_seconds(timestamp '2024-01-01 00:00:00')) / 86400) as bigint) as seq,
    cast(count(case when value > 40 then 1 end) as double) / count(*) as x from events group by 1, 2"""
_OBS_DUCK = _OBS.replace("unix_seconds(cast(ts as timestamp)) - unix_seconds(timestamp '2024-01-01 00:00:00')",
                         "epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')").replace("/ 86400", "/ 86400000000")
_RULES = """select concat('u', cast(user_id as string)) as rule_id,
    case cast(user_id % 4 as int) when 0 then 'completeness' when 1 then 'uniqueness' when 2 then 'custom_sql' else 'pattern' end as rule_type,
    case when user_id % 3 = 0 then cast(0.9 as double) else cast(0.02 as double) end as threshold,
    user_id % 10 <> 0 as adaptive, 'active' as status from (select distinct user_id from events)"""
_EWMA = """select rule_id, seq, rn, x as mean, 0::double as var from ordered where rn = 1
    union all select o.rule_id, o.seq, o.rn, e.mean + 0.3::double * (o.x - e.mean),
      0.7::double * (e.var + 0.3::double * (o.x - e.mean) * (o.x - e.mean))
    from ew e join ordered o on o.rule_id = e.rule_id and o.rn = e.rn + 1"""
_STATE = """select rule_id, least(rn, 200) as n, mean, var, seq as last_seq from
    (select *, row_number() over (partition by rule_id order by rn desc) as b from ew) where b = 1"""
_SUGGESTED = """select s.*, r.rule_type, r.threshold, r.adaptive, case when n >= 5 then round(
      case when rule_type in ('uniqueness', 'pattern') then greatest(0, mean - 2 * sqrt(var))
           when rule_type in ('completeness', 'range', 'referential') then least(1, mean + 2 * sqrt(var))
           else mean + 2 * sqrt(var) end, 6) end as suggested from state s join rules r using (rule_id)"""
_CLASSIFIED = """select *, abs(suggested - threshold) / greatest(abs(threshold), 1e-9) as relative_change,
    case when suggested is null or not adaptive or abs(suggested - threshold) / greatest(abs(threshold), 1e-9) < 0.01 then 'none'
         when abs(suggested - threshold) / greatest(abs(threshold), 1e-9) <= 0.2 then 'auto' else 'reapproval' end as change
    from suggested"""
_VIEWS = {
    "obs": _OBS_DUCK, "rules": _RULES,
    "ordered": "select *, row_number() over (partition by rule_id order by seq) as rn from obs",
    "ew": _EWMA, "state": _STATE, "suggested": _SUGGESTED, "classified": _CLASSIFIED,
}


def oracle(body: str, **extra: str) -> str:
    return with_views(body, **_VIEWS, **extra)


def observations(spark, sf_dir):
    return over(spark, _OBS, "events", table(spark, sf_dir, "events"))


def rules(spark, sf_dir):
    return over(spark, _RULES, "events", table(spark, sf_dir, "events"))


@query("ewma_fold", oracle("select rule_id, n, round(mean, 9) as mean, round(var, 9) as var, last_seq from state"))
def ewma_fold(spark, sf_dir):
    return A.ewma_fold(observations(spark, sf_dir)).select(
        "rule_id", "n", F.round("mean", 9).alias("mean"), F.round("var", 9).alias("var"), "last_seq")


@query("ewma_resume", oracle("select rule_id, n, round(mean, 9) as mean, round(var, 9) as var, last_seq from state"))
def ewma_resume(spark, sf_dir):
    """The same result when the first half is folded before the second."""
    obs = observations(spark, sf_dir)
    half = A.ewma_fold(obs.filter("seq < 15"))
    return A.ewma_fold(obs.filter("seq >= 15"), half).select(
        "rule_id", "n", F.round("mean", 9).alias("mean"), F.round("var", 9).alias("var"), "last_seq")


@query("observation_count", oracle("select rule_id, least(count(*), 200) as n from obs group by 1"))
def observation_count(spark, sf_dir):
    return A.observation_count(observations(spark, sf_dir))


@query("cap_history", """select o_orderpriority as rule_id, o_orderkey as seq, o_totalprice as x from
    (select *, row_number() over (partition by o_orderpriority order by o_orderkey desc) as age from orders) where age <= 200""")
def cap_history(spark, sf_dir):
    return A.capped_history(table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("rule_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("x")))


@query("record_observations", results_oracle(
    "select rule_id, seq, metric_value as x from results where status in ('pass', 'warn') and metric_value is not null"))
def record_observations(spark, sf_dir):
    return A.observations(monthly_results(spark, sf_dir))


@query("suggest_threshold", oracle("select rule_id, suggested from suggested"))
def suggest_threshold(spark, sf_dir):
    state = A.ewma_fold(observations(spark, sf_dir))
    return A.suggestions(state, rules(spark, sf_dir)).select("rule_id", "suggested")


@query("classify_change", oracle("select rule_id, round(relative_change, 3) as relative_change, change from classified"))
def classify_change(spark, sf_dir):
    state = A.ewma_fold(observations(spark, sf_dir))
    return A.suggestions(state, rules(spark, sf_dir)).select(
        "rule_id", F.round("relative_change", 3).alias("relative_change"), "change")


@query("adapt_step", oracle("""select rule_id, threshold as old_threshold, suggested as new_threshold,
    'EWMA-based auto-tune from ' || n || ' observations (mean=' || printf('%.4f', mean) || ', std=' || printf('%.4f', sqrt(var))
      || '); relative_change=' || printf('%.1f%%', relative_change * 100) as reason, change = 'reapproval' as required_reapproval
    from classified where change <> 'none'"""))
def adapt_step(spark, sf_dir):
    """One step after the last day, with the state of all days before it."""
    from ...session import cut_lineage
    obs = observations(spark, sf_dir)
    # Resuming from a prefix of each rule's own history gives the state of the whole.
    last = obs.groupBy("rule_id").agg(F.max("seq").alias("last"))
    marked = cut_lineage(obs.join(last, "rule_id"))
    before = A.ewma_fold(marked.filter("seq < last").drop("last"))
    results = marked.filter("seq = last").select(
        "rule_id", "seq", F.col("x").alias("metric_value"), F.lit("pass").alias("status"))
    _, changes = A.adapt_step(results, rules(spark, sf_dir), before, 0.0)
    return changes.select("rule_id", "old_threshold", "new_threshold", "reason",
                          "required_reapproval")


_STEP = """select rule_id, seq, rn, least(rn, 200) as n, mean, var, old_threshold, suggested, rc, kind,
      case when kind = 'none' then old_threshold else suggested end as threshold,
      case when kind = 'reapproval' then 'approved' else status end as status, rule_type, adaptive
    from (select *, case when rc is null or rc < 0.01 then 'none' when rc <= 0.2 then 'auto' else 'reapproval' end as kind
      from (select *, abs(suggested - old_threshold) / greatest(abs(old_threshold), 1e-9) as rc
        from (select *, case when adaptive and rn >= 5 then round(
            case when rule_type in ('uniqueness', 'pattern') then greatest(0, mean - 2 * sqrt(var))
                 when rule_type in ('completeness', 'range', 'referential') then least(1, mean + 2 * sqrt(var))
                 else mean + 2 * sqrt(var) end, 6) end as suggested from ({source}))))"""
_REPLAY = (_STEP.format(source="""select o.rule_id, o.seq, o.rn, o.x as mean, 0::double as var, r.threshold as old_threshold,
        r.status, r.rule_type, r.adaptive from ordered o join rules r using (rule_id) where o.rn = 1""")
    + " union all " + _STEP.format(source="""select o.rule_id, o.seq, o.rn, e.mean + 0.3::double * (o.x - e.mean) as mean,
        0.7::double * (e.var + 0.3::double * (o.x - e.mean) * (o.x - e.mean)) as var, e.threshold as old_threshold,
        e.status, e.rule_type, e.adaptive from rp e join ordered o on o.rule_id = e.rule_id and o.rn = e.rn + 1"""))


@query("adapt_replay", oracle(
    "select rule_id, seq, n, mean, threshold, kind as change, status from rp", rp=_REPLAY))
def adapt_replay(spark, sf_dir):
    return A.adapt_replay(observations(spark, sf_dir), rules(spark, sf_dir)).select(
        "rule_id", "seq", "n", "mean", "threshold", "change",
        "status")
