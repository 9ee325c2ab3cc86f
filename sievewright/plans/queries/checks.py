"""Checks, statuses, samples, gate and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import coerce
from ...functions.patterns import NAMED_PATTERNS
from ...operators import gate as G, incidents as I
from ...operators.checks import CheckPlan, check_status, evaluate, predicate_column, reference_keys
from ...schemas import HIGHER_IS_BETTER, Rule
from .registry import MONTH_SEQ, dirty, joined, over, query, table, with_views

AS_OF = "2002-01-01 00:00:00"
TABLE = "shop.orders"
VALID = "o_totalprice > 0 and o_orderpriority <> 'bad'"

RULES = [
    Rule("r01", TABLE, "o_custkey", "completeness", 0.07, "warn"),
    Rule("r02", TABLE, "o_orderkey", "uniqueness", 0.999, "critical"),
    Rule("r03", TABLE, "o_totalprice", "range", 0.03, "critical", {"min": 0, "max": 1000000}),
    Rule("r04", TABLE, "o_orderdate_text", "pattern", 0.97, "info", {"pattern_name": "date_iso"}),
    Rule("r05", TABLE, "o_orderdate", "freshness", 3000.0, "warn"),
    Rule("r06", TABLE, "o_custkey", "referential", 0.05, "critical",
         {"ref_table": "customer", "ref_column": "c_custkey"}),
    Rule("r07", TABLE, None, "custom_sql", 0.1, "warn", {"valid_expr": VALID}),
    Rule("r08", TABLE, "o_orderpriority", "referential", 0.05, "info",
         {"ref_values": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}),
]
BROKEN = [
    Rule("e01", TABLE, "no_such_column", "completeness", 0.1, "critical"),
    Rule("e02", TABLE, None, "custom_sql", 0.1, "warn", {}),
    Rule("e03", TABLE, "o_custkey", "novelty", 0.1, "warn"),
    Rule("e04", TABLE, "o_orderdate_text", "pattern", 0.9, "warn", {}),
]


# -- the same checks in SQL ------------------------------------------------
def _text(value) -> str:
    return "null" if value is None else "'" + str(value).replace("'", "''") + "'"


def _pct(x: str) -> str:
    return f"printf('%.2f%%', ({x}) * 100)"


def rule_oracle(rule: Rule, source: str, batch: str, as_of: str = AS_OF) -> str:
    """Select (batch_id, rule attributes, metric_value, message) of one rule."""
    c, p, limit = rule.column, rule.params, f"{rule.threshold:.2%}"
    join = ""
    if rule.rule_type == "completeness":
        metric = f"coalesce(count(*) filter ({c} is null)::double / nullif(count(*), 0), 0)"
        message = f"'Null rate ' || {_pct('m')} || ' (max allowed {limit})'"
    elif rule.rule_type == "uniqueness":
        metric = f"coalesce(count(distinct {c})::double / nullif(count({c}), 0), 1)"
        message = f"'Distinct rate ' || {_pct('m')} || ' (min required {limit})'"
    elif rule.rule_type == "range":
        x = f"try_cast({c} as double)"
        bad = " or ".join([f"{x} < {p['min']}"] * ("min" in p) + [f"{x} > {p['max']}"] * ("max" in p))
        metric = f"coalesce(count(*) filter ({bad})::double / nullif(count({x}), 0), 0)"
        message = f"{_pct('m')} || ' of values outside [{p.get('min')}, {p.get('max')}]'"
    elif rule.rule_type == "pattern":
        regex = p.get("regex") or NAMED_PATTERNS[p["pattern_name"]]
        good = f"regexp_matches({c}::varchar, {_text('^(?:' + regex + ')')})"
        metric = f"coalesce(count(*) filter ({good})::double / nullif(count({c}), 0), 1)"
        message = f"{_pct('m')} || ' matched pattern (min required {limit})'"
    elif rule.rule_type == "freshness":
        metric = f"(epoch_us(timestamp '{as_of}') - epoch_us(max({c}))) / 3.6e9"
        message = f"'Most recent {c} is ' || printf('%.1f', m) || 'h old (max allowed {rule.threshold}h)'"
    elif rule.rule_type == "referential":
        if "ref_table" in p:
            join = f" left join (select distinct {p['ref_column']} as k from {p['ref_table']}) r on {c} = r.k"
            absent = f"{c} is not null and r.k is null"
        else:
            absent = f"{c} not in ({', '.join(_text(v) for v in p['ref_values'])})"
        metric = f"coalesce(count(*) filter ({absent})::double / nullif(count({c}), 0), 0)"
        message = f"{_pct('m')} || ' of values not found in reference set'"
    else:
        metric = (f"coalesce(count(*) filter (not coalesce({p['valid_expr']}, false))::double "
                  "/ nullif(count(*), 0), 0)")
        message = f"{_pct('m')} || ' of rows violate ' || {_text(chr(39) + p['valid_expr'] + chr(39))}"
    attrs = (f"{_text(rule.rule_id)} as rule_id, {_text(rule.table_fq_name)} as table_fq_name, "
             f"{_text(c)}::varchar as \"column\", {_text(rule.rule_type)} as rule_type, "
             f"{rule.threshold}::double as threshold, {_text(rule.severity)} as severity")
    group = "" if batch.startswith("'") else " group by 1"
    return (f"select batch_id, {attrs}, m as metric_value, {message} as message from "
            f"(select {batch} as batch_id, {metric} as m from {source}{join}{group})")


STATUS_SQL = """case when metric_value is null then 'error' when rule_type in ('uniqueness', 'pattern') then
    case when metric_value >= threshold then 'pass'
         when metric_value >= threshold - greatest(threshold, 0.01) * 0.15::double then 'warn' else 'fail' end
  else case when metric_value <= threshold then 'pass'
         when metric_value <= threshold + greatest(threshold, 0.01) * 0.15::double then 'warn' else 'fail' end end"""


def results_oracle(rules: list[Rule], source: str = "orders_dirty", batch: str = "batch_id") -> str:
    union = "\nunion all ".join(rule_oracle(r, source, batch) for r in rules)
    seq = MONTH_SEQ if batch == "batch_id" else "0"
    return f"select *, {STATUS_SQL} as status, ({seq})::bigint as seq from ({union})"


def monthly_results(spark: SparkSession, sf_dir: str, rules: list[Rule] | None = None,
                    samples: bool = False) -> DataFrame:
    """Results of every month of the faulty orders, one job for all batches."""
    return evaluate(dirty(spark, sf_dir, "orders_dirty"), rules or RULES, batch_col="batch_id",
                    resolve=lambda t: table(spark, sf_dir, t), as_of=F.to_timestamp(F.lit(AS_OF)),
                    seq=F.expr(MONTH_SEQ), samples=samples)


def oracle(body: str, rules: list[Rule] | None = None, **extra: str) -> str:
    """`body` over a subquery `results` with the monthly results."""
    return with_views(body, "orders_dirty", results=results_oracle(rules or RULES), **extra)


COLUMNS = ("batch_id", "rule_id", "table_fq_name", "column", "rule_type", "status", "metric_value",
           "threshold", "severity", "message")
SHOWN = ", ".join(f'"{c}"' for c in COLUMNS)


# -- one query per check type, on whole tables ----------------------------
def _whole(rule: Rule, source: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = (table if source in ("documents", "lineitem", "events") else dirty)(spark, sf_dir, source)
        return evaluate(df, [rule], batch_id="all", as_of=F.to_timestamp(F.lit(AS_OF)), samples=False,
                        resolve=lambda t: table(spark, sf_dir, t)).select(*COLUMNS)
    views = [source] if source.endswith("_dirty") else []
    sql = with_views(f"select {SHOWN} from results", *views,
                     results=results_oracle([rule], source, "'all'"))
    return run, sql


_SINGLE = {
    "check_completeness": (RULES[0], "orders_dirty"),
    "check_uniqueness": (RULES[1], "orders_dirty"),
    "check_range": (RULES[2], "orders_dirty"),
    "check_pattern": (Rule("p01", "crm.customer", "c_email", "pattern", 0.9, "warn", {"pattern_name": "email"}),
                      "customer_dirty"),
    "check_freshness": (RULES[4], "orders_dirty"),
    "check_referential": (RULES[5], "orders_dirty"),
    "check_custom": (RULES[6], "orders_dirty"),
    "referential_check": (Rule("d01", "text.documents", "doc_id", "referential", 0.0, "critical",
                               {"ref_table": "labels", "ref_column": "doc_id"}), "documents"),
    "referential_literal": (RULES[7], "orders_dirty"),
    "uniqueness_of_texts": (Rule("d02", "text.documents", "text", "uniqueness", 0.99, "warn"), "documents"),
}
for _name, (_rule, _source) in _SINGLE.items():
    _run, _sql = _whole(_rule, _source)
    query(_name, _sql)(_run)


@query("check_all", oracle(f"select {SHOWN}, seq from results"))
def check_all(spark, sf_dir):
    return monthly_results(spark, sf_dir).select(*COLUMNS, "seq")


@query("concat_results", with_views(
    f"select {SHOWN} from o union all select {SHOWN} from c", "orders_dirty", "customer_dirty",
    o=results_oracle(RULES, "orders_dirty", "'all'"),
    c=results_oracle([_SINGLE["check_pattern"][0]], "customer_dirty", "'all'")))
def concat_results(spark, sf_dir):
    as_of = F.to_timestamp(F.lit(AS_OF))
    orders = evaluate(dirty(spark, sf_dir, "orders_dirty"), RULES, batch_id="all", as_of=as_of,
                      samples=False, resolve=lambda t: table(spark, sf_dir, t))
    customers = evaluate(dirty(spark, sf_dir, "customer_dirty"), [_SINGLE["check_pattern"][0]], batch_id="all",
                         as_of=as_of, samples=False)
    return orders.unionByName(customers).select(*COLUMNS)


@query("check_status", with_views(
    f"select o_orderkey, round(metric_value, 9) as metric_value, {STATUS_SQL} as status from m", m="""
    select o_orderkey, o_totalprice / 500000 as metric_value, 0.5::double as threshold,
           case when o_orderpriority = '5-LOW' then 'pattern' else 'range' end as rule_type from orders"""))
def status_of_metrics(spark, sf_dir):
    metric = F.col("o_totalprice") / 500000
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(metric, 9).alias("metric_value"),
        check_status(metric, F.lit(0.5), F.col("o_orderpriority") == "5-LOW").alias("status"))


@query("check_error", with_views("""
    select batch_id, rule_id, 'error' as status, null::double as metric_value, message
    from (select distinct batch_id from orders_dirty),
      (values ('e01', 'Check errored: column ''no_such_column'' not found'),
              ('e02', 'Check errored: No ''valid_expr'' configured for custom rule e02'),
              ('e03', 'Unknown rule_type novelty'),
              ('e04', 'Check errored: No regex/pattern_name configured for rule e04')) v(rule_id, message)""",
    "orders_dirty"))
def check_error(spark, sf_dir):
    return monthly_results(spark, sf_dir, BROKEN).select("batch_id", "rule_id", "status", "metric_value", "message")


@query("resolve_reference", "select distinct doc_id as ref from labels where doc_id is not null")
def resolve_reference(spark, sf_dir):
    return reference_keys(table(spark, sf_dir, "labels"), "doc_id")


_VIOLATIONS = """
    select batch_id, 'r02' as rule_id, o_orderkey::varchar as v from orders_dirty
        where o_orderkey is not null group by batch_id, o_orderkey having count(*) > 1
    union all select batch_id, 'r03', o_totalprice::varchar from orders_dirty where o_totalprice < 0 or o_totalprice > 1000000
    union all select batch_id, 'r04', o_orderdate_text from orders_dirty
        where not regexp_matches(o_orderdate_text, '^\\d{4}-\\d{2}-\\d{2}$')
    union all select distinct batch_id, 'r06', o_custkey::varchar from orders_dirty
        where o_custkey is not null and o_custkey not in (select c_custkey from customer)
    union all select distinct batch_id, 'r08', o_orderpriority from orders_dirty where o_orderpriority = 'bad'"""


@query("sample_violations", with_views(
    """select batch_id, rule_id, string_agg(v, '|' order by v) as sample from (
         select *, row_number() over (partition by batch_id, rule_id order by v) as n from violations) where n <= 10
       group by all""", "orders_dirty", violations=_VIOLATIONS))
def sample_violations(spark, sf_dir):
    chosen = [r for r in RULES if r.rule_id in ("r02", "r03", "r04", "r06", "r08")]
    plan = CheckPlan(dirty(spark, sf_dir, "orders_dirty"), chosen, batch_col="batch_id",
                     resolve=lambda t: table(spark, sf_dir, t))
    ids = F.element_at(F.array(*[F.lit(r.rule_id) for r in chosen]), F.col("pos") + 1)
    return plan.samples().select("batch_id", ids.alias("rule_id"), joined("sample_violations").alias("sample"))


# -- predicates ------------------------------------------------------------
@query("where_filter", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45 and l_discount < 0.02")
def where_filter(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter(F.expr("l_quantity > 45 and l_discount < 0.02")).select(
        "l_orderkey", "l_linenumber", "l_quantity")


@query("drop_nulls", with_views(
    "select batch_id, count(o_custkey) as live, count(*) - count(o_custkey) as missing from orders_dirty group by 1",
    "orders_dirty"))
def drop_nulls(spark, sf_dir):
    df = dirty(spark, sf_dir, "orders_dirty")
    dtype = df.schema["o_custkey"].dataType
    return df.groupBy("batch_id").agg(
        F.count_if(coerce.present(F.col("o_custkey"), dtype)).alias("live"),
        F.count_if(coerce.is_missing(F.col("o_custkey"), dtype)).alias("missing"))


_MIXED = """select c_custkey, case when c_custkey % 5 = 0 then c_email when c_custkey % 7 = 1 then '12d'
    when c_custkey % 7 = 2 then '0x10' when c_custkey % 7 = 3 then '' else c_acctbal_text end as t from customer_dirty"""


@query("to_numeric_coerce", with_views(
    """select c_custkey, case when t in ('12d', '0x10') then null else try_cast(t as double) end as x from mixed""",
    "customer_dirty", mixed=_MIXED))
def to_numeric_coerce(spark, sf_dir):
    mixed = over(spark, _MIXED, "customer_dirty", dirty(spark, sf_dir, "customer_dirty"))
    return mixed.select("c_custkey", coerce.to_number(F.col("t"), mixed.schema["t"].dataType).alias("x"))


@query("to_timestamp_coerce", with_views(
    """select batch_id, count(ts) as parsed, count(*) as total, epoch_us(max(ts)) as latest_us from (
         select batch_id, try_cast(o_orderdate_text as timestamp) as ts from orders_dirty) group by 1""",
    "orders_dirty"))
def to_timestamp_coerce(spark, sf_dir):
    df = dirty(spark, sf_dir, "orders_dirty")
    ts = coerce.to_timestamp(F.col("o_orderdate_text"), df.schema["o_orderdate_text"].dataType)
    return df.groupBy("batch_id").agg(
        F.count(ts).alias("parsed"), F.count(F.lit(1)).alias("total"), F.unix_micros(F.max(ts)).alias("latest_us"))


@query("valid_expr_predicate", with_views(
    f"select batch_id, count(*) filter (coalesce({VALID}, false)) as valid, count(*) as total from orders_dirty group by 1",
    "orders_dirty"))
def valid_expr_predicate(spark, sf_dir):
    df = dirty(spark, sf_dir, "orders_dirty")
    return df.withColumn("ok", predicate_column(df, VALID)).groupBy("batch_id").agg(
        F.count_if("ok").alias("valid"), F.count(F.lit(1)).alias("total"))


@query("row_limit_columns", with_views(
    """select o_orderkey, json_object('o_orderkey', o_orderkey, 'o_orderpriority', o_orderpriority)::varchar as record
       from orders_dirty where o_orderpriority = 'bad'""", "orders_dirty"))
def row_limit_columns(spark, sf_dir):
    df = dirty(spark, sf_dir, "orders_dirty").select("o_orderkey", "o_orderpriority")
    return df.filter("o_orderpriority = 'bad'").select(
        "o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderpriority")).alias("record"))


@query("rule_result_zip", oracle(
    "select r.batch_id, r.rule_id, v.adaptive, r.status from results r join "
    "(values ('r01', true), ('r02', true), ('r03', false), ('r04', true), ('r05', false), ('r06', true), "
    "('r07', true), ('r08', true)) v(rule_id, adaptive) using (rule_id)"))
def rule_result_zip(spark, sf_dir):
    rules = spark.createDataFrame([(r.rule_id, r.rule_id not in ("r03", "r05")) for r in RULES],
                                  "rule_id string, adaptive boolean")
    return monthly_results(spark, sf_dir).join(rules, "rule_id").select("batch_id", "rule_id", "adaptive", "status")


# -- gate and incidents ----------------------------------------------------
_CRITICAL = "severity = 'critical' and status = 'fail'"
_PROBLEM = "status in ('fail', 'warn')"
_REASON = "\"column\" is null"
_GATE = f"""
    select table_fq_name, batch_id,
      case when bool_or({_CRITICAL}) then 'block' when bool_or({_PROBLEM}) then 'pass_with_warnings' else 'pass' end as decision,
      coalesce(case when bool_or({_CRITICAL}) then
          string_agg('CRITICAL FAIL: ' || coalesce("column", 'None') || ' ' || rule_type || ' — ' || message, '|' order by rule_id) filter ({_CRITICAL})
        else string_agg(upper(status) || ': ' || coalesce("column", 'None') || ' ' || rule_type || ' — ' || message, '|' order by rule_id) filter ({_PROBLEM}) end, '') as reasons
    from results group by 1, 2"""


def _gate(spark, sf_dir):
    return G.gate(monthly_results(spark, sf_dir))


@query("gate_decision", oracle("select table_fq_name, batch_id, decision from g", g=_GATE))
def gate_decision(spark, sf_dir):
    return _gate(spark, sf_dir).select("table_fq_name", "batch_id", "decision")


@query("gate", oracle("select * from g", g=_GATE))
def gate_with_reasons(spark, sf_dir):
    return _gate(spark, sf_dir).withColumn("reasons", joined("reasons"))


@query("released_batch", oracle(
    "select o.batch_id, count(*) as n, count(*) filter (o_totalprice < 0) as negative from orders_dirty o join g using (batch_id) "
    "where decision <> 'block' group by 1", g=_GATE))
def released_batch(spark, sf_dir):
    flowing = G.released(dirty(spark, sf_dir, "orders_dirty"), _gate(spark, sf_dir))
    return flowing.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"),
                                           F.count_if(F.col("o_totalprice") < 0).alias("negative"))


@query("issues_minus_critical", oracle(f"select batch_id, rule_id, status from results where {_PROBLEM} and not ({_CRITICAL})"))
def issues_minus_critical(spark, sf_dir):
    return G.issues_minus_critical(monthly_results(spark, sf_dir)).select("batch_id", "rule_id", "status")


_RANK = "case severity when 'critical' then 2 when 'warn' then 1 else 0 end"


@query("overall_severity", oracle(
    f"select batch_id, arg_max(severity, {_RANK}) as severity from results where {_PROBLEM} group by 1"))
def overall_severity(spark, sf_dir):
    return I.incidents(monthly_results(spark, sf_dir)).select("batch_id", "severity")


@query("incident_rule_set", oracle(
    f"select batch_id, string_agg(distinct rule_id, ',' order by rule_id) as rule_ids from results where {_PROBLEM} group by 1"))
def incident_rule_set(spark, sf_dir):
    return I.incidents(monthly_results(spark, sf_dir)).select("batch_id", joined("rule_ids", ",").alias("rule_ids"))


@query("tables_in_ticket", oracle(
    f"select severity, string_agg(distinct table_fq_name, ', ' order by table_fq_name) as tables from results where {_PROBLEM} group by 1"))
def tables_in_ticket(spark, sf_dir):
    return I.tables_named(monthly_results(spark, sf_dir), ["severity"])


_WORST = f"""select * from (select *, row_number() over (partition by batch_id
    order by {_RANK} desc, (status = 'fail')::int desc, rule_id) as n from results where {_PROBLEM}) where n = 1"""


@query("worst_result", oracle(
    "select batch_id, rule_id, status, severity, metric_value from w", w=_WORST))
def worst_result(spark, sf_dir):
    return I.worst_result(monthly_results(spark, sf_dir)).select("batch_id", "rule_id", "status", "severity", "metric_value")


_INCIDENTS = f"""select table_fq_name, batch_id, max(seq) as seq, count(*) as problems,
    arg_max(severity, {_RANK}) as severity, string_agg(distinct rule_id, ',' order by rule_id) as rule_key
    from results where {_PROBLEM} group by 1, 2"""


@query("incident", oracle(
    "select i.*, w.rule_id as worst_rule_id from i join w using (batch_id)", i=_INCIDENTS, w=_WORST))
def incident(spark, sf_dir):
    return I.incidents(monthly_results(spark, sf_dir)).select(
        "table_fq_name", "batch_id", "seq", "problems", "severity", joined("rule_ids", ",").alias("rule_key"),
        "worst_rule_id")
