"""Rule log, threshold history and tickets, on events derived from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import adapt, incidents as I, rules as R
from ...operators.knowledge import latest
from ...schemas import RULES
from .checks import _INCIDENTS, _WORST, monthly_results, oracle as results_oracle
from .registry import joined, over, query, table, with_views

# Every customer stands for a rule, every order for an event on the rule of its customer.
_STATUS = """case o_orderpriority when '1-URGENT' then 'approved' when '2-HIGH' then 'active'
    when '3-MEDIUM' then 'rejected' when '4-NOT SPECIFIED' then case when o_totalprice < 250000 then 'retired' else 'proposed' end end"""
_RULE_COLUMNS = """concat('rule_', cast(c_custkey as string)) as rule_id, concat('crm.', c_mktsegment) as table_fq_name,
    concat('col_', cast(c_nationkey as string)) as "column",
    case when c_acctbal < 0 then 'range' when c_nationkey < 10 then 'completeness' else 'uniqueness' end as rule_type,
    cast(0.02 as double) as threshold, 'warn' as severity, 'proposed' as status"""
_CHANGES = f"""select o_orderkey + 1 as seq, concat('rule_', cast(o_custkey as string)) as rule_id,
    {_STATUS} as new_status, cast(o_orderkey as double) as stamp from orders where o_orderpriority <> '5-LOW'"""
_HISTORY = """select concat('rule_', cast(o_custkey as string)) as rule_id, (o_totalprice - 1000) / 1000000 as old_threshold,
    o_totalprice / 1000000 as new_threshold, cast(o_orderkey as double) as changed_at, 'drift' as reason, true as auto_adjusted,
    o_totalprice > 250000 as required_reapproval from orders where o_orderpriority = '5-LOW'"""
_CURRENT = """
    select r.rule_id, table_fq_name, "column", rule_type, coalesce(e.last_threshold, r.threshold) as threshold, severity,
      coalesce(e.last_status, r.status) as status, coalesce(e.updated_at, 0::double) as updated_at,
      coalesce(e.changes, 0)::int + 1 as version
    from rules r left join (
      select rule_id, arg_max(new_status, seq) filter (new_status is not null) as last_status,
        arg_max(new_threshold, seq) filter (new_threshold is not null) as last_threshold,
        arg_max(stamp, seq) as updated_at, count(new_threshold) as changes
      from (select seq, rule_id, new_status, null::double as new_threshold, stamp from changes
            union all select changed_at::bigint + 1, rule_id, case when required_reapproval then 'approved' end,
              new_threshold, changed_at from history) group by 1) e using (rule_id)"""
_VIEWS = {"rules": f"select {_RULE_COLUMNS} from customer", "changes": _CHANGES, "history": _HISTORY}


def oracle(body: str) -> str:
    return with_views(body, **_VIEWS, cur=_CURRENT)


def rule_rows(spark, sf_dir):
    rules = spark.sql(f"select {_RULE_COLUMNS.replace(chr(34) + 'column' + chr(34), '`column`')} from {{c}}",
                      c=table(spark, sf_dir, "customer"))
    rest = {"params": F.lit("{}"), "rationale": F.lit(""), "adaptive": F.lit(True), "created_by": F.lit("system"),
            "created_at": F.lit(0.0), "updated_at": F.lit(0.0), "version": F.lit(1)}
    return rules.withColumns(rest).select(*[f.name for f in RULES.fields])


def changes(spark, sf_dir):
    return spark.sql(_CHANGES.replace("from orders", "from {o}"), o=table(spark, sf_dir, "orders")
                     ).withColumnRenamed("stamp", "at")


def history(spark, sf_dir):
    return over(spark, _HISTORY, "orders", table(spark, sf_dir, "orders"))


def rule_log(spark, sf_dir):
    return (R.add_events(rule_rows(spark, sf_dir), F.lit(0))
            .unionByName(R.status_events(changes(spark, sf_dir)))
            .unionByName(R.threshold_events(history(spark, sf_dir), F.col("changed_at").cast("long") + 1)))


_SHOWN = ["rule_id", "table_fq_name", "column", "rule_type", "threshold", "severity", "status", "updated_at", "version"]
_SHOWN_SQL = ", ".join(f'"{c}"' for c in _SHOWN)


def current(spark, sf_dir):
    return R.current_rules(rule_log(spark, sf_dir)).select(*_SHOWN)


@query("apply_rule_events", oracle(f"select {_SHOWN_SQL} from cur"))
def apply_rule_events(spark, sf_dir):
    return current(spark, sf_dir)


@query("current_rules", oracle(f"select {_SHOWN_SQL} from cur where table_fq_name = 'crm.BUILDING'"))
def current_rules(spark, sf_dir):
    return R.rules_where(current(spark, sf_dir), "crm.BUILDING")


@query("active_rules_filter", oracle(f"select {_SHOWN_SQL} from cur where status = 'active'"))
def active_rules(spark, sf_dir):
    return R.rules_where(current(spark, sf_dir), status="active")


@query("pending_rules", oracle("select rule_id, status from cur where table_fq_name = 'crm.BUILDING' and status = 'proposed'"))
def pending_rules(spark, sf_dir):
    return R.pending_rules(current(spark, sf_dir), "crm.BUILDING").select("rule_id", "status")


@query("activate_approved", oracle(
    "select rule_id, 'active' as new_status from cur where table_fq_name = 'crm.MACHINERY' and status = 'approved'"))
def activate_approved(spark, sf_dir):
    events = R.activate_approved(current(spark, sf_dir), "crm.MACHINERY", F.lit(10**12), 0.0)
    return events.select("rule_id", "new_status")


@query("add_rules", oracle("""select rule_id, threshold, status from rules where rule_id not in
    (select concat('rule_', cast(o_custkey as string)) from orders where o_totalprice > 400000)"""))
def add_rules(spark, sf_dir):
    known = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(
        F.concat(F.lit("rule_"), F.col("o_custkey").cast("string")).alias("rule_id"))
    return R.add_events(rule_rows(spark, sf_dir), F.lit(0), known).select("rule_id", "threshold", "status")


@query("update_threshold", oracle("""
    select c.rule_id, cur.threshold as old_threshold, c.new_threshold, 0::double as changed_at, 'manual' as reason,
      false as auto_adjusted, c.new_threshold > 0.4 as required_reapproval
    from (select concat('rule_', cast(o_custkey as string)) as rule_id, max(o_totalprice) / 1000000 as new_threshold
          from orders group by 1) c join cur using (rule_id)"""))
def update_threshold(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").groupBy(
        F.concat(F.lit("rule_"), F.col("o_custkey").cast("string")).alias("rule_id")).agg(
        (F.max("o_totalprice") / 1000000).alias("new_threshold")).withColumns({
            "changed_at": F.lit(0.0), "reason": F.lit("manual"), "auto_adjusted": F.lit(False),
            "required_reapproval": F.col("new_threshold") > 0.4})
    return R.update_threshold(current(spark, sf_dir), wanted)


@query("threshold_history", oracle("select * from history"))
def threshold_history(spark, sf_dir):
    return R.threshold_history(history(spark, sf_dir))


@query("history_order", oracle("select rule_id, changed_at, new_threshold, required_reapproval from history"))
def history_order(spark, sf_dir):
    """One range-partitioned sort by rule and time, so a rule with many changes spans tasks."""
    return R.threshold_history(history(spark, sf_dir)).select(
        "rule_id", "changed_at", "new_threshold", "required_reapproval")


@query("recent_history", oracle("""
    select rule_id, changed_at, new_threshold, cast(row_number() over (partition by rule_id order by changed_at) as int) as position
    from (select *, row_number() over (partition by rule_id order by changed_at desc) as age from history) where age <= 5"""))
def recent_history(spark, sf_dir):
    return adapt.recent_history(history(spark, sf_dir)).select("rule_id", "changed_at", "new_threshold", "position")


@query("latest_state", """select o_custkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus,
    arg_max(o_totalprice, o_orderkey) as o_totalprice, max(o_orderkey) as o_orderkey from orders group by 1""")
def latest_state(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return latest(log, "o_custkey", "o_orderkey")


# -- tickets ---------------------------------------------------------------
# Incidents before 1998 already have tickets; those of even months are resolved.
_CUT = "1998-01"
_KEYED = "select *, table_fq_name as t, seq % 2 = 0 as even from i"
_TICKET_ID = "concat('tkt_', substr(sha256(concat_ws('|', table_fq_name, rule_key, batch_id)), 1, 12))"
_OLD = f"""select {_TICKET_ID} as ticket_id, table_fq_name, rule_key, severity, seq::double as created_at,
    case when seq % 2 = 0 then 'resolved' else 'open' end as status from i where batch_id < '{_CUT}'"""
_FRESH = f"""select {_TICKET_ID} as ticket_id, table_fq_name, rule_key, severity, batch_id, problems from (
      select *, row_number() over (partition by table_fq_name, rule_key order by seq, batch_id) as n from i
      where batch_id >= '{_CUT}') where n = 1 and (table_fq_name, rule_key) not in
    (select (table_fq_name, rule_key) from old where status = 'open')"""


def _incidents(spark, sf_dir):
    from ...session import cut_lineage
    # One row per batch, read several times below.
    return cut_lineage(I.incidents(monthly_results(spark, sf_dir)).withColumns({
        "title": F.concat(F.lit("Data quality failures on "), "table_fq_name"),
        "description": F.concat(F.col("problems").cast("string"), F.lit(" problems in "), "batch_id"),
        "created_at": F.col("seq").cast("double")}))


def _old_tickets(found):
    made = found.filter(F.col("batch_id") < _CUT).withColumn("rule_key", I.rule_key(F.col("rule_ids")))
    digest = F.sha2(F.concat_ws("|", "table_fq_name", "rule_key", "batch_id"), 256)
    return made.select(
        F.concat(F.lit("tkt_"), F.substring(digest, 1, 12)).alias("ticket_id"), "table_fq_name", "title", "description",
        "severity", F.col("rule_ids").alias("check_results"),
        F.when(F.col("seq") % 2 == 0, "resolved").otherwise("open").alias("status"), "created_at")


def _new_tickets(spark, sf_dir):
    found = _incidents(spark, sf_dir)
    return I.create_tickets(found.filter(F.col("batch_id") >= _CUT), _old_tickets(found))


def ticket_oracle(body: str) -> str:
    return results_oracle(body, i=_INCIDENTS, w=_WORST, old=_OLD, fresh=_FRESH)


@query("create_ticket", ticket_oracle(
    "select ticket_id, table_fq_name, rule_key, severity, 'open' as status from fresh"))
def create_ticket(spark, sf_dir):
    return _new_tickets(spark, sf_dir).select(
        "ticket_id", "table_fq_name", joined("check_results", ",").alias("rule_key"), "severity", "status")


@query("open_ticket_match", ticket_oracle(f"""select i.batch_id, o.ticket_id from i join
    (select table_fq_name, rule_key, arg_min(ticket_id, created_at) as ticket_id from old where status = 'open' group by 1, 2) o
    using (table_fq_name, rule_key) where i.batch_id >= '{_CUT}'"""))
def open_ticket_match(spark, sf_dir):
    found = _incidents(spark, sf_dir)
    return I.match_open(found.filter(F.col("batch_id") >= _CUT), _old_tickets(found)).select("batch_id", "ticket_id")


@query("list_tickets", ticket_oracle("select ticket_id, status from old where table_fq_name = 'shop.orders'"))
def list_tickets(spark, sf_dir):
    return I.list_tickets(_old_tickets(_incidents(spark, sf_dir)), "shop.orders").select("ticket_id", "status")


@query("resolve_ticket", ticket_oracle(
    "select ticket_id, case when severity = 'critical' then 'resolved' else status end as status from old"))
def resolve_ticket(spark, sf_dir):
    tickets = _old_tickets(_incidents(spark, sf_dir))
    return I.resolve_tickets(tickets, tickets.filter("severity = 'critical'")).select("ticket_id", "status")


@query("webhook_payload", ticket_oracle("""select ticket_id, json_object('ticket_id', ticket_id, 'table', table_fq_name,
    'title', 'Data quality failures on ' || table_fq_name, 'description', problems || ' problems in ' || batch_id,
    'severity', severity, 'rule_ids', string_split(rule_key, ','))::varchar as payload from fresh"""))
def webhook_payload(spark, sf_dir):
    return I.webhook_payload(_new_tickets(spark, sf_dir))


@query("set_equality", """
    select a.l_suppkey, a.flags = b.flags as same from
      (select l_suppkey, list_sort(list(distinct l_returnflag || l_linestatus)) as flags from lineitem where l_linenumber = 6 group by 1) a
      join (select l_suppkey, list_sort(list(distinct l_returnflag || l_linestatus)) as flags from lineitem where l_quantity > 40 group by 1) b
      using (l_suppkey)""")
def set_equality(spark, sf_dir):
    """Sets of flags per supplier; a set has six members at most, however many rows there are."""
    lines = table(spark, sf_dir, "lineitem").withColumn("s", F.concat("l_returnflag", "l_linestatus"))
    late = lines.filter("l_linenumber = 6").groupBy("l_suppkey").agg(F.collect_set("s").alias("a"))
    large = lines.filter("l_quantity > 40").groupBy("l_suppkey").agg(F.collect_set("s").alias("b"))
    return late.join(large, "l_suppkey").select(
        "l_suppkey", (I.rule_key(F.col("a")) == I.rule_key(F.col("b"))).alias("same"))
