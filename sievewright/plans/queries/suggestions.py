"""Prompts, answers and their parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import adapt as A, incidents as I, suggest as P
from ...operators.gate import is_problem
from ...session import cut_lineage
from .checks import _PROBLEM, _WORST, monthly_results, oracle as results_oracle
from .knowledge import notes, NOTES
from .profiles import ALL_PROPOSED, oracle as profile_oracle, proposal_columns, profiles
from .registry import over, query, table, with_views

# An answer per order: valid and invalid items in between prose.
_ANSWERS = """select o_orderkey, concat('Here you are:', chr(10), '[{"column": "c', cast(o_custkey as string), '", "rule_type": "',
      case o_orderpriority when '1-URGENT' then 'range' when '2-HIGH' then 'pattern' when '3-MEDIUM' then 'novelty' else 'completeness' end,
      '", "threshold": ', case when o_orderstatus = 'P' then 'null' when o_orderstatus = 'O' then cast(o_custkey as string) else concat('"0.', cast(o_orderkey as string), '"') end,
      case when o_orderkey % 4 = 0 then ', "severity": "critical"' when o_orderkey % 4 = 1 then ', "severity": null'
           when o_orderkey % 4 = 2 then ', "severity": "panic"' else '' end,
      case when o_orderkey % 3 = 0 then ', "rationale": "seen before"' else '' end,
      '}, 7, "x", {"rule_type": "uniqueness", "threshold": 0.5, "table": "other.t"}', case when o_orderkey % 10 = 9 then '}' else '' end, '] done.') as text
    from orders"""


def _answers(spark, sf_dir):
    return over(spark, _ANSWERS, "orders", table(spark, sf_dir, "orders"))


_PARSED = """
    select coalesce(json_extract_string(v, '$.table'), t) as table_fq_name, json_extract_string(v, '$.column') as "column",
      json_extract_string(v, '$.rule_type') as rule_type, try_cast(json_extract_string(v, '$.threshold') as double) as threshold,
      case when json_extract(v, '$.severity') is null then 'warn' else json_extract_string(v, '$.severity') end as severity,
      coalesce(json_extract_string(v, '$.rationale'), '(LLM-suggested)') as rationale
    from (select t, unnest(json_extract(j, '$[*]')) as v from (
      select 'orders.' || o_orderkey as t, regexp_extract(text, '(?s)(\\[.*\\])', 1) as j from answers) where json_valid(j))
    where json_type(v) = 'OBJECT'"""


@query("parse_rule_suggestions", with_views(
    """select * from parsed where rule_type in ('completeness', 'uniqueness', 'range', 'pattern', 'freshness', 'referential', 'custom_sql')
       and threshold is not null and severity in ('info', 'warn', 'critical')""", answers=_ANSWERS, parsed=_PARSED))
def parse_rule_suggestions(spark, sf_dir):
    answers = _answers(spark, sf_dir).select(
        F.concat(F.lit("orders."), F.col("o_orderkey").cast("string")).alias("table_fq_name"), "text")
    return P.parse_suggestions(answers).select("table_fq_name", "column", "rule_type", "threshold", "severity", "rationale")


@query("refine_rules", profile_oracle("""
    select p.table_fq_name, p."column", p.rule_type, 0.25::double as threshold, 'info' as severity, p.lo, p.pattern_name from (
      select table_fq_name, "column", 'range' as rule_type, round(min_value - stddev * 3, 4) as lo, null::varchar as pattern_name
        from profile where stddev <> 0
      union all select table_fq_name, "column", 'pattern', null, inferred_pattern from profile where inferred_pattern is not null) p""",
    ["part", "customer_dirty"]))
def refine_rules(spark, sf_dir):
    """Accepted items keep the parameters of the candidates they refine."""
    profile = cut_lineage(profiles(spark, sf_dir, ["part", "customer_dirty"]))
    # A table's answer has one item per candidate: a bounded group.
    item = F.to_json(F.struct("column", "rule_type", F.lit(0.25).alias("threshold"), F.lit("info").alias("severity")))
    answers = P.baseline_rules(profile).filter(F.col("rule_type").isin("range", "pattern")).groupBy("table_fq_name").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("text"))
    return proposal_columns(P.propose_rules(profile, answers)).select(
        "table_fq_name", "column", "rule_type", "threshold", "severity", "lo", "pattern_name")


# Conversation turns with a confidence and an action line put behind most of them.
_RCA = """select concat(cast(conv_id as string), '/', cast(turn as string)) as id, concat(text,
      case when turn % 4 = 0 then concat(chr(10), 'Confidence: 0.', cast(turn + 1 as string)) when turn % 4 = 1 then concat(chr(10), 'CONFIDENCE ', cast(60 + turn as string), '%')
           when turn % 4 = 2 then concat(chr(10), 'confidence:   400') else '' end,
      case when turn % 3 = 0 then concat(chr(10), 'Action: rerun ', role, ' load  ') when turn % 3 = 1 then concat(chr(10), 'ACTION - ', role) else '' end) as text
    from conversations"""
_STRIP = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
_RAW = "coalesce(try_cast(nullif(regexp_extract(text, '(?i)confidence[:\\s]+([0-9]*\\.?[0-9]+)', 1), '') as double), 0.5)"
_PARSED_RCA = f"""select id, {_RAW} as raw, {_STRIP.format("split_part(split_part(text, 'Confidence:', 1), 'confidence:', 1)")} as head,
    {_STRIP.format("text")} as whole, {_STRIP.format("regexp_extract(text, '(?i)action[:\\s]+([^\\n]+)', 1)")} as suggested_action from rca"""


def _rca_texts(spark, sf_dir):
    return over(spark, _RCA, "conversations", table(spark, sf_dir, "conversations"))


@query("parse_rca", with_views(
    """select id, case when head <> '' then head else whole end as explanation,
       round(greatest(0, least(1, case when raw <= 1 then raw else raw / 100 end)), 9) as confidence, suggested_action from p""",
    rca=_RCA, p=_PARSED_RCA))
def parse_rca(spark, sf_dir):
    return P.parse_rca(_rca_texts(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


@query("parse_text", with_views("select id, raw, suggested_action from p", rca=_RCA, p=_PARSED_RCA))
def parse_text(spark, sf_dir):
    from ...functions import text as X
    text = F.col("text")
    raw = F.when(text.rlike(r"(?i)confidence[:\s]+[0-9]*\.?[0-9]+"),
                 F.regexp_extract(text, r"(?i)confidence[:\s]+([0-9]*\.?[0-9]+)", 1).cast("double"))
    return _rca_texts(spark, sf_dir).select("id", F.coalesce(raw, F.lit(0.5)).alias("raw"),
                                            X.suggested_action(text).alias("suggested_action"))


_DRAFTS = """select concat(cast(conv_id as string), '/', cast(turn as string)) as id, concat('shop.', role) as tables,
    concat(case when turn % 3 < 2 then concat('Title:  Load of ', role, ' failed ', chr(10)) else '' end,
      case when turn % 2 = 0 then concat('Description: ', text) else text end) as text from conversations"""


@query("draft_ticket_text", with_views(f"""
    select id, case when whole_form then {_STRIP.format("regexp_extract(text, 'Title:\\s*([^\\n]+)', 1)")} else 'Data quality failures on ' || tables end as title,
      case when whole_form then {_STRIP.format("regexp_extract(text, '(?s)Description:\\s*(.+)', 1)")} else {_STRIP.format("text")} end as description
    from (select *, regexp_matches(text, 'Title:\\s*[^\\n]') and regexp_matches(text, '(?s)Description:\\s*.') as whole_form from d)""", d=_DRAFTS))
def draft_ticket_text(spark, sf_dir):
    drafts = over(spark, _DRAFTS, "conversations", table(spark, sf_dir, "conversations"))
    return P.draft_ticket_text(drafts.select("id", "text"), drafts.select("id", "tables"))


CANNED = [("der", "[]"), ("the", "Title: a\nDescription: b"), ("ROOT", "Late load. Confidence: 0.8")]
_DEFAULT = f"""case when contains(h, 'propose data quality rules') then '[]' when contains(h, 'root cause') then '{P.DEFAULT_ANSWERS[1][1]}'
    when contains(h, 'draft a concise ticket') then '{P.DEFAULT_ANSWERS[2][1]}' else '{P.FALLBACK_ANSWER}' end"""


def _turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    system = F.when(F.col("turn") % 5 == 0, P.SUGGEST_SYSTEM).when(F.col("turn") % 5 == 1, P.RCA_SYSTEM).when(
        F.col("turn") % 5 == 2, P.TICKET_SYSTEM)
    return turns.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
                        F.lit("x").alias("kind"), system.alias("system"), F.col("text").alias("prompt"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TURNS = f"""select conv_id || '/' || turn as id, lower(coalesce(case turn % 5 when 0 then {_sql_text(P.SUGGEST_SYSTEM)}
    when 1 then {_sql_text(P.RCA_SYSTEM)} when 2 then {_sql_text(P.TICKET_SYSTEM)} end, '') || chr(10) || text) as h from conversations"""


@query("canned_response_match", with_views(
    "select id, case " + " ".join(f"when contains(h, {_sql_text(k.lower())}) then {_sql_text(a)}" for k, a in CANNED)
    + f" else {_DEFAULT} end as text from turns", turns=_TURNS))
def canned_response_match(spark, sf_dir):
    return P.canned_responses(_turns(spark, sf_dir), CANNED)


@query("canned_responses", with_views(f"select id, {_DEFAULT} as text from turns", turns=_TURNS))
def canned_responses(spark, sf_dir):
    return P.canned_responses(_turns(spark, sf_dir))


# -- prompts over real results ---------------------------------------------
_LINES = """coalesce((select string_agg('- ' || title || ': ' || content, chr(10) order by created_at, doc_id) from notes n
    where n.table_fq_name = {t}), '(no business knowledge documents on file for this table)')"""


# Threshold changes of some of the rules, more than a prompt shows for each; the text is valid in both engines.
HISTORY = """select case n_nationkey % 3 when 0 then 'r06' when 1 then 'r03' else 'r07' end as rule_id,
    cast(n_nationkey as double) / 2 as old_threshold, cast(n_nationkey as double) / 4 as new_threshold, cast(n_nationkey as double) as changed_at,
    n_name as reason, n_nationkey % 2 = 0 as auto_adjusted, n_nationkey % 2 = 1 as required_reapproval from nation"""
_CHANGES = """coalesce((select string_agg('- ' || changed_at || ': ' || old_threshold || ' -> ' || new_threshold || ' (' || reason || ')', chr(10)
      order by changed_at) from (select *, row_number() over (partition by rule_id order by changed_at desc) as age from history) h
    where h.rule_id = w.rule_id and age <= 5), '(no threshold history)')"""


def _recent(spark, sf_dir):
    return A.recent_history(over(spark, HISTORY, "nation", table(spark, sf_dir, "nation")))


@query("build_prompts", results_oracle(f"""
    select table_fq_name || '|' || batch_id as id, 'A data quality check failed.' || chr(10) || chr(10) || 'Table: ' || table_fq_name || chr(10)
      || 'Column: ' || coalesce("column", 'None') || chr(10) || 'Rule type: ' || rule_type || chr(10) || 'Status: ' || status || chr(10)
      || 'Metric value: ' || metric_value || chr(10) || 'Threshold: ' || threshold || chr(10) || 'Message: ' || message || chr(10) || chr(10)
      || 'BUSINESS KNOWLEDGE:' || chr(10) || {_LINES.format(t="w.table_fq_name")} || chr(10) || chr(10)
      || 'RECENT THRESHOLD HISTORY:' || chr(10) || {_CHANGES} || chr(10) as prompt
    from w""", w=_WORST, notes=NOTES, history=HISTORY))
def build_prompts(spark, sf_dir):
    worst = I.worst_result(monthly_results(spark, sf_dir))
    return P.rca_prompts(worst, notes(spark, sf_dir), _recent(spark, sf_dir)).select("id", "prompt")


@query("ticket_prompts", results_oracle(f"""
    select table_fq_name || '|' || batch_id as id, 'Failed checks:' || chr(10) || string_agg('- ' || table_fq_name || '.' || coalesce("column", 'None') || ': '
      || rule_type || ' failed (value=' || metric_value || ', threshold=' || threshold || ', severity=' || severity || ')', chr(10) order by rule_id)
      || chr(10) || chr(10) as prompt from results where {_PROBLEM} group by table_fq_name, batch_id"""))
def ticket_prompts(spark, sf_dir):
    return P.ticket_prompts(monthly_results(spark, sf_dir).filter(is_problem())).select("id", "prompt")


# Every candidate as JSON, in the order of columns and of rule types.
_CANDIDATES = f"""select c.table_fq_name, '[' || string_agg('{{"table":"' || c.table_fq_name || '","column":"' || c."column" || '","rule_type":"' || rule_type
      || '","threshold":' || threshold || ',"severity":"' || severity || '","rationale":"' || rationale || '"}}', ','
      order by position, list_position(['completeness', 'uniqueness', 'range', 'pattern'], rule_type)) || ']' as candidates
    from ({ALL_PROPOSED}) c join profile p on p.table_fq_name = c.table_fq_name and p."column" = c."column" group by 1"""


@query("suggestion_prompts", profile_oracle(f"""
    select id, 'Propose data quality rules for this table.' || chr(10) || chr(10) || 'DATA PROFILE:' || chr(10) || 'Table: ' || id || ' (' || n || ' rows)' || chr(10)
      || lines || chr(10) || chr(10) || 'BUSINESS KNOWLEDGE:' || chr(10) || '(no business knowledge documents on file for this table)' || chr(10) || chr(10)
      || 'STATISTICAL BASELINE CANDIDATES:' || chr(10) || candidates || chr(10) as prompt from (
      select table_fq_name as id, max(row_count) as n, string_agg('- ' || "column" || ' (' || case "column" when 'p_size' then 'int'
          when 'p_partkey' then 'bigint' when 'p_retailprice' then 'double' else 'string' end || '): null_rate=' || printf('%.2f%%', null_rate * 100)
          || ', distinct_rate=' || printf('%.2f%%', distinct_rate * 100) || ', pattern=' || coalesce(inferred_pattern, 'None')
          || ', candidate_key=' || case when is_candidate_key then 'True' else 'False' end, chr(10) order by position) as lines
      from profile group by 1) join ({_CANDIDATES}) on table_fq_name = id""", ["part"]))
def suggestion_prompts(spark, sf_dir):
    profile = profiles(spark, sf_dir, ["part"])
    return P.suggestion_prompts(profile, notes(spark, sf_dir), P.baseline_rules(profile)).select("id", "prompt")


RCA_ANSWERS = [("rule type: freshness", "Nothing arrived lately.\nConfidence: 80\nAction: rerun the load"),
               ("rule type: referential", "Orders came before their customers.\nConfidence: 0.7\nAction: load customers first")]


@query("explain_failure", results_oracle(f"""
    select table_fq_name || '|' || batch_id as id, case rule_type when 'freshness' then 'Nothing arrived lately.'
        when 'referential' then 'Orders came before their customers.' else '{P.DEFAULT_ANSWERS[1][1]}' end as explanation,
      case rule_type when 'freshness' then 0.8::double when 'referential' then 0.7::double else 0.5::double end as confidence,
      case rule_type when 'freshness' then 'rerun the load' when 'referential' then 'load customers first' else '' end as suggested_action from w""", w=_WORST))
def explain_failure(spark, sf_dir):
    worst = I.worst_result(monthly_results(spark, sf_dir))
    return P.explain_failures(worst, notes(spark, sf_dir), _recent(spark, sf_dir), lambda p: P.canned_responses(p, RCA_ANSWERS))
