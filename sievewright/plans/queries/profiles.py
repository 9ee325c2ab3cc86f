"""Profiles, proposals, scans and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.patterns import NAMED_PATTERNS, PATTERN_MATCH_SHARE
from ...operators import suggest as P
from ...operators.profile import candidate_grain, frequent_values, profile_columns, profile_table
from ...sources.base import table_metadata
from ...session import cut_lineage
from ..monitor import scan_report
from .registry import DIRTY, dirty, over, query, table, with_views

# Profiled inputs: name -> columns as (name, kind), kind n(umber), i(nteger), s(tring), t(ime).
COLUMNS = {
    "part": [("p_partkey", "i"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "i"),
             ("p_retailprice", "n")],
    "customer_dirty": [("c_custkey", "i"), ("c_email", "s"), ("c_acctbal_text", "s"), ("c_acctbal", "n"),
                       ("c_mktsegment", "s")],
    "orders_dirty": [("o_orderkey", "i"), ("o_custkey", "i"), ("o_totalprice", "n"), ("o_orderpriority", "s"),
                     ("o_orderdate_text", "s"), ("o_orderdate", "t"), ("batch_id", "s")],
    "events": [("event_id", "i"), ("ts", "t"), ("user_id", "i"), ("event_type", "s"), ("value", "n"), ("props", "s")],
    "labels": [("doc_id", "i"), ("quality", "i"), ("toxic", "i")],
    "documents": [("doc_id", "i"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "i")],
}
TABLES = list(COLUMNS)


def frame(spark, sf_dir, name):
    base = name.removesuffix("_dirty")
    wide = table(spark, sf_dir, base)
    return over(spark, DIRTY[name], base, wide) if name in DIRTY else wide


def profiles(spark, sf_dir, names=None):
    out = None
    for name in names or TABLES:
        one = profile_columns(frame(spark, sf_dir, name), f"src.{name}")
        out = one if out is None else out.unionByName(one)
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def column_oracle(name: str, pos: int, column: str, kind: str, source: str | None = None) -> str:
    source = source or name
    number = kind in "in"
    x = f"{column}::double"
    text = f"{column}::varchar"
    pattern = "null::varchar"
    if kind == "s":
        cases = " ".join(
            f"when count(*) filter (regexp_matches({column}, {_quoted('^(?:' + rx + ')')})) >= {PATTERN_MATCH_SHARE}::double * count({column}) then '{pn}'"
            for pn, rx in NAMED_PATTERNS.items())
        pattern = f"case when count({column}) = 0 then null {cases} end"
    elif kind == "i":
        pattern = f"case when count(distinct {column}) = count({column}) then 'integer_id' end"
    return f"""select 'src.{name}' as table_fq_name, {pos} as position, '{column}' as "column", count(*) as row_count,
        count(*) - count({column}) as null_count,
        coalesce((count(*) - count({column}))::double / nullif(count(*), 0), 0) as null_rate,
        count(distinct {column}) as distinct_count,
        coalesce(count(distinct {column})::double / nullif(count(*), 0), 0) as distinct_rate,
        {f'min({x})' if number else 'null::double'} as min_value, {f'max({x})' if number else 'null::double'} as max_value,
        {f'round(avg({x}), 6)' if number else 'null::double'} as mean,
        {f'round(coalesce(stddev_samp({x}), 0), 6)' if number else 'null::double'} as stddev,
        {f'min({x})::varchar' if number else f'min({column})::varchar'} as min_text,
        {f'max({x})::varchar' if number else f'max({column})::varchar'} as max_text,
        (select string_agg(v || ':' || n, '|' order by n desc, v) from (select {text} as v, count(*) as n from {source}
            where {column} is not null group by 1 order by n desc, v limit 5)) as top_values,
        {pattern} as inferred_pattern,
        count(*) > 0 and count(distinct {column}) = count(*) as is_candidate_key
        from {source}"""


def profile_oracle(names=None) -> str:
    return "\nunion all ".join(column_oracle(n, i, c, k) for n in (names or TABLES) for i, (c, k) in enumerate(COLUMNS[n]))


def oracle(body: str, names=None, **extra: str) -> str:
    return with_views(body, "orders_dirty", "customer_dirty", profile=profile_oracle(names), **extra)


FULL = ("table_fq_name, position, \"column\", row_count, null_count, null_rate, distinct_count, distinct_rate, min_value, "
        "max_value, mean, stddev, min_text, max_text, top_values, inferred_pattern, is_candidate_key")


def flat(profile):
    top = F.array_join(F.transform("top_values", lambda t: F.concat(t["value"], F.lit(":"), t["n"].cast("string"))), "|")
    return profile.select(
        "table_fq_name", "position", "column", "row_count", "null_count", "null_rate", "distinct_count",
        "distinct_rate", "min_value", "max_value", F.round("mean", 6).alias("mean"),
        F.round("stddev", 6).alias("stddev"), "min_text", "max_text",
        F.when(F.size("top_values") > 0, top).alias("top_values"), "inferred_pattern", "is_candidate_key")


@query("profile_table", oracle(f"select {FULL} from profile"))
def profile_all(spark, sf_dir):
    return flat(profiles(spark, sf_dir))


def _part(name: str, columns: list[str], names: list[str], where: str = "true"):
    shown = ["table_fq_name", "column", *columns]
    sql = oracle(f"""select {', '.join('"' + c + '"' for c in shown)} from profile where {where}""", names)
    query(name, sql)(lambda spark, sf_dir: flat(profiles(spark, sf_dir, names)).filter(where).select(*shown))


_part("profile_row_count", ["row_count"], ["events", "labels"])
_part("profile_nulls", ["null_count", "null_rate"], ["customer_dirty", "orders_dirty"])
_part("profile_distinct", ["distinct_count", "distinct_rate"], ["orders_dirty", "documents"])
_part("profile_numeric_stats", ["min_value", "max_value", "mean", "stddev"], ["events", "customer_dirty"], "mean is not null")
_part("profile_minmax_other", ["min_text", "max_text"], ["events", "part"], "mean is null")
_part("profile_pattern", ["inferred_pattern"], ["customer_dirty", "orders_dirty"], "mean is null")
_part("profile_integer_id", ["inferred_pattern"], ["part", "orders_dirty", "labels"], "inferred_pattern = 'integer_id'")
_part("candidate_key", ["is_candidate_key"], ["part", "orders_dirty", "events"])


@query("candidate_grain", oracle("""select table_fq_name, max(row_count) as row_count,
    coalesce(string_agg("column", ',' order by position) filter (is_candidate_key), '') as grain from profile group by 1"""))
def grain(spark, sf_dir):
    return candidate_grain(profiles(spark, sf_dir)).select(
        "table_fq_name", "row_count", F.array_join("candidate_grain", ",").alias("grain"))


@query("top_values", with_views(
    "select * from (select *, cast(row_number() over (partition by position order by n desc, value) as int) as rank from c) where rank <= 5",
    c="""select 0 as position, l_quantity::varchar as value, count(*) as n from lineitem group by 2
         union all select 1, l_shipdate::varchar, count(*) from lineitem group by 2
         union all select 2, l_partkey::varchar, count(*) from lineitem group by 2"""))
def top_values_query(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_shipdate", "l_partkey")
    return frequent_values(df)


# -- proposals -------------------------------------------------------------
PROPOSED = {
    "propose_completeness": (P.propose_completeness, """
        select table_fq_name, "column", 'completeness' as rule_type, round(least(0.99, null_rate + 0.02), 4) as threshold,
          case when null_rate < 0.01 then 'critical' else 'warn' end as severity, null::double as lo, null::double as hi,
          null::varchar as pattern_name,
          'Observed null rate ' || printf('%.2f%%', null_rate * 100) || '; proposing a max-null-rate threshold of '
            || printf('%.2f%%', round(least(0.99, null_rate + 0.02), 4) * 100) || ' with headroom.' as rationale
        from profile where null_rate < 1"""),
    "propose_uniqueness": (P.propose_uniqueness, """
        select table_fq_name, "column", 'uniqueness' as rule_type, 0.999::double as threshold, 'critical' as severity,
          null::double as lo, null::double as hi, null::varchar as pattern_name,
          "column" || ' looks like a candidate key (all distinct, no nulls).' as rationale from profile where is_candidate_key"""),
    "propose_range": (P.propose_range, """
        select table_fq_name, "column", 'range' as rule_type, 0::double as threshold, 'warn' as severity,
          round(min_value - stddev * 3, 4) as lo, round(max_value + stddev * 3, 4) as hi, null::varchar as pattern_name,
          'Observed range [' || min_value || ', ' || max_value || ']; flagging values outside it.' as rationale
        from profile where min_value is not null and stddev <> 0"""),
    "propose_pattern": (P.propose_pattern, """
        select table_fq_name, "column", 'pattern' as rule_type, 0.95::double as threshold, 'warn' as severity,
          null::double as lo, null::double as hi, inferred_pattern as pattern_name,
          "column" || ' values match the ''' || inferred_pattern || ''' pattern in the sample.' as rationale
        from profile where inferred_pattern is not null"""),
}


def proposal_columns(proposals):
    params = F.col("params")
    return proposals.select(
        "table_fq_name", "column", "rule_type", "threshold", "severity",
        F.round(F.get_json_object(params, "$.min").cast("double"), 4).alias("lo"),
        F.round(F.get_json_object(params, "$.max").cast("double"), 4).alias("hi"),
        F.get_json_object(params, "$.pattern_name").alias("pattern_name"), "rationale")


PROPOSED_TABLES = ["part", "customer_dirty", "orders_dirty", "events"]
for _name, (_fn, _sql) in PROPOSED.items():
    query(_name, oracle(_sql, PROPOSED_TABLES))(
        lambda spark, sf_dir, fn=_fn: proposal_columns(fn(profiles(spark, sf_dir, PROPOSED_TABLES))))

ALL_PROPOSED = "\nunion all ".join(sql for _, sql in PROPOSED.values())


@query("propose_rules", oracle(ALL_PROPOSED, PROPOSED_TABLES))
def propose_rules(spark, sf_dir):
    # One row per column, read several times below.
    profile = cut_lineage(profiles(spark, sf_dir, PROPOSED_TABLES))
    prompts = P.suggestion_prompts(profile, spark.createDataFrame([], "table_fq_name string, title string, content string, created_at double, doc_id string"),
                                   P.baseline_rules(profile))
    # The offline answer to a proposal request is an empty list, so the baseline stands.
    answers = P.canned_responses(prompts).withColumnRenamed("id", "table_fq_name")
    return proposal_columns(P.propose_rules(profile, answers))


# -- metadata, scan and report ---------------------------------------------
_TYPES = {"customer_dirty": ["bigint", "string", "string", "double", "string"]}


def _metadata_oracle(name: str) -> str:
    return "\nunion all ".join(
        f"""select {i} as position, '{c}' as name, '{_TYPES[name][i]}' as data_type, count({c}) < count(*) as nullable,
            {'true' if i == 0 else 'false'} as is_primary_key, null::varchar as comment, count(*) as row_count from {name}"""
        for i, (c, _) in enumerate(COLUMNS[name]))


@query("table_metadata", with_views("select * from m", "customer_dirty", m=_metadata_oracle("customer_dirty")))
def metadata(spark, sf_dir):
    return table_metadata(dirty(spark, sf_dir, "customer_dirty"), keys=["c_custkey"])


@query("scan_table", with_views(
    f"select p.*, m.data_type, m.nullable from profile p join m on m.name = p.\"column\"", "customer_dirty",
    m=_metadata_oracle("customer_dirty"),
    profile="\nunion all ".join(column_oracle("customer_dirty", i, c, k)
                                for i, (c, k) in enumerate(COLUMNS["customer_dirty"]))))
def scan_table(spark, sf_dir):
    """Profile of the whole table beside its metadata."""
    df = dirty(spark, sf_dir, "customer_dirty")
    facts = table_metadata(df).select(F.col("name").alias("column"), "data_type", "nullable")
    return flat(profile_table(df, "src.customer_dirty")).join(facts, "column")


@query("scan_report", with_views(
    """select m.position, m.name, m.data_type, m.nullable, m.is_primary_key, p.null_rate, p.distinct_rate,
         p.inferred_pattern, p.is_candidate_key, m.row_count,
         (select coalesce(string_agg("column", ', ' order by position), '') from profile where is_candidate_key) as candidate_grain,
         (select string_agg('raw.' || n_name || ' -> src.customer_dirty', '; ' order by n_name) from nation) as lineage
       from m join profile p on m.name = p."column" """,
    "customer_dirty", "orders_dirty", m=_metadata_oracle("customer_dirty"), profile=profile_oracle(["customer_dirty"])))
def report(spark, sf_dir):
    df = dirty(spark, sf_dir, "customer_dirty")
    edges = table(spark, sf_dir, "nation").select(F.concat(F.lit("raw."), "n_name").alias("upstream"),
                                                  F.lit("src.customer_dirty").alias("downstream"))
    return scan_report(table_metadata(df, keys=["c_custkey"]), profile_columns(df), edges)
