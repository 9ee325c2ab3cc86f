"""Scalar functions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import names as N, text as X
from ...functions.patterns import NAMED_PATTERNS, matches
from ...operators.lineage import split_names
from .registry import dirty, over, query, table, with_views


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Texts of many shapes, made from the columns of orders.
_SHAPES = """select o_orderkey, case cast(o_orderkey % 9 as int)
    when 0 then concat('user', cast(o_custkey as string), '@example.com')
    when 1 then concat(substr(md5(cast(o_orderkey as string)), 1, 8), '-0a1b-2c3d-4e5f-', substr(md5(cast(o_custkey as string)), 1, 12))
    when 2 then substr(cast(o_orderdate as string), 1, 10) when 3 then cast(o_orderdate as string)
    when 4 then cast(o_orderkey as string) when 5 then concat('+49 (0)', cast(1000000 + o_custkey as string))
    when 6 then concat(substr(cast(10000 + o_custkey as string), 1, 5), '-', substr(cast(10000 + o_orderkey as string), 1, 4))
    when 7 then o_orderpriority else concat(' ', cast(o_custkey as string), ' ') end as t from orders"""


def _shapes(spark, sf_dir):
    return over(spark, _SHAPES, "orders", table(spark, sf_dir, "orders"))


@query("named_patterns", with_views(
    "select o_orderkey, t, " + ", ".join(
        f"regexp_matches(t, {_quoted('^(?:' + rx + ')')}) as is_{name}" for name, rx in NAMED_PATTERNS.items())
    + " from shapes", shapes=_SHAPES))
def named_patterns(spark, sf_dir):
    return _shapes(spark, sf_dir).select("o_orderkey", "t", *[
        matches(F.col("t"), rx).alias(f"is_{name}") for name, rx in NAMED_PATTERNS.items()])


_TOKENS = "unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]{2,})', 1))"


@query("tokenise", f"select term, count(*) as n from (select {_TOKENS} as term from documents) group by 1")
def tokenise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term")).groupBy(
        "term").agg(F.count(F.lit(1)).alias("n"))


@query("term_buckets", f"""select bucket, count(*) as n, count(distinct term) as terms from (select term,
    ('0x' || substr(md5(term), 1, 8))::bigint % 4096 as bucket from (select {_TOKENS} as term from conversations)) group by 1""")
def term_buckets(spark, sf_dir):
    # Terms are counted first, so the second shuffle holds one row per distinct term.
    terms = table(spark, sf_dir, "conversations").select(F.explode(X.tokens(F.col("text"))).alias("term")).groupBy(
        "term").agg(F.count(F.lit(1)).alias("n"))
    return terms.groupBy(X.term_bucket(F.col("term")).cast("long").alias("bucket")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"))


@query("rounding_math", """select o_orderkey, round(o_totalprice / 7, 4) as r4, round(o_totalprice / 1000000, 6) as r6,
    greatest(0, least(1, o_totalprice / 250000 - 0.5::double)) as clamped, round(sqrt(abs(o_totalprice - 250000)), 6) as root from orders""")
def rounding_math(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(price / 7, 4).alias("r4"), F.round(price / 1000000, 6).alias("r6"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), price / 250000 - 0.5)).alias("clamped"),
        F.round(F.sqrt(F.abs(price - 250000)), 6).alias("root"))


@query("number_formats", """select o_orderkey, printf('%.2f%%', o_totalprice / 500000 * 100) as share,
    printf('%.1f%%', o_totalprice / 500000 * 100) as short, printf('%.1f', o_totalprice / 3600) as hours,
    printf('%.4f', o_totalprice / 1000000) as four, replace('shop.' || o_orderstatus || '.x', '.', '_') as folder from orders""")
def number_formats(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", N.percent(price / 500000).alias("share"), N.percent(price / 500000, 1).alias("short"),
        N.decimals(price / 3600, 1).alias("hours"), N.decimals(price / 1000000, 4).alias("four"),
        F.replace(F.concat_ws(".", F.lit("shop"), "o_orderstatus", F.lit("x")), F.lit("."), F.lit("_")).alias("folder"))


@query("hours_between", """select event_type, (epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(max(ts))) / 3.6e9 as age_hours,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 as span_hours from events group by 1""")
def hours_between(spark, sf_dir):
    def us(c):
        return F.unix_micros(c.cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("hi"), F.min("ts").alias("lo")).select(
        "event_type", ((us(F.lit("2024-02-01 00:00:00")) - us(F.col("hi"))) / F.lit(3.6e9)).alias("age_hours"),
        ((us(F.col("hi")) - us(F.col("lo"))) / F.lit(3.6e9)).alias("span_hours"))


@query("json_values", """select event_id, json_extract_string(props, '$.k')::bigint as k,
    regexp_extract('note ' || event_type || ' [' || event_id || ', ' || user_id || '] end ]', '(?s)(\\[.*\\])', 1) as found,
    json_object('id', event_id, 'type', event_type)::varchar as dumped from events""")
def json_values(spark, sf_dir):
    note = F.concat(F.lit("note "), "event_type", F.lit(" ["), F.col("event_id").cast("string"), F.lit(", "),
                    F.col("user_id").cast("string"), F.lit("] end ]"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), X.json_array_text(note).alias("found"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("dumped"))


@query("array_ops", """select l_orderkey, array_to_string(list_slice(list_sort(list(distinct l_returnflag || l_linestatus)), 1, 2), ',') as first_two,
    count(distinct l_returnflag || l_linestatus) as flags from lineitem group by 1""")
def array_ops(spark, sf_dir):
    """Sorted, distinct and sliced arrays of a set that has six members at most."""
    flags = F.array_sort(F.array_distinct(F.collect_set(F.concat("l_returnflag", "l_linestatus"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(flags.alias("s")).select(
        "l_orderkey", F.array_join(F.slice("s", 1, 2), ",").alias("first_two"),
        F.size("s").cast("long").alias("flags"))


@query("defaults", with_views(
    """select o_orderkey, batch_id, coalesce(nullif(o_orderpriority, 'bad'), 'system') as author, coalesce(o_custkey, -1) as cust
       from orders_dirty""", "orders_dirty"))
def defaults(spark, sf_dir):
    return dirty(spark, sf_dir, "orders_dirty").select(
        "o_orderkey", "batch_id", F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("bad")), F.lit("system")).alias("author"),
        F.coalesce("o_custkey", F.lit(-1)).alias("cust"))


_NAMES = """select c_custkey, concat(case when c_nationkey % 3 = 0 then 'crm.' else '' end,
    case when c_nationkey % 2 = 0 then concat(c_mktsegment, '.') else '' end, c_name) as t,
    case when c_nationkey % 5 = 0 then '' else 'main' end as s from customer"""


def _names(spark, sf_dir):
    return over(spark, _NAMES, "customer", table(spark, sf_dir, "customer"))


@query("fq_names", with_views(
    "select c_custkey, case when starts_with(t, 'crm.') then t else concat_ws('.', 'crm', nullif(s, ''), t) end as fq from n", n=_NAMES))
def fq_names(spark, sf_dir):
    return _names(spark, sf_dir).select(
        "c_custkey", N.resolve_fq(F.lit("crm"), F.col("s"), F.col("t")).alias("fq"))


@query("split_names", with_views(
    """select c_custkey, case when instr(t, '.') > 0 then split_part(t, '.', 1) else 'public' end as schema,
       case when instr(t, '.') > 0 then substr(t, instr(t, '.') + 1) else t end as "table" from n""", n=_NAMES))
def split_names_query(spark, sf_dir):
    return split_names(_names(spark, sf_dir), "t", "public").select("c_custkey", "schema", "table")
