"""Reading, writing and describing sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...operators import gate as G, lineage as L, rules as R
from ...operators.profile import head_sample
from ...session import scratch_path
from ...sources import CatalogSource, DirectorySource, FileSource
from ...sources.base import hadoop_path
from ...sources.catalog import tables_union_views
from ...sources.files import read_file
from ...sources.kafka import decode_values
from ...sources.quarantine import quarantine_folder, write_quarantine
from ...sources.state import StateStore
from .checks import _GATE, monthly_results, oracle as results_oracle
from .lifecycle import _SHOWN, _SHOWN_SQL, changes, history, oracle as rules_oracle, rule_rows
from .registry import dirty, over, query, table, with_views

_CUSTOMERS = """select c_custkey, c_email, c_acctbal_text::double as c_acctbal_text, c_acctbal, c_mktsegment, note
    from customer_dirty left join (select doc_id as id, text || chr(10) || '"' || source || '",' || chr(9) as note from documents)
      on c_custkey = id"""


def _delimited(spark, sf_dir, suffix: str, sep: str):
    """Faulty customers with notes that hold line breaks, quotes and separators, written with a missing-value word and
    read back without a schema."""
    path = scratch_path(spark, "customer") + suffix
    note = F.concat("text", F.lit('\n"'), "source", F.lit('",\t')).alias("note")
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("c_custkey"), note)
    rows = dirty(spark, sf_dir, "customer_dirty").join(notes, "c_custkey", "left")
    rows.write.csv(path, header=True, sep=sep, nullValue="NA", escape='"', ignoreTrailingWhiteSpace=False,
                   ignoreLeadingWhiteSpace=False)
    return FileSource(spark, "files", path).table()


@query("scan_csv", with_views(_CUSTOMERS, "customer_dirty"))
def scan_csv(spark, sf_dir):
    return _delimited(spark, sf_dir, ".csv", ",")


@query("scan_tsv", with_views(_CUSTOMERS, "customer_dirty"))
def scan_tsv(spark, sf_dir):
    return _delimited(spark, sf_dir, ".tsv", "\t")


@query("scan_parquet", "select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_returnflag = 'R'")
def scan_parquet(spark, sf_dir):
    return read_file(spark, f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R'").select(
        "l_orderkey", "l_linenumber", "l_extendedprice")


def _as_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of one JSON array per partition."""
    first = True
    for batch in batches:
        lines = batch["value"].tolist()
        if first and lines:
            lines[0], first = "[" + lines[0], False
            lines[1:] = ["," + line for line in lines[1:]]
        else:
            lines = ["," + line for line in lines]
        yield pd.DataFrame({"value": lines})
    yield pd.DataFrame({"value": ["[]" if first else "]"]})


@query("scan_json", with_views("select * from customer_dirty", "customer_dirty"))
def scan_json(spark, sf_dir):
    path = scratch_path(spark, "customer") + ".json"
    df = dirty(spark, sf_dir, "customer_dirty")
    df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(_as_documents, "value string").write.text(path)
    return read_file(spark, path).select(*df.columns)


@query("scan_jsonl", with_views("select * from customer_dirty", "customer_dirty"))
def scan_jsonl(spark, sf_dir):
    path = scratch_path(spark, "customer") + ".jsonl"
    df = dirty(spark, sf_dir, "customer_dirty")
    df.write.json(path)
    return read_file(spark, path, df.schema)


@query("single_file_source", "select o_orderstatus, count(*) as n, min(o_orderkey) as first_key from orders group by 1")
def single_file_source(spark, sf_dir):
    source = FileSource(spark, "files", f"{sf_dir}/orders.parquet")
    return source.batch("any name").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("directory_source", """select r_name, n_name, count(*) as customers from customer
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def directory_source(spark, sf_dir):
    source = DirectorySource(spark, "files", sf_dir)
    return (source.table("customer").join(source.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(source.table("files.region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers")))


@query("catalog_source", "select c_mktsegment, count(*) as n from customer where c_acctbal > 0 group by 1")
def catalog_source(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("catalog_customer")
    return CatalogSource(spark, "lake").batch("lake.catalog_customer", "c_acctbal > 0").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"))


def _kind_folder(spark, sf_dir):
    """Part kinds as a folder with one file a brand; the tables of the source are the brands of the data."""
    folder = scratch_path(spark, "kinds")
    part = table(spark, sf_dir, "part").select(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")).alias("name"), "p_type")
    part.repartition("name").write.partitionBy("name").json(f"{folder}/by")
    fs, by = hadoop_path(spark, f"{folder}/by")
    for one in fs.listStatus(by):
        name = one.getPath().getName()
        if name.startswith("name="):
            fs.rename(one.getPath(), hadoop_path(spark, f"{folder}/{name.removeprefix('name=')}.jsonl")[1])
    fs.delete(by, True)
    return DirectorySource(spark, "kinds", folder)


_BRANDS = "lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g'))"


@query("list_tables", f"select distinct {_BRANDS} as name from part")
def list_tables(spark, sf_dir):
    """The tables that a folder source lists."""
    names = _kind_folder(spark, sf_dir).list_tables()
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("tables_union_views", "select p_brand as name from part union select p_type from part")
def union_views(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return tables_union_views(part.select(F.col("p_brand").alias("name")), part.select(F.col("p_type").alias("name")))


@query("sorted_listing", f"""select name, row_number() over (order by name) - 1 as place from
    (select distinct {_BRANDS} as name from part)""")
def sorted_listing(spark, sf_dir):
    """Names in the order in which the source lists them."""
    names = _kind_folder(spark, sf_dir).list_tables()
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, place long")


_COUNTED = ("lineitem", "orders", "events", "documents")


@query("row_count", " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in _COUNTED))
def row_count(spark, sf_dir):
    source = DirectorySource(spark, "files", sf_dir)
    return spark.createDataFrame([(name, source.row_count(name)) for name in _COUNTED], "name string, n long")


@query("fetch_sample", "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem order by l_orderkey, l_linenumber, l_partkey, l_quantity limit 5000")
def fetch_sample(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return head_sample(lines, 5000, lines.columns)


@query("fetch_batch", "select l_returnflag, l_linestatus, count(*) as n from lineitem where l_shipdate >= timestamp '1998-01-01 00:00:00' group by 1, 2")
def fetch_batch(spark, sf_dir):
    source = DirectorySource(spark, "files", sf_dir)
    return source.batch("lineitem", "l_shipdate >= timestamp '1998-01-01 00:00:00'").groupBy(
        "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


# -- lineage, on catalogs derived from lineitem ----------------------------
_USAGE = """select 'mart' as view_schema, concat('v_', cast(l_suppkey as string), '_', cast(l_orderkey as string)) as view_name,
    l_linestatus as table_schema, l_returnflag as table_name from lineitem"""
_DEPENDS = """select 'mart' as referencing_schema, concat('V_', cast(l_partkey as string)) as referencing_object_name,
    'RAW' as referenced_schema, upper(l_returnflag) as referenced_object_name, 'DB' as referenced_database from lineitem"""
_FLOWS = """select case when l_linenumber = 1 then '' else concat('raw.', l_returnflag) end as source_table_full_name,
    case when l_linenumber = 2 then null when l_linestatus = 'O' then concat('mart.s', cast(l_suppkey as string)) else 'raw.A' end as target_table_full_name from lineitem"""
_PG = """select table_schema || '.' || table_name as upstream, view_schema || '.' || view_name as downstream,
    'view_depends_on' as relationship, 'information_schema.view_table_usage' as source_of_info from usage
    where table_name = 'A' and table_schema = 'F'"""
_SF = """select referenced_schema || '.' || referenced_object_name as upstream, referencing_schema || '.' || referencing_object_name as downstream,
    'object_dependency' as relationship, 'account_usage.object_dependencies' as source_of_info from depends where referenced_object_name = 'A'"""
_DB = """select source_table_full_name as upstream, target_table_full_name as downstream, 'etl_lineage' as relationship,
    'system.access.table_lineage' as source_of_info from flows
    where (source_table_full_name = 'raw.A' or target_table_full_name = 'raw.A')
      and source_table_full_name <> '' and target_table_full_name is not null"""
_CATALOGS = {"usage": _USAGE, "depends": _DEPENDS, "flows": _FLOWS}


def _catalog(spark, sf_dir, text):
    return over(spark, text, "lineitem", table(spark, sf_dir, "lineitem"))


@query("lineage_postgres", with_views(_PG, **_CATALOGS))
def lineage_postgres(spark, sf_dir):
    return L.postgres_edges(_catalog(spark, sf_dir, _USAGE), "F.A")


@query("lineage_snowflake", with_views(_SF, **_CATALOGS))
def lineage_snowflake(spark, sf_dir):
    return L.snowflake_edges(_catalog(spark, sf_dir, _DEPENDS), "raw.a")


@query("lineage_databricks", with_views(_DB, **_CATALOGS))
def lineage_databricks(spark, sf_dir):
    return L.databricks_edges(_catalog(spark, sf_dir, _FLOWS), "A", "raw")


@query("lineage_edges", with_views(
    f"select *, count(*) as n from ({_PG} union all {_SF} union all {_DB}) group by all", **_CATALOGS))
def lineage_edges(spark, sf_dir):
    feeds = [lambda: lineage_postgres(spark, sf_dir), lambda: lineage_snowflake(spark, sf_dir),
             lambda: L.postgres_edges(spark.table("no_such_catalog"), "F.A"),
             lambda: lineage_databricks(spark, sf_dir)]
    edges = L.lineage_edges(spark, feeds)
    return edges.groupBy(*edges.columns).agg(F.count(F.lit(1)).alias("n"))


# -- sinks and state -------------------------------------------------------
@query("quarantine_sink", results_oracle(
    """select o.batch_id, count(*) as n, sum(q.total)::bigint // count(*) as reported, round(sum(o_totalprice), 2) as price from orders_dirty o
       join g using (batch_id), (select count(*) as total from orders_dirty join g using (batch_id) where decision = 'block') q
       where decision = 'block' group by 1""", g=_GATE))
def quarantine_sink(spark, sf_dir):
    """Blocked months written, written again, and read back."""
    root = scratch_path(spark, "quarantine")
    batches = G.held(dirty(spark, sf_dir, "orders_dirty"), G.gate(monthly_results(spark, sf_dir)))
    write_quarantine(batches, root, "shop.orders")
    rows = write_quarantine(batches, root, "shop.orders")
    data = [f for f in batches.schema.fields if f.name != "batch_id"]
    schema = T.StructType([*data, T.StructField("batch_id", T.StringType())])
    back = spark.read.schema(schema).csv(quarantine_folder(root, "shop.orders"), header=True)
    return back.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.lit(rows).cast("long").alias("reported"),
        F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("state_tables", rules_oracle(f"select {_SHOWN_SQL} from cur"))
def state_tables(spark, sf_dir):
    """The rule log through its Parquet form, with one epoch written twice and a compaction in the middle."""
    store = StateStore(spark, scratch_path(spark, "state"))
    store.append("rule_events", R.add_events(rule_rows(spark, sf_dir), F.lit(0)), "add_1")
    for _ in range(2):
        store.append("rule_events", R.status_events(changes(spark, sf_dir)), "status_1")
    store.compact("rule_events")
    moves = R.threshold_events(history(spark, sf_dir), F.col("changed_at").cast("long") + 1)
    store.append("rule_events", moves, "moves_1")
    return store.rules().select(*_SHOWN)


@query("kafka_decode", "select event_id, user_id, event_type, value from events")
def kafka_decode(spark, sf_dir):
    """JSON record values as a topic delivers them."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    records = events.select(F.to_json(F.struct("*")).cast("binary").alias("value"))
    return decode_values(records, events.schema)
