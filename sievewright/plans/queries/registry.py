"""Registry and the shared inputs of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Input views with deliberate faults; the text is valid in both engines.
DIRTY = {
    "orders_dirty": """
        select case when o_orderkey % 101 = 1 then o_orderkey - 1 else o_orderkey end as o_orderkey,
               case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then o_custkey + 1000000
                    else o_custkey end as o_custkey,
               case when o_orderkey % 29 = 0 then -1.0 * o_totalprice else o_totalprice end as o_totalprice,
               case when o_orderkey % 31 = 0 then null when o_orderkey % 37 = 0 then 'bad'
                    else o_orderpriority end as o_orderpriority,
               case when o_orderkey % 41 = 0 then 'not-a-date'
                    else substr(cast(o_orderdate as string), 1, 10) end as o_orderdate_text,
               o_orderdate,
               substr(cast(o_orderdate as string), 1, 7) as batch_id
        from orders""",
    "customer_dirty": """
        select c_custkey,
               case when c_custkey % 19 = 0 then null when c_custkey % 11 = 0 then 'not-an-email'
                    else concat('user', cast(c_custkey as string), '@example.com') end as c_email,
               case when c_custkey % 7 = 0 then null else cast(c_acctbal as string) end as c_acctbal_text,
               c_acctbal, c_mktsegment
        from customer""",
    "events_dirty": """
        select event_id, user_id, event_type,
               case when event_id % 23 = 0 then null when event_id % 47 = 0 then -1.0 * value else value end as value,
               case when event_id % 31 = 0 then 'n/a' else concat('user', cast(user_id as string), '@example.com') end as email
        from events""",
}
# Number of a month batch; 1995-01 is 0.
MONTH_SEQ = "cast(substr(batch_id, 1, 4) as int) * 12 + cast(substr(batch_id, 6, 2) as int) - 23941"


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its oracle if there is one."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    base = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return base.select(*columns) if columns else base


def over(spark: SparkSession, text: str, name: str, df: DataFrame) -> DataFrame:
    """Run a query text that reads the table `name` on `df`."""
    escaped = text.replace("{", "{{").replace("}", "}}").replace(f"from {name}", "from {src}")
    return spark.sql(escaped, src=df)


def dirty(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = name.removesuffix("_dirty")
    return over(spark, DIRTY[name], base, table(spark, sf_dir, base))


def with_views(body: str, *names: str, **extra: str) -> str:
    """`with` clause over the faulty views and further named subqueries, then the body."""
    parts = [f"{n} as ({DIRTY[n]})" for n in names] + [f"{n} as ({q})" for n, q in extra.items()]
    return ("with recursive " + ",\n".join(parts) + "\n" + body) if parts else body


def joined(column: str, sep: str = "|"):
    """An array as text, so that both engines hash the same value."""
    return F.array_join(F.col(column), sep)
