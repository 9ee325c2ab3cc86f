"""Relational databases through Spark's JDBC reader.

The driver class has to be on the classpath. With a numeric or date `partition_column`
the table is read in parallel ranges; filters and column choices reach the database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage as L
from ..session import best_effort
from .base import Source

# Supported dialects with driver class and key-column catalog query.
DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "snowflake": "net.snowflake.client.jdbc.SnowflakeDriver",
    "databricks": "com.databricks.client.jdbc.Driver",
    "sqlite": "org.sqlite.JDBC",
}
_LINEAGE_CATALOG = {
    "postgresql": ("information_schema.view_table_usage", L.postgres_edges),
    "snowflake": ("snowflake.account_usage.object_dependencies", L.snowflake_edges),
    "databricks": ("system.access.table_lineage", L.databricks_edges),
}


def read_options(dialect: str, url: str, table: str, *, partition_column: str | None = None,
                 bounds: tuple | None = None, partitions: int | None = None,
                 properties: dict[str, str] | None = None) -> dict[str, str]:
    """Options of one parallel read."""
    if dialect not in DRIVERS:
        raise ValueError(f"unknown dialect '{dialect}'; known: {sorted(DRIVERS)}")
    options = {"url": url, "dbtable": table, "driver": DRIVERS[dialect], "fetchsize": "10000",
               **(properties or {})}
    if partition_column:
        if bounds is None or not partitions:
            raise ValueError("a partition column needs bounds and a number of partitions")
        options |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]),
                    "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return options


class JdbcSource(Source):
    observed_nulls = False

    def __init__(self, spark: SparkSession, name: str, dialect: str, url: str, schema: str | None = None,
                 properties: dict[str, str] | None = None, partitioning: dict[str, tuple] | None = None):
        """`partitioning` maps a table to (column, lower, upper, partitions)."""
        super().__init__(spark, name, schema)
        read_options(dialect, url, "t")
        self.dialect, self.url, self.properties = dialect, url, properties or {}
        self.partitioning = partitioning or {}

    def qualified(self, table: str) -> str:
        schema, name = self.split(table)
        return f"{schema}.{name}" if schema else name

    def _read(self, dbtable: str, **kwargs) -> DataFrame:
        options = read_options(self.dialect, self.url, dbtable, properties=self.properties, **kwargs)
        return self.spark.read.format("jdbc").options(**options).load()

    def table(self, table: str) -> DataFrame:
        part = self.partitioning.get(table)
        extra = dict(partition_column=part[0], bounds=part[1:3], partitions=part[3]) if part else {}
        return self._read(self.qualified(table), **extra)

    def list_tables_query(self) -> str:
        if self.dialect == "sqlite":
            return "(select name from sqlite_master where type in ('table', 'view')) t"
        where = f" where table_schema = '{self.schema}'" if self.schema else ""
        return f"(select table_name as name from information_schema.tables{where}) t"

    def list_tables(self) -> list[str]:
        rows = self._read(self.list_tables_query()).select("name").distinct().orderBy("name").collect()
        return [r.name for r in rows]

    def primary_key_query(self, table: str) -> str | None:
        schema, name = self.split(table)
        if self.dialect == "sqlite":
            return f"(select name from pragma_table_info('{name}') where pk > 0) k"
        in_schema = f" and c.table_schema = '{schema}'" if schema else ""
        return ("(select u.column_name as name from information_schema.table_constraints c "
                "join information_schema.key_column_usage u on c.constraint_name = u.constraint_name "
                f"where c.constraint_type = 'PRIMARY KEY' and c.table_name = '{name}'{in_schema}) k")

    def primary_key(self, table: str) -> list[str]:
        """Empty where the database does not tell."""
        return best_effort(lambda: [r.name for r in self._read(self.primary_key_query(table)).collect()], [],
                           f"primary key of {table}")

    def lineage(self, table: str) -> DataFrame:
        """Best effort: catalogs may need rights the caller lacks."""
        if self.dialect not in _LINEAGE_CATALOG:
            return L.no_edges(self.spark)
        catalog, edges = _LINEAGE_CATALOG[self.dialect]

        def feed() -> DataFrame:
            rows = self._read(catalog)
            rows = rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns])
            return edges(rows, table) if self.dialect == "snowflake" else edges(rows, table, self.schema)

        return L.lineage_edges(self.spark, [feed])
