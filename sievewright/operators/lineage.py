"""Lineage edges from database catalogs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import split_name
from ..schemas import LINEAGE_EDGES
from ..session import best_effort


def _edges(rows: DataFrame, upstream: Column, downstream: Column, relationship: str, info: str) -> DataFrame:
    return rows.select(upstream.alias("upstream"), downstream.alias("downstream"),
                       F.lit(relationship).alias("relationship"), F.lit(info).alias("source_of_info"))


def _dotted(schema: str, name: str) -> Column:
    return F.concat_ws(".", schema, name)


def postgres_edges(view_usage: DataFrame, table: str, default_schema: str | None = None) -> DataFrame:
    """View to base-table edges of one table; the schema counts only if it is known."""
    schema, name = (table.split(".", 1) if "." in table else (default_schema, table))
    rows = view_usage.filter(F.col("table_name") == name)
    if schema is not None:
        rows = rows.filter(F.col("table_schema") == schema)
    return _edges(rows, _dotted("table_schema", "table_name"), _dotted("view_schema", "view_name"),
                  "view_depends_on", "information_schema.view_table_usage")


def snowflake_edges(dependencies: DataFrame, table: str) -> DataFrame:
    """Objects that refer to the table; catalogs hold names in upper case."""
    name = table.split(".", 1)[-1].upper()
    rows = dependencies.filter(F.col("referenced_object_name") == name)
    return _edges(rows, _dotted("referenced_schema", "referenced_object_name"),
                  _dotted("referencing_schema", "referencing_object_name"),
                  "object_dependency", "account_usage.object_dependencies")


def databricks_edges(table_lineage: DataFrame, table: str, default_schema: str | None = None) -> DataFrame:
    """Edges with the table on either side; half-empty rows are dropped."""
    fq = table if "." in table or not default_schema else f"{default_schema}.{table}"
    source, target = F.col("source_table_full_name"), F.col("target_table_full_name")
    rows = table_lineage.filter((source == fq) | (target == fq)).filter((source != "") & (target != ""))
    return _edges(rows, source, target, "etl_lineage", "system.access.table_lineage")


def no_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LINEAGE_EDGES)


def lineage_edges(spark: SparkSession, feeds: list[Callable[[], DataFrame]]) -> DataFrame:
    """One edge table over all feeds; a feed that cannot be read adds nothing."""
    out = no_edges(spark)
    for feed in feeds:
        edges = best_effort(feed, None, "lineage")
        if edges is not None:
            out = out.unionByName(edges)
    return out


def split_names(names: DataFrame, column: str, default_schema: str | None = None) -> DataFrame:
    schema, table = split_name(F.col(column), F.lit(default_schema).cast("string"))
    return names.withColumns({"schema": schema, "table": table})
