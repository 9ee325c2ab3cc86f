"""Tables and views of the session catalog, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import lineage as L
from .base import Source

# Fixed value: where a catalog keeps the edges between its tables.
LINEAGE_TABLE = "system.access.table_lineage"


class CatalogSource(Source):
    observed_nulls = False

    def list_tables(self) -> list[str]:
        return sorted({t.name for t in self.spark.catalog.listTables(self.schema)})

    def table(self, table: str) -> DataFrame:
        local = table.removeprefix(f"{self.name}.")
        schema, name = self.split(local)
        return self.spark.table(f"{schema}.{name}" if schema else name)

    def lineage(self, table: str) -> DataFrame:
        """Edges of the lineage system table, where the catalog has one."""
        local = table.removeprefix(f"{self.name}.")
        return L.lineage_edges(self.spark, [
            lambda: L.databricks_edges(self.spark.table(LINEAGE_TABLE), local, self.schema)])


def tables_union_views(tables: DataFrame, views: DataFrame) -> DataFrame:
    """Sorted distinct names of two catalog listings (column `name`)."""
    return tables.select("name").union(views.select("name")).distinct().orderBy("name")
