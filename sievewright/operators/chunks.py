"""Consecutive chunks of an ordered table without a single-task numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def numbered(df: DataFrame, order_by: list[str], name: str = "row_index") -> DataFrame:
    """Rows numbered 0..n-1 in the given total order.

    A range-partitioned sort is kept in the shared folder; each row then knows its
    partition and place, and only the partition sizes are summed up.
    """
    placed = cut_lineage(df.orderBy(*order_by).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"__part": F.shiftright("__at", 33),
                                 "__local": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("__part").agg((F.max("__local") + 1).alias("size"))
    # One row per partition of the sort, so the single-task window stays small.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__offset"))
    return (placed.join(F.broadcast(offsets), "__part")
            .withColumn(name, (F.col("__offset") + F.col("__local")).cast("long"))
            .drop("__part", "__local", "__offset", "__at"))


def chunked(df: DataFrame, order_by: list[str], size: int = 500, max_chunks: int | None = None,
            name: str = "chunk") -> DataFrame:
    """Chunks of `size` rows, the last one short. `max_chunks=0` still yields one chunk."""
    out = numbered(df, order_by, "__row").withColumn(
        name, F.floor(F.col("__row") / size).cast("long")).drop("__row")
    return out if max_chunks is None else out.filter(F.col(name) < max(max_chunks, 1))
