"""Where blocked batches are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.coerce import is_nested
from ..operators.checks import field


def quarantine_folder(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table.replace('.', '_')}"


def write_quarantine(df: DataFrame, root: str, table: str, batch_col: str = "batch_id",
                     fmt: str = "csv") -> int:
    """Write whole batches, one folder per batch; a replay replaces its own folder. Returns the rows."""
    seen = Observation()
    if fmt == "csv":
        # The format has no nested types.
        df = df.select(*[F.to_json(field(f.name)).alias(f.name) if is_nested(f.dataType) else field(f.name)
                         for f in df.schema.fields])
    writer = (df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format(fmt)
              .option("partitionOverwriteMode", "dynamic").partitionBy(batch_col))
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(quarantine_folder(root, table))
    return seen.get["rows"]
