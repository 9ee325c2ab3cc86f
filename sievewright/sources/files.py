"""Flat files: one file as one table, or a folder of them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import na_to_null
from ..operators.checks import field
from .base import Source, hadoop_path
from .records import records

EXTENSIONS = (".csv", ".json", ".jsonl", ".parquet", ".tsv")


def _inferred_types(texts: DataFrame) -> T.StructType:
    """Narrowest of bigint, double, boolean and string that takes every value; one pass."""
    kinds = ("bigint", "double", "boolean")
    truth = F.lower
    aggs = []
    for i, name in enumerate(texts.columns):
        c = field(name)
        aggs.append(F.count(c).alias(f"n{i}"))
        for kind in kinds:
            fits = c.try_cast(kind).isNotNull()
            if kind == "boolean":
                fits = truth(c).isin("true", "false")
            elif kind == "double":
                fits = fits & ~c.rlike("[dDfF]$")
            aggs.append(F.count_if(fits).alias(f"{kind}{i}"))
    seen = texts.agg(*aggs).first()
    fields = []
    for i, name in enumerate(texts.columns):
        total = seen[f"n{i}"]
        picked = next((k for k in kinds if total and seen[f"{k}{i}"] == total), "double" if not total else "string")
        fields.append(T.StructField(name, T._parse_datatype_string(picked)))
    return T.StructType(fields)


def _split_bytes(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def _largest_file(spark: SparkSession, path: str) -> int:
    fs, root = hadoop_path(spark, path)
    statuses = fs.listStatus(root) if fs.exists(root) and fs.getFileStatus(root).isDirectory() else (fs.globStatus(root) or ())
    return max((status.getLen() for status in statuses if status.isFile()), default=0)


def _parsed(found: DataFrame, columns: list[str], sep: str) -> DataFrame:
    """Records as columns of text; the first one of each file is its header, empty lines are none."""
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)
    rows = found.where(~((F.col("block") == 0) & (F.col("at") == 0)) & (F.col("text") != ""))
    return rows.select(F.from_csv("text", schema, {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}).alias("row")).select(
        *[F.col("row").getField(c).alias(c) for c in columns])


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None,
                   multiline: bool = True) -> DataFrame:
    """Header row, quoted by doubled quotes, missing-value words as NULL.

    Without a schema types are inferred after the missing-value words are gone. Quoted fields may hold line
    breaks; files of more than one split are cut into records by many tasks all the same (`records`).
    `multiline=False` says that no field does.
    """
    reader = (spark.read.option("header", True).option("sep", sep).option("escape", '"')
              .option("multiLine", multiline))
    if schema is not None:
        reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]))
    raw = reader.csv(path)
    if multiline and _largest_file(spark, path) > _split_bytes(spark):
        raw = _parsed(records(spark, path, sep), raw.columns, sep)
    texts = raw.select(*[na_to_null(field(c)).alias(c) for c in raw.columns])
    typed = schema if schema is not None else _inferred_types(texts)
    return texts.select(*[
        field(f.name) if isinstance(f.dataType, T.StringType)
        else field(f.name).try_cast(f.dataType).alias(f.name) for f in typed.fields])


def read_file(spark: SparkSession, path: str, schema: T.StructType | None = None,
              multiline: bool = True) -> DataFrame:
    """Read by extension; `multiline` concerns delimited files."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in (".csv", ".tsv"):
        return read_delimited(spark, path, "," if suffix == ".csv" else "\t", schema, multiline)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix == ".parquet":
        return reader.parquet(path)
    if suffix == ".json":
        return reader.option("multiLine", True).json(path)
    if suffix == ".jsonl":
        return reader.json(path)
    raise ValueError(f"unsupported file extension '{suffix}'; supported: {list(EXTENSIONS)}")


class FileSource(Source):
    """One file as one table; every read ignores the table name, as there is only one."""

    def __init__(self, spark: SparkSession, name: str, path: str, logical_table: str | None = None,
                 schema: T.StructType | None = None, multiline: bool = True):
        super().__init__(spark, name)
        stem, suffix = os.path.splitext(os.path.basename(path.rstrip("/")))
        if suffix.lower() not in EXTENSIONS:
            raise ValueError(f"unsupported file extension '{suffix}'; supported: {list(EXTENSIONS)}")
        self.path, self.logical_table, self.file_schema = path, logical_table or stem, schema
        self.multiline = multiline
        self._frame: DataFrame | None = None

    def list_tables(self) -> list[str]:
        return [self.logical_table]

    def table(self, table: str | None = None) -> DataFrame:
        if self._frame is None:
            self._frame = read_file(self.spark, self.path, self.file_schema, self.multiline)
        return self._frame

    def fq_name(self, table: str) -> str:
        return table if table.startswith(f"{self.name}.") else f"{self.name}.{self.logical_table}"


class DirectorySource(Source):
    """A folder of files, one table per file stem; on equal stems the last extension wins."""

    def __init__(self, spark: SparkSession, name: str, directory: str,
                 schemas: dict[str, T.StructType] | None = None, multiline: bool = True):
        super().__init__(spark, name)
        fs, root = hadoop_path(spark, directory)
        if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
            raise ValueError(f"not a directory: {directory}")
        found = sorted(status.getPath().getName() for status in fs.listStatus(root))
        self.files = {os.path.splitext(n)[0]: f"{directory.rstrip('/')}/{n}" for n in found
                      if os.path.splitext(n)[1].lower() in EXTENSIONS}
        if not self.files:
            raise ValueError(f"no supported files in {directory}; supported: {list(EXTENSIONS)}")
        self.schemas, self.multiline = schemas or {}, multiline
        self._frames: dict[str, DataFrame] = {}

    def list_tables(self) -> list[str]:
        return sorted(self.files)

    def split(self, table: str) -> tuple[str | None, str]:
        return None, table

    def table(self, table: str) -> DataFrame:
        local = table.removeprefix(f"{self.name}.")
        if local not in self.files:
            raise ValueError(f"unknown table '{table}'; known: {self.list_tables()}")
        if local not in self._frames:
            self._frames[local] = read_file(self.spark, self.files[local], self.schemas.get(local), self.multiline)
        return self._frames[local]
