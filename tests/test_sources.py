import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.operators import lineage as L
from sievewright.operators.chunks import chunked, numbered
from sievewright.sources import CatalogSource, DirectorySource, FileSource, JdbcSource
from sievewright.sources.files import read_file
from sievewright.sources.jdbc import read_options
from sievewright.sources.kafka import decode_values, kafka_options


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "Customer.csv").write_text('CustomerId,Email,Score,Note\n1,a@x.com,1.5,"said ""hi"", left"\n2,NA,n/a,\n3,c@x.com,2,null\n')
    (tmp_path / "Track.tsv").write_text("TrackId\tUnitPrice\n1\t0.99\n2\t1.99\n")
    (tmp_path / "Doc.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    (tmp_path / "Line.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "Track.csv").write_text("other\n1\n")
    (tmp_path / "notes.txt").write_text("ignored")
    return str(tmp_path)


def test_directory(spark, folder):
    source = DirectorySource(spark, "files", folder)
    assert source.list_tables() == ["Customer", "Doc", "Line", "Track"]
    customer = source.table("Customer")
    assert dict(customer.dtypes) == {"CustomerId": "bigint", "Email": "string", "Score": "double", "Note": "string"}
    assert [tuple(r) for r in customer.orderBy("CustomerId").collect()] == [
        (1, "a@x.com", 1.5, 'said "hi", left'), (2, None, None, None), (3, "c@x.com", 2.0, None)]
    assert source.table("files.Track").columns == ["TrackId", "UnitPrice"]
    assert (source.row_count("Doc"), source.row_count("Line"), source.row_count("nope")) == (2, 2, None)
    assert source.fq_name("Customer") == source.fq_name("files.Customer") == "files.Customer"
    with pytest.raises(ValueError):
        source.table("nope")
    nullable = {r.name: r.nullable for r in source.metadata("Customer").collect()}
    assert nullable == {"CustomerId": False, "Email": True, "Score": True, "Note": True}
    assert source.lineage("Customer").count() == 0


def test_single_file(spark, folder):
    source = FileSource(spark, "f", f"{folder}/Customer.csv", schema=T.StructType([
        T.StructField("CustomerId", T.IntegerType()), T.StructField("Email", T.StringType()),
        T.StructField("Score", T.DoubleType()), T.StructField("Note", T.StringType())]))
    assert source.list_tables() == ["Customer"] and source.fq_name("whatever") == "f.Customer"
    assert source.batch("ignored", "Score > 1.7").count() == 1
    assert source.sample("x", 2, ["CustomerId"]).count() == 2
    sizes = source.micro_batches("x", ["CustomerId"], 2).groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in sizes] == [(0, 2), (1, 1)]


def test_bad_paths(spark, tmp_path):
    with pytest.raises(ValueError):
        FileSource(spark, "f", "/x/y.xlsx")
    with pytest.raises(ValueError):
        read_file(spark, "/x/y.xlsx")
    with pytest.raises(ValueError):
        DirectorySource(spark, "f", str(tmp_path / "none"))
    with pytest.raises(ValueError):
        DirectorySource(spark, "f", str(tmp_path))


def test_catalog(spark, shop):
    source = CatalogSource(spark, "lake")
    assert {"customers", "orders"} <= set(source.list_tables())
    assert source.batch("lake.orders", "amount < 0").count() == 1
    assert source.split("a.b.c") == ("a", "b.c")


def test_jdbc_options(spark):
    got = read_options("postgresql", "jdbc:postgresql://h/db", "s.t", partition_column="id", bounds=(0, 100), partitions=8)
    assert (got["partitionColumn"], got["lowerBound"], got["upperBound"], got["numPartitions"]) == ("id", "0", "100", "8")
    assert got["driver"] == "org.postgresql.Driver"
    with pytest.raises(ValueError):
        read_options("oracle", "u", "t")
    with pytest.raises(ValueError):
        read_options("sqlite", "u", "t", partition_column="id")
    source = JdbcSource(spark, "pg", "postgresql", "jdbc:postgresql://h/db", schema="sales")
    assert source.qualified("orders") == "sales.orders" and source.qualified("hr.people") == "hr.people"
    assert "table_schema = 'sales'" in source.list_tables_query()
    assert "c.table_name = 'people'" in source.primary_key_query("hr.people")
    assert JdbcSource(spark, "l", "sqlite", "jdbc:sqlite:x").lineage("t").count() == 0


def test_kafka(spark):
    got = kafka_options(["a:9092", "b:9092"], "orders")
    assert got == {"kafka.bootstrap.servers": "a:9092,b:9092", "subscribe": "orders", "startingOffsets": "latest"}
    assert kafka_options("a", "t", max_records=9)["maxOffsetsPerTrigger"] == "9"
    schema = T.StructType([T.StructField("id", T.LongType())])
    records = spark.createDataFrame([('{"id": 5}',), ("broken",)], "value string").select(F.col("value").cast("binary").alias("value"))
    assert sorted((r.id for r in decode_values(records, schema).collect()), key=str) == [5, None]


def test_lineage(spark):
    usage = spark.createDataFrame([("v", "a", "s", "t"), ("v", "b", "x", "t"), ("v", "c", "s", "u")],
                                  "view_schema string, view_name string, table_schema string, table_name string")
    assert L.postgres_edges(usage, "t").count() == 2
    assert L.postgres_edges(usage, "s.t").first().downstream == "v.a"
    assert L.postgres_edges(usage, "t", "x").first().downstream == "v.b"
    flows = spark.createDataFrame([("s.t", "x"), ("y", "s.t"), ("", "s.t"), ("s.t", None), ("p", "q")],
                                  "source_table_full_name string, target_table_full_name string")
    assert L.databricks_edges(flows, "t", "s").count() == 2


def test_numbering_with_a_hot_leading_key(spark):
    df = spark.range(5000).selectExpr("case when id % 3 = 0 then 7 else id % 11 end as k", "id")
    got = [(r.k, r.id) for r in numbered(df.repartition(7), ["k", "id"]).orderBy("row_index").collect()]
    assert got == sorted(got) and len(got) == 5000
    indexes = numbered(df, ["k", "id"]).selectExpr("min(row_index)", "max(row_index)", "count(distinct row_index)").first()
    assert tuple(indexes) == (0, 4999, 5000)


def test_bounded_chunks(spark):
    df = spark.range(10)
    assert chunked(df, ["id"], 3, max_chunks=2).count() == 6
    assert chunked(df, ["id"], 3, max_chunks=0).count() == 3


def test_unreadable_sources_yield_nothing(spark):
    """Without a driver on the classpath there is no count, no key and no lineage, and no error either."""
    from sievewright.sources.jdbc import JdbcSource
    source = JdbcSource(spark, "db", "postgresql", "jdbc:postgresql://127.0.0.1:1/none")
    assert source.row_count("t") is None and source.primary_key("t") == []
    assert source.lineage("public.t").count() == 0


@pytest.mark.parametrize("multiline,rows", [(True, 2), (False, 3)])
def test_quoted_line_breaks(spark, tmp_path, multiline, rows):
    path = tmp_path / "t.csv"
    path.write_text('id,note\n1,"two\nlines"\n2,plain\n')
    df = FileSource(spark, "files", str(path), multiline=multiline).table()
    assert df.count() == rows
    if multiline:
        assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "two\nlines"), (2, "plain")]


def test_scratch_folders_are_deleted(spark):
    import os
    from sievewright.session import clean_scratch, cut_lineage
    folder = cut_lineage(spark.range(3)).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    clean_scratch(spark)
    assert not os.path.exists(folder)
