"""Kafka topics with JSON values; the connector package has to be on the classpath."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: where a new consumer starts.
START = "latest"


def kafka_options(servers: str | list[str], topic: str, max_records: int | None = None,
                  starting: str = START, **extra: str) -> dict[str, str]:
    """Reader options; a micro-batch takes everything there is unless `max_records` limits it."""
    joined = servers if isinstance(servers, str) else ",".join(servers)
    limit = {} if max_records is None else {"maxOffsetsPerTrigger": str(max_records)}
    return {"kafka.bootstrap.servers": joined, "subscribe": topic, "startingOffsets": starting, **limit, **extra}


def decode_values(records: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON in `value` as columns; the declared schema is what a stream must have."""
    return records.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def kafka_stream(spark: SparkSession, servers, topic: str, schema: T.StructType, **kwargs) -> DataFrame:
    options = kafka_options(servers, topic, **kwargs)
    return decode_values(spark.readStream.format("kafka").options(**options).load(), schema)
