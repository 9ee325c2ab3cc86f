"""The corpus pipeline: rules, boilerplate lines, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`. SQL cannot express the near-duplicate and packing
stages, so there is no ORACLE_SQL; tests/llm/test_pipeline.py holds the stages against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import line_dedup, minhash, mixing, packing, quality_rules
from sievewright.llm.common import settle
from sievewright.llm.queries import tokenizer

ORACLE_SQL = None


def pass_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_rules.kept_documents(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts (and n_chars) without lines that stand on many sources; copies count as one."""
    cleaned = line_dedup.clean_lines(docs)
    chars = F.length("row.text").cast(docs.schema["n_chars"].dataType)
    return cleaned.select(F.when(F.col("n_removed") > 0, F.col("row").withField("n_chars", chars))
                          .otherwise(F.col("row")).alias("row")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id; repeated rows and rows without an id take part."""
    return minhash.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each time."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality_rules", pass_rules), ("line_dedup", drop_boilerplate), ("near_duplicates", drop_near_duplicates),
          ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the pieces of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
