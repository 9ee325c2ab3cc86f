"""A kept inverted index of text vectors: postings as Parquet by term bucket, changed in place, searched with bounds.

A text's vector holds its hashed terms (`vectors.vectors`); the index turns vectors into postings (doc_id, bucket, tf,
norm), partitioned by ranges of buckets, with the number of texts of each bucket beside them. A change rewrites the
partitions that hold old or new postings of the changed texts and no others. Products of term counts are whole numbers,
so scores do not depend on the order in which they are added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BUCKETS
from ..session import cut_lineage
from .vectors import SCORE_DIGITS, top_hits, vectors

PARTS = 64
# A bucket is frequent if it has this share of the texts of the most frequent one; frequent buckets are salted.
FREQUENT = 1 / 8
# Postings of one frequent bucket that meet in one task at most, about, where queries are too many to be broadcast.
SALT_ROWS = 200_000
# One text in so many is scored first, for a bound.
PILOT = 64

NO_BUCKET = -1


def postings_of(vectors_: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, bucket, tf, norm) of `vectors` rows."""
    return vectors_.select(key, "norm", F.inline(F.arrays_zip("buckets", "tfs"))).select(
        key, F.col("buckets").alias("bucket"), F.col("tfs").alias("tf"), "norm")


def bucket_sizes(postings: DataFrame) -> DataFrame:
    """(bucket, df): texts of each bucket; at most BUCKETS rows."""
    return postings.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))


@dataclass
class VectorIndex:
    """Postings and bucket sizes below a folder of the shared storage; one writer at a time.

    Both are plain Parquet tables partitioned by `part`. A write replaces whole partitions by Spark's dynamic overwrite:
    one that fails before its job commits leaves the index as it was.
    """

    spark: SparkSession
    path: str
    parts: int = PARTS

    def _part(self) -> Column:
        return F.floor(F.col("bucket") * F.lit(self.parts) / F.lit(BUCKETS)).cast("int")

    def _write(self, rows: DataFrame, name: str, mode: str = "overwrite") -> None:
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")

    def _marked(self, postings: DataFrame, parts: list[int]) -> DataFrame:
        """Postings with one row without a text in each part, so that a part that lost all its postings is rewritten too."""
        none = {f.name: F.lit(None).cast(f.dataType) for f in postings.schema.fields}
        marks = self.spark.createDataFrame([(p,) for p in parts], "p int").select(
            *[(F.lit(NO_BUCKET).cast("int") if c == "bucket" else F.col("p") if c == "part" else v).alias(c) for c, v in none.items()])
        return postings.unionByName(marks)

    def build(self, texts: DataFrame) -> None:
        """Index `texts` (doc_id, text), one row a text; what was there goes."""
        self._replace(postings_of(vectors(texts)).withColumn("part", self._part()), list(range(self.parts)))

    def _replace(self, postings: DataFrame, parts: list[int]) -> None:
        # Several tasks a part; within one, buckets lie together and their statistics let a reader skip the others.
        rows = (self._marked(postings.select("doc_id", "bucket", "tf", "norm", "part"), parts)
                .repartition("part", F.pmod(F.xxhash64("bucket"), F.lit(4))).sortWithinPartitions("part", "bucket"))
        self._write(rows, "postings")
        chosen = self._read("postings").where(F.col("part").isin(parts))
        sizes = chosen.groupBy("part", "bucket").agg(F.count("doc_id").alias("df"))
        self._write(sizes.select("bucket", "df", "part").coalesce(1), "sizes")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def postings(self) -> DataFrame:
        """(doc_id, bucket, tf, norm, part) of all indexed texts."""
        return self._read("postings").where(F.col("bucket") > NO_BUCKET)

    def sizes(self) -> DataFrame:
        return self._read("sizes").where((F.col("bucket") > NO_BUCKET) & (F.col("df") > 0)).select("bucket", "df")

    def upsert(self, changed: DataFrame) -> list[int]:
        """Replace or add the texts of `changed` (doc_id, text); a null or empty text has no postings. The parts rewritten."""
        new = cut_lineage(postings_of(vectors(changed)).withColumn("part", self._part()))
        return self._change(changed.select("doc_id").distinct(), new)

    def delete(self, ids: DataFrame) -> list[int]:
        """Remove the texts of `ids` (doc_id). The parts rewritten."""
        return self._change(ids.select("doc_id").distinct(), None)

    def _change(self, ids: DataFrame, new: DataFrame | None) -> list[int]:
        ids = cut_lineage(ids)
        # At most `parts` numbers; only parts without new postings are searched for old ones.
        touched = set() if new is None else {r.part for r in new.select("part").distinct().collect()}
        if len(touched) < self.parts:
            others = self.postings().where(~F.col("part").isin(list(touched)))
            touched |= {r.part for r in others.join(ids, "doc_id", "left_semi").select("part").distinct().collect()}
        parts = sorted(touched)
        if parts:
            kept = self.postings().where(F.col("part").isin(parts)).join(ids, "doc_id", "left_anti")
            self._replace(kept if new is None else kept.unionByName(new, allowMissingColumns=False), parts)
        return parts

    def search(self, queries: DataFrame, k: int = 5, among: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) of the k best texts of each query (query_id, text), all or those `among` (doc_id)."""
        postings, sizes = self.postings(), self.sizes()
        if among is not None:
            postings = cut_lineage(postings.join(among.select("doc_id").distinct(), "doc_id", "left_semi"))
            sizes = bucket_sizes(postings)
        return best_matches(postings, sizes, postings_of(vectors(queries, "query_id"), "query_id"), k)


def best_matches(postings: DataFrame, sizes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best texts of each query by cosine, ties to the lesser doc_id; exact.

    Postings of buckets that are asked for are dealt out by text, so a text meets all queries in one task and its products
    with them are added up there. One text in PILOT is scored first: the k-th best score among those is a bound that the
    k-th best of all cannot fall below, and no pair below it is ranked.
    """
    frequent = F.col("df") >= FREQUENT * F.max("df").over(Window.partitionBy(F.lit(0)))
    salts = F.when(frequent, F.greatest(F.ceil(F.col("df") / SALT_ROWS), F.lit(1))).otherwise(1).cast("int")
    sizes = F.broadcast(cut_lineage(sizes.select("bucket", salts.alias("salts"))))  # at most BUCKETS rows
    asked = asked.select("query_id", "bucket", F.col("tf").alias("q_tf"), F.col("norm").alias("q_norm")).join(sizes, "bucket")
    asked = cut_lineage(asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"))
    wanted = F.broadcast(cut_lineage(asked.groupBy("bucket").agg((F.max("salt") + 1).alias("salts"))))  # at most BUCKETS rows
    postings = postings.select("doc_id", "bucket", "tf", "norm").join(wanted, "bucket").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts")

    def scored(some: DataFrame) -> DataFrame:
        met = some.repartition("doc_id").join(asked, ["bucket", "salt"]).groupBy("query_id", "doc_id").agg(
            F.sum(F.col("q_tf") * F.col("tf")).alias("dot"), F.first("q_norm").alias("q_norm"), F.first("norm").alias("norm"))
        return met.select("query_id", "doc_id", F.round(F.col("dot") / (F.col("q_norm") * F.col("norm")), SCORE_DIGITS).alias("score"))

    pilot = top_hits(scored(postings.where(F.pmod(F.xxhash64(F.lit("pilot"), "doc_id"), F.lit(PILOT)) == 0)), k)
    least = cut_lineage(pilot.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")))
    worth = scored(postings).join(least, "query_id", "left").where(F.col("score") >= F.coalesce("least", F.lit(0.0)))
    return top_hits(worth.drop("least"), k)
