"""Business notes: upserts and similarity search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .vector_index import VectorIndex, best_matches, bucket_sizes, postings_of
from .vectors import SCORE_DIGITS, embed, top_hits, vectors

__all__ = ["VectorIndex", "cosine", "current_docs", "docs_for_tables", "embed", "hits_to_docs", "indexed_text", "latest", "search",
           "similar_texts", "similar_vectors", "top_hits", "vectors"]

# Dense queries scored per pass; their matrix is what a task holds.
QUERY_BLOCK = 1024
SCORE_ROWS = 256


def latest(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The current row per key of an append-only log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), seq).alias("r")
                                ).select(key, "r.*")


def current_docs(log: DataFrame) -> DataFrame:
    """`log` has seq, the document columns and `deleted`."""
    return latest(log, "doc_id").filter(~F.coalesce("deleted", F.lit(False))).drop("deleted", "seq")


def indexed_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as it goes into the vectors."""
    return docs.select("doc_id", F.concat("table_fq_name", F.lit(" | "), "title", F.lit("\n"), "content").alias("text"))


def docs_for_tables(tables: DataFrame, docs: DataFrame) -> DataFrame:
    """Every table with its notes; tables without notes stay."""
    return tables.join(docs, "table_fq_name", "left")


def _best_per_query(scores: np.ndarray, keys: np.ndarray, qids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of each query column (all ties at the cut included)."""
    scores = np.round(scores, SCORE_DIGITS)
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
        rows, cols = np.nonzero((scores >= cut) & (scores > 0))
    else:
        rows, cols = np.nonzero(scores > 0)
    return pd.DataFrame({"query_id": qids[cols], "doc_id": keys[rows], "score": scores[rows, cols]})


def _dense_matrix(rows: pd.DataFrame) -> np.ndarray:
    out = np.stack([np.asarray(v, dtype=float) for v in rows["vector"]]) if len(rows) else np.zeros((0, 1))
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def similar_vectors(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Top-k of given dense vectors (column `vector`) per query by cosine. Score all of them against blocks of queries; each Arrow batch keeps its own k best.

    `queries` rows are pulled block by block: a block is what one matrix holds, never the
    whole set.
    """
    spark = docs.sparkSession
    qtype = queries.schema["query_id"].dataType.simpleString()
    dtype = docs.schema["doc_id"].dataType.simpleString()
    schema = f"query_id {qtype}, doc_id {dtype}, score double"
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    if blocks > 1:
        # Each block passes over the vectors; they are made once.
        docs = cut_lineage(docs)
    block_of = F.pmod(F.xxhash64(F.col("query_id")), F.lit(blocks))
    out = None
    for number in range(blocks):
        part = queries.filter(block_of == number).toPandas() if blocks > 1 else queries.toPandas()
        if part.empty:
            continue
        shared = spark.sparkContext.broadcast(
            (part["query_id"].to_numpy(), _dense_matrix(part).T.copy()))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qids, matrix = shared.value
            best = None
            for batch in batches:
                for at in range(0, len(batch), SCORE_ROWS):
                    piece = batch.iloc[at:at + SCORE_ROWS]
                    found = _best_per_query(_dense_matrix(piece) @ matrix, piece["doc_id"].to_numpy(), qids, k)
                    best = found if best is None else pd.concat([best, found], ignore_index=True)
                    # Ranked like the final result, so exactly k per query are enough.
                    best = (best.sort_values(["score", "doc_id"], ascending=[False, True])
                            .groupby("query_id", sort=False).head(k))
            if best is not None:
                yield best

        hits = docs.mapInPandas(score, schema)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], schema)
    return top_hits(out, k)


def similar_texts(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Top-k documents per query by cosine; both sides are `vectors` rows (doc_id / query_id)."""
    postings = cut_lineage(postings_of(docs))
    return best_matches(postings, bucket_sizes(postings), postings_of(queries, "query_id"), k)


def hits_to_docs(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits joined back to their documents; ids without one are skipped."""
    return hits.join(docs, "doc_id")


def search(docs: DataFrame, queries: DataFrame, k: int = 5, table: str | None = None,
           overfetch: bool = False, index: VectorIndex | None = None) -> DataFrame:
    """Documents for query texts (query_id, text), best first.

    With a table, documents are filtered before ranking. `overfetch=True` ranks 3k documents
    of all tables first and filters then, which may return fewer than k. A kept `index` over
    `indexed_text(docs)` is read if given; without one the documents are indexed for this call.
    """
    chosen = docs if table is None or overfetch else docs.filter(F.col("table_fq_name") == table)
    fetch = k * 3 if table is not None and overfetch else k
    if index is None:
        hits = similar_texts(vectors(indexed_text(chosen)), vectors(queries, "query_id"), fetch)
    else:
        hits = index.search(queries, fetch, None if chosen is docs else chosen)
    hits = hits_to_docs(hits, chosen)
    if table is not None and overfetch:
        again = Window.partitionBy("query_id").orderBy("rank")
        hits = (hits.filter(F.col("table_fq_name") == table)
                .withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= k))
    return hits


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return dot / (norm(a) * norm(b))
