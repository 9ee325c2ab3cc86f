"""Sparse text vectors: hashed bags of words, and the ranking of hits."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BUCKETS, TOKEN, tokens

# Scores are compared after rounding, so copies of a text tie exactly.
SCORE_DIGITS = 9
# Tokens that a task counts at once, unless one text has more.
TOKENS_AT_ONCE = 1 << 20


def _bags(words: pa.Array, lengths: np.ndarray) -> list[pa.Array]:
    """Buckets, tfs and norm of texts that have so many of the words each; the buckets are those of `term_bucket`."""
    known = words.dictionary_encode()
    buckets = np.array([int(md5(w, usedforsecurity=False).hexdigest()[5:8], 16)
                        for w in known.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.int64)
    places = np.repeat(np.arange(len(lengths)), lengths) * BUCKETS + buckets[known.indices.to_numpy(zero_copy_only=False)]
    places, tfs = np.unique(places, return_counts=True)
    rows, found = np.divmod(places, BUCKETS)
    starts = pa.array(np.searchsorted(rows, np.arange(len(lengths) + 1)), pa.int32())
    squares = np.bincount(rows, weights=tfs * tfs, minlength=len(lengths))
    return [pa.ListArray.from_arrays(starts, pa.array(found, pa.int32())),
            pa.ListArray.from_arrays(starts, pa.array(tfs, pa.int64())), pa.array(np.sqrt(squares), pa.float64())]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tokens) rows as vectors."""
    for batch in batches:
        keys, terms = batch.columns
        offsets = terms.offsets.to_numpy()
        at = 0
        while at < len(keys):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOKENS_AT_ONCE, side="right")) - 1)
            words = terms.values.slice(offsets[at], offsets[to] - offsets[at])
            yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), *_bags(words, np.diff(offsets[at:to + 1]))],
                                             names=[batch.schema.names[0], "buckets", "tfs", "norm"])
            at = to


def vectors(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, buckets, tfs, norm): hashed bag of words of each text.

    A text is one row, so its terms are counted in place, in Arrow batches: a term is hashed once
    for all texts that are counted together. Nothing is shuffled. Texts without terms have no vector.
    """
    held = texts.filter(F.col(text).rlike(TOKEN)).select(key, tokens(F.col(text)).alias("terms"))
    return held.mapInArrow(_counted, f"`{key}` {held.schema[key].dataType.simpleString()}, buckets array<int>, tfs array<bigint>, norm double")


def embed(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bucket, tf, weight): the same vectors as postings of unit length."""
    return vectors(texts, key, text).select(key, "norm", F.inline(F.arrays_zip("buckets", "tfs"))).select(
        key, F.col("buckets").alias("bucket"), F.col("tfs").alias("tf"),
        (F.col("tfs") / F.col("norm")).alias("weight"))


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best positive scores per query, ties by document."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return (hits.filter(F.col("score") > 0).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k))
