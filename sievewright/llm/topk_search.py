"""Exact top-k search by inner product: sparse queries accumulate term at a time over blocks of postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.chunks import numbered
from .common import SMALL_BATCH, bounded_batches, settle

K = 10
SCALE = 1024
# Bytes of queries that one pass over all vectors takes, and vectors whose scores are accumulated at once.
ROUND_BYTES = 32 << 20
BLOCK = 8192
LONG = np.iinfo(np.int64)

FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite numbers; Python's whole numbers where 64 bits are too few."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if np.abs(scaled).max(initial=0) < 2.0**62:
        return scaled.astype(np.int64)
    limit = np.finfo(np.float64).max
    return np.array([int(x) for x in np.clip(scaled, -limit, limit).tolist()], object)


def vector_parts(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids (0 for none), whether there is none, lengths and all weights of a batch (row, vec_id, embedding)."""
    ids, vectors = batch.column("vec_id"), batch.column("embedding")
    return (batch.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
            pa.compute.list_value_length(vectors).to_numpy().astype(np.int64),
            whole(vectors.flatten().to_numpy(zero_copy_only=False), scale))


class Block:
    """Postings of some vectors: by term the places of the vectors that have it, and weights; places go by vec_id."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, lengths: np.ndarray, weights: np.ndarray):
        order = np.lexsort((rows, ids, unnamed))
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        self.rows, self.ids, self.unnamed = rows[order], ids[order], unnamed[order]
        self.place = {r: i for i, r in enumerate(self.rows.tolist())}
        owner = np.repeat(place, lengths)
        term = np.arange(len(weights)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.largest = max((abs(int(weights.max())), abs(int(weights.min())))) if len(weights) else 0
        if self.largest < 2**31:
            weights = weights.astype(np.int32)
        some = np.flatnonzero(weights != 0)
        some = some[np.lexsort((owner[some], term[some]))]
        bounds = np.searchsorted(term[some], np.arange(lengths.max(initial=0) + 1))
        held = [(owner[some[a:b]], weights[some[a:b]]) for a, b in zip(bounds, bounds[1:])]
        # A term that all vectors have needs no list of places.
        self.postings = [(slice(None) if len(h) == len(rows) else h, w) for h, w in held]

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact inner products of a sparse query with all vectors of the block, held within 64 bits."""
        most = max(map(abs, weights.tolist()), default=0) * self.largest * len(terms)
        kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
        out = np.zeros(len(self.rows), kind)
        for term, weight in zip(terms.tolist(), weights.tolist()):
            if term < len(self.postings):
                held, values = self.postings[term]
                out[held] += values.astype(kind, copy=False) * (weight if kind is object else kind(weight))
        if kind is object:
            out = np.array([min(max(x, LONG.min), LONG.max) for x in out.tolist()], np.int64)
        return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the first places; in order of place."""
    if k >= len(scores):
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.sort(np.append(above, np.flatnonzero(scores == least)[:k - len(above)]))


class Search:
    """The best hits so far of each query of a round, over the blocks of one task."""

    def __init__(self, queries: list[tuple[int, int, np.ndarray, np.ndarray]], k: int):
        self.queries, self.k = queries, k
        self.hits: list[tuple | None] = [None] * len(queries)

    def look(self, block: Block) -> None:
        for at, (row, _, terms, weights) in enumerate(self.queries):
            scores, own = block.scores(terms, weights), block.place.get(row)
            places = None
            if own is not None:  # a query's own row is no candidate
                places = best(np.delete(scores, own), self.k)
                places += places >= own
            now = self.hits[at]
            if now is not None and len(now[0]) == self.k and (not len(scores) or scores.max() < now[0][-1]):
                continue
            places = best(scores, self.k) if places is None else places
            some = (scores[places].astype(np.int64), block.unnamed[places], block.ids[places], block.rows[places])
            if now is not None:
                some = tuple(np.concatenate(pair) for pair in zip(now, some))
            order = np.lexsort((some[3], some[2], some[1], ~some[0]))[:self.k]
            self.hits[at] = tuple(x[order] for x in some)

    def table(self) -> pa.RecordBatch:
        kept = [(q, h) for q, h in zip(self.queries, self.hits) if h is not None and len(h[0])]
        sizes = [len(h[0]) for _, h in kept]
        column = lambda i, kind: np.concatenate([h[i] for _, h in kept]) if kept else np.zeros(0, kind)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array([q[0] for q, _ in kept], np.int64), sizes)),
             pa.array(np.repeat(np.array([q[1] for q, _ in kept], np.int64), sizes)),
             pa.array(column(3, np.int64)), pa.array(column(2, np.int64), mask=column(1, bool)), pa.array(column(0, np.int64))],
            names=["query_row", "query_id", "row", "vec_id", "score"])


def _found(queries, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, parts, size = Search(queries.value, k), [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                parts.append(vector_parts(batch.slice(start, BLOCK), scale))
                size += len(parts[-1][0])
                if size >= BLOCK:
                    search.look(Block(*map(np.concatenate, zip(*parts))))
                    parts, size = [], 0
        if parts:
            search.look(Block(*map(np.concatenate, zip(*parts))))
        yield search.table()
    return run


def sparse_queries(table: pa.Table, scale: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row, id, terms and weights of each query; only terms that it has."""
    out = []
    for batch in table.to_batches():
        rows, ids, _, lengths, weights = vector_parts(batch, scale)
        for row, vec_id, part in zip(rows.tolist(), ids.tolist(), np.split(weights, np.cumsum(lengths)[:-1])):
            terms = np.flatnonzero(part != 0)
            out.append((row, vec_id, terms.astype(np.int32), part[terms]))
    return out


def top_hits(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE,
             round_bytes: int = ROUND_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest inner products of each query with all other rows.

    `vectors` has vec_id and embedding; rows where `is_query` holds are the queries, and every row but the query's own
    is a candidate. Components become floor(scale * x); scores are whole and exact (and held within 64 bits), ties go to
    the smaller vec_id, none last. Vectors that are null or hold null or non-finite components take no part; where
    lengths differ, missing components are 0; an empty vector scores 0. Repeated rows and ids are queries and
    candidates each on their own. Other columns are ignored; no queries or no other rows give no rows.

    Every vector is scored by every query. Queries pass through the driver in rounds of at most `round_bytes`, each a
    broadcast and one pass over the vectors; a task keeps k hits a query, and Spark merges those of all tasks.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, SMALL_BATCH)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    valid = settle(vectors.select("vec_id", "embedding", is_query.alias("query")).where(F.col("embedding").isNotNull() & finite)
                   .select("query", "vec_id", "embedding", F.monotonically_increasing_id().alias("row")), "vectors")
    asked = numbered(valid.where("query").drop("query"), ["row"], "at")
    longest = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("size")).first()
    each = max(1, round_bytes // (12 * (longest["size"] or 0) + 400 + 40 * k))
    rounds = []
    for start in range(0, longest["n"], each):
        queries = spark.sparkContext.broadcast(sparse_queries(
            asked.where(F.col("at").between(start, start + each - 1)).drop("at").toArrow(), scale))
        rounds.append(settle(valid.select("row", "vec_id", "embedding").mapInArrow(_found(queries, k, scale), FOUND), "hits"))
        queries.unpersist()
    if not rounds:
        rounds = [spark.createDataFrame([], FOUND)]
    hits = rounds[0]
    for more in rounds[1:]:
        hits = hits.unionByName(more)
    best_first = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (hits.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
