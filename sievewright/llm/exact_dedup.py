"""Exact duplicates: counting quotient filters of fingerprints, then the bytes of what they flag."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, bitmap_of, bounded_batches, passes, settle, text_slices
from .textops import text_buffer

# Fingerprints that one merge of filter blocks should hold.
BLOCK_ROWS = 1 << 19
PIECE_ROWS = 4 << 20
PRINTS = "doc_id long, row long, fingerprint long, text_sha256 string"
FILTER = "block int, remainders binary, counts binary"


def _lowered(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 with A-Z lower-cased; no other byte of UTF-8 lies in A-Z."""
    data, bounds = text_buffer(column)
    upper = (data >= 65) & (data <= 90)
    raw = memoryview((data + upper.astype(np.uint8) * np.uint8(32)).tobytes())
    ends = bounds.tolist()
    return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]


def _print(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 40
    for batch in text_slices(batches):
        texts = _lowered(batch.column("text"))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "row": pa.array(np.arange(at, at + len(texts))),
            "fingerprint": pa.array([_print(t) for t in texts], pa.int64()),
            "text_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())})
        at += len(texts)


def build_filter(prints: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes]]:
    """A counting quotient filter of fingerprints: (quotient, sorted remainders, their counts).

    The quotient is the high `bits` of a fingerprint, the remainder all others, so nothing is lost. A run holds
    each remainder once, sorted, beside its count.
    """
    values, counts = np.unique(prints.view(np.uint64), return_counts=True)
    shift = np.uint64(64 - bits)
    quotients = (values >> shift).astype(np.int64)
    bounds = np.flatnonzero(np.diff(quotients, prepend=-1, append=-1)).tolist()
    rest = values & ((np.uint64(1) << shift) - np.uint64(1))
    return [(int(quotients[a]), rest[a:b].tobytes(), counts[a:b].astype(np.int64).tobytes())
            for a, b in zip(bounds, bounds[1:])]


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs as one; counts of equal remainders add up."""
    rest = np.concatenate([a[0], b[0]])
    order = np.argsort(rest, kind="stable")  # two sorted runs: this is a merge
    rest, counts = rest[order], np.concatenate([a[1], b[1]])[order]
    starts = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]])) if len(rest) else np.zeros(0, np.int64)
    return rest[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _build(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One filter a partition, passed on whenever it has grown to a bounded size."""
        held, size = [], 0

        def out():
            rows = build_filter(np.concatenate(held), bits)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                               pa.array([r[1] for r in rows], pa.binary()),
                                               pa.array([r[2] for r in rows], pa.binary())],
                                              names=["block", "remainders", "counts"])

        for batch in batches:
            held.append(batch.column("fingerprint").to_numpy())
            size += batch.num_rows
            if size >= PIECE_ROWS:
                yield out()
                held, size = [], 0
        if size:
            yield out()
    return run


def _merge_blocks(bits: int):
    def run(key, table):
        """Merge the pieces of a quotient, small ones first, and give the fingerprints counted more than once."""
        stack: list[tuple[np.ndarray, np.ndarray]] = []
        for rest, counts in zip(table.column("remainders"), table.column("counts")):
            piece = np.frombuffer(rest.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64)
            while stack and len(stack[-1][0]) <= 2 * len(piece[0]):
                piece = merge(stack.pop(), piece)
            stack.append(piece)
        while len(stack) > 1:
            last = stack.pop()
            stack.append(merge(stack.pop(), last))
        rest, counts = stack[0]
        many = counts > 1
        prints = (rest[many] | (np.uint64(key[0].as_py()) << np.uint64(64 - bits))).view(np.int64)
        return pa.table({"fingerprint": pa.array(prints), "times": pa.array(counts[many])})
    return run


def repeated_prints(prints: DataFrame) -> DataFrame:
    """(fingerprint, times) of the fingerprints that occur more than once."""
    rows = prints.count()
    bits = max(5, (rows // BLOCK_ROWS).bit_length())
    return (prints.select("fingerprint").mapInArrow(_build(bits), FILTER)
            .groupBy("block").applyInArrow(_merge_blocks(bits), "fingerprint long, times long"))


def _flagged(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = _lowered(batch.column("text"))
            prints = np.array([_print(t) for t in texts], np.int64)
            mask = passes(bitmap.value, prints & ((1 << FILTER_BITS) - 1))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").filter(pa.array(mask)),
                "fingerprint": pa.array(prints[mask]),
                "bytes": pa.array([texts[i] for i in np.flatnonzero(mask).tolist()], pa.binary())})
    return run


def verified_groups(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(fingerprint, text_sha256, keep_id, group_size) of the texts that occur more than once, byte for byte.

    A bitmap of the repeated fingerprints, of fixed size, picks the texts; what it lets through by chance forms
    groups of one and goes. Copies are counted within each task first, so a text that fills a third of the table
    is shuffled once a task.
    """
    spark = docs.sparkSession
    slots = repeated.select(F.expr(f"fingerprint & {(1 << FILTER_BITS) - 1}").alias("slot"))
    bitmap = spark.sparkContext.broadcast(bitmap_of(slots))
    flagged = docs.select("doc_id", "text").mapInArrow(_flagged(bitmap), "doc_id long, fingerprint long, bytes binary")
    return (flagged.groupBy("fingerprint", "bytes")
            .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            .where("group_size > 1")
            .select("fingerprint", F.sha2("bytes", 256).alias("text_sha256"), "keep_id", "group_size"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of `docs` (doc_id, text).

    Texts are equal when their bytes are, after lower-casing A-Z; null counts as empty. The row with the largest
    doc_id of a group stays. Of rows that share that doc_id too, one stays. A null doc_id is below all others; a group
    without any doc_id keeps one row, with a null keep_id. Other columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    prints = settle(docs.select("doc_id", "text").mapInArrow(_prints, PRINTS), "prints")
    repeated = settle(repeated_prints(prints), "repeated")
    groups = settle(verified_groups(docs, repeated), "groups")
    named = settle(prints.join(groups, ["fingerprint", "text_sha256"], "left"), "named")
    grouped = F.col("group_size").isNotNull()
    ties = settle(named.where(grouped & F.col("doc_id").eqNullSafe(F.col("keep_id")))
                  .groupBy("fingerprint", "text_sha256").agg(F.min("row").alias("first"), F.count("*").alias("n"))
                  .where("n > 1").drop("n"), "ties")
    out = named.join(ties, ["fingerprint", "text_sha256"], "left")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.coalesce(F.col("row") == F.col("first"), F.lit(True))
    return out.select("doc_id", F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).alias("group_size"),
                      (~grouped | stays).alias("kept"), "text_sha256")
