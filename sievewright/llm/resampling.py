"""Importance resampling towards a target: hashed word runs, scanned by an Aho-Corasick dictionary of CRC payloads."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import numbered
from .common import SMALL_BATCH, bounded_batches, settle, text_slices, worker_cache

BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
# Bytes of text that are scanned at once, and the most words of a dictionary and their greatest length.
PART_BYTES = 1 << 20
WORDS = 1 << 14
LONG = 64
# CRC-32 of the usual reflected polynomial (fixed value).
POLYNOMIAL = 0xEDB88320

# Bytes of words as they are, A-Z as a-z, all others as a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# The end of a text, as a word of the dictionary, and its payload; FOLD leaves no such byte.
END = b"\x00"
MARK = 1 << 62


def _crc_tables():
    """The table of one byte, and those that carry a CRC over n bytes: n up to LONG, and LONG times each power of two."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)
    over = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(LONG):
        over.append((over[-1] >> np.uint32(8)) ^ byte[over[-1] & np.uint32(255)])
    powers = [over[-1]]
    for _ in range(25):
        powers.append(_carry(powers[-1], powers[-1]))
    return byte, np.stack(over), powers


def _carry(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return (table[0][crc & low] ^ table[1][(crc >> np.uint32(8)) & low]
            ^ table[2][(crc >> np.uint32(16)) & low] ^ table[3][crc >> np.uint32(24)])


def followed(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of texts with CRC `first`, a space, and texts with CRC `second` of `length` bytes."""
    byte, over, powers = worker_cache("crc", _crc_tables)
    crc = ~first
    crc = ~(byte[(crc ^ np.uint32(32)) & np.uint32(255)] ^ (crc >> np.uint32(8)))
    n, low = length % LONG, np.uint32(255)
    out = (over[n, 0, crc & low] ^ over[n, 1, (crc >> np.uint32(8)) & low]
           ^ over[n, 2, (crc >> np.uint32(16)) & low] ^ over[n, 3, crc >> np.uint32(24)])
    times = length // LONG
    for k, table in enumerate(powers):
        at = np.flatnonzero(times >> k & 1)
        if len(at):
            out[at] = _carry(table, out[at])
    return out ^ second


class Dictionary:
    """An Aho-Corasick automaton over the words of some text that occur there more than once, with their payloads.

    Words stand between their delimiters, and neighbours share one, so the automaton reports each word it knows once, in
    order. It is bounded in words and their length; other words are those between two reports.
    """

    def __init__(self, text: bytes):
        import ahocorasick
        counts = Counter(w for w in text.split() if len(w) <= LONG)
        self.automaton = ahocorasick.Automaton()
        self.automaton.add_word(f" {END.decode()} ", MARK)
        for word, n in counts.most_common(WORDS):
            if n > 1 and word != END:
                self.automaton.add_word(f" {word.decode('latin-1')} ", payload(word))
        self.automaton.make_automaton()

    def scan(self, part: bytes) -> tuple[np.ndarray, int]:
        """Payloads of the words of ` w w w `, MARK at the end of a text, and how many words it did not know."""
        found = np.fromiter(chain.from_iterable(self.automaton.iter(part.decode("latin-1"))), np.int64).reshape(-1, 2)
        last, out = found[:, 0], found[:, 1]
        length = np.where(out == MARK, len(END), out >> 32)
        before = np.concatenate([[0], last])
        after = np.append(last - length - 1, len(part) - 1)
        words, places = [], []
        for i in np.flatnonzero(after - before > 1).tolist():  # two delimiters side by side hold no word
            some = part[before[i]:after[i]].split()
            words += some
            places += [i] * len(some)
        return np.insert(out, places, [payload(w) for w in words]), len(words)


def payload(word: bytes) -> int:
    """The CRC of a word and, from bit 32, its length."""
    return zlib.crc32(word) | len(word) << 32


def _scanned(part: bytes) -> np.ndarray:
    """Payloads by the dictionary of this worker; one that knows less than half of a part is built anew from it."""
    held = worker_cache("dictionary", lambda: [Dictionary(part)])
    out, unknown = held[0].scan(part)
    if 2 * unknown > len(out):
        held[0] = Dictionary(part)
    return out


def payloads(texts: list[bytes]) -> np.ndarray:
    """Payloads of the words of all texts in order, each text closed by MARK."""
    data = b" " + b"".join(t.translate(FOLD) + b" " + END + b" " for t in texts)
    out, start = [np.zeros(0, np.int64)], 0
    while start < len(data) - 1:
        stop = min(len(data) - 1, start + PART_BYTES)
        while data[stop] != 32:  # a word is never cut
            stop = data.find(b" ", stop)
        out.append(_scanned(data[start:stop + 1]))
        start = stop
    return np.concatenate(out)


def run_buckets(found: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of one, two and three words that start at each payload (3 x n), and which exist."""
    crc, length = (found & 0xFFFFFFFF).astype(np.uint32), np.where(found == MARK, 0, found >> 32)
    runs, there = np.zeros((3, len(found)), np.int64), np.zeros((3, len(found)), bool)
    now, exists = crc, length > 0
    for k in range(3):
        n = len(found) - k
        if n <= 0:
            break
        if k:
            now = followed(now[:n], crc[k:], length[k:])
            exists = exists[:n] & (length[k:] > 0)
        runs[k, :n], there[k, :n] = now % np.uint32(buckets), exists
    return runs, there


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for part in text_slices(batches, limit=PART_BYTES):
            runs, there = run_buckets(payloads(_texts(part)), buckets)
            counts += np.bincount(runs[there], minlength=buckets)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])
    return run


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of one to three words of all texts fall into each bucket; each task sends one row a bucket."""
    bounded_batches(texts.sparkSession, SMALL_BATCH)
    sums = (texts.select("text").mapInArrow(_counted(buckets), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares of each bucket, rounded down."""
    n, t, s = len(raw), float(target.sum()), float(raw.sum())
    return np.array([math.floor(1000 * math.log((a + 1.0) * (s + n) / ((b + 1.0) * (t + n))))
                     for a, b in zip(target.tolist(), raw.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """1000 times the Gumbel noise of a document, rounded down; no id is the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(gain, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=PART_BYTES):
            found = payloads(_texts(part))
            runs, there = run_buckets(found, len(gain.value))
            ends = np.flatnonzero(found == MARK)
            sums = lambda each: np.diff(np.cumsum(each, dtype=np.int64)[ends], prepend=0)
            weight = sums(np.where(there, gain.value[runs], 0).sum(axis=0))
            score = weight + [noise(i, seed) for i in part.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sums(there[0])), pa.array(sums(there.sum(axis=0))), pa.array(weight),
                 pa.array(score.astype(np.int64))], names=["doc_id", "n_words", "n_features", "weight", "score"])
    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of `docs` (doc_id, text); `target` has text.

    Features are the runs of one to three words of a text, by the CRC of their bytes in `buckets` buckets. A text
    weighs the log ratios of target and raw counts of its features; Gumbel noise from its id makes the highest
    scores a draw without replacement in proportion to these ratios. `percent` of the rows with at least `least_words` words
    are drawn, the highest scores first, ties to the smaller doc_id (no id last); the others have a null rank.

    A null text is empty: no features, weight 0. Repeated rows are scored and drawn each on its own; rows that tie in
    score and id take consecutive ranks in any order. Other columns are ignored; an empty table gives no rows; an empty
    target leaves the raw counts to decide. Texts are read twice; of the corpus the driver sees `buckets` numbers,
    and the ranking is a range sort of narrow rows.
    """
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(bucket_counts(target, buckets), bucket_counts(docs, buckets)))
    scored = settle(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _weighed(gain, seed), "doc_id long, n_words long, n_features long, weight long, score long")
        .withColumn("row", F.monotonically_increasing_id()), "scored")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    placed = numbered(scored, [(~able).asc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "place")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score",
                         F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
