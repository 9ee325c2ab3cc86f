"""Packing token sequences: cutting-stock column generation over a histogram of lengths."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, settle, text_slices, worker_cache

CAPACITY = 4096
# Lengths are planned in steps of so many tokens: a piece leaves less than a step unused. Pieces of up to SHORT steps
# are classes of their exact length, planned in bundles of up to BUNDLE steps.
STEP = 16
SHORT = 4
BUNDLE = 16
END_ID = 2
# The linear program stops when no pattern is worth more than this (1: optimal).
WORTH = 1.0002
# Bytes of the codes that a worker remembers, with so many for each entry itself; longer chunks than KEEP are not kept.
REMEMBERED = 192 << 20
ENTRY = 160
KEEP = 64
# Signs that may follow a word without joining it (fixed values; no apostrophe, which starts contractions).
SIGNS = ".,;:!?)#$%&*|"

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, class int, local long")


class ChunkCodes:
    """Ids of texts as little-endian 32-bit numbers, chunk by chunk between white space.

    The vocabulary's own splitting drops white space, so chunks are encoded independently; those met before are
    looked up. It also parts letters from signs and folds case: a word with signs after it is the word and the signs.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = 0

    def _new(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Codes of chunks that are not known; short ones are remembered."""
        cut = {}
        for chunk in chunks:
            text = chunk.decode()
            word = text.rstrip(SIGNS)
            cut[chunk] = (word.lower() if word.isascii() else word, text[len(word):]) if word.isalpha() else (text, "")
        texts = list({p for pair in cut.values() for p in pair if p not in self.parts})
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        fresh = {t: struct.pack(f"<{len(ids)}I", *ids) for t, ids in zip(texts, [c.ids for c in coded])}
        code = lambda p: fresh[p] if p in fresh else self.parts[p]
        found = {chunk: code(word) + code(tail) for chunk, (word, tail) in cut.items()}
        if self.held > REMEMBERED:
            self.known.clear()
            self.parts.clear()
            self.held = 0
        for known, some in ((self.known, found), (self.parts, fresh)):
            kept = {k: ids for k, ids in some.items() if len(k) <= KEEP}
            known.update(kept)
            self.held += sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY * len(kept)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        rows, gaps, unknown = [], [], set()
        for text in texts:
            chunks = text.encode().split()
            codes = list(map(self.known.get, chunks))
            rows.append(codes)
            if None in codes:
                at = [i for i, code in enumerate(codes) if code is None]
                gaps.append((codes, at, [chunks[i] for i in at]))
                unknown.update(gaps[-1][2])
        found = self._new(unknown) if unknown else {}
        for codes, at, chunks in gaps:
            for i, chunk in zip(at, chunks):
                codes[i] = found[chunk]
        return [b"".join(codes) for codes in rows]


def _pieces(path: str, capacity: int, step: int):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = worker_cache(f"chunks:{path}", lambda: ChunkCodes(path))
        part = TaskContext.get().partitionId()
        ranks = [0] * (SHORT * step + -(-capacity // step) + 1)
        for batch in text_slices(batches):
            rows = []
            coded = codes.encode(batch.column("text").fill_null("").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coded):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    stop = min(n, start + capacity)
                    kind = stop - start if stop - start <= SHORT * step else SHORT * step + -(-(stop - start) // step)
                    rows.append((doc_id, start, stop - start, zlib.crc32(ids[4 * start:4 * stop]), n, part, kind,
                                 ranks[kind]))
                    ranks[kind] += 1
            if rows:
                cols = list(zip(*rows))
                types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[
                    "doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "class", "local"])
    return run


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: an unbounded knapsack by dynamic programming."""
    useful = values > 1e-12
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    worth, room, index = values[useful], sizes[useful], np.flatnonzero(useful)
    for space in range(1, capacity + 1):
        best[space] = best[space - 1]
        fit = room <= space
        if fit.any():
            gains = np.where(fit, best[np.maximum(space - room, 0)] + worth, -1.0)
            at = int(gains.argmax())
            if gains[at] > best[space] + 1e-12:
                best[space], choice[space] = gains[at], at
    pattern, space = np.zeros(len(values), np.int64), capacity
    while space > 0:
        if choice[space] < 0:
            space -= 1
        else:
            pattern[index[choice[space]]] += 1
            space -= int(room[choice[space]])
    return float(best[capacity]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 20_000):
    """Patterns (rows) and real numbers of uses that meet the demand with almost the fewest sequences.

    Revised simplex over the patterns of the basis; the knapsack prices new columns with the duals.
    """
    m = len(sizes)
    patterns = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns))
    uses = inverse @ demand
    for round_no in range(rounds):
        worth, pattern = best_pattern(inverse.sum(axis=0), sizes, capacity)
        if worth <= WORTH:
            break
        change = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, uses / change, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        uses = np.maximum(uses - ratio[out] * change, 0)
        uses[out] = ratio[out]
        patterns[out] = pattern
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        if round_no % 200 == 199:  # wash out rounding errors
            inverse = np.linalg.inv(patterns.T.astype(float))
            uses = np.maximum(inverse @ demand, 0)
    return patterns, uses


def _fit_rest(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Best fit decreasing for the pieces that rounding leaves over."""
    bins, room = [], []
    for c in np.argsort(-sizes, kind="stable"):
        for _ in range(int(demand[c])):
            fits = [(r, i) for i, r in enumerate(room) if r >= sizes[c]]
            if fits:
                i = min(fits)[1]
            else:
                i = len(bins)
                bins.append(np.zeros(len(sizes), np.int64))
                room.append(capacity)
            bins[i][c] += 1
            room[i] -= int(sizes[c])
    return bins


def slots(plan: tuple[np.ndarray, np.ndarray, np.ndarray], kind: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence, and place in its pattern, of the pieces with these ranks in a class.

    The plan holds the classes, the patterns (a row each, pieces by class) and how many sequences use each; the
    slots of a class are numbered pattern by pattern.
    """
    classes, patterns, times = plan
    c = int(np.searchsorted(classes, kind))
    copies = patterns[:, c]
    firsts = np.concatenate([[0], np.cumsum(copies * times)])
    p = np.searchsorted(firsts, rank, side="right") - 1
    within = rank - firsts[p]
    base = np.concatenate([[0], np.cumsum(times)])
    before = patterns[:, c + 1:].sum(axis=1)  # larger classes come first in a sequence
    return base[p] + within // copies[p], before[p] + within % copies[p]


def plan_patterns(classes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Round the uses down and fit what is left over; every piece of the histogram gets one slot."""
    if not len(classes):
        return classes, np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    patterns, uses = cutting_stock(classes, demand.astype(float), capacity)
    times = np.floor(uses + 1e-7).astype(np.int64)
    while ((short := demand - patterns.T @ times) < 0).any():  # rounding errors of the program
        times[np.flatnonzero((patterns[:, short < 0] > 0).any(axis=1) & (times > 0))[0]] -= 1
    rest = _fit_rest(classes, short, capacity)
    if rest:
        patterns, times = np.vstack([patterns, rest]), np.concatenate([times, np.ones(len(rest), np.int64)])
    used = times > 0
    return classes, patterns[used], times[used]


def bundle(length: int, step: int, capacity: int) -> tuple[int, int]:
    """(pieces, steps) of the bundle of pieces of a short length that wastes the smallest part."""
    steps = [u for u in range(1, min(BUNDLE, capacity // step) + 1) if u * step >= length]
    best = max(steps, key=lambda u: (u * step // length * length / u, -u))
    return best * step // length, best


def plan_pieces(kinds: np.ndarray, demand: np.ndarray, capacity: int, step: int):
    """The patterns over steps, and by kind of piece (pieces a bundle, bundles, their class and first, rest's class and first).

    Short pieces of one length fill bundles, which are planned like a piece of their steps; those left over and long
    pieces are planned alone. Ranks in a class of steps go kind by kind.
    """
    items, places = np.zeros(capacity // step + 1, np.int64), {}
    for kind, n in zip(kinds.tolist(), demand.tolist()):
        short = kind <= SHORT * step
        each, steps = bundle(kind, step, capacity) if short else (1, kind - SHORT * step)
        alone = -(-kind // step) if short else steps
        whole, rest = divmod(n, each)
        first = int(items[steps])
        items[steps] += whole
        places[kind] = (each, whole, steps, first, alone, int(items[alone]))
        items[alone] += rest
    classes = np.flatnonzero(items)
    return plan_patterns(classes, items[classes], capacity // step), places


def _assign(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, places = plan.value
        for batch in batches:
            kinds, ranks = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, place = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
            for kind in np.unique(kinds).tolist():
                each, whole, steps, first, alone, first_alone = places[kind]
                bundled = ranks < each * whole
                for rows, size, item, spot in (
                        (bundled, steps, first + ranks // each, ranks % each),
                        (~bundled, alone, first_alone + ranks - each * whole, np.zeros_like(ranks))):
                    rows = rows & (kinds == kind)
                    if rows.any():
                        sequence[rows], at = slots(patterns, size, item[rows])
                        place[rows] = at * (1 << 32) + spot[rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
                + [pa.array(sequence), pa.array(place)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """Pieces of all documents (doc_id, text) and their places in sequences of at most `capacity` tokens.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document is its ids and
    the end id; a null or empty text is the end id alone. Documents longer than a sequence are cut into full ones
    and a rest. Lengths, exact up to SHORT steps and in steps of `step` tokens above, form a histogram, the only thing
    the driver sees; short pieces are planned in bundles, which keeps capacity / step classes; the patterns planned over it
    are dealt to the pieces by their rank in their class. Ranks come from counts by task, so no class passes through one
    task. Repeated rows and ids are packed as they come;
    other columns are ignored; an empty table gives no rows. `tokenizer_path` must exist on every executor.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = settle(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, capacity, step), PIECES), "pieces")
    counts = settle(pieces.groupBy("part", "class").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = counts.groupBy("class").agg(F.sum("n").alias("n")).orderBy("class").toArrow()
    plan = spark.sparkContext.broadcast(plan_pieces(
        histogram.column("class").to_numpy().astype(np.int64), histogram.column("n").to_numpy().astype(np.int64),
        capacity, step))
    placed = (pieces.join(firsts, ["part", "class"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class",
                      (F.col("first") + F.col("local")).alias("rank"))
              .mapInArrow(_assign(plan), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                         "sequence_id long, place long"))
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))
