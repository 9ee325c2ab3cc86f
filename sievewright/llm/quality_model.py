"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_slices
from .textops import text_buffer, word_hashes

# The model is fitted on at most so many labelled rows, those of least hash.
FIT_ROWS = 20_000
THRESHOLD = 0.3
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.12
SHRINK = 2.0
LEAST_ROWS = 10

# Byte classes that statistics count.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
           "space": b" ", "break": b"\n", "stop": b".", "comma": b",;:", "bang": b"!", "query": b"?", "hash": b"#",
           "star": b"*", "money": b"$", "percent": b"%", "and": b"&", "bar": b"|", "angle": b"<>", "slash": b"/\\",
           "bracket": b"()[]{}", "mark": b"=+_@~^`", "quote": b"\"'-"}
ODD = ("bang", "hash", "star", "money", "percent", "and", "bar", "angle", "mark")


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES) + 1, np.uint8)  # the last: bytes of other letters
    table[:128] = len(CLASSES)
    for i, members in enumerate(CLASSES.values()):
        table[list(members)] = i
    return table


def _spread(values: np.ndarray, counts: np.ndarray, reduce, empty: float = 0.0) -> np.ndarray:
    """A reduction over consecutive runs of `counts` values; `empty` for runs of none."""
    out = np.full(len(counts), empty)
    some = counts > 0
    if some.any():
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[some]
        out[some] = reduce.reduceat(values, starts)
    return out


def features(column: pa.Array) -> np.ndarray:
    """Statistics of each text, a row each; texts without bytes or words give zeros."""
    data, bounds = text_buffer(column)
    rows, size = len(bounds) - 1, np.diff(bounds)
    kinds = _class_table()[data]
    n_kinds = len(CLASSES) + 2
    names = list(CLASSES)

    # Bytes by class, line by line; a line ends after its break or with its row.
    ends = np.unique(np.concatenate([np.flatnonzero(kinds == names.index("break")) + 1, bounds[1:]]))
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    length = ends - starts
    owner = np.searchsorted(bounds, starts, side="right") - 1
    line_of = np.repeat(np.arange(len(ends)), length)
    by_line = np.bincount(line_of * n_kinds + kinds, minlength=len(ends) * n_kinds).reshape(len(ends), n_kinds)
    lines = np.bincount(owner, minlength=rows)
    by_row = np.stack([_spread(by_line[:, k].astype(float), lines, np.add) for k in range(n_kinds)], axis=1)
    odd = by_line[:, [names.index(k) for k in ODD]].sum(axis=1) / np.maximum(length, 1)
    upper = by_line[:, names.index("upper")] / np.maximum(length, 1)
    full = np.where(length >= 20, odd, 0.0)

    words, counts = word_hashes(data, bounds)
    cut = np.concatenate([[0], np.cumsum(counts)])
    distinct, twice, most = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        if b - a > 1:
            ordered = np.sort(words[a:b])
            runs = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))
            distinct[i], most[i] = len(runs), runs.max()
            pairs = np.sort(words[a:b - 1] * np.uint64(0x9E3779B97F4A7C15) + words[a + 1:b])
            twice[i] = (pairs[1:] == pairs[:-1]).sum()
    per = np.maximum(counts, 1)
    share = by_row / np.maximum(size, 1)[:, None]
    total = by_row.sum(axis=1) - by_row[:, names.index("space")] - by_row[:, names.index("break")]
    return np.column_stack([
        share, by_row[:, [names.index(k) for k in (*ODD, "stop", "comma", "digit")]] / per[:, None],
        np.log1p(counts), np.log1p(size), total / per, distinct / per, twice / per, most / per,
        np.log1p(lines), counts / np.maximum(lines, 1),
        _spread(odd, lines, np.maximum), _spread(full, lines, np.maximum),
        _spread((odd > 0.05).astype(float), lines, np.add) / np.maximum(lines, 1),
        _spread(upper, lines, np.maximum), _spread((odd * length), lines, np.add) / per,
        _spread(((odd > 0.05) * length).astype(float), lines, np.add) / np.maximum(size, 1)])


def score(forest: tuple, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1: all rows walk down a tree together, level by level.

    Trees are complete and lie flat in arrays: a feature and a cut for each inner node, a value for each leaf.
    """
    feature, cut, leaf, base = forest
    total, rows = np.full(len(x), base), np.arange(len(x))
    depth = int(np.log2(leaf.shape[1])) if len(leaf) else 0
    for t in range(len(leaf)):
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, feature[t, node]] > cut[t, node])
        total += leaf[t, node - (leaf.shape[1] - 1)]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> tuple:
    """Boost trees on the logistic loss; each level is one histogram of gradients over (node, feature, bin).

    Without rows the score is 0.5; with one label only it is that of a smoothed share.
    """
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    n, m = x.shape
    if n < 2 * LEAST_ROWS or y.min() == y.max():
        return np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)), base
    cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
    binned = np.stack([np.searchsorted(cuts[:, j], x[:, j], side="left") for j in range(m)], axis=1)
    flat = binned + np.arange(m) * BINS
    inner, leaves = 2 ** depth - 1, 2 ** depth
    out_f, out_c, out_l = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within the level
        for level in range(depth):
            width, first = 2 ** level, 2 ** level - 1
            at = (node[:, None] * (m * BINS) + flat).ravel()
            size = width * m * BINS
            hist = [np.bincount(at, np.repeat(w, m) if w is not None else None, size).reshape(width, m, BINS)
                    for w in (g, h, None)]
            gl, hl, nl = (np.cumsum(a, axis=2)[:, :, :-1] for a in hist)
            gs, hs, ns = (a.sum(axis=2, keepdims=True) for a in hist)
            gain = gl**2 / (hl + SHRINK) + (gs - gl)**2 / (hs - hl + SHRINK) - gs**2 / (hs + SHRINK)
            gain = np.where((nl >= LEAST_ROWS) & (ns - nl >= LEAST_ROWS), gain, 0).reshape(width, -1)
            best = gain.argmax(axis=1)
            split = gain[np.arange(width), best] > 1e-6
            f, b = best // (BINS - 1), best % (BINS - 1)
            out_f[t, first:first + width] = f
            out_c[t, first:first + width] = np.where(split, cuts[b, f], np.inf)
            node = 2 * node + ((binned[np.arange(n), f[node]] > b[node]) & split[node])
        sums_g, sums_h = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        out_l[t] = -RATE * sums_g / (sums_h + SHRINK)
        margin += out_l[t, node]
    return out_f, out_c, out_l, base


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(features(batch.column("text"))),
                                                                          pa.list_(pa.float64()))],
                                         names=["label", "x"])


def fit_on(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> tuple:
    """A model of labels (doc_id, label) fitted on the texts of docs; at most `most` labels, those of least hash."""
    bounded_batches(docs.sparkSession)
    chosen = (labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        F.col("label").cast("double").alias("label"), "text").mapInArrow(_features, "label double, x array<double>").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, 1)), np.zeros(0))
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(rows.num_rows, -1)
    y = rows.column("label").to_numpy()
    order = np.lexsort((*x.T, y))  # the fit must not depend on the order in which rows arrive
    return fit(x[order], y[order])


def _scores(forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score(forest, features(batch.column("text"))))], names=["doc_id", "score"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs` (doc_id, text).

    `labels` has doc_id and quality (0 or 1). Rows whose crc32 of the id as text is divisible by 5 are held out of
    the fit, and only the text is an input of a score. Null and empty texts are scored like any other, as a text of
    length 0. Rows with a null id are not held out. Repeated rows get equal scores; conflicting labels of an id count
    as 1; without labels every score is 0.5. Other columns are ignored; an empty table gives no rows.
    """
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    fitted = fit_on(docs, labels.where(~held).select("doc_id", F.col("quality").alias("label")))
    scored = docs.select("doc_id", "text").mapInArrow(_scores(fitted), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
