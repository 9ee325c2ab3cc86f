"""Vectorised work on UTF-8 text: words and shingles of whole Arrow columns as hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import worker_cache

BLOCK = 1 << 20
SHINGLE = 5
WHITE = b" \t\n\x0b\x0c\r"


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables():
    """Byte weights (white space weighs nothing, A-Z as a-z) and the powers that place them."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    weight = rng.integers(0, 2**64, 256, np.uint64, endpoint=False) | np.uint64(1)
    weight[65:91] = weight[97:123]
    weight[list(WHITE)] = 0
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 2**64)
    return weight, white, base, inverse, rng.integers(0, 2**64, 8, np.uint64, endpoint=False) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _setup():
    weight, white, base, inverse, keys = _tables()
    return weight, white, [_powers(base, BLOCK), _powers(inverse, BLOCK)], (base, inverse), keys


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 bounds of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    bounds = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def _blocks(data: np.ndarray, bounds: np.ndarray, white: np.ndarray):
    """Consecutive byte ranges of about BLOCK bytes that end at a word or row end."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + BLOCK)
        while end < n:
            row_end = bounds[np.searchsorted(bounds, end)]
            stretch = white[data[end:min(row_end, end + 4096)]]
            if end == row_end or stretch.any():
                end += 0 if end == row_end else int(stretch.argmax())
                break
            end = min(row_end, end + 4096)
        yield at, end
        at = end


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased in ASCII, and the number of words of each row."""
    weight, white, powers, bases, _ = worker_cache("textops", _setup)
    hashes, starts_all = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, end in _blocks(data, bounds, white):
        part = data[at:end]
        if len(part) > len(powers[0]):
            powers[:] = [_powers(b, len(part)) for b in bases]
        gap = white[part]
        first = np.empty(len(part), bool)
        first[0] = True
        first[1:] = gap[:-1]
        inner = bounds[np.searchsorted(bounds, at):np.searchsorted(bounds, end)] - at
        first[inner] = True
        first &= ~gap
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        values = weight[part]
        values *= powers[0][:len(part)]
        words = np.add.reduceat(values, starts)
        words *= powers[1][starts]
        hashes.append(mixed(words))
        starts_all.append(starts + at)
    counts = np.diff(np.searchsorted(np.concatenate(starts_all), bounds))
    return np.concatenate(hashes), counts


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its five-word shingles.

    A row with fewer words has one shingle, the whole sequence; one without words has none.
    """
    keys = worker_cache("textops", _setup)[4]
    words, counts = word_hashes(*text_buffer(column))
    ends = np.cumsum(counts)
    n = max(0, len(words) - SHINGLE + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        rolled += words[j:j + n] * keys[j]
    mixed(rolled)
    out = []
    for count, end in zip(counts.tolist(), ends.tolist()):
        if count >= SHINGLE:
            out.append(np.unique(rolled[end - count:end - SHINGLE + 1]))
        elif count:
            parts = np.append(words[end - count:end] * keys[:count], np.uint64(count) * keys[SHINGLE:SHINGLE + 1])
            out.append(mixed(parts.sum(keepdims=True, dtype=np.uint64)))
        else:
            out.append(words[:0])
    return out
