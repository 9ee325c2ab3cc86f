"""Token counts by byte-pair merging with a heap over a linked list."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, text_slices, worker_cache

LIMIT = 4096
# Segments whose counts a worker remembers; longer ones than KEEP characters are counted anew.
REMEMBERED = 1_500_000
KEEP = 48
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
SPACE = "▁"


class PieceVocabulary:
    """Ranks of the pieces of a sentencepiece BPE model with byte fallback, for counting only."""

    def __init__(self, pieces: dict[str, float]):
        # A pair merges if its concatenation is a piece; the highest score goes first.
        self.rank = {piece: -score for piece, score in pieces.items()}
        self.pairs = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        self.counts: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> PieceVocabulary:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
                    if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})

    def merges(self, symbols: list[str]) -> int:
        """Number of merges: pop the best adjacent pair, leftmost first, join it, look at its new neighbours."""
        n, rank, done, heap = len(symbols), self.rank, 0, []
        for i in range(n - 1):
            piece = symbols[i] + symbols[i + 1]
            if piece in rank:
                heap.append((rank[piece], i, piece))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, left, piece = heapq.heappop(heap)
            right = after[left]
            # A pair with a side that was joined since then is out of date; joined-away symbols are empty.
            if right == n or not symbols[left] or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, ""
            done += 1
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                longer = piece + symbols[right]
                if longer in rank:
                    heapq.heappush(heap, (rank[longer], left, longer))
            left = before[left]
            if left >= 0:
                longer = symbols[left] + piece
                if longer in rank:
                    heapq.heappush(heap, (rank[longer], left, longer))
        return done

    def stretch(self, text: str) -> int:
        """Tokens of a stretch of characters: symbols, unknown characters as their bytes, less the merges."""
        rank, symbols = self.rank, list(text)
        initial = len(symbols)
        for c in symbols:
            if c not in rank:
                initial += len(c.encode()) - 1
        return initial - self.merges(symbols) if len(symbols) > 1 else initial

    def segment(self, text: str) -> int:
        """Tokens of a segment, cut where two characters stand together in no piece: no merge crosses there."""
        pairs, known = self.pairs, self.counts
        cuts = [i for i, (a, b) in enumerate(zip(text, text[1:]), 1) if a + b not in pairs]
        total, start = 0, 0
        for end in (*cuts, len(text)):
            part = text[start:end]
            count = known.get(part)
            if count is None:
                count = self.stretch(part)
                if end - start <= KEEP:
                    known[part] = count
            total += count
            start = end
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; a space is put before it, and spaces are written as the mark of word starts."""
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ") if SPACE in text else text.split(" ")
        if "" in words:
            # Runs of spaces form pieces of their own: keep each run with the word after it.
            words = [w.replace(" ", SPACE)[1:] for w in re.findall(" +[^ ]*", " " + " ".join(words))]
        total, known = 0, self.counts
        if len(known) > REMEMBERED:
            known.clear()
        for word in words:
            count = known.get(SPACE + word)
            if count is None:
                marked = SPACE + word
                count = self.segment(marked)
                if len(marked) <= KEEP:
                    known[marked] = count
            total += count
        return total


def _counts(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker_cache(f"pieces:{path}", lambda: PieceVocabulary.load(path))
        for batch in text_slices(batches):
            texts = batch.column("text").fill_null("")
            counts = np.array([vocabulary.count(t) for t in texts.to_pylist()], np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.compute.binary_length(texts).cast(pa.int64()),
                "n_tokens": pa.array(counts), "over_limit": pa.array(counts > limit)})
    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit`) of every row of `docs` (doc_id, text).

    The count is that of the model's own BPE encoder over the whole text, without begin or end tokens; names of
    special tokens inside a text are plain characters. Null counts as empty: no bytes, no tokens. Rows are counted
    on their own, so repeated rows, null ids and further columns have no effect; an empty table gives no rows.
    `model_path` must exist on every executor.
    """
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_counts(model_path, limit), COUNTS)
