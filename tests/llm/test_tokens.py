"""Token counts and packing against the tokenizer libraries."""

import random
import zlib

import numpy as np
import pytest

from sievewright.llm import packing, token_count

public = pytest.importorskip("public_tokenizers")
BPE, PIECES = public.path("word_bpe_49k.json"), public.path("piece_bpe_32k.model")
ALPHABET = list(" \n\t▁abcdeéßü12€<0x>A/s,.日本語😀  ") + ["the ", " and", "<s>", "<|endoftext|>", " ", "\x1c", "é"]


def random_texts(n=3000):
    r = random.Random(4)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)] + [
        "", "   ", " ", "\n", "a" * 3000, " " * 2000, "<s></s><unk><0x0A>", "▁▁ ▁a"]


def test_counts_equal_the_library():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    own = token_count.PieceVocabulary.load(PIECES)
    for text in random_texts():
        assert own.count(text) == len(sp.encode(text)), text


def test_token_counts(odd, odd_rows, nothing):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(odd, PIECES).collect())
    want = []
    for r in odd_rows:
        text, n = r[1] or "", len(sp.encode(r[1] or ""))
        want.append((r[0] or -1, len(text.encode()), n, n > 4096))
    assert got == sorted(want)
    assert token_count.token_counts(nothing, PIECES).count() == 0


def test_chunks_equal_the_whole_text():
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(BPE)
    codes = packing.ChunkCodes(BPE)
    for text in random_texts(1500):
        assert np.frombuffer(codes.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def check_pieces(pieces, documents, capacity):
    """Every id of every document lies in one piece, and sequences are filled without gaps."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    wanted = {}
    for doc_id, ids in documents:
        wanted.setdefault((doc_id, len(ids)), []).append(ids)
    assert set(wanted) == set(by_doc)
    for key, copies in wanted.items():
        want = sorted((s, min(capacity, key[1] - s), zlib.crc32(np.array(ids[s:s + capacity], "<u4").tobytes()))
                      for ids in copies for s in range(0, key[1], capacity))
        assert sorted((p.start, p.length, p.ids_crc32) for p in by_doc[key]) == want
    return len(by_sequence)


@pytest.mark.parametrize("capacity,step", [(4096, 16), (256, 4)])
def test_pack(odd, odd_rows, capacity, step):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(BPE)
    documents = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in odd_rows]
    used = check_pieces(packing.pack(odd, BPE, capacity, step).collect(), documents, capacity)
    assert used <= -(-sum(len(ids) for _, ids in documents) // capacity) + 2


def test_pack_nothing(nothing):
    assert packing.pack(nothing, BPE).count() == 0


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(8)
    sizes = np.unique(rng.integers(1, 65, 40))
    demand = rng.integers(1, 500, len(sizes))
    patterns, uses = packing.cutting_stock(sizes, demand.astype(float), 64)
    assert (patterns @ sizes <= 64).all() and np.allclose(patterns.T @ uses, demand)
    classes, patterns, times = packing.plan_patterns(sizes, demand, 64)
    assert (patterns.T @ times == demand).all() and (patterns @ classes <= 64).all()
    assert times.sum() <= uses.sum() + len(sizes) and times.sum() >= np.ceil(sizes @ demand / 64)
    seen = set()
    for kind, n in zip(sizes.tolist(), demand.tolist()):
        seen |= set(zip(*(x.tolist() for x in packing.slots((classes, patterns, times), kind, np.arange(n)))))
    assert len(seen) == demand.sum()


def test_knapsack_is_optimal():
    rng = np.random.default_rng(9)
    for _ in range(20):
        sizes, values = rng.integers(1, 12, 4), rng.random(4) - 0.2
        best = 0.0
        for a in range(13):
            for b in range(13):
                for c in range(13):
                    for d in range(13):
                        k = np.array([a, b, c, d])
                        if k @ sizes <= 12:
                            best = max(best, k @ values)
        worth, pattern = packing.best_pattern(values, sizes, 12)
        assert abs(worth - best) < 1e-9 and pattern @ sizes <= 12 and abs(pattern @ values - worth) < 1e-9
