"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievewright.llm import components, exact_dedup, minhash, textops


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute_components(rows):
    """{doc_id: component} by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, set()).add(shingles(text))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                for x in sets[a]:
                    for y in sets[b]:
                        if x and y and 100 * len(x & y) >= 75 * len(x | y):
                            r, s = root(a), root(b)
                            parent[max(r, s)] = min(r, s)
    return {i: root(i) for i in ids}


def test_shingle_sets_match_words(odd_rows):
    texts = [r[1] for r in odd_rows]
    got = textops.shingle_sets(pa.array(texts, pa.string()))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    same = {}
    for t, s in zip(texts, got):
        assert same.setdefault(shingles(t), s.tobytes()) == s.tobytes()


def test_words_across_blocks(monkeypatch):
    monkeypatch.setattr(textops, "BLOCK", 16)
    texts = ["alpha beta gamma delta epsilon zeta", "", "verylongwordthatisnotcut by a block or two", "alpha beta gamma delta epsilon zeta"]
    words, counts = textops.word_hashes(*textops.text_buffer(pa.array(texts)))
    assert counts.tolist() == [6, 0, 6, 6]
    assert words[:6].tolist() == words[12:].tolist() and len(set(words.tolist())) == 12


def test_densification_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (6, 40, 400, 3000):
        agree = []
        for _ in range(30):
            pool = np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False))
            a, b = pool[: int(n * 0.9)], pool[int(n * 0.1):]
            both = minhash.one_permutation(np.sort(a)) == minhash.one_permutation(np.sort(b))
            agree.append(both.mean())
        assert abs(np.mean(agree) - 0.8) < 0.1


def test_near_duplicates(odd, odd_rows):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    want = brute_components([(r[0], r[1]) for r in odd_rows if r[0] is not None])
    texts = Counter((r[0], len(shingles(r[1]))) for r in odd_rows)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == texts
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert want[7] == want[8] == 6


@pytest.mark.parametrize("listed,hubs", [(128, 64), (2, 1)])
def test_chains_and_crowded_buckets(spark, monkeypatch, listed, hubs):
    """Documents around one passage, some linked only through others; large buckets go through every path."""
    monkeypatch.setattr(minhash, "LISTED", listed)
    monkeypatch.setattr(minhash, "HUBS", hubs)
    r = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join([f"q{r.random()}" for _ in range(r.choice([4, 30, 60]))] + passage)))
    for i in range(40, 60):  # a chain: each changes a little of the one before
        at = r.randrange(len(passage))
        passage = passage[:at] + [f"n{i}"] + passage[at + 1:]
        rows.append((i, " ".join(passage)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == brute_components(rows)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x.node: x.component for x in got} == {x: root(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_duplicates(odd, odd_rows):
    got = exact_dedup.exact_duplicates(odd).collect()
    groups = {}
    for r in odd_rows:
        groups.setdefault(lowered(r[1]), []).append(r[0])
    assert len(got) == len(odd_rows)
    kept = Counter()
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        if r.kept:
            assert r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    parts = [rng.integers(-50, 50, n).astype(np.int64) * 0x123456789ABCDE for n in (1000, 10, 1, 700)]
    merged = {}
    for part in parts:
        for block, rest, counts in exact_dedup.build_filter(part, 5):
            piece = np.frombuffer(rest, np.uint64), np.frombuffer(counts, np.int64)
            assert (np.diff(piece[0].astype(object)) > 0).all()
            merged[block] = exact_dedup.merge(merged[block], piece) if block in merged else piece
    got = {(b << 59) | int(v): int(c) for b, (rest, counts) in merged.items() for v, c in zip(rest, counts)}
    assert got == Counter(int(x) % 2**64 for x in np.concatenate(parts).tolist())


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """Texts with one fingerprint but different bytes stay apart."""
    monkeypatch.setattr(exact_dedup, "_print", lambda text: len(text))
    rows = [(1, "ab"), (2, "cd"), (3, "AB"), (4, "xyz")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in
           exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}


def test_empty_tables(nothing):
    assert minhash.near_duplicates(nothing).count() == 0
    assert exact_dedup.exact_duplicates(nothing).count() == 0
