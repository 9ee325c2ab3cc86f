"""Resampling, exact search and collocations against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sievewright.llm import collocations, resampling, topk_search
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    ws = WORD.findall((text or "").translate(LOWER))
    return ws, Counter(zlib.crc32(" ".join(ws[i:i + m]).encode()) % 10000 for m in (1, 2, 3) for i in range(len(ws) - m + 1))


def plain_resample(rows, target, percent=5):
    t, s = Counter(), Counter()
    for x in target:
        t.update(plain_features(x)[1])
    feats = [plain_features(x) for _, x in rows]
    for _, f in feats:
        s.update(f)
    nt, ns = sum(t.values()), sum(s.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000))))
    out = []
    for (i, _), (ws, f) in zip(rows, feats):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(b) for b, n in f.items())
        out.append((i, len(ws), sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-r[4], r[0] is None, r[0] or 0) for r in out if r[1] >= 20)
    return out, able[:percent * len(able) // 100]


def test_composed_crcs():
    r = random.Random(3)
    texts = ["".join(r.choice("ab Éß日,Z9") for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += ["", " ", "x" * 1000 + " y " + "z" * 5000 + " x", "q" * 65 + " " + "q" * 64 + " " + "q" * 128, "one"]
    found = resampling.payloads([t.encode() for t in texts])
    runs, there = resampling.run_buckets(found, 10000)
    ends = np.flatnonzero(found == resampling.MARK)
    assert len(ends) == len(texts)
    start = 0
    for text, end in zip(texts, ends.tolist()):
        got = Counter(runs[:, start:end][there[:, start:end]].tolist())
        assert got == plain_features(text)[1], text
        start = end + 1


def test_parts_do_not_cut_words(monkeypatch):
    texts = ["alpha beta gamma " * 50, "", "w" * 700 + " tail", "ß" * 40] * 3
    whole = resampling.payloads([t.encode() for t in texts])
    monkeypatch.setattr(resampling, "PART_BYTES", 37)
    assert (resampling.payloads([t.encode() for t in texts]) == whole).all()


@pytest.mark.parametrize("percent", [5, 40])
def test_resample(spark, odd, odd_rows, percent):
    target = ["the of and to the of", None, "", "shared line here"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, rank int")
    got = resampling.resample(odd, bench, percent=percent).collect()
    want, drawn = plain_resample([(r[0], r[1]) for r in odd_rows], target, percent)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(key, [tuple(r)[:5] for r in got])) == sorted(map(key, want))
    ranked = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranked] == drawn


def test_resample_nothing(spark, nothing, odd):
    assert resampling.resample(nothing, odd).count() == 0
    assert resampling.resample(odd, nothing).where("weight is null or score is null").count() == 0


def held(score):
    return min(max(score, -2**63), 2**63 - 1)


def plain_hits(rows, k=10):
    ok = [(i, v, [math.floor(1024 * x) for x in e]) for i, (v, e) in enumerate(rows)
          if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q, a in ok:
        if q is not None and q % 100 == 0:
            some = sorted((-held(sum(x * y for x, y in zip(a, b))), v is None, v or 0) for j, v, b in ok if j != i)
            out += [(q, n, None if none else v, -s) for n, (s, none, v) in enumerate(some[:k], 1)]
    return sorted(out, key=lambda r: tuple((x is None, x or 0) for x in r))


def vector_rows():
    r = random.Random(8)
    rows = [(i, [round(r.uniform(-1, 1), 3) if r.random() < 0.7 else 0.0 for _ in range(r.choice((6, 6, 6, 3)))]) for i in range(230)]
    rows += [(i, [0.5, -0.25, 1.0]) for i in range(300, 340)]  # a group of copies, one of them a query
    rows += [(100, rows[100][1]), (100, None), (None, [1.0] * 6), (None, [1.0] * 6), (400, [float("nan"), 1.0]),
             (500, [float("inf")]), (600, []), (601, [None, 1.0]), (700, [0.0] * 6)]
    return rows


@pytest.mark.parametrize("block, round_bytes", [(8192, 32 << 20), (7, 1500)])
def test_top_hits(spark, monkeypatch, block, round_bytes):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    rows = vector_rows()
    df = spark.createDataFrame([(v, e, 1, "x") for v, e in rows], "vec_id long, embedding array<double>, rank int, query_id string")
    got = topk_search.top_hits(df.repartition(3), F.col("vec_id") % 100 == 0, round_bytes=round_bytes).collect()
    assert sorted(map(tuple, got), key=lambda r: tuple((x is None, x or 0) for x in r)) == plain_hits(rows)


def test_large_numbers_stay_exact(spark):
    rows = [(0, [1e15, 1.0, -3.0]), (1, [1e6, 7.0, 0.001]), (2, [1e12, -1.0, 2.0]), (3, [-1e15, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk_search.top_hits(df, F.col("vec_id") % 100 == 0).collect())) == plain_hits(rows)


def test_no_queries(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_hits(none, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, [1.0]), (None, None)], "vec_id long, embedding array<float>")
    assert topk_search.top_hits(one, F.col("vec_id") % 100 == 0).count() == 0


def plain_collocations(rows, least, best):
    count, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = tuple(re.findall("[^\x20\x09]+", piece))
            sizes[lang] += len(ws)
            count.update((lang, ws[i:i + m]) for m in range(1, 6) for i in range(len(ws) - m + 1))
    found = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    inside = {(lang, ws[i:j]) for (lang, ws), a in found.items() for i in range(len(ws)) for j in range(i + 2, len(ws) + 1)
              if j - i < len(ws) and 100 * a >= 100 * count[lang, ws[i:j]]}
    out = []
    for lang in sizes:
        rows = []
        for (of, ws), a in found.items():
            if of == lang and (lang, ws) not in inside:
                s, _, l, r = min((1000 * a * sizes[lang] // (count[lang, ws[:k]] * count[lang, ws[k:]]), k,
                                  count[lang, ws[:k]], count[lang, ws[k:]]) for k in range(1, len(ws)))
                rows.append((-s, -a, " ".join(ws).encode(), l, r))
        out += [(lang, n, p.decode(), -a, l, r, sizes[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


def phrase_rows():
    r = random.Random(5)
    words = ["of", "the", "a", "é", "日本", "\x01", "x" * 300] + [f"w{i}" for i in range(30)]
    text = lambda n: "".join(r.choice(words[:r.choice((4, 37))]) + r.choice([" ", " ", " ", "\t ", ", ", "\n", "."]) for _ in range(n))
    rows = [(r.choice(("en", "de", None, "und")), text(r.randint(0, 60))) for _ in range(150)]
    rows += [("en", "Of the same fixed line here again")] * 40 + [("en", None), (None, ""), ("de", " \t\n.. ,"), ("en", text(4000))]
    return rows


@pytest.mark.parametrize("bucket_rows, hot, flush", [(500_000, 200_000, 1 << 20), (300, 30, 500), (40, 4, 200)])
def test_collocations(spark, monkeypatch, bucket_rows, hot, flush):
    monkeypatch.setattr(collocations, "FLUSH", flush)
    monkeypatch.setattr(collocations, "LOCAL_HOT", 2)
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(4)
    got = collocations.collocations(df, least=5, best=60, bucket_rows=bucket_rows, hot=hot)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 5, 60)


def test_collocations_in_known_words_only(spark, monkeypatch):
    monkeypatch.setattr(collocations, "KNOWN", 10)  # codes start anew again and again
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    got = collocations.collocations(df, least=5, best=None)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 5, None)


def test_collocations_of_nothing(spark, nothing, odd):
    assert collocations.collocations(nothing).count() == 0
    assert collocations.collocations(odd, least=10**6).count() == 0


def test_exact_beyond_64_bits(spark):
    rows = [("en", "big pair")] * 3 + [("en", " ".join(["pad"] * 3))]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=2).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 2, 2000)
    a, n, l, r = 4 * 10**12, 9 * 10**12, 5 * 10**12, 6 * 10**12
    one = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").select(collocations.score().alias("s")).first()
    assert one.s == 1000 * a * n // (l * r)
