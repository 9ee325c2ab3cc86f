"""Quality rules and the classifier."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from sievewright.llm import quality_model, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(5)}
    n, chars = len(words), sum(map(len, words))
    symbols, dup = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    stop = len(set(words) & set(quality_rules.STOP_WORDS))
    base = n < 10 or 100 * len(covered) > 20 * n
    bad = (100 * symbols > 25 * n or 100 * chars > 2000 * n or (n >= 50 and 100 * n > 60 * chars)
           or 100 * dup > 50 * len(lines) or (n >= 80 and stop < 2))
    return n, chars, symbols, dup, len(covered), base, not (base or bad)


def test_rules(spark, odd, odd_rows, nothing):
    more = ["a b c d e a b c d e f " * 3, "x # | y <b> $5 % & " * 8, "same line\nsame line\n same line\nother", "a b c d e f a b c d e",
            "w " * 5, "w " * 6, "\x85   a\x1cb"]
    texts = [r[1] for r in odd_rows] + more
    table = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = quality_rules.assess(table).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter(map(tuple, got.collect())) == Counter(plain_rules(t) for t in texts)
    kept = quality_rules.kept_documents(odd)
    assert kept.columns == odd.columns
    assert Counter(r.text for r in kept.collect()) == Counter(r[1] for r in odd_rows if plain_rules(r[1])[-1])
    assert quality_rules.kept_documents(nothing).count() == 0


def test_rules_are_one_projection(odd):
    plan = quality_rules.assess(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0] and "Python" not in plan


def test_features_of_odd_texts():
    x = quality_model.features(pa.array([None, "", "\n\n", "a", "é|é", "word " * 10, "x\n" * 3], pa.string()))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()
    assert (quality_model.features(pa.array(["b | c", "word " * 10]))[1] == x[5]).all()


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 6))
    y = ((x[:, 1] > 0.6) ^ (x[:, 4] < 0.3)).astype(float)
    forest = quality_model.fit(x[:3000], y[:3000])
    assert ((quality_model.score(forest, x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def walk(forest, row):
    feature, cut, leaf, base = forest
    total = base
    for t in range(len(leaf)):
        node = 0
        while node < feature.shape[1]:
            node = 2 * node + 1 + int(row[feature[t, node]] > cut[t, node])
        total += leaf[t, node - feature.shape[1]]
    return 1 / (1 + np.exp(-total))


def test_flat_arrays_equal_walking():
    rng = np.random.default_rng(2)
    x = rng.random((300, 5))
    forest = quality_model.fit(x, (x[:, 0] + x[:, 2] > 1).astype(float), trees=7, depth=3)
    assert np.allclose(quality_model.score(forest, x), [walk(forest, r) for r in x])


def test_scores(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(15)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality_model.quality_scores(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    none = quality_model.quality_scores(odd, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_model.quality_scores(nothing, labels).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
