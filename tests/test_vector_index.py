"""The kept index against brute force, after building, changing and deleting."""

import math
import os
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.functions.text import term_bucket
from sievewright.operators import knowledge as K, vector_index as V, vectors

WORDS = [f"w{i}" for i in range(300)]


def texts(seed, n):
    """Some words stand in almost all texts, most in few; some texts are equal."""
    r = random.Random(seed)
    out = {}
    for i in range(n):
        common = r.choices(["the", "of", "and", "to"], k=r.randint(0, 12))
        rare = [WORDS[min(int(r.paretovariate(0.6)), len(WORDS)) - 1] for _ in range(r.randint(0, 12))]
        out[i] = " ".join(r.sample(common + rare, len(common + rare)))
    out.update({n + i: out[5] for i in range(12)})
    out.update({n + 20: "the the of", n + 21: "", n + 22: None, n + 23: "only here"})
    return out


@pytest.fixture(scope="module")
def buckets(spark):
    words = [*WORDS, "the", "of", "and", "to", "only", "here", "new", "zzz"]
    return {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", term_bucket(F.col("w")).alias("b")).collect()}


def brute(docs, asked, buckets, k):
    vec = {i: Counter(buckets[w] for w in (t or "").split()) for i, t in docs.items()}
    out = []
    for q, text in asked.items():
        qv = Counter(buckets[w] for w in text.split())
        norm = lambda v: math.sqrt(sum(n * n for n in v.values()))
        scored = [(-round(sum(n * v[b] for b, n in qv.items()) / (norm(qv) * norm(v)), 9), i) for i, v in vec.items() if v and qv]
        out += [(q, i, n) for n, (s, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(out)


def frame(spark, some, key="doc_id"):
    return spark.createDataFrame(list(some.items()), f"{key} long, text string").repartition(3)


def found(index, asked, k, **options):
    return sorted((r.query_id, r.doc_id, r["rank"]) for r in index.search(asked, k, **options).collect())


ASKED = {0: "the of w1 w3 w3", 1: "the", 2: "w40 w41 w2", 3: "zzz", 4: "only here the", 5: "and to of the the w1 w2 w3 w4 w5 w6", 6: "w5"}


def files(path):
    return {d: sorted(os.listdir(os.path.join(path, "postings", d))) for d in os.listdir(os.path.join(path, "postings")) if d.startswith("part=")}


@pytest.mark.parametrize("frequent, salt_rows", [(1 / 8, 200_000), (0.0, 7), (2.0, 7), (1 / 3, 20)])
def test_search(spark, tmp_path, monkeypatch, buckets, frequent, salt_rows):
    monkeypatch.setattr(V, "FREQUENT", frequent)
    monkeypatch.setattr(V, "SALT_ROWS", salt_rows)
    docs = texts(1, 150)
    index = K.VectorIndex(spark, str(tmp_path / "index"), parts=8)
    index.build(frame(spark, docs))
    asked = frame(spark, ASKED, "query_id")
    assert found(index, asked, 5) == brute(docs, ASKED, buckets, 5)
    among = {i: t for i, t in docs.items() if i % 3 == 0}
    assert found(index, asked, 4, among=frame(spark, among)) == brute(among, ASKED, buckets, 4)


def test_changes_rewrite_the_parts_they_touch(spark, tmp_path, buckets):
    path = str(tmp_path / "index")
    docs = texts(2, 60)
    index = K.VectorIndex(spark, path, parts=16)
    index.build(frame(spark, docs))
    before = files(path)
    assert len(before) == 16
    change = {3: "new w1", 83: "w9", 900: "new new", 4: None}
    touched = index.upsert(frame(spark, change))
    old = {buckets[w] for i in change for w in (docs.get(i) or "").split()} | {buckets[w] for t in change.values() for w in (t or "").split()}
    assert touched == sorted({b * 16 // 4096 for b in old}) and len(touched) < 16
    after = files(path)
    assert {d for d in after if after[d] != before[d]} == {f"part={p}" for p in touched}
    docs.update(change)
    asked = frame(spark, ASKED, "query_id")
    assert found(index, asked, 6) == brute(docs, ASKED, buckets, 6)

    gone = [i for i in docs if i % 2]
    index.delete(frame(spark, {i: None for i in gone}))
    left = {i: t for i, t in docs.items() if not i % 2}
    assert found(index, asked, 6) == brute(left, ASKED, buckets, 6)
    assert index.sizes().agg(F.sum("df")).first()[0] == index.postings().count()

    index.delete(frame(spark, left))
    assert index.postings().count() == 0 and found(index, asked, 6) == [] and len(files(path)) == 16
    index.upsert(frame(spark, {1: "the w5"}))
    assert found(index, asked, 2) == brute({1: "the w5"}, ASKED, buckets, 2)


def test_no_change_writes_nothing(spark, tmp_path):
    index = K.VectorIndex(spark, str(tmp_path / "index"), parts=4)
    index.build(frame(spark, {1: "w1"}))
    before = files(str(tmp_path / "index"))
    assert index.upsert(frame(spark, {7: None})) == [] and index.delete(frame(spark, {9: "w1"})) == []
    assert files(str(tmp_path / "index")) == before


def test_an_empty_index(spark, tmp_path):
    index = K.VectorIndex(spark, str(tmp_path / "index"), parts=4)
    index.build(frame(spark, {1: None, 2: " . "}))
    assert found(index, frame(spark, ASKED, "query_id"), 3) == []


def test_search_stays_in_the_jvm(spark, tmp_path):
    index = K.VectorIndex(spark, str(tmp_path / "index"), parts=4)
    index.build(frame(spark, texts(3, 30)))
    hits = index.search(frame(spark, ASKED, "query_id"), 3)
    plan = hits._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "Cartesian", "NestedLoop"))


def test_pairs_are_added_up_where_the_text_is(spark, tmp_path):
    """Postings are dealt out by text once; products of pairs are not dealt out, nor are postings joined by text."""
    index = K.VectorIndex(spark, str(tmp_path / "index"), parts=4)
    index.build(frame(spark, texts(3, 30)))
    plan = index.search(frame(spark, ASKED, "query_id"), 3)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any(re.search(r"doc_id#\d+L? (=|<=>) ", line) for line in joins)


def test_bound_from_some_texts(spark, tmp_path, monkeypatch, buckets):
    docs = texts(4, 200)
    index = K.VectorIndex(spark, str(tmp_path / "index"), parts=4)
    index.build(frame(spark, docs))
    for pilot in (1, 3, 10_000):
        monkeypatch.setattr(V, "PILOT", pilot)
        assert found(index, frame(spark, ASKED, "query_id"), 5) == brute(docs, ASKED, buckets, 5)


def test_notes_by_a_kept_index(spark, tmp_path):
    notes = spark.createDataFrame(
        [("d1", "src.orders", "Amount rules", "Order amount may be negative for refunds."), ("d2", "src.orders", "Timezone", "All dates are UTC."),
         ("d3", "src.other", "Amount", "order amount negative")], "doc_id string, table_fq_name string, title string, content string")
    asked = spark.createDataFrame([("q", "why would order amount be negative")], "query_id string, text string")
    index = K.VectorIndex(spark, str(tmp_path / "index"), parts=4)
    index.build(K.indexed_text(notes))
    for options in ({}, {"table": "src.orders"}, {"table": "src.orders", "overfetch": True}):
        got, want = ([tuple(r) for r in K.search(notes, asked, 1, index=i, **options).orderBy("rank").collect()] for i in (index, None))
        assert got == want and len(got) == 1


def test_terms_are_counted_in_arrow_batches(spark, buckets):
    """A term costs no interpreted function; ids may repeat or be null, one text may have more terms than are counted at once."""
    rows = [(1, "w1 the w1"), (1, "w2"), (None, "of of of"), (4, None), (5, " . "), (6, "The THE w3")]
    frame_ = spark.createDataFrame(rows, "id long, body string").coalesce(1)
    some = K.vectors(frame_, "id", "body")
    assert "lambdafunction" not in some._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for i, text in rows:
        bag = Counter(buckets[w] for w in re.findall(r"\w\w+", (text or "").lower()))
        if bag:
            want.append((i, sorted(bag), [bag[b] for b in sorted(bag)], math.sqrt(sum(n * n for n in bag.values()))))
    assert [tuple(r) for r in some.collect()] == want


def test_slices_of_a_batch(monkeypatch):
    terms = [["a1", "b1"], [], ["b1"] * 7, ["c1", "a1", "c1"], ["é1"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(terms)], names=["doc_id", "terms"])
    whole = pa.Table.from_batches(vectors._counted(iter([batch]))).to_pylist()
    assert [sum(r["tfs"]) for r in whole] == [len(t) for t in terms] and whole[2]["norm"] == 7.0
    for size in (1, 2, 3, 8):
        monkeypatch.setattr(vectors, "TOKENS_AT_ONCE", size)
        assert pa.Table.from_batches(vectors._counted(iter([batch]))).to_pylist() == whole
        assert pa.Table.from_batches(vectors._counted(iter([batch.slice(2, 3)]))).to_pylist() == whole[2:5]


def test_parts_with_new_postings_are_not_searched_for_old_ones(spark, tmp_path, monkeypatch):
    index = K.VectorIndex(spark, str(tmp_path / "index"), parts=1)
    index.build(frame(spark, {1: "w1 w2", 2: "w2"}))
    scans, postings = [], K.VectorIndex.postings
    monkeypatch.setattr(K.VectorIndex, "postings", lambda self: scans.append(1) or postings(self))
    assert index.upsert(frame(spark, {2: "w3"})) == [0] and len(scans) == 1
    assert sorted(r.doc_id for r in postings(index).collect()) == [1, 1, 2]
