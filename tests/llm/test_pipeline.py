"""The pipeline's stages against plain versions, each on what the stage before it kept."""

from collections import Counter

import pytest
from test_duplicates import brute_components
from test_lines_mix import check_mix, plain_lines
from test_quality import plain_rules
from test_tokens import BPE, check_pieces

import corpus_pipeline
from sievewright.llm import line_dedup, mixing
from sievewright.llm.common import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "packing"]


def run_stages(spark, docs):
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(settle(stage(spark, tables[-1], "/nowhere"), name))
    return tables


def check_unique(given, kept):
    """One row of each component of rows, one of least id; rows without words stay."""
    component = brute_components([(i, r[1]) for i, r in enumerate(given)])
    groups = {}
    for i, r in enumerate(given):
        groups.setdefault(component[i], []).append(r)
    least = lambda g: min((r[0] is None, r[0] or 0) for r in g)
    left = Counter(kept)
    for g in groups.values():
        some = [r for r in g if (r[0] is None, r[0] or 0) == least(g) and left[r]]
        assert some, g
        left[some[0]] -= 1
    assert not +left


def check_stages(tables):
    given, ruled, lined, unique, mixed, packed = tables
    rows = lambda t: [tuple(r) for r in t.select(*COLUMNS).collect()]
    assert Counter(rows(ruled)) == Counter(r for r in rows(given) if plain_rules(r[1])[-1])
    want = plain_lines([(r[0], r[1], r[3]) for r in rows(ruled)], line_dedup.MIN_SITES)
    assert Counter((r[0], r[1]) for r in rows(lined)) == Counter((w[0], w[3]) for w in want)
    assert all(r[4] == len(r[1]) for r in rows(lined) if r[1] is not None and r[4] is not None)
    check_unique(rows(lined), rows(unique))
    plan = mixing.mix_plan(unique)
    check_mix(*(t.collect() for t in plan))
    assert set(rows(mixed)) <= set(rows(unique)) and max(Counter(rows(mixed)).values(), default=0) <= 3 * max(
        Counter(rows(unique)).values(), default=0)
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(BPE)
    texts = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows(mixed)]
    check_pieces(packed.collect(), texts, 4096)


def test_small_tables(spark):
    check_stages(run_stages(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))


def test_odd_rows(spark, odd):
    check_stages(run_stages(spark, odd.select(*COLUMNS)))
    assert all(t.columns == odd.columns for t in run_stages(spark, odd)[:-1])


def test_no_rows(spark, nothing):
    assert [t.count() for t in run_stages(spark, nothing)] == [0] * 6


def test_run_is_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    whole = corpus_pipeline.run(spark, sf)
    assert Counter(map(tuple, whole.select("doc_id", "start", "ids_crc32").collect())) == Counter(
        map(tuple, run_stages(spark, spark.read.parquet(f"{sf}/documents.parquet"))[-1].select("doc_id", "start", "ids_crc32").collect()))


def test_repeated_rows_and_rows_without_an_id(spark):
    text = "one text of more than five words that stands in several rows"
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text), (None, "another text without an id of its own"),
            (5, "a short one"), (5, "quite another text under the same id as that"), (None, None), (None, None), (7, " ")]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "/nowhere").collect()]
    assert Counter(got) == Counter([(1, text)] + rows[5:])
