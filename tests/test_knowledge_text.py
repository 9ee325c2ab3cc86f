import math
import random

import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as X
from sievewright.operators import knowledge as K, suggest as P
from sievewright.operators.profile import profile_table


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, title, body, float(n)) for n, (i, t, title, body) in enumerate(rows)],
                                 "doc_id string, table_fq_name string, title string, content string, created_at double")


def test_search_finds_the_note(spark):
    notes = docs(spark, ("d1", "src.orders", "Amount rules", "Order amount may be negative for refunds."),
                 ("d2", "src.orders", "Timezone", "All dates are UTC."), ("d3", "src.other", "Amount", "order amount negative"))
    asked = spark.createDataFrame([("q", "why would order amount be negative")], "query_id string, text string")
    assert K.search(notes, asked, 1, table="src.orders").first().title == "Amount rules"
    assert K.search(notes, asked, 1, table="src.orders", overfetch=True).first().title == "Amount rules"
    assert K.search(notes, asked, 5).count() == 2
    assert K.search(notes, spark.createDataFrame([("q", "zzz")], "query_id string, text string")).count() == 0


def test_upsert_and_delete(spark):
    log = docs(spark, ("d1", "t", "a", "x"), ("d1", "t", "b", "y"), ("d2", "t", "c", "z"), ("d2", None, None, None)).withColumns(
        {"seq": F.col("created_at").cast("long"), "deleted": F.col("title").isNull()})
    assert [(r.doc_id, r.title) for r in K.current_docs(log).collect()] == [("d1", "b")]


def test_scores_agree_with_brute_force(spark):
    random.seed(1)
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(random.choices(words, k=random.randint(1, 40))) for i in range(700)}
    # Copies tie and are told apart by their number.
    texts.update({700 + i: texts[3] for i in range(300)})
    asked = {q: " ".join(random.choices(words, k=8)) for q in range(5)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    got = K.similar_texts(K.vectors(frame), K.vectors(queries, "query_id"), 7)
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", X.term_bucket(F.col("w")).alias("b")).collect()}

    def vector(text):
        out = {}
        for w in text.split():
            out[bucket[w]] = out.get(bucket[w], 0) + 1
        norm = math.sqrt(sum(v * v for v in out.values()))
        return {b: v / norm for b, v in out.items()}
    vecs = {i: vector(t) for i, t in texts.items()}
    for q, text in asked.items():
        qv = vector(text)
        scored = [(-round(sum(w * vecs[i].get(b, 0) for b, w in qv.items()), 9), i) for i in texts]
        want = [i for s, i in sorted(scored) if s < 0][:7]
        assert [r.doc_id for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "QUERY_BLOCK", 3)
    frame = spark.createDataFrame([(i, f"common word{i}") for i in range(10)], "doc_id long, text string")
    asked = frame.selectExpr("doc_id as query_id", "text")
    got = K.similar_texts(K.vectors(frame), K.vectors(asked, "query_id"), 1)
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == [(i, i) for i in range(10)]


def test_rca(spark):
    raw = "The load ran late.\nIt was a holiday.\nConfidence: 0.82\nAction: rerun the load"
    rows = [("a", raw), ("b", "confidence 85"), ("c", "no idea"), ("d", "Confidence: 4000")]
    got = {r.id: r for r in P.parse_rca(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert (got["a"].confidence, got["a"].suggested_action) == (0.82, "rerun the load")
    assert got["a"].explanation == "The load ran late.\nIt was a holiday."
    assert got["b"].confidence == 0.85 and got["b"].explanation == "confidence 85"
    assert (got["c"].confidence, got["c"].suggested_action) == (0.5, "") and got["d"].confidence == 1.0


def test_ticket_text(spark):
    rows = [("a", "Title: Late\nDescription: Two\nlines"), ("b", "just text ")]
    got = {r.id: (r.title, r.description) for r in P.draft_ticket_text(
        spark.createDataFrame(rows, "id string, text string"),
        spark.createDataFrame([("a", "x"), ("b", "src.t")], "id string, tables string")).collect()}
    assert got == {"a": ("Late", "Two\nlines"), "b": ("Data quality failures on src.t", "just text")}


@pytest.fixture()
def profile(spark):
    return profile_table(spark.createDataFrame([(1, 10.0), (2, 20.0)], "id long, amount double"), "src.t")


def answers(spark, text):
    return spark.createDataFrame([("src.t", text)], "table_fq_name string, text string")


def test_refinement(spark, profile):
    text = ('Sure:\n[{"column": "amount", "rule_type": "range", "threshold": 0.1, "severity": "critical", "rationale": "why"},'
            ' 5, {"rule_type": "bogus", "threshold": 1}, {"rule_type": "range", "threshold": null},'
            ' {"column": "id", "rule_type": "uniqueness", "threshold": "0.9", "severity": null}] ok')
    got = P.propose_rules(profile, answers(spark, text)).collect()
    assert [(r["column"], r.threshold, r.severity, r.rationale) for r in got] == [("amount", 0.1, "critical", "why")]
    # Parameters the answer leaves out come from the candidate.
    assert '"min"' in got[0].params


@pytest.mark.parametrize("text", ["[]", "no json", "[{broken]", '[{"rule_type": "bogus"}]'])
def test_useless_answers_keep_the_baseline(spark, profile, text):
    assert P.propose_rules(profile, answers(spark, text)).count() == P.baseline_rules(profile).count()


def test_offline_answers(spark, profile):
    prompts = P.suggestion_prompts(profile, docs(spark, ("d", "src.t", "N", "note")), P.baseline_rules(profile))
    row = prompts.first()
    assert "- N: note" in row.prompt and "- id (bigint): null_rate=0.00%, distinct_rate=100.00%, pattern=integer_id, candidate_key=True" in row.prompt
    assert P.canned_responses(prompts).first().text == "[]"
    asked = spark.createDataFrame([("1", "k", P.TICKET_SYSTEM, "Likely ROOT cause: x"), ("2", "k", None, "hello"),
                                   ("3", "k", P.TICKET_SYSTEM, "x")], "id string, kind string, system string, prompt string")
    got = {r.id: r.text for r in P.canned_responses(asked, [("HELLO", "hi")]).collect()}
    assert got["1"].startswith("Unable to determine") and got["2"] == "hi" and got["3"].startswith("Data quality check failed")


def test_proposal_ids_are_stable(spark, profile):
    ids = [sorted(r.rule_id for r in P.as_rules(P.baseline_rules(profile)).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == len(ids[0])
