"""Boilerplate lines, mixing and page languages."""

import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from pyspark.sql import functions as F

from sievewright.llm import language, line_dedup, mixing

WHITE = " \t\x0b\x0c\r"


def hashed(values):
    """Spark's xxhash64 of several texts and whole numbers."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return struct.unpack("<q", struct.pack("<Q", seed))[0]


def plain_keys(lines, wide):
    """What two copies share some of: pairs of near hashes of the runs of three words outside wide lines."""
    runs = set()
    for x in lines:
        if x not in wide:
            ws = re.split("[\x20\x09-\x0D]+", x)
            runs |= {hashed(ws[i:i + 3]) for i in range(max(len(ws) - 2, 1))}
    runs = sorted(runs)[:16]
    if len(runs) < 2:
        return {hashed(runs or sorted({hashed([x]) for x in lines}))}
    return {hashed([runs[i], runs[i + gap]]) for gap in (1, 2) for i in range(len(runs) - gap)}


def plain_lines(rows, min_sites):
    """[(doc_id, n_lines, n_removed, text)] by counting the sites of every line over documents that are no copies."""
    split = [[x.strip(WHITE) for x in (t or "").split("\n")] for _, t, _ in rows]
    sites = defaultdict(set)
    for lines, (_, _, source) in zip(split, rows):
        for x in filter(None, lines):
            sites[x].add(source)
    wide = {x for x, found in sites.items() if len(found) >= min_sites}
    pages, first = {}, {}
    for lines, (doc_id, text, source) in zip(split, rows):
        if wide & set(lines):
            page = (hashed([doc_id, text, source]), "\x00none" if source is None else source)
            pages[page] = (set(filter(None, lines)), plain_keys([x for x in lines if x], wide))
    for page, (_, keys) in pages.items():
        for k in keys:
            first[k] = min(first.get(k, page), page)
    joined = {page[0]: min(first[k] for k in keys) for page, (_, keys) in pages.items()}
    spread = defaultdict(set)
    for page, (lines, _) in pages.items():
        for x in lines & wide:
            spread[x].add(joined[joined[page[0]][0]][1])
    bad = {x for x, found in spread.items() if len(found) >= min_sites}
    out = []
    for lines, (doc_id, text, _) in zip(split, rows):
        hits = sum(x in bad for x in lines)
        kept = [raw for raw, x in zip((text or "").split("\n"), lines) if x not in bad]
        out.append((doc_id, sum(map(bool, lines)), hits, "\n".join(kept) if hits else text))
    return out


def some_lines():
    rows = []
    for i in range(60):
        lines = [f"own line {i} of some length", f"own other {i} of some length"]
        for k, n in enumerate((1, 3, 4, 5, 6, 8, 20)):
            if i % 20 < n:
                lines.insert(k % 3, f" line on {n} sites" if i % 2 else f"line on {n} sites\t")
        rows.append((i, "\n".join(lines) + ("\n" if i % 3 else "\n\n"), f"s{i % 20}" if i % 20 else None))
    rows += [(100 + i, "all of this\nis everywhere", f"s{i}") for i in range(9)]
    return rows


@pytest.mark.parametrize("min_sites", [2, 5, 6])
def test_lines(spark, odd, odd_rows, min_sites):
    rows = [(r[0], r[1], r[3]) for r in odd_rows] + some_lines()
    table = odd.select("doc_id", "text", "source").unionByName(spark.createDataFrame(some_lines(), "doc_id long, text string, source string"))
    got = line_dedup.clean_lines(table, min_sites).select("row.doc_id", "n_lines", "n_removed", "row.text").collect()
    assert Counter(map(tuple, got)) == Counter(plain_lines(rows, min_sites))
    assert sum(r.n_removed for r in got) > 0


def test_lines_of_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = line_dedup.clean_lines(docs.repartition(5)).select("row.doc_id", "n_lines", "n_removed", "row.text").collect()
    assert Counter(map(tuple, got)) == Counter(plain_lines(rows, line_dedup.MIN_SITES)) and sum(r.n_removed for r in got) > 0


def test_only_rows_with_such_a_line_are_shuffled(spark):
    plain = [(200 + i, f"nothing shared {i}", f"s{i}") for i in range(30)]
    docs = spark.createDataFrame(some_lines() + plain, "doc_id long, text string, source string")
    lines = line_dedup.boilerplate_lines(docs, 6)
    bitmap, bits = line_dedup.line_filter(lines)
    found = docs.select("text", bitmap.scalar().alias("b")).where(
        F.exists(line_dedup.text_lines(), lambda x: line_dedup.possible(x, F.col("b"), bits)))
    assert 0 < lines.count() < 10 and found.count() == docs.count() - 30


def test_lines_keep_columns_and_use_no_python(odd, nothing):
    cleaned = line_dedup.clean_lines(odd)
    assert cleaned.select("row.*").columns == odd.columns
    assert "Python" not in cleaned._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert line_dedup.clean_lines(nothing).count() == 0


def plain_targets(sizes, epochs):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = epochs * sizes[s]
            free.discard(s)
    return target


def check_mix(rows, plan, epochs=3.0):
    """rows: doc_id, source, size, spot; plan: source, source_size, target, whole, spot_last."""
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = plain_targets(dict(sizes), epochs)
    by = {p.source: p for p in plan}
    assert set(by) == set(sizes)
    taken, largest = Counter(), defaultdict(int)
    for r in rows:
        p = by[r.source]
        times = p.whole + (r.spot <= p.spot_last)
        assert times <= epochs or not r.size
        taken[r.source] += times * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s, p in by.items():
        assert p.source_size == sizes[s] and abs(p.target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - p.target) <= largest[s], (s, taken[s], p.target)


def test_mix(spark, odd, odd_rows, nothing):
    rows, plan = mixing.mix_plan(odd)
    assert sorted(r.size for r in rows.collect()) == sorted(len((r[1] or "").split()) for r in odd_rows if "\x1c" not in (r[1] or ""))
    check_mix(rows.collect(), plan.collect())
    rows, plan = mixing.mix_plan(nothing)
    assert rows.count() == 0 and plan.count() == 0


def test_mix_of_many_sizes(spark):
    table = [(i, " ".join(["w"] * (i % 97 + 1)), f"src{i % 7 if i % 3 else 0}") for i in range(3000)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    rows, plan = mixing.mix_plan(docs)
    check_mix(rows.collect(), plan.collect())
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(docs).select("doc_id").collect())
    by = {p.source: p for p in plan.collect()}
    assert mixed == Counter({r.doc_id: n for r in rows.collect()
                             if (n := by[r.source].whole + (r.spot <= by[r.source].spot_last))})


def test_mixed_documents_keep_columns(odd, nothing):
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and set(mixed.collect()) <= set(odd.collect())
    assert "Python" not in mixed._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert mixing.mixed_documents(nothing).count() == 0


def test_clamps_cascade(spark):
    sources = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 10000, 1.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(sources, 10110.0).collect()}
    assert got == {"a": 30.0, "b": 300.0, "c": 9780.0}


SPEECH = {"en": "the cat sat on the mat and the dog was with them in this house ", "de": "die katze und der hund sind nicht auf dem haus ",
          "fr": "le chat est dans la maison et les chiens sont sur une table "}


def test_languages(spark, nothing):
    labelled = spark.createDataFrame([(i, t * 6, lang) for i, (lang, t) in enumerate(list(SPEECH.items()) * 4)], "doc_id long, text string, lang string")
    page = lambda lang, body, said=None: f"<html{f' lang={said}' if said else ''}><style>p{{}}</style><p>{body}</p></html>"
    rows = [(i, f"http://www.site.{lang}/p", page(lang, t * 3, lang), "x") for i, (lang, t) in enumerate(list(SPEECH.items()) * 10)]
    rows += [(100, "http://www.site.de/q", page("de", "zz qq xx"), "x"), (101, None, page("", "zz qq xx", "fr"), "x"), (102, None, None, "x"),
             (103, "not an address", "", "x"), (104, "http://other.site.de/r", "<html lang='de-AT'>", None), (None, None, SPEECH["fr"], "x"),
             (105, "http://www.site.de/q", page("", SPEECH["en"] * 20, "de"), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lang string")
    got = {r.page_id: r for r in language.page_languages(pages, labelled).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang == lang and got[i].confidence > 0.9 for i, lang in enumerate(list(SPEECH) * 10))
    assert got[100].lang == "de" and got[101].lang == "fr" and got[104].lang == "de" and got[None].lang == "fr"
    assert got[105].lang == "en" and got[105].declared == "de"
    assert got[102].lang in SPEECH and got[102].text_lang is None and abs(got[102].confidence - 1 / 3) < 0.2
    assert language.page_languages(pages.limit(0), labelled).count() == 0
    assert {r.lang for r in language.page_languages(pages, labelled.limit(0)).collect()} == {None}


def test_language_from_text_alone(spark):
    """Accuracy against the declared language of real pages when only the text is used."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.page_languages(spark.read.parquet(f"{sf}/pages.parquet"), docs).collect()
    assert sum(r.text_lang == r.declared for r in got) > 0.97 * len(got)
    assert sum(r.lang == r.declared for r in got) > 0.99 * len(got)
