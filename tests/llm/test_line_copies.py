"""Boilerplate lines among copies of documents and on short pages, as the pipeline removes them."""

import random

import pytest

import corpus_pipeline

BAR = "Sign up for our weekly letter and never miss a story"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def cleaned(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)
    got = corpus_pipeline.drop_boilerplate(spark, docs, "/nowhere").collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    return {r.doc_id: r.text for r in got}


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def edited_copies(n, share):
    """A document of 20 lines and n copies on ten sites: in each, a word of many lines is changed."""
    r = random.Random(7)
    lines = [words(r, 14) for _ in range(20)]
    out = [(0, "\n".join(lines), "s0")]
    for i in range(1, n + 1):
        new = [x.rsplit(" ", 1)[0] + f" new{i}" if r.random() < share else x for x in lines]
        out.append((i, "\n".join(new), f"s{i % 10}"))
    return out


def test_edited_copies_keep_their_lines(spark):
    """Unchanged lines make less than half of most copies, which lost them when each copy counted as a site."""
    for n, share in ((40, 0.6), (400, 0.6)):
        rows = edited_copies(n, share)
        assert cleaned(spark, rows) == {i: t for i, t, _ in rows}


def test_boilerplate_goes_from_copies_and_pages(spark):
    """A line on many pages goes from a group of copies as well, whose own lines stay."""
    r = random.Random(8)
    copies = [(i, f"{t}\n{BAR}", s) for i, t, s in edited_copies(40, 0.6)]
    pages = [(100 + i, f"{words(r, 30)}\n{BAR}\n{words(r, 30)}", f"s{i}") for i in range(7)]
    got = cleaned(spark, copies + pages)
    assert all(got[i] == "\n".join(x for x in t.split("\n") if x != BAR) for i, t, _ in copies + pages)


def test_short_pages_lose_boilerplate(spark):
    """Also where it is more than half of the page, and where it is all of it."""
    r = random.Random(9)
    rows = [(i, f"{words(r, 3)}\n  {BAR}", f"s{i}") for i in range(8)] + [(20, BAR, "s0"), (21, f"{BAR}\n\n{BAR}\n", "s1")]
    got = cleaned(spark, rows)
    assert all(got[i] == t.split("\n")[0] for i, t, _ in rows[:8]) and got[20] == "" and got[21] == "\n"


def test_blocks_of_boilerplate_go(spark):
    """Lines that always stand together, in pages that are otherwise not alike."""
    r = random.Random(10)
    block = [BAR, words(r, 9), words(r, 12)]
    rows = [(i, "\n".join([words(r, 40), words(r, 60), *block, words(r, 50)]), f"s{i % 9}") for i in range(30)]
    got = cleaned(spark, rows)
    assert all(got[i] == "\n".join(x for x in t.split("\n") if x not in block) for i, t, _ in rows)


def test_one_line_copies_stay(spark):
    """Exact copies of a line that stands nowhere else: one document, left to the operators for copies."""
    rows = [(i, BAR, f"s{i}") for i in range(9)]
    assert cleaned(spark, rows) == {i: BAR for i in range(9)}


def template_pages(own):
    """40 pages on 40 sites: a header, a navigation line, text of their own, a footer."""
    r = random.Random(own)
    lines = [words(r, 8), words(r, 6), words(r, 14)]
    return lines, [(i, "\n".join([*lines[:2], words(r, own), lines[2]]), f"s{i}") for i in range(40)]


@pytest.mark.parametrize("own", [10, 30, 60, 120])
def test_templates_lose_all_their_lines(spark, own):
    lines, rows = template_pages(own)
    got = cleaned(spark, rows)
    assert all(got[i] == t.split("\n")[2] for i, t, _ in rows)


def test_a_template_goes_and_the_lines_of_copies_within_it_stay(spark):
    lines, rows = template_pages(40)
    copies = [(100 + i, "\n".join([*lines[:2], t, lines[2]]), s) for i, t, s in edited_copies(60, 0.6)]
    got = cleaned(spark, rows + copies)
    assert all(got[i] == "\n".join(x for x in t.split("\n") if x not in lines) for i, t, _ in rows + copies)


def test_pages_of_nothing_but_wide_lines(spark):
    """Equal sets of lines are copies; different sets are not, and what they share goes."""
    r = random.Random(11)
    lines = [words(r, 9) for _ in range(6)]
    sets = [(i, "\n".join(lines[:i] + lines[i + 1:]), f"s{i}") for i in range(6)] + [(9, "\n".join(lines), "s9")]
    got = cleaned(spark, [(*x[:2], f"{x[2]}{k}") for k in range(7) for x in [(10 * k + i, t, s) for i, t, s in sets]])
    assert set(got.values()) == {""}
