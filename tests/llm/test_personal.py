"""Personal data: base spans against plain patterns, and what the bootstrap adds."""

import hashlib
import random
import re

from sievewright.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PLAIN.items()}


def test_base_spans_match_the_patterns():
    r = random.Random(3)
    parts = ["a", "b", "@", ".", "@x.y", "1", "23", "255", "256", "+1", "(", "-", " ", "4111111111111111", "1.2.3.4", "é", "٣", "+44 20 7946 0958"]
    for _ in range(20000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+" * 100_000, "a@" * 50_000, "1 " * 100_000, "(" * 100_000):
        pii.mentions(run, pii.base_spans(run))


def learnable():
    rows = [(i, f"{w} please call support desk +1 (212) 555-{1000 + i} or write {w}") for i, w in enumerate("abcdefgh")]
    rows += [(20, "é call support desk (0171) 555 2368 today"), (21, "they won 555 2368 17 points"),
             (22, "the order 4485 1234 5678 is fine"), (23, None), (24, ""), (None, "write to x@y.org"), (None, "write to x@y.org"),
             (25, "call support desk +1 212 555 9999")]
    return rows


def test_bootstrap_finds_what_patterns_miss(spark, nothing):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in learnable()], "doc_id long, text string, spans string, row int")
    got = pii.personal_data(docs).collect()
    assert len(got) == len(learnable())
    texts = {i: t for i, t in learnable() if i is not None}
    for r in got:
        spans = plain(texts.get(r.doc_id, "write to x@y.org"))
        base = pii.written([(a, b, k) for k, s in spans.items() for a, b in s])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(spans[k]) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        if r.doc_id == 20:
            start = texts[20].index("(0171)")
            assert r.n_added == 1 and r.spans == f"phone:{start}:{start + len('(0171) 555 2368')}"
        else:
            assert r.n_added == 0 and r.spans == base
    assert pii.personal_data(nothing).count() == 0


def test_weak_patterns_add_nothing(spark):
    """A context that mostly stands before other things is not trusted."""
    rows = [(i, f"the +1 (212) 555-{1000 + i}") for i in range(3)] + [(10 + i, f"the 0171 555 {2000 + i}") for i in range(9)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_added for r in got) == 0


def test_scores_spread_over_the_graph(spark):
    """Unseen values that a good pattern holds lend weight to the other patterns that hold them."""
    rows = [("phone", "call", f"s{i}", True, 1) for i in range(8)] + [("phone", "call", "u1", False, 1)]
    rows += [("phone", "ring", f"s{i}", True, 1) for i in range(8)] + [("phone", "ring", "u1", False, 2), ("phone", "ring", "u1b", False, 2)]
    rows += [("phone", "won", f"s{i}", True, 1) for i in range(3)] + [("phone", "won", f"n{i}", False, 1) for i in range(9)]
    edges = spark.createDataFrame(rows, "kind string, context string, value string, seed boolean, docs long")
    once = {r.context: r.score for r in pii.pattern_scores(edges, rounds=1, confident=0.7).collect()}
    more = {r.context: r.score for r in pii.pattern_scores(edges, rounds=3, confident=0.7).collect()}
    assert set(once) == set(more) == {"call", "ring"}
    assert more["call"] > once["call"] and more["ring"] > once["ring"]


def planted(seeds=160, n=30, few=4):
    """Addresses written out after words that stand before real ones, and after words that stand before those only."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(6))
    rows, loose = [], []
    for i in range(seeds):
        rows.append(f"{word()} contact mail {word()}{i}@{word()}.com {word()}")
    first = [f"{word()}{i} [at] {word()}.org" for i in range(n)]
    second = [f"{word()}{i} (at) {word()} (dot) net" for i in range(few)]
    for x in first:
        rows += [f"{word()} contact mail {x} {word()}", f"{word()} you reach me via {x} {word()}"]
        loose += [(len(rows) - 2, x), (len(rows) - 1, x)]
    for x in second:
        rows.append(f"{word()} you reach me via {x} {word()}")
        loose.append((len(rows) - 1, x))
    rows += [f"{word()} {word()} we met {word()} [at] {word()} yesterday" for _ in range(n)]
    rows += [f"{word()} about {r.randint(10, 99)} {r.randint(100, 999)} {r.randint(1000, 9999)} points" for _ in range(n)]
    return rows, loose


def test_what_is_discovered_induces_patterns(spark):
    rows, loose = planted()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    found = {(i, rows[i][int(a):int(b)]) for i, r in got.items() for k, a, b in (s.split(":") for s in r.spans.split(",") if s)
             if (int(a), int(b)) not in [s for x in plain(rows[i]).values() for s in x]}
    right = len(found & set(loose))
    assert right == len(found) and right == len(loose)  # precision and recall of what the patterns add
    assert sum(r.n_added for r in got.values()) == len(loose)
    for i, r in got.items():
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(plain(rows[i])[k]) for k in pii.KINDS]


def test_a_second_round_finds_what_the_first_cannot(spark):
    rows = [("email", "mail _", f"s{i}", True, 1) for i in range(12)] + [("email", "mail _", f"u{i}", False, 1) for i in range(2)]
    rows += [("email", "mail _", "u2", False, 1)] + [("email", "via _", f"u{i}", False, 1) for i in range(3)]
    rows += [("phone", "via _", f"u{i}", False, 1) for i in range(3)]
    edges = spark.createDataFrame(rows, "kind string, context string, value string, seed boolean, docs long")
    names = lambda n: {(r.kind, r.context) for r in pii.pattern_scores(edges, rounds=n, confident=0.5).collect()}
    assert names(1) == {("email", "mail _")} and names(2) == names(6) == {("email", "mail _"), ("email", "via _")}


def test_contexts():
    text = "Phone No: 0171 555 2368, then call  desk 12 now"
    a = text.index("0171")
    assert pii.contexts(text, a, a + 13) == ["no: _", "phone no: _", "phone no: |"]
    a = text.index("12")
    assert pii.contexts(text, a, a + 2) == ["desk _", "call desk _", "_ now"]
    assert pii.contexts("x", 0, 1) == [] and pii.contexts("\n fax:\t7", 7, 8) == ["fax: _", "fax: |"]
