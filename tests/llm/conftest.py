import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, row string"


def prose(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "and", "to"] + ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(60)]
    return " ".join(r.choice(words) for _ in range(n))


def rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and names that results use too."""
    base = prose(1, 300)
    near = base.replace(" the ", " THE ").split(" ")
    near[150] = "changed"
    texts = [None, "", " \n\t ", "one", "One", "two words", base, " ".join(near), base.upper(), prose(2, 40),
             prose(2, 40), "shared line here\n" + prose(3, 30), "shared line here\n" + prose(4, 30),
             "shared line here \n" + prose(5, 30) + "\n\nend of it", prose(6, 9000), "é" * 30 + " ñ 日本語 😀 x",
             "mail a.b@example.com now", "x" * 5000, "tab\x0bsep\x0cform\rback", "a b c d e f g"]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, "en" if i % 3 else None, f"s{i % 8}" if i % 7 else None, len(t) if t is not None else None,
                    "x", None, "r"))
    out += [out[6], out[6], (None, "no id at all here", "en", "s1", 17, None, None, None),
            (None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
