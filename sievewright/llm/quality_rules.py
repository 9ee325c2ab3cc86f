"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
WHITE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
# Function words of the languages in the corpus (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "be", "this",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht", "ein",
    "le", "la", "les", "et", "en", "un", "une", "du", "que", "dans", "par", "pour", "sur", "est", "au", "de",
    "el", "los", "y", "se", "las", "por", "con", "no", "su", "para", "al", "lo", "una", "del", "como", "más")


@dataclass(frozen=True)
class Threshold:
    """A document fails if `part` > `most` percent of `whole`, or `part` < `least`, once it has `words` words."""
    name: str
    part: str
    whole: str | None = None
    most: float | None = None
    least: float | None = None
    words: int = 0


# The base rules come first; the others reject what is mostly markup, listing or noise and leave prose alone.
BASE = (Threshold("few_words", "n_words", least=10),
        Threshold("repeated_words", "n_repeat_words", "n_words", most=20))
RULES = (Threshold("symbols", "n_symbols", "n_words", most=25),
         Threshold("long_words", "word_chars", "n_words", most=2000),
         Threshold("short_words", "n_words", "word_chars", most=60, words=50),
         Threshold("repeated_lines", "n_dup_lines", "n_lines", most=50),
         Threshold("stop_words", "n_stop_words", least=2, words=80))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in five-word windows that occur twice or more; windows are compared as 64-bit hashes."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - v, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        hits = F.filter(ordered, lambda x, k: same(x, k + 1) | (F.when(k > 0, same(x, k - 1)).otherwise(False)))
        return bind(F.sort_array(F.transform(hits, lambda x: x["i"])), covered)

    def count(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(found) > F.size(F.array_distinct(found)), bind(ordered, repeated)).otherwise(0)

    return F.when(F.size(words) < WINDOW + 1, 0).otherwise(bind(windows, count))


def statistics(docs: DataFrame, text: str = "text") -> dict[str, Column]:
    """The numbers that rules compare, as expressions over a text column."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, WHITE), "")
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    per_word = bind(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
        F.size(F.array_intersect(w, F.array(*[F.lit(s) for s in STOP_WORDS]))).cast("long").alias("n_stop_words")))
    per_line = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                              (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).cast("long")
    return {"w": per_word, "l": per_line, "n_symbols": symbols}


def compiled(rule: Threshold, value: Callable[[str], Column]) -> Column:
    """True where a document fails the rule."""
    part = value(rule.part)
    bad = part < F.lit(rule.least) if rule.least is not None else (
        F.lit(100) * part > F.lit(rule.most) * value(rule.whole))
    return bad & (value("n_words") >= F.lit(rule.words)) if rule.words else bad


def assess(docs: DataFrame, base=BASE, rules=RULES) -> DataFrame:
    """`docs` as a struct column `row`, its statistics, and what the rules say; nothing is shuffled.

    Columns: row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed,
    kept, failed (names of the rules that a row fails). Null text counts as empty and fails `few_words`. Rows are
    judged on their own, so ties and repeated rows have no effect, and other columns stay inside `row` whatever
    their names. An empty table gives no rows.
    """
    stats = statistics(docs)
    rows = docs.select(F.struct("*").alias("row"), *[v.alias(k) for k, v in stats.items()])
    flat = rows.select("row", "w.*", "l.*", "n_symbols")
    failed = {r.name: compiled(r, F.col) for r in (*base, *rules)}
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | failed[r.name]
    names = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in failed.items()]), lambda x: x.isNotNull())
    return flat.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
                       "n_stop_words", base_failed.alias("base_failed"), names.alias("failed")) \
        .withColumn("kept", F.size("failed") == 0)


def kept_documents(docs: DataFrame, base=BASE, rules=RULES) -> DataFrame:
    """The rows of `docs` that pass every rule, with their columns as they are.

    The verdict is one expression that computes the statistics once; a filter over separate columns would be pushed
    below them and compute them anew for every rule.
    """
    stats = statistics(docs)

    def passes(s: Column) -> Column:
        places = {"n_symbols": s["n_symbols"]}
        value = lambda name: places[name] if name in places else (
            s["l" if name in ("n_lines", "n_dup_lines") else "w"][name])
        good = F.lit(True)
        for rule in (*base, *rules):
            good = good & ~compiled(rule, value)
        return good

    return docs.where(bind(F.struct(*[v.alias(k) for k, v in stats.items()]), passes))
