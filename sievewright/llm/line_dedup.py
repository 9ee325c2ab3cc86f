"""Cross-site boilerplate lines: distinct-site spread by HyperLogLog, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard_since, scratch_mark, settle

# A line on so many sites is boilerplate.
MIN_SITES = 6
# Base-2 logarithm of the registers of a sketch, and the relative error that decides what is counted exactly.
SKETCH_BITS = 8
ERROR = 0.2
# Copies of a document are found by the so many least hashes of their runs of so many words.
RUN_WORDS = 3
RUNS = 16
# Base-2 logarithms of the bits of the filter of lines: 32 KiB to 16 MiB.
LEAST_BITS, MOST_BITS = 18, 27

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """96 bits of hash of a line without the white space around it."""
    bare = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
    return F.struct(F.xxhash64(bare).alias("h1"), F.hash(bare).alias("h2"))


def has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def text_lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def line_sites(docs: DataFrame) -> DataFrame:
    """(h1, h2, site) for each distinct line with a word of each row of docs (text, source)."""
    keys = F.array_distinct(F.transform(F.filter(text_lines(), has_word), line_key))
    site = F.coalesce(F.col("source").cast("string"), F.lit("\x00none"))
    return docs.select(F.explode(keys).alias("k"), site.alias("site")).select("k.*", "site")


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of the lines that stand on at least `min_sites` sites.

    One sketch a line is filled in each task and merged by the aggregate, so a line that every document has is one
    small row a task. Lines whose estimate is near the threshold get their sites counted exactly.
    """
    sites = line_sites(docs)
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)))
    low, high = min(min_sites - 2, min_sites * (1 - ERROR)), max(min_sites + 2, min_sites * (1 + ERROR))
    spread = settle(sites.groupBy(*KEY).agg(estimate.alias("sites")).where(F.col("sites") >= low), "spread")
    near = spread.where(F.col("sites") <= high).select(*KEY)
    exact = (sites.join(near, KEY, "left_semi").distinct().groupBy(*KEY).agg(F.count("*").alias("sites"))
             .where(F.col("sites") >= min_sites).select(*KEY))
    return settle(spread.where(F.col("sites") > high).select(*KEY).unionByName(exact), "boilerplate")


def line_filter(lines: DataFrame) -> tuple[DataFrame, int]:
    """A bitmap of the lines (h1, h2) as one value, and its bits: 64 for each line, within fixed bounds."""
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (64 * lines.count()).bit_length()))
    slot = F.pmod("h1", F.lit(bits))
    words = (lines.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("set")))
    places = lines.sparkSession.range(bits >> 6)
    whole = places.join(words, F.col("id") == F.col("word"), "left").select("id", F.coalesce("set", F.lit(0)).alias("set"))
    return whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "set"))), lambda x: x["set"])), bits


def possible(line: Column, bitmap: Column, bits: int) -> Column:
    """The line may be one of the bitmap's; no line that is one is missed."""
    slot = F.pmod(line_key(line)["h1"], F.lit(bits))
    word = F.get(bitmap, F.shiftright(slot, 6).cast("int"))
    shifted = F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63)).cast("int"))
    return has_word(line) & (shifted.bitwiseAND(F.lit(1)) == 1)


def least_runs(lines: Column) -> Column:
    """The RUNS least hashes of the runs of words of some lines."""
    def runs(words: Column) -> Column:
        return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (RUN_WORDS - 1), F.lit(1))),
                           lambda x, i: F.xxhash64(x, *[F.get(words, i + n) for n in range(1, RUN_WORDS)]))

    words = F.transform(lines, lambda x: F.split(F.btrim(x, F.lit(" \t\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+"))
    return F.slice(F.sort_array(F.array_distinct(F.flatten(F.transform(words, runs)))), 1, RUNS)


def copy_keys(runs: Column, lines: Column) -> Column:
    """Keys that copies share some of: pairs of near hashes of their runs; without runs the set of all their lines."""
    pairs = lambda gap: F.transform(
        F.slice(runs, 1, F.greatest(F.size(runs) - gap, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(runs, i + gap)))
    whole = F.xxhash64(F.sort_array(F.array_distinct(F.transform(F.filter(lines, has_word), lambda x: line_key(x)["h1"]))))
    return (F.when(F.size(runs) == 0, F.array(whole)).when(F.size(runs) == 1, F.array(F.xxhash64(runs)))
            .otherwise(F.array_distinct(F.concat(pairs(1), pairs(2)))))


def independent_sites(keyed: DataFrame) -> DataFrame:
    """(id, site): the site that each page of `keyed` (id, site, key) counts for.

    A page joins the page of least id that it shares a key with, and that one's in turn; so copies count for one site.
    """
    first = keyed.groupBy("key").agg(F.min(F.struct("id", "site")).alias("first"))
    # One plan at every size: both sides of these joins grow with the table.
    joined = settle(keyed.join(first.hint("merge"), "key").groupBy("id").agg(F.min("first").alias("first")), "first")
    heads = joined.select(F.col("id").alias("head"), F.col("first.site").alias("site"))
    return joined.select("id", F.col("first.id").alias("head")).join(heads.hint("merge"), "head").select("id", "site")


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """`docs` (doc_id, text, source) without boilerplate lines, as a struct column `row`, and what was removed.

    Columns: row (all columns of docs, the text cleaned), n_lines (lines with a word), n_removed. A line is compared
    without the white space around it. It is boilerplate if it stands on at least `min_sites` distinct sources of documents
    that are not copies of each other, and goes wherever it stands, also where nothing else is left; all other lines and
    breaks stay as they are.

    Copies are told by what is left of a document without all lines that stand on `min_sites` sources, whoever has them:
    documents that share a pair of near hashes among the least ones of their runs of three words there are copies; of
    documents with nothing left, those with the same lines. So a template's own lines make no copies of its pages, and
    the lines of a document that was copied to many sources stay.

    Null text stays null and has no lines; a null source is a source; repeated rows are copies of each other. Other columns
    are kept whatever their names; an empty table gives no rows.

    Rows without such a line go straight through, told by a bitmap of those lines; only the others are shuffled.
    """
    wide = boilerplate_lines(docs, min_sites)
    mark = scratch_mark()
    bitmap, bits = line_filter(wide)
    there = docs.select(F.struct("*").alias("row"), F.col("text"), F.col("source").cast("string").alias("site"), bitmap.scalar().alias("bits"))
    some = F.exists(text_lines(), lambda x: possible(x, F.col("bits"), bits))
    ident = F.xxhash64("row.doc_id", "text", "site")
    pages = settle(there.where(some).select("row", "text", F.coalesce("site", F.lit("\x00none")).alias("site"), ident.alias("id")), "pages")

    keys = F.array_distinct(F.transform(F.filter(text_lines(), has_word), line_key))
    hits = settle(pages.select("id", F.explode(keys).alias("k")).select("id", "k.*").join(wide, KEY, "left_semi").distinct(), "hits")
    own = pages.select("id", "site", text_lines().alias("lines"), bitmap.scalar().alias("bits")).select(
        "id", "site", "lines", F.filter("lines", lambda x: has_word(x) & ~possible(x, F.col("bits"), bits)).alias("own"))
    keyed = settle(own.select("id", "site", "lines", least_runs(F.col("own")).alias("runs")).select(
        "id", "site", F.explode(copy_keys(F.col("runs"), F.col("lines"))).alias("key")), "keys")
    counted = independent_sites(keyed)
    boilerplate = settle(hits.join(counted.hint("merge"), "id").select(*KEY, "site").distinct().groupBy(*KEY)
                         .agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select(*KEY), "boilerplate")
    discard_since(mark, pages, hits, boilerplate)

    cuts = hits.join(boilerplate, KEY, "left_semi").groupBy("id").agg(F.collect_set(F.struct(*KEY)).alias("cuts"))
    both = pages.select("row", "text", "id").join(cuts.hint("merge"), "id", "left").withColumn("lines", F.transform(
        text_lines(), lambda x: F.struct(x.alias("line"), F.when(F.col("cuts").isNull() | ~has_word(x), False).otherwise(
            F.array_contains("cuts", line_key(x))).alias("hit"))))
    left = F.transform(F.filter("lines", lambda x: ~x["hit"]), lambda x: x["line"])
    removed = F.size(F.filter("lines", lambda x: x["hit"])).cast("long")
    n_lines = F.size(F.filter(text_lines(), has_word)).cast("long").alias("n_lines")
    cleaned = both.select(F.when(F.col("cuts").isNull(), F.col("row")).otherwise(
        F.col("row").withField("text", F.array_join(left, "\n"))).alias("row"), n_lines, removed.alias("n_removed"))
    return there.where(~some).select("row", n_lines, F.lit(0).cast("long").alias("n_removed")).unionByName(cleaned)
