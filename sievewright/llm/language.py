"""Language of web pages: text likelihoods, declared language, address suffix and host priors, fused by Bayes' rule."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, settle, text_slices
from .textops import text_buffer

# The text model is fitted on at most so many labelled documents, those of least hash.
FIT_ROWS = 6_000
BUCKETS = 1 << 14
# Neighbouring trigrams repeat the same evidence: log-likelihoods count for this part only, up to so many trigrams.
TEMPER = 0.25
ENOUGH = 400.0
# Pages that the level above stands for when a level of the host hierarchy is smoothed.
HOST_WEIGHT, DOMAIN_WEIGHT, SUFFIX_WEIGHT, GLOBAL_WEIGHT = 5.0, 10.0, 20.0, 1.0
# Pseudo-counts of a declared language: for agreeing with the language of the page, and for any other.
AGREE, DIFFER = 8.0, 1.0

HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
TAG = re.compile(r"<[^<>]*>")
DECLARED = re.compile(r"<html\b[^<>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)
META = re.compile(r"<meta\b[^<>]*?content-language[^<>]*?content\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)
HOST = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def visible_text(page: str) -> str:
    return html.unescape(TAG.sub(" ", HIDDEN.sub(" ", page)))


def declared_language(page: str) -> str | None:
    m = DECLARED.search(page) or META.search(page)
    return m[1].lower() if m else None


def host_of(url: str | None) -> str | None:
    m = HOST.match(url or "")
    return m[1].lower().strip(".") or None if m else None


def _letters() -> np.ndarray:
    """Bytes folded for trigrams: letters in lower case, everything else in ASCII one separator."""
    table = np.zeros(256, np.uint32)
    table[128:] = np.arange(128, 256)
    for c in range(97, 123):
        table[c] = table[c - 32] = c
    return table


def trigram_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of a text column in order, and the bounds of its rows; trigrams of separators are left out."""
    data, bounds = text_buffer(column)
    folded = _letters()[data]
    if len(folded) < 3:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    code = folded[:-2] * np.uint32(65536) + folded[1:-1] * np.uint32(256) + folded[2:]
    # Inside one row, and with a letter in the middle.
    valid = folded[1:-1] > 0
    edges = bounds[1:-1]
    for back in (1, 2):
        at = edges - back
        valid[at[(at >= 0) & (at < len(valid))]] = False
    places = np.flatnonzero(valid)
    bucket = ((code[places] * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)
    return bucket, np.searchsorted(places, bounds)


def _fit_counts(languages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        rows = np.zeros(len(languages), np.int64)
        for batch in text_slices(batches):
            bucket, cut = trigram_counts(batch.column("text"))
            for i, name in enumerate(batch.column("lang").to_pylist()):
                k = languages.index(name)
                counts[k] += np.bincount(bucket[cut[i]:cut[i + 1]], minlength=BUCKETS)
                rows[k] += 1
        for k in np.flatnonzero(rows).tolist():
            yield pa.RecordBatch.from_pydict({"lang": [languages[k]], "counts": pa.array([counts[k]], pa.list_(pa.int64()))})
    return run


def fit_text_model(labelled: DataFrame, most: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities of trigram buckets in each, from at most `most` rows (doc_id, text, lang)."""
    bounded_batches(labelled.sparkSession)
    known = labelled.where("lang is not null and text is not null")
    chosen = known.select("doc_id", F.xxhash64("doc_id").alias("order")).orderBy("order", "doc_id").limit(most).select("doc_id")
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(chosen.distinct()), "doc_id").select("text", "lang")
    rows = settle(rows, "labelled")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    summed = np.zeros((len(languages), BUCKETS))
    parts = rows.mapInArrow(_fit_counts(languages), "lang string, counts array<long>")
    positions = parts.select("lang", F.posexplode("counts").alias("bucket", "n")).groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).where("n > 0").toArrow()
    for lang, bucket, n in zip(*(positions.column(c).to_pylist() for c in ("lang", "bucket", "n"))):
        summed[languages.index(lang), bucket] = n
    smooth = summed + 0.5
    return languages, np.log(smooth / smooth.sum(axis=1, keepdims=True))


def _evidence(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(model.value.T)
        for batch in text_slices(batches, "html"):
            pages = [p or "" for p in batch.column("html").to_pylist()]
            hosts = [host_of(u) for u in batch.column("url").to_pylist()]
            bucket, cut = trigram_counts(pa.array([visible_text(p) for p in pages], pa.string()))
            sums = np.zeros((len(pages), table.shape[1]))
            n = np.diff(cut)
            full = n > 0
            if full.any():
                sums[full] = np.add.reduceat(table[bucket], cut[:-1][full], axis=0)
            weight = TEMPER * np.minimum(1.0, ENOUGH / np.maximum(n, 1))
            logs = sums * weight[:, None]
            logs -= logs.max(axis=1, keepdims=True) if logs.shape[1] else 0
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"),
                "host": pa.array(hosts, pa.string()),
                "declared": pa.array([declared_language(p) for p in pages], pa.string()),
                "n_trigrams": pa.array(n.astype(np.int64)),
                "logs": pa.array(list(logs), pa.list_(pa.float64()))})
    return run


def host_priors(pages: DataFrame, size: int) -> DataFrame:
    """Soft counts of each host and of the levels above it: host, n0.., d0.., s0.. (host, domain, suffix).

    Text posteriors are summed by host in one aggregate; the levels above are sums over the table of hosts.
    """
    post = [f"p{i}" for i in range(size)]
    hosts = settle(pages.groupBy("host").agg(*[F.sum(p).alias(f"n{i}") for i, p in enumerate(post)])
                   .withColumn("labels", F.split("host", "\\."))
                   .withColumn("domain", F.array_join(F.slice("labels", F.greatest(F.lit(1), F.size("labels") - 1), F.lit(2)), "."))
                   .withColumn("suffix", F.element_at("labels", -1)).drop("labels"), "hosts")
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(size)])
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(size)])
    return hosts.join(domains, "domain", "left").join(suffixes, "suffix", "left")


def page_languages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, lang, confidence and the evidence of every row of `pages` (page_id, url, html).

    `labelled` (doc_id, text, lang) fits the text model. The log-posterior of a language adds: the tempered trigram
    log-likelihood of the visible text; the log-probability of the declared language, and of the address suffix, given
    the language; and a host prior smoothed over host, domain, suffix and all pages. The probabilities come from
    grouped sums of text posteriors over all pages, without the page's own. Ties go to the first language in code
    point order. Missing evidence (null or empty url or html, nothing declared) is neutral; a page without any gets
    the most frequent language. Rows are independent, so repeated rows get equal results, and other columns are
    ignored; an empty table gives no rows; without labelled rows `lang` is null.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    languages, table = fit_text_model(labelled)
    size = len(languages)
    if not size:
        return pages.select("page_id", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"))])
    model = spark.sparkContext.broadcast(table)
    found = pages.select("page_id", "url", "html").mapInArrow(
        _evidence(model), "page_id long, host string, declared string, n_trigrams long, logs array<double>")
    logs = [F.get("logs", F.lit(i)) for i in range(size)]
    mass = sum((F.exp(x) for x in logs[1:]), F.exp(logs[0]))
    found = settle(found.select("page_id", "host", "declared", "n_trigrams", *[x.alias(f"t{i}") for i, x in enumerate(logs)],
                                *[(F.exp(x) / mass).alias(f"p{i}") for i, x in enumerate(logs)]), "evidence")
    span = range(size)
    priors = host_priors(found, size)
    # One row; with the number of pages it smooths every level.
    top = [v or 0.0 for v in found.agg(*[F.sum(f"p{i}") for i in span]).first()]
    overall = [(v + GLOBAL_WEIGHT / size) / (sum(top) + GLOBAL_WEIGHT) for v in top]
    spoken = found.where("declared is not null").groupBy("declared").agg(*[F.sum(f"p{i}").alias(f"c{i}") for i in span])
    spoken_all = [v or 0.0 for v in spoken.agg(*[F.sum(f"c{i}") for i in span]).first()]
    joined = (found.join(priors.withColumnRenamed("host", "of"), F.col("host") == F.col("of"), "left")
              .join(spoken.withColumnRenamed("declared", "said"), F.col("declared") == F.col("said"), "left"))

    def rest(column: str, i: int) -> Column:
        return F.greatest(F.coalesce(F.col(column), F.lit(0.0)) - F.col(f"p{i}"), F.lit(0.0))

    def level(prefix: str, weight: float, below: list[Column]) -> list[Column]:
        total = sum((rest(f"{prefix}{i}", i) for i in span), F.lit(0.0))
        return [(rest(f"{prefix}{i}", i) + F.lit(weight) * below[i]) / (total + F.lit(weight)) for i in span]

    prior = level("n", HOST_WEIGHT, level("d", DOMAIN_WEIGHT, level("s", SUFFIX_WEIGHT, [F.lit(v) for v in overall])))
    scores = []
    for i, name in enumerate(languages):
        agree = F.when(F.col("declared") == name, AGREE).otherwise(DIFFER)
        said = F.log((rest(f"c{i}", i) + agree) / F.lit(spoken_all[i] + AGREE + DIFFER * size))
        # How much likelier the suffix is under the language than at large.
        ends = F.log((rest(f"s{i}", i) + F.lit(SUFFIX_WEIGHT * overall[i])) / F.lit(top[i] + SUFFIX_WEIGHT))
        scores.append(F.col(f"t{i}") + F.log(prior[i]) + F.when(F.col("declared").isNull(), 0.0).otherwise(said)
                      + F.when(F.col("host").isNull(), 0.0).otherwise(ends))
    scored = joined.select("page_id", "host", "declared", "n_trigrams", *[x.alias(f"x{i}") for i, x in enumerate(scores)],
                           *[f"p{i}" for i in span])
    names = F.array(*[F.lit(n) for n in languages])

    def first_best(prefix: str) -> Column:
        values = F.array(*[F.col(f"{prefix}{i}") for i in span])
        return F.get(names, F.array_position(values, F.array_max(values)).cast("int") - 1)

    best = F.greatest(*[F.col(f"x{i}") for i in span]) if size > 1 else F.col("x0")
    confidence = 1 / sum((F.exp(F.col(f"x{i}") - best) for i in span), F.lit(0.0))
    return scored.select("page_id", first_best("x").alias("lang"), confidence.alias("confidence"),
                         F.when(F.col("n_trigrams") > 0, first_best("p")).alias("text_lang"), "declared", "host")
