"""Personal data: exact patterns, and a bootstrap that learns the words around what they find."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, settle, text_slices
from .textops import text_buffer

KINDS = ("email", "ip", "card", "phone")
# A learnt pattern must hold in so many different seeds and documents, and score so high, before it adds spans.
LEAST_SEEDS = 3
LEAST_DOCS = 3
CONFIDENT = 0.8
ROUNDS = 6

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run is tried from its first digit only: from a later one it would fail in the same place.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What a learnt pattern may add: looser shapes of each kind.
LOOSE = {
    "email": re.compile(r"(?<![^\s<(\[\"'])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:@|\x20?[\[(]at[\])]\x20?)"
                        r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){0,4}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9A-Za-z+.-])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9A-Za-z]|[.-][0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]?[0-9]{2,5}){1,4}(?![0-9A-Za-z]|[.-][0-9])"),
}
WORD = re.compile(r"\S{1,40}")
LABEL = re.compile(r"(?:^|\n)[^\S\n]*([^\W\d][^\n:]{0,30}):[^\S\n]*\Z")

FOUND = ("row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
         "mentions array<struct<start:int,end:int,kind:string,seed:boolean,value:string,contexts:array<string>>>")
MENTIONS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("seed", pa.bool_()),
                               ("value", pa.string()), ("contexts", pa.list_(pa.string()))]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, found from their @: the local part cannot hold one, so the run before it is the match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            last = domain.end()
        # What an @ leaves behind cannot be part of the next local part anyway.
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind; those that fail their test are dropped."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    spans["email"] = emails(text)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans["phone"].append(m.span())
    return spans


def written(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: the last word and the last two before it, the next word, and the label of its line.

    Words are in lower case with digits as 0.
    """
    plain = lambda words: [re.sub("[0-9]", "0", w.lower()) for w in words]
    before = plain(WORD.findall(text, max(0, start - 90), start)[-2:])
    out = [" ".join(before[-n:]) + " _" for n in (1, 2) if len(before) >= n]
    after = WORD.match(text, end + 1) if text[end:end + 1].isspace() else None
    if after:
        out.append("_ " + plain([after[0]])[0])
    label = LABEL.search(text, max(0, start - 60), start)
    if label:
        out.append(f"{label[1].lower()}: |")
    return out


def mentions(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """Seeds (base spans) and candidates (looser shapes that touch no base span) with their contexts."""
    taken = sorted(s for found in spans.values() for s in found)
    out = []

    def add(kind, a, b, seed):
        value = re.sub(r"[^a-z0-9@]", "", text[a:b].lower())
        out.append({"start": a, "end": b, "kind": kind, "seed": seed, "value": value, "contexts": contexts(text, a, b)})

    for kind in KINDS:
        for a, b in spans[kind]:
            add(kind, a, b, True)
    starts, ends = [s[0] for s in taken], np.maximum.accumulate([s[1] for s in taken] or [0])
    for kind, shape in LOOSE.items():
        if kind == "email" and "@" not in text and "at)" not in text and "at]" not in text:
            continue
        for m in shape.finditer(text):
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                continue
            i = int(np.searchsorted(starts, m.end()))
            if not (i and ends[i - 1] > m.start()):
                add(kind, *m.span(), False)
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in text_slices(batches):
        data, bounds = text_buffer(batch.column("text"))
        telling = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64) | (data == 93) | (data == 41))])
        hits = np.flatnonzero(np.diff(telling[bounds])).tolist()
        n = batch.num_rows
        counts, digest, base, found = {k: [0] * n for k in KINDS}, [nothing] * n, [""] * n, [[]] * n
        for i, text in zip(hits, batch.column("text").take(pa.array(hits, pa.int64())).to_pylist()):
            spans = base_spans(text)
            base[i] = written([(a, b, k) for k, s in spans.items() for a, b in s])
            digest[i] = hashlib.sha256(base[i].encode()).hexdigest()
            for k in KINDS:
                counts[k][i] = len(spans[k])
            found[i] = mentions(text, spans)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + n)), batch.column("doc_id"), *[pa.array(counts[k], pa.int64()) for k in KINDS],
             pa.array(digest), pa.array(base), pa.array(found, MENTIONS)],
            names=["row", "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "mentions"])
        row += n


def pattern_scores(edges: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_docs: int = LEAST_DOCS,
                   confident: float = CONFIDENT) -> DataFrame:
    """(kind, context, score) of the confident patterns of the graph `edges` (kind, context, value, seed, docs).

    A pattern scores the mean confidence of its instances, as if it had one more that is worth nothing. An instance
    that is a seed of the pattern's kind is worth 1, any other 1 - (1 - a)(1 - b)... over the scores of the confident
    patterns of the kind that hold it; at first 0. A pattern needs `least_seeds` instances that are seeds or were held
    with confidence in the round before: so what one pattern discovers induces the next. Rounds alternate between the two
    sides until no pattern comes or goes, `rounds` at most; each is one aggregate.
    """
    worth = edges.select("kind", "context", "value", "docs", "seed", F.col("seed").cast("double").alias("worth"))
    good, before = None, None
    for number in range(rounds):
        scored = worth.groupBy("kind", "context").agg(
            (F.sum("worth") / (F.count("*") + 1)).alias("score"), F.count_if(F.col("worth") >= confident).alias("seeds"),
            F.sum("docs").alias("docs"))
        after = settle(scored.where((F.col("seeds") >= least_seeds) & (F.col("docs") >= least_docs)
                                    & (F.col("score") >= confident)).select("kind", "context", "score"), "patterns")
        if good is not None:
            discard(good)
        good = after
        now = tuple(good.agg(F.count("*"), F.sum(F.xxhash64("kind", "context") % 1_000_000_007)).first())
        if now == before:
            break
        before = now
        if number + 1 < rounds:
            held = edges.where("not seed").join(good, ["kind", "context"]).groupBy("kind", "value").agg(
                (1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("held"))
            worth = edges.join(held, ["kind", "value"], "left").select(
                "kind", "context", "value", "docs", "seed",
                F.when(F.col("seed"), 1.0).otherwise(F.coalesce("held", F.lit(0.0))).alias("worth"))
    return good


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every text of `docs` (doc_id, text): a row each.

    Columns: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the spans that the exact patterns find; spans
    (kind:start:end, code points, end exclusive) of those and of the ones that learnt patterns add; n_added. Base spans
    always stay; an added span touches none of them. Patterns are the one or two words before a place, the word after it
    and the label of its line; the graph of patterns and distinct values is scored by Spark, so copies of a document count
    once a value, and values that confident patterns hold lead to further patterns. A null or empty text has no spans; rows are told apart by position, so repeated rows and ids do no harm; other columns are
    ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    found = settle(docs.select("doc_id", "text").mapInArrow(_found, FOUND), "found")
    each = found.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    # A value is one instance of a pattern however often it stands there; a seed anywhere is a seed.
    edges = each.select("kind", "value", "seed", F.explode("contexts").alias("context")).groupBy("kind", "context", "value").agg(
        F.max("seed").alias("here"), F.count("*").alias("docs"))
    seeds = edges.groupBy("kind", "value").agg(F.max("here").alias("seed"))
    edges = settle(edges.drop("here").join(seeds, ["kind", "value"]), "edges")
    patterns = pattern_scores(edges)
    added = (each.where("not seed").select("row", "start", "end", "kind", F.explode("contexts").alias("context"))
             .join(patterns, ["kind", "context"]).groupBy("row")
             .agg(F.collect_set(F.struct("start", "end", "kind")).alias("added")))
    out = found.drop("mentions").join(settle(added, "added"), "row", "left")
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    spans = F.array_union(
        F.transform(base, lambda s: F.struct(s[1].cast("int").alias("start"), place[s[0]].alias("place"),
                                             s[2].cast("int").alias("end"), s[0].alias("kind"))),
        F.transform(F.coalesce("added", F.array().cast("array<struct<start:int,end:int,kind:string>>")),
                    lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"),
                                       s["kind"].alias("kind"))))
    text = F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n_added = F.coalesce(F.size("added"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
                      F.when(n_added > 0, text).otherwise(F.col("base")).alias("spans"), n_added.alias("n_added"))
