"""Near-duplicate documents: one-permutation hashing, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import (bitmap_of, bounded_batches, discard, discard_since, passes, scratch_mark, settle, slot_of, text_slices,
                     worker_cache)
from .components import connected_components
from .textops import mixed, shingle_sets

ROWS, BANDS = 4, 40
BINS = ROWS * BANDS
# Percent of similarity that makes a link.
NEEDED = 75
# Pairs that agree in fewer bins are not looked at on full sets: 0.75 less six standard deviations. Sets of fewer than
# SMALL shingles are looked at in any case.
LEAST_BINS = int(BINS * (NEEDED / 100 - 6 * (0.75 * 0.25 / BINS) ** 0.5))
SMALL = 16
# Leftover pairs are listed for buckets of at most LISTED members. Larger ones are divided by the rarest shingles of their
# members; those that are still larger give so many new hubs a round.
LISTED = 16
HUBS = 16

SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>, bins binary"


def _hashing():
    """Lower bounds of the bins, and for each bin the random order in which an empty one looks for another."""
    rng = np.random.Generator(np.random.PCG64(7))
    edges = np.array([(i << 64) // BINS for i in range(BINS)], np.uint64)
    order = np.stack([rng.permutation(BINS) for _ in range(BINS)])
    keys = rng.integers(0, 2**64, BINS, np.uint64, endpoint=False) | np.uint64(1)
    return edges, order, keys


def one_permutation(shingles: np.ndarray) -> np.ndarray:
    """The least value of each bin of a sorted set, empty bins filled by optimal densification.

    An empty bin copies the first occupied one of its own random order of all bins, the same order for every set.
    """
    edges, order, keys = worker_cache("minhash", _hashing)
    at = np.searchsorted(shingles, edges)
    nexts = np.append(at[1:], len(shingles))
    full = at < nexts
    if not full.all():
        source = np.arange(BINS)
        empty = np.flatnonzero(~full)
        source[empty] = order[empty, full[order[empty]].argmax(axis=1)]
        at = at[source]
    return mixed(shingles[at] * keys)


def band_keys(values: np.ndarray) -> np.ndarray:
    """Bucket names of the bands of a signature; a band's number is part of the name."""
    return mixed(values.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
                 + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        sets = shingle_sets(batch.column("text"))
        values = [one_permutation(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                                for s in sets], pa.binary()),
            "bands": pa.array([None if v is None else band_keys(v) for v in values], pa.list_(pa.int64())),
            "bins": pa.array([None if v is None else v.astype(np.uint8).tobytes() for v in values], pa.binary())})


def sketch(docs: DataFrame) -> DataFrame:
    """Number of shingles, digest of the set, bucket names and one byte of each bin of documents (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_sketches, SKETCH)


def _chosen_sets(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = passes(bitmap.value, batch.column("slot").to_numpy())
            for part in text_slices([batch.filter(pa.array(mask))]):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "shingles": pa.array([s.tobytes() for s in shingle_sets(part.column("text"))], pa.binary())})
    return run


def chosen_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents whose ids are in `nodes` (node), one row an id and set."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(bitmap_of(nodes.select(slot_of("node").alias("slot"))))
    found = docs.where("doc_id is not null").select("doc_id", "text", slot_of("doc_id").alias("slot")).mapInArrow(
        _chosen_sets(bitmap), "doc_id long, shingles binary")
    return found.join(nodes, found.doc_id == nodes.node, "left_semi").distinct()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("set_a"), batch.column("set_b")):
            a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
            common = len(a) + len(b) - len(np.union1d(a, b))
            keep.append(100 * common >= NEEDED * (len(a) + len(b) - common))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("bins_u", "bins_v"))
        keep = ((a == b).sum(axis=1) >= LEAST_BINS) | (batch.column("least").to_numpy() < SMALL)
        yield batch.select(["u", "v"]).filter(pa.array(keep))


def verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough; signatures spare most others the look."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}"))
    likely = (pairs.join(side("u"), "u").join(side("v"), "v")
              .select("u", "v", F.least("n_u", "n_v").alias("least"), "bins_u", "bins_v")
              .mapInArrow(_promising, "u long, v long"))
    full = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = likely.join(full("u"), "u").join(full("v"), "v")
    return both.select("u", "v", F.col("set_u").alias("set_a"), F.col("set_v").alias("set_b")).mapInArrow(
        _similar, "u long, v long").distinct()


def _fits(a: str, b: str):
    """Sizes alone allow the similarity."""
    return F.expr(f"100 * least({a}, {b}) >= {NEEDED} * greatest({a}, {b})")


def star_edges(members: DataFrame) -> DataFrame:
    """One edge from the least member of each bucket to each other one: as many pairs as rows, at most."""
    hubs = (members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.max("rep").alias("last"))
            .where("hub.rep < last").select("key", F.col("hub.rep").alias("u"), F.col("hub.n").alias("hub_n")))
    return members.join(hubs, "key").where(F.col("rep") > F.col("u")).where(_fits("n", "hub_n")) \
        .select("u", F.col("rep").alias("v")).distinct()


def _rest(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members that may still have a link to another component of their bucket: key, rep, n, most, comp, size.

    A member stays if it could reach enough with the shortest member of any other component.
    """
    named = members.join(labels, members.rep == labels.node, "left").select(
        "key", "rep", "n", "most", F.coalesce("component", "rep").alias("comp"))
    parts = named.groupBy("key", "comp").agg(F.min("n").alias("least"), F.count("*").alias("own"))
    first = (parts.groupBy("key").agg(F.min(F.struct("least", "comp")).alias("first"), F.sum("own").alias("size"),
                                      F.min("comp").alias("low"), F.max("comp").alias("high"))
             .where("low < high").select("key", "first", "size"))
    second = (parts.join(first, "key").where("comp <> first.comp").groupBy("key", "first", "size")
              .agg(F.min("least").alias("second")))
    other = F.when(F.col("comp") == F.col("first.comp"), F.col("second")).otherwise(F.col("first.least"))
    return named.join(second, "key").where(_reaches(F.col("most"), F.col("n") + other)).select(
        "key", "rep", "n", "most", "comp", "size")


def _cross_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of different components within a bucket, one side from each table, that may share enough there."""
    side = lambda t, x: t.select("key", F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("most").alias(f"m_{x}"),
                                 F.col("comp").alias(f"c_{x}"))
    fits = _reaches(F.least("m_x", "m_y"), F.col("n_x") + F.col("n_y"))
    return side(a, "x").join(side(b, "y"), "key").where("c_x <> c_y").where(fits).select(
        F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def _reaches(common: Column, sizes: Column) -> Column:
    """So many common shingles are enough for two sets whose sizes add up to `sizes`."""
    return F.lit(100 + NEEDED) * common >= F.lit(NEEDED) * sizes


def _hubs(large: DataFrame) -> DataFrame:
    """The next hubs of each large bucket: its shortest members, and members of its smallest components."""
    sizes = large.groupBy("key", "comp").agg(F.count("*").alias("own"))
    short = F.row_number().over(Window.partitionBy("key").orderBy("n", "rep"))
    apart = F.row_number().over(Window.partitionBy("key").orderBy("own", "comp", "rep"))
    return large.join(sizes, ["key", "comp"]).withColumns({"short": short, "apart": apart}).where(
        F.least("short", "apart") <= HUBS // 2).drop("own", "short", "apart")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, one in enumerate(batch.column("shingles")):
            values = np.frombuffer(one.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), batch.column("rep")[i].as_py())), pa.array(values)], names=["rep", "key"])


def _divided(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of large buckets by the shingles of their prefix: key, rep, n, most.

    Shingles are ranked by how many of these members have them, then by hash. The prefix of a set of n shingles holds
    its n - ceil(0.75 n) + 1 first ones; two sets that are similar enough share one of those. If the shingle of a bucket
    is the first that two sets share, they share at most `most` of them, those from it on. A member that could not
    reach enough even with the shortest one of its bucket leaves it: where members have only a common passage in
    common, those remain that the passage fills.
    """
    nodes = large.select("rep", "n").distinct()
    held = settle(sets.join(nodes, F.col("doc_id") == F.col("rep")).select("rep", "shingles").mapInArrow(
        _exploded, "rep long, key long"), "shingles")
    common = held.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    shared = held.join(common, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("shared"))
    # Shingles that only one member has come first in its ranking and meet nobody.
    alone = F.col("n") - F.size("shared")
    prefix = F.greatest(F.col("n") - F.ceil(F.col("n") * F.lit(NEEDED) / 100) + 1 - alone, F.lit(0)).cast("int")
    placed = shared.join(nodes, "rep").select("rep", "n", alone.alias("alone"), F.posexplode(
        F.slice("shared", F.lit(1), prefix)).alias("at", "one")).select(
            F.col("one.key").alias("key"), "rep", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("most"))
    shortest = placed.groupBy("key").agg(F.min("n").alias("least"))
    return placed.join(shortest, "key").where(_reaches(F.col("most"), F.col("n") + F.col("least"))).select(
        "key", "rep", "n", "most")


def link_classes(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, component) of the linked classes; `reps` has one row a class: rep, n, bands, bins.

    First every bucket gives a star around its least member; the links confirmed on full sets give components. A
    bucket whose members then lie in one component needs nothing more. In the others every pair of different
    components is looked at too: all at once in buckets of at most LISTED members, which is a fixed multiple of the
    rows. Larger ones, such as those of a passage that very many documents quote, are divided by their members' rarest
    shingles first, which loses no link; what is still larger goes star by star, HUBS new hubs a bucket and round, until
    nothing is left. So no round lists more pairs than a fixed multiple of its rows, and there is no limit on partners.
    """
    mark = scratch_mark()
    members = reps.select(F.explode("bands").alias("key"), "rep", "n", F.col("n").alias("most"))
    shared = (members.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
              .where("low < high").select("key"))
    members = settle(members.join(shared, "key", "left_semi"), "buckets")
    nodes = settle(members.select(F.col("rep").alias("node")).distinct(), "nodes")
    reps = settle(reps.join(nodes, F.col("rep") == F.col("node"), "left_semi"), "nodes")
    sets = settle(chosen_sets(docs, nodes), "sets")
    links = settle(verified(star_edges(members), reps, sets), "links")
    labels = settle(connected_components(links), "labels")
    divided = False
    while True:
        rest = settle(_rest(members, labels), "rest")
        if not rest.limit(1).count():
            break
        small, large = rest.where(F.col("size") <= LISTED), rest.where(F.col("size") > LISTED)
        pairs = _cross_pairs(small, small)
        if divided:
            hubs = settle(_hubs(large), "hubs")
            pairs = pairs.unionByName(_cross_pairs(hubs, large)).distinct()
            left = large.join(hubs, ["key", "rep"], "left_anti").select("key", "rep", "n", "most")
        else:
            left = _divided(large, sets)
        more = settle(verified(pairs, reps, sets), "links")
        discard(members)
        members, divided = settle(left, "buckets"), True
        if more.limit(1).count():
            labels = _relabelled(labels, more)
        discard(more)
        discard(rest)
    discard_since(mark, labels)
    return labels


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) with further links (u, v): only those between two components are contracted."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    joined = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(
        F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v"))
    merged = settle(connected_components(joined).withColumnsRenamed({"node": "of", "component": "least"}), "merged")
    known = labels.join(merged, F.col("component") == F.col("of"), "left").select(
        "node", F.coalesce("least", "component").alias("component"))
    new = merged.join(labels, F.col("of") == F.col("node"), "left_anti").select(
        F.col("of").alias("node"), F.col("least").alias("component"))
    after = settle(known.unionByName(new), "labels")
    discard(merged)
    discard(labels)
    return after


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text).

    Words are runs of anything but ASCII white space, lower-cased in A-Z; a document's set holds its distinct
    five-word shingles (64-bit hashes). Documents with a similarity of at least 0.75 are linked. Equal sets form a
    class and enter once, so exact copies cost one row. Documents without words (null, empty or blank texts) are
    their own component. Rows that share a doc_id count as one document. Rows without a doc_id get a null component
    and are kept; other columns are ignored. An empty table gives an empty result.
    """
    sketches = settle(sketch(docs), "sketches")
    known = sketches.where("digest is not null and doc_id is not null")
    reps = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"),
                                       F.first("bands").alias("bands"), F.first("bins").alias("bins"))
    reps = settle(reps, "classes")
    labels = link_classes(docs, reps)
    classes = reps.select("digest", "rep").join(labels, reps.rep == labels.node, "left").select(
        "digest", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of `docs` (doc_id, text, more) of each group of near duplicates, the one of least doc_id, with its columns.

    Every row counts on its own, whatever its doc_id: of rows that share an id, or have none, those with similar texts
    are near duplicates of each other like any others; an id goes before none, ties to the first row. Rows without
    words (null, empty or blank texts) are linked with nothing and stay. An empty table gives no rows.
    """
    # Rows get their numbers once and keep them in a table: scans on another number of executors may deal them otherwise.
    rows = settle(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "rows")
    mark = scratch_mark()
    classes = near_duplicates(rows.select(F.col("at").alias("doc_id"), "row.text")).select(
        F.col("doc_id").alias("at"), F.col("component_id").alias("component"))
    several = classes.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = settle(classes.join(several, "component"), "members")
    # One plan at every size: what is dropped grows with the table, so neither side is broadcast.
    named = members.join(rows.select("at", F.col("row.doc_id").alias("id")).hint("merge"), "at")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "at")
    stays = named.groupBy("component").agg(F.min(order)["at"].alias("stays"))
    dropped = settle(members.join(stays, "component").where("at <> stays").select("at"), "dropped")
    discard_since(mark, dropped)
    return rows.join(dropped.hint("merge"), "at", "left_anti").select("row.*")
