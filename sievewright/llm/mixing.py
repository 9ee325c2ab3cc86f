"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

# Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
SEED = 17
# Documents of a source stand in a seeded order; words are summed for 2**RANGE_BITS ranges of it.
RANGE_BITS = 12


def word_count(text: str = "text") -> Column:
    """Number of runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).cast("long"), F.lit(0).cast("long"))


def source_weights(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Give the sources their weights by code point order, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.get(table, (F.row_number().over(order) - 1) % len(weights)))


def water_fill(sources: DataFrame, total: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources (source, source_size, weight): shares of `total` by weight, clamped at the cap.

    Each round gives every source that is not clamped its share of what the clamped ones leave, and clamps those
    above `max_epochs` times their size, until none is. A round is one aggregate over the table of sources; the
    driver gets three numbers from it.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    level, clamped = None, 0
    while True:
        over = F.lit(False) if level is None else cap < F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)).alias("used"),
                          F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
                          F.count(F.when(over, 1)).alias("n")).first()
        if level is not None and (row.n == clamped or not row.open):
            break
        clamped = row.n
        level = max(total - (row.used or 0.0), 0.0) / row.open if row.open else 0.0
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(level))))


def _spot(seed: int) -> Column:
    """Where a row stands in the seeded order of its source: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 1)


def _thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source the spot up to which rows are taken once more, so that words come nearest to `extra`."""
    sums = settle(rows.groupBy("source", F.shiftright("spot", 63 - RANGE_BITS).alias("range"))
                  .agg(F.sum("size").alias("words")), "sums")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    placed = placed.join(plan.select(F.col("source").alias("of"), "extra"), F.col("source").eqNullSafe(F.col("of")))
    start = F.shiftleft("range", 63 - RANGE_BITS)
    full = F.col("before") + F.col("words") <= F.col("extra")
    border = settle(placed.where(~full & (F.col("before") < F.col("extra"))).select(
        "of", F.col("range").alias("at"), "before", "extra", (start - 1).alias("none")), "border")
    inside = placed.where(full).groupBy("of").agg(
        F.max(start + F.lit((1 << (63 - RANGE_BITS)) - 1)).alias("spot_full"))
    at_border = rows.join(border, F.col("source").eqNullSafe(F.col("of"))
                          & (F.shiftright("spot", 63 - RANGE_BITS) == F.col("at")))
    up_to = Window.partitionBy("of").orderBy("spot")
    miss = F.abs(F.col("before") + F.sum("size").over(up_to) - F.col("extra"))
    nearest = at_border.select("of", "none", F.struct(miss.alias("miss"), F.col("spot").alias("spot")).alias("some"),
                               F.struct(F.abs(F.col("before") - F.col("extra")).alias("miss"),
                                        F.col("none").alias("spot")).alias("nothing")) \
        .groupBy("of").agg(F.least(F.min("some"), F.min("nothing")).getField("spot").alias("spot_border"))
    return (plan.join(inside, plan.source.eqNullSafe(inside.of), "left").drop("of")
            .join(nearest, plan.source.eqNullSafe(nearest.of), "left").drop("of")
            .withColumn("spot_last", F.coalesce("spot_border", "spot_full", F.lit(-1).cast("long")))
            .drop("spot_border", "spot_full"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS,
             seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of `docs` (doc_id, text, source): a row for each document, and a row for each source.

    Documents: doc_id, source, size (words), spot. Sources: source, source_size, target, whole, spot_last. The mix
    takes each row of a source `whole` times, and rows up to `spot_last` once more; see `repeats`. Sources weigh
    `weights` by code point order, null last (null is a source of its own). The fraction of a round that is left
    after whole ones goes to rows in seeded order, up to the row at which the words taken come nearest to the
    target. So every source is within half a document of its target, reruns agree, and no row is taken more than
    `max_epochs` times, rounded up. A null or empty text has size 0. Rows that repeat an id and text share their
    place and are taken together. A source without words has target 0. An empty table gives no rows.

    Words are summed by source and range of the seeded order first: only the one range that holds the border is
    ordered row by row, so no source is sorted as a whole.
    """
    rows = settle(docs.select("doc_id", "source", word_count().alias("size"), _spot(seed).alias("spot")), "sizes")
    sizes = settle(source_weights(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "sources")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A share within rounding error of a whole number is that number.
    plan = settle(water_fill(sizes, float(total), max_epochs)
                  .withColumn("whole", F.floor(share + F.lit(1e-9)).cast("int"))
                  .withColumn("extra", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
                  .drop("weight"), "targets")
    return rows, settle(_thresholds(rows, plan).drop("extra"), "thresholds")


def repeats(spot: Column) -> Column:
    """How often the mix takes a row, by its spot and the plan of its source."""
    return F.col("whole") + F.when(spot <= F.col("spot_last"), 1).otherwise(0)


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with their columns as they are."""
    _, sources = mix_plan(docs, weights, max_epochs, seed)
    plan = sources.select(F.col("source").alias("__of"), "whole", "spot_last")
    named = docs.select(F.struct("*").alias("__row"), F.col("source").alias("__source"), _spot(seed).alias("__spot"))
    times = repeats(F.col("__spot"))
    return (named.join(plan, F.col("__source").eqNullSafe(F.col("__of")))
            .select("__row", F.explode(F.array_repeat(F.lit(0), times))).select("__row.*"))
