"""Adaptive thresholds: exponentially weighted statistics per rule and what follows from them.

An observation x maps a state (mean, var) to a new one. Maps of that form compose
into maps of the same form, so a long history folds level by level in bounded
pieces and in parallel, instead of as one list per rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import decimals, percent
from ..schemas import CAPPED_AT_ONE, HIGHER_IS_BETTER
from ..session import cut_lineage

# Tuning of the adaptive thresholds.
MIN_OBSERVATIONS = 5
ALPHA = 0.3
K_STDDEV = 2.0
AUTO_MAX_CHANGE = 0.20
NO_CHANGE = 0.01
MAX_HISTORY = 200

# Batches folded per piece; `seq` counts batches, so a piece holds no more than this.
PIECE_BITS = 10


def observations(results: DataFrame) -> DataFrame:
    """Only PASS and WARN results with a metric feed the statistics."""
    return (results.filter(F.col("status").isin("pass", "warn") & F.col("metric_value").isNotNull())
            .select("rule_id", "seq", F.col("metric_value").alias("x")))


def capped_history(obs: DataFrame) -> DataFrame:
    """The last 200 observations per rule."""
    newest = Window.partitionBy("rule_id").orderBy(F.col("seq").desc())
    return (obs.withColumn("age", F.row_number().over(newest))
            .filter(F.col("age") <= MAX_HISTORY).drop("age"))


def observation_count(obs: DataFrame) -> DataFrame:
    return obs.groupBy("rule_id").agg(F.least(F.count(F.lit(1)), F.lit(MAX_HISTORY)).alias("n"))


# A map is (o, a, b, v, q2, q1, q0): with u = mean - o it sends
#   mean to o + a*u + b   and   var to v*var + q2*u^2 + q1*u + q0.
# The origin o keeps u small, so large metrics lose no digits.
_MAP_FIELDS = ("o", "a", "b", "v", "q2", "q1", "q0")


def _single(x: Column) -> Column:
    keep = 1 - ALPHA
    values = (x, F.lit(keep), F.lit(0.0), F.lit(keep), F.lit(keep * ALPHA), F.lit(0.0), F.lit(0.0))
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(_MAP_FIELDS, values)])


def _then(f: Column, g: Column) -> Column:
    """Apply f, then g."""
    d = f["o"] + f["b"] - g["o"]
    values = (
        f["o"], g["a"] * f["a"], g["a"] * d + g["b"] + g["o"] - f["o"], g["v"] * f["v"],
        g["v"] * f["q2"] + g["q2"] * f["a"] * f["a"],
        g["v"] * f["q1"] + 2 * g["q2"] * f["a"] * d + g["q1"] * f["a"],
        g["v"] * f["q0"] + g["q2"] * d * d + g["q1"] * d + g["q0"],
    )
    return F.struct(*[v.alias(n) for n, v in zip(_MAP_FIELDS, values)])


def ewma_fold(obs: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Fold observations (rule_id, seq, x) in `seq` order into (rule_id, n, mean, var, last_seq)."""
    level = obs.select("rule_id", "seq", F.lit(1).cast("long").alias("n"), _single(F.col("x")).alias("m"))
    for step in (1, 2, None):
        piece = [] if step is None else [F.shiftright("seq", PIECE_BITS * step).alias("piece")]
        grouped = level.groupBy("rule_id", *piece).agg(
            F.array_sort(F.collect_list(F.struct("seq", "m"))).alias("ms"),
            F.sum("n").alias("n"), F.max("seq").alias("seq"))
        folded = F.aggregate(F.slice("ms", 2, F.size("ms")), F.element_at("ms", 1)["m"],
                             lambda f, g: _then(f, g["m"]))
        level = grouped.select("rule_id", "seq", "n", folded.alias("m"))
    folded = level.withColumnRenamed("n", "new_n").withColumnRenamed("seq", "new_seq")
    if state is None:
        mean0, var0, n0 = F.col("m.o"), F.lit(0.0), F.lit(0)
        joined = folded
    else:
        joined = folded.join(state, "rule_id", "full")
        mean0, var0, n0 = F.coalesce("mean", "m.o"), F.coalesce("var", F.lit(0.0)), F.coalesce("n", F.lit(0))
    u = mean0 - F.col("m.o")
    mean = F.col("m.o") + F.col("m.a") * u + F.col("m.b")
    var = F.col("m.v") * var0 + F.col("m.q2") * u * u + F.col("m.q1") * u + F.col("m.q0")
    return joined.select(
        "rule_id", F.least(n0 + F.coalesce("new_n", F.lit(0)), F.lit(MAX_HISTORY)).cast("long").alias("n"),
        F.when(F.col("m").isNull(), mean0).otherwise(mean).alias("mean"),
        # The algebra can leave a tiny negative variance where the true one is zero.
        F.when(F.col("m").isNull(), var0).otherwise(F.greatest(var, F.lit(0.0))).alias("var"),
        F.coalesce("new_seq", *(["last_seq"] if state is not None else [])).cast("long").alias("last_seq"))


def suggest_threshold(rule_type: Column, n: Column, mean: Column, var: Column) -> Column:
    """Two standard deviations on the lenient side of the mean; NULL below five observations."""
    std = F.sqrt(var)
    upper = mean + K_STDDEV * std
    value = (F.when(rule_type.isin(*HIGHER_IS_BETTER), F.greatest(F.lit(0.0), mean - K_STDDEV * std))
             .when(rule_type.isin(*CAPPED_AT_ONE), F.least(F.lit(1.0), upper)).otherwise(upper))
    return F.when(n >= MIN_OBSERVATIONS, F.round(value, 6))


def relative_change(suggested: Column, threshold: Column) -> Column:
    return F.abs(suggested - threshold) / F.greatest(F.abs(threshold), F.lit(1e-9))


def classify_change(change: Column, adaptive: Column) -> Column:
    """none / auto / reapproval."""
    return (F.when(change.isNull() | ~adaptive | (change < NO_CHANGE), "none")
            .when(change <= AUTO_MAX_CHANGE, "auto").otherwise("reapproval"))


def suggestions(state: DataFrame, rules: DataFrame, never_tighten: bool = False) -> DataFrame:
    """(rule_id, threshold, n, mean, var, suggested, relative_change, change) per rule with state."""
    joined = rules.select("rule_id", "rule_type", "threshold", "adaptive", "status").join(
        state.select("rule_id", "n", "mean", "var"), "rule_id")
    suggested = suggest_threshold(F.col("rule_type"), F.col("n"), F.col("mean"), F.col("var"))
    out = joined.withColumn("suggested", suggested).withColumn(
        "relative_change", relative_change(F.col("suggested"), F.col("threshold")))
    change = classify_change(F.col("relative_change"), F.col("adaptive"))
    if never_tighten:
        tighter = F.when(F.col("rule_type").isin(*HIGHER_IS_BETTER), F.col("suggested") > F.col("threshold")
                         ).otherwise(F.col("suggested") < F.col("threshold"))
        change = F.when(tighter, "none").otherwise(change)
    return out.withColumn("change", change)


def change_reason() -> Column:
    return F.concat(
        F.lit("EWMA-based auto-tune from "), F.col("n").cast("string"), F.lit(" observations (mean="),
        decimals(F.col("mean"), 4), F.lit(", std="), decimals(F.sqrt("var"), 4),
        F.lit("); relative_change="), percent(F.col("relative_change"), 1))


def threshold_changes(state: DataFrame, rules: DataFrame, at: float,
                      never_tighten: bool = False) -> DataFrame:
    """History rows for the rules whose statistics ask for another threshold."""
    moved = suggestions(state, rules, never_tighten).filter(F.col("change") != "none")
    return moved.select(
        "rule_id", F.col("threshold").alias("old_threshold"), F.col("suggested").alias("new_threshold"),
        F.lit(at).cast("double").alias("changed_at"), change_reason().alias("reason"),
        F.lit(True).alias("auto_adjusted"), (F.col("change") == "reapproval").alias("required_reapproval"))


def adapt_step(results: DataFrame, rules: DataFrame, state: DataFrame | None, at: float,
               never_tighten: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new state, threshold changes) after one batch of check results."""
    new_state = ewma_fold(observations(results), state)
    checked = rules.join(results.select("rule_id").distinct(), "rule_id", "left_semi")
    return new_state, threshold_changes(new_state, checked, at, never_tighten)


_REPLAY_SCHEMA = ("rule_id string, seq long, n long, mean double, var double, old_threshold double, "
                  "suggested double, relative_change double, change string, threshold double, status string")
REPLAY_BITS = 12


def _replay_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step through rows sorted by rule and seq; only the state of the present rule is held."""
    rule, seen, mean, var, threshold, status = None, 0, None, 0.0, 0.0, ""
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            if r.rule_id != rule:
                rule, threshold, status = r.rule_id, r.threshold0, r.status0
                seen = 0 if pd.isna(r.n0) else int(r.n0)
                mean, var = (r.mean0, r.var0) if seen else (r.x, 0.0)
            delta = r.x - mean
            mean += ALPHA * delta
            var = (1 - ALPHA) * (var + ALPHA * delta * delta)
            seen = min(seen + 1, MAX_HISTORY)
            before, suggested, change, kind = threshold, None, None, "none"
            if r.adaptive and seen >= MIN_OBSERVATIONS:
                spread = K_STDDEV * var ** 0.5
                suggested = max(0.0, mean - spread) if r.rule_type in HIGHER_IS_BETTER else mean + spread
                suggested = round(min(1.0, suggested) if r.rule_type in CAPPED_AT_ONE else suggested, 6)
                change = abs(suggested - threshold) / max(abs(threshold), 1e-9)
                if change >= NO_CHANGE:
                    kind = "auto" if change <= AUTO_MAX_CHANGE else "reapproval"
                    threshold = suggested
                    status = "approved" if kind == "reapproval" else status
            out.append((rule, r.seq, seen, mean, var, before, suggested, change, kind, threshold, status))
        yield pd.DataFrame(out, columns=[part.split()[0] for part in _REPLAY_SCHEMA.split(", ")])


def adapt_replay(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """Every step of a history (rule_id, seq, x): statistics, suggestion, change and threshold.

    A threshold depends on the one before, so a rule's steps are sequential; they run in
    rounds of 4096 batches, all rules in parallel, with the state handed from round to round.
    """
    start = rules.select("rule_id", "rule_type", "adaptive", F.col("threshold").alias("threshold0"),
                         F.col("status").alias("status0"))
    pieces = obs.withColumn("piece", F.shiftright("seq", REPLAY_BITS))
    rounds = [r.piece for r in pieces.select("piece").distinct().orderBy("piece").collect()]
    state, done = None, []
    for piece in rounds:
        now = pieces.filter(F.col("piece") == piece).drop("piece").join(start, "rule_id")
        if state is None:
            now = now.withColumns({"n0": F.lit(None).cast("long"), "mean0": F.lit(None).cast("double"),
                                   "var0": F.lit(None).cast("double")})
        else:
            now = (now.join(state, "rule_id", "left")
                   .withColumn("threshold0", F.coalesce("last_threshold", "threshold0"))
                   .withColumn("status0", F.coalesce("last_status", "status0"))
                   .drop("last_threshold", "last_status"))
        steps = (now.repartition("rule_id").sortWithinPartitions("rule_id", "seq")
                 .mapInPandas(_replay_rows, _REPLAY_SCHEMA))
        if len(rounds) > 1:
            steps = cut_lineage(steps)
            last = steps.groupBy("rule_id").agg(F.max_by(F.struct(
                F.col("n").alias("n0"), F.col("mean").alias("mean0"), F.col("var").alias("var0"),
                F.col("threshold").alias("last_threshold"), F.col("status").alias("last_status")), "seq"
            ).alias("s")).select("rule_id", "s.*")
            state = last if state is None else cut_lineage(
                last.unionByName(state.join(last, "rule_id", "left_anti")))
        done.append(steps)
    if not done:
        return obs.sparkSession.createDataFrame([], _REPLAY_SCHEMA)
    out = done[0]
    for steps in done[1:]:
        out = out.unionByName(steps)
    return out


def recent_history(history: DataFrame, last: int = 5) -> DataFrame:
    """The last changes of each rule, oldest first (`position` 1..5)."""
    newest = Window.partitionBy("rule_id").orderBy(F.col("changed_at").desc())
    kept = history.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= last)
    oldest = Window.partitionBy("rule_id").orderBy("changed_at")
    return kept.withColumn("position", F.row_number().over(oldest)).drop("age")
