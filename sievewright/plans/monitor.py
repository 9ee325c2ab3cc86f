"""Scan, propose, run and report: the operators put together over one state store."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window, functions as F

from ..operators import adapt, gate as G, incidents as I, knowledge as K, rules as R, suggest as P
from ..operators.checks import run_and_count
from ..operators.profile import candidate_grain, profile_table
from ..schemas import CHECK_RESULTS, rules_from_rows
from ..session import cut_lineage, local_copy
from ..sources.base import Source
from ..sources.quarantine import write_quarantine
from ..sources.state import LOGS, StateStore, batch_key
from ..streaming.stream import run_micro_batches

Answerer = Callable[[DataFrame], DataFrame]


@dataclass
class BatchReport:
    """What one batch led to, or a micro-batch of many; the frames are small and already computed.

    For many batches `decision` is the gravest, `gate` has that of each.
    """

    table_fq_name: str
    batch_id: str
    row_count: int
    decision: str
    results: DataFrame
    gate: DataFrame
    tickets: DataFrame
    threshold_changes: DataFrame
    quarantined_rows: int = 0


def _written_copy(df: DataFrame) -> tuple[DataFrame, int]:
    """As `local_copy`, for frames that grow with the number of batches: they stay in the shared folder."""
    kept = cut_lineage(df)
    return kept, kept.count()


class Monitor:
    def __init__(self, source: Source, store: StateStore, quarantine_root: str,
                 answer: Answerer = P.canned_responses, error_blocks: bool = False,
                 never_tighten: bool = False, clock: Callable[[], float] = time.time):
        self.source, self.store, self.quarantine_root = source, store, quarantine_root
        self.answer, self.error_blocks, self.never_tighten = answer, error_blocks, never_tighten
        self.clock = clock

    def _epoch(self, kind: str) -> str:
        return f"{kind}_{int(self.clock() * 1e6)}"

    def _seq(self) -> int:
        """Log position of user actions and batches alike."""
        return int(self.clock() * 1e6)

    # -- knowledge -------------------------------------------------------
    def add_knowledge(self, docs: DataFrame) -> None:
        rows = docs.withColumns({"seq": F.lit(self._seq()), "deleted": F.lit(False)})
        self.store.append("knowledge_docs", rows, self._epoch("docs"))

    def delete_knowledge(self, doc_ids: DataFrame) -> None:
        rows = doc_ids.select("doc_id").withColumns({"seq": F.lit(self._seq()), "deleted": F.lit(True)})
        self.store.append("knowledge_docs", rows, self._epoch("docs"))

    # -- scan and propose ------------------------------------------------
    def scan_table(self, table: str, sample_rows: int | None = None,
                   order_by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(metadata, profile); the profile covers the whole table unless `sample_rows` is given."""
        df = self.source.table(table)
        return self.source.metadata(table), profile_table(df, self.source.fq_name(table), sample_rows, order_by)

    def propose_rules(self, table: str, sample_rows: int | None = None) -> DataFrame:
        """Proposals now in the store; rules proposed before are not stored again."""
        _, profile = self.scan_table(table, sample_rows)
        profile = cut_lineage(profile)
        prompts = P.suggestion_prompts(profile, self.store.docs(), P.baseline_rules(profile))
        responses = self.answer(prompts).withColumnRenamed("id", "table_fq_name")
        rules = P.as_rules(P.propose_rules(profile, responses), self.clock())
        events = R.add_events(rules, F.lit(self._seq()), self.store.rules())
        self.store.append("rule_events", cut_lineage(events), self._epoch("propose"))
        return self.pending_rules(table)

    def pending_rules(self, table: str) -> DataFrame:
        return R.pending_rules(self.store.rules(), self.source.fq_name(table))

    def add_rules(self, rules: DataFrame) -> None:
        events = R.add_events(rules, F.lit(self._seq()), self.store.rules())
        self.store.append("rule_events", events, self._epoch("add"))

    def set_status(self, rule_ids: DataFrame, status: str, strict: bool = False) -> None:
        """Approve, activate, reject or retire; unknown ids raise KeyError."""
        events = self.store.read("rule_events")
        changes = rule_ids.select("rule_id").withColumns(
            {"seq": F.lit(self._seq()), "new_status": F.lit(status), "at": F.lit(self.clock())})
        R.check_known(changes, events)
        if strict and R.invalid_transitions(changes, events).limit(1).count():
            raise ValueError(f"a rule cannot become '{status}' from its present status")
        self.store.append("rule_events", R.status_events(changes), self._epoch(status))

    def activate_approved(self, table: str) -> None:
        events = R.activate_approved(self.store.rules(), self.source.fq_name(table),
                                     F.lit(self._seq()), self.clock())
        self.store.append("rule_events", events, self._epoch("activate"))

    # -- run -------------------------------------------------------------
    def run_batch(self, table: str, where: str | None = None, batch_id: str | None = None) -> BatchReport:
        return self.run_dataframe(table, self.source.batch(table, where), batch_id)

    def run_dataframe(self, table: str, df: DataFrame, batch_id: str | None = None) -> BatchReport:
        fq = self.source.fq_name(table)
        batch_id = batch_id or self._epoch("batch")
        return self._process(fq, df, batch_id, batch_key(fq, batch_id), self.store)

    def run_stream(self, table: str, stream: DataFrame, checkpoint: str, query: str = "stream",
                   max_batches: int | None = None,
                   on_report: Callable[[BatchReport], None] | None = None, batch_col: str | None = None) -> int:
        """The same step on every micro-batch; rules are read anew each time. Returns the micro-batches processed.

        With `batch_col` each value of that column is a batch of its own, with its own results, decision, quarantine folder
        and commit, however many of them a micro-batch holds; thresholds move once a micro-batch, after all its batches.

        A batch is known by its table, its id and the id that Spark keeps in the checkpoint: another stream, or the
        same one from a new checkpoint, is never taken for a replay. A replayed batch is not processed or counted.
        """
        fq = self.source.fq_name(table)

        def step(batch: DataFrame, epoch: int, stream_id: str) -> bool:
            batch_id = f"{query}_{epoch}"
            store = StateStore(batch.sparkSession, self.store.root)
            if store.committed(fq, batch_id, stream_id):
                return False
            # The checks pass over a micro-batch several times; the source is read once.
            kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                report = self._process(fq, kept, batch_id, batch_key(fq, batch_id, stream_id), store, batch_col)
            finally:
                kept.unpersist()
            if on_report:
                on_report(report)
            return True

        return run_micro_batches(stream, checkpoint, step, max_batches=max_batches)

    def _resolve(self, table: str) -> DataFrame:
        return self.source.table(table)

    def _process(self, table: str, df: DataFrame, batch_id: str, key: str, store: StateStore,
                 batch_col: str | None = None) -> BatchReport:
        """Check, adapt, gate, report. What the checks return is one row per rule, kept as local rows.

        `key` names the epochs of the batch in every log. With `batch_col` there are many batches, whose ids begin with
        `batch_id`; all have the same key, and what is one row per rule and batch is kept in the shared folder.
        """
        keep = _written_copy if batch_col else local_copy
        spark, now = df.sparkSession, self.clock()
        rules_now, _ = local_copy(store.rules(before=key).filter(
            (F.col("table_fq_name") == table) & (F.col("status") == "active")))
        rules = rules_from_rows(rules_now)
        seq, batches = store.next_seq(table), None
        if batch_col:
            df = df.withColumns({"batch_id": F.concat_ws("_", F.lit(batch_id), F.col(batch_col).cast("string")), "__at": F.col(batch_col)})
            found = df.groupBy("batch_id").agg(F.min("__at").alias("at"), F.count(F.lit(1)).alias("row_count"))
            # One row a batch.
            place = F.row_number().over(Window.orderBy("at", "batch_id")) - 1
            batches, df = cut_lineage(found.select("batch_id", (place + F.lit(seq)).cast("long").alias("seq"), "row_count")), df.drop("__at")
        if rules and batch_col:
            results, rows = run_and_count(df, rules, batch_col="batch_id", resolve=self._resolve)
            results = cut_lineage(results.drop("seq").join(batches.select("batch_id", "seq"), "batch_id").select(*results.columns))
            store.append("check_results", results, key)
        elif rules:
            results, rows = run_and_count(df, rules, batch_id=batch_id, seq=seq, resolve=self._resolve)
            store.append("check_results", results, key)
        else:
            results, rows = spark.createDataFrame([], CHECK_RESULTS), df.count()

        changes = self._adapt(store, results, rules_now, key, now)
        decisions, verdicts = keep(G.gate(results, self.error_blocks))
        if batch_col:
            seen = {r.decision for r in decisions.select("decision").distinct().collect()}
            decision = next((d for d in ("block", "pass_with_warnings") if d in seen), "pass")
        else:
            decision = decisions.first().decision if verdicts else "pass"
        held, held_rows = 0, F.lit(0)
        if decision == "block":
            blocked = G.held(df, decisions) if batch_col else df.withColumn("batch_id", F.lit(batch_id))
            held = write_quarantine(blocked, self.quarantine_root, table)
            held_rows = F.when(F.col("decision") == "block", F.col("row_count")).otherwise(0) if batch_col else F.lit(held)
        gates = decisions.join(batches.select("batch_id", "row_count"), "batch_id") if batch_col else decisions
        store.append("gate_results", gates.withColumn("quarantined_rows", held_rows), key, verdicts)

        tickets = self._tickets(store, results, key, now, keep)
        done = spark.createDataFrame([(table, batch_id, seq, rows, key)], LOGS["commits"])
        if batch_col and rows:
            done = batches.withColumns({"table_fq_name": F.lit(table), "key": F.lit(key)})
        store.append("commits", done, key)
        return BatchReport(table, batch_id, rows, decision, results, decisions, tickets, changes, held)

    def _adapt(self, store: StateStore, results: DataFrame, rules_now: DataFrame, key: str,
               now: float) -> DataFrame:
        """Record the batch in the statistics and log the threshold changes that follow."""
        checked = results.select("rule_id").distinct()
        before = store.ewma(before=key).join(F.broadcast(checked), "rule_id", "left_semi")
        state, tracked = local_copy(adapt.ewma_fold(adapt.observations(results), before))
        store.append("ewma_state", state, key, tracked)
        changes, moved = local_copy(adapt.threshold_changes(state, rules_now, now, self.never_tighten))
        store.append("threshold_history", changes, key, moved)
        store.append("rule_events", R.threshold_events(changes, F.lit(self._seq())), key, moved)
        return changes

    def _tickets(self, store: StateStore, results: DataFrame, key: str, now: float,
                 keep: Callable[[DataFrame], tuple[DataFrame, int]] = local_copy) -> DataFrame:
        """Open tickets of each batch's incident: a new one, or the one that already covers it."""
        problems, count = keep(results.filter(G.is_problem()))
        known = store.tickets(before=key)
        if not count:
            return known.limit(0)
        rca, _ = keep(P.explain_failures(
            I.worst_result(problems), store.docs(), adapt.recent_history(store.read("threshold_history")),
            self.answer))
        responses = self.answer(P.ticket_prompts(problems, rca))
        tables = I.tables_named(problems, ["table_fq_name", "batch_id"]).select(
            F.concat_ws("|", "table_fq_name", "batch_id").alias("id"), "tables")
        texts = P.draft_ticket_text(responses, tables)
        found, _ = keep(
            I.incidents(problems).withColumn("id", F.concat_ws("|", "table_fq_name", "batch_id"))
            .join(texts, "id").withColumn("created_at", F.lit(now)))
        fresh, opened = keep(I.create_tickets(found, known).withColumn("seq", F.lit(self._seq())))
        store.append("tickets", fresh, key, opened)
        store.append("outbox", I.webhook_payload(fresh), key, opened)
        return I.match_open(found.select("table_fq_name", "batch_id", "rule_ids"),
                            known.unionByName(fresh.drop("seq")))

    def resolve_tickets(self, ticket_ids: DataFrame) -> None:
        current = self.store.tickets()
        named = current.join(ticket_ids.select("ticket_id").distinct(), "ticket_id", "left_semi")
        rows = named.withColumns({"status": F.lit("resolved"), "seq": F.lit(self._seq())})
        self.store.append("tickets", rows, self._epoch("resolve"))

    def list_tickets(self, table: str | None = None) -> DataFrame:
        return I.list_tickets(self.store.tickets(), self.source.fq_name(table) if table else None)

    # -- report ----------------------------------------------------------
    def scan_report(self, table: str) -> DataFrame:
        metadata, profile = self.scan_table(table)
        return scan_report(metadata, profile, self.source.lineage(table))


def scan_report(metadata: DataFrame, profile: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One summary row per column; the grain and the lineage of the table stand in each."""
    facts = profile.select(F.col("column").alias("name"), "null_rate", "distinct_rate", "inferred_pattern",
                           "is_candidate_key")
    grain = candidate_grain(profile).select(F.array_join("candidate_grain", ", ").alias("candidate_grain"))
    edge = F.concat("upstream", F.lit(" -> "), "downstream")
    lines = (edges.agg(F.array_join(F.array_sort(F.collect_set(edge)), "; ").alias("lineage")) if edges is not None
             else metadata.sparkSession.range(1).select(F.lit("").alias("lineage")))
    # Both sides are one row.
    return metadata.join(facts, "name").join(F.broadcast(grain)).join(F.broadcast(lines)).select(
        "position", "name", "data_type", "nullable", "is_primary_key", "null_rate", "distinct_rate",
        "inferred_pattern", "is_candidate_key", "row_count", "candidate_grain", "lineage")
