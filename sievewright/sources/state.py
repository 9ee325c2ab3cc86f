"""Append-only state logs on Parquet.

Each append goes to a folder of its own epoch and replaces what an earlier attempt of that
epoch left there, so a replayed micro-batch writes nothing twice. The epochs of a batch are named
by its table, its id and what delivers it; a batch counts once its commit is written. One writer
at a time.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators.knowledge import latest
from .base import hadoop_path, path_exists

_SEQ = T.StructField("seq", T.LongType())


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    have = {f.name for f in schema.fields}
    return T.StructType([f for f in fields if f.name not in have] + schema.fields)


LOGS = {
    "rule_events": S.RULE_EVENTS,
    "threshold_history": S.THRESHOLD_HISTORY,
    "check_results": S.CHECK_RESULTS,
    "gate_results": S._struct(("table_fq_name", T.StringType()), ("batch_id", T.StringType()),
                              ("decision", T.StringType()), ("reasons", T.ArrayType(T.StringType())),
                              ("quarantined_rows", T.LongType())),
    "knowledge_docs": _with(S.KNOWLEDGE_DOCS, _SEQ, T.StructField("deleted", T.BooleanType())),
    "tickets": _with(S.TICKETS, _SEQ),
    "ewma_state": S.EWMA_STATE,
    "outbox": S._struct(("ticket_id", T.StringType()), ("payload", T.StringType())),
    "commits": S._struct(("table_fq_name", T.StringType()), ("batch_id", T.StringType()),
                         ("seq", T.LongType()), ("row_count", T.LongType()), ("key", T.StringType())),
}
BATCH = "batch-"
MERGED = "merged-"


def batch_key(table: str, batch_id: str, writer: str = "") -> str:
    """Name of the epochs of a batch: readable, and distinct by table, batch and writer."""
    digest = hashlib.sha256("\0".join((table, batch_id, writer)).encode()).hexdigest()[:20]
    return f"{BATCH}{re.sub('[^A-Za-z0-9_]+', '_', batch_id)[:40]}-{digest}"


class StateStore:
    """The logs of one deployment below one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, log: str) -> str:
        return f"{self.root}/{log}"

    def append(self, log: str, rows: DataFrame, epoch: str, count: int | None = None) -> None:
        """Write the rows of an epoch; `count=0` says that there are none."""
        if count == 0 and not path_exists(self.spark, f"{self.path(log)}/epoch={epoch}"):
            return
        schema = LOGS[log]
        have = set(rows.columns)
        shaped = rows.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                               for f in schema.fields])
        shaped.write.mode("overwrite").parquet(f"{self.path(log)}/epoch={epoch}")

    def read(self, log: str, before: str | None = None) -> DataFrame:
        """All rows of a log; `before` leaves out an epoch that is being written."""
        return self._rows(log, lambda epoch: epoch != before)

    def _rows(self, log: str, wanted) -> DataFrame:
        schema = LOGS[log]
        shown = [e for e in self._visible(log) if wanted(e)]
        if not shown:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path(log)}/epoch={e}" for e in shown]
        return self.spark.read.schema(schema).parquet(*paths)

    def _names(self, path: str) -> list[str]:
        fs, root = hadoop_path(self.spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []

    def _visible(self, log: str) -> list[str]:
        """Epochs that count: those that no published merge replaces, and published merges."""
        epochs = [n.removeprefix("epoch=") for n in self._names(self.path(log)) if n.startswith("epoch=")]
        published = self._published(log)
        replaced = {e for old in published.values() for e in old}
        return [e for e in epochs if e not in replaced and (not e.startswith(MERGED) or e in published)]

    def _published(self, log: str) -> dict[str, list[str]]:
        """Merges whose list of replaced epochs is in place; its appearance is what publishes a merge."""
        folder = f"{self.path(log)}/_replaced"
        lists = [n for n in self._names(folder) if n.startswith(MERGED)]
        return {n: [r.value for r in self.spark.read.text(f"{folder}/{n}").collect()] for n in lists}

    def committed(self, table: str, batch_id: str, writer: str = "") -> bool:
        key = batch_key(table, batch_id, writer)
        return self.read("commits").filter(F.col("key") == key).limit(1).count() > 0

    def compact(self, log: str) -> int:
        """Rewrite the finished epochs of a log as one, between batches; returns how many there were.

        Epochs of batches without a commit stay apart, as a replay will replace them. The merged rows are written
        first; then one rename publishes the list of what they replace, and from then on readers take the merge
        and skip those; then the old epochs go. A stop at any point loses and doubles nothing: what is unpublished
        is ignored, and what is left over is deleted by the next call.
        """
        self._sweep(log)
        epochs = self._visible(log)
        done = {r.key for r in self._keys_of(epochs).collect()} if log != "commits" else set(epochs)
        finished = [e for e in epochs if e in done or (not e.startswith(BATCH) and path_exists(
            self.spark, f"{self.path(log)}/epoch={e}/_SUCCESS"))]
        if len(finished) > 1:
            name = f"{MERGED}{uuid.uuid4().hex[:12]}"
            keep = set(finished)
            self._rows(log, keep.__contains__).write.parquet(f"{self.path(log)}/epoch={name}")
            self._publish(log, name, finished)
            self._sweep(log)
        return len(epochs)

    def _keys_of(self, epochs: list[str]) -> DataFrame:
        """Which of the epochs belong to committed batches."""
        mine = self.spark.createDataFrame([(e,) for e in epochs], "key string")
        return mine.join(self.read("commits").select("key"), "key", "left_semi")

    def _publish(self, log: str, name: str, replaced: list[str]) -> None:
        hidden = f"{self.path(log)}/_replaced/.{name}"
        self.spark.createDataFrame([(e,) for e in replaced], "value string").coalesce(1).write.text(hidden)
        fs, old = hadoop_path(self.spark, hidden)
        fs.rename(old, hadoop_path(self.spark, f"{self.path(log)}/_replaced/{name}")[1])

    def _sweep(self, log: str) -> None:
        """Delete epochs that a published merge replaces, unpublished merges, and lists whose merge is gone."""
        published = self._published(log)
        replaced = {e for old in published.values() for e in old}
        there = [n.removeprefix("epoch=") for n in self._names(self.path(log)) if n.startswith("epoch=")]
        for epoch in there:
            if epoch in replaced or (epoch.startswith(MERGED) and epoch not in published):
                fs, old = hadoop_path(self.spark, f"{self.path(log)}/epoch={epoch}")
                fs.delete(old, True)
        for name in published:
            if name in replaced:
                fs, old = hadoop_path(self.spark, f"{self.path(log)}/_replaced/{name}")
                fs.delete(old, True)

    def next_seq(self, table: str) -> int:
        last = self.read("commits").filter(F.col("table_fq_name") == table).agg(F.max("seq")).first()[0]
        return 0 if last is None else last + 1

    # -- current views ---------------------------------------------------
    def rules(self, before: str | None = None) -> DataFrame:
        from ..operators.rules import current_rules
        return current_rules(self.read("rule_events", before))

    def tickets(self, before: str | None = None) -> DataFrame:
        return latest(self.read("tickets", before), "ticket_id").drop("seq")

    def docs(self) -> DataFrame:
        from ..operators.knowledge import current_docs
        return current_docs(self.read("knowledge_docs"))

    def ewma(self, before: str | None = None) -> DataFrame:
        return latest(self.read("ewma_state", before), "rule_id", "last_seq").select(
            *[f.name for f in S.EWMA_STATE.fields])
