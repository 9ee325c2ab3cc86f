"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import logging
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
T = TypeVar("T")
_SCRATCH: list[str] = []


def build_session(master: str | None = None, app: str = "sievewright", **conf) -> SparkSession:
    """A session with the settings the operators expect; `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # Rows with long texts or vectors must not add up to huge batches for Python.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        # Call-site capture for every column costs more than building the column.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for local masters."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    current = spark.sparkContext.getCheckpointDir()
    if not root and current:
        root = current
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-")
    if not current:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder; see `clean_scratch`."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.unregister(_clean_at_exit)
        atexit.register(_clean_at_exit)
    _SCRATCH.append(path)
    return path


def clean_scratch(spark: SparkSession) -> None:
    """Delete every folder that `scratch_path` has named in this session; frames that read them end with it."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


def _clean_at_exit() -> None:
    """What a program leaves behind goes when it ends, if its session still runs."""
    spark = SparkSession.getActiveSession() if _SCRATCH else None
    if spark is not None:
        with contextlib.suppress(Exception):
            clean_scratch(spark)


def best_effort(read: Callable[[], T], otherwise: T, what: str) -> T:
    """The result of a read that may fail for want of a driver, a server or rights; failures are logged."""
    try:
        return read()
    except (PySparkException, Py4JError, ValueError) as exc:
        logging.getLogger(__name__).warning("%s: %s", what, str(exc).strip().splitlines()[0] if str(exc).strip() else exc)
        return otherwise


def cut_lineage(df):
    """Write a frame to the shared folder and go on from there; survives lost executors.

    A written table keeps its size known, so small ones are still broadcast.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_copy(df):
    """A frame of configuration size (rules of a table, results of one batch) as local rows."""
    rows = df.toArrow()
    return df.sparkSession.createDataFrame(rows, schema=df.schema), rows.num_rows
