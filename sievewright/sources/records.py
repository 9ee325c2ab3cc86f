"""Records of delimited files that may hold quoted line breaks, read by many tasks.

A task that starts in the middle of a file cannot tell whether it starts inside quotes. So each block of a file is read for
both cases first: which state its lines lead to from either one. These steps, one row a block, are put together in order,
which gives the true state at the start of every block; then all blocks are cut into records at once. Only the pieces
of records that cross a border, two a block at most, are moved.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = ["file", "block", "value"]
PIECES = "file string, block long, at long, kind string, text string"


@functools.lru_cache
def line_rule(sep: str) -> Callable[[str, bool], bool]:
    """Whether a line ends inside quotes, by whether it starts inside: `rule(line, inside)`.

    A field is quoted if a quote is its first character; quotes are doubled in it. Others are plain characters.
    """
    s = re.escape(sep)
    closing = re.compile('(?:[^"]|"")*+"')
    plain = re.compile(f'(?:(?:"(?:[^"]|"")*+"[^{s}]*+|[^"{s}][^{s}]*+|)(?:{s}|\\Z))*+')
    rest = re.compile(f"[^{s}]*+(?:{s}|\\Z)")

    def rule(line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        start = 0
        if inside:
            end = closing.match(line)
            if end is None:
                return True
            start = rest.match(line, end.end()).end()
        return start < len(line) and plain.match(line, start).end() < len(line)
    return rule


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of each block of each file, in order within the block."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """Runs of lines of the same block, batch by batch."""
    for batch in batches:
        files, blocks, values = (batch.column(c).to_pylist() for c in LINE)
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or blocks[i] != blocks[start] or files[i] != files[start]:
                yield (files[start], blocks[start]), values[start:i]
                start = i


def _steps(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, now, ends = line_rule(sep), None, [False, True]

        def row():
            return pa.RecordBatch.from_pydict({"file": [now[0]], "block": pa.array([now[1]], pa.int64()),
                                               "outside": [ends[0]], "inside": [ends[1]]})
        for key, lines in _blocks(batches):
            if key != now:
                if now is not None:
                    yield row()
                now, ends = key, [False, True]
            for line in lines:
                if '"' in line:
                    ends = [rule(line, e) for e in ends]
        if now is not None:
            yield row()
    return run


def block_starts(lines: DataFrame, sep: str) -> DataFrame:
    """(file, block, starts): whether each block starts inside quotes; one row a block."""
    steps = lines.mapInArrow(_steps(sep), "file string, block long, outside boolean, inside boolean")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # The state after the earlier blocks: their steps applied one after the other.
    earlier = F.coalesce(F.collect_list(F.struct("outside", "inside")).over(before), F.array())
    state = F.aggregate(earlier, F.lit(False), lambda s, x: F.when(s, x["inside"]).otherwise(x["outside"]))
    return steps.select("file", "block", state.alias("starts"))


def _pieces(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, now, at, inside, open_lines, kind = line_rule(sep), None, 0, False, [], "whole"

        def batch(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                               pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
                                              names=["file", "block", "at", "kind", "text"])
        for source in batches:
            rows = []
            starts = source.column("starts").to_pylist()
            place = 0
            for key, lines in _blocks([source]):
                if key != now:
                    if open_lines:
                        rows.append((*now, at, "tail" if kind == "tail" else "head", "\n".join(open_lines)))
                    now, at, inside, open_lines = key, 0, starts[place], []
                    kind = "tail" if inside else "whole"
                place += len(lines)
                for line in lines:
                    inside = rule(line, inside)
                    open_lines.append(line)
                    if not inside:
                        rows.append((*now, at, "end" if kind == "tail" else "whole", "\n".join(open_lines)))
                        at, open_lines, kind = at + 1, [], "whole"
            if rows:
                yield batch(rows)
        if open_lines:
            yield batch([(*now, at, "tail" if kind == "tail" else "head", "\n".join(open_lines))])
    return run


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, block, at, text): every record of the files below a path, with its line breaks.

    A record belongs to the block it starts in, as number `at`; one that never closes its quotes goes up to the end of its
    file. Line ends within a record become single line feeds. Empty records are kept.
    """
    lines = text_lines(spark, path)
    starts = block_starts(lines, sep).withColumnsRenamed({"file": "f", "block": "b"})
    # One row a block of the files.
    pieces = (lines.join(F.broadcast(starts), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
              .select(*LINE, "starts").mapInArrow(_pieces(sep), PIECES))
    whole = pieces.where("kind = 'whole'").select("file", "block", "at", "text")
    # A head, any blocks that lie wholly within its record, and the end of it: two pieces a block.
    order = Window.partitionBy("file").orderBy("block", "at")
    crossing = pieces.where("kind <> 'whole'").withColumn("record", F.count_if(F.col("kind") == "head").over(order))
    joined = crossing.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("parts")).select(
        "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["at"].alias("at"),
        F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))
    clean = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r$", "")
    return whole.unionByName(joined).select("file", "block", "at", clean.alias("text"))
