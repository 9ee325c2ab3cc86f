"""Delimited files in many splits against one split and Python's own reader."""

import csv
import io
import random

import pytest

from sievewright.sources import FileSource
from sievewright.sources.records import line_rule, records


@pytest.fixture()
def split(spark):
    """Splits of a given number of bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def to(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")
    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def some_rows(n, sep, seed=5):
    r = random.Random(seed)
    parts = ["a", "bc", " ", '"', '""', "\n", "\n\n", sep, "é", "日本", "x" * 30, "5'", "'", ";"]
    text = lambda: "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
    return [[str(i), text(), "end" + text(), "k"] for i in range(n)]


def written(rows, sep, end="\n"):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator=end).writerows([["id", "note", "b c", "last"], *rows])
    return out.getvalue()


def test_rule():
    rule = line_rule(",")
    for line, outside, inside in (
            ("a,b", False, True), ('a,"b', True, False), ('"a""', True, False), ('"a"",b', True, False), ('"a",b', False, False),
            ('5" pipe,3', False, False), ('a"b"c', False, False), ('"', True, False), ('""', False, True), ('"""', True, False),
            ('x"",y', False, True), ('x",y', False, False), ('x","y', True, True), ('x","y"', False, False), ("", False, True)):
        assert (rule(line, False), rule(line, True)) == (outside, inside), line


@pytest.mark.parametrize("sep, suffix, size", [(",", ".csv", 40), (",", ".csv", 333), ("\t", ".tsv", 64), (",", ".csv", 5000)])
def test_many_splits_equal_one(spark, split, tmp_path, sep, suffix, size):
    rows = some_rows(300, sep)
    path = tmp_path / f"t{suffix}"
    path.write_text(written(rows, sep))
    read = lambda: sorted(FileSource(spark, "f", str(path)).table().collect(), key=lambda r: r.id)
    whole = read()
    assert len(whole) == 300
    split(size)
    table = FileSource(spark, "f", str(path)).table()
    assert read() == whole and table.columns == ["id", "note", "b c", "last"]
    assert records(spark, str(path), sep).where("text <> ''").count() == 301


def test_windows_line_ends_and_stray_quotes(spark, split, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b'id,note\r\n1,"two\r\nlines"\r\n2,5" pipe\r\n3,\r\n\r\n4,"a ""quoted"" word"\r\n5,last')
    want = [(1, "two\nlines"), (2, '5" pipe'), (3, None), (4, 'a "quoted" word'), (5, "last")]
    for size in (10**6, 9, 25):
        split(size)
        assert sorted(tuple(r) for r in FileSource(spark, "f", str(path)).table().collect()) == want


def test_records_over_many_blocks_and_several_files(spark, split, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    long = "line\n" * 200 + "end"
    (folder / "a.csv").write_text(written([["1", long, "x", "k"], ["2", "b", "", "k"]], ","))
    (folder / "b.csv").write_text(written([["3", "c", "y\nz", "k"]], ",") + '4,"never closed\n5,x,y,k\n')
    split(50)
    got = {r.id: r.note for r in FileSource(spark, "f", str(folder)).table().collect()}
    assert got[1] == long and got[2] == "b" and got[3] == "c" and len(got) == 4


def test_many_tasks_read_one_file(spark, split, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(written(some_rows(400, ","), ","))
    split(1000)
    found = records(spark, str(path), ",")
    assert found.select("block").distinct().count() > 5
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
