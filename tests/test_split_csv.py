"""CSV files read in blocks give the rows of files read whole."""

import csv
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snaptrail.sources import readers, split_csv

CELLS = ["plain", "two words", 'a "quoted" word', "line\nbreak", 'ends with "', '"', "a,b", "", "long " * 40, "\n\n", 'x\n"y"\n,z', "é漢", " padded "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(CELLS), min_size=2, max_size=3), max_size=5), st.booleans())
def test_states_of_lines(rows, quote_all):
    out = []
    for r in rows:
        cells = ['"' + c.replace('"', '""') + '"' if quote_all or any(x in c for x in ',"\n') or c.startswith(" ") else c for c in r]
        out.append(",".join(cells))
    inside, n = False, 0
    for record in out:
        lines = record.split("\n")
        for line in lines:
            inside = split_csv.ends_inside(line, inside)
            n += not inside
        assert not inside
    assert n == len(rows)


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_blocks_equal_whole_files(spark, tmp_path, small_blocks, newline):
    rng = random.Random(2)
    for name in ("a", "b"):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=newline)
            w.writerow(["A", "B", "C"])
            for i in range(150):
                w.writerow([f"{name}{i}", rng.choice(CELLS), rng.choice(CELLS)])
    (tmp_path / "giant.csv").write_text("A,B,C\n1,\"" + "one field over many blocks\n" * 80 + "\",z\n2,x,5\" pipe\n\n3,,\n4,too,many,cells\n5,few\n6,last,\"row\"")
    (tmp_path / "other.csv").write_text("A,X,C\n1,2,3\n")
    (tmp_path / "empty.csv").write_text("")
    lines = split_csv.lines_of(spark, str(tmp_path))
    assert lines.select("file", "block").distinct().count() > 20
    rows, problems = split_csv.read_csv_blocks(spark, str(tmp_path), ["a", "b", "c"], ["A", "B", "C"])
    whole, whole_problems = readers.read_csv_strict(spark, str(tmp_path), ["a", "b", "c"], ["A", "B", "C"])
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, whole.collect()))
    assert sorted(map(repr, problems.collect())) == sorted(map(repr, whole_problems.collect()))
    assert rows.count() == 304 and problems.count() == 2


def test_blocks_skip_lines(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("Title,,\n\n,note,\nA,B,C\n" + "".join(f'{i},"x\n{i}",y\n' for i in range(200)))
    rows, _ = split_csv.read_csv_blocks(spark, str(tmp_path / "a.csv"), ["a", "b", "c"], ["A", "B", "C"], skip_lines=2)
    assert sorted(int(r["a"]) for r in rows.collect()) == list(range(200))


@pytest.mark.parametrize("lead", [0, 3, 1000])
def test_headers_beyond_the_first_lines(spark, tmp_path, small_blocks, monkeypatch, lead):
    """Headers behind many blank rows, behind a record over many blocks, and in no row at all."""
    monkeypatch.setattr(split_csv, "LEAD", lead)
    (tmp_path / "a.csv").write_text("Title,,\n" + ",,\n\n" * 200 + "A,B,C\n" + "".join(f'{i},"x\n{i}",y\n' for i in range(50)))
    (tmp_path / "b.csv").write_text('"' + "a title of many lines\n" * 60 + '",,\nA,B,C\n' + "".join(f'{i},"""x\n",y\n' for i in range(50, 80)))
    (tmp_path / "c.csv").write_text("only a title,,\n")
    (tmp_path / "d.csv").write_text(",,\n\n")
    rows, problems = split_csv.read_csv_blocks(spark, str(tmp_path), ["a", "b", "c"], ["A", "B", "C"], skip_lines=1)
    assert sorted(int(r["a"]) for r in rows.collect()) == list(range(80))
    assert [(r["file"][-5:], r["problem"]) for r in problems.collect()] == [("c.csv", "HEADER_MISMATCH")]


def test_files_are_read_few_times(spark, tmp_path):
    """For the blocks' states, headers, records over edges, and rows: where it took six times."""
    path, sc = tmp_path / "a.csv", spark.sparkContext._jsc.sc()
    path.write_text("A,B,C\n" + "".join(f'{i},"two\nlines",""\n' for i in range(200_000)))
    told = []
    for run in (lambda: None, lambda: split_csv.read_csv_blocks(spark, str(path), ["a", "b", "c"], ["A", "B", "C"])[0].write.format("noop").mode("overwrite").save()):
        run()
        sc.listenerBus().waitUntilEmpty()
        told.append(sc.statusStore().executorList(True).head().totalInputBytes())
    assert path.stat().st_size < told[1] - told[0] < 4.6 * path.stat().st_size
