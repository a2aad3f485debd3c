import csv
import io
import random

import pytest

from molquarry.sources.csv import read_csv
from molquarry.sources.csv_ranges import count_records, read_csv_ranges, survey


def written(path, rows, end="\r\n", mark=""):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["smiles", "name", "note"])
    writer.writerows(rows)
    path.write_bytes((mark + out.getvalue()).encode())


@pytest.fixture
def cut(spark):
    """Ranges of a few bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[1], "0")
    yield lambda size: spark.conf.set(names[0], str(size))
    for n, v in old.items():
        spark.conf.set(n, v)


def odd(rng, n):
    text = lambda: "".join(rng.choice(["a", "é", " ", ",", '"', "\n", "\r\n", "C1", "日"]) for _ in range(rng.randint(0, 12)))
    return [(f"C{k}", text(), text()) for k in range(n)]


@pytest.mark.parametrize(("size", "end", "mark"), [(64, "\n", ""), (200, "\r\n", "﻿"), (1000, "\n", ""), (10**6, "\r\n", "")])
def test_line_ends_in_fields_over_many_ranges(spark, tmp_path, cut, size, end, mark):
    rows = odd(random.Random(size), 400)
    written(tmp_path / "in.csv", rows, end, mark)
    cut(size)
    path = str(tmp_path / "in.csv")
    got = read_csv_ranges(spark, path)
    assert got.columns == ["smiles", "name", "note"]
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert count_records(spark, path) == len(rows)
    ranges = survey(spark, path)
    assert ranges.count() > 8 or size > 1000


def test_the_same_rows_as_one_task(spark, tmp_path, cut):
    rows = [(f"C{k}", "line\none" if k % 3 else "plain", 'say "x", y') for k in range(500)]
    written(tmp_path / "in.csv", rows, "\n")
    cut(300)
    path = str(tmp_path / "in.csv")
    assert sorted(map(tuple, read_csv(spark, path).collect())) == sorted(map(tuple, read_csv_ranges(spark, path).collect())) == sorted(rows)
    assert spark.read.text(path).rdd.getNumPartitions() > 8


def test_a_record_over_many_ranges(spark, tmp_path, cut):
    rows = [("C", "short", "x"), ("CC", "line\n" * 300, "y"), ("CCC", "\n\n", "z"), ("N", "line\r\n" * 100, "")]
    written(tmp_path / "in.csv", rows, "\n")
    cut(50)
    assert sorted(map(tuple, read_csv_ranges(spark, str(tmp_path / "in.csv")).collect())) == sorted(rows)


def test_several_files_headers_and_blank_lines(spark, tmp_path, cut):
    cut(40)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text('smiles,name\n\nCCO,"a\nb"\n\r\nCCN,x\n\n')
    (tmp_path / "t" / "b.csv").write_text("smiles,name\nC,last")
    (tmp_path / "t" / "c.csv").write_text("smiles,name\n")
    (tmp_path / "t" / "d.csv").write_text("")
    path = str(tmp_path / "t")
    got = read_csv_ranges(spark, path, at="place")
    assert sorted((r["smiles"], r["name"]) for r in got.collect()) == [("C", "last"), ("CCN", "x"), ("CCO", "a\nb")]
    assert count_records(spark, path) == 3 and got.select("place.file").distinct().count() == 2
    assert read_csv_ranges(spark, str(tmp_path / "t" / "d.csv")).count() == 0
    (tmp_path / "tab.csv").write_text('s\tn\nC\t"x\ty"\nN\n')
    assert sorted(map(tuple, read_csv_ranges(spark, str(tmp_path / "tab.csv"), "\t").collect())) == [("C", "x\ty"), ("N", "")]
