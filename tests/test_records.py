"""CSV records with line breaks in fields, put together from splits: equal to the reader that takes files whole."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from casework.sources import records
from casework.sources.tables import read_cases, read_cohort_folder


def write(path, rows, end="\n", last=True, stray=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)
        if stray:
            f.write(stray)
    if not last:
        with open(path, "rb+") as f:
            f.seek(-len(end), os.SEEK_END)
            f.truncate()


def table(n, seed):
    r = random.Random(seed)
    words = ["plain", "two\nlines", 'a "quoted" word', "comma, here", "\n", "é\n\n\"x\"\n", "", "tail\n", "NA", "long " * 200, "1.5", " lead"]
    return [["a", "b c", "d"]] + [[str(i), r.choice(words), r.choice(words)] for i in range(n)]


@pytest.fixture
def splits(spark):
    """Splits of a few hundred bytes."""
    conf = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end, last", [("\n", True), ("\r\n", True), ("\n", False)])
def test_split_reading_equals_whole_reading(spark, tmp_path, splits, end, last):
    rows = table(160, len(end))
    path = str(tmp_path / "one file.csv")
    write(path, rows, end, last)
    assert records.lines_of(spark, path).select("block").distinct().count() > 5
    assert records.records_of(records.lines_of(spark, path)).count() == 161
    whole, split = read_cases(spark, path, split=False), read_cases(spark, path, split=True)
    assert split.columns == whole.columns == ["a", "b c", "d", "row_id"]
    fields = [F.col(f"`{c}`") for c in ("a", "b c", "d")]
    a, b = ([tuple(r) for r in x.orderBy("row_id").select(*fields).collect()] for x in (whole, split))
    assert a == b and [r[0] for r in b] == [r[0] for r in rows[1:]]
    assert any("\n" in (r[1] or "") for r in b)


def test_a_field_longer_than_several_splits(spark, tmp_path, splits):
    path = str(tmp_path / "x.csv")
    write(path, [["a", "b"], ["1", "line\n" * 400], ["2", "y"], ["3", "\n" * 900], ["4", 'q"' * 300]])
    assert records.records_of(records.lines_of(spark, path)).count() == 5
    got = read_cases(spark, path, split=True).orderBy("row_id").collect()
    assert [(r.a, r.b) for r in got] == [("1", "line\n" * 400), ("2", "y"), ("3", "\n" * 900), ("4", 'q"' * 300)]


def test_stray_quotes_send_the_file_to_the_whole_reader(spark, tmp_path, splits):
    path = str(tmp_path / "x.csv")
    write(path, table(50, 3), stray='51,5" nail,x\n52,ok,y\n')
    assert records.records_of(records.lines_of(spark, path)) is None
    got = read_cases(spark, path, split=True)
    assert got.count() == 52 and got.filter("a = '51'").first()["b c"] == '5" nail'


def test_folder_rows_follow_file_names_and_places(spark, tmp_path, splits):
    want = []
    for name in ("b.csv", "a one.csv", "sub/c.csv", "a.csv"):
        write(str(tmp_path / name), table(30, len(name)))
    for name in ("a one", "a", "b", "c"):  # by name: a space sorts ahead of a dot
        want += [(name, str(i)) for i in range(30)]
    got = read_cohort_folder(spark, str(tmp_path)).orderBy("row_id").select("dataset", "a").collect()
    assert [tuple(r) for r in got] == want
    ids = [r.row_id for r in read_cases(spark, str(tmp_path / "*.csv")).orderBy("row_id").collect()]
    assert len(set(ids)) == 90


def test_parquet_ids_follow_files_and_rows(spark, tmp_path):
    for i, name in enumerate(("z", "y")):
        spark.range(5).select((F.col("id") + 10 * i).alias("v")).coalesce(1).write.parquet(str(tmp_path / name))
    import glob
    import shutil
    os.makedirs(tmp_path / "all")
    for name in ("z", "y"):
        shutil.copy(glob.glob(str(tmp_path / name / "part*"))[0], tmp_path / "all" / f"{name}.parquet")
    got = read_cases(spark, str(tmp_path / "all"), fmt="parquet").orderBy("row_id").collect()
    assert [r.v for r in got] == [10, 11, 12, 13, 14, 0, 1, 2, 3, 4]


def test_header_only_and_empty_files(spark, tmp_path):
    write(str(tmp_path / "h.csv"), [["a", "b"]])
    assert read_cases(spark, str(tmp_path / "h.csv"), split=True).count() == 0
