"""CSV files with quoted line feeds, read in splits of any size."""

import csv
import random

import pytest

from tabwright.sources import quoted
from tabwright.sources.tables import CSV, read_table


@pytest.fixture
def split_size(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(k) for k in keys]

    def put(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")

    yield put
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def cells(seed, n):
    rng = random.Random(seed)
    signs = ["a", "b", " ", '"', ",", "\n", "\r\n", "é", '""', "x" * 20]
    return [[str(i), *("".join(rng.choices(signs, k=rng.choice([0, 1, 3, 8, 30]))) for _ in range(2))] for i in range(n)]


def written(path, rows, end="\n", header=("id", "b c", "d")):
    with open(path, "w", newline="") as f:
        writer = csv.writer(f, lineterminator=end)
        writer.writerow(header)
        writer.writerows(rows)
    return str(path)


@pytest.mark.parametrize("size", [120, 1 << 27])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_are_whole_at_any_split(spark, tmp_path, split_size, size, end):
    rows = cells(size, 300)
    path = written(tmp_path / "t.csv", rows, end)
    split_size(size)
    assert size > 1000 or quoted.text_lines(spark, path).rdd.getNumPartitions() > 10
    df = quoted.parsed(quoted.quoted_records(spark, path), ["id", "b c", "d"], CSV)
    assert sorted(tuple(r) for r in df.collect()) == sorted((i, a, b) if a and b else (i, a or None, b or None) for i, a, b in rows)


def test_one_value_over_many_splits(spark, tmp_path, split_size):
    long = "\n".join(f'line {k}, with "quotes" and ""' for k in range(500))
    path = written(tmp_path / "t.csv", [["1", "a", long], ["2", "b", "c"], ["3", long, "d\n"]])
    split_size(100)
    df = read_table(spark, path)
    assert {r.id: (r["b c"], r.d) for r in df.collect()} == {1: ("a", long), 2: ("b", "c"), 3: (long, "d\n")}
    assert dict(df.dtypes)["id"] == "bigint"


def test_header_over_lines_blank_lines_and_several_files(spark, tmp_path, split_size):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k in range(3):
        written(folder / f"{k}.csv", [[str(k), "x\ny", "z"]], header=("id", "two\nlines", "d"))
        with open(folder / f"{k}.csv", "a") as f:
            f.write("\n   \n9,u,v\n")
    split_size(15)
    df = read_table(spark, str(folder))
    assert df.columns == ["id", "two\nlines", "d"]
    assert sorted(tuple(r) for r in df.collect()) == [(0, "x\ny", "z"), (1, "x\ny", "z"), (2, "x\ny", "z"), *[(9, "u", "v")] * 3]


def test_quotes_inside_plain_values_are_text(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('size,note\n5" pipe,plain\n6" pipe,"two\nlines"\n7" pipe,x\n')
    rows = read_table(spark, str(path)).collect()
    assert [(r["size"], r.note) for r in sorted(rows, key=lambda r: r["size"])] == [('5" pipe', "plain"), ('6" pipe', "two\nlines"), ('7" pipe', "x")]


def test_files_without_quoted_line_feeds_go_to_the_plain_reader(spark, tmp_path):
    path = written(tmp_path / "t.csv", [["1", 'say "hi"', "a,b"], ["2", "", "x"]])
    assert quoted.quoted_records(spark, path) is None
    assert sorted(tuple(r) for r in read_table(spark, path).collect()) == [(1, 'say "hi"', "a,b"), (2, None, "x")]


def test_repeated_names_and_ragged_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,a,b\n"x\n",2\n3,4,5,6\n')
    df = read_table(spark, str(path))
    assert df.columns == ["a0", "a1", "b"]
    assert sorted(tuple(map(str, r)) for r in df.collect()) == [("3", "4", "5"), ("x\n", "2", "None")]


@pytest.mark.parametrize(("line", "outside", "inside"), [
    (b"a,b", False, True), (b'"a', True, False), (b'a"', False, False), (b'a,"b', True, False), (b'"a""', True, False),
    (b'"a",b', False, False), (b'"a","b', True, True), (b'x",y', False, False), (b'x","y', True, True), (b'""', False, True), (b'"""', True, False), (b"", False, True),
])
def test_states(line, outside, inside):
    assert (quoted.ends_inside(line, False), quoted.ends_inside(line, True)) == (outside, inside)
