"""CSV with quoted line breaks, read in many splits, against one split for each file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from mailsift.sources import csv_files, csv_split


@pytest.fixture
def tiny_splits(spark):
    """Splits of some dozen bytes, so that records lie across many."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def written(rows, encoding="utf-8", end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue().encode(encoding)


def rows_of(seed, n=60):
    rng = random.Random(seed)
    bits = ["a", "한국어", "line\nbreak", 'quote"d', ",", "", "\n\n", "plain words here", '""', "x" * 90, " pad "]
    return [[str(i), "".join(rng.choice(bits) for _ in range(rng.randrange(4))), rng.choice(bits)] for i in range(n)]


def in_splits(spark, paths, encoding="UTF-8"):
    found, left_out = csv_split.read_split(spark, paths, encoding)
    rows = found.orderBy("ord").drop("ord").collect()
    return [tuple(r) for r in rows], left_out


def whole(spark, paths, encoding="UTF-8"):
    rows = csv_files._plain_csv(spark, paths, encoding, True).orderBy("ord").drop("ord")
    return [tuple(r) for r in rows.collect()]


@pytest.mark.parametrize("seed,encoding,end", [(1, "utf-8", "\n"), (2, "utf-8-sig", "\r\n"), (3, "cp949", "\n")])
def test_equals_one_split(spark, tmp_path, tiny_splits, seed, encoding, end):
    path = str(tmp_path / "a.csv")
    with open(path, "wb") as f:
        f.write(written([["id", "text", "more"], *rows_of(seed)], encoding, end))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    files = csv_files.glob_files(spark, path)
    charset = "MS949" if encoding == "cp949" else "UTF-8"
    assert len(csv_split._starts(spark, files).collect()) > 20
    got, left_out = in_splits(spark, files, charset)
    assert left_out == [] and len(got) == 60
    # The other reader has the splits of its one file in order only if it is one.
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == whole(spark, files, charset)


def test_a_record_over_many_splits(spark, tmp_path, tiny_splits):
    long = "\n".join(f"line {i}" for i in range(200))
    with open(tmp_path / "a.csv", "wb") as f:
        f.write(written([["id", "text"], ["1", long], ["2", "next"], ["3", "\n"], ["4", "end\n" * 30]]))
    got, left_out = in_splits(spark, csv_files.glob_files(spark, str(tmp_path / "a.csv")))
    assert got == [("1", long), ("2", "next"), ("3", "\n"), ("4", "end\n" * 30)] and left_out == []


def test_a_header_over_splits_and_odd_names(spark, tmp_path, tiny_splits):
    with open(tmp_path / "a.csv", "wb") as f:
        f.write(written([["id", "a\n" * 50, "", "x", "X"], ["1", "b\n", "c", "d", "e"]]))
    found, _ = csv_split.read_split(spark, csv_files.glob_files(spark, str(tmp_path / "a.csv")), "UTF-8")
    assert found.columns == ["id", "a\n" * 50, "_c2", "x3", "X4", "ord"]
    assert [tuple(r)[:-1] for r in found.collect()] == [("1", "b\n", "c", "d", "e")]


def test_files_whose_quotes_do_not_pair_are_read_whole(spark, tmp_path, tiny_splits):
    good = written([["id", "text"], ["1", "a\nb"], ["2", "c"]])
    for name, data in (("1", good), ("2", b'id,text\n3,5" nails\n4,"x\ny"\n'), ("3", b'id,text\n5,"never closed\n6,z\n')):
        with open(tmp_path / f"{name}.csv", "wb") as f:
            f.write(data)
    paths = csv_files.glob_files(spark, str(tmp_path / "*.csv"))
    _, left_out = in_splits(spark, paths)
    assert [p[-5:] for p in left_out] == ["2.csv", "3.csv"]
    got = csv_files.read_csv_any(spark, paths)
    assert {(r["id"], r["text"]) for r in got.collect()} == {
        ("1", "a\nb"), ("2", "c"), ("3", '5" nails'), ("4", "x\ny"), ("5", "never closed\n6,z\n"),
    }
    assert got.select("ord").distinct().count() == 5


def test_reading_order_over_files(spark, tmp_path, tiny_splits):
    for k in range(3):
        with open(tmp_path / f"{k}.csv", "wb") as f:
            f.write(written([["id", "text"], *[[str(100 * k + i), "t\nu" * (i % 4)] for i in range(30)]]))
    got = csv_files.read_csv_any(spark, csv_files.glob_files(spark, str(tmp_path / "*.csv"))).orderBy("ord").collect()
    assert [int(r["id"]) for r in got] == [100 * k + i for k in range(3) for i in range(30)]


def test_files_without_breaks_need_no_second_reading(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(written([["id", "text"], ["1", 'say "no", twice']]))
    kinds = csv_files.file_encodings(spark, [str(tmp_path / "a.csv")]).collect()
    assert [r["breaks"] for r in kinds] == [False]
    assert csv_files.read_csv_any(spark, str(tmp_path / "a.csv")).first()["text"] == 'say "no", twice'


def test_a_split_that_was_not_counted_fails(spark):
    lines = spark.createDataFrame([(None, None, None, None, b"x")], "base long, file int, first boolean, odd boolean, value binary")
    with pytest.raises(Exception, match="splits of a file changed"):
        lines.mapInArrow(csv_split._assembled("UTF-8"), csv_split.ROWS).collect()


def test_lines_keep_their_order_through_the_join(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(written([["id", "text"], ["1", "a\nb"]]))
    files = csv_files.glob_files(spark, str(tmp_path / "a.csv"))
    found, _ = csv_split.records(spark, files, "UTF-8")
    assert found.filter(F.col("header")).count() == 1
