"""Cursor pages and pages by number over rows that tie."""

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailsift.operators import pages

DDL = "id long, created_at timestamp_ntz, content string"


def table(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3)


def tied(n, seed=1):
    """Rows with equal times, equal ids, nulls in both, and rows equal throughout."""
    rng = random.Random(seed)
    times = [None, *[datetime(2024, 1, 1 + d, 0, 0, s) for d, s in itertools.product((0, 40 % 28), (0, 1))]]
    times += [datetime(2024, 1, 1, 0, 0, 0, 5)]
    return [(rng.choice([None, 1, 2, -3]), rng.choice(times), rng.choice(["x", "y", None])) for _ in range(n)]


def newest_first(rows):
    def key(r):
        return (r[1] is None, -(r[1].timestamp() if r[1] else 0), r[0] is None, -(r[0] or 0))

    return sorted(rows, key=key)


def walk(df, size):
    out, cursor = [], None
    while True:
        page, cursor = pages.page_after(df, cursor and pages.Cursor.of(cursor.token()), size)
        if cursor is None:
            assert page.count() == 0
            return out
        out.append([tuple(r) for r in page.collect()])


@pytest.mark.parametrize("size", [1, 7, 60, 200])
def test_walking_gives_each_row_once(spark, size):
    rows = tied(60 if size > 1 else 12)
    got = walk(table(spark, rows), size)
    assert [len(p) for p in got[:-1]] == [size] * (len(got) - 1)
    flat = [r for p in got for r in p]
    assert sorted(map(repr, flat)) == sorted(map(repr, rows))
    assert [r[:2] for r in flat] == [r[:2] for r in newest_first(rows)]


def test_pages_by_number_agree_with_cursors(spark):
    rows = tied(50, 2)
    df = table(spark, rows)
    by_cursor = walk(df, 8)
    for shallow in (1, 5, 10_000):
        for i, page in enumerate(by_cursor):
            assert [tuple(r) for r in pages.row_range(df, 8 * i, 8, shallow=shallow).collect()] == page, (shallow, i)
        assert pages.row_range(df, 50, 8, shallow=shallow).count() == 0
        assert pages.row_range(df, 500, 8, shallow=shallow).count() == 0


def test_many_equal_rows_end(spark):
    """More equal rows than may be sorted: found by counting, shown once each."""
    df = spark.range(300).select(
        F.lit(7).cast("long").alias("id"), F.expr("timestamp_ntz'2024-01-01'").alias("created_at"), F.lit("same").alias("content")
    )
    df = df.unionByName(table(spark, [(6, datetime(2024, 1, 1), "last")]))
    assert pages.seek(df, 200, shallow=10).seen == 200
    assert [r["content"] for r in pages.row_range(df, 298, 5, shallow=10).collect()] == ["same", "same", "last"]


def test_one_time_and_id_many_texts(spark):
    rows = [(1, datetime(2024, 1, 1), f"text {i}") for i in range(90)]
    df = table(spark, rows)
    got = [tuple(r) for i in range(0, 90, 30) for r in pages.row_range(df, i, 30, shallow=4).collect()]
    assert sorted(got) == sorted(rows) and got == [r for p in walk(df, 45) for r in p]


def test_new_rows_do_not_shift_the_pages_behind_a_cursor(spark):
    rows = [(i, datetime(2024, 1, 1), "x") for i in range(10)]
    page, cursor = pages.page_after(table(spark, rows), None, 4)
    assert [r["id"] for r in page.collect()] == [9, 8, 7, 6]
    more = rows + [(i, datetime(2024, 1, 2), "new") for i in range(5)]
    assert [r["id"] for r in pages.page_after(table(spark, more), cursor, 3)[0].collect()] == [5, 4, 3]


def test_cursor_bound_reaches_the_scan(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i % 24), "x") for i in range(48)]
    table(spark, rows).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    _, cursor = pages.page_after(df, None, 20)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = pages.page_after(df, cursor, 5)[0]._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(created_at,2024-01-01T14:00)" in plan
    assert "GreaterThanOrEqual(created_at,2024-01-01T11:00)" in plan


def test_empty_table(spark):
    df = table(spark, [])
    assert pages.page_after(df, None, 5)[1] is None
    assert pages.seek(df, 3) is None
