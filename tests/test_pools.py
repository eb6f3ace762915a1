"""Pools of synthetic texts of an exact size."""

import itertools

import pytest
from pyspark.sql import functions as F

from mailsift.operators import augment

TEMPLATES = [
    ("few", 0, "{a} {a}", "x"),
    ("few", 1, "{a} {a}", "x"),
    ("many", 0, "{w} {w} {w}", "{w} {w} {w} {w}"),
    ("one", 0, "same", "text"),
    ("same", 0, "{e}{e}{e}{e}{e}{e}{e}", "t"),
]


def pool(spark, quotas, links=None, files=None, templates=TEMPLATES):
    links = F.array().cast("array<string>") if links is None else links
    table = spark.createDataFrame(templates, "label string, idx long, subject string, body string")
    wanted = spark.createDataFrame(quotas, "label string, n int")
    ten = F.array(*[F.lit(f"w{i}") for i in range(10)])
    slots = F.create_map(
        F.lit("a"), F.array(F.lit("1"), F.lit("2"), F.lit("2")), F.lit("w"), ten, F.lit("e"), F.array(*[F.lit(" " * i) for i in range(10)])
    )
    got, report = augment.filled_pool(wanted, table, slots, links, files if files is not None else F.array(F.lit("")))
    texts = {}
    for r in got.collect():
        texts.setdefault(r["label"], []).append(r["text"])
    assert all(len(set(t)) == len(t) for t in texts.values())
    return texts, {r["label"]: (r["n"], r["got"]) for r in report.collect()}


def test_exactly_n_or_all_there_are(spark):
    texts, report = pool(spark, [("few", 9), ("many", 500), ("one", 3), ("none", 5), ("zero", 0)])
    assert report == {"few": (9, 4), "many": (500, 500), "one": (3, 1), "none": (5, 0), "zero": (0, 0)}
    assert sorted(texts["few"]) == [f"{a} {b} x" for a, b in itertools.product("12", "12")]
    assert len(texts["many"]) == 500 and texts["one"] == ["same text"]


def test_links_and_attachments_belong_to_the_space(spark):
    files = F.array(F.lit(""), F.lit("f.exe"), F.lit("f.exe"))
    texts, report = pool(spark, [("one", 99)], F.array(F.lit("l1"), F.lit("l2")), files)
    assert report == {"one": (99, 6)}
    assert len(texts["one"]) == 6 and sum("f.exe" in t for t in texts["one"]) == 3 and sum("l1" in t for t in texts["one"]) == 2


def test_hopeless_draws_end_in_going_through(spark):
    """A large space of texts that nearly all are the same: draws bring little, the count is exact."""
    texts, report = pool(spark, [("same", 2000)], templates=[("same", 0, "{e}x{e}", "t{e}{e}")])
    want = len({(" " * a + "x" + " " * b).strip() + " " + ("t" + " " * (c + d)).strip() for a, b, c, d in itertools.product(range(10), repeat=4)})
    assert report == {"same": (2000, want)} and len(texts["same"]) == want


def test_the_same_seed_gives_the_same_pool(spark):
    assert sorted(pool(spark, [("many", 50)])[0]["many"]) == sorted(pool(spark, [("many", 50)])[0]["many"])


@pytest.mark.parametrize("ways", [1, 7, 25_000])
def test_numbered_rows(spark, ways):
    rows = augment._numbered(spark.createDataFrame([("x", ways), ("y", 0)], "k string, n long"), F.col("n"), "i")
    assert rows.agg(F.count("i"), F.min("i"), F.max("i"), F.count_distinct("i")).first() == (ways, 0, ways - 1, ways)


def test_a_space_beyond_counting(spark):
    rows = spark.createDataFrame([("x", 0, "{w}" * 30, "b")], "label string, idx long, subject string, body string")
    slots = F.create_map(F.lit("w"), F.array(*[F.lit(str(i)) for i in range(100)]))
    assert augment.with_space(rows, slots, F.array(F.lit("l")), F.array(F.lit(""))).first()["space"] == augment.ENDLESS
