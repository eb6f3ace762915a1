import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mailsift.operators import allowlist, mailbox, scaling


def test_mark_smallest_equals_ranking(spark):
    random.seed(3)
    rows = [(i, random.choice("aaaaaab"), random.choice("xy")) for i in range(3000)] + [(9999, "c", "x")]
    df = spark.createDataFrame(rows, "id long, s string, t string")
    marked = scaling.mark_smallest(
        df, ["s", "t"], scaling.seeded_hash(42, "id"),
        lambda sizes: sizes.withColumn("quota", F.expr("n div 3 + 1")),
    )
    got = {r["id"] for r in marked.filter("selected").collect()}
    want = set()
    for key in {(s, t) for _, s, t in rows}:
        ids = sorted(
            (i for i, s, t in rows if (s, t) == key),
            key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest(),
        )
        want |= set(ids[: len(ids) // 3 + 1])
    assert got == want
    assert marked.count() == len(rows)


def test_mark_smallest_limits(spark):
    df = spark.range(50).withColumn("s", F.lit("a"))
    for quota, expected in ((0, 0), (7, 7), (50, 50), (99, 50)):
        marked = scaling.mark_smallest(
            df, ["s"], scaling.seeded_hash(1, "id"),
            lambda n, q=quota: n.withColumn("quota", F.lit(q).cast("long")),
        )
        assert marked.filter("selected").count() == expected


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_keys", [1, 3])
def test_lookup_join_large_side_equals_plain_join(spark, monkeypatch, how, hot_keys):
    monkeypatch.setattr(scaling, "HOT_KEYS", hot_keys)
    left = spark.range(600).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
    )
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k string, v int")
    got = scaling.lookup_join(left, right, ["k"], how, limit=0)
    want = left.join(right, ["k"], how)
    key = str
    assert sorted(map(tuple, got.select(want.columns).collect()), key=key) == sorted(
        map(tuple, want.collect()), key=key
    )


def test_allowlist_paths_agree(spark, monkeypatch):
    patterns = spark.createDataFrame(
        [("b.com",), ("u1@c.org",), ("example.net",), ("com",), ("word",)], "pattern string"
    )
    senders = ["x <A@B.com>", "a@mail.b.com", "a@xb.com", "u1@c.org", "u2@c.org", "word", "", None, "com", "b@d.com"]
    mail = spark.createDataFrame([(i, s) for i, s in enumerate(senders)], "id int, sender string")
    want = {0: True, 1: True, 2: True, 3: True, 4: False, 5: True, 6: False, 7: False, 8: True, 9: True}
    first = {r["id"]: r["trusted"] for r in allowlist.flag_trusted(mail, patterns).collect()}
    monkeypatch.setattr(allowlist, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(scaling, "is_small", lambda *a, **k: False)
    second = {r["id"]: r["trusted"] for r in allowlist.flag_trusted(mail, patterns).collect()}
    assert first == want
    assert second == want


def test_subdomain_rule(spark):
    patterns = spark.createDataFrame([("notion.so",)], "pattern string")
    senders = ["t@notion.so", "t@mail.notion.so", "t@evilnotion.so", "t@notion.so.evil.com"]
    mail = spark.createDataFrame([(i, s) for i, s in enumerate(senders)], "id int, sender string")
    rows = allowlist.flag_trusted(mail, patterns).orderBy("id").collect()
    assert [r["trusted"] for r in rows] == [True, True, False, False]


@pytest.mark.parametrize("offset", [0, 7, 150, 390, 399, 500])
def test_row_range_deep(spark, offset):
    # Most rows share one instant, as after a bulk load.
    rows = spark.range(400).select(
        "id",
        F.expr(
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, "
            "CASE WHEN id % 3 = 0 THEN 5 ELSE CAST(id AS INT) * 1000 END)"
        ).alias("created_at"),
    )
    want = [r["id"] for r in rows.orderBy(F.desc("created_at"), F.desc("id")).collect()][offset : offset + 20]
    got = mailbox.row_range(rows, offset, 20, shallow=25).orderBy(F.desc("created_at"), F.desc("id"))
    assert [r["id"] for r in got.collect()] == want


def test_page_clamping():
    assert mailbox.page_count(0) == 1
    assert mailbox.page_count(11) == 2
    assert mailbox.clamp_page(9, 11) == 1
    assert mailbox.clamp_page(-1, 11) == 0


def test_hash_lookup(spark):
    table = spark.range(1000).select(F.concat(F.lit("t"), "id").alias("k"), F.col("id").cast("int").alias("v"))
    lookup = scaling.HashLookup(table, "k", "v", 1000)
    rows = spark.createDataFrame([(["t1", "none", "t999"],)], "a array<string>")
    out = lookup.attach(rows).select(F.transform("a", lambda k: lookup.probe(k))).first()[0]
    assert out == [1, None, 999]


def test_first_by_limits_rows_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = scaling.first_by(df, ["k"], [F.col("id")])._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
