from pyspark.sql import functions as F

from mailsift.functions import verdict as vd
from mailsift.schema import REVIEW_LOW, SPAM_HIGH


def apply(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("p"))).collect()]


def test_tier_boundaries(spark):
    values = [SPAM_HIGH, SPAM_HIGH - 0.0001, REVIEW_LOW, REVIEW_LOW - 0.0001, 0.0, 1.0, 0.55, None]
    assert apply(spark, values, vd.to_tier) == [
        "spam", "review", "review", "ham", "ham", "spam", "review", None,
    ]


def test_binary_boundary(spark):
    assert apply(spark, [0.5, 0.4999, None], vd.to_binary) == ["spam", "ham", None]


def test_label_codes(spark):
    rows = spark.createDataFrame([("0",), ("1.0",), ("x",), ("2",), (None,)], "c string")
    got = [r[0] for r in rows.select(vd.label_from_code("c")).collect()]
    assert got == ["ham", "spam", None, None, None]


def test_version_tag_and_target(spark):
    rows = spark.createDataFrame([("ko", "SPAM"), ("en", "ham")], "lang string, label string")
    got = [tuple(r) for r in rows.select(vd.version_tag("lang"), vd.is_spam("label")).collect()]
    assert got == [("v1", 1), ("v1-en", 0)]


def test_codes_with_type_suffixes_are_not_numbers(spark):
    from pyspark.sql import functions as F

    from mailsift.functions.verdict import label_from_code

    rows = spark.createDataFrame([("1d",), ("1f",), ("0D",), ("1",), (" 0.0 ",), ("1e0",), ("",), (None,)], "c string")
    assert [r[0] for r in rows.select(label_from_code(F.col("c"))).collect()] == [None, None, None, "spam", "ham", "spam", None, None]
