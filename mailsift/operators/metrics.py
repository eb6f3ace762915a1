"""Quality of a scored set: rows with label, spam_prob and optionally lang."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.verdict import is_spam, to_binary, to_tier
from mailsift.schema import BINARY_THRESHOLD


def _counts() -> list[Column]:
    y = is_spam("label") == 1
    p = F.col("spam_prob") >= BINARY_THRESHOLD
    return [
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    ]


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def _scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("n", tp + fp + fn + tn)
        .withColumn("accuracy", _ratio(tp + tn, F.col("n")))
        .withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))
    )


def metrics(scored: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of the whole set; a zero division gives 0."""
    return _scores(scored.agg(*_counts()))


def metrics_by_lang(scored: DataFrame) -> DataFrame:
    """The same per language and, as 'all', overall. The rows are counted once."""
    by_lang = scored.groupBy("lang").agg(*_counts())
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    both = by_lang.rollup("lang").agg(*sums, F.grouping("lang").alias("_all"))
    named = both.withColumn("lang", F.when(F.col("_all") == 1, "all").otherwise(F.col("lang")))
    return _scores(named.drop("_all"))


def confusion_matrix(scored: DataFrame) -> DataFrame:
    return (
        scored.withColumn("pred", to_binary("spam_prob"))
        .groupBy("label")
        .pivot("pred", ["ham", "spam"])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def tier_matrix(scored: DataFrame) -> DataFrame:
    return (
        scored.withColumn("tier", to_tier("spam_prob"))
        .groupBy("label")
        .pivot("tier", ["ham", "review", "spam"])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def accuracy(scored: DataFrame) -> DataFrame:
    """Rows, wrong rows and share of right ones at the binary threshold."""
    right = to_binary("spam_prob") == F.col("label")
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~right).alias("wrong"),
        (F.count_if(right) / F.count(F.lit(1))).alias("accuracy"),
    )


def wrong_rows(scored: DataFrame, n: int = 8, width: int = 70) -> DataFrame:
    """The first ``n`` wrong rows by id, with truth, verdict and the start of the text."""
    return (
        scored.withColumn("pred", to_binary("spam_prob"))
        .filter(F.col("pred") != F.col("label"))
        .orderBy("id")
        .limit(n)
        .select("id", "label", "pred", F.substring("text", 1, width).alias("text"))
    )
