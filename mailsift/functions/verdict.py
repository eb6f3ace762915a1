"""Verdict and filter rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.schema import (
    BINARY_THRESHOLD,
    REVIEW_LOW,
    SPAM_HIGH,
    VERSION_EN,
    VERSION_KO,
)


def to_tier(prob: Column | str) -> Column:
    """spam from SPAM_HIGH on, ham below REVIEW_LOW, review between."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.when(p >= SPAM_HIGH, "spam").when(p < REVIEW_LOW, "ham").when(p.isNotNull(), "review")


def to_binary(prob: Column | str) -> Column:
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.when(p >= BINARY_THRESHOLD, "spam").when(p.isNotNull(), "ham")


def sigmoid(score: Column | str) -> Column:
    z = F.col(score) if isinstance(score, str) else score
    return 1 / (1 + F.exp(-z))


def version_tag(lang: Column | str) -> Column:
    """Tag stored with a fetched mail."""
    c = F.col(lang) if isinstance(lang, str) else lang
    return F.when(c == "ko", VERSION_KO).otherwise(VERSION_EN)


def label_filter(label: str | None, column: str = "predicted_label") -> Column:
    """List filter: 'spam' also shows review, 'ham' only ham, anything else shows all."""
    if label == "spam":
        return F.col(column).isin("spam", "review")
    if label == "ham":
        return F.col(column) == "ham"
    return F.lit(True)


def pending_filter(label: str | None = "spam") -> Column:
    """Fetched mail nobody has acted on yet."""
    return (
        (F.col("source") == "gmail")
        & F.col("gmail_id").isNotNull()
        & (F.col("actioned") == 0)
        & label_filter(label)
    )


def is_spam(label: Column | str) -> Column:
    """1 for spam in any letter case, else 0."""
    c = F.col(label) if isinstance(label, str) else label
    return (F.lower(c) == "spam").cast("int")


def label_from_code(code: Column | str) -> Column:
    """0 and 1 become ham and spam; anything else, also unparsable text, becomes null."""
    c = F.trim((F.col(code) if isinstance(code, str) else code).cast("string"))
    # The cast alone would also read type suffixes, as in '1d'.
    n = F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))
    return F.when(n == 0, "ham").when(n == 1, "spam")
