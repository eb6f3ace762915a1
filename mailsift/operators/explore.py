"""Corpus statistics: class counts, lengths, token frequencies and class signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsift.functions.text import tokens
from mailsift.operators.scaling import spread


def class_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))


def label_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def class_table(corpus: DataFrame) -> DataFrame:
    """Labels side by side per language."""
    wide = corpus.groupBy("lang").pivot("label", ["ham", "spam"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def text_length(lang: str) -> Column:
    """Characters for Korean, tokens for English."""
    return F.length("text") if lang == "ko" else F.size(tokens("text", "en"))


def length_counts(corpus: DataFrame, lang: str, clip: int | None = None) -> DataFrame:
    """Rows per text length. One pass; every length statistic is read off this small table."""
    n = text_length(lang)
    n = F.least(n, F.lit(clip)) if clip else n
    return spread(corpus.select("id", "text"), "id").groupBy(n.alias("len")).agg(F.count(F.lit(1)).alias("n"))


def length_stats(corpus: DataFrame, lang: str) -> DataFrame:
    """Mean, exact (interpolated) median and maximum length."""
    return length_counts(corpus, lang).agg(
        F.sum("n").alias("n_rows"),
        (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("mean_len"),
        F.percentile("len", F.lit(0.5), F.col("n")).alias("median_len"),
        F.max("len").alias("max_len"),
    )


def length_histogram(corpus: DataFrame, lang: str, clip: int, bins: int = 50) -> DataFrame:
    """All ``bins`` equal bins between the least and greatest clipped length, the last one closed.

    Bin numbers are whole-number arithmetic, so no edge value lands on the wrong side. A bin
    without rows has n = 0; an empty corpus has no edges (null).
    """
    counts = length_counts(corpus, lang, clip)  # at most clip + 1 rows
    every = Window.partitionBy()
    lo, hi = F.min("len").over(every), F.max("len").over(every)
    slot = F.when(F.col("hi") == F.col("lo"), bins // 2).otherwise(
        F.least(F.floor((F.col("len") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    )
    filled = (
        counts.withColumns({"lo": lo, "hi": hi})
        .groupBy(slot.cast("int").alias("bin"))
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    numbers = corpus.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return numbers.join(filled, "bin", "left").select(
        "bin",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.min("lo").over(every).alias("lo"),
        F.max("hi").over(every).alias("hi"),
    )


def token_frequency(corpus: DataFrame, lang: str) -> DataFrame:
    rows = spread(corpus.select("id", "text"), "id")
    return (
        rows.select(F.explode(tokens("text", lang)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_tokens(corpus: DataFrame, lang: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent tokens; equal counts in token order."""
    return token_frequency(corpus, lang).orderBy(F.desc("n"), "token").limit(n)


def token_doc_freq(corpus: DataFrame, lang: str) -> DataFrame:
    """In how many spam and ham rows each token occurs; one pass for both classes."""
    rows = spread(corpus.select("id", "label", "text"), "id")
    return (
        rows.select("label", F.explode(F.array_distinct(tokens("text", lang))).alias("token"))
        .groupBy("token")
        .agg(
            F.sum((F.col("label") == "spam").cast("bigint")).alias("spam_docs"),
            F.sum((F.col("label") == "ham").cast("bigint")).alias("ham_docs"),
        )
    )


def token_ratios(corpus: DataFrame, lang: str, min_count: int) -> DataFrame:
    """Share of spam rows with the token against its share in both classes."""
    totals = corpus.agg(
        F.struct(
            F.sum((F.col("label") == "spam").cast("bigint")).alias("spam"),
            F.sum((F.col("label") == "ham").cast("bigint")).alias("ham"),
        )
    ).scalar()
    s = F.col("spam_docs") / F.col("_t.spam")
    h = F.col("ham_docs") / F.col("_t.ham")
    return (
        token_doc_freq(corpus, lang)
        .filter(F.col("spam_docs") + F.col("ham_docs") >= min_count)
        .withColumn("_t", totals)
        .select("token", "spam_docs", "ham_docs", (s / (s + h + 1e-9)).alias("ratio"))
    )


def signal_tokens(corpus: DataFrame, lang: str, min_count: int | None = None, n: int = 15) -> DataFrame:
    """The ``n`` strongest spam tokens and ham tokens with their rank."""
    ratios = token_ratios(corpus, lang, min_count or (20 if lang == "ko" else 10))

    def top(direction: str, first: Column) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(first, F.asc("token")))
        return ratios.orderBy(first, F.asc("token")).limit(n).select(
            F.lit(direction).alias("direction"), rank.alias("rank"), "token", "ratio"
        )

    return top("spam", F.desc("ratio")).unionByName(top("ham", F.asc("ratio")))


def source_distinct(corpus: DataFrame) -> DataFrame:
    """Distinct texts per source. Digests, not texts, are shuffled."""
    digest = F.unhex(F.sha2("text", 256))
    return corpus.groupBy("source").agg(
        F.count_distinct(digest).alias("distinct_texts"), F.count(F.lit(1)).alias("n_rows")
    )


def origin_share(corpus: DataFrame) -> DataFrame:
    """Share of each origin (real, synthetic) within its class."""
    counts = corpus.groupBy("label", "origin").agg(F.count(F.lit(1)).alias("n"))
    of_class = F.sum("n").over(Window.partitionBy("label"))
    return counts.select("label", "origin", "n", (F.col("n") / of_class).alias("share"))
