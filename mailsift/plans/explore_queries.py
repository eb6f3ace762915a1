"""Corpus statistics and quality figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.operators import explore, metrics
from mailsift.plans import fixtures as fx
from mailsift.plans import sqltext as q
from mailsift.plans.registry import query

LABELLED = fx.with_views(fx.LABELLED_SQL)


@query("class_counts", LABELLED + "SELECT lang, label, count(*) AS n FROM labelled GROUP BY lang, label")
def class_counts(spark, sf_dir):
    return explore.class_counts(fx.labelled(spark, sf_dir))


@query("label_counts", LABELLED + "SELECT label, count(*) AS n FROM labelled GROUP BY label")
def label_counts(spark, sf_dir):
    return explore.label_counts(fx.labelled(spark, sf_dir))


@query(
    "class_table",
    LABELLED
    + """SELECT lang, count(*) FILTER (label = 'ham') AS ham, count(*) FILTER (label = 'spam') AS spam
FROM labelled GROUP BY lang""",
)
def class_table(spark, sf_dir):
    return explore.class_table(fx.labelled(spark, sf_dir))


def _docs(spark, sf_dir):
    return fx.mail(spark, sf_dir).select(
        "id",
        F.col("body").alias("text"),
        F.when(F.col("id") % 3 == 0, "spam").otherwise("ham").alias("label"),
    )


_DOCS_SQL = """
docs AS (SELECT id, body AS text, CASE WHEN id % 3 = 0 THEN 'spam' ELSE 'ham' END AS label FROM mail)"""
DOCS = fx.with_views(fx.MAIL_SQL, _DOCS_SQL)


def _length(lang: str) -> str:
    return "length(text)" if lang == "ko" else f"len({q.tokens('text', 'en')})"


def _stats_sql(lang: str) -> str:
    return DOCS + f"""SELECT count(*) AS n_rows, sum(l) / count(*) AS mean_len, median(l) AS median_len,
  CAST(max(l) AS INTEGER) AS max_len FROM (SELECT {_length(lang)} AS l FROM docs)"""


def _histogram_sql(lang: str, clip: int) -> str:
    return DOCS + f""", v AS (SELECT least({_length(lang)}, {clip}) AS l FROM docs),
e AS (SELECT min(l) AS lo, max(l) AS hi FROM v)
SELECT b.bin, (SELECT count(*) FROM v, e WHERE least((l - lo) * 50 // (hi - lo), 49) = b.bin) AS n,
  CAST(e.lo AS INTEGER) AS lo, CAST(e.hi AS INTEGER) AS hi
FROM (SELECT CAST(unnest(range(50)) AS INTEGER) AS bin) b, e"""


@query("length_stats_char", _stats_sql("ko"))
def length_stats_char(spark, sf_dir):
    return explore.length_stats(_docs(spark, sf_dir), "ko")


@query("length_stats_word", _stats_sql("en"))
def length_stats_word(spark, sf_dir):
    return explore.length_stats(_docs(spark, sf_dir), "en")


@query("length_histogram_char", _histogram_sql("ko", 600))
def length_histogram_char(spark, sf_dir):
    return explore.length_histogram(_docs(spark, sf_dir), "ko", 600)


@query("length_histogram_word", _histogram_sql("en", 800))
def length_histogram_word(spark, sf_dir):
    return explore.length_histogram(_docs(spark, sf_dir), "en", 800)


def _each(lang: str) -> str:
    return DOCS + f""", each AS (SELECT id, label, unnest({q.tokens('text', lang)}) AS token FROM docs)
"""


@query(
    "top_tokens_char",
    _each("ko") + "SELECT token, count(*) AS n FROM each GROUP BY token ORDER BY n DESC, token LIMIT 20",
)
def top_tokens_char(spark, sf_dir):
    return explore.top_tokens(_docs(spark, sf_dir), "ko")


@query(
    "top_tokens_word",
    _each("en") + "SELECT token, count(*) AS n FROM each GROUP BY token ORDER BY n DESC, token LIMIT 20",
)
def top_tokens_word(spark, sf_dir):
    return explore.top_tokens(_docs(spark, sf_dir), "en")


_DF = """SELECT token, count(DISTINCT id) FILTER (label = 'spam') AS spam_docs,
  count(DISTINCT id) FILTER (label = 'ham') AS ham_docs FROM each GROUP BY token"""


@query("token_doc_freq_char", _each("ko") + _DF)
def token_doc_freq_char(spark, sf_dir):
    return explore.token_doc_freq(_docs(spark, sf_dir), "ko")


@query("token_doc_freq_word", _each("en") + _DF)
def token_doc_freq_word(spark, sf_dir):
    return explore.token_doc_freq(_docs(spark, sf_dir), "en")


def _signal_sql(lang: str, min_count: int) -> str:
    return _each(lang) + f""", df AS ({_DF}),
t AS (SELECT count(*) FILTER (label = 'spam') AS ns, count(*) FILTER (label = 'ham') AS nh FROM docs),
r AS (
  SELECT token, (spam_docs / ns) / ((spam_docs / ns) + (ham_docs / nh) + 1e-9) AS ratio FROM df, t
  WHERE spam_docs + ham_docs >= {min_count})
SELECT * FROM (SELECT 'spam' AS direction, CAST(row_number() OVER (ORDER BY ratio DESC, token) AS INTEGER) AS rank, token, ratio FROM r
  UNION ALL SELECT 'ham', CAST(row_number() OVER (ORDER BY ratio, token) AS INTEGER), token, ratio FROM r)
WHERE rank <= 15"""


@query("signal_tokens_char", _signal_sql("ko", 20))
def signal_tokens_char(spark, sf_dir):
    return explore.signal_tokens(_docs(spark, sf_dir), "ko")


@query("signal_tokens_word", _signal_sql("en", 10))
def signal_tokens_word(spark, sf_dir):
    return explore.signal_tokens(_docs(spark, sf_dir), "en")


@query(
    "source_distinct",
    "SELECT source, count(DISTINCT text) AS distinct_texts, count(*) AS n_rows FROM documents GROUP BY source",
)
def source_distinct(spark, sf_dir):
    return explore.source_distinct(fx.table(spark, sf_dir, "documents"))


@query(
    "origin_share",
    LABELLED
    + """SELECT label, origin, n, n / sum(n) OVER (PARTITION BY label) AS share
FROM (SELECT label, origin, count(*) AS n FROM labelled GROUP BY label, origin)""",
)
def origin_share(spark, sf_dir):
    return explore.origin_share(fx.labelled(spark, sf_dir))


# ---- quality ------------------------------------------------------------------------------
@query(
    "metrics_by_lang",
    LABELLED
    + """, c AS (
  SELECT COALESCE(lang, 'all') AS lang,
    count(*) FILTER (label = 'spam' AND spam_prob >= 0.5) AS tp,
    count(*) FILTER (label <> 'spam' AND spam_prob >= 0.5) AS fp,
    count(*) FILTER (label = 'spam' AND spam_prob < 0.5) AS fn,
    count(*) FILTER (label <> 'spam' AND spam_prob < 0.5) AS tn, count(*) AS n
  FROM labelled GROUP BY GROUPING SETS ((lang), ()))
SELECT *, (tp + tn) / n AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c""",
)
def metrics_by_lang(spark, sf_dir):
    return metrics.metrics_by_lang(fx.labelled(spark, sf_dir))


@query(
    "metrics_overall",
    LABELLED
    + """, c AS (
  SELECT count(*) FILTER (label = 'spam' AND spam_prob >= 0.5) AS tp,
    count(*) FILTER (label <> 'spam' AND spam_prob >= 0.5) AS fp,
    count(*) FILTER (label = 'spam' AND spam_prob < 0.5) AS fn,
    count(*) FILTER (label <> 'spam' AND spam_prob < 0.5) AS tn, count(*) AS n FROM labelled)
SELECT *, (tp + tn) / n AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
  2 * tp / (2 * tp + fp + fn) AS f1 FROM c""",
)
def metrics_overall(spark, sf_dir):
    return metrics.metrics(fx.labelled(spark, sf_dir))


@query(
    "confusion_matrix",
    LABELLED
    + """SELECT label, count(*) FILTER (spam_prob < 0.5) AS ham, count(*) FILTER (spam_prob >= 0.5) AS spam
FROM labelled GROUP BY label""",
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(fx.labelled(spark, sf_dir))


@query(
    "tier_matrix",
    LABELLED
    + """SELECT label, count(*) FILTER (spam_prob < 0.4) AS ham,
  count(*) FILTER (spam_prob >= 0.4 AND spam_prob < 0.7) AS review,
  count(*) FILTER (spam_prob >= 0.7) AS spam FROM labelled GROUP BY label""",
)
def tier_matrix(spark, sf_dir):
    return metrics.tier_matrix(fx.labelled(spark, sf_dir))


_PRED = """, p AS (SELECT *, CASE WHEN spam_prob >= 0.5 THEN 'spam' ELSE 'ham' END AS pred FROM labelled)
"""


@query(
    "demo_accuracy",
    LABELLED
    + _PRED
    + """SELECT count(*) AS n, count(*) FILTER (pred <> label) AS wrong,
  count(*) FILTER (pred = label) / count(*) AS accuracy FROM p""",
)
def demo_accuracy(spark, sf_dir):
    return metrics.accuracy(fx.labelled(spark, sf_dir))


@query(
    "demo_wrong_rows",
    LABELLED
    + _PRED
    + "SELECT id, label, pred, substring(text, 1, 70) AS text FROM p WHERE pred <> label ORDER BY id LIMIT 8",
)
def demo_wrong_rows(spark, sf_dir):
    return metrics.wrong_rows(fx.labelled(spark, sf_dir))
