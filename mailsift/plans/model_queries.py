"""Fitted models: training with evaluation, and a mailbox pass with real scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml.feature import NGram
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.operators import explore, jobs, model
from mailsift.operators.model import BAG, Recipe, train_and_evaluate, verdicts
from mailsift.operators.scaling import cut_lineage
from mailsift.plans import fixtures as fx
from mailsift.plans import sqltext as q
from mailsift.plans.ingest_queries import scratch
from mailsift.plans.registry import query
from mailsift.sources.csv_files import with_target
from mailsift.sources.tables import Store

LANGS = ("ko", "en")


def corpora(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = cut_lineage(with_target(fx.labelled(spark, sf_dir).select("id", "label", "text", "lang")))
    return {lang: rows.filter(F.col("lang") == lang) for lang in LANGS}


@query("train_eval")
def train_eval(spark, sf_dir):
    """Test-side metrics of one model per language, with the sizes of both sides."""
    reports = fx.user_reports(spark, sf_dir)
    out = []
    for lang, rows in corpora(spark, sf_dir).items():
        _, scores, n_train, n_test = train_and_evaluate(rows, reports, lang)
        out.append(
            scores.select(
                F.lit(lang).alias("lang"), F.lit(n_train).alias("n_train"), F.lit(n_test).alias("n_test"), "*"
            )
        )
    return out[0].unionByName(out[1])


@query("train_ordered")
def train_ordered(spark, sf_dir):
    """Test-side metrics where runs of tokens may be features too, chosen by folds of the training side."""
    reports = fx.user_reports(spark, sf_dir)
    out = None
    for lang, rows in corpora(spark, sf_dir).items():
        fitted, scores, *_ = train_and_evaluate(rows, reports, lang, max_iter=10, recipes=(BAG, Recipe((2,))))
        grams = sum(1 for stage in fitted.pipeline.stages if isinstance(stage, NGram))
        part = scores.select(F.lit(lang).alias("lang"), F.lit(grams).alias("grams"), "*")
        out = part if out is None else out.unionByName(part)
    return out


_EACH_SQL = f"""
each AS (SELECT id, lang, label, unnest(CASE WHEN lang = 'ko' THEN {q.tokens('text', 'ko')} ELSE {q.tokens('text', 'en')} END) AS token
  FROM labelled),
docs AS (SELECT lang, token, count(DISTINCT id) FILTER (label = 'spam') AS s, count(DISTINCT id) FILTER (label = 'ham') AS h
  FROM each GROUP BY lang, token),
weights AS (SELECT lang, token, CAST(s - h AS DOUBLE) / (s + h + 8) AS weight FROM docs WHERE s + h >= 3),
sums AS (SELECT id, sum(weight) AS z FROM each JOIN weights USING (lang, token) GROUP BY id)
"""


@query(
    "score_by_weights",
    fx.with_views(fx.LABELLED_SQL, _EACH_SQL)
    + """SELECT id, lang, round(p, 6) AS spam_prob, CASE WHEN round(p, 6) >= 0.7 THEN 'spam' WHEN round(p, 6) < 0.4 THEN 'ham' ELSE 'review' END AS tier
FROM (SELECT l.id, l.lang, 1 / (1 + exp(-(coalesce(z, 0) + CASE lang WHEN 'ko' THEN 0.25 ELSE 0.5 END))) AS p
  FROM labelled l LEFT JOIN sums s ON s.id = l.id)""",
)
def score_by_weights(spark, sf_dir):
    """Both languages' rows scored in one pass by weights in a table, read off each token's class counts."""
    rows = fx.labelled(spark, sf_dir).select("id", "label", "lang", "text")
    tables = []
    for lang in LANGS:
        found = explore.token_doc_freq(rows.filter(F.col("lang") == lang), lang)
        s, h = F.col("spam_docs"), F.col("ham_docs")
        weight = (s - h).cast("double") / (s + h + 8)
        tables.append(found.filter(s + h >= 3).select(F.lit(lang).alias("lang"), "token", weight.alias("weight")))
    weights = cut_lineage(tables[0].unionByName(tables[1]))
    intercepts = spark.createDataFrame([("ko", 0.25), ("en", 0.5)], "lang string, intercept double")
    scored = model.score_by_weights(rows, weights, intercepts, "id")
    shown = scored.select("id", "lang", F.round("spam_prob", 6).alias("spam_prob"))
    return verdicts(shown).select("id", "lang", "spam_prob", "tier")


@query("score_mailbox")
def score_mailbox(spark, sf_dir):
    """Train, deploy, then one pass over all fetched mail; the stored rows are returned."""
    store = Store(spark, scratch(spark, "store"))
    reports = fx.user_reports(spark, sf_dir)
    for i, (lang, rows) in enumerate(corpora(spark, sf_dir).items()):
        fitted, *_ = train_and_evaluate(rows, reports, lang)
        jobs.deploy(store, lang, fitted, datetime(2025, 1, 1, 0, 0, i))
    fetched = fx.mail(spark, sf_dir).filter("gmail_id IS NOT NULL").withColumn("pos", F.col("id"))
    jobs.mailbox_pass(store, fetched, jobs.load_models(store))
    stored = store.read("messages").select("gmail_id", "sender", "predicted_label", "spam_prob", "model_version")
    return verdicts(stored)
