"""Queries from text to features, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions.text import tokens
from mailsift.operators import features
from mailsift.operators.scaling import spread
from mailsift.plans import fixtures as fx
from mailsift.plans import sqltext as q
from mailsift.plans.registry import query


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.mail(spark, sf_dir).select("id", F.col("body").alias("text"))


def _tokens_sql(lang: str) -> str:
    return fx.with_views(fx.MAIL_SQL) + f"""SELECT id, CAST(len(t) AS INTEGER) AS n, array_to_string(t, ' ') AS tokens
FROM (SELECT id, {q.tokens('body', lang)} AS t FROM mail)"""


def _tokens(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    rows = spread(bodies(spark, sf_dir), "id").withColumn("t", tokens("text", lang))
    return rows.select("id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("tokens_char", _tokens_sql("ko"))
def tokens_char(spark, sf_dir):
    return _tokens(spark, sf_dir, "ko")


@query("tokens_word", _tokens_sql("en"))
def tokens_word(spark, sf_dir):
    return _tokens(spark, sf_dir, "en")


def _vocab_views(lang: str) -> str:
    return fx.with_views(fx.MAIL_SQL) + f""", tok AS (SELECT id, {q.tokens('body', lang)} AS t FROM mail),
each AS (SELECT id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM tok),
counted AS (
  SELECT token, count(*) AS n, min(id) AS first_row, arg_min(pos, (id, pos)) AS first_pos FROM each GROUP BY token),
vocab AS (
  SELECT token, CAST(rn + 1 AS INTEGER) AS id FROM (
    SELECT token, row_number() OVER (ORDER BY n DESC, first_row, first_pos) AS rn FROM counted WHERE n >= 2)
  WHERE rn <= {features.VOCAB_SIZE[lang]})
"""


@query("vocab_char", _vocab_views("ko") + "SELECT token, id FROM vocab")
def vocab_char(spark, sf_dir):
    return features.vocabulary(bodies(spark, sf_dir), "ko", "id")


@query("vocab_word", _vocab_views("en") + "SELECT token, id FROM vocab")
def vocab_word(spark, sf_dir):
    return features.vocabulary(bodies(spark, sf_dir), "en", "id")


def _encoded_sql(lang: str) -> str:
    n = features.MAX_LEN[lang]
    return _vocab_views(lang) + f""", ids AS (
  SELECT e.id, list(COALESCE(v.id, 1) ORDER BY e.pos) AS l
  FROM each e LEFT JOIN vocab v ON e.token = v.token WHERE e.pos <= {n} GROUP BY e.id)
SELECT m.id, array_to_string(list_resize(COALESCE(l, []), {n}, 0), ' ') AS ids
FROM mail m LEFT JOIN ids ON m.id = ids.id"""


def _encoded(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    rows = bodies(spark, sf_dir)
    vocab = features.vocabulary(rows, lang, "id")
    encoded = features.encode(spread(rows, "id"), vocab, lang)
    return encoded.select("id", F.array_join("ids", " ").alias("ids"))


@query("encoded_char", _encoded_sql("ko"))
def encoded_char(spark, sf_dir):
    return _encoded(spark, sf_dir, "ko")


@query("encoded_word", _encoded_sql("en"))
def encoded_word(spark, sf_dir):
    return _encoded(spark, sf_dir, "en")
