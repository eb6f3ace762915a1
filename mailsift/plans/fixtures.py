"""Mail-shaped views over the given tables, once as DataFrames and once as SQL text.

The given tables hold no mail, so every registered query starts from these views. Each rule is
written twice, so a second engine can compute the expected rows from the same parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions.verdict import to_tier

TRUSTED = [
    ("src1.example.org", "domain"),
    ("src3.example.com", "parent domain"),
    ("u8@src8.example.org", "address"),
    ("example.net", "no hit"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _start():
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'")


def _minutes(n):
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def _hours(n):
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    address_id = d.cast("string")
    prob = ((d * 53) % 101) / 100
    return table(spark, sf_dir, "documents").select(
        d.alias("id"),
        F.when(d % 4 == 0, "manual").otherwise("gmail").alias("source"),
        F.when(d % 4 != 0, F.concat(F.lit("g"), address_id)).alias("gmail_id"),
        F.when(d % 7 == 0, None)
        .when(
            d % 3 == 0,
            F.concat(
                F.lit("User <U"), address_id, F.lit("@Mail."), F.col("source"), F.lit(".example.com>")
            ),
        )
        .otherwise(F.concat(F.lit("u"), address_id, F.lit("@"), F.col("source"), F.lit(".example.org")))
        .alias("sender"),
        F.concat(F.lit("Re: "), F.col("lang")).alias("subject"),
        F.when(d % 6 == 0, F.concat(F.lit("안녕하세요 "), F.col("text")))
        .otherwise(F.col("text"))
        .alias("body"),
        F.when(d % 5 == 1, "report.pdf")
        .when(d % 5 == 2, "invoice.exe")
        .when(d % 5 == 3, "nan")
        .otherwise("")
        .alias("attachment"),
        prob.alias("spam_prob"),
        to_tier(prob).alias("predicted_label"),
        (d % 5 == 0).cast("int").alias("actioned"),
        (_start() + _minutes(F.expr("doc_id div 2"))).alias("created_at"),
    )


MAIL_SQL = """
mail AS (
  SELECT *, CASE WHEN spam_prob >= 0.7 THEN 'spam' WHEN spam_prob < 0.4 THEN 'ham' ELSE 'review' END AS predicted_label
  FROM (
    SELECT doc_id AS id,
      CASE WHEN doc_id % 4 = 0 THEN 'manual' ELSE 'gmail' END AS source,
      CASE WHEN doc_id % 4 <> 0 THEN 'g' || doc_id END AS gmail_id,
      CASE WHEN doc_id % 7 = 0 THEN NULL
           WHEN doc_id % 3 = 0 THEN 'User <U' || doc_id || '@Mail.' || source || '.example.com>'
           ELSE 'u' || doc_id || '@' || source || '.example.org' END AS sender,
      'Re: ' || lang AS subject,
      CASE WHEN doc_id % 6 = 0 THEN '안녕하세요 ' || text ELSE text END AS body,
      CASE doc_id % 5 WHEN 1 THEN 'report.pdf' WHEN 2 THEN 'invoice.exe' WHEN 3 THEN 'nan' ELSE '' END AS attachment,
      CAST((doc_id * 53) % 101 AS DOUBLE) / 100 AS spam_prob,
      CAST(doc_id % 5 = 0 AS INTEGER) AS actioned,
      TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id // 2 AS INTEGER)) AS created_at
    FROM documents))"""


def trusted_senders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRUSTED, "pattern string, note string")


TRUSTED_SQL = """
trusted_senders(pattern, note) AS (VALUES
  ('src1.example.org', 'domain'), ('src3.example.com', 'parent domain'),
  ('u8@src8.example.org', 'address'), ('example.net', 'no hit'))"""


def user_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return (
        table(spark, sf_dir, "conversations")
        .select(
            (c * 100 + t).alias("id"),
            F.when(c % 3 == 0, F.concat(F.lit("안녕 "), F.col("text")))
            .otherwise(F.col("text"))
            .alias("content"),
            F.when((c + t) % 3 == 0, "spam").otherwise("ham").alias("user_label"),
            F.lit(None).cast("string").alias("note"),
            (_start() + _hours(c) + _minutes(t)).alias("created_at"),
        )
    )


REPORTS_SQL = """
user_reports AS (
  SELECT conv_id * 100 + turn AS id,
    CASE WHEN conv_id % 3 = 0 THEN '안녕 ' || text ELSE text END AS content,
    CASE WHEN (conv_id + turn) % 3 = 0 THEN 'spam' ELSE 'ham' END AS user_label,
    CAST(NULL AS VARCHAR) AS note,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS created_at
  FROM conversations)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled corpus; a sixth of the rows Korean, so both languages occur."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    d = F.col("doc_id")
    return docs.join(labels, "doc_id").select(
        d.alias("id"),
        F.when(F.col("toxic") == 1, "spam").otherwise("ham").alias("label"),
        F.when(d % 6 == 0, F.concat(F.lit("안녕하세요 "), F.col("text")))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(d % 6 == 0, "ko").otherwise("en").alias("lang"),
        "source",
        F.when(d % 3 == 1, "synthetic").otherwise("real").alias("origin"),
        (((d * 53) % 101) / 100).alias("spam_prob"),
    )


LABELLED_SQL = """
labelled AS (
  SELECT d.doc_id AS id,
    CASE WHEN l.toxic = 1 THEN 'spam' ELSE 'ham' END AS label,
    CASE WHEN d.doc_id % 6 = 0 THEN '안녕하세요 ' || d.text ELSE d.text END AS text,
    CASE WHEN d.doc_id % 6 = 0 THEN 'ko' ELSE 'en' END AS lang,
    d.source AS source,
    CASE WHEN d.doc_id % 3 = 1 THEN 'synthetic' ELSE 'real' END AS origin,
    CAST((d.doc_id * 53) % 101 AS DOUBLE) / 100 AS spam_prob
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def training_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = e % 4
    f1 = ((e * 37) % 1001) / 1000
    return table(spark, sf_dir, "events").select(
        e.alias("id"),
        F.when(kind == 0, "v1")
        .when(kind == 1, "v1-skipped")
        .when(kind == 2, "en-v1")
        .otherwise("en-v1-skipped")
        .alias("model_version"),
        (1000 + e % 500).cast("int").alias("train_size"),
        (200 + e % 100).cast("int").alias("test_size"),
        (((e * 41) % 1001) / 1000).alias("accuracy"),
        (((e * 43) % 1001) / 1000).alias("precision_val"),
        (((e * 47) % 1001) / 1000).alias("recall_val"),
        f1.alias("f1_score"),
        (_start() + _hours((e * 7) % (20 + 10 * kind))).alias("trained_at"),
    )


RUNS_SQL = """
training_runs AS (
  SELECT event_id AS id,
    CASE event_id % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v1-skipped' WHEN 2 THEN 'en-v1' ELSE 'en-v1-skipped' END AS model_version,
    CAST(1000 + event_id % 500 AS INTEGER) AS train_size,
    CAST(200 + event_id % 100 AS INTEGER) AS test_size,
    CAST((event_id * 41) % 1001 AS DOUBLE) / 1000 AS accuracy,
    CAST((event_id * 43) % 1001 AS DOUBLE) / 1000 AS precision_val,
    CAST((event_id * 47) % 1001 AS DOUBLE) / 1000 AS recall_val,
    CAST((event_id * 37) % 1001 AS DOUBLE) / 1000 AS f1_score,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((event_id * 7) % (20 + 10 * (event_id % 4)) AS INTEGER)) AS trained_at
  FROM events)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    lang = F.when(e % 3 == 0, "en").otherwise("ko")
    logged = _start() + _minutes((e * 13) % 5003)
    backup_id = F.concat(
        F.date_format(logged, "yyyyMMdd_HHmmss"), F.lit("_"), F.lpad(e.cast("string"), 9, "0")
    )
    return table(spark, sf_dir, "events").select(
        lang.alias("lang"),
        backup_id.alias("backup_id"),
        F.concat(F.lit("models/"), lang, F.lit("/"), e.cast("string")).alias("path"),
        F.when(e % 5 == 0, "deploy").otherwise("backup").alias("kind"),
        logged.alias("logged_at"),
    )


REGISTRY_SQL = """
registry AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'en' ELSE 'ko' END AS lang,
    strftime(logged, '%Y%m%d_%H%M%S') || '_' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS backup_id,
    'models/' || CASE WHEN event_id % 3 = 0 THEN 'en' ELSE 'ko' END || '/' || event_id AS path,
    CASE WHEN event_id % 5 = 0 THEN 'deploy' ELSE 'backup' END AS kind,
    logged AS logged_at
  FROM (SELECT event_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((event_id * 13) % 5003 AS INTEGER)) AS logged FROM events))"""


def trust_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowlist changes: mixed case, padded, some blank, some removals."""
    d = F.col("doc_id")
    raw = F.concat(F.lit("  U"), (d % 50).cast("string"), F.lit("@"), F.col("source"), F.lit(".Example.org "))
    return table(spark, sf_dir, "documents").select(
        d.alias("id"),
        F.when(d % 13 == 0, "   ").otherwise(raw).alias("pattern"),
        F.concat(F.lit("n"), d.cast("string")).alias("note"),
        F.when(d % 9 == 0, "remove").otherwise("add").alias("op"),
        (_start() + _minutes(d)).alias("created_at"),
    )


TRUST_LOG_SQL = """
trust_log AS (
  SELECT doc_id AS id,
    CASE WHEN doc_id % 13 = 0 THEN '   ' ELSE '  U' || (doc_id % 50) || '@' || source || '.Example.org ' END AS pattern,
    'n' || doc_id AS note,
    CASE WHEN doc_id % 9 = 0 THEN 'remove' ELSE 'add' END AS op,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS created_at
  FROM documents)"""


def picked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mails a user ticked: ids of a part table key range, some not stored."""
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("gmail_id")
    )


PICKED_SQL = """
picked AS (SELECT 'g' || doc_id AS gmail_id FROM labels)"""


def with_views(*views: str) -> str:
    return "WITH " + ",".join(views) + "\n"
