"""Feedback and model lifecycle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from mailsift.operators import lifecycle
from mailsift.plans import fixtures as fx
from mailsift.plans.registry import query

TS = "yyyy-MM-dd HH:mm:ss"
SQL_TS = "%Y-%m-%d %H:%M:%S"
_LANG = "CASE replace(model_version, '-skipped', '') WHEN 'v1' THEN 'ko' WHEN 'en-v1' THEN 'en' END"


@query(
    "latest_run",
    fx.with_views(fx.RUNS_SQL)
    + f"""SELECT id, model_version, train_size, test_size, accuracy, precision_val, recall_val, f1_score,
  strftime(trained_at, '{SQL_TS}') AS trained_at
FROM (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY trained_at DESC, id DESC) AS rn FROM training_runs)
WHERE rn = 1""",
)
def latest_run(spark, sf_dir):
    runs = lifecycle.latest_runs(fx.training_runs(spark, sf_dir))
    return runs.withColumn("trained_at", F.date_format("trained_at", TS))


@query(
    "latest_attempt",
    fx.with_views(fx.RUNS_SQL)
    + f"SELECT {_LANG} AS lang, strftime(max(trained_at), '{SQL_TS}') AS since FROM training_runs GROUP BY 1",
)
def latest_attempt(spark, sf_dir):
    attempts = lifecycle.latest_attempts(fx.training_runs(spark, sf_dir))
    return attempts.withColumn("since", F.date_format("since", TS))


DUE_SQL = fx.with_views(fx.REPORTS_SQL, fx.RUNS_SQL) + f""", a AS (
  SELECT {_LANG} AS lang, max(trained_at) AS since FROM training_runs GROUP BY 1),
r AS (SELECT *, CASE WHEN regexp_matches(content, '[가-힣]') THEN 'ko' ELSE 'en' END AS lang FROM user_reports)
SELECT a.lang, strftime(a.since, '{SQL_TS}') AS since, count(r.id) AS new_reports, count(r.id) >= 5 AS due
FROM a LEFT JOIN r ON a.lang = r.lang AND r.created_at > a.since GROUP BY a.lang, a.since"""


@query("retrain_due", DUE_SQL)
def retrain_due(spark, sf_dir):
    due = lifecycle.retrain_due(fx.user_reports(spark, sf_dir), fx.training_runs(spark, sf_dir))
    return due.withColumn("since", F.date_format("since", TS))


@query(
    "promotion_gate",
    fx.with_views(fx.RUNS_SQL)
    + """, cand AS (
  SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'ko' ELSE 'en' END AS lang,
    CAST((event_id * 53) % 1001 AS DOUBLE) / 1000 AS new_f1 FROM events),
bar AS (
  SELECT CASE model_version WHEN 'v1' THEN 'ko' ELSE 'en' END AS lang, f1_score AS old_f1 FROM (
    SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY trained_at DESC, id DESC) AS rn FROM training_runs
    WHERE model_version IN ('v1', 'en-v1')) WHERE rn = 1)
SELECT event_id, c.lang, new_f1, old_f1,
  CASE WHEN new_f1 >= old_f1 - 0.02::DOUBLE THEN 'promoted' ELSE 'skipped_regression' END AS decision,
  CASE c.lang WHEN 'ko' THEN 'v1' ELSE 'en-v1' END
    || CASE WHEN new_f1 >= old_f1 - 0.02::DOUBLE THEN '' ELSE '-skipped' END AS log_version
FROM cand c JOIN bar b ON c.lang = b.lang""",
)
def promotion_gate(spark, sf_dir):
    e = F.col("event_id")
    candidates = fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 2 == 0, "ko").otherwise("en").alias("lang"),
        (((e * 53) % 1001) / 1000).alias("new_f1"),
    )
    return lifecycle.promotion_gate(candidates, fx.training_runs(spark, sf_dir))


@query(
    "promotion_gate_first",
    """SELECT event_id, 'ko' AS lang, CAST(event_id % 101 AS DOUBLE) / 100 - 1.5 AS new_f1, -1.0::DOUBLE AS old_f1,
  CASE WHEN CAST(event_id % 101 AS DOUBLE) / 100 - 1.5 >= -1.02::DOUBLE THEN 'promoted' ELSE 'skipped_regression' END AS decision,
  CASE WHEN CAST(event_id % 101 AS DOUBLE) / 100 - 1.5 >= -1.02::DOUBLE THEN 'v1' ELSE 'v1-skipped' END AS log_version FROM events""",
)
def promotion_gate_first(spark, sf_dir):
    """Candidates of a language that has no run of its own yet: the bar is -1."""
    candidates = fx.table(spark, sf_dir, "events").select(
        "event_id", F.lit("ko").alias("lang"), ((F.col("event_id") % 101).cast("double") / 100 - 1.5).alias("new_f1")
    )
    others = fx.training_runs(spark, sf_dir).filter("model_version <> 'v1'")
    return lifecycle.promotion_gate(candidates, others)


_BACKUPS = fx.with_views(fx.REGISTRY_SQL) + """, b AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY backup_id DESC) AS rn FROM registry WHERE kind = 'backup')
"""


@query(
    "registry_list",
    _BACKUPS + 'SELECT lang, backup_id, path, CAST(rn - 1 AS INTEGER) AS "index" FROM b WHERE rn <= 3',
)
def registry_list(spark, sf_dir):
    return lifecycle.backups(fx.registry(spark, sf_dir)).select("lang", "backup_id", "path", "index")


@query("registry_prune", _BACKUPS + "SELECT lang, backup_id, path FROM b WHERE rn > 3")
def registry_prune(spark, sf_dir):
    return lifecycle.pruned(fx.registry(spark, sf_dir)).select("lang", "backup_id", "path")


@query(
    "registry_deployed",
    fx.with_views(fx.REGISTRY_SQL)
    + """SELECT lang, backup_id, path FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY backup_id DESC) AS rn FROM registry WHERE kind = 'deploy')
WHERE rn = 1""",
)
def registry_deployed(spark, sf_dir):
    return lifecycle.deployed(fx.registry(spark, sf_dir)).select("lang", "backup_id", "path")


@query(
    "registry_restore",
    _BACKUPS
    + """, d AS (
  SELECT lang, path FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY backup_id DESC) AS rn FROM registry WHERE kind = 'deploy')
  WHERE rn = 1)
SELECT lang, 'deploy' AS kind, path FROM b WHERE rn = 2
UNION ALL SELECT lang, 'newest backup', path FROM d""",
)
def registry_restore(spark, sf_dir):
    """Roll both languages back to their second newest backup, then read the state off the log."""
    log = fx.registry(spark, sf_dir)
    at = datetime(2025, 1, 1)
    for lang in ("ko", "en"):
        log = log.unionByName(lifecycle.restore_rows(log, lang, 1, at))
    newest = lifecycle.backups(log).filter(F.col("index") == 0)
    return lifecycle.deployed(log).select("lang", F.lit("deploy").alias("kind"), "path").unionByName(
        newest.select("lang", F.lit("newest backup").alias("kind"), "path")
    )
