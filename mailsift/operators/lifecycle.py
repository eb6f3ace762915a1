"""Feedback and model lifecycle on tables: retrain due, promotion gate, registry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsift.functions.text import detect_lang
from mailsift.operators.scaling import first_by, lookup_join
from mailsift.schema import (
    MAX_BACKUPS,
    MAX_F1_DROP,
    REGISTRY,
    RETRAIN_THRESHOLD,
    RUN_VERSION,
    SKIPPED_SUFFIX,
)

LANGS = tuple(RUN_VERSION)


def _latest_first():
    return F.desc("trained_at"), F.desc("id")


def _lang_of_version():
    """Language of a promoted run's version; null for other versions."""
    out = F.when(F.lit(False), "")
    for lang, version in RUN_VERSION.items():
        out = out.when(F.col("model_version") == version, lang)
    return out


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each model version."""
    return first_by(runs, ["model_version"], _latest_first())


def latest_promoted(runs: DataFrame) -> DataFrame:
    """Per language the F1 of the latest deployed run."""
    rows = runs.filter(F.col("model_version").isin(*RUN_VERSION.values()))
    rows = rows.withColumn("lang", _lang_of_version())
    return first_by(rows, ["lang"], _latest_first()).select(
        "lang", F.col("f1_score").alias("old_f1"), "trained_at"
    )


def attempt_rows(runs: DataFrame) -> DataFrame:
    """lang and trained_at of every attempt, deployed or skipped."""
    versions = [v + suffix for v in RUN_VERSION.values() for suffix in ("", SKIPPED_SUFFIX)]
    base = F.regexp_replace("model_version", SKIPPED_SUFFIX + "$", "")
    return (
        runs.filter(F.col("model_version").isin(versions))  # reaches the scan
        .withColumn("model_version", base)
        .select(_lang_of_version().alias("lang"), "trained_at")
    )


def latest_attempts(runs: DataFrame) -> DataFrame:
    """Per language the time of the latest attempt, deployed or skipped."""
    return attempt_rows(runs).groupBy("lang").agg(F.max("trained_at").alias("since"))


def _each_lang(spark) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LANGS], "lang string")


def new_feedback(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """Per language the number of reports newer than the last attempt, over all reports.

    Language is read off the stored content. Two rows of attempt times are broadcast, and the
    reports are counted where they are read.
    """
    since = latest_attempts(runs)
    counted = (
        reports.select("created_at", detect_lang("content").alias("lang")).join(F.broadcast(since), "lang", "left")
        .filter(F.col("since").isNull() | (F.col("created_at") > F.col("since")))
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("new_reports"))
    )
    return (
        _each_lang(reports.sparkSession)
        .join(F.broadcast(counted), "lang", "left")
        .join(F.broadcast(since), "lang", "left")
        .select("lang", "since", F.coalesce("new_reports", F.lit(0)).alias("new_reports"))
    )


def retrain_due(
    reports: DataFrame, runs: DataFrame, threshold: int = RETRAIN_THRESHOLD
) -> DataFrame:
    return new_feedback(reports, runs).withColumn("due", F.col("new_reports") >= threshold)


def promotion_gate(candidates: DataFrame, runs: DataFrame, drop: float = MAX_F1_DROP) -> DataFrame:
    """Per candidate (lang, new_f1): promote unless F1 fell by more than ``drop``.

    Without an earlier run the bar is -1. ``log_version`` is the version its run is logged under.
    """
    bar = latest_promoted(runs).select("lang", "old_f1")
    version = F.when(F.lit(False), "")
    for lang, name in RUN_VERSION.items():
        version = version.when(F.col("lang") == lang, name)
    gated = candidates.join(F.broadcast(bar), "lang", "left").withColumn(
        "old_f1", F.coalesce("old_f1", F.lit(-1.0))
    )
    ok = F.col("new_f1") >= F.col("old_f1") - drop
    return gated.withColumn("decision", F.when(ok, "promoted").otherwise("skipped_regression")).withColumn(
        "log_version", F.when(ok, version).otherwise(F.concat(version, F.lit(SKIPPED_SUFFIX)))
    )


# ---- registry -----------------------------------------------------------------------------
# The registry is an append-only log. Model folders are written once and never moved: a 'deploy'
# row points at the folder in use, a 'backup' row remembers one that was replaced.
def deployed(registry: DataFrame) -> DataFrame:
    """The model in use per language: the newest deploy row."""
    rows = registry.filter(F.col("kind") == "deploy")
    return first_by(rows, ["lang"], [F.desc("backup_id")])


def backups(registry: DataFrame, keep: int = MAX_BACKUPS) -> DataFrame:
    """The newest ``keep`` backups per language, index 0 the newest."""
    rows = registry.filter(F.col("kind") == "backup")
    w = Window.partitionBy("lang").orderBy(F.desc("backup_id"))
    return (
        rows.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= keep)
        .withColumn("index", (F.col("_rn") - 1).cast("int"))
        .drop("_rn")
    )


def pruned(registry: DataFrame, keep: int = MAX_BACKUPS) -> DataFrame:
    """Backups beyond the newest ``keep`` per language whose folders may be deleted.

    A rollback deploys a backup's folder, which then stands in the log twice: folders in use and
    folders of kept backups are never listed.
    """
    oldest_kept = (
        backups(registry, keep)
        .filter(F.col("index") == keep - 1)
        .select("lang", F.col("backup_id").alias("_oldest"))
    )
    rows = registry.filter(F.col("kind") == "backup")
    needed = deployed(registry).select("path").unionByName(backups(registry, keep).select("path")).distinct()
    return (
        lookup_join(rows, oldest_kept, ["lang"], "inner")
        .filter(F.col("backup_id") < F.col("_oldest"))
        .select(*registry.columns)
        .join(needed, "path", "left_anti")
        .select(*registry.columns)
    )


def _log_row(spark, lang: str, path: str, kind: str, at: datetime, n: int) -> DataFrame:
    row_id = at.strftime("%Y%m%d_%H%M%S_") + f"{at.microsecond:06d}{n:03d}"
    return spark.createDataFrame([(lang, row_id, path, kind, at)], REGISTRY)


def replace_rows(registry: DataFrame, lang: str, path: str, at: datetime) -> DataFrame:
    """Log rows that put ``path`` in use; the model it replaces, if any, becomes a backup."""
    spark = registry.sparkSession
    rows = _log_row(spark, lang, path, "deploy", at, 1)
    current = deployed(registry.filter(F.col("lang") == lang)).first()
    if current is not None:
        rows = _log_row(spark, lang, current["path"], "backup", at, 0).unionByName(rows)
    return rows


def restore_target(registry: DataFrame, lang: str, index: int = 0, keep: int = MAX_BACKUPS) -> str:
    """Path of the ``index``-th newest backup; the choice is made before anything is pruned."""
    kept = backups(registry.filter(F.col("lang") == lang), keep)
    hit = kept.filter(F.col("index") == index).first()
    if hit is None:
        raise ValueError(f"{lang} has {kept.count()} backups, index {index} does not exist")
    return hit["path"]


def restore_rows(
    registry: DataFrame, lang: str, index: int, at: datetime, keep: int = MAX_BACKUPS
) -> DataFrame:
    """Log rows of a rollback: the current model is backed up first, so it can be undone."""
    return replace_rows(registry, lang, restore_target(registry, lang, index, keep), at)
