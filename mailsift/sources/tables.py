"""Stored tables: reading, appending, schema set-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift import schema as S


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty one of ``schema`` when there is none yet."""
    try:
        found = spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return S.conform(found, schema)


def log_order() -> Column:
    """An id that orders a log of pattern and op: time of the write, then removals after additions.

    The microsecond of the write stands first, then ten bits of the pattern's hash, which tell
    patterns of one write apart, and one bit for a removal.
    """
    micros = F.shiftleft(F.unix_micros(F.current_timestamp()), 11)
    own = F.shiftleft(F.pmod(F.xxhash64("pattern"), F.lit(1024)), 1)
    return micros + own + (F.col("op") == "remove").cast("long")


class Store:
    """The message store as append-only parquet tables under one shared folder.

    Rows are never changed in place: an action, a removed pattern or a rollback is one more row,
    and the current state is a query over the log.
    """

    ACTIONS = T.StructType(
        [T.StructField("gmail_id", T.StringType()), T.StructField("acted_at", T.TimestampNTZType())]
    )
    TRUST_LOG = T.StructType([*S.TRUSTED_SENDERS.fields, T.StructField("op", T.StringType())])
    REJECTS = T.StructType(
        [
            T.StructField("table_name", T.StringType()),
            T.StructField("reason", T.StringType()),
            T.StructField("row", T.StringType()),
            T.StructField("created_at", T.TimestampNTZType()),
        ]
    )
    TABLES: Mapping[str, T.StructType] = {
        "messages": S.MESSAGES,
        "user_reports": S.USER_REPORTS,
        "training_runs": S.TRAINING_RUNS,
        "trust_log": TRUST_LOG,
        "action_log": ACTIONS,
        "registry": S.REGISTRY,
        "rejects": REJECTS,
    }
    DEFAULTS: Mapping[str, Mapping[str, object]] = {"messages": S.MESSAGE_DEFAULTS}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return read_or_empty(self.spark, self.path(name), self.TABLES[name])

    def ready(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows in the table's shape: defaults filled, time stamped, id hashed from the row."""
        target = self.TABLES[name]
        for stamp in ("created_at", "trained_at", "acted_at"):
            if stamp in target.fieldNames() and stamp not in rows.columns:
                rows = rows.withColumn(stamp, F.localtimestamp())
        if "id" in target.fieldNames() and "id" not in rows.columns:
            rows = rows.withColumn("id", log_order() if name == "trust_log" else F.xxhash64(*rows.columns))
        return S.conform(rows, target, self.DEFAULTS.get(name))

    def append(self, name: str, rows: DataFrame) -> None:
        """Append rows in the table's shape; those with a value that does not cast go to the rejects, whole.

        Where types can fail to cast, ``rows`` is read twice.
        """
        failed = S.failed_casts(rows, self.TABLES[name])
        if failed is not None:
            marked = rows.withColumn("_failed", failed)
            bad = marked.filter("_failed <> ''")
            if bad.limit(1).count():
                row = F.to_json(F.struct(*rows.columns)).alias("row")
                reason = F.concat(F.lit("does not cast: "), "_failed").alias("reason")
                self.append("rejects", bad.select(F.lit(name).alias("table_name"), reason, row))
                rows = marked.filter("_failed = ''").drop("_failed")
        self.ready(name, rows).write.mode("append").parquet(self.path(name))


def save_rejects(store: Store, name: str, rows: DataFrame, reason: Column) -> None:
    """Log rows that table ``name`` does not take, whole, with the reason."""
    row = F.to_json(F.struct(*rows.columns))
    store.append("rejects", rows.select(F.lit(name).alias("table_name"), reason.alias("reason"), row.alias("row")))


def _append_in_domain(store: Store, name: str, rows: DataFrame, column: str, allowed: Sequence[str]) -> None:
    good, bad = S.split_domain(rows, column, allowed)
    store.append(name, good)
    save_rejects(store, name, bad, F.concat(F.lit(f"{column}: "), F.coalesce(column, F.lit("null"))))


def save_predictions(store: Store, rows: DataFrame) -> None:
    """Append scored messages; those with a label outside the domain go to the rejects table.

    ``rows`` is read twice: hand in a written table when it is costly.
    """
    _append_in_domain(store, "messages", rows, "predicted_label", S.TIER_LABELS)


def save_reports(store: Store, rows: DataFrame) -> None:
    """As ``save_predictions``, for user reports."""
    _append_in_domain(store, "user_reports", rows, "user_label", S.REPORT_LABELS)


def reject_counts(store: Store) -> DataFrame:
    """table_name, reason, n."""
    return store.read("rejects").groupBy("table_name", "reason").agg(F.count(F.lit(1)).alias("n"))


def save_run(store: Store, version: str, train_size: int, test_size: int, scores: DataFrame) -> None:
    """Append one training run from a one-row ``metrics`` frame."""
    store.append(
        "training_runs",
        scores.select(
            F.lit(version).alias("model_version"),
            F.lit(train_size).alias("train_size"),
            F.lit(test_size).alias("test_size"),
            "accuracy",
            F.col("precision").alias("precision_val"),
            F.col("recall").alias("recall_val"),
            F.col("f1").alias("f1_score"),
        ),
    )
