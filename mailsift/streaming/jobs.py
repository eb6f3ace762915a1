"""Streams over landed files. Each batch writes its own folder, so a replayed batch replaces itself."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mailsift.operators import jobs, lifecycle
from mailsift.schema import MESSAGES, RETRAIN_THRESHOLD, USER_REPORTS
from mailsift.sources.id_index import MERGE_FROM, SLOTS, IdIndex
from mailsift.sources.tables import read_or_empty
from mailsift.streaming import counter

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_BATCH = [T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())]
_STORED = T.StructType([*MESSAGES.fields, *_BATCH])
# A table, or what reads it anew for every batch.
Table = DataFrame | Callable[[], DataFrame]


def run_of(checkpoint: str) -> str:
    """Name of a run's folders. Batches are numbered per checkpoint, so each has folders of its own.

    Use a new checkpoint folder for a new run: a name used again replaces the old run's batches.
    """
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def _write_batch(rows: DataFrame, path: str, run: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")


def _now(table: Table) -> DataFrame:
    return table() if callable(table) else table


def stored_messages(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, _STORED)


def rejects_path(path: str) -> str:
    return f"{path}_rejects"


def stored_ids(spark: SparkSession, path: str, slots: int = SLOTS) -> IdIndex:
    """The index of the ids stored under ``path``."""
    return IdIndex(spark, f"{path}_ids", slots)


def stream_rejects(spark: SparkSession, path: str) -> DataFrame:
    """reject and row (JSON) of the mail the stream did not store."""
    schema = T.StructType([T.StructField("reject", T.StringType()), T.StructField("row", T.StringType()), *_BATCH])
    return read_or_empty(spark, rejects_path(path), schema)


def score_stream(
    mail: DataFrame, patterns: Table, scorer: jobs.Scorer, path: str, checkpoint: str,
    delay: str = "1 day", trigger: Mapping | None = None, slots: int = SLOTS,
) -> StreamingQuery:
    """Score arriving mail, each id once, into ``path``; mail without an id goes to ``path``'s rejects.

    Stored rows have an id (from the mail's id) and the time they were stored. ``patterns`` may be a
    function, called for every batch. ``trigger``: as for a stream writer, all that is there if not given.

    ``mail`` is a stream with gmail_id, pos and the mail fields. Ids repeated within ``delay`` of
    their arrival are dropped from bounded state (RocksDB, on disk); later repeats are caught by
    the comparison with the stored ids: an index of ``slots`` folders, of which a batch reads those its
    own ids fall in. Arrival time, not the mail's own time, drives the watermark, so no mail is ever
    late and none is lost. A store without an index gets one when the stream starts.
    """
    spark = mail.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    run = run_of(checkpoint)
    index = stored_ids(spark, path, slots)
    if not index.built():
        index.rebuild(stored_messages(spark, path), run)
    once = (
        # Mail without an id is no repeat of anything.
        mail.withColumn("_key", F.coalesce("gmail_id", F.expr("uuid()")))
        .withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", delay)
        .dropDuplicatesWithinWatermark(["_key"])
        .drop("_arrived", "_key")
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # asked for its ids, then scored
        try:
            refused = batch.filter(F.col("gmail_id").isNull())
            if refused.limit(1).count():
                row = F.to_json(F.struct(*batch.columns)).alias("row")
                _write_batch(refused.select(F.lit("no id").alias("reject"), row), rejects_path(path), run, batch_id)
            known = index.known(batch, run, batch_id)
            rows = jobs.scored_batch(batch, known, _now(patterns), scorer)
            made = {"id": F.xxhash64("gmail_id"), "created_at": F.localtimestamp()}
            made = {c: F.coalesce(c, v) if c in rows.columns else v for c, v in made.items()}
            _write_batch(rows.withColumns(made), path, run, batch_id)
            stored = batch.sparkSession.read.parquet(f"{path}/run={run}/batch={batch_id}")
            index.add(stored, run, batch_id)
            if batch_id % MERGE_FROM == MERGE_FROM - 1:
                index.compact(run, before=batch_id)
        finally:
            batch.unpersist()

    return (
        once.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def feedback_stream(
    reports: DataFrame, runs: Table, path: str, checkpoint: str, on_due=None, trigger: Mapping | None = None
) -> StreamingQuery:
    """Store arriving reports and, after each batch, work out which languages are due.

    ``on_due`` gets the due languages of a batch; logging the attempt it makes resets the count when
    ``runs`` is a function that reads the log, which is called for every batch.
    """
    stored = T.StructType([*USER_REPORTS.fields, *_BATCH])
    run = run_of(checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, f"{path}/reports", run, batch_id)
        seen = read_or_empty(batch.sparkSession, f"{path}/reports", stored)
        # A replay counts what it counted: all of other runs, this run's batches up to this one.
        seen = seen.filter((F.col("run") != run) | (F.col("batch") <= batch_id))
        due = lifecycle.retrain_due(seen, _now(runs))
        _write_batch(due, f"{path}/due", run, batch_id)
        if on_due is not None:
            on_due(due.filter("due"))

    return (
        reports.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def feedback_counter(
    reports: DataFrame, runs: DataFrame, path: str, checkpoint: str, on_due=None,
    threshold: int = RETRAIN_THRESHOLD, remind_ms: int | None = None, trigger: Mapping | None = None,
) -> StreamingQuery:
    """Count new reports per language in stream state; no batch reads earlier reports again.

    ``reports`` and ``runs`` are streams of the two tables: an attempt in ``runs`` resets its language.
    What the counter tells goes to ``path``; ``counter.latest`` makes the due table of it. ``on_due``
    gets the languages of a batch that are due, again every ``remind_ms`` while no attempt follows.
    """
    spark = reports.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    run = run_of(checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # a row for each language, written and handed on
        try:
            _write_batch(batch, path, run, batch_id)
            if on_due is not None:
                on_due(batch.filter("due"))
        finally:
            batch.unpersist()

    return (
        counter.counts(counter.events(reports, runs), threshold, remind_ms)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def tier_counts_stream(
    messages: DataFrame, path: str, checkpoint: str, trigger: Mapping | None = None
) -> StreamingQuery:
    """Running counts per verdict; each batch replaces the three-row table."""
    counts = messages.groupBy("predicted_label").agg(F.count(F.lit(1)).alias("n"))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
