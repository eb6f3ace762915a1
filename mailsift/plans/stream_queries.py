"""Streams over the same tables, written as arriving files; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.plans import fixtures as fx
from mailsift.plans.ingest_queries import scratch
from mailsift.plans.lifecycle_queries import DUE_SQL, TS
from mailsift.plans.mail_queries import _OVERRIDDEN, _STORED
from mailsift.plans.registry import query
from mailsift.sources.id_index import IdIndex
from mailsift.streaming import counter
from mailsift.streaming import jobs as streams

SLICES = 4
# Folders of the id index: few, as the test tables are small.
SLOTS = 16


def arriving(rows: DataFrame, spark: SparkSession, what: str, repeat: bool = False) -> DataFrame:
    """A stream over ``rows`` landed in SLICES files of time order; optionally some rows twice."""
    path = scratch(spark, what)
    span = rows.agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi")).first()
    step = (span["hi"] - span["lo"]) / SLICES
    bounds = [span["lo"] + step * i for i in range(SLICES)]
    for i, low in enumerate(bounds):
        part = rows.filter(F.col("created_at") >= low)
        if i + 1 < len(bounds):
            part = part.filter(F.col("created_at") < bounds[i + 1])
        if repeat and i:
            again = rows.filter((F.col("created_at") < low) & (F.col("id") % 10 == 1))
            part = part.unionByName(again.filter(F.col("created_at") >= bounds[i - 1]))
        part.write.mode("append").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    per_batch = max(files // SLICES, 1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _finish(stream) -> None:
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


@query("stream_scoring", _OVERRIDDEN + _STORED)
def stream_scoring(spark, sf_dir):
    """Mail arriving in four files with repeated ids; each id is stored once."""
    rows = fx.mail(spark, sf_dir).drop("predicted_label", "source", "actioned")
    rows = rows.withColumn("pos", F.col("id")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    path = scratch(spark, "scored")
    _finish(
        streams.score_stream(
            arriving(rows, spark, "mail", repeat=True),
            fx.trusted_senders(spark),
            lambda batch: batch,  # the rows carry a stand-in score
            path,
            scratch(spark, "checkpoint"),
            slots=SLOTS,
        )
    )
    return streams.stored_messages(spark, path).select(
        "source", "gmail_id", "sender", "content", "predicted_label", "spam_prob", "model_version", "actioned"
    )


@query("stream_feedback", DUE_SQL)
def stream_feedback(spark, sf_dir):
    """Reports arriving in four files; the last batch's due table."""
    path = scratch(spark, "feedback")
    reports = arriving(fx.user_reports(spark, sf_dir), spark, "reports")
    _finish(
        streams.feedback_stream(reports, fx.training_runs(spark, sf_dir), path, scratch(spark, "checkpoint"))
    )
    due = spark.read.parquet(f"{path}/due")
    last = due.agg(F.max("batch")).scalar()
    return due.filter(F.col("batch") == last).select(
        "lang", F.date_format("since", TS).alias("since"), "new_reports", "due"
    )


@query("stream_feedback_counter", DUE_SQL)
def stream_feedback_counter(spark, sf_dir):
    """Reports and training runs arriving in four files each; the state's counts after the last."""
    path = scratch(spark, "counter")
    reports = arriving(fx.user_reports(spark, sf_dir), spark, "reports")
    runs = fx.training_runs(spark, sf_dir)
    runs = arriving(runs.withColumn("created_at", F.col("trained_at")), spark, "runs")
    _finish(streams.feedback_counter(reports, runs, path, scratch(spark, "checkpoint")))
    return counter.latest(spark, spark.read.parquet(path)).withColumn("since", F.date_format("since", TS))


@query(
    "stream_rejects",
    fx.with_views(fx.MAIL_SQL) + "SELECT 'no id' AS reject, id FROM mail WHERE gmail_id IS NULL",
)
def stream_rejects(spark, sf_dir):
    """Arriving mail without an id is kept as a reject, once a row."""
    rows = fx.mail(spark, sf_dir).select("id", "gmail_id", "sender", "subject", "body", "attachment", "spam_prob", "created_at")
    rows = rows.withColumn("pos", F.col("id")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    path = scratch(spark, "scored")
    _finish(
        streams.score_stream(
            arriving(rows, spark, "mail"), fx.trusted_senders(spark), lambda batch: batch, path,
            scratch(spark, "checkpoint"), slots=SLOTS,
        )
    )
    return streams.stream_rejects(spark, path).select("reject", F.get_json_object("row", "$.id").cast("bigint").alias("id"))


@query(
    "stored_id_index",
    fx.with_views(fx.MAIL_SQL, fx.PICKED_SQL)
    + """SELECT DISTINCT gmail_id FROM mail WHERE id % 4 <> 3
AND gmail_id IN (SELECT gmail_id FROM picked UNION ALL SELECT 'absent' || gmail_id FROM picked)""",
)
def stored_id_index(spark, sf_dir):
    """Which of the picked ids four batches have stored, asked as a replay of the last one would."""
    index = IdIndex(spark, scratch(spark, "ids"), slots=SLOTS)
    mail = fx.mail(spark, sf_dir)
    for batch in range(4):
        index.add(mail.filter(F.col("id") % 4 == batch), "run", batch)
    index.compact("run", before=3, merge_from=2)
    picked = fx.picked_ids(spark, sf_dir)
    asked = picked.unionByName(picked.select(F.concat(F.lit("absent"), "gmail_id").alias("gmail_id")))
    return index.known(asked, "run", 3)


@query(
    "stream_stats",
    fx.with_views(fx.MAIL_SQL) + "SELECT predicted_label, count(*) AS n FROM mail GROUP BY predicted_label",
)
def stream_stats(spark, sf_dir):
    path = scratch(spark, "stats")
    mail = arriving(fx.mail(spark, sf_dir).select("id", "predicted_label", "created_at"), spark, "verdicts")
    _finish(streams.tier_counts_stream(mail, path, scratch(spark, "checkpoint")))
    return spark.read.parquet(path)
