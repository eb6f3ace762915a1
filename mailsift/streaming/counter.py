"""A counter of new feedback per language that is kept as stream state.

The reports are not read again: what each language's state holds is the time of its last attempt and
how many reports came for every later second or microsecond. A report or an attempt that comes late or
out of order counts as it would have in time, so the state always equals the count over the whole tables.

All reports of a language meet in its one state. They get there summed up: every task sends one number
for each time it has seen. The state holds the times as lists of two long arrays, added to by every batch and
merged when an attempt ends some or when what was added outgrows what was merged; no time is looked up singly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mailsift.functions.text import detect_lang
from mailsift.operators.lifecycle import LANGS, attempt_rows
from mailsift.schema import RETRAIN_THRESHOLD

# An event of a language: ``n`` reports of a time, or an attempt (n = 0). Times are microseconds.
EVENT = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType())]
)
OUT = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("since", T.LongType()),
        T.StructField("new_reports", T.LongType()),
        T.StructField("due", T.BooleanType()),
        T.StructField("reminder", T.BooleanType()),
    ]
)
# Stands for the time of a report without one: counted until there is an attempt.
NO_TIME = -(1 << 62)
ATTEMPT = 0
# Times in one list of the state.
CHUNK = 10_000
# Times that may be added before a merge, however few there were.
UNMERGED = 10 * CHUNK


def events(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """One stream of the events of reports and training runs, summed up within each task."""
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    counted = reports.select(
        detect_lang("content").alias("lang"), F.coalesce(micros, F.lit(NO_TIME)).alias("at"), F.lit(1).cast("long").alias("n")
    )
    tried = attempt_rows(runs).select(
        "lang", F.unix_micros(F.col("trained_at").cast("timestamp")).alias("at"), F.lit(ATTEMPT).cast("long").alias("n")
    )
    return counted.unionByName(tried.filter(F.col("at").isNotNull())).mapInArrow(_summed, EVENT)


def _grouped(rows: pa.Table) -> pa.Table:
    """Reports of one language and time as one row; of a language's attempts the last."""
    schema = to_arrow_schema(EVENT)
    tries = pc.equal(rows["n"], ATTEMPT)
    sums = rows.filter(pc.invert(tries)).group_by(["lang", "at"]).aggregate([("n", "sum")])
    last = rows.filter(tries).group_by(["lang"]).aggregate([("at", "max")])
    tried = [last["lang"], last["at_max"], pa.array([ATTEMPT] * len(last), pa.int64())]
    return pa.concat_tables(
        pa.Table.from_arrays(columns, names=schema.names).cast(schema) for columns in ([sums["lang"], sums["at"], sums["n_sum"]], tried)
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's events summed up, whole batches at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(_grouped(pa.Table.from_batches([batch])))
        size += len(held[-1])
        if size >= 100_000:  # bounded, whatever the times
            merged = _grouped(pa.concat_tables(held))
            held, size = [merged], len(merged)
            if size >= 50_000:
                yield from merged.to_batches()
                held, size = [], 0
    if held:
        yield from _grouped(pa.concat_tables(held)).to_batches()


def _by_time(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each time once, with all its reports."""
    times, place = np.unique(at, return_inverse=True)
    sums = np.zeros(len(times), np.int64)
    np.add.at(sums, place, n)
    return times, sums


class FeedbackCounter(StatefulProcessor):
    """State of one language: the last attempt, the reports after it by time, and their sum."""

    def __init__(self, threshold: int = RETRAIN_THRESHOLD, remind_ms: int | None = None):
        self.threshold, self.remind_ms = threshold, remind_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # ``merged`` and ``added`` are how many times the lists held after the last merge and got since.
        self.sums = handle.getValueState("sums", "since long, total long, merged long, added long")
        self.times = handle.getListState("times", "at array<long>, n array<long>")

    def _row(self, lang, since, total, reminder):
        row = {"lang": [lang], "since": [since], "new_reports": [total], "due": [total >= self.threshold], "reminder": [reminder]}
        frame = pd.DataFrame(row)
        frame["since"] = frame["since"].astype("Int64")
        return frame

    @staticmethod
    def _chunks(at: np.ndarray, n: np.ndarray) -> list[tuple]:
        return [(at[i : i + CHUNK].tolist(), n[i : i + CHUNK].tolist()) for i in range(0, len(at), CHUNK)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        since, total, merged, added = self.sums.get() if self.sums.exists() else (None, 0, 0, 0)
        was_due = total >= self.threshold
        tried, ats, ns = since, [], []
        for frame in rows:
            at, n = frame["at"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
            attempts = at[n == ATTEMPT]
            if len(attempts) and (tried is None or attempts.max() > tried):
                tried = int(attempts.max())
            ats.append(at[n != ATTEMPT])
            ns.append(n[n != ATTEMPT])
        at, n = _by_time(np.concatenate(ats), np.concatenate(ns))
        if tried != since or added + len(at) > max(merged, UNMERGED):
            # Reports up to the new attempt are done with.
            since = tried
            held = list(self.times.get()) if merged + added else []
            at = np.concatenate([at, *[np.array(c[0], np.int64) for c in held]])
            n = np.concatenate([n, *[np.array(c[1], np.int64) for c in held]])
            after = at > since if since is not None else np.ones(len(at), bool)
            at, n = _by_time(at[after], n[after])
            if held:
                self.times.clear()
            total, merged, added = int(n.sum()), len(at), 0
        else:
            after = at > since if since is not None else np.ones(len(at), bool)
            at, n = at[after], n[after]
            total, added = total + int(n.sum()), added + len(at)
        if len(at):
            self.times.appendList(self._chunks(at, n))
        self.sums.update((since, total, merged, added))
        if self.remind_ms is not None and total >= self.threshold and not was_due:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.remind_ms)
        yield self._row(key[0], since, total, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Say again that a language is due when no attempt has followed."""
        since, total, *_ = self.sums.get()
        if total >= self.threshold:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.remind_ms)
            yield self._row(key[0], since, total, True)

    def close(self) -> None:
        pass


def counts(events_: DataFrame, threshold: int = RETRAIN_THRESHOLD, remind_ms: int | None = None) -> DataFrame:
    """lang, since, new_reports, due and reminder of every language that a batch touches."""
    found = events_.groupBy("lang").transformWithStateInPandas(
        FeedbackCounter(threshold, remind_ms), OUT, "Update", "None" if remind_ms is None else "ProcessingTime"
    )
    return found.withColumn("since", F.timestamp_micros("since").cast("timestamp_ntz"))


def latest(spark: SparkSession, log: DataFrame) -> DataFrame:
    """lang, since, new_reports and due of every language, from the log of what the counter told."""
    last = log.groupBy("lang").agg(F.max_by(F.struct("since", "new_reports", "due"), F.struct("batch", ~F.col("reminder"))).alias("r"))
    every = spark.createDataFrame([(x,) for x in LANGS], "lang string")
    told = every.join(F.broadcast(last), "lang", "left")
    return told.select(
        "lang", "r.since", F.coalesce("r.new_reports", F.lit(0)).alias("new_reports"), F.coalesce("r.due", F.lit(False)).alias("due")
    )
