"""The index of stored ids, the scoring stream on it, and the feedback counter in stream state."""

import json
import os
import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailsift.operators import lifecycle
from mailsift.schema import TRAINING_RUNS, USER_REPORTS
from mailsift.sources.id_index import IdIndex
from mailsift.streaming import counter
from mailsift.streaming import jobs as streams

MAIL = "pos long, gmail_id string, sender string, subject string, body string, attachment string, spam_prob double"


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "gmail_id string")


def known(index, names, *but):
    return sorted(r["gmail_id"] for r in index.known(ids(index.spark, names), *but).collect())


# ---- index --------------------------------------------------------------------------------
def test_known_ids_and_replays(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path), slots=8)
    assert known(index, ["a"]) == []
    index.add(ids(spark, ["a", "b", None, "b"]), "r", 0)
    index.add(ids(spark, ["c", "a"]), "r", 1)
    assert known(index, ["a", "c", "z", None]) == ["a", "c"]
    assert known(index, ["a", "b", "c"], "r", 1) == ["a", "b"]
    index.add(ids(spark, ["c", "a"]), "r", 1)  # a replay replaces itself
    assert index.read(range(8)).count() == 4
    assert known(index, []) == []


def test_a_question_reads_its_own_folders_only(spark, tmp_path):
    """The cost of a batch follows its ids, not the number of batches and ids stored before."""
    index = IdIndex(spark, str(tmp_path), slots=32)
    for batch in range(3):
        index.add(ids(spark, [f"m{i}" for i in range(batch * 300, batch * 300 + 300)]), "r", batch)
    asked = ids(spark, ["m5", "new"])
    slots = index.slots_of(asked)
    assert len(slots) <= 2
    read = {f.split("slot=")[1].split("/")[0] for f in index.read(slots).inputFiles()}
    assert read <= set(map(str, slots))
    # The plan's file index lists those folders, and so no others.
    plan = index.known(asked)._jdf.queryExecution().toString()
    assert f"slot={{{','.join(map(str, slots))}}}" in plan or len(index.read(slots).inputFiles()) <= 3 * len(slots)
    assert known(index, ["m5", "new"]) == ["m5"]


def test_other_folders_may_even_be_unreadable(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path), slots=16)
    index.add(ids(spark, [f"m{i}" for i in range(100)]), "r", 0)
    keep = index.slots_of(ids(spark, ["m1"]))[0]
    for folder, _, files in os.walk(index.path):
        for name in files:
            if name.endswith(".parquet") and f"slot={keep}/" not in folder + "/":
                with open(os.path.join(folder, name), "wb") as f:
                    f.write(b"not parquet")
    assert known(index, ["m1"]) == ["m1"]


def test_compacting_keeps_all_ids(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path), slots=2)
    names = [f"m{i}" for i in range(40)]
    for batch in range(5):
        index.add(ids(spark, names[batch * 8 : batch * 8 + 8]), "r", batch)
    assert index.compact("r", before=4, merge_from=3) == [0, 1]
    runs = {(r["run"], r["batch"]) for r in index.read([0, 1]).select("run", "batch").distinct().collect()}
    assert runs == {("merged", 0), ("r", 4)}
    assert known(index, [*names, "z"]) == sorted(names)
    assert known(index, names, "r", 4) == sorted(names[:32])
    index.add(ids(spark, ["x"] + [f"y{i}" for i in range(9)]), "r", 5)
    assert index.compact("r", before=6, merge_from=2) and not index.compact("r", before=6, merge_from=2)
    assert known(index, [*names, "x"]) == sorted([*names, "x"])


# ---- scoring ------------------------------------------------------------------------------
def land(path, name, rows):
    os.makedirs(path, exist_ok=True)
    keys = [c.split()[0] for c in MAIL.split(", ")]
    with open(os.path.join(path, name), "w") as f:
        f.writelines(json.dumps(dict(zip(keys, r, strict=True))) + "\n" for r in rows)


def mail(i, gid):
    return (i, gid, "a@b.c", f"s{i}", "body", "", 0.5)


def score(spark, tmp_path, checkpoint="c1", slots=4):
    rows = spark.readStream.schema(MAIL).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    patterns = spark.createDataFrame([], "pattern string, note string")
    stream = streams.score_stream(rows, patterns, lambda b: b, str(tmp_path / "out"), str(tmp_path / checkpoint), slots=slots)
    stream.awaitTermination()
    assert stream.exception() is None


def stored(spark, tmp_path):
    return sorted((r["gmail_id"], r["content"]) for r in streams.stored_messages(spark, str(tmp_path / "out")).collect())


def test_each_id_once_and_none_without_trace(spark, tmp_path):
    land(tmp_path / "in", "1.json", [mail(1, "a"), mail(2, None), mail(3, None), mail(4, "a")])
    land(tmp_path / "in", "2.json", [mail(5, "b"), mail(6, "a"), mail(7, None)])
    score(spark, tmp_path)
    land(tmp_path / "in", "3.json", [mail(8, "c"), mail(9, "b")])
    score(spark, tmp_path)
    assert [g for g, _ in stored(spark, tmp_path)] == ["a", "b", "c"]
    rejects = streams.stream_rejects(spark, str(tmp_path / "out")).collect()
    assert sorted(json.loads(r["row"])["pos"] for r in rejects) == [2, 3, 7]
    assert {r["reject"] for r in rejects} == {"no id"}
    # A new run over the same files stores nothing again: the index knows the ids of the old run.
    score(spark, tmp_path, "c2")
    assert [g for g, _ in stored(spark, tmp_path)] == ["a", "b", "c"]


def test_a_store_without_an_index_gets_one(spark, tmp_path):
    land(tmp_path / "in", "1.json", [mail(1, "a")])
    score(spark, tmp_path)
    land(tmp_path / "in", "2.json", [mail(2, "a"), mail(3, "b")])
    score(spark, tmp_path, "c2", slots=8)  # another number of slots is another index
    assert [g for g, _ in stored(spark, tmp_path)] == ["a", "b"]


def test_a_replayed_batch_stores_the_same(spark, tmp_path):
    land(tmp_path / "in", "1.json", [mail(1, "a"), mail(2, "b")])
    score(spark, tmp_path)
    before = stored(spark, tmp_path)
    # As if the batch had failed after it was stored: its commit is gone, so it runs again.
    for name in ("0", ".0.crc"):
        if (tmp_path / "c1" / "commits" / name).exists():
            os.remove(tmp_path / "c1" / "commits" / name)
    score(spark, tmp_path)
    assert stored(spark, tmp_path) == before


# ---- counter ------------------------------------------------------------------------------
START = datetime(2024, 1, 1)


def report(i, minutes, korean=False):
    at = None if minutes is None else START + timedelta(minutes=minutes)
    return (i, "안녕" if korean else "hello", "spam", None, at)


def run(i, minutes, version="en-v1"):
    return (i, version, 1, 1, 0.5, 0.5, 0.5, 0.5, START + timedelta(minutes=minutes))


class Arrivals:
    """Reports and runs that land bit by bit, counted by one stream started anew for each."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.told = spark, tmp_path, []
        self.reports, self.runs, self.bits = [], [], 0
        for name in ("reports", "runs"):
            os.makedirs(tmp_path / name)

    def land(self, reports=(), runs=()):
        self.bits += 1
        for name, rows, schema, all_ in (("reports", reports, USER_REPORTS, self.reports), ("runs", runs, TRAINING_RUNS, self.runs)):
            all_ += rows
            if rows:
                self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(self.path / name))

    def count(self, **how):
        def read(name, schema):
            return self.spark.readStream.schema(schema).parquet(str(self.path / name))

        stream = streams.feedback_counter(
            read("reports", USER_REPORTS), read("runs", TRAINING_RUNS), str(self.path / "told"), str(self.path / "check"),
            on_due=lambda due: self.told.append(sorted(r["lang"] for r in due.collect())), **how,
        )
        if "trigger" not in how:
            stream.awaitTermination()
            assert stream.exception() is None
        return stream

    def agrees(self):
        """The state's counts are those of the whole tables."""
        log = self.spark.read.parquet(str(self.path / "told"))
        got = {r["lang"]: (r["since"], r["new_reports"], r["due"]) for r in counter.latest(self.spark, log).collect()}
        reports = self.spark.createDataFrame(self.reports, USER_REPORTS)
        runs = self.spark.createDataFrame(self.runs, TRAINING_RUNS)
        want = {r["lang"]: (r["since"], r["new_reports"], r["due"]) for r in lifecycle.retrain_due(reports, runs).collect()}
        assert got == want
        return {k: v[1:] for k, v in got.items()}


def test_counts_over_attempts_and_late_rows(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    a.land([report(i, i) for i in range(3)] + [report(9, None), report(10, 5, korean=True)])
    a.count()
    assert a.agrees() == {"en": (4, False), "ko": (1, False)}
    a.land([report(11, 1), report(12, 30)])
    a.count()
    assert a.agrees()["en"] == (6, True)
    a.land([report(13, 2), report(14, 20)], [run(1, 10)])  # the attempt ends what came up to it
    a.count()
    assert a.agrees()["en"] == (2, False)
    a.land([report(15, 10), report(16, 11)], [run(2, 4), run(3, 99, "other")])  # late report, late attempt
    a.count()
    assert a.agrees()["en"] == (3, False)
    a.land([report(20 + i, 40 + i) for i in range(2)], [run(4, 12, "en-v1-skipped"), run(5, 3, "v1")])
    a.count()
    assert a.agrees() == {"en": (4, False), "ko": (1, False)}
    assert ["en"] in a.told


@pytest.mark.parametrize("seed", [1])
def test_any_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    a = Arrivals(spark, tmp_path)
    for bit in range(4):
        reports = [report(bit * 100 + i, rng.choice([None, *range(200)]), rng.random() < 0.3) for i in range(40)]
        versions = ["en-v1", "v1", "v1-skipped", "other"]
        a.land(reports, [run(bit * 10 + i, rng.randrange(150), rng.choice(versions)) for i in range(rng.randrange(3))])
        a.count()
        if a.runs:
            a.agrees()


class State:
    """A value, list or map state that counts the calls it gets."""

    def __init__(self, calls):
        self.value, self.rows, self.calls = None, [], calls

    def __getattr__(self, name):
        raise AssertionError(f"{name}: times are not looked up singly")

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return iter(list(self.rows)) if self.value is None else self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.rows = []

    def appendList(self, rows):
        self.calls.append("append")
        self.rows += rows


def test_calls_to_the_state_do_not_grow_with_the_times(monkeypatch):
    """Some calls a batch, for thousands of times as for few; merged lists hold each time once."""
    monkeypatch.setattr(counter, "UNMERGED", 3000)
    calls, told = [], []
    made = counter.FeedbackCounter(threshold=5)
    made.sums, made.times = State([]), State(calls)
    rng, kept, since = random.Random(4), [], None
    for batch in range(12):
        at = [rng.randrange(4000) for _ in range(2000)] + [counter.NO_TIME]
        kept += at
        attempts = [rng.randrange(2000)] if batch in (3, 4, 8) else []
        since = max([x for x in (since, *attempts) if x is not None], default=None)
        frames = [pd.DataFrame({"at": at + attempts, "n": [1] * len(at) + [0] * len(attempts)})]
        (row,) = made.handleInputRows(("en",), frames, None)
        told.append(row["new_reports"][0])
        assert told[-1] == sum(since is None or x > since for x in kept)
    assert len(calls) <= 12 * 3 and max(len(r[0]) for r in made.times.rows) <= counter.CHUNK
    assert sum(len(r[0]) for r in made.times.rows) <= 2 * 4001 + 3000


def test_reminders_while_no_attempt_follows(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    a.land([report(i, i) for i in range(6)], [run(1, -10)])
    stream = a.count(remind_ms=500, trigger={"processingTime": "200 milliseconds"})
    until = time.time() + 60
    while sum(t == ["en"] for t in a.told) < 3 and time.time() < until:
        time.sleep(0.5)
    stream.stop()
    assert sum(t == ["en"] for t in a.told) >= 3
    log = spark.read.parquet(str(tmp_path / "told"))
    assert log.filter("reminder").count() >= 2 and log.filter("NOT reminder").count() == 1
    assert log.filter(F.col("new_reports") != 6).count() == 0
