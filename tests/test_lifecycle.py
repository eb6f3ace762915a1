from datetime import datetime, timedelta

import pytest

from mailsift.operators import lifecycle
from mailsift.sources.tables import Store

T0 = datetime(2024, 1, 1)


def log(spark, tmp_path):
    return Store(spark, str(tmp_path))


def put(store, lang, path, n):
    rows = lifecycle.replace_rows(store.read("registry"), lang, path, T0 + timedelta(seconds=n))
    store.append("registry", rows)


def paths(store, lang="ko", keep=2):
    rows = lifecycle.backups(store.read("registry").filter(f"lang = '{lang}'"), keep)
    return [r["path"] for r in rows.orderBy("index").collect()]


def in_use(store, lang="ko"):
    return lifecycle.deployed(store.read("registry").filter(f"lang = '{lang}'")).first()["path"]


def test_first_deploy_has_nothing_to_back_up(spark, tmp_path):
    store = log(spark, tmp_path)
    put(store, "ko", "m1", 0)
    assert paths(store) == []
    assert in_use(store) == "m1"


def test_replace_backs_up_and_prunes(spark, tmp_path):
    store = log(spark, tmp_path)
    for i in range(5):
        put(store, "ko", f"m{i}", i)
    put(store, "en", "e0", 9)
    assert paths(store) == ["m3", "m2"]
    gone = lifecycle.pruned(store.read("registry"), 2).collect()
    assert sorted(r["path"] for r in gone) == ["m0", "m1"]


def test_restore_can_be_undone(spark, tmp_path):
    store = log(spark, tmp_path)
    put(store, "ko", "v1", 0)
    put(store, "ko", "v2", 1)
    store.append("registry", lifecycle.restore_rows(store.read("registry"), "ko", 0, T0 + timedelta(seconds=2)))
    assert in_use(store) == "v1"
    assert paths(store) == ["v2", "v1"]
    store.append("registry", lifecycle.restore_rows(store.read("registry"), "ko", 0, T0 + timedelta(seconds=3)))
    assert in_use(store) == "v2"


def test_restoring_the_oldest_kept_backup(spark, tmp_path):
    store = log(spark, tmp_path)
    for i in range(4):
        put(store, "ko", f"m{i}", i)
    rows = lifecycle.restore_rows(store.read("registry"), "ko", 2, T0 + timedelta(seconds=9), keep=3)
    store.append("registry", rows)
    assert in_use(store) == "m0"


def test_bad_index_raises(spark, tmp_path):
    with pytest.raises(ValueError):
        lifecycle.restore_target(log(spark, tmp_path).read("registry"), "ko", 5)


def runs(spark, *rows):
    df = spark.createDataFrame(list(rows) or [(0, "none", 0.0, T0)], "id long, model_version string, f1_score double, trained_at timestamp_ntz")
    return df if rows else df.limit(0)


def test_gate(spark):
    history = runs(
        spark, (1, "v1", 0.955, T0), (2, "v1", 0.96, T0 + timedelta(days=1)), (3, "v1-skipped", 0.2, T0 + timedelta(days=2))
    )
    tries = spark.createDataFrame(
        [("ko", 0.96 - 0.02), ("ko", 0.9399), ("en", 0.0)], "lang string, new_f1 double"
    )
    got = {(r["lang"], r["new_f1"]): (r["decision"], r["log_version"], r["old_f1"]) for r in lifecycle.promotion_gate(tries, history).collect()}
    assert got[("ko", 0.96 - 0.02)] == ("promoted", "v1", 0.96)
    assert got[("ko", 0.9399)] == ("skipped_regression", "v1-skipped", 0.96)
    assert got[("en", 0.0)] == ("promoted", "en-v1", -1.0)


def test_due_counts_strictly_newer_reports(spark):
    history = runs(spark, (1, "v1", 0.9, T0), (2, "v1-skipped", 0.5, T0 + timedelta(days=1)))
    reports = spark.createDataFrame(
        [(i, "안녕", T0 + timedelta(days=1, minutes=i)) for i in range(6)]
        + [(10 + i, "hello", T0 - timedelta(days=i)) for i in range(5)],
        "id long, content string, created_at timestamp_ntz",
    )
    got = {r["lang"]: (r["new_reports"], r["due"]) for r in lifecycle.retrain_due(reports, history).collect()}
    assert got == {"ko": (5, True), "en": (5, True)}
    none = {r["lang"]: (r["new_reports"], r["due"]) for r in lifecycle.retrain_due(reports.limit(0), history).collect()}
    assert none == {"ko": (0, False), "en": (0, False)}


def test_pruning_spares_the_model_in_use(spark):
    at = datetime(2024, 1, 1)
    rows = [("ko", f"b{i}", f"m{i}", "backup", at) for i in range(4)] + [("ko", "b4", "m4", "backup", at), ("ko", "b5", "m0", "deploy", at)]
    registry = spark.createDataFrame(rows, lifecycle.REGISTRY)
    assert [r["path"] for r in lifecycle.pruned(registry).collect()] == ["m1"]


def test_new_reports_are_counted_without_a_limit(spark):
    at = datetime(2024, 1, 1)
    rows = [(i, "안녕 하세요", "spam", None, at) for i in range(6)]
    rows += [(100 + i, "hello there", "spam", None, datetime(2024, 1, 2)) for i in range(20)]
    reports = spark.createDataFrame(rows, "id long, content string, user_label string, note string, created_at timestamp_ntz")
    runs = spark.createDataFrame([], "model_version string, trained_at timestamp_ntz")
    got = {r["lang"]: r["new_reports"] for r in lifecycle.new_feedback(reports, runs).collect()}
    assert got == {"ko": 6, "en": 20}
