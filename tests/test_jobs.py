from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailsift.operators import jobs
from mailsift.operators.model import score_routed, train_and_evaluate
from mailsift.sources.csv_files import with_target
from mailsift.sources.tables import Store, save_reports
from mailsift.streaming import jobs as streams


def corpus(spark):
    n = F.col("id")
    spam = n % 2 == 0
    ko = F.when(spam, F.concat(F.lit("무료 당첨 대출 "), n)).otherwise(F.concat(F.lit("회의 일정 안내 "), n))
    en = F.when(spam, F.concat(F.lit("free prize winner "), n)).otherwise(F.concat(F.lit("meeting notes agenda "), n))
    rows = spark.range(160).select(
        "id",
        F.when(spam, "spam").otherwise("ham").alias("label"),
        F.when(n < 80, ko).otherwise(en).alias("text"),
        F.when(n < 80, "ko").otherwise("en").alias("lang"),
    )
    return {lang: with_target(rows.filter(F.col("lang") == lang)) for lang in ("ko", "en")}


@pytest.fixture(scope="module")
def trained(spark):
    no_reports = Store(spark, "/nonexistent").read("user_reports")
    return {lang: train_and_evaluate(rows, no_reports, lang, 10) for lang, rows in corpus(spark).items()}


FIELDS = "gmail_id string, pos long, subject string, sender string, body string, attachment string"
MAIL = [
    ("g1", 0, "무료 당첨", "x@bad.com", "대출", ""),
    ("g2", 1, "free prize", "x@bad.com", "winner", ""),
    ("g3", 2, "free prize", "Boss <boss@mail.good.com>", "winner", "a.pdf"),
    ("g4", 3, "meeting", None, "notes agenda", ""),
    ("g1", 4, "again", "x@bad.com", "again", ""),
]


def test_models_learn_the_split(trained):
    for _, scores, n_train, n_test in trained.values():
        assert scores.first()["accuracy"] == 1.0
        assert (n_train, n_test) == (64, 16)


def test_missing_model_is_an_error(spark, trained):
    rows = spark.createDataFrame([("ko", "안녕"), ("en", "hi")], "lang string, text string")
    only = {"ko": trained["ko"][0]}
    assert score_routed(rows.filter("lang = 'ko'"), only).count() == 1
    with pytest.raises(Exception, match="no model for language en"):
        score_routed(rows, only).collect()


def test_mailbox_pass(spark, trained, tmp_path):
    store = Store(spark, str(tmp_path))
    for i, (lang, result) in enumerate(trained.items()):
        jobs.deploy(store, lang, result[0], datetime(2024, 1, 1, 0, 0, i))
    store.append("trust_log", spark.createDataFrame([(1, "good.com", "n", "add")], "id long, pattern string, note string, op string"))
    fetched = spark.createDataFrame(MAIL, FIELDS)
    models = jobs.load_models(store)
    assert jobs.mailbox_pass(store, fetched, models) == (4, 5)
    assert jobs.mailbox_pass(store, fetched, models) == (0, 5)
    got = {r["gmail_id"]: r for r in store.read("messages").collect()}
    assert {k: v["predicted_label"] for k, v in got.items()} == {"g1": "spam", "g2": "spam", "g3": "ham", "g4": "ham"}
    assert (got["g3"]["spam_prob"], got["g1"]["model_version"], got["g2"]["model_version"]) == (0.0, "v1", "v1-en")
    assert got["g1"]["content"] == "무료 당첨 대출"
    reported, _ = jobs.mark_not_spam(store, spark.createDataFrame([("g1",), ("g9",)], "gmail_id string"))
    assert reported == 1
    report = store.read("user_reports").first()
    assert (report["content"], report["user_label"], report["note"]) == ("무료 당첨 대출", "ham", "gmail_not_spam")


def test_retrain_round(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    sets = corpus(spark)
    assert jobs.retrain_round(store, sets) == {}
    reports = spark.range(5).select(F.concat(F.lit("무료 신고 "), "id").alias("content"), F.lit("spam").alias("user_label"))
    save_reports(store, reports)
    assert jobs.retrain_round(store, sets) == {"ko": "promoted"}
    assert jobs.retrain_round(store, sets) == {}
    run = store.read("training_runs").first()
    assert (run["model_version"], run["train_size"], run["test_size"]) == ("v1", 64 + 25, 16)
    assert set(jobs.load_models(store)) == {"ko"}


def test_saved_model_scores_alike(spark, trained, tmp_path):
    model = trained["en"][0]
    rows = spark.createDataFrame([("free prize",), ("agenda",)], "text string")
    model.save(str(tmp_path / "m"))
    again = type(model).load("en", str(tmp_path / "m"))
    assert model.score(rows).collect() == again.score(rows).collect()


def slices(spark, tmp_path, parts, schema):
    path = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_stores_each_id_once(spark, tmp_path):
    schema = FIELDS + ", spam_prob double"
    scored = [(*m, 0.9) for m in MAIL]
    stream = slices(spark, tmp_path, [scored[:3], scored[2:], scored[:2]], schema)
    patterns = spark.createDataFrame([("good.com",)], "pattern string")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    streams.score_stream(stream, patterns, lambda b: b, out, checkpoint).awaitTermination()
    rows = streams.stored_messages(spark, out).collect()
    assert sorted(r["gmail_id"] for r in rows) == ["g1", "g2", "g3", "g4"]
    # a restart with a fresh dedupe state still finds the stored ids
    streams.score_stream(stream, patterns, lambda b: b, out, str(tmp_path / "cp2")).awaitTermination()
    ids = sorted(r["gmail_id"] for r in streams.stored_messages(spark, out).collect())
    assert ids == ["g1", "g2", "g3", "g4"]


def test_feedback_stream_fires_once_due(spark, tmp_path):
    schema = "id long, content string, user_label string, note string, created_at timestamp_ntz"
    at = datetime(2024, 5, 1)
    parts = [[(10 * b + i, "안녕", "ham", None, at) for i in range(3)] for b in range(2)]
    stream = slices(spark, tmp_path, parts, schema)
    runs = Store(spark, "/nonexistent").read("training_runs")
    fired = []
    streams.feedback_stream(
        stream, runs, str(tmp_path / "f"), str(tmp_path / "cp"), lambda due: fired.append([r["lang"] for r in due.collect()])
    ).awaitTermination()
    assert fired == [[], ["ko"]]


def test_runs_add_to_what_is_stored(spark, tmp_path):
    """Two checkpoints over different files, one overlapping mail: nothing is lost or stored twice."""
    schema = FIELDS + ", spam_prob double"
    scored = [(*m, 0.9) for m in MAIL]
    patterns = spark.createDataFrame([("good.com",)], "pattern string")
    out = str(tmp_path / "out")
    for name, part in (("a", scored[:2]), ("b", scored[1:])):
        (tmp_path / name).mkdir()
        stream = slices(spark, tmp_path / name, [part], schema)
        streams.score_stream(stream, lambda: patterns, lambda b: b, out, str(tmp_path / name / "cp")).awaitTermination()
    rows = streams.stored_messages(spark, out).collect()
    assert sorted(r["gmail_id"] for r in rows) == ["g1", "g2", "g3", "g4"]
    assert all(r["id"] is not None and r["created_at"] is not None for r in rows)


def test_logged_attempts_reset_the_count(spark, tmp_path):
    schema = "id long, content string, user_label string, note string, created_at timestamp_ntz"
    at = datetime(2024, 5, 1)
    parts = [[(10 * b + i, "안녕", "ham", None, at) for i in range(6)] for b in range(3)]
    stream = slices(spark, tmp_path, parts, schema)
    store = Store(spark, str(tmp_path / "s"))
    fired = []

    def on_due(due):
        for r in due.collect():
            fired.append(r["lang"])
            run = [("v1", 1, 1, 0.9, 0.9, 0.9, 0.9, datetime(2024, 6, 1))]
            names = "model_version string, train_size int, test_size int, accuracy double, precision_val double"
            store.append("training_runs", spark.createDataFrame(run, names + ", recall_val double, f1_score double, trained_at timestamp_ntz"))

    streams.feedback_stream(
        stream, lambda: store.read("training_runs"), str(tmp_path / "f"), str(tmp_path / "cp"), on_due
    ).awaitTermination()
    assert fired == ["ko"]
