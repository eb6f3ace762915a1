import datetime

from pyspark.sql import functions as F

from mailsift import schema as S
from mailsift.operators import allowlist, mailbox
from mailsift.sources.tables import Store, reject_counts, save_predictions, save_reports, save_run

PREDICTION = "content string, predicted_label string, spam_prob double, gmail_id string"


def put(spark, store, *rows):
    save_predictions(store, spark.createDataFrame(list(rows), PREDICTION))


def test_tables_start_empty_and_typed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for name, schema in Store.TABLES.items():
        table = store.read(name)
        assert table.count() == 0
        assert table.schema.fieldNames() == schema.fieldNames()


def test_save_and_read_back(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    put(spark, store, ("회의록 공유", "review", 0.55, "g7"))
    row = mailbox.newest(store.read("messages"), 5).first()
    assert (row["content"], row["predicted_label"], row["spam_prob"], row["gmail_id"]) == ("회의록 공유", "review", 0.55, "g7")
    assert (row["source"], row["model_version"], row["actioned"]) == ("manual", "v1", 0)
    assert isinstance(row["created_at"], datetime.datetime)


def test_stats_by_tier(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    empty = mailbox.verdict_stats(store.read("messages"))
    assert tuple(empty.first()) == (0, None, None, None)
    assert tuple(mailbox.stats_view(empty).first()) == (0, 0, 0, 0)
    tiers = ["spam"] * 3 + ["ham"] * 2 + ["review"]
    put(spark, store, *[(f"text {i}", tier, 0.5, None) for i, tier in enumerate(tiers)])
    assert tuple(mailbox.verdict_stats(store.read("messages")).first()) == (6, 3, 1, 2)


def test_many_messages_without_id(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    put(spark, store, ("m1", "ham", 0.1, None))
    put(spark, store, ("m2", "ham", 0.1, None))
    assert store.read("messages").count() == 2


def test_labels_outside_the_domain_become_rejects(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    put(spark, store, ("m1", "Spam", 0.9, None), ("m2", None, 0.1, None), ("m3", "ham", 0.1, None))
    assert [r["content"] for r in store.read("messages").collect()] == ["m3"]
    counts = {(r["table_name"], r["reason"]): r["n"] for r in reject_counts(store).collect()}
    assert counts == {("messages", "predicted_label: Spam"): 1, ("messages", "predicted_label: null"): 1}
    assert any('"content":"m1"' in r["row"] for r in store.read("rejects").collect())


def test_late_pages_with_null_times(spark):
    rows = spark.range(40).select(
        "id",
        F.when(F.col("id") % 4 != 0, F.expr("timestamp_ntz'2024-03-01' + make_interval(0, 0, 0, 0, 0, cast(id % 5 as int), 0)")).alias("created_at"),
    )
    for offset in (0, 7, 28, 31, 38, 40, 99):
        want = [r["id"] for r in mailbox.row_range(rows, offset, 6).collect()]
        assert [r["id"] for r in mailbox.row_range(rows, offset, 6, shallow=3).collect()] == want
    nulls = rows.filter("created_at IS NULL")
    assert [r["id"] for r in mailbox.row_range(nulls, 2, 3, shallow=1).collect()] == [28, 24, 20]


def test_conform_twice_changes_nothing(spark):
    rows = spark.createDataFrame([("7", "x", "not a number")], "id string, content string, spam_prob string")
    once = S.conform(rows, S.MESSAGES, S.MESSAGE_DEFAULTS)
    twice = S.conform(once, S.MESSAGES, S.MESSAGE_DEFAULTS)
    assert once.collect() == twice.collect()
    assert once.schema.fieldNames() == S.MESSAGES.fieldNames()
    assert once.first()["spam_prob"] is None


def test_values_that_do_not_cast_are_rejected(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("7", "a", "0.5"), ("x", "b", "0.1"), (None, "c", "much")], "id string, content string, spam_prob string")
    store.append("messages", rows)
    assert [(r["id"], r["spam_prob"]) for r in store.read("messages").collect()] == [(7, 0.5)]
    rejects = {r["reason"]: r["row"] for r in store.read("rejects").collect()}
    assert set(rejects) == {"does not cast: id", "does not cast: spam_prob"} and '"content":"c"' in rejects["does not cast: spam_prob"]
    assert S.failed_casts(spark.createDataFrame([(1, "a", 2.0)], "id int, content string, spam_prob float"), S.MESSAGES) is None


def test_allowlist_insert_then_update(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "id long, pattern string, note string"

    def listed():
        return allowlist.current_list(store.read("trust_log"))

    def log(change, i, pattern, note=None):
        store.append("trust_log", change(spark.createDataFrame([(i, pattern, note)], schema)))

    log(allowlist.add_rows, 10, " Billing@Corp.Test ", "invoices")
    log(allowlist.add_rows, 11, "\t", "nothing")
    log(allowlist.add_rows, 12, "billing@corp.test", "invoices and offers")
    assert [(r["id"], r["pattern"], r["note"]) for r in listed().collect()] == [(10, "billing@corp.test", "invoices and offers")]
    mail = spark.createDataFrame([("BILLING@corp.test",)], "sender string")
    assert allowlist.flag_trusted(mail, listed()).first()["trusted"]
    log(allowlist.remove_rows, 13, "billing@CORP.test")
    assert listed().count() == 0
    log(allowlist.add_rows, 14, "billing@corp.test", "back")
    assert [(r["id"], r["note"]) for r in listed().collect()] == [(14, "back")]


def test_runs_and_reports(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    scores = spark.createDataFrame([(0.9, 0.8, 0.7, 0.75)], "accuracy double, precision double, recall double, f1 double")
    save_run(store, "v1", 100, 25, scores)
    run = store.read("training_runs").first()
    assert (run["model_version"], run["train_size"], run["f1_score"]) == ("v1", 100, 0.75)
    save_reports(store, spark.createDataFrame([("t", "spam"), ("u", "review")], "content string, user_label string"))
    assert tuple(mailbox.report_counts(store.read("user_reports")).first()) == (1, 1, 0)


def test_actions_keep_history(spark):
    rows = spark.createDataFrame(
        [(1, "g1", 0), (2, "g2", 0), (3, None, 0)], "id long, gmail_id string, actioned int"
    )
    log = spark.createDataFrame([("g2",), ("g2",), ("g9",), (None,)], "gmail_id string")
    got = {r["id"]: r["actioned"] for r in mailbox.mark_actioned(rows, log).collect()}
    assert got == {1: 0, 2: 1, 3: 0}
    assert mailbox.mark_actioned(rows, log.limit(0)).collect() == rows.collect()


def test_new_mail_paths_agree(spark, monkeypatch):
    fetched = spark.createDataFrame(
        [("a", 0), ("b", 1), ("a", 2), ("c", 3), (None, 4)], "gmail_id string, pos long"
    )
    stored = spark.createDataFrame([("c",), ("z",), (None,)], "gmail_id string")
    want = [("a", 0), ("b", 1)]
    assert sorted(map(tuple, mailbox.new_mail(fetched, stored).select("gmail_id", "pos").collect())) == want
    monkeypatch.setattr(mailbox, "is_small", lambda *a, **k: False)
    assert sorted(map(tuple, mailbox.new_mail(fetched, stored).select("gmail_id", "pos").collect())) == want


def test_mailbox_actions(spark):
    boxes = spark.createDataFrame(
        [("a", ["INBOX"]), ("b", ["SPAM", "UNREAD"]), ("c", ["INBOX", "SPAM"])],
        "gmail_id string, labels array<string>",
    )
    actions = spark.createDataFrame(
        [("a", "spam"), ("b", "not_spam"), ("c", "trash"), ("x", "spam")], "gmail_id string, action string"
    ).unionByName(spark.createDataFrame([("a2", "archive")], "gmail_id string, action string"))
    applied = mailbox.apply_actions(boxes, actions)
    got = {r["gmail_id"]: (r["status"], r["labels"]) for r in applied.collect()}
    assert got["a"] == ("ok", ["SPAM"])
    assert got["b"] == ("ok", ["UNREAD", "INBOX"])
    assert got["c"] == ("ok", ["SPAM", "TRASH"])
    assert got["x"] == ("fail", None)
    assert got["a2"] == ("fail", None)
    assert tuple(mailbox.action_counts(applied).first()) == (3, 2)


def test_empty_entries_are_rejected(spark):
    rows = spark.createDataFrame(
        [(1, "s", None), (2, None, " \t"), (3, "", "b"), (4, "　", "")], "id int, subject string, body string"
    )
    usable, rejected = mailbox.split_empty(rows)
    assert {r["id"] for r in usable.collect()} == {1, 3}
    assert {r["id"] for r in rejected.collect()} == {2, 4}


def test_mail_without_sender_stays_empty_text(spark):
    rows = spark.createDataFrame(
        [("g1", "s", None, "b", "en", 0.9)],
        "gmail_id string, subject string, sender string, body string, lang string, spam_prob double",
    )
    patterns = spark.createDataFrame([("x.com",)], "pattern string")
    row = mailbox.fetched_messages(rows, patterns).first()
    assert (row["sender"], row["content"], row["predicted_label"]) == ("", "s b", "spam")
    assert row["model_version"] == "v1-en"


def test_list_follows_the_order_of_writes(spark, tmp_path):
    from mailsift.operators import allowlist

    store = Store(spark, str(tmp_path / "ordered"))
    patterns = spark.createDataFrame([(f"d{i}.com", None) for i in range(20)], "pattern string, note string")
    store.append("trust_log", allowlist.add_rows(patterns))
    assert allowlist.current_list(store.read("trust_log")).count() == 20
    store.append("trust_log", allowlist.remove_rows(patterns))
    assert allowlist.current_list(store.read("trust_log")).count() == 0
    store.append("trust_log", allowlist.add_rows(patterns.limit(3)))
    assert allowlist.current_list(store.read("trust_log")).count() == 3
