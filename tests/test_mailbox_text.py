"""A mailbox pass writes no composed text; words are looked for before markers, with the same tokens."""

import pytest
from pyspark.sql import functions as F

from mailsift.functions.text import EN_WORD, NOT_WS, NUM_TOKEN, URL_TOKEN, WORD_DOMAINS, _marked, word_tokens
from mailsift.operators import jobs, mailbox
from mailsift.sources.tables import Store

FIELDS = "gmail_id string, pos long, subject string, sender string, body string, attachment string"
MAIL = [("g1", 0, "Nan", " naN ", "hi", "NaN"), ("g2", 1, "s", "abcd", "b", "c"), ("g3", 2, None, "na", "nano", "")]


def test_mailbox_pass_writes_no_text_beside_the_mail(spark, tmp_path, monkeypatch):
    steps, cut = [], jobs.cut_lineage
    monkeypatch.setattr(jobs, "cut_lineage", lambda df, **k: steps.append(df.columns) or cut(df, **k))
    monkeypatch.setattr(jobs, "score_routed", lambda rows, models: rows.withColumn("spam_prob", F.length("text") / 100))
    store = Store(spark, str(tmp_path))
    assert jobs.mailbox_pass(store, spark.createDataFrame(MAIL, FIELDS), {}) == (3, 3)
    assert "lang" in steps[0] and "text" not in steps[0]
    got = {r["gmail_id"]: r["spam_prob"] for r in store.read("messages").collect()}
    assert got == {"g1": 0.02, "g2": 0.15, "g3": 0.07}


def test_composed_text(spark):
    rows = mailbox.model_input(spark.createDataFrame(MAIL, FIELDS)).collect()
    assert {r["gmail_id"]: r["text"] for r in rows} == {"g1": "hi", "g2": "s abcd b 첨부파일 c", "g3": "na nano"}


@pytest.mark.parametrize(
    "text",
    ["x<num> <num> <url> a<url>b < num> <<num>>", "<num>\u3000<url>\x85<num>", "at https://t.example/x1! it's 3pm <", "naïve '' <url", "", None],
)
def test_words_as_with_markers_first(spark, text):
    marker = f"(?<!{NOT_WS})(?:{URL_TOKEN}|{NUM_TOKEN})(?!{NOT_WS})"
    before = F.regexp_extract_all(_marked("text", WORD_DOMAINS), F.lit(f"{marker}|{EN_WORD}"), F.lit(0))
    row = spark.createDataFrame([(text,)], "text string").select(word_tokens("text").alias("now"), before.alias("before")).first()
    assert row["now"] == row["before"]
