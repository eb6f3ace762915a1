import re

import pytest
from pyspark.sql import functions as F

from mailsift.functions import text as tx

# Each text with the tokens it must give, written out by hand.
CHAR_CASES = [
    ("문의 https://t.example/x1 로", ["문", "의", "<url>", "로"]),
    ("shop.kr/7 봐", ["<url>", "봐"]),
    ("shop.company", ["<url>"]),
    ("me.io", ["m", "e", ".", "i", "o"]),
    ("값 12,30", ["값", "<num>", ",", "<num>"]),
    ("１２ ①", ["<num>", "①"]),
    ("AB c", ["a", "b", "c"]),
    ("가\x1c나\x85다\u3000라", ["가", "나", "다", "라"]),
    ("😀a", ["😀", "a"]),
    ("(https://q r)", ["(", "<url>", "r", ")"]),
    ("", []),
    (" \t\n ", []),
    ("İ", ["i", "\u0307"]),
]
WORD_CASES = [
    ("Buy now at https://t.example/x1!", ["buy", "now", "at", "<url>"]),
    ("it's 3pm", ["it's", "<num>", "pm"]),
    ("me.io ok", ["<url>", "ok"]),
    ("x<num> <num>", ["x", "num", "<num>"]),
    ("naïve", ["na", "ve"]),
    ("''", ["''"]),
    ("(https://a.b)", ["<url>"]),
    ("한글 text", ["text"]),
    ("9.com9 7", ["<url>", "<num>"]),
    ("_q.net.", ["<url>"]),
    ("safe-login.org", ["safe", "<url>"]),
    ("", []),
    ("\u00a0\n", []),
]


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["o"] for r in rows.select("i", make("s").alias("o")).orderBy("i").collect()]


def one(spark, value, make):
    return column(spark, [value], make)[0]


@pytest.mark.parametrize("make,cases", [(tx.char_tokens, CHAR_CASES), (tx.word_tokens, WORD_CASES)])
def test_tokens(spark, make, cases):
    got = column(spark, [text for text, _ in cases], make)
    assert dict(zip([t for t, _ in cases], got)) == dict(cases)


def test_tokens_of_a_long_text(spark):
    text = "longer words " * 50_000
    assert len(one(spark, text, tx.word_tokens)) == 100_000
    assert len(one(spark, text, tx.char_tokens)) == 11 * 50_000


def composed(spark, subject=None, sender=None, body=None, attachment=None):
    schema = "subject string, sender string, body string, attachment string"
    row = spark.createDataFrame([(subject, sender, body, attachment)], schema)
    return row.select(tx.compose_email("subject", "sender", "body", "attachment")).first()[0]


def test_compose_email(spark):
    assert composed(spark, "", "", "내일 봐요", "") == "내일 봐요"
    assert composed(spark, "회의", "kim@corp.test", "내일 봐요", "plan.hwp") == "회의 kim@corp.test 내일 봐요 첨부파일 plan.hwp"
    assert composed(spark, "NaN", None, "x", " nan ") == "x"
    assert composed(spark, "\u3000", None, None, None) == ""


def test_compose_content(spark):
    schema = "subject string, sender string, body string, attachment string"
    rows = [(" plan ", "kim@corp.test", " see you ", "p.hwp"), ("", None, "", ""), (None, "", "q" * 60_000, None)]
    made = spark.createDataFrame(rows, schema)
    fields = schema.replace(" string", "").split(", ")
    first, empty, long = [r[0] for r in made.select(tx.compose_content(*fields)).collect()]
    assert first == "제목: plan\n발신: kim@corp.test\nsee you\n첨부: p.hwp"
    assert empty == ""
    assert long == "q" * 60_000
    assert [len(r[0]) for r in made.select(tx.compose_content(*fields, cap=10)).collect()] == [10, 0, 10]
    whole, short = made.select(tx.mail_content("subject", "body"), tx.mail_content("subject", "body", cap=4)).collect()[2]
    assert (len(whole), short) == (60_000, "qqqq")


def test_extract_email(spark):
    values = ["김철수 <kim@corp.test>", "LEE@Corp.Test", "", None, "  Front Desk  ", "Alerts <no-reply@mail.corp.test>"]
    assert column(spark, values, tx.extract_email) == [
        "kim@corp.test", "lee@corp.test", "", "", "front desk", "no-reply@mail.corp.test",
    ]


def test_strip_and_collapse(spark):
    values = [s + x + " b " + s for s in tx.WS_CHARS for x in ("a", "a\n\n")]
    assert column(spark, values, tx.strip) == [v.strip() for v in values]
    assert column(spark, values, tx.collapse) == [re.sub(r"\s+", " ", v).strip() for v in values]


def test_preview(spark):
    values = ["제목: 안녕\n본문\t끝", "a\r\nb\rc", " x ", "제목: " + "가" * 90, "y" * 80]
    got = column(spark, values, lambda c: tx.preview(c, 80))
    assert got == ["안녕 본문 끝", "a b c", "x", "가" * 80 + "…", "y" * 80]


def test_percent_rounds_half_to_even(spark):
    values = [0.125, 0.135, 0.005, 0.015, 0.5, 1.0, 0.0, 0.285]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
    got = [r[0] for r in rows.orderBy("i").select(tx.percent("p")).collect()]
    assert got == [f"{v:.0%}" for v in values]


def test_language(spark):
    values = ["hello", "안", "ㅋㅋ", None, "x 가"]
    assert column(spark, values, tx.detect_lang) == ["en", "ko", "en", "en", "ko"]


def test_routing_ignores_attachment(spark):
    row = spark.createDataFrame([("hi", None)], "s string, b string")
    assert row.select(tx.route_lang(F.col("s"), F.col("b"))).first()[0] == "en"


def test_first_character_tokens_are_those_of_the_whole_text(spark):
    """Cut before the text is taken apart: at markers, at chunks that begin like one, at blanks in front."""
    texts = [
        "확인 http://bit.ly/abc 클릭 01012345678", "  　<url>abc <num> d", "ab <url>c", "x" * 600 + " y.com z", "a\x1cb\x85c",
        "1 " * 400, "", " ", None, "ΑΣ α <url>", "😀a😀 me2.do/kk1 ab", "<url", "a.com,b 7<num>",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 250):
        whole = F.slice(tx.char_tokens("text"), 1, n)
        assert rows.filter(~whole.eqNullSafe(tx.char_tokens("text", n))).count() == 0, n
