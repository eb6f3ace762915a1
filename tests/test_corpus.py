import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from mailsift.operators import augment, corpus, explore, features
from mailsift.sources import csv_files


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿label,text\nham,안녕\n".encode())
    (tmp_path / "kr.csv").write_bytes("label,text\nspam,광고 똠방\n".encode("cp949"))
    (tmp_path / "broken.csv").write_bytes("label,text\nspam,가".encode("cp949") + b"\xff\n")
    paths = [str(tmp_path / n) for n in ("bom.csv", "kr.csv", "broken.csv")]
    kinds = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in csv_files.file_encodings(spark, paths).collect()}
    assert kinds == {"bom.csv": "UTF-8", "kr.csv": "MS949", "broken.csv": "MS949"}
    rows = csv_files.read_csv_any(spark, paths)
    assert set(rows.columns) == {"label", "text", "ord"}
    texts = {r["text"] for r in rows.collect()}
    assert {"안녕", "광고 똠방"} <= texts
    assert any(t.startswith("가") and len(t) == 2 for t in texts)


def test_csv_quotes_breaks_and_missing(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('label,text\nham,"two\nlines, ""quoted"""\nspam,nan\nham,NA\nham,\n', encoding="utf-8")
    got = [r["text"] for r in csv_files.read_csv_any(spark, str(path)).orderBy("ord").collect()]
    assert got == ['two\nlines, "quoted"', None, None, None]


def test_missing_files(spark, tmp_path):
    with pytest.raises(AnalysisException):
        csv_files.read_csv_any(spark, str(tmp_path / "none.csv"))
    empty = csv_files.read_optional(spark, str(tmp_path / "none.csv"))
    assert empty.count() == 0 and empty.columns == ["label", "text", "ord"]


def test_read_corpus_and_demo(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("label,text\nSPAM,a\nham,b\n,c\nham,\n", encoding="utf-8")
    rows = csv_files.read_corpus(spark, str(path), "csv")
    assert sorted((r["text"], r["lang"], r["y"]) for r in rows.collect()) == [("a", "ko", 1), ("b", "ko", 0)]
    demo = tmp_path / "d.csv"
    demo.write_text("﻿label,text,lang\nspam,x,ko\n", encoding="utf-8")
    assert csv_files.read_demo(spark, str(demo)).first()["label"] == "spam"


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "g+ 1%20.csv").write_text("no,내용\n1,오늘 회의 안내 드립니다\n2,짧음\n", encoding="utf-8")
    (tmp_path / "g+ 2.csv").write_bytes("본문,일자\n내일 일정 변경 안내,1\n오늘 회의 안내 드립니다,2\n".encode("cp949"))
    files = csv_files.glob_files(spark, str(tmp_path / "g+ *.csv"))
    ham = corpus.korean_ham_source(csv_files.read_each(spark, files))
    assert sorted(r["text"] for r in ham.collect()) == ["내일 일정 변경 안내", "오늘 회의 안내 드립니다"]


def test_one_call_over_two_headers_and_encodings(spark, tmp_path):
    (tmp_path / "1.csv").write_text("text,label\n같은 글,ham\n첫째,ham\n", encoding="utf-8")
    (tmp_path / "2.csv").write_text("label,text\nspam,같은 글\nspam,둘째\n", encoding="utf-8")
    (tmp_path / "3.csv").write_bytes("label,text\nspam,같은 글\nham,셋째\n".encode("cp949"))
    rows = csv_files.read_csv_any(spark, [str(tmp_path / f"{n}.csv") for n in (1, 2, 3)])
    assert {(r["label"], r["text"]) for r in rows.collect()} == {
        ("ham", "같은 글"), ("ham", "첫째"), ("spam", "같은 글"), ("spam", "둘째"), ("ham", "셋째"),
    }
    assert rows.select("ord").distinct().count() == rows.count() == 6
    first = corpus.distinct_texts(rows, [F.col("ord")]).collect()
    assert {r["text"]: r["label"] for r in first}["같은 글"] == "ham" and len(first) == 4


def test_longest_column_tie_and_nulls(spark):
    rows = spark.createDataFrame([("abc", None, "x"), ("abc", "abc", "y")], "a string, b string, c string")
    assert corpus.longest_text_column(rows) == "a"


def test_clean_and_noise(spark):
    rows = spark.createDataFrame(
        [(1, "  hello \n world "), (2, "tiny"), (3, None), (4, "RETURNED MAIL: x"), (5, "메일 반송 안내"), (6, "123456")],
        "id int, text string",
    )
    kept = corpus.drop_noise(corpus.clean(rows))
    assert sorted((r["id"], r["text"]) for r in kept.collect()) == [(1, "hello world"), (6, "123456")]


def test_spam_source_by_position(spark):
    raw = spark.createDataFrame(
        [
            (0, "d", "t", "y", "무료 대출 안내", "a.exe"),
            (1, "d", "t", "y", "무료  대출 안내", "b.exe"),
            (2, "d", "t", "y", "english only subject", None),
            (3, "d", "t", "y", "당첨 축하 드립니다", None),
            (4, "d", "t", "y", None, "x"),
        ],
        "ord long, c1 string, c2 string, c3 string, c4 string, c5 string",
    )
    got = sorted(r["text"] for r in corpus.korean_spam_source(raw).collect())
    assert got == ["당첨 축하 드립니다", "무료 대출 안내 첨부파일 a.exe"]
    short = raw.drop("c5")
    assert sorted(r["text"] for r in corpus.korean_spam_source(short).collect())[1] == "무료 대출 안내"


def test_first_of_equal_texts_wins(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("b", "x", 1), ("c", " x", 3), ("d", "  ", 0)], "label string, text string, o int")
    merged = corpus.merge_corpus(rows, [F.col("o")]).collect()
    assert [(r["label"], r["text"], r["lang"]) for r in merged] == [("b", "x", "en")]


def test_english_source_balance(spark):
    raw = spark.createDataFrame(
        [(i, f"body number {i % 40}", "1" if i % 4 == 0 else "0") for i in range(60)] + [(99, "odd label row", "x")],
        "ord long, Body string, Label string",
    )
    got = corpus.english_source(raw)
    counts = {r["label"]: r["n"] for r in explore.label_counts(got).collect()}
    assert counts == {"ham": 10, "spam": 10}


def test_split_is_stratified_and_disjoint(spark):
    rows = spark.range(100).select(
        "id", F.when(F.col("id") < 30, "spam").otherwise("ham").alias("label"), F.lit("ko").alias("lang")
    )
    train, test = corpus.split(rows, ["lang", "label"], "id")
    assert {r["label"]: r["n"] for r in explore.label_counts(test).collect()} == {"spam": 6, "ham": 14}
    assert train.join(test, "id").count() == 0
    assert train.count() + test.count() == 100


def test_feedback_copies_and_weight(spark):
    train = spark.createDataFrame([(1, "ham", "t", "ko", 0), (2, "spam", "u", "ko", 1)], "id long, label string, text string, lang string, y int")
    reports = spark.createDataFrame(
        [(10, "안녕 광고", "spam", "2024-01-02 00:00:00"), (11, "hello", "ham", "2024-01-03 00:00:00")],
        "id long, content string, user_label string, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    ko = corpus.feedback_rows(reports, "ko")
    assert [r["id"] for r in ko.collect()] == [10]
    assert corpus.feedback_rows(reports, "ko", limit=1).count() == 0
    full = corpus.add_feedback(train, ko)
    assert full.count() == 7
    weight = corpus.class_weight(full).first()
    assert (weight["n_pos"], weight["n_neg"]) == (6, 1)
    assert corpus.class_weight(full.filter("y = 0")).first()["pos_weight"] == 1.0


def test_feedback_is_of_all_reports(spark):
    """No cut at 100,000 reports, nor a ranking of them; the newest alone only where that is asked for."""
    reports = spark.range(100_010).select(
        "id",
        F.when(F.col("id") % 10 == 0, "안녕").otherwise("hello").alias("content"),
        F.lit("spam").alias("user_label"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("created_at"),
    )
    found = {lang: corpus.feedback_rows(reports, lang) for lang in ("ko", "en")}
    assert {lang: rows.count() for lang, rows in found.items()} == {"ko": 10_001, "en": 90_009}
    assert found["ko"].filter("id = 0").count() == 1
    assert corpus.feedback_rows(reports, "en", limit=3).count() == 3


def vocab(spark, texts, lang="ko", **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = features.vocabulary(rows, lang, "id", specials=True, **options).collect()
    return {r["token"]: r["id"] for r in got}


def test_vocabulary(spark):
    assert vocab(spark, ["한번씩만"]) == {"<pad>": 0, "<unk>": 1}
    assert vocab(spark, ["물고기"] * 2) == {"<pad>": 0, "<unk>": 1, "물": 2, "고": 3, "기": 4}
    # count first, then the earlier row, then the earlier place
    assert vocab(spark, ["pear fig", "fig pear plum", "plum kiwi kiwi"], "en", max_size=3) == {
        "<pad>": 0, "<unk>": 1, "pear": 2, "fig": 3, "plum": 4,
    }
    assert vocab(spark, ["oak elm ash oak elm ash"], "en", max_size=2) == {"<pad>": 0, "<unk>": 1, "oak": 2, "elm": 3}


def test_encode(spark):
    words = spark.createDataFrame([("물", 2), ("고", 3), ("기", 4)], "token string, id int")
    rows = spark.createDataFrame([(0, "기"), (1, "물고기잡이"), (2, "Q"), (3, "")], "id long, text string")
    got = [r["ids"] for r in features.encode(rows, words, "ko", 4).orderBy("id").collect()]
    assert got == [[4, 0, 0, 0], [2, 3, 4, 1], [1, 0, 0, 0], [0, 0, 0, 0]]


def test_encode_with_a_vocabulary_too_large_to_look_up(spark, monkeypatch):
    words = spark.createDataFrame([("a", 2), ("b", 3)], "token string, id int")
    rows = spark.createDataFrame([(0, "a b c a"), (1, "a a a a a a"), (2, "")], "id long, text string")
    want = sorted(map(tuple, features.encode(rows, words, "en", 4).select("id", "ids").collect()))
    monkeypatch.setattr(features, "LOOKUP_ROWS", 1)
    got = features.encode(rows, words, "en", 4, key="id").select("id", "ids").collect()
    assert sorted(map(tuple, got)) == want == [(0, [2, 3, 1, 2]), (1, [2, 2, 2, 2]), (2, [0, 0, 0, 0])]
    with pytest.raises(ValueError):
        features.encode(rows, words, "en", 4)


def test_vocabulary_round_trip(spark, tmp_path):
    words = spark.createDataFrame([("a", 2), ("b", 3)], "token string, id int")
    features.save_vocabulary(words, str(tmp_path / "v"))
    assert sorted(features.load_vocabulary(spark, str(tmp_path / "v")).collect()) == sorted(words.collect())


def test_templates(spark):
    templates = spark.createDataFrame(
        [("ham", 0, "{a} {a}", "x {b}"), ("spam", 0, "s {a}", "{nope}"), ("spam", 1, "t", "u")],
        "label string, idx long, subject string, body string",
    )
    rows = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, "ham").otherwise("spam").alias("label"))
    slots = F.create_map(F.lit("a"), F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.lit("b"), F.array(F.lit("z")))
    made = augment.augment(
        rows, templates, slots, F.array(F.lit("http://l")), F.array(F.lit(""), F.lit("f.exe")), "id"
    )
    out = made.collect()
    assert len(out) == 200
    assert not any("{a}" in r["text"] or "{b}" in r["text"] for r in out)
    assert any("{nope}" in r["text"] for r in out)
    linked = sum("http://l" in r["text"] for r in out)
    assert 60 < linked < 140
    heads = {r["text"][:3] for r in out if r["label"] == "ham"}
    assert "1 2" in heads and "1 1" in heads
    pool = augment.distinct_pool(made, "id", 10)
    assert pool.count() <= 20 and pool.select("text").distinct().count() == pool.count()
    demo = augment.mark_demo(pool, "id", 2)
    assert demo.filter("is_demo").count() == 4


def test_characters_are_counted_without_rows_of_their_own(spark):
    texts = [(3, 5, "ab a <url>"), (1, 1, "b http://x.y 7"), (2, 2, None), (None, 1, "c <url>d"), (4, None, "e")]
    rows = spark.createDataFrame(texts, "ord long, copies int, text string")
    found = features.token_counts(rows, "ko", "ord", "copies")
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["token"]: (r["n"], r["first_row"]) for r in found.collect()}
    assert got == {
        "a": (10, 3), "b": (6, 1), "<url>": (6, 1), "<num>": (1, 1), "c": (1, None), "d": (1, None),
        "e": (None, 4), **{c: (1, None) for c in "<url>"},
    }
