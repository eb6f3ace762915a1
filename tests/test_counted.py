"""A model of token counts is fitted and scores without arrays of all tokens, with the same counts and scores."""

import pytest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from mailsift.functions.text import CHAR_DOMAINS, DIGITS, NOT_WS, NUM_TOKEN, URL_TOKEN, WORD, WORD_DOMAINS, _marked, tokens
from mailsift.operators import features, model

TEXTS = [
    "x<num> <num> <url> a<url>b < num> <<num>> <url><num>",
    "<num>　<url>\x85<num>\x1c5<num>6",
    "At https://t.example/x1!\nit's 3pm <\n\nsee a.b.com/x y.kr\n",
    "안녕 한국.kr 12\n한국어 ΟΔΟΣ\nΣ 𝔸𝔸  It's",
    "naïve '' <url",
    " \n",
    "",
]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(i, t, i % 2, 1 + i % 3) for i, t in enumerate(TEXTS)], "ord long, text string, y int, copies int")


@pytest.mark.parametrize("lang", ["ko", "en"])
def test_counts_as_of_all_tokens(texts, lang):
    rows = texts.select(tokens("text", lang).alias("t"), features.counted_tokens("text", lang).alias("c")).collect()
    for r in rows:
        assert r.c.words == list(dict.fromkeys(r.t))
        assert r.c.times == [r.t.count(w) for w in r.c.words]


@pytest.mark.parametrize("lang", ["ko", "en"])
def test_vectors_as_of_a_count_vectorizer(texts, lang):
    # An unknown token in most texts, and a word of the vocabulary that none has.
    words = sorted({w for r in texts.select(tokens("text", lang).alias("t")).collect() for w in r.t}, reverse=True)[1:] + ["no such word"]
    counter = CountVectorizerModel.from_vocabulary(words, inputCol="_tokens", outputCol="want")
    rows = counter.transform(texts.withColumn("_tokens", tokens("text", lang)))
    rows = rows.withColumn("c", features.counted_tokens("text", lang))
    found = features.counted_vectors("c.words", "c.times", words)
    for r in rows.select("want", features.text_vectors("text", lang, words).alias("now"), found.alias("found")).collect():
        assert r.want == r.now == r.found


def test_nulls_stay_null(spark):
    rows = spark.createDataFrame([(None,), ("a",)], "text string").withColumn("c", features.counted_tokens("text", "en"))
    found = features.counted_vectors("c.words", "c.times", ["a"])
    got = rows.select("c", features.text_vectors("text", "en", ["a"]).alias("v"), found.alias("w")).collect()
    assert tuple(got[0]) == (None, None, None)
    assert got[1].v == got[1].w and got[1].v.toArray().tolist() == [1.0]


@pytest.mark.parametrize("lang", ["ko", "en"])
def test_vocabulary_as_of_all_tokens(texts, lang):
    assert model.known_words(model.counted_rows(texts, lang), lang) == model.known_words(model.tokenized(texts, lang), lang)


@pytest.mark.parametrize("lang", ["ko", "en"])
def test_fit_and_score_make_no_arrays_of_all_tokens(texts, lang, monkeypatch):
    by_arrays = model.fit(model.tokenized(texts, lang), lang, 5)
    want = by_arrays.pipeline.transform(texts.withColumn("_tokens", tokens("text", lang))).select("ord", "_probability")
    want = {r.ord: r._probability[1] for r in want.collect()}
    plans, cut = [], model.cut_lineage
    monkeypatch.setattr(model, "cut_lineage", lambda df, **k: plans.append(df) or cut(df, **k))
    monkeypatch.setattr(model, "tokens", None)
    scored = model.fit(texts, lang, 5).score(texts)
    assert not any("_tokens" in df.columns for df in plans)
    assert {r.ord: r.spam_prob for r in scored.collect()} == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("domains", [CHAR_DOMAINS, WORD_DOMAINS])
def test_links_by_line_as_in_the_whole_text(texts, domains):
    url = f"https?://{NOT_WS}++|(?<!{WORD}){WORD}++\\.(?:{domains}){NOT_WS}*+"
    whole = F.regexp_replace(F.regexp_replace(F.lower("text"), url, f" {URL_TOKEN} "), DIGITS, f" {NUM_TOKEN} ")
    more = texts.select("text").union(texts.select(F.lit("https://\nx.com\n\n\r\nhttp://a\x0bb.io\n.kr\na\n.com")))
    assert more.filter(~_marked("text", domains).eqNullSafe(whole)).count() == 0
