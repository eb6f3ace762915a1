"""The fit against numpy, weights in a table against the pipeline, and features that see order."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mailsift.functions.text import tokens
from mailsift.operators import model

WORDS = ["red", "green", "blue", "gray", "pink", "gold"]


def rows(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = int(i % 3 == 0)
        picked = rng.choice(WORDS, 6, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1] if y else [0.1, 0.1, 0.1, 0.1, 0.2, 0.4])
        out.append((i, " ".join(picked), y, 5 if i % 10 == 0 else 1))
    return spark.createDataFrame(out, "ord long, text string, y int, copies int")


@pytest.fixture(scope="module")
def fitted(spark):
    train = rows(spark)
    return train, model.fit(train, "en", max_iter=300)


def test_the_fit_is_where_the_gradient_vanishes(fitted):
    train, made = fitted
    found = made.pipeline.transform(train.withColumn("_tokens", tokens("text", "en")))
    data = found.select(vector_to_array("_features").alias("x"), vector_to_array("_probability")[1].alias("p"), "y", "copies").collect()
    x, p, y, copies = (np.array([r[c] for r in data], float) for c in ("x", "p", "y", "copies"))
    w = copies * np.where(y == 1, copies[y == 0].sum() / copies[y == 1].sum(), 1.0)
    regression = made.pipeline.stages[-1]
    beta = regression.coefficients.toArray()
    assert np.allclose(p, 1 / (1 + np.exp(-(x @ beta + regression.intercept))), atol=1e-9)
    assert abs((w * (p - y)).sum() / w.sum()) < 1e-4
    mean = (w[:, None] * x).sum(0) / w.sum()
    variance = (w[:, None] * (x - mean) ** 2).sum(0) / w.sum()
    slope = ((w * (p - y))[:, None] * x).sum(0) / w.sum() + 0.01 * variance * beta
    assert np.abs(slope).max() < 2e-3 * max(1, np.abs(beta).max())


def test_weights_in_a_table_score_as_the_pipeline(spark, fitted):
    train, made = fitted
    weights, intercept = made.weights()
    asked = train.select("ord", "text", F.lit("en").alias("lang")).unionByName(
        spark.createDataFrame([(900, "", "en"), (901, None, "en"), (902, "unknown words", "en"), (903, "red", "ko")], "ord long, text string, lang string")
    )
    table = weights.select(F.lit("en").alias("lang"), "token", "weight")
    got = model.score_by_weights(asked, table, spark.createDataFrame([("en", intercept)], "lang string, intercept double"), "ord")
    got = {r["ord"]: r["spam_prob"] for r in got.collect()}
    want = {r["ord"]: r["spam_prob"] for r in made.score(asked.filter("text IS NOT NULL AND lang = 'en'")).collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert got[901] == got[900] == got[902] and got[903] is None


def test_order_is_chosen_where_it_tells(spark):
    """The same words in every text; only which stands first differs."""
    rng = np.random.default_rng(2)
    data = []
    for i in range(120):
        y = int(i % 2 == 0)
        filler = " ".join(rng.choice(WORDS, 2))
        data.append((i, f"{filler} win now" if y else f"{filler} now win", y, 1))
    train = model.tokenized(spark.createDataFrame(data, "ord long, text string, y int, copies int"), "en")
    recipes = (model.BAG, model.Recipe((2,), buckets=256))
    bag, ordered = model.tune(train, "en", recipes, folds=2, max_iter=10)
    assert ordered == 1.0 and bag < 0.9
    made = model.fit(train, "en", 10, recipes[1])
    shown = spark.createDataFrame([("blue pink win now",), ("blue pink now win",)], "text string")
    assert [r["spam_prob"] > 0.5 for r in made.score(shown).collect()] == [True, False]
    with pytest.raises(ValueError):
        made.weights()


def test_a_model_with_order_is_saved_and_loaded(spark, tmp_path):
    made = model.fit(rows(spark, 30), "en", 5, model.Recipe((2, 3), buckets=64))
    made.save(str(tmp_path / "m"))
    again = model.LanguageModel.load("en", str(tmp_path / "m"))
    asked = rows(spark, 5, 3).select("text")
    assert made.score(asked).collect() == again.score(asked).collect()


def test_folds_and_recipes_share_their_counts(spark, monkeypatch):
    """Tokens are counted by fold once; each fit is the one that its rows alone would give."""
    train = model.tokenized(rows(spark, 90), "en")
    recipes = (model.BAG, model.Recipe((2,), buckets=64), model.Recipe((2, 3), buckets=64))
    calls, plain = [], model.token_counts
    monkeypatch.setattr(model, "token_counts", lambda *a, **k: calls.append(a) or plain(*a, **k))
    fits, fit = [], model.fit
    monkeypatch.setattr(model, "fit", lambda *a: fits.append((a, fit(*a))) or fits[-1][1])
    found = model.tune(train, "en", recipes, folds=2, max_iter=5)
    assert len(calls) == 1 and len(found) == 3 and len(fits) == 6
    for (given, _, steps, recipe, words), made in fits:
        alone = fit(train.join(given.select("ord"), "ord", "left_semi"), "en", steps, recipe)
        assert alone.pipeline.stages[0].vocabulary == list(words)
        assert np.allclose(alone.pipeline.stages[-1].coefficients.toArray(), made.pipeline.stages[-1].coefficients.toArray(), atol=1e-6)


def test_all_feedback_is_learnt_from(spark):
    """More reports than the 100,000 that training once stopped at; the oldest alone know a word."""
    texts = [(i, "spam" if i % 2 else "ham", f"{WORDS[i % 6]} mail", i % 2) for i in range(40)]
    corpus = spark.createDataFrame(texts, "id long, label string, text string, y int").withColumn("lang", F.lit("en"))
    n = 100_020
    reports = spark.range(n).select(
        "id",
        F.when(F.col("id") < 20, "oldest mail").otherwise("red mail").alias("content"),
        F.when(F.col("id") % 2 == 0, "ham").otherwise("spam").alias("user_label"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("created_at"),
    )
    made, _, n_train, n_test = model.train_and_evaluate(corpus, reports, "en", max_iter=1)
    assert (n_train, n_test) == (32 + 5 * n, 8)
    assert "oldest" in made.pipeline.stages[0].vocabulary
