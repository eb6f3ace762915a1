"""The two learned scores: held-out accuracy, decisions, and rows without anything to learn from."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.llm import labelled, line_quality, queries, toxicity
from tests.llm.brute import AWKWARD, documents

BAD_WORDS = ["dreadful", "vile", "rotten", "awful"]


def corpus(spark, kind, n=360):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        lines = []
        for k in range(rng.randrange(3, 8)):
            words = ["".join(rng.choices("aeioustnrl", k=rng.randrange(2, 9))) for _ in range(rng.randrange(6, 20))]
            if kind == "toxic" and bad and k < 2:
                words[rng.randrange(len(words))] = rng.choice(BAD_WORDS)
            if kind == "quality" and bad and k % 2 == 0:
                words = [w + "%%%" for w in words]
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines), "en", "s"))
        labels.append((i, int(bad) if kind == "toxic" else int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return docs, spark.createDataFrame(labels, f"doc_id long, {kind} int"), dict(labels)


def held_out(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


def test_remainder(spark):
    got = spark.range(200).select("id", labelled.remainder(F.col("id"), 3).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 3 for r in got)


def test_toxicity_held_out(spark):
    docs, labels, truth = corpus(spark, "toxic")
    model = toxicity.fit(docs, labels, labelled.remainder(F.col("doc_id"), 3) != 1)
    scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    test = [i for i in truth if held_out(i, 3, 1)]
    right = [(scores[i] >= toxicity.REJECT_FROM) == bool(truth[i]) for i in test]
    assert len(scores) == len(truth) and np.mean(right) > 0.97
    kept = {r.doc_id for r in toxicity.filter_documents(docs, model).collect()}
    assert kept == {i for i in truth if scores[i] < toxicity.REJECT_FROM}


def test_margins_tell_toxic_windows():
    ordinary = toxicity.dictionary_text(["this", "that", "with"])
    toxic = ordinary + toxicity.dictionary_text(["dreadful", "vile"])
    model = toxicity.ToxicityModel(ordinary, toxic)
    assert model.margins("this was a Dreadful! day")[0] >= 5
    assert max(model.margins("this was a fine day with that and more")) < 3
    assert model.margins("") == []


def test_toxic_stems_of_many_rare_forms(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        bad = i % 9 == 0
        words = ["".join(rng.choices("aeioustnrl", k=rng.randrange(2, 9))) for _ in range(60)]
        if bad:
            # One stem a language, hardly any word form twice.
            stem = ["gräuk", "bomvé", "vilpm"][i // 9 % 3]
            for k in rng.sample(range(60), 4):
                words[k] = stem + "".join(rng.choices("aeioustnrl", k=rng.randrange(3, 7)))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), labelled.remainder(F.col("doc_id"), 3) != 1)
    scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    test = [(scores[i] >= toxicity.REJECT_FROM, bool(y)) for i, y in labels if held_out(i, 3, 1)]
    assert np.mean([got for got, y in test if y]) > 0.9 and np.mean([got for got, y in test if not y]) < 0.02


def test_quality_held_out(spark):
    docs, labels, truth = corpus(spark, "quality")
    model = line_quality.fit(docs, labels, labelled.remainder(F.col("doc_id"), 5) != 0)
    scores = {r.doc_id: r.score for r in line_quality.score_texts(docs, model).collect()}
    test = [i for i in truth if held_out(i, 5, 0)]
    assert np.mean([(scores[i] >= 0.3) == bool(truth[i]) for i in test]) > 0.97
    # Single lines are told apart, too.
    lines = ["some plain words in a row here", "sta%%% lor%%% nesa%%% tiol%%% uras%%%", "more plain words to end with"]
    good = model.marginals(line_quality.line_features(lines))
    assert good[1] < 0.2
    plain = model.marginals(line_quality.line_features([lines[0], lines[2], "and a last line of words"]))
    assert min(plain) > 0.5


def test_marginals_against_every_labelling():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        scores, moves = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        weight = np.zeros(n)
        total, pairs = 0.0, np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> t) & 1 for t in range(n)]
            w = np.exp(sum(s for s, k in zip(scores, y) if k) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            weight += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w
        marginal, expected = line_quality.forward_backward(scores, moves)
        assert marginal == pytest.approx(weight / total) and expected == pytest.approx(pairs / total)


@pytest.mark.parametrize("module", [toxicity, line_quality])
def test_awkward_rows(spark, module):
    kind = "toxic" if module is toxicity else "quality"
    docs, labels, _ = corpus(spark, kind, 80)
    model = module.fit(docs, labels)
    odd = documents(spark, AWKWARD)
    scores = {r.doc_id: r.score for r in module.score_texts(odd, model).collect()}
    assert len(scores) == len(AWKWARD) and all(0 <= s <= 1 for s in scores.values())
    assert scores[0] == scores[1] == scores[2] and scores[12] == scores[13]
    assert module.score_texts(odd.limit(0), model).collect() == []


@pytest.mark.parametrize("module", [toxicity, line_quality])
def test_labels_that_teach_nothing(spark, module):
    kind = "toxic" if module is toxicity else "quality"
    odd = documents(spark, AWKWARD)
    for rows, score in ([], 0.0), ([(0, 1), (3, 1), (3, 0), (5, 7), (None, 1), (77, 0), (6, None)], 1.0):
        labels = spark.createDataFrame(rows, f"doc_id long, {kind} int")
        model = module.fit(odd, labels)
        assert {r.score for r in module.score_texts(odd, model).collect()} <= {score}


def test_filter_keeps_columns(spark):
    docs, labels, _ = corpus(spark, "toxic", 80)
    odd = documents(spark, AWKWARD)
    kept = toxicity.filter_documents(odd, toxicity.fit(docs, labels))
    assert kept.dtypes == odd.dtypes and kept.count() == len(AWKWARD)


@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity", "toxic", 0.90), ("op4_quality_classifier", "quality", 0.95)])
def test_queries_on_tables(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
