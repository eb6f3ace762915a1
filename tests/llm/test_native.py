"""The two operators that use DataFrame expressions alone."""

import math
import random

import numpy as np
import pytest

from mailsift.llm import imatch, outliers
from tests.llm.brute import AWKWARD, WORD, counts, documents, sha


def test_counts(spark):
    rng = random.Random(3)
    texts = AWKWARD + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(90))) for _ in range(60)]
    got = {r.doc_id: r for r in outliers.judged(documents(spark, texts)).select("row.doc_id", "*").collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        want = counts(text)
        assert (r[2], r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed
        assert r.kept is False if failed else r.kept in (True, False)


def vector(c):
    n = max(c[0], 1)
    return [math.log(max(c[1], 1) / n), math.log1p(10 * c[2] / n), math.sqrt(10 * c[3] / n), math.sqrt(c[4] / n)]


def robust(x):
    """The estimate in numpy: the same starts, distance classes and steps, the least determinant of all."""

    def estimate(rows):
        cov = (rows.T @ rows / len(rows) - np.outer(rows.mean(0), rows.mean(0))) * outliers.CONSISTENCY
        return rows.mean(0), cov + np.diag(np.array(outliers.FLOOR) ** 2)

    def distance(e):
        z = x - e[0]
        return np.einsum("ij,jk,ik->i", z, np.linalg.inv(e[1]), z)

    clean = x[(x[:, 1] == 0) & (x[:, 2] == 0)]
    mild = x[(x[:, 1:] <= x[:, 1:].mean(0)).all(axis=1)]
    best = None
    for part in (x, clean, mild):
        if 2 * len(part) < len(x):
            continue
        e, last = estimate(part), math.inf
        while True:
            c = np.floor(np.log2(distance(e) + 1e-9) * outliers.CLASSES_PER_DOUBLING)
            edge = np.sort(c)[math.ceil(outliers.HALF * len(c)) - 1]
            e = estimate(x[c <= edge])
            det = np.linalg.slogdet(e[1])[1]
            if best is None or det < best[0] - 1e-9:
                best = det, e
            if det >= last - outliers.LEAST_GAIN:
                break
            last = det
    return distance(best[1])


def test_the_least_determinant_of_several_starts_holds(spark):
    """Two clumps: the start from all rows ends between them, another in the tighter one."""
    rng = np.random.default_rng(4)
    tight = rng.normal(0, 0.1, (800, 4))
    far = rng.normal(0, 0.1, (400, 4)) + [4, 3, 3, 2]
    rows = [("g", *map(float, r)) for r in np.abs(np.vstack([tight, far]))]
    df = spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, x4 double").repartition(3)
    every = {r.g[0]: r for r in outliers._starts(df, True).collect()}
    assert set(every) == {"0", "2"}
    e = outliers.robust_estimates(df, True).first()
    want = robust(np.abs(np.vstack([tight, far])))
    got = outliers._with_distance(df, outliers.robust_estimates(df, True), True).orderBy("d").collect()
    assert np.allclose(sorted(want), [r.d for r in got], rtol=1e-6)
    assert e.n >= 0.75 * 1200


def test_verdicts_against_numpy(spark):
    rng = random.Random(8)
    texts, groups = [], []
    for i in range(700):
        n = rng.randrange(60, 200)
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
        if i % 10 == 0:
            words = [w + "***" for w in words]
        if i % 13 == 0:
            words = words[: n // 2] + ["stop\nsame line\nsame line\n"]
        texts.append(" ".join(words))
        groups.append(("en", "big") if i % 3 else ("de", f"small{i % 7}"))
    rows = [(i, t, *g) for i, (t, g) in enumerate(zip(texts, groups, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.doc_id: r for r in outliers.judged(docs).select("row.doc_id", "distance", "kept", "base_failed").collect()}
    for lang in ("en", "de"):
        ids = [i for i, g in enumerate(groups) if g[0] == lang and not got[i].base_failed]
        want = robust(np.array([vector(counts(texts[i])) for i in ids]))
        for i, d in zip(ids, want, strict=True):
            assert got[i].distance == pytest.approx(d, rel=1e-6, abs=1e-6)
            assert got[i].kept == (d <= outliers.CUTOFF)
    junk = [got[i].kept for i in range(0, 700, 10)]
    assert not any(junk)
    clean = [got[i].kept for i in range(700) if i % 10 and i % 13]
    assert sum(clean) >= 0.99 * len(clean)


def test_filter_keeps_columns_and_clean_rows(spark):
    docs = documents(spark, AWKWARD)
    kept = outliers.filter_documents(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert {r.doc_id for r in kept.collect()} == {12, 13}
    assert outliers.filter_documents(documents(spark, [])).count() == 0


def edits(texts):
    whole = [t or "" for t in texts]
    out = []
    for i, t in enumerate(whole):
        half = len(t) // 2
        out.append(t[: len(t) - half] + whole[(i + 1) % len(whole)][:half])
    return out


def test_fingerprints(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2500)]
    texts = AWKWARD + [" ".join(rng.choices(vocabulary, k=rng.randrange(40, 120))) for _ in range(300)]
    got = {r.doc_id: r for r in imatch.compare_with_edits(documents(spark, texts, 5)).collect()}
    assert len(got) == len(texts)
    changed = edits(texts)
    by_text = {}
    for i, text in enumerate(texts):
        r = got[i + 5]
        assert r.n_chars == len(text or "") and r.edited_sha256 == sha(changed[i])
        assert by_text.setdefault(text or "", r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if (text or "") == changed[i]:
            assert r.near_edited == 1
    tail = [got[i + 5] for i in range(len(AWKWARD), len(texts) - 1)]
    assert np.mean([r.near_edited for r in tail]) > 5 * np.mean([r.near_next for r in tail]) > 0


def test_lexicon_and_slots(spark):
    texts = [f"common w{i % 20} only{i}" for i in range(400)]
    words = imatch.lexicon(documents(spark, texts))
    assert {r.term for r in words.collect()} == {f"w{k}" for k in range(20)}
    made = imatch.Fingerprinter(words)
    rows = made.attach(documents(spark, texts)).select("doc_id", made.column(imatch.F.col("text")).alias("fingerprint"))
    prints = {r.doc_id: tuple(r.fingerprint) for r in rows.collect()}
    assert all(prints[i] == prints[i % 20] for i in range(400)) and len(set(prints.values())) > 15


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "z y"), (2, "e f g h"), (None, "q r s t"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in imatch.compare_with_edits(docs).collect())
    want = [(0, 0, sha("")), (0, 7, sha("q r ")), (1, 3, sha("z e")), (1, 7, sha("a b e f")), (1, 7, sha("a b e f")), (2, 7, sha("e f a b"))]
    assert got == sorted(want)
    assert imatch.compare_with_edits(docs.limit(0)).collect() == []


def test_words_are_those_of_the_pattern(spark):
    docs = documents(spark, AWKWARD).select("doc_id", imatch.terms(imatch.F.coalesce("text", imatch.F.lit(""))).alias("t"))
    for r in docs.collect():
        assert sorted(r.t) == sorted({w.lower() for w in WORD.findall(AWKWARD[r.doc_id] or "")})
