"""The search by collisions against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.llm import collisions

DDL = "vec_id long, embedding array<double>, query_id long, rank int, dim int, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], DDL).repartition(3)


def search(df, **how):
    found = collisions.nearest(df, F.col("vec_id") % 100 == 0, **how)
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def plain(rows, k=10):
    valid = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v]
    valid = [(i, v) for i, v in valid if np.isfinite(v).all() and v.any()]
    out = {}
    for q, x in valid:
        if q % 100 == 0:
            far = [(float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in valid if i != q and len(v) == len(x)]
            if far:
                out[q] = [(i, d) for d, i in sorted(far)[:k]]
    return out


def recall(got, want):
    pairs = {(q, i) for q, found in want.items() for i, _ in found}
    return len(pairs & {(q, i) for q, found in got.items() for i, _ in found}) / len(pairs)


def gaussian(n, dim, seed=0, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    if clusters:
        x = rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] * 10 + x * 0.05
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("clusters", [0, 40])
@pytest.mark.parametrize("least_rows", [300, 5000])
def test_recall(spark, clusters, least_rows):
    rows = gaussian(3000, 24, clusters, clusters)
    got, want = search(table(spark, rows), least_rows=least_rows), plain(rows)
    assert recall(got, want) >= 0.95
    assert set(got) == set(want)
    for q, found in got.items():
        assert len(found) == 10 and q not in dict(found)
        for i, score in found:
            assert score == pytest.approx(float(np.linalg.norm(np.subtract(rows[i][1], rows[q][1]))), rel=1e-12)


def test_few_candidates_are_all_found(spark):
    rows = gaussian(7, 5)
    got, want = search(table(spark, rows)), plain(rows)
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] and len(got[0]) == 6
    assert search(table(spark, rows[:1])) == {}


def test_rows_that_take_no_part(spark):
    rows = gaussian(50, 4)
    bad = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 0.0, 0.0, 1.0]]
    rows += [(200 + i, v) for i, v in enumerate(bad)] + [(300 + i, [1.0, 2.0]) for i in range(3)]
    rows += [(None, [0.0, 0.0, 0.0, 1.0]), (400, [float("inf")] * 4)]
    got, want = search(table(spark, rows)), plain([r for r in rows if r[0] is not None])
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    assert set(got) == {0, 300}


def test_equal_vectors_and_ties(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(400)] + [(1000 + i, [1.0, 2.0, 3.0 + i]) for i in range(1, 30)]
    got = search(table(spark, rows), least_rows=100)
    assert [i for i, _ in got[0]] == list(range(1, 11))
    assert [i for i, _ in got[200]] == list(range(10))
    assert {d for _, d in got[0]} == {0.0}


def test_repeated_ids(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.1]), (5, [1.0, 0.2]), (5, [1.0, 0.3])]
    found = collisions.nearest(table(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(100, 1, 5), (100, 1, 5), (100, 2, 5), (100, 2, 5)]


def test_windows_hold_what_the_threshold_says():
    least = collisions.threshold(64, 0.02)
    rng = np.random.default_rng(1)
    hits = (np.abs(rng.standard_normal((20_000, 64))) <= 1).sum(axis=1)
    assert 0 < (hits < least).mean() <= 0.025


def test_empty_table(spark):
    assert search(table(spark, [])) == {}
