"""Components of alike documents against comparing every pair."""

import random

import numpy as np
import pytest

from mailsift.llm import queries, shingle_join
from tests.llm.brute import AWKWARD, WORD, documents
from tests.oracle import compare, connect


def plain_set(text, width=4):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_components(texts, percent=85, width=4):
    sets = [plain_set(t, width) for t in texts]
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], ["new%d" % rng.randrange(999)], [words[i], "in%d" % rng.randrange(999)]])
    return " ".join(words)


def corpus(rng):
    texts = list(AWKWARD)
    for _ in range(60):
        n = rng.choice([3, 5, 8, 12, 20, 40, 80, 200])
        base = " ".join(f"{rng.choice('abcdeF')}{rng.randrange(60)}" for _ in range(n))
        texts.append(base)
        for _ in range(rng.randrange(4)):
            texts.append(edited(rng, base, rng.randrange(0, max(2, n // 20))) or "gone")
    chain = " ".join(f"k{i}" for i in range(100))
    for _ in range(12):
        texts.append(chain)
        chain = edited(rng, chain, 2)
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_pair(spark, seed):
    texts = corpus(random.Random(seed))
    got = shingle_join.linked_components(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(texts)


def test_crowds_are_compared_by_blocks(spark, monkeypatch):
    """Many near copies of one text, around the limit, with segments shared by most of them."""
    monkeypatch.setattr(shingle_join, "CROWD", 4)
    monkeypatch.setattr(shingle_join, "BLOCK", 25)
    rng = random.Random(12)
    base = " ".join(f"b{i}" for i in range(150))
    texts = [edited(rng, base, rng.randrange(2, 9)) for _ in range(130)] + corpus(rng)
    got = shingle_join.linked_components(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(texts)


def test_alike_sets_share_a_key():
    """Random pairs close to the limit, over all sizes where bands and numbers of segments change."""
    rng = np.random.default_rng(4)
    for size in [*range(1, 60), 75, 120, 333, 1000]:
        for _ in range(12):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            gone = int(rng.integers(0, size * 15 // 100 + 1))
            room = (100 * (size - gone) - 85 * size) // 85
            added = int(rng.integers(0, max(room, 0) + 1))
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, added, dtype=np.uint64)])
            x, y = np.unique(a), np.unique(b)
            if len(y) and shingle_join.alike(x, y):
                assert set(shingle_join.signatures(x).tolist()) & set(shingle_join.signatures(y).tolist()), (size, gone, added)


def test_bands_hold_alike_sizes():
    plan = shingle_join.bands(85)
    for size in range(1, 3000):
        assert plan.band(size * 100 // 85) - plan.band(size) in (0, 1)


def test_other_widths_and_limits(spark):
    texts = corpus(random.Random(7))[:90]
    got = shingle_join.linked_components(documents(spark, texts), width=2, percent=70).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(texts, 70, 2)


def test_one_of_each(spark):
    texts = corpus(random.Random(3))
    docs = documents(spark, texts)
    kept = shingle_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in plain_components(texts)})


def test_one_row_of_repeated_and_missing_ids(spark):
    same, other = "one two three four five six", "seven eight nine ten eleven"
    rows = [(1, same), (1, same), (1, "One  two three four five six"), (None, same), (None, same), (2, same), (3, other)]
    rows += [(3, "quite another text of some words"), (None, "only nameless rows have this"), (None, "only  nameless rows have this")]
    rows += [(4, ""), (4, None), (None, " "), (None, " ")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, comp string").repartition(3)
    kept = shingle_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id or 0), " ".join((r.text or "").lower().split())) for r in kept.collect())
    assert got == sorted(
        [(1, same), (3, other), (3, "quite another text of some words"), (0, "only nameless rows have this")]
        + [(4, ""), (4, ""), (0, ""), (0, "")]
    )


def test_ids_that_repeat_or_lack(spark):
    rows = [(1, "a b c d e"), (1, "q r s t u"), (5, "q r s t u"), (9, "a b c d e"), (None, "a b c d e"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in shingle_join.linked_components(docs).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (5, 1), (7, 7), (9, 1)]
    assert shingle_join.linked_components(docs.limit(0)).collect() == []


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    """Labels, pairs, sizes and texts are dealt out, however small Spark takes them to be."""
    plans, cut = [], shingle_join.cut_lineage
    monkeypatch.setattr(shingle_join, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    docs = documents(spark, corpus(random.Random(5)))
    found = shingle_join.linked_components(docs)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    # By digest or segment, where a key may be hot, and the ids wanted, which are counted before.
    assert sum("SortMergeJoin" in plan for plan in plans) >= 10
    assert all("[d1#" in line or "[sig#" in line or "LeftSemi" in line for line in joins), joins
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")
    assert sorted(map(tuple, shingle_join.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)]


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(connect(sf), queries.QUERIES["op9_shingle_join"](spark, sf), queries.SQL["op9_shingle_join"]) == []
