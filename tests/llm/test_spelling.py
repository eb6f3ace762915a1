"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mailsift.llm import spelling
from tests.llm.brute import AWKWARD, documents


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if one_edit(w, v)]
        less, form = min(near, default=(0, None))
        fits = form is not None and -less >= 2 * n
        out[w] = (form if fits else None, n, len(near), -less if fits else None)
    roots = {}
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        roots[w] = root
    return {w: (f, roots[w], n, k, fn) for w, (f, n, k, fn) in out.items()}


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def vocabulary(seed, size=500):
    rng = random.Random(seed)
    words = {}
    while len(words) < size:
        w = "".join(rng.choice("abcdéß") for _ in range(rng.choice([5, 5, 6, 6, 7, 12])))
        words[w] = rng.choice([3, 3, 4, 6, 12, 25, 50, 100, 1000])
    words |= {"z" * 5000: 9, "z" * 5001: 20, "y" + "z" * 4999: 9, "漢字漢字漢字": 5, "漢字漢字漢": 12, "😀bcdef": 4, "abcde😀": 4}
    return words


# One cell a length; trees of many cells; cells of words with the same letters, cut into pieces and slices.
@pytest.mark.parametrize("sizes", [{}, {"cell": 20}, {"cell": 3, "queries": 40, "sample": 60}])
def test_equals_all_pairs(spark, sizes):
    words = vocabulary(len(sizes))
    for i in range(60):
        word = list("abcdefgh")
        random.Random(i).shuffle(word)
        words["".join(word)] = 3 + i
    rows = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n int, form string")
    assert result(spelling.grouped(rows, **sizes)) == plain(words)


def test_long_chain_of_forms(spark):
    words = {"a" * i + "b" * (40 - i): 3 << i for i in range(30)}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    found = result(spelling.grouped(rows))
    assert found == plain(words)
    assert {r[1] for r in found.values()} == {"a" * 29 + "b" * 11}


def test_leaves_part_all_words_and_balls_lose_none():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(8)) for _ in range(3000)]
    codes = spelling.letters(words, 8)
    tree = spelling.grow(codes[:500], 3000, 100)
    assert not isinstance(tree, int)
    home = np.full(len(words), -1)
    for leaf, of, far in spelling.reached(tree, codes, 2):
        own = of[far == 0]
        assert (home[own] == -1).all()
        home[own] = leaf
    assert (home >= 0).all()
    met = {(leaf, int(i)) for leaf, of, _ in spelling.reached(tree, codes[:200], 2) for i in of}
    for i in range(200):
        for j, w in enumerate(words):
            if one_edit(words[i], w):
                assert (int(home[j]), i) in met


def test_counted_words(spark):
    texts = [*AWKWARD, "Größe größe GRÖSSE ×÷×÷×÷ " * 30, "abcdef abcdeg " * 500, "ABCDEF abcdef\nabcdef2abcdef"]
    texts += [f"wordy{'x' * (i % 7)} another" for i in range(200)]
    want = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if n >= 3 and len(w) >= 5}
    got = {r.word: r.n for r in spelling.counted_words(documents(spark, texts)).collect()}
    assert got == want and len(want) > 10
    assert result(spelling.grouped(spelling.counted_words(documents(spark, texts)))) == plain(want)


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "hello hello hello"), (1, None)], "doc_id long, text string")
    assert [tuple(r) for r in spelling.counted_words(docs).collect()] == [("hello", 3)]
    assert spelling.grouped(spelling.counted_words(docs.limit(0))).count() == 0


def test_a_ratio_of_one_would_lead_back(spark):
    with pytest.raises(ValueError):
        spelling.grouped(spark.createDataFrame([("abcde", 3)], "word string, n long"), ratio=1)
