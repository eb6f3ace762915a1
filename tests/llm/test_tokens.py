"""Encoding, counting and packing against the tokenizers library."""

import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mailsift.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
EDGE = [
    None,
    "",
    " ",
    "\n\n  \t",
    "It's we'll I'd they've 'tis '''s",
    "trailing   blanks   \n\nand  lines \r\n",
    "naïve façade ÿ × ÷ ª º µ",
    "한국어 텍스트와 中文 １２３ ①② ½",
    "emoji 👩‍👩‍👧 é ​ x\x1c\x1dy\x85z ",
    "a<|endoftext|>b<|endoftext|><|endoftext|> c <|endoftext",
    "x" * 3000,
    "ab" * 4000 + " " + "!?" * 900,
    "same text",
    "same text",
]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def random_text(rng, n):
    alphabet = "aabcdeee  \n\t'.,!0129ÄéßAZ<|>한'st"
    return "".join(rng.choice(alphabet) for _ in range(n))


def docs(spark, texts):
    rows = [(i, t, "en", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, piece long").repartition(3)


def test_encode_matches_the_library():
    rng = random.Random(5)
    for text in [*EDGE, *(random_text(rng, rng.randrange(200)) for _ in range(300))]:
        assert bpe.encode(text or "", PATH) == ids(text)
        assert bpe.decode(ids(text), PATH) == LIBRARY.decode(ids(text), skip_special_tokens=False)


def test_decode_of_cut_characters():
    some = ids("한국어 텍스트")
    for a in range(len(some)):
        assert bpe.decode(some[a:], PATH) == LIBRARY.decode(some[a:], skip_special_tokens=False)


def test_round_trip(spark):
    got = {r.doc_id: r for r in bpe.round_trip(docs(spark, EDGE), PATH).collect()}
    assert len(got) == len(EDGE)
    for i, text in enumerate(EDGE):
        want = ids(text)
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        back = LIBRARY.decode(want, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def check_packing(rows, texts, length):
    """Rows are every piece of every text once, in sequences without gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    total = 0
    for i, text in enumerate(texts):
        want = [*ids(text), 0]
        total += len(want)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(math.ceil(len(want) / length)))
        assert all(r.length == length for r in pieces[1:])
        at = 0
        for r in pieces:
            cut = want[at : at + r.length]
            assert r.start == at and r.length == len(cut)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))
            at += r.length
        assert at == len(want)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(by_sequence), math.ceil(total / length)


def test_packing_edge_cases(spark):
    rows = packing.pack_documents(docs(spark, EDGE), PATH, 2048).collect()
    used, least = check_packing(rows, EDGE, 2048)
    assert used <= least + 1


@pytest.mark.parametrize("items", [40, 20_000])
def test_packing_is_tight(spark, monkeypatch, items):
    monkeypatch.setattr(packing, "ITEMS", items)
    rng = random.Random(items)
    texts = [random_text(rng, int(rng.expovariate(1 / 90))) for _ in range(600)]
    used, least = check_packing(packing.pack_documents(docs(spark, texts), PATH, 128).collect(), texts, 128)
    assert used <= 1.03 * least


def test_packing_of_nothing(spark):
    assert packing.pack_documents(docs(spark, []), PATH).collect() == []


def test_best_fit_takes_the_tightest_bin():
    import numpy as np

    assert packing.best_fit(np.array([7, 6, 3, 4]), 10) == [[0, 2], [1, 3]]
    assert packing.best_fit(np.array([6, 5, 4, 1]), 10) == [[0, 2], [1, 3]]


def edited(text, edits):
    for position, delete, insert in sorted(edits, reverse=True):
        position = min(position, len(text))
        text = text[:position] + insert + text[position + delete :]
    return text


def test_counts_follow_edits():
    rng = random.Random(11)
    for _ in range(150):
        text = random_text(rng, rng.choice([0, 5, 300, 3000]))
        doc = token_counts.CountedText(text, PATH)
        assert doc.total == len(ids(text))
        for _ in range(8):
            e = rng.randrange(len(text) + 2), rng.choice([0, 1, 40, 900]), random_text(rng, rng.choice([0, 1, 30, 700]))
            doc.edit(*e)
            text = edited(text, [e])
            assert doc.total == len(ids(text))
            assert "".join(doc.piece(i) for i in range(doc.n_pieces)) == text


def test_an_edit_touches_few_pieces():
    text = "some ordinary words in a long line " * 2000
    doc = token_counts.CountedText(text, PATH)
    doc.edit(30_000, 5, "other")
    assert doc.encoded < 20
    assert doc.total == len(ids(edited(text, [(30_000, 5, "other")])))


def test_count_with_edits(spark):
    edits = [(4, 3, 2, "x y"), (4, 3, 2, "x y"), (6, None, None, None), (6, -4, 1, "é"), (7, 10**6, 5, " end"), (99, 1, 1, "q")]
    frame = spark.createDataFrame(edits, "doc_id long, position long, delete long, insert string")
    got = {r.doc_id: r for r in token_counts.count_with_edits(docs(spark, EDGE), frame, PATH).collect()}
    assert len(got) == len(EDGE)
    for i, text in enumerate(EDGE):
        own = [(max(p or 0, 0), max(n or 0, 0), s or "") for d, p, n, s in edits if d == i]
        assert got[i].n_tokens == len(ids(text))
        assert got[i].edited_tokens == len(ids(edited(text or "", own)))
        assert got[i].n_edits == len(own)


def test_packing_of_one_id_and_of_none(spark, monkeypatch):
    """One id, or none, in most rows: no task gets more than its share, and every row is packed."""
    monkeypatch.setattr(packing, "ITEMS", 100)
    rows = [(None if i % 3 == 0 else 7, f"text {i % 5}") for i in range(900)] + [(1000 + i, f"row {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt = []
    real = packing._round

    def watched(items, capacity, tasks):
        out = real(items, capacity, tasks).cache()
        dealt.append((tasks, max(r["n"] for r in out.selectExpr("task", "size(members) n").groupBy("task").sum("n").toDF("task", "n").collect())))
        return out

    monkeypatch.setattr(packing, "_round", watched)
    got = packing.pack_documents(df, PATH, length=64).collect()
    assert sum(r.doc_id is None for r in got) == 300 and sum(r.doc_id == 7 for r in got) == 600 and len(got) == 1000
    assert dealt[0][0] == 10 and dealt[0][1] < 200
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
