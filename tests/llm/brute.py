"""Plain Python versions of what the operators work out, and awkward rows to try them on."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")

AWKWARD = [
    None,
    "",
    "   \n\t \r\n",
    "one",
    "two words",
    "one line\none line\n\n  \n\none line ",
    "a b c a b c a b c",
    "x # y * z $$$ %% && || <> end",
    "no break here \x85 x\x1cx",
    "équipe À LA française ÉTÉ " * 4,
    "한국어 문장 이다 " * 20,
    "word " * 60,
    " ".join(f"w{i}" for i in range(60)),
    " ".join(f"w{i}" for i in range(60)),
    "z" * 5000,
    " ".join(f"long{i * i % 977}" for i in range(20_000)),
]


def documents(spark, texts, first_id=0):
    """A documents table with columns whose names clash with those the operators make."""
    rows = [(first_id + i, t, "en" if i % 3 else None, f"s{i % 2}", 0, -1, "x") for i, t in enumerate(texts)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string"
    return spark.createDataFrame(rows, ddl).repartition(3)


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
