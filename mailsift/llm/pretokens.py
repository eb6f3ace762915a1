"""Splitting text into the pieces that a byte-level vocabulary encodes one by one."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

# The split pattern of the vocabulary, narrowed to characters whose class is the same
# everywhere (printable ASCII, tab, line feed, form feed, return and the letters of Latin-1).
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIMPLE = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?(?:[{LETTERS}]+|[0-9]+|[^\s0-9{LETTERS}]+)|\s+(?!\S)|\s+"
)
OTHER = re.compile(rf"[^\t\n\x0b\x0c\r -~{LETTERS}]")


@cache
def library(path: str):
    """The tokenizers library's own object for a vocabulary file, one per worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def specials(path: str) -> tuple[dict[str, int], re.Pattern | None]:
    """Added tokens, which the library looks for in a text before it splits it."""
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
    longest_first = sorted(added, key=len, reverse=True)
    return added, re.compile("|".join(map(re.escape, longest_first))) if added else None


def split(text: str, path: str) -> list[str]:
    """Pieces of a text without added tokens; joined, they are the text."""
    if OTHER.search(text) is None:
        return SIMPLE.findall(text)
    return [text[a:b] for _, (a, b) in library(path).pre_tokenizer.pre_tokenize_str(text)]


def segments(text: str, path: str) -> Iterator[tuple[int | None, list[str]]]:
    """Runs of pieces and, between them, added tokens: (id, []) or (None, pieces)."""
    added, pattern = specials(path)
    at = 0
    for hit in pattern.finditer(text) if pattern else ():
        if hit.start() > at:
            yield None, split(text[at : hit.start()], path)
        yield added[hit.group()], []
        at = hit.end()
    if at < len(text):
        yield None, split(text[at:] if at else text, path)
