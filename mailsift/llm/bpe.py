"""Byte-pair encoding by a queue of merge ranks over a doubly linked list of symbols.

``encode`` gives the ids the tokenizers library gives, ``decode`` concatenates vocabulary strings.
Pieces repeat, so each worker keeps the ids of pieces it has met, up to a number of them.

Empty and null texts have no ids and decode to an empty text. Rows without an id and repeated rows are
encoded one by one; of two merges of equal rank the one further left goes first. An empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from array import array
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame

from mailsift.llm.frames import keyed_texts, map_rows
from mailsift.llm.pretokens import segments

# Pieces whose ids a worker keeps; beyond it the store starts anew (results do not change).
KEPT_PIECES = 400_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary's strings.

    Bytes that print stand for themselves; the others follow from code point 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge table and strings of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        symbols = byte_symbols()
        ids: dict[str, int] = data["model"]["vocab"]
        every = ids | {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.strings = [b""] * (max(every.values()) + 1)
        for token, number in every.items():
            self.strings[number] = bytes(symbols[c] for c in token)
        self.of_byte = [0] * 256
        for symbol, byte in symbols.items():
            self.of_byte[byte] = ids[symbol]
        # (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece: always merge the pair of least rank, the leftmost first."""
        of_byte, merges = self.of_byte, self.merges
        ids = [of_byte[b] for b in piece.encode()]
        n = len(ids)
        queue = []
        for i in range(n - 1):
            merge = merges.get((ids[i], ids[i + 1]))
            if merge is not None:
                queue.append((merge[0], i, merge[1], ids[i], ids[i + 1]))
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, i, merged, left, right = heapq.heappop(queue)
            j = after[i] if ids[i] >= 0 else n
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two was merged meanwhile
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                merge = merges.get((merged, ids[k]))
                if merge is not None:
                    heapq.heappush(queue, (merge[0], i, merge[1], merged, ids[k]))
            h = before[i]
            if h >= 0:
                merge = merges.get((ids[h], merged))
                if merge is not None:
                    heapq.heappush(queue, (merge[0], h, merge[1], ids[h], merged))
        return [x for x in ids if x >= 0]


class PieceBytes(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers, worked out when first asked for."""

    def __init__(self, encode: Callable[[str], list[int]], kept: int = KEPT_PIECES):
        super().__init__()
        self.encode, self.kept = encode, kept

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.kept:
            self.clear()
        ids = self.encode(piece)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = found
        return found


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def pieces_by_queue(path: str) -> PieceBytes:
    return PieceBytes(vocabulary(path).encode_piece)


def encode_bytes(text: str, path: str, pieces: PieceBytes) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    out = []
    for special, run in segments(text, path):
        if special is None:
            out.extend(map(pieces.__getitem__, run))
        else:
            out.append(struct.pack("<I", special))
    return b"".join(out)


def encode(text: str, path: str) -> list[int]:
    data = encode_bytes(text, path, pieces_by_queue(path))
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def decode(ids: list[int] | array, path: str) -> str:
    """Concatenated vocabulary strings; bytes that form no character become U+FFFD."""
    return b"".join(map(vocabulary(path).strings.__getitem__, ids)).decode("utf-8", "replace")


def round_trip(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids, digest of the ids and digest of the text decoded from them."""

    def rows(slices):
        pieces = pieces_by_queue(path)
        for part in slices:
            out = []
            for doc_id, whole in zip(part["doc_id"], part["text"], strict=True):
                data = encode_bytes(whole, path, pieces)
                ids = array("I", data)
                back = decode(ids, path).encode()
                out.append((doc_id, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield out

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(keyed_texts(documents, key, text), rows, ddl)
