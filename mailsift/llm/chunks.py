"""Repeated passages found by content-defined chunks and removed from all but one place.

A gear rolling hash over the last 16 bytes decides after which words a chunk ends, so that a passage
falls into the same chunks wherever it stands and insertions shift nothing behind them. In scripts
without blanks a chunk may end after any character, and a character counts as a word. What is compared
are stretches: from each chunk on, and up to each, as many chunks as hold ``MIN_WORDS`` words. So whatever is cut lies in
stretches of that many words that one other document holds as a whole; chunks from here and there never
add up to one, and shorter chance repeats and set phrases stay.

A stretch that several documents hold, or one document holds twice, belongs to the document of the
smallest id, there to its first place; everywhere else its chunks are cut out. A second place in the same
document counts if it doesn't overlap the first.

Stretches are compared by 64-bit digests. Null texts stay null, empty ones empty. Rows that repeat an id
are one document: the id's first place holds in each of them. Rows without an id own nothing: they lose
what any document with an id holds as well, and keep the rest. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from mailsift.llm.frames import map_rows

# One word end in so many ends a chunk. A longer chunk may end inside a word, or is cut anyhow.
WORDS_A_CHUNK = 6
MAX_BYTES = 512
MIN_WORDS = 20

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
# First bytes of three-byte characters of kana, Han and their signs, which stand without blanks.
WIDE = np.zeros(256, dtype=bool)
WIDE[0xE3:0xEA] = True
GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256, dtype=np.uint16)
LIMIT = (1 << 16) // WORDS_A_CHUNK
# The same for characters inside words that are longer than MAX_BYTES.
INSIDE = (1 << 16) // 128


def chunk_ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of a text's bytes, the last its length, and the number of words up to each."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # h[i] = sum of GEAR[b[i - j]] << j over the last 16 bytes, by doubling.
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        more = h.copy()
        more[width:] += h[:-width] << np.uint16(width)
        h = more
    blank, wide = BLANK[data], WIDE[data]
    word_end = blank.copy()
    word_end[:-1] &= ~blank[1:]
    word_end[2:] |= wide[:-2]
    begins = ~blank
    begins[1:] &= blank[:-1] | wide[1:]
    words = np.cumsum(begins)
    ends = np.flatnonzero(word_end & (h < LIMIT)) + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    if np.diff(ends, prepend=0).max() > MAX_BYTES:
        first = (data & 0xC0) != 0x80
        inside = h < INSIDE
        inside[:-1] &= first[1:]
        ends = np.array(_shorter(ends.tolist(), np.flatnonzero(inside) + 1, first))
    return ends, words[ends - 1]


def _shorter(ends: list[int], inside: np.ndarray, first: np.ndarray) -> list[int]:
    """Long chunks cut where the hash says so inside words, and else at a character after MAX_BYTES."""
    out, at = [], 0
    for end in ends:
        if end - at > MAX_BYTES:
            for cut in [*inside[np.searchsorted(inside, at, "right") : np.searchsorted(inside, end)].tolist(), end]:
                while cut - at > MAX_BYTES:
                    at += MAX_BYTES
                    while not first[at]:
                        at -= 1
                    out.append(at)
                if cut > at and cut != end:
                    out.append(cut)
                    at = cut
        out.append(end)
        at = end
    return out


def stretches(text: str, min_words: int = MIN_WORDS) -> tuple[bytes, list[int], list[tuple[int, int, int]]]:
    """A text's bytes, its chunks' ends, and its stretches (first chunk, last chunk, digest)."""
    data = text.encode()
    ends, words = chunk_ends(np.frombuffer(data, dtype=np.uint8))
    ends_ = ends.tolist()
    before = np.concatenate([[0], words])
    # The first chunk at which the words since the start are enough.
    last = np.searchsorted(before, before[:-1] + min_words, "left") - 1
    n = int((last < len(ends_)).sum())
    if not n:
        return data, ends_, []
    # Chunks that no such stretch ends with get one that begins as late as it may.
    others = np.setdiff1d(np.arange(last[0], len(ends_)), last[:n])
    starts = np.searchsorted(before, before[others + 1] - min_words, "right") - 1
    spans = sorted([*enumerate(last[:n].tolist()), *zip(starts.tolist(), others.tolist(), strict=True)])
    digest, at, parts = xxhash.xxh3_64_digest, 0, []
    for end in ends_:
        parts.append(digest(data[at:end].strip()))
        at = end
    whole, found = b"".join(parts), []
    for i, j in spans:
        found.append((i, j, xxhash.xxh3_64_intdigest(whole[8 * i : 8 * j + 8]) - (1 << 63)))
    return data, ends_, found


def _row_key(text: str) -> Column:
    """Tells rows of one id, or of none, apart."""
    return F.xxhash64(F.col(text).cast("string"))


def shared_stretches(documents: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row_key and the digests of stretches that are held elsewhere too (``foreign``) or repeated in it (``own``)."""

    def rows(slices):
        for part in slices:
            out = []
            for doc_id, row_key, whole in zip(part["doc_id"], part["row_key"], part["text"], strict=True):
                if whole:
                    times: dict[int, int] = {}
                    for _, _, digest in stretches(whole, min_words)[2]:
                        times[digest] = times.get(digest, 0) + 1
                    out.extend((digest, doc_id, row_key, k) for digest, k in times.items())
            yield out

    texts = documents.select(
        F.col(key).cast("long").alias("doc_id"), _row_key(text).alias("row_key"), F.col(text).cast("string").alias("text")
    )
    found = map_rows(texts, rows, "digest long, doc_id long, row_key long, times int")
    held = found.groupBy("digest").agg(F.sum("times").alias("n"), F.min("doc_id").alias("owner"))
    held = held.filter("n > 1").select(F.col("digest").alias("_d"), "owner")
    met = found.select("digest", "doc_id", "row_key").join(held, F.col("digest") == F.col("_d"))
    own = F.col("doc_id").eqNullSafe(F.col("owner"))
    foreign = F.col("owner").isNotNull() & ~own
    # A row's own set: no more digests than its text has chunks, however often the row or its id stands.
    return met.groupBy("doc_id", "row_key").agg(
        F.collect_set(F.when(foreign, F.col("digest"))).alias("foreign"),
        F.collect_set(F.when(own & F.col("doc_id").isNotNull(), F.col("digest"))).alias("own"),
    )


def repeated(n_chunks: int, found: list[tuple[int, int, int]], foreign: set[int], own: set[int]) -> np.ndarray:
    """Which chunks lie in a stretch that belongs to another document or to an earlier place of this one."""
    steps = np.zeros(n_chunks + 1, dtype=np.int64)
    ended: dict[int, int] = {}
    for i, j, digest in found:
        again = False
        if digest in own:
            again = ended.setdefault(digest, j) < i
        if again or digest in foreign:
            steps[i] += 1
            steps[j + 1] -= 1
    return np.cumsum(steps[:-1]) > 0


def duplicate_runs(ends: list[int], duplicate: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of maximal runs of duplicate chunks."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], duplicate.astype(np.int8), [0]])))
    starts = [0, *ends]
    return [(starts[a], starts[b]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType())]))


def deduplicated(documents: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents' rows (struct ``row``, its text replaced), chunk counts and the spans removed.

    Spans are in characters of the old text.
    """
    shared = shared_stretches(documents, key, text, min_words)
    kept = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        F.col(key).cast("long").alias("_id"),
        _row_key(text).alias("_key"),
    )
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("row_key"))
    joined = kept.join(shared, same, "left").select("row", "foreign", "own")
    schema = StructType(
        [
            joined.schema["row"],
            StructField("n_chunks", LongType()),
            StructField("n_duplicate_chunks", LongType()),
            StructField("removed", SPANS),
        ]
    )

    def clean(whole: str, foreign: set, own: set) -> tuple[str, int, int, list[dict]]:
        data, ends, found = stretches(whole, min_words)
        duplicate = repeated(len(ends), found, foreign, own)
        spans = duplicate_runs(ends, duplicate)
        parts, at, places = [], 0, []
        for a, b in spans:
            parts.append(data[at:a])
            places.append({"start": len(data[:a].decode()), "length": len(data[a:b].decode())})
            at = b
        return b"".join([*parts, data[at:]]).decode(), len(ends), int(duplicate.sum()), places

    def run(batches):
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(start, 256)
                struct = batch.column(0)
                at = struct.type.get_field_index(text)
                texts = struct.field(at).to_pylist()
                results = [
                    clean(t, set(f or ()), set(o or ())) if t else (t, 0, 0, [])
                    for t, f, o in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
                ]
                new, chunks, dups, spans = zip(*results, strict=True)
                fields = [pa.array(new, struct.type.field(i).type) if i == at else struct.field(i) for i in range(struct.type.num_fields)]
                row = pa.StructArray.from_arrays(fields, fields=list(struct.type))
                span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                columns = [row, pa.array(chunks, pa.int64()), pa.array(dups, pa.int64()), pa.array(spans, span_type)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their columns, repeated passages cut out of their texts."""
    return deduplicated(documents, key, text, min_words).select("row.*")
