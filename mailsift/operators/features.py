"""Vocabulary and fixed-length encoding."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mailsift.functions.text import EN_WORD, NUM_TOKEN, URL_TOKEN, WS_CHARS, char_tokens, marked_chars, marked_words, tokens
from mailsift.operators.scaling import BROADCAST_ROWS, HashLookup, cut_lineage, lookup_join, size_up_to, spread
from mailsift.schema import (
    EN_MAX_LEN,
    EN_VOCAB_SIZE,
    KO_MAX_LEN,
    KO_VOCAB_SIZE,
    MIN_FREQ,
    PAD_ID,
    PAD_TOKEN,
    UNK_ID,
    UNK_TOKEN,
    VOCABULARY,
)

MAX_LEN = {"ko": KO_MAX_LEN, "en": EN_MAX_LEN}
# A vocabulary up to this size is looked up in place; about 30 MB per task.
LOOKUP_ROWS = 1_000_000
VOCAB_SIZE = {"ko": KO_VOCAB_SIZE, "en": EN_VOCAB_SIZE}


def _tokens(lang: str, words: str | None) -> Column:
    """The token arrays of ``words`` where they are at hand, else those of the text."""
    return F.col(words) if words else tokens("text", lang)


_SPACES = frozenset(WS_CHARS)
_MARKER = re.compile(f"(?<![^{WS_CHARS}])(?:{URL_TOKEN}|{NUM_TOKEN})(?![^{WS_CHARS}])")


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and first row of the character tokens of a batch of marked texts."""
    for batch in batches:
        sums, firsts = {}, {}
        for row, times, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if text is None:
                continue
            marks = _MARKER.findall(text) if URL_TOKEN in text or NUM_TOKEN in text else []
            counted = Counter(_MARKER.sub("", text) if marks else text)
            counted.update(marks)
            for token, n in counted.items():
                if token in _SPACES:
                    continue
                if times is not None:
                    sums[token] = sums.get(token, 0) + n * times
                known = firsts.setdefault(token, row)
                if row is not None and (known is None or row < known):
                    firsts[token] = row
        columns = [
            pa.array(list(firsts), pa.string()),
            pa.array([sums.get(t) for t in firsts], pa.int64()),
            pa.array(list(firsts.values()), batch.column(0).type),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "n", "first_row"])


# A marker of a whole chunk; it begins with a plain character, which is quick to look for.
_CHUNK = f"<(?<![^{WS_CHARS}]<)(?:url|num)>(?![^{WS_CHARS}])"
_CHUNKS = re.compile(_CHUNK)
_EN_TOKENS = re.compile(f"{EN_WORD}|{_CHUNK}")
# Stand for markers where characters are counted; no text that UTF-8 can hold has them.
_STAND_INS = {URL_TOKEN: "\ud800", NUM_TOKEN: "\ud801"}
_STOOD_FOR = {v: k for k, v in _STAND_INS.items()}


def _count_chars(marked: str) -> dict[str, int]:
    if "<" in marked:
        marked = _CHUNKS.sub(lambda m: _STAND_INS[m[0]], marked)
    return {_STOOD_FOR.get(t, t): n for t, n in Counter(marked).items() if t not in _SPACES}


def _count_words(marked: str) -> dict[str, int]:
    return Counter(_EN_TOKENS.findall(marked))


def _row_counter(lang: str) -> Callable[[str], dict[str, int]]:
    """Of a marked text: each token and how often, by first appearance."""
    return _count_chars if lang == "ko" else _count_words


def _marked_text(text: str, lang: str) -> Column:
    return marked_chars(text) if lang == "ko" else marked_words(text)


_COUNTED = "words array<string>, times array<int>"
_VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def _texts(texts: pa.Array) -> Iterator[str | None]:
    return (t.as_py() for t in texts)


def counted_tokens(text: str, lang: str) -> Column:
    """words and times: the tokens of a text by first appearance, each once, and how often; null for null.

    As ``tokens`` counted, in a fraction of the space: what is counted never becomes an array of all tokens.
    """
    count = _row_counter(lang)

    def counted(marked: pa.Array) -> pa.Array:
        found = [None if t is None else count(t) for t in _texts(marked)]
        words = _lists([None if c is None else list(c) for c in found], pa.string())
        times = _lists([None if c is None else list(c.values()) for c in found], pa.int32())
        return pa.StructArray.from_arrays([words, times], ["words", "times"], mask=marked.is_null())

    return F.arrow_udf(counted, _COUNTED)(_marked_text(text, lang))


def _vectors(ids: np.ndarray, times: np.ndarray, per_row: np.ndarray, size: int, missing: pa.Array) -> pa.Array:
    """Sparse vectors in Spark's form of them, of ``per_row`` ids and counts each; unknown tokens have the id -1."""
    rows, known = np.repeat(np.arange(len(per_row)), per_row), ids >= 0
    rows, ids, times = rows[known], ids[known], times[known]
    order = np.lexsort((ids, rows))
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(per_row)))]).astype(np.int32)
    indices = pa.ListArray.from_arrays(ends, ids[order].astype(np.int32))
    values = pa.ListArray.from_arrays(ends, times[order].astype(np.float64))
    n = len(per_row)
    parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), indices, values]
    return pa.StructArray.from_arrays(parts, fields=list(_VECTOR), mask=missing)


def text_vectors(text: str, lang: str, words: Sequence[str]) -> Column:
    """Token counts of a text as a CountVectorizerModel of ``words`` gives them for its ``tokens``."""
    count, known = _row_counter(lang), {w: i for i, w in enumerate(words)}

    def vectors(marked: pa.Array) -> pa.Array:
        ids, times, per_row = array("i"), array("i"), []
        for text in _texts(marked):
            counted = {} if text is None else count(text)
            ids.extend([known.get(t, -1) for t in counted])
            times.extend(counted.values())
            per_row.append(len(counted))
        return _vectors(np.array(ids), np.array(times), np.array(per_row, np.int64), len(known), marked.is_null())

    return F.arrow_udf(vectors, VectorUDT())(_marked_text(text, lang))


def counted_vectors(found: str, times: str, words: Sequence[str]) -> Column:
    """As ``text_vectors``, of the columns of ``counted_tokens``."""
    words = list(words)

    def vectors(tokens: pa.Array, counts: pa.Array) -> pa.Array:
        each = tokens.flatten()
        ids = pc.index_in(each, value_set=pa.array(words, each.type)).fill_null(-1).to_numpy(zero_copy_only=False)
        per_row = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False)
        return _vectors(ids, counts.flatten().to_numpy(zero_copy_only=False), per_row, len(words), tokens.is_null())

    return F.arrow_udf(vectors, VectorUDT())(found, times)


def token_counts(
    corpus: DataFrame, lang: str, order: str, copies: str | None = None, words: str | None = None, by: str | None = None,
    times: str | None = None,
) -> DataFrame:
    """Per token: how often it occurs and the smallest ``order`` value of a row holding it.

    Both are plain longs, summed by hash before the shuffle: a token that occurs everywhere
    costs one row per task. ``copies`` names a column with how often a row counts, ``words`` one
    with the tokens, if they were made before, ``by`` one to count apart by (with ``words``), ``times`` one
    with how often each of ``words`` occurs, if they hold every token once.
    Characters of texts are counted text by text and never become rows of their own.
    """
    if by and not words:
        raise ValueError("counts apart by a column need tokens that were made before")
    apart, often = [by] if by else [], [times] if times else []
    weight = F.col(copies) if copies else F.lit(1)
    kept = corpus.select(*apart, F.col(order).alias("first_row"), weight.cast("bigint").alias("n"), words or "text", *often)
    rows = kept if words else spread(kept, "first_row")
    if lang == "ko" and not words:
        out = T.StructType().add("token", "string").add("n", "long").add("first_row", kept.schema["first_row"].dataType)
        each = rows.select("first_row", "n", marked_chars("text").alias("text")).mapInArrow(_char_counts, out)
    elif times:
        pairs = F.explode(F.arrays_zip(F.col(words).alias("token"), F.col(times).alias("times")))
        each = rows.select(*apart, "first_row", "n", pairs.alias("_pair"))
        each = each.select(*apart, "first_row", (F.col("n") * F.col("_pair.times")).alias("n"), "_pair.token")
    else:
        each = rows.select(*apart, "first_row", "n", F.explode(_tokens(lang, words)).alias("token"))
    return each.groupBy(*apart, "token").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))


def vocabulary(
    corpus: DataFrame,
    lang: str,
    order: str,
    min_freq: int = MIN_FREQ,
    max_size: int | None = None,
    specials: bool = False,
    copies: str | None = None,
    words: str | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """token and id: most frequent first, ties by first appearance, ids from 2.

    ``counts`` are the ``token_counts`` of ``corpus``, if they were made before.
    The text is tokenized once for the counts. Where tokens tie in count and in the row they
    first appear in, their place within that row decides; it is looked up only for the tied
    tokens that can make the cut, in their first rows (at most ``max_size`` and one row's tokens).
    """
    size = max_size or VOCAB_SIZE[lang]
    counts = token_counts(corpus, lang, order, copies, words) if counts is None else counts
    counted = cut_lineage(counts.filter(F.col("n") >= min_freq))
    last = (
        counted.orderBy(F.desc("n"), "first_row")
        .limit(size)
        .agg(F.min(F.struct("n", (-F.col("first_row")).alias("row"))))
        .scalar()
    )
    near = counted.filter(F.struct("n", (-F.col("first_row")).alias("row")) >= last)
    tie = F.count(F.lit(1)).over(Window.partitionBy("n", "first_row"))
    tied = near.withColumn("_tie", tie).filter(F.col("_tie") > 1).select("token", "first_row")
    firsts = tied.select(F.col("first_row").alias(order)).distinct()
    # Only a vocabulary size within the broadcast limit bounds the two sides below without a count.
    bounded = size <= BROADCAST_ROWS
    wanted = lookup_join(corpus.select(order, words or "text"), firsts, [order], "left_semi", right_is_bounded=bounded)
    in_row = wanted if words else spread(wanted, order)
    placed = in_row.select(
        F.col(order).alias("first_row"),
        F.posexplode(F.array_distinct(_tokens(lang, words))).alias("first_pos", "token"),
    )
    places = lookup_join(placed, tied, ["token", "first_row"], "left_semi", right_is_bounded=bounded)
    rank = (F.desc("n"), F.asc("first_row"), F.asc("first_pos"))
    top = near.join(places, ["token", "first_row"], "left").orderBy(*rank).limit(size)
    numbered = top.select(
        "token", (F.row_number().over(Window.orderBy(*rank)) + UNK_ID).cast("int").alias("id")
    )
    if not specials:
        return numbered
    fixed = corpus.sparkSession.createDataFrame([(PAD_TOKEN, PAD_ID), (UNK_TOKEN, UNK_ID)], VOCABULARY)
    return fixed.unionByName(numbered)


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select("token", "id").coalesce(1).write.mode("overwrite").parquet(path)


def load_vocabulary(spark, path: str) -> DataFrame:
    return spark.read.schema(VOCABULARY).parquet(path)


def with_token_ids(
    rows: DataFrame, vocab: DataFrame, lang: str, max_len: int | None = None, text: str = "text",
    name: str = "ids", vocab_rows: int | None = None, key: str | None = None,
) -> DataFrame:
    """Add the ids of the first ``max_len`` tokens, unknown tokens as 1; no padding.

    ``vocab`` is counted, unless ``vocab_rows`` says how many rows it was cut to. Up to LOOKUP_ROWS the
    rows are encoded where they are, by a lookup. A larger vocabulary is joined token by token,
    which needs ``key``, a unique column of ``rows``; frequent tokens are kept out of that shuffle.
    """
    size = vocab_rows or size_up_to(vocab, LOOKUP_ROWS)
    n = max_len or MAX_LEN[lang]
    cut = char_tokens(text, n) if lang == "ko" else F.slice(tokens(text, lang), 1, n)

    def known(found: Column) -> Column:
        return F.coalesce(found, F.lit(UNK_ID)).cast("int")

    if size <= LOOKUP_ROWS:
        lookup = HashLookup(vocab, "token", "id", size)
        return (
            lookup.attach(rows.withColumn("_tokens", cut), "_vocab")
            .withColumn(name, F.transform("_tokens", lambda t: known(lookup.probe(t, "_vocab"))))
            .drop("_tokens", "_vocab")
        )
    if key is None:
        raise ValueError("a vocabulary of this size needs the name of a unique key column")
    each = rows.select(key, F.posexplode(cut).alias("_pos", "token"))
    found = lookup_join(each, vocab.select("token", F.col("id").alias("_id")), ["token"])
    # At most max_len entries per row come together here.
    ids = found.groupBy(key).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_pos", known(F.col("_id")).alias("i")))), lambda x: x["i"]
        ).alias(name)
    )
    return rows.join(ids, key, "left").withColumn(
        name, F.coalesce(name, F.array().cast("array<int>"))
    )


def pad(ids: Column | str, max_len: int) -> Column:
    """Fill with 0 on the right up to ``max_len``."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(c, F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - F.size(c)))


def encode(
    rows: DataFrame, vocab: DataFrame, lang: str, max_len: int | None = None, text: str = "text",
    name: str = "ids", vocab_rows: int | None = None, key: str | None = None,
) -> DataFrame:
    """Fixed-length id arrays: cut at ``max_len``, unknown 1, padded with 0."""
    n = max_len or MAX_LEN[lang]
    found = with_token_ids(rows, vocab, lang, n, text, name, vocab_rows, key)
    return found.withColumn(name, pad(name, n))
