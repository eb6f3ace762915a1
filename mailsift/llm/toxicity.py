"""Toxicity by compression: which of two zstandard dictionaries shortens a window of words more.

From a bounded sample of labelled documents two dictionaries are made: one of ordinary text (its most
common words) and one of toxic text (the same words, followed by the words and stems that set toxic
documents apart). A mark is a whole word or the first letters of one, in any language; it needs no share
of all toxic documents, but a likelihood ratio that chance does not reach, so marks spread over many rare
word forms count by their common stem. Every word of a text is compressed with both dictionaries, written
twice, so that known and unknown words both cost one reference and differ by their letters; the difference
of the two lengths is the word's margin, the largest of a window's words is the window's. Margins above
calibrated thresholds make a document's features, a logistic fit on the sample makes them a score.

All words of all texts are scored. Empty and null texts have no windows and get the score of a text
without any margin. If the sample has only one class or no row, every score is its share of toxic rows
(0 without rows). Rows without an id and repeated rows are scored each; labels without an id are left out, of
a repeated label the larger counts. Marks of equal evidence go by length, then by themselves. An empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.frames import keyed_texts, map_rows
from mailsift.llm.labelled import logistic, probability, sample
from mailsift.operators.scaling import cut_lineage

# Labelled documents per class the model is fitted on.
SAMPLE = 2500
# Words per window.
WINDOW = 4
# Letters of a stem.
STEM = range(3, 11)
# A mark stands in so many toxic documents and is so many times as frequent there as in ordinary ones; its
# likelihood ratio (twice its logarithm) is far beyond what the best of a million chance marks reaches.
MARK_DOCUMENTS, CONTRAST, EVIDENCE = 3, 8, 30
# Occurrences of a mark that count in one document.
OCCURRENCES = 4
TOXIC_WORDS, ORDINARY_WORDS = 200, 400
# Counts of marks a task holds before it hands them on, and margins of words a worker remembers.
HELD_COUNTS, HELD_MARGINS = 200_000, 50_000
# Margins (bytes) tried as thresholds; the logistic fit on the sample weighs them.
THRESHOLDS = (2, 3, 4, 5, 6, 8, 10)
REJECT_FROM = 0.7

LETTERS = re.compile(r"[^\W\d_]+")
GAP = "  "
# Ends a mark that is a whole word; no letter.
END = "$"


def windows(text: str) -> list[list[str]]:
    """Lower-case words, ``WINDOW`` at a time."""
    words = LETTERS.findall(text.lower())
    return [words[i : i + WINDOW] for i in range(0, len(words), WINDOW)]


def marks(word: str) -> list[str]:
    """The stems of a word, and the word with an end sign."""
    return [*(word[:n] for n in STEM if n <= len(word)), word + END]


def dictionary_text(words: list[str]) -> bytes:
    """Content of a dictionary; the words given first are nearest to the window."""
    return (GAP + GAP.join(w + GAP + w for w in reversed(words)) + GAP).encode()


def stem_text(stems: list[str]) -> bytes:
    """Content of a dictionary that matches beginnings of words only."""
    return "".join("\n" + GAP + s for s in reversed(stems)).encode() + b"\n"


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=5, target_length=4,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    return zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary)


@dataclass
class ToxicityModel:
    """Two dictionaries, the thresholds of margins and the logistic weights."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None = None
    base: float = 0.0

    def __getstate__(self) -> dict:
        # Compressors are made anew in each worker.
        return {k: v for k, v in self.__dict__.items() if k not in ("compressors", "word_margin")}

    @cached_property
    def compressors(self) -> tuple:
        return compressor(self.ordinary).compress, compressor(self.toxic).compress

    @cached_property
    def word_margin(self):
        ordinary, toxic = self.compressors

        @lru_cache(HELD_MARGINS)
        def margin(word: str) -> int:
            data = dictionary_text([word])
            return len(ordinary(data)) - len(toxic(data))

        return margin

    def margins(self, text: str) -> list[int]:
        margin = self.word_margin
        return [max(map(margin, w)) for w in windows(text)]

    def features(self, text: str) -> list[float]:
        """Logarithms of the number and of the share of windows from each threshold on; the largest margin."""
        margins = np.array(self.margins(text) or [0])
        above = [(margins >= t).sum() for t in THRESHOLDS]
        return [
            *(float(np.log1p(n)) for n in above),
            *(float(np.log1p(100 * n / len(margins))) for n in above),
            float(np.clip(margins.max(), 0, 20)) / 4,
        ]

    def score(self, text: str) -> float:
        return self.base if self.weights is None else probability(self.weights, self.features(text))


def _counts(texts: DataFrame) -> DataFrame:
    """Of each mark: occurrences in toxic (t) and ordinary (o) texts, and documents of both (dt, do)."""

    def rows(slices):
        held: dict[str, list[int]] = {}
        for part in slices:
            for text, y in zip(part["text"], part["y"], strict=True):
                found = Counter()
                for word, n in Counter(LETTERS.findall(text.lower())).items():
                    for mark in marks(word):
                        found[mark] += n
                for mark, n in found.items():
                    of = held.setdefault(mark, [0, 0, 0, 0])
                    of[1 - y] += min(n, OCCURRENCES)
                    of[3 - y] += 1
                if len(held) > HELD_COUNTS:
                    yield [(m, *of) for m, of in held.items()]
                    held = {}
        yield [(m, *of) for m, of in held.items()]

    counts = map_rows(texts.select("text", "y"), rows, "mark string, t long, o long, dt long, do long")
    return counts.groupBy("mark").agg(*(F.sum(c).alias(c) for c in ("t", "o", "dt", "do")))


def _toxic_marks(counts: DataFrame, toxic: int, ordinary: int) -> list[str]:
    """The strongest marks of toxic text; of marks that begin alike the one with the most evidence."""
    if not toxic or not ordinary:
        return []
    t, o, p = F.col("t"), F.col("o"), toxic / (toxic + ordinary)
    rest = F.when(o > 0, o * F.log(o / ((t + o) * (1 - p)))).otherwise(0.0)
    found = counts.filter((F.col("dt") >= MARK_DOCUMENTS) & (t / toxic > CONTRAST * (o + 0.5) / ordinary))
    found = found.withColumn("g", F.round(2 * (t * F.log(t / ((t + o) * p)) + rest), 6)).filter(F.col("g") >= EVIDENCE)
    taken: list[str] = []
    stems, begun = set(), set()
    order = [F.desc("g"), F.desc(F.length("mark")), "mark"]
    for r in found.orderBy(*order).limit(50 * TOXIC_WORDS).collect():
        word = r["mark"].removesuffix(END)
        begins = {word[:n] for n in range(1, len(word) + 1)}
        if not begins & stems and word not in begun:
            taken.append(r["mark"])
            stems.add(word)
            begun |= begins
    return taken[:TOXIC_WORDS]


def _dictionaries(taken: DataFrame) -> tuple[bytes, bytes]:
    """Both dictionaries, from the documents (different texts) of the sample."""
    texts = cut_lineage(taken.dropDuplicates(["text", "y"]))
    n = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    counts = cut_lineage(_counts(texts))
    found = _toxic_marks(counts, n.get(1, 0), n.get(0, 0))
    whole = [m.removesuffix(END) for m in found if m.endswith(END)]
    stems = [m for m in found if not m.endswith(END)]
    word = F.substring_index("mark", END, 1)
    common = counts.filter(F.col("mark").endswith(END) & (F.col("do") > 0) & (F.length("mark") > 4)).withColumn("word", word)
    # Words with a picked stem are left out; there are few among the common ones.
    first = F.substring("word", 1, STEM[-1])
    begins = F.transform(F.sequence(F.lit(1), F.length(first)), lambda i: F.substring(first, F.lit(1), i))
    picked = F.col("word").isin(whole) | F.arrays_overlap(begins, F.array(*map(F.lit, stems)).cast("array<string>"))
    ordinary = [r["word"] for r in common.filter(~picked).orderBy(F.desc("do"), "word").limit(ORDINARY_WORDS).collect()]
    return dictionary_text(ordinary), dictionary_text(ordinary) + dictionary_text(whole) + stem_text(stems)


def fit(documents: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = SAMPLE) -> ToxicityModel:
    """A model from ``labels`` (doc_id, toxic) of the rows where ``learn`` holds."""
    learn = F.lit(True) if learn is None else learn
    taken, weight = sample(documents, labels, "toxic", learn, per_class)
    model = ToxicityModel(*_dictionaries(taken))

    def rows(slices):
        for part in slices:
            yield [(y, model.features(t)) for t, y in zip(part["text"], part["y"], strict=True)]

    found = map_rows(taken.select("text", "y"), rows, "y int, x array<double>").collect()
    if len({r["y"] for r in found}) < 2:
        model.base = float(sum(r["y"] for r in found)) / max(len(found), 1)
        return model
    y = np.array([r["y"] for r in found])
    x = np.array([r["x"] for r in found])
    model.weights = logistic(x, y, np.array([weight[k] for k in y.tolist()]) / max(weight.values()))
    return model


def score_texts(documents: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def rows(slices):
        for part in slices:
            yield [(d, model.score(t)) for d, t in zip(part["doc_id"], part["text"], strict=True)]

    return map_rows(keyed_texts(documents, key, text), rows, "doc_id long, score double")


def filter_documents(documents: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Rows whose score is below ``REJECT_FROM``, with all their columns."""
    schema = documents.schema
    at = documents.columns.index(text)

    def run(batches):
        for batch in batches:
            scores = [model.score(t or "") for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(s < REJECT_FROM for s in scores))

    return documents.mapInArrow(run, schema)
