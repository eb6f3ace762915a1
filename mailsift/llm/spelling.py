"""Words of a corpus grouped with their spelling variants: one inserted, deleted or replaced letter apart.

A word is a point whose coordinates are how often it holds each letter. One edit moves it by an L1
distance of at most two: by one for an inserted or deleted letter, by two for a replaced one. So the near
words of a word lie in a small box, which k-d trees find: for each length one, split where the letters
differ most. The top of the trees, fitted on a bounded sample of words, deals all words into cells; a
word goes to its own cell and, as a query, to each cell of its length and of the lengths one above and
below that its ball reaches. Within a cell a k-d tree with tight boxes is built over the cell's words, the
queries of the cell are pruned box by box, and in the leaves the counts are compared and then the letters
in their order, so every result is exact whatever the sample.

Cells hold some thousand words. One that holds more (words with the same letters cannot be parted) is
cut into pieces by hash that its queries all visit, one with very many queries is copied for slices of
them; a task keeps one piece and streams the queries past it. Nothing is emitted for a pair: a query gets
from a piece the number of near words and the best of them.

Roots follow the forms, by pointer doubling over written tables: counts double with every step, so a few
rounds suffice, and no ring can arise.

Null texts have no words. A null id stands as an empty string in the checksum. Rows repeating an id or a
text count each. Ties: see ``grouped``. Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from mailsift.llm.frames import struct_of
from mailsift.operators.scaling import cut_lineage, lookup_join

# Words the trees' tops are fitted on, about; every word is indexed whatever they are.
SAMPLE = 100_000
# Words in a cell, and queries in a slice of one, about.
CELL = 4_096
QUERIES = 100_000
# Letters of a cell's words, about: long words come in smaller cells.
CELL_LETTERS = 1 << 21
LEAF = 256
# Sample words below which a node of a tree's top is split no further.
LEAST_SAMPLE = 8
# Lengths that get a tree; others have one cell, cut into pieces by hash.
LENGTHS = 1_000
CELL_BITS = 20
# Numbers of a comparison held at a time.
CHUNK = 1 << 21

RUNS = "[a-zÀ-ÿ]"


def counted_words(docs: DataFrame, modulus: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word and n: the runs of Latin letters in all texts, A-Z in lower case, one in ``modulus`` misspelt.

    A run loses a letter if the checksum of its document's id and itself is divisible by ``modulus``.
    """
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    # Runs below the least length have no word, so the pattern skips them; those it takes are whole.
    runs = F.regexp_extract_all(low, F.lit(f"{RUNS}{{{least_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    cut = (h % F.char_length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), cut), F.substring(F.col("run"), cut + 2, F.char_length("run")))
    word = F.when(h % modulus == 0, less).otherwise(F.col("run"))
    counts = found.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def letters(words: list[str], length: int) -> np.ndarray:
    """Code points, one row a word of that length."""
    flat = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(flat, dtype="<u4").reshape(len(words), length)


@dataclass(frozen=True)
class Split:
    """A node of a tree's top: words with at most ``most`` of a letter go left."""

    letter: int
    most: int
    left: Split | int
    right: Split | int


def grow(codes: np.ndarray, words: float, cell: int) -> Split | int:
    """The top of a tree for about ``words`` words of one length, from a sample of them.

    Leaves are numbered from left to right.
    """
    alphabet = np.unique(codes)
    counts = np.stack([(codes == a).sum(axis=1) for a in alphabet], axis=1) if len(codes) else codes
    numbers = iter(range(1 << CELL_BITS))

    def node(of: np.ndarray) -> Split | int:
        share = words * len(of) / max(len(codes), 1)
        if share > cell and len(of) >= 2 * LEAST_SAMPLE:
            own = counts[of]
            at = int(own.var(axis=0).argmax())
            column = own[:, at]
            most = int(np.median(column))
            if most == column.max():
                most -= 1
            if most >= column.min():
                low = column <= most
                return Split(int(alphabet[at]), most, node(of[low]), node(of[~low]))
        return next(numbers)

    return node(np.arange(len(codes)))


def reached(tree: Split | int, codes: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows of ``codes`` whose ball reaches it, their L1 distance from it)."""
    known: dict[int, np.ndarray] = {}
    rows = np.arange(len(codes))
    waiting = [(tree, rows, np.zeros(len(codes), dtype=np.int64), {})]
    while waiting:
        node, of, far, bounds = waiting.pop()
        if isinstance(node, int):
            yield node, of, far
            continue
        if node.letter not in known:
            known[node.letter] = (codes == node.letter).sum(axis=1)
        x = known[node.letter][of]
        low, high = bounds.get(node.letter, (0, 1 << 40))
        rest = far - np.maximum(low - x, 0) - np.maximum(x - high, 0)
        for child, a, b in ((node.left, low, min(high, node.most)), (node.right, max(low, node.most + 1), high)):
            away = rest + np.maximum(a - x, 0) + np.maximum(x - b, 0)
            near = away <= radius
            if near.any():
                waiting.append((child, of[near], away[near], bounds | {node.letter: (a, b)}))


def _limit(length: int, cell: int) -> int:
    return max(1, min(cell, CELL_LETTERS // length))


def _parts(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """(length, places) of the words by length, a bounded number of letters at a time."""
    by_length = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w)].append(i)
    for length, at in by_length.items():
        step = max(1, CHUNK // length)
        for i in range(0, len(at), step):
            yield length, at[i : i + step]


def _map_batches(df: DataFrame, work, ddl: str) -> DataFrame:
    """``work`` takes an iterator of record batches and yields tuples of columns."""
    schema = struct_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            made = [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return df.mapInArrow(run, schema)


def _routed(words: DataFrame, trees: dict[int, Split | int], least_length: int) -> DataFrame:
    """cell, kind, word, n: a word as one of its cell (kind 0), and as a query for each cell in reach.

    Kinds 1, 2 and 3 are queries one letter shorter than the cell's words, as long, and one longer.
    """

    def work(batches):
        for batch in batches:
            every = batch.column(0).to_pylist()
            n = np.asarray(batch.column(1))
            for length, places in _parts(every):
                codes = letters([every[i] for i in places], length)
                at = np.asarray(places)
                for target in range(max(length - 1, least_length), length + 2):
                    for leaf, of, far in reached(trees.get(target, 0), codes, 2 if target == length else 1):
                        cell = target << CELL_BITS | leaf
                        # Leaves part all of space, so a word lies in exactly one.
                        own = of[far == 0] if target == length else of[:0]
                        take = at[np.concatenate([own, of])]
                        kinds = np.concatenate([np.zeros(len(own), int), np.full(len(of), length - target + 2)])
                        yield np.full(len(take), cell), kinds, [every[i] for i in take], n[take]

    return _map_batches(words.select("word", "n"), work, "cell long, kind int, word string, n long")


class Cell:
    """A k-d tree with tight boxes over the letter counts of words of one length."""

    def __init__(self, words: list[str], n: np.ndarray):
        # In code-point order, so that of equal counts the first place is the smallest word.
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words = [words[i] for i in order]
        self.n = np.asarray(n)[order]
        self.length = len(words[0])
        self.codes = letters(self.words, self.length)
        self.alphabet = np.unique(self.codes)
        self.counts, _ = self._counted(self.codes)
        self.bits = self._parity(self.counts)
        self.root = self._node(np.arange(len(words)))

    def _counted(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the alphabet's letters, and of all others together."""
        rows, width = len(codes), len(self.alphabet)
        place = np.minimum(np.searchsorted(self.alphabet, codes), width - 1)
        known = self.alphabet[place] == codes
        flat = (np.arange(rows)[:, None] * width + place)[known]
        counts = np.bincount(flat, minlength=rows * width).reshape(rows, width)
        return counts.astype(np.int16 if codes.shape[1] < 1 << 14 else np.int32), (~known).sum(axis=1)

    @staticmethod
    def _parity(counts: np.ndarray) -> np.ndarray:
        """One bit a letter: odd or even. The bits that differ bound the distance from below."""
        odd = (counts & 1).astype(np.uint64)
        bits = np.zeros(len(counts), dtype=np.uint64)
        for i in range(counts.shape[1]):
            bits ^= odd[:, i] << np.uint64(i % 64)
        return bits

    def _node(self, of: np.ndarray):
        own = self.counts[of]
        low, high = own.min(axis=0), own.max(axis=0)
        spread = own.var(axis=0)
        at = int(spread.argmax())
        if len(of) <= LEAF or low[at] == high[at]:
            return low, high, of
        most = min(int(np.median(own[:, at])), int(high[at]) - 1)
        left = own[:, at] <= most
        return low, high, (self._node(of[left]), self._node(of[~left]))

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, place in the cell) one edit apart; ``words`` are of one length."""
        codes = letters(words, len(words[0]))
        counts, others = self._counted(codes)
        bits = self._parity(counts)
        radius = 2 if len(words[0]) == self.length else 1
        found = [(np.zeros(0, int), np.zeros(0, int))]
        waiting = [(self.root, np.flatnonzero(others <= radius))]
        while waiting:
            (low, high, rest), of = waiting.pop()
            own = counts[of]
            away = others[of] + (np.maximum(low - own, 0) + np.maximum(own - high, 0)).sum(axis=1)
            of = of[away <= radius]
            if not len(of):
                continue
            if isinstance(rest, tuple):
                waiting += [(child, of) for child in rest]
                continue
            step = max(1, CHUNK // len(rest))
            for i in range(0, len(of), step):
                part = of[i : i + step]
                q, d = np.nonzero(np.bitwise_count(bits[part][:, None] ^ self.bits[rest][None, :]) <= radius)
                found.append(self._verified(codes, counts, others, part[q], rest[d], radius))
        return np.concatenate([q for q, _ in found]), np.concatenate([d for _, d in found])

    def _verified(self, codes, counts, others, q, d, radius):
        """Of candidate pairs those within the distance whose letters, in order, differ by one edit."""
        kept = []
        step = max(1, CHUNK // max(len(self.alphabet), self.length))
        for i in range(0, len(q), step):
            a, b = q[i : i + step], d[i : i + step]
            close = others[a] + np.abs(counts[a] - self.counts[b]).sum(axis=1) <= radius
            a, b = a[close], b[close]
            same = one_edit(codes[a], self.codes[b])
            kept.append((a[same], b[same]))
        return (
            np.concatenate([x for x, _ in kept]) if kept else q,
            np.concatenate([x for _, x in kept]) if kept else d,
        )


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` differ by exactly one inserted, deleted or replaced letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    width = a.shape[1]
    if not len(a):
        return np.zeros(0, dtype=bool)
    front, back = a != b[:, :-1], a != b[:, 1:]
    first = np.where(front.any(axis=1), front.argmax(axis=1), width)
    last = np.where(back.any(axis=1), width - 1 - back[:, ::-1].argmax(axis=1), -1)
    return last < first


def _best(cell: Cell, words: list[str]):
    """Columns word, n_near, form_n, form for those of the words that have near ones in the cell."""
    q, d = cell.near(words)
    if not len(q):
        return None
    n = cell.n[d]
    order = np.lexsort((d, -n, q))
    q, d, n = q[order], d[order], n[order]
    heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    sizes = np.diff(np.r_[heads, len(q)])
    return [words[i] for i in q[heads]], sizes, n[heads], [cell.words[i] for i in d[heads]]


def _searched(batches: Iterator[pa.RecordBatch]):
    """Rows come sorted by piece and kind: first a piece's words, then its queries."""
    now, cell, own, numbers = None, None, [], []
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(c)) for c in ("cell", "piece", "slice", "kind")], axis=1)
        words, n = batch.column("word").to_pylist(), np.asarray(batch.column("n"))
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if len(keys) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece, kind = tuple(keys[a, :3]), keys[a, 3]
            if piece != now:
                now, cell, own, numbers = piece, None, [], []
            if kind == 0:
                own += words[a:b]
                numbers.append(n[a:b])
            elif own:
                cell = cell or Cell(own, np.concatenate(numbers))
                step = max(1, CHUNK // len(words[a]))
                for i in range(a, b, step):
                    if (found := _best(cell, words[i : min(i + step, b)])) is not None:
                        yield found


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL, queries: int = QUERIES) -> DataFrame:
    """word, n_near and form_n, form (the near word of largest n, ties to the smallest) of those with any.

    ``words`` has one row a word (word, n) and should be a written table: it is read several times.
    """
    sized = words.withColumn("_length", F.char_length("word"))
    lengths = sized.groupBy("_length").agg(F.count(F.lit(1)).alias("k"), F.min("_length").alias("m"))
    # Long words come in smaller cells, so their lengths need a tree sooner.
    room = F.greatest(F.lit(1), F.least(F.lit(cell), F.floor(F.lit(CELL_LETTERS) / F.col("m"))))
    large = lengths.filter((F.col("k") > room) & (F.col("m") <= 1_000)).orderBy(F.desc("k"), "m").limit(LENGTHS)
    sizes = {r.m: r.k for r in large.collect()}
    shortest = lengths.agg(F.min("m")).first()[0] or 1
    trees: dict[int, Split | int] = {}
    if sizes:
        # About ``sample`` words, by their hash; every task sends its own share of them and no more.
        part = min(1.0, sample / sum(sizes.values()))
        drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(part * (1 << 30))
        by_length = defaultdict(list)
        for r in sized.filter(F.col("_length").isin(list(sizes)) & drawn).select("word").collect():
            by_length[len(r.word)].append(r.word)
        trees = {k: grow(letters(w, k), sizes[k], _limit(k, cell)) for k, w in by_length.items()}

    routed = cut_lineage(_routed(words, trees, shortest))
    room = F.greatest(F.lit(1), F.least(F.lit(cell), F.floor(F.lit(CELL_LETTERS) / F.shiftright("cell", CELL_BITS))))
    crowds = (
        routed.groupBy("cell")
        .agg(F.count_if(F.col("kind") == 0).alias("d"), F.count_if(F.col("kind") > 0).alias("q"))
        .select("cell", F.ceil(F.col("d") / (2 * room)).alias("pieces"), F.ceil(F.col("q") / queries).alias("slices"))
        .filter("pieces > 1 OR slices > 1")
    )
    marked = lookup_join(routed, crowds, ["cell"], "left")
    pieces, slices = (F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).cast("int") for c in ("pieces", "slices"))
    mine = F.xxhash64("word")
    every = F.when(F.col("kind") == 0, F.transform(F.sequence(F.lit(0), slices - 1), lambda s: F.struct(
        F.pmod(mine, pieces).cast("int").alias("piece"), s.alias("slice")
    ))).otherwise(F.transform(F.sequence(F.lit(0), pieces - 1), lambda p: F.struct(
        p.alias("piece"), F.pmod(F.xxhash64("word", F.lit(1)), slices).cast("int").alias("slice")
    )))
    dealt = marked.select("cell", "kind", "word", "n", F.inline(every))
    keys = ("cell", "piece", "slice")
    sorted_ = dealt.select(*keys, "kind", "word", "n").repartition(*keys).sortWithinPartitions(*keys, "kind")
    found = _map_batches(sorted_, _searched, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of all words with a form, by pointer doubling."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = lookup_join(now, ahead, ["root"], "left")
        then = cut_lineage(
            moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        )
        if not then.filter("_moved").limit(1).count():
            return then.select("word", "root")
        now = then.select("word", "root")


def grouped(words: DataFrame, ratio: int = 2, **sizes: int) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word (word, n; one row a word).

    A word's form is its near word of largest n (of equal ones the smallest in code-point order) if that
    n is ``ratio`` times its own or more. Its root is reached by following forms; a word without form is
    its own root. ``ratio`` must be over 1, so that forms never lead back.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")))
    found = near_words(words, **sizes)
    joined = words.join(found, "word", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    whole = cut_lineage(
        joined.select(
            "word",
            F.when(fits, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, F.col("form_n")).alias("form_n"),
        )
    )
    roots = _roots(whole.filter("form IS NOT NULL"))
    return whole.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
