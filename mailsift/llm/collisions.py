"""Nearest neighbours by counting collisions in windows on single random lines.

Every vector is projected on some dozens of random lines, and each line keeps its values sorted. A query
opens a window around its own value on every line and widens them all in steps (virtual rehashing: the
widths grow, the index stays). A vector within radius R lies in a line's window of half width R with a
known probability, so the number of windows it lies in is binomial; the threshold is the quantile that
such a vector misses with probability ``miss`` at most. Vectors that reach it are verified by their exact
distance, in double precision. A query ends when k verified vectors lie within its radius, or when
its windows hold all rows; nothing is capped.

The rows are dealt evenly to blocks that are indexed each by themselves; every query visits every block
in the stream of its task, and the block's best are merged. A query that ends in a block by its own k-th
distance there looks no less far than one that knew the best of all blocks.

Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows without
an id. Vectors of different lengths are never compared. A repeated id: rows are candidates of their
own, each query row is searched for by itself, and no row with a query's id is its neighbour. Ties go
to the smaller id. Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from mailsift.llm.frames import struct_of
from mailsift.operators.scaling import cut_lineage, lookup_join

LINES = 64
# Chance that a true neighbour within the radius is not verified.
MISS = 0.02
SEED = 20_011
GROWTH = 1.3
# Rows of a block: no fewer than these, for that many blocks, and no more numbers than these.
LEAST_ROWS, BLOCKS, MOST_NUMBERS = 4_096, 64, 1 << 23
# Rows of a block whose distances tell how wide the first windows are; the result doesn't depend on them.
PROBE = 128


def threshold(lines: int, miss: float) -> int:
    """Windows that a vector at distance R lies in, with half widths R, but for a chance of ``miss``."""
    p = erf(1 / sqrt(2))
    total, count = 0.0, 0
    while count < lines:
        total += comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if total > miss:
            break
        count += 1
    return max(count, 1)


class Index:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int, least: int):
        self.ids, self.vectors, self.least = ids, vectors, least
        rng = np.random.default_rng(SEED)
        self.lines = rng.standard_normal((vectors.shape[1], lines))
        values = (vectors @ self.lines).T
        self.order = np.ascontiguousarray(np.argsort(values, axis=1, kind="stable")).astype(np.int32)
        self.values = np.take_along_axis(values, self.order, axis=1)
        # So much may rounding move a projection.
        self.slack = 1e-9 * (1 + float(np.abs(self.values).max()))
        self.starts = np.arange(lines)[:, None] * len(ids)

    def _radii(self, query: np.ndarray, spread: float) -> np.ndarray:
        """Radii of the windows, from about half the distance of a near row to one that takes in all."""
        near = self.distances(query, np.arange(min(PROBE, len(self.ids))))
        some = near[near > 0]
        first = float(some.min()) / 2 if len(some) else max(spread, self.slack)
        steps = max(0, int(np.ceil(np.log(max(spread / first, 1)) / np.log(GROWTH)))) + 1
        # Equal vectors are met with windows of no width.
        return np.concatenate([[0.0], first * GROWTH ** np.arange(steps), [spread * GROWTH]])

    def distances(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.square(self.vectors[rows] - query).sum(axis=1))

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, nearest first."""
        at = query @ self.lines
        size = len(self.ids)
        spread = float(max(np.abs(self.values[:, 0] - at).max(), np.abs(self.values[:, -1] - at).max())) + self.slack
        radii = self._radii(query, spread)
        half = radii + self.slack
        low = np.stack([np.searchsorted(v, a - half, "left") for v, a in zip(self.values, at, strict=True)])
        high = np.stack([np.searchsorted(v, a + half, "right") for v, a in zip(self.values, at, strict=True)])
        flat = self.order.reshape(-1)
        counts = np.zeros(size, dtype=np.int64)
        open_ = self.ids != query_id
        rows, far = np.zeros(0, dtype=np.int64), np.zeros(0)
        a = b = None
        for j, radius in enumerate(radii):
            # The entries the windows take in anew, at their lower and their upper ends.
            x, y = low[:, j], high[:, j]
            begins, ends = (x, y) if j == 0 else (np.concatenate([x, b]), np.concatenate([a, y]))
            offset = self.starts[:, 0] if j == 0 else np.tile(self.starts[:, 0], 2)
            a, b = x, y
            counts += np.bincount(flat[_ranges(begins + offset, ends + offset)], minlength=size)
            new = np.flatnonzero(open_ & (counts >= self.least))
            if len(new):
                open_[new] = False
                rows, far = np.concatenate([rows, new]), np.concatenate([far, self.distances(query, new)])
            if len(rows) >= k and np.partition(far, k - 1)[k - 1] <= radius:
                break
        if len(rows) > k:
            keep = far <= np.partition(far, k - 1)[k - 1]
            rows, far = rows[keep], far[keep]
        best = np.lexsort((self.ids[rows], far))[:k]
        return self.ids[rows[best]], far[best]


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = ends - begins
    return np.repeat(ends - sizes.cumsum(), sizes) + np.arange(sizes.sum())


def _vectors(df: DataFrame, is_query: Column, key: str, vector: str) -> DataFrame:
    """place (a number of the row), id, query, v and dim of the rows that take part."""
    chosen = df.select(
        F.monotonically_increasing_id().alias("place"),
        F.col(key).cast("long").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
        F.col(vector).cast("array<double>").alias("v"),
    )
    # Null components make the first test null or false, so the row goes.
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = chosen.filter(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return kept.withColumn("dim", F.size("v"))


def _searched(k: int, lines: int, miss: float):
    least = threshold(lines, miss)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, ids, vectors = None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)) for c in ("dim", "block", "kind")], axis=1)
            every, place = np.asarray(batch.column("id")), np.asarray(batch.column("place"))
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                dim, kind = int(keys[a, 0]), keys[a, 2]
                v = np.asarray(batch.column("v").slice(a, b - a).flatten()).reshape(b - a, dim)
                if tuple(keys[a, :2]) != now:
                    now, index, ids, vectors = tuple(keys[a, :2]), None, [], []
                if kind == 0:
                    ids.append(every[a:b])
                    vectors.append(v)
                    continue
                if index is None and ids:
                    index = Index(np.concatenate(ids), np.concatenate(vectors), lines, least)
                    vectors = []
                if index is None:
                    continue
                out = [(q, p, *index.search(q, x, k)) for q, p, x in zip(every[a:b], place[a:b], v, strict=True)]
                sizes = [len(o[2]) for o in out]
                yield (
                    np.repeat([o[0] for o in out], sizes),
                    np.repeat([o[1] for o in out], sizes),
                    np.concatenate([o[2] for o in out]),
                    np.concatenate([o[3] for o in out]),
                )

    schema = struct_of("query_id long, place long, vec_id long, score double")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for columns in work(batches):
            made = [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return run, schema


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    lines: int = LINES,
    miss: float = MISS,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest found of each row where ``is_query`` holds."""
    rows = cut_lineage(_vectors(df, is_query, key, vector))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    most = F.greatest(F.lit(1), F.floor(F.lit(MOST_NUMBERS) / F.col("dim")))
    room = F.least(most, F.greatest(F.lit(least_rows), F.floor(F.col("n") / BLOCKS)))
    blocks = sizes.select("dim", F.ceil(F.col("n") / room).cast("int").alias("blocks"))
    sized = lookup_join(rows, blocks, ["dim"], "inner")
    block = F.pmod("place", "blocks").cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    data = sized.select("dim", block.alias("block"), F.lit(0).alias("kind"), "place", "id", "v")
    asked = sized.filter("query").select("dim", each.alias("block"), F.lit(1).alias("kind"), "place", "id", "v")
    dealt = data.unionByName(asked).repartition("dim", "block").sortWithinPartitions("dim", "block", "kind")
    run, schema = _searched(k, lines, miss)
    met = dealt.mapInArrow(run, schema)
    order = Window.partitionBy("query_id", "place").orderBy("score", "vec_id")
    return (
        met.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
