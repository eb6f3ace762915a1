"""Building blocks that keep the jobs even at any size and under hot keys.

The rules behind them: a side is broadcast only after its size was checked, one key may hold
a third of all rows, no group is ever gathered whole in one task, and a wide text column is
moved only where the result needs it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mailsift.session import shared_dir

# Rows of short columns (ids, patterns, tokens) allowed on a broadcast side.
BROADCAST_ROWS = 200_000
# Bytes of values allowed on a broadcast side, whatever its rows.
BROADCAST_BYTES = 64 << 20
# Bytes below which a table may yield fewer splits than there are cores.
SPREAD_BYTES = 256 << 20
# Keys looked at when a big join is split into its hot and its even part.
HOT_KEYS = 1_000


def size_up_to(df: DataFrame, limit: int = BROADCAST_ROWS) -> int:
    """Row count, or ``limit`` + 1 when there are more.

    Every task counts its own rows and sends one number. A limit would send up to ``limit`` rows
    of every partition to one task.
    """
    return min(df.count(), limit + 1)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes the values of a row take."""
    fixed, size = 8 * len(df.columns), F.lit(0)
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
    if nested:
        size = size + F.octet_length(F.to_json(F.struct(*nested)))
    return size + fixed


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``limit`` rows and ``max_bytes`` of values; every task sends two numbers."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return rows <= limit and (size or 0) <= max_bytes


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Give heavy per-row work all cores when the rows are so few bytes that they come in few splits.

    Inputs of SPREAD_BYTES or more, by the plan's own estimate, pass through unshuffled: their splits
    are many. Nothing is run or listed to find out, and what is shuffled is small.
    """
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if key else df.repartition(cores)


def computed(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns that are worked out once per row.

    A later filter on an ordinary column is pushed down as a second copy of its expression. For
    costly ones (regular expressions over whole texts, JSON) that doubles the work; a one-row
    generator is not pushed through.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*keep, made)


def cut_lineage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: later jobs neither recompute nor lose it.

    A parquet table rather than a checkpoint of rows, so that counting passes read only the
    columns they need; with ``by``, a column of few values, filters on it read only their folders.
    """
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def first_by(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key.

    Spark keeps only ``n`` rows per key and task before the shuffle (WindowGroupLimit), so a key
    with very many rows arrives small.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
    right_is_bounded: bool = False,
) -> DataFrame:
    """Join ``left`` to a ``right`` that has one row per key; ``how`` is left, inner, left_semi or left_anti.

    A small right side is broadcast. A large one is shuffled, after the rows of the most frequent
    left keys are joined by a broadcast of just their partners: any key with more than
    1/HOT_KEYS of the rows is among them, so no shuffle partition holds a hot key.
    """
    keys = list(keys)
    if right_is_bounded or is_small(right, limit):
        return left.join(F.broadcast(right), keys, how)
    hot = (
        left.dropna(subset=keys)
        .groupBy(*keys)
        .count()
        .orderBy(F.desc("count"), *keys)
        .limit(HOT_KEYS)
        .select(*keys)
    )
    tagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    # Rows with a null key match nothing; they stay out of the shuffle too.
    apart = F.col("_hot").isNotNull()
    for key in keys:
        apart = apart | F.col(key).isNull()
    hot_right = right.join(F.broadcast(hot), keys, "left_semi")
    hot_part = tagged.filter(apart).drop("_hot").join(F.broadcast(hot_right), keys, how)
    cold_part = tagged.filter(~apart).drop("_hot").join(right, keys, how)
    return hot_part.unionByName(cold_part)


class HashLookup:
    """A bounded key/value table that expressions can probe, also inside array functions.

    The table is hashed into an array of small maps and read as a scalar subquery. A probe is one
    hash and one short map scan, so a column of token arrays is looked up in a narrow projection:
    no explode, no join, no regrouping.
    """

    def __init__(self, table: DataFrame, key: str, value: str, max_rows: int):
        spark = table.sparkSession
        self.buckets = 1 << max(4, min(16, (max_rows // 4).bit_length()))
        entries = table.select(
            self._bucket(F.col(key)).alias("b"), F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("e")
        )
        every = spark.range(0, self.buckets, 1, 1).select(F.col("id").cast("int").alias("b"))
        maps = (
            entries.unionByName(every, allowMissingColumns=True)
            .groupBy("b")
            .agg(F.map_from_entries(F.collect_list("e")).alias("m"))
        )
        ordered = F.array_sort(F.collect_list(F.struct("b", "m")), lambda x, y: x["b"] - y["b"])
        self._table = maps.agg(F.transform(ordered, lambda x: x["m"]).alias("t"))

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def attach(self, df: DataFrame, name: str = "_lookup") -> DataFrame:
        """Add the table as a column for ``probe``; drop it after use."""
        return df.withColumn(name, self._table.scalar())

    def probe(self, key: Column, name: str = "_lookup") -> Column:
        """Value for ``key``, null when absent."""
        return F.element_at(F.get(F.col(name), self._bucket(key)), key)


def seeded_hash(seed: int, *parts: Column | str) -> Column:
    """Hex order key that any engine with md5 reproduces: md5 of 'seed|part|part'."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_number(hashed: Column, n: Column | int) -> Column:
    """A number in [0, n) from the first eight digits of a hex hash."""
    return F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint"), F.lit(n) if isinstance(n, int) else n)


def mark_smallest(
    df: DataFrame,
    strata: Sequence[str],
    order_hash: Column,
    quota: Callable[[DataFrame], DataFrame],
    name: str = "selected",
) -> DataFrame:
    """Mark, per stratum, exactly the ``quota`` rows with the smallest hash.

    ``order_hash`` is a ``seeded_hash`` of a unique row key. ``quota`` maps the stratum sizes
    (strata columns and ``n``) to the same rows with an added bigint ``quota``.

    A ranking window would pull a whole stratum, perhaps a third of all rows, into one task.
    Here the rows are counted by the first four hash digits, the digit group holding the cut is
    read off those counts, and only that group (one 65,536th of a stratum) is ranked. The rows
    themselves are then marked by comparing with the cut: no shuffle of the full rows. The two
    counting passes read only the strata and key columns.
    """
    strata = list(strata)
    keyed = df.select(*strata, order_hash.alias("_h")).withColumn("_b", F.substring("_h", 1, 4))
    hist = keyed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    sizes = hist.groupBy(*strata).agg(F.sum("_c").alias("n"))
    few = is_small(df.select(*strata).distinct(), BROADCAST_ROWS)
    quotas = quota(sizes).select(*strata, F.least("n", "quota").alias("_q"))
    run = Window.partitionBy(*strata).orderBy("_b")
    cut = (
        hist.withColumn("_cum", F.sum("_c").over(run))
        .join(F.broadcast(quotas) if few else quotas, strata)
        .filter((F.col("_cum") >= F.col("_q")) & (F.col("_cum") - F.col("_c") < F.col("_q")))
        .select(*strata, "_b", (F.col("_q") - F.col("_cum") + F.col("_c")).alias("_need"))
    )
    rank = Window.partitionBy(*strata).orderBy("_h")
    edge = (
        lookup_join(keyed, cut, [*strata, "_b"], "inner", right_is_bounded=few)
        .withColumn("_rn", F.row_number().over(rank))
        .filter(F.col("_rn") == F.col("_need"))
        .select(*strata, F.col("_h").alias("_edge"))
    )
    marked = lookup_join(df, edge, strata, "left", right_is_bounded=few)
    return marked.withColumn(
        name, F.coalesce(order_hash <= F.col("_edge"), F.lit(False))
    ).drop("_edge")
