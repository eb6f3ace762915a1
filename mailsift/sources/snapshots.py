"""The state of an append-only log from a snapshot and the files appended since.

A snapshot holds the state as of a watermark, the greatest order id seen, and the names of the files it
covers. Reading takes the newest complete snapshot and the files that are not among those, so its cost
follows what was appended since. The log itself stays: it is the history, and what late rows are settled
with.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.operators import allowlist
from mailsift.operators.scaling import cut_lineage, first_by, lookup_join
from mailsift.sources.tables import Store


@dataclass(frozen=True)
class LogState:
    """How a log folds into a state.

    ``merge`` takes a state and later rows. Where the order of rows decides (``ordered``), rows that
    come late, with an id up to the watermark, are not merged: their keys are folded anew from the log.
    """

    name: str
    key: str
    order: str
    fold: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame, DataFrame], DataFrame]
    # The key as the state has it, of a log row.
    key_of: Callable[[], Column]
    ordered: bool = True


def _merge_trust(state: DataFrame, tail: DataFrame) -> DataFrame:
    ended = tail.filter(F.col("op") == "remove").select(allowlist.clean_pattern("pattern").alias("pattern")).distinct()
    kept = lookup_join(state, ended, ["pattern"], "left_anti").withColumn("_part", F.lit(0))
    both = kept.unionByName(allowlist.current_list(tail).withColumn("_part", F.lit(1)))
    # The first insert's id and time stay; the last note holds.
    return both.groupBy("pattern").agg(
        F.min_by("id", "_part").alias("id"),
        F.max_by("note", "_part").alias("note"),
        F.min_by("created_at", "_part").alias("created_at"),
    )


def _fold_actions(log: DataFrame) -> DataFrame:
    return log.filter(F.col("gmail_id").isNotNull()).groupBy("gmail_id").agg(F.min("acted_at").alias("acted_at"))


def _fold_deployed(log: DataFrame) -> DataFrame:
    return first_by(log.filter(F.col("kind") == "deploy"), ["lang"], [F.desc("backup_id")])


TRUST = LogState(
    "trust_log", "pattern", "id", allowlist.current_list, _merge_trust, lambda: allowlist.clean_pattern("pattern")
)
# The first action and the last deployment are the same in whatever order the rows come.
ACTIONS = LogState(
    "action_log", "gmail_id", "acted_at", _fold_actions,
    lambda state, tail: _fold_actions(state.unionByName(tail.select(*state.columns))), lambda: F.col("gmail_id"), False,
)
DEPLOYED = LogState(
    "registry", "lang", "backup_id", _fold_deployed,
    lambda state, tail: _fold_deployed(state.unionByName(tail.select(*state.columns))), lambda: F.col("lang"), False,
)

FILES = T.StructType([T.StructField("file", T.StringType())])


class Snapshots:
    """Snapshots of one log of a store, numbered; one process may write them at a time."""

    def __init__(self, store: Store, log: LogState):
        self.store, self.log, self.spark = store, log, store.spark
        self.path = f"{store.path(log.name)}_snapshots"

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def newest(self) -> int | None:
        """The number of the newest complete snapshot: what it covers is written last."""
        listed = self._read(f"{self.path}/covers")
        return None if listed is None else listed.agg(F.max("number")).first()[0]

    def _log(self) -> DataFrame:
        return self.store.read(self.log.name)

    def tail(self) -> DataFrame:
        """Rows of the files that the newest snapshot doesn't cover; no other file is read."""
        number, table = self.newest(), self._log()
        if number is None:
            return table
        covered = self.spark.read.parquet(f"{self.path}/covers/number={number}")
        files = self.spark.createDataFrame([(f,) for f in table.inputFiles()], FILES)
        new = [r["file"] for r in files.join(covered, "file", "left_anti").collect()]
        if not new:
            return table.limit(0)
        return self.spark.read.schema(Store.TABLES[self.log.name]).parquet(*new)

    def _base(self) -> tuple[DataFrame | None, object]:
        """(state of the newest snapshot, its watermark)."""
        number = self.newest()
        if number is None:
            return None, None
        mark = self.spark.read.parquet(f"{self.path}/marks/number={number}").first()
        return self.spark.read.parquet(f"{self.path}/states/number={number}"), mark["watermark"]

    def _late(self, tail: DataFrame, watermark: object) -> DataFrame:
        if watermark is None:
            return tail.limit(0)
        return tail.filter(F.col(self.log.order) <= F.lit(str(watermark)).cast(tail.schema[self.log.order].dataType))

    def late(self) -> DataFrame:
        """key and n: rows that were appended after a snapshot but belong before its watermark."""
        late = self._late(self.tail(), self._base()[1])
        return late.groupBy(self.log.key_of().alias(self.log.key)).agg(F.count(F.lit(1)).alias("n"))

    def state(self) -> DataFrame:
        """The state as the whole log has it."""
        base, watermark = self._base()
        tail = self.tail()
        if base is None:
            return self.log.fold(tail)
        if not self.log.ordered:
            return self.log.merge(base, tail)
        key = self.log.key
        late = cut_lineage(self._late(tail, watermark).select(self.log.key_of().alias(key)).distinct())
        if late.limit(1).count() == 0:
            return self.log.merge(base, tail)
        keyed = tail.withColumn("_key", self.log.key_of())
        asked = late.withColumnRenamed(key, "_key")
        in_time = lookup_join(keyed, asked, ["_key"], "left_anti").drop("_key")
        anew = lookup_join(self._log().withColumn("_key", self.log.key_of()), asked, ["_key"], "left_semi").drop("_key")
        merged = self.log.merge(lookup_join(base, late, [key], "left_anti"), in_time)
        return merged.unionByName(self.log.fold(anew).select(*merged.columns))

    def take(self) -> int:
        """Write a new snapshot of all that the log holds now; returns its number."""
        number = (self.newest() or 0) + 1
        _, watermark = self._base()
        # The files are listed first: one that is appended meanwhile is in the next tail.
        files = self._log().inputFiles()
        tail = self.tail()
        top = tail.agg(F.max(self.log.order).alias("watermark"))
        if watermark is not None:
            kind = tail.schema[self.log.order].dataType
            top = top.select(F.greatest("watermark", F.lit(str(watermark)).cast(kind)).alias("watermark"))
        self.state().write.mode("overwrite").parquet(f"{self.path}/states/number={number}")
        top.write.mode("overwrite").parquet(f"{self.path}/marks/number={number}")
        # Last, as it makes the snapshot count. A file that is missing here is a late one, and settled as such.
        covers = self.spark.createDataFrame([(f,) for f in files], FILES)
        covers.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/covers/number={number}")
        return number
