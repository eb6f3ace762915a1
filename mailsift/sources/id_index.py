"""Which mail ids are stored, without reading the store.

The index is a parquet table of ids in folders by the hash of the id. A question for some ids lists and
reads only the folders their hashes name, so its cost follows the number of ids asked for and the size of
one folder, not the store. Choose ``slots`` so that a folder holds some hundred thousand ids at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.operators.scaling import is_small

SLOTS = 256
# Batch folders of a slot from which ``compact`` merges them.
MERGE_FROM = 16
MERGED = "merged"


class IdIndex:
    """Ids by slot, run and batch.

    A batch's ids lie in folders of their own, so a replayed batch replaces them, and can be asked about
    without itself. Ids that stand in several folders count once. Several runs may write at a time;
    ``compact`` must not run beside another ``compact``.
    """

    SCHEMA = T.StructType(
        [
            T.StructField("gmail_id", T.StringType()),
            T.StructField("slot", T.IntegerType()),
            T.StructField("run", T.StringType()),
            T.StructField("batch", T.LongType()),
        ]
    )

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        # Another number of slots is another index.
        self.spark, self.path, self.slots = spark, f"{path.rstrip('/')}/slots={slots}", slots

    def slot(self, key: Column | str = "gmail_id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.slots)).cast("int")

    def slots_of(self, ids: DataFrame) -> list[int]:
        """Slots that hold the ids, at most as many as there are slots."""
        rows = ids.select(self.slot().alias("slot")).distinct().collect()
        return sorted(r["slot"] for r in rows)

    def read(self, slots: Sequence[int]) -> DataFrame:
        """The rows of these slots; no other folder is listed or read."""
        empty = self.spark.createDataFrame([], self.SCHEMA)
        if not slots:
            return empty
        wanted = f"{self.path}/slot={{{','.join(map(str, slots))}}}"
        try:
            found = self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(wanted)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty
        return found.select(*self.SCHEMA.names)

    def known(self, ids: DataFrame, run: str | None = None, batch: int | None = None) -> DataFrame:
        """The distinct ones of ``ids`` (gmail_id) that are stored, by another batch than the one given."""
        asked = ids.select("gmail_id").dropna().distinct()
        rows = self.read(self.slots_of(asked))
        if run is not None:
            rows = rows.filter(~((F.col("run") == run) & (F.col("batch") == batch)))
        rows = rows.select("gmail_id")
        # Few ids are sent to the folders; what is found is no more than was asked for.
        return rows.join(F.broadcast(asked) if is_small(asked) else asked, "gmail_id", "left_semi").distinct()

    def add(self, ids: DataFrame, run: str, batch: int) -> None:
        """Put in the ids of a batch, in place of what it put in before."""
        rows = ids.select("gmail_id").dropna().distinct().select("gmail_id", self.slot().alias("slot"))
        stamped = rows.withColumns({"run": F.lit(run), "batch": F.lit(batch).cast("long")})
        self._write(stamped)

    def _write(self, rows: DataFrame) -> None:
        # One task writes a slot's ids, so a batch leaves one file in each of its slots. Slots are as even
        # as the hash of distinct ids.
        rows.repartition("slot").sortWithinPartitions("slot", "gmail_id").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("slot", "run", "batch").parquet(self.path)

    def built(self) -> bool:
        """Whether ``rebuild`` has come to its end."""
        path, files = self._files(f"{self.path}/_built")
        return files.exists(path)

    def rebuild(self, messages: DataFrame, run: str | None = None) -> None:
        """Index a store that has none yet, or whose index was lost.

        Rows of ``run``, which may replay its last batch, keep their run and batch.
        """
        own = F.lit(False) if run is None else F.coalesce(F.col("run") == run, F.lit(False))
        number = F.when(own, F.col("batch")).otherwise(0) if run is not None else F.lit(0)
        rows = messages.filter(F.col("gmail_id").isNotNull()).select(
            "gmail_id", self.slot().alias("slot"), F.when(own, run).otherwise(MERGED).alias("run"), number.cast("long").alias("batch")
        )
        self._write(rows.distinct())
        path, files = self._files(f"{self.path}/_built")
        files.create(path, True).close()

    def compact(self, run: str, before: int, merge_from: int = MERGE_FROM) -> list[int]:
        """Merge folders of ``run``'s batches below ``before`` in slots with many; returns these slots.

        Batches that may still be replayed must not be among them: a stream replays none but its last.
        The merged ids are written before the old folders go; in between ids stand twice, which is harmless.
        """
        table = self._listed()
        old = (F.col("run") == run) & (F.col("batch") < before)
        many = (
            table.filter(old).select("slot", "batch").distinct().groupBy("slot").count().filter(F.col("count") >= merge_from)
        )
        slots = sorted(r["slot"] for r in many.select("slot").collect())
        if slots:
            mine = table.filter(F.col("slot").isin(slots))
            merged = mine.filter((F.col("run") == MERGED) | old).select("gmail_id", "slot").distinct()
            numbers = mine.filter(F.col("run") == MERGED).agg(F.max("batch")).first()[0]
            number = 0 if numbers is None else numbers + 1
            self._write(merged.withColumns({"run": F.lit(MERGED), "batch": F.lit(number).cast("long")}))
            gone = mine.filter(old | ((F.col("run") == MERGED) & (F.col("batch") < number)))
            self._drop([tuple(r) for r in gone.select("slot", "run", "batch").distinct().collect()])
        return slots

    def _listed(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path).select(*self.SCHEMA.names)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def _files(self, path: str):
        """The path and its file system, as Spark sees them."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _drop(self, folders: Sequence[tuple[int, str, int]]) -> None:
        for slot, run, batch in folders:
            path, files = self._files(f"{self.path}/slot={slot}/run={run}/batch={batch}")
            files.delete(path, True)
