"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

# Texts turned into Python strings at a time, so that a batch of long ones stays small.
ROWS_AT_A_TIME = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text only, under plain names; a null text is an empty one."""
    # No alias for the usual name: two uses of the frame then have the same plan, and share exchanges.
    doc_id = F.col("doc_id") if key == "doc_id" else F.col(key).alias("doc_id")
    return df.select(doc_id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def struct_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterable[tuple]], ddl: str) -> DataFrame:
    """Run ``rows`` over each partition's rows (as column lists, some hundred rows at a time).

    ``rows`` gets an iterator of ``{column: list}`` and yields lists of result tuples. Only a slice of
    a partition is held at any time.
    """
    schema = struct_of(ddl)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema.fields]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(at, ROWS_AT_A_TIME)
                yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows(slices(batches)):
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], names=names
                )
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
