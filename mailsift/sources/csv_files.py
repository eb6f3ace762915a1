"""Labelled CSV sources in mixed encodings, and the corpus sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions.verdict import is_spam
from mailsift.schema import CORPUS
from mailsift.session import RUNTIME_CONF
from mailsift.sources.csv_split import file_path, quotes, read_split

# Cell texts read as missing, as the usual CSV reader of Python does.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
KOREAN_CHARSET = "MS949"


def file_encodings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, encoding, header, breaks: UTF-8 where every line is valid UTF-8, else the Korean charset.

    Lines are tested as raw bytes, so big files are checked in splits. Line breaks are the same
    byte in both charsets. ``header`` is a digest of the first line's bytes. ``breaks`` says that some
    line has an odd number of quotes, so that quoted fields may go on over lines.
    """
    at = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    lines = spark.read.text(list(paths)).select(
        file_path().alias("path"),
        F.is_valid_utf8("value").alias("ok"),
        (quotes() % 2 == 1).alias("odd"),
        F.struct(at.alias("at"), "value").alias("line"),
    )
    first = F.min(F.when(F.col("line.at").isNotNull(), F.col("line")))["value"]
    return lines.groupBy("path").agg(
        F.when(F.bool_and("ok"), "UTF-8").otherwise(KOREAN_CHARSET).alias("encoding"),
        F.md5(first.cast("binary")).alias("header"),
        F.bool_or("odd").alias("breaks"),
    )


def _plain_csv(spark: SparkSession, files: Sequence[str], encoding: str, multi_line: bool) -> DataFrame:
    options = {"header": True, "multiLine": multi_line, "encoding": encoding, "escape": '"'}
    part = spark.read.options(**options).csv(list(files))
    return part.withColumn("ord", F.monotonically_increasing_id())


def read_csv_any(
    spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True, as_text: bool = True
) -> DataFrame:
    """CSV files, whatever their encoding and header, as text columns plus ``ord``.

    Files are read in groups of one encoding and header, in the order of each group's first path,
    and united by column name. Bytes that fit neither encoding are replaced; a missing file raises
    at once. ``ord`` is unique over all files and follows the reading order.

    Every file is read in splits, also where quoted fields hold line breaks (``csv_split``). Only a file
    whose quotes do not pair up is one split. ``multi_line=False`` takes every line for a record.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        spark.conf.set("spark.sql.legacy.javaCharsets", RUNTIME_CONF["spark.sql.legacy.javaCharsets"])
    groups: dict[tuple[str, str, bool], list[str]] = {}
    for row in file_encodings(spark, paths).orderBy("path").toLocalIterator():
        groups.setdefault((row["encoding"], row["header"], multi_line and row["breaks"]), []).append(row["path"])
    parts: list[DataFrame] = []
    for (encoding, _, breaks), files in groups.items():
        if breaks:
            part, files = read_split(spark, files, encoding)
            parts += [] if part is None else [part]
        if files:
            parts.append(_plain_csv(spark, files, encoding, breaks))
    out = None
    for number, part in enumerate(parts):
        names = [c for c in part.columns if c != "ord"]
        # What orders the rows of a group stays below 63 bits with the group's number above it.
        part = part.withColumn("ord", F.col("ord") + (number << 50))
        if as_text:
            part = part.withColumns({c: F.when(~F.col(c).isin(*MISSING), F.col(c)) for c in names})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no rows in {paths}")
    return out


def read_each(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """One frame per file, for files whose headers differ."""
    return [read_csv_any(spark, p) for p in paths]


def glob_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files matching a glob, in name order."""
    listed = spark.read.format("binaryFile").load(pattern).select("path").orderBy("path")
    return [r["path"] for r in listed.toLocalIterator()]


def read_optional(spark: SparkSession, path: str) -> DataFrame:
    """label, text of a source that may be absent; then an empty frame of the same shape."""
    try:
        return read_csv_any(spark, path).select("label", "text", "ord")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "label string, text string, ord bigint")


def with_target(rows: DataFrame) -> DataFrame:
    """Labelled corpus rows: language 'ko' when absent, nulls dropped, target y derived."""
    if "lang" not in rows.columns:
        rows = rows.withColumn("lang", F.lit("ko"))
    return rows.dropna(subset=["label", "text", "lang"]).withColumn("y", is_spam("label"))


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    rows = read_csv_any(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    return with_target(rows)


def read_demo(spark: SparkSession, path: str) -> DataFrame:
    """The demo set: label, text, lang."""
    return read_csv_any(spark, path).select(*CORPUS.fieldNames(), "ord")


def write_corpus(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = rows.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
