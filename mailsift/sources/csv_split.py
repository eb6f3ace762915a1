"""CSV records with quoted line breaks, read from large files in splits.

A line break ends a record where the quotes so far are even in number. Every split counts its quotes; a
prefix sum over the splits of a file tells whether a split begins inside a quoted field. Knowing that, a
task puts the lines of its split together, and only the record that crosses the end of a split is joined
from pieces of several.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsift.operators.scaling import cut_lineage, is_small

# ord of a record: the split's number over all files, then the record's in the split.
SPLIT_SHIFT = 27
# Splits whose state is broadcast in one read: with the usual 128 MB, over 100 TB.
MOST_SPLITS = 1_000_000
WHOLE, HEAD, MIDDLE, TAIL = range(4)
PYTHON_CHARSET = {"UTF-8": "utf-8", "MS949": "cp949"}
_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",]*)'
_RECORD = re.compile(f"{_FIELD}(?:,{_FIELD})*")


def file_path() -> Column:
    """The path a row was read from; the metadata are URL-encoded, save that a plus sign stays as it is."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def quotes(value: str = "value") -> Column:
    """Number of quotes, by bytes: no byte of a character of the two charsets is one."""
    return F.octet_length(value) - F.octet_length(F.replace(F.col(value), F.lit('"'), F.lit("")))


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(list(files)).select(
        file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _starts(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """path, block, file (number), base (ord of the split's first record), odd (it begins inside quotes), first."""
    numbers = spark.createDataFrame([(p, i) for i, p in enumerate(files)], "path string, file int")
    per = _lines(spark, files).groupBy("path", "block").agg(F.sum(quotes()).alias("q")).join(F.broadcast(numbers), "path")
    by_file = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("q").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a split, MOST_SPLITS at most: they can be numbered in one task.
    place = F.row_number().over(Window.orderBy("file", "block")) - 1
    return per.select(
        "path",
        "block",
        "file",
        F.shiftleft(place.cast("long"), SPLIT_SHIFT).alias("base"),
        (before % 2 == 1).alias("odd"),
        (F.row_number().over(by_file) == 1).alias("first"),
    )


def stray(text: str) -> bool:
    """True when quotes stand elsewhere than around a field or doubled inside one."""
    return '"' in text and _RECORD.fullmatch(text) is None


def _assembled(encoding: str):
    """Lines in order to rows of ROWS; ``base`` names the split."""
    charset = PYTHON_CHARSET[encoding]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, open_, carried, seq = None, [], False, False, 0
        out: list[tuple] = []

        def emit(kind):
            nonlocal held, seq
            text = b"\n".join(held).decode(charset, "replace")
            if kind in (WHOLE, TAIL):
                text = text.removesuffix("\r")
            if kind != WHOLE or text:  # an empty line is no record
                base, file, first = now
                out.append((base + seq, file, kind, text, kind == WHOLE and stray(text), first and seq == 0))
                seq += 1
            held = []

        def ended():
            if held:
                emit(MIDDLE if carried else HEAD)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("base", "file", "first", "odd", "value"))
            for base, file, first, odd, line in zip(*columns, strict=True):
                if base is None:
                    raise ValueError("the splits of a file changed while it was read; read it again")
                if now is None or base != now[0]:
                    ended()
                    now, held, open_, carried, seq = (base, file, first), [], odd, odd, 0
                held.append(line)
                open_ ^= bool(line.count(b'"') & 1)
                if not open_:
                    emit(TAIL if carried else WHOLE)
                    carried = False
            if out:
                yield _batch(out)
                out = []
        ended()
        if out:
            yield _batch(out)

    return run


# header: the first record of a file. stray: see ``stray``.
ROWS = "ord long, file int, kind int, text string, stray boolean, header boolean"
ARROW = pa.schema(
    [("ord", pa.int64()), ("file", pa.int32()), ("kind", pa.int32()), ("text", pa.string()), ("stray", pa.bool_()), ("header", pa.bool_())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that cross splits, as whole ones."""
    in_file = Window.partitionBy("file").orderBy("ord")
    numbered = pieces.withColumn("_record", F.sum((F.col("kind") == HEAD).cast("int")).over(in_file))
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    whole = numbered.groupBy("file", "_record").agg(
        F.min("ord").alias("ord"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"),
        (F.max("kind") != TAIL).alias("open"),
        F.bool_or("header").alias("header"),
    )
    return whole.select("ord", "file", "text", "open", "header").mapInArrow(_checked, ROWS)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("ord", "file", "text", "open", "header"))
        rows = [(ord_, file, WHOLE, text, o or stray(text), h) for ord_, file, text, o, h in zip(*columns, strict=True)]
        if rows:
            yield _batch(rows)


def records(spark: SparkSession, files: Sequence[str], encoding: str) -> tuple[DataFrame, list[str]]:
    """(ord, file, text and header of every record, files left out).

    Files are left out whose quotes do not pair up or stand inside plain fields: where they end a
    record is not a matter of counting. The records are written once, so that they are put together once.
    """
    starts = cut_lineage(_starts(spark, files))
    if not is_small(starts, MOST_SPLITS, 256 << 20):
        raise ValueError("too many splits for one read; read the files in several calls")
    # A broadcast join keeps the order of the lines.
    lines = _lines(spark, files).join(F.broadcast(starts), ["path", "block"], "left")
    lines = lines.select("base", "file", "first", "odd", F.col("value").cast("binary").alias("value"))
    read = cut_lineage(lines.mapInArrow(_assembled(encoding), ROWS))
    joined = cut_lineage(_joined(read.filter(F.col("kind") != WHOLE)))
    whole = read.filter(F.col("kind") == WHOLE).unionByName(joined)
    left_out = sorted(r["file"] for r in whole.filter("stray").select("file").distinct().toLocalIterator())
    if left_out:
        whole = whole.filter(~F.col("file").isin(left_out))
    return whole.select("ord", "file", "text", "header"), [files[i] for i in left_out]


def header_names(text: str, case_sensitive: bool) -> list[str]:
    """Column names of a header record: empty ones numbered, repeated ones with their place added."""
    names = next(csv.reader([text.removeprefix("﻿")], strict=False), [])
    folded = [n if case_sensitive else n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if folded.count(f) > 1 else n for i, (n, f) in enumerate(zip(names, folded, strict=True))]


def read_split(spark: SparkSession, files: Sequence[str], encoding: str) -> tuple[DataFrame | None, list[str]]:
    """(text columns and ``ord``, files left out) of CSV files with one encoding and header."""
    found, left_out = records(spark, files, encoding)
    # All of these files have the same header.
    head = found.filter("header").orderBy("ord").select("text").first()
    if head is None:
        return None, left_out
    names = header_names(head["text"], spark.conf.get("spark.sql.caseSensitive") == "true")
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    row = F.from_csv("text", fields, {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    rows = found.filter("NOT header").select("ord", row.alias("_row"))
    return rows.select(*[F.col("_row").getField(n).alias(n) for n in names], "ord"), left_out
