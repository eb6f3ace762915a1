"""Pages of a table in newest-first order, by cursor or by number.

The order is time, then id, both descending with nulls last, then a digest of the row. So only rows that
are equal throughout tie, and of those it is enough to know how many were shown. A page reads keys first;
digests are made for rows of the page's own keys alone.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Keys that may be sorted in one step and brought to the driver.
SHALLOW = 10_000
ID_SLOTS = 4096
# Digits of the digest by which rows of one time and id are told apart in one step.
DIGITS = 3


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: the key of its last row and how many rows equal to it were shown."""

    created_at: datetime | None
    id: int | None
    digest: str
    seen: int

    def token(self) -> str:
        """The cursor as text, to hand to a client."""
        at = None if self.created_at is None else self.created_at.isoformat(sep=" ")
        return base64.urlsafe_b64encode(json.dumps([at, self.id, self.digest, self.seen]).encode()).decode()

    @classmethod
    def of(cls, token: str) -> Cursor:
        at, id_, digest, seen = json.loads(base64.urlsafe_b64decode(token))
        return cls(None if at is None else datetime.fromisoformat(at), id_, digest, seen)


def _digest(rows: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in rows.columns])), 256)


def _newest_first() -> tuple[Column, ...]:
    return F.desc_nulls_last("created_at"), F.desc_nulls_last("id")


def _time(rows: DataFrame, at: datetime) -> Column:
    # As text, so that no time zone of the driver comes in; it folds to a constant that reaches the scan.
    return F.lit(at.isoformat(sep=" ")).cast(rows.schema["created_at"].dataType)


def _is(rows: DataFrame, at: datetime | None, id_: int | None) -> Column:
    same_time = F.col("created_at").isNull() if at is None else F.col("created_at") == _time(rows, at)
    return same_time & (F.col("id").isNull() if id_ is None else F.col("id") == id_)


def _after(rows: DataFrame, at: datetime | None, id_: int | None) -> Column:
    """Rows whose time and id come later in the order."""
    same_time = F.col("created_at").isNull() if at is None else F.col("created_at") == _time(rows, at)
    lower = F.lit(False) if id_ is None else (F.col("id") < id_) | F.col("id").isNull()
    later = same_time & lower
    if at is None:
        return later
    return (F.col("created_at") < _time(rows, at)) | F.col("created_at").isNull() | later


def _top(rows: DataFrame, n: int) -> list[Row]:
    """The first ``n`` keys; only the key columns are read."""
    return rows.select("created_at", "id").orderBy(*_newest_first()).limit(n).collect()


def _until(rows: DataFrame, last: Row) -> Column:
    """Rows up to and with the key ``last``; as no later key, so that no null decides."""
    until = ~F.coalesce(_after(rows, last["created_at"], last["id"]), F.lit(False))
    # The plain bound says no more, but reaches the scan.
    return until if last["created_at"] is None else until & (F.col("created_at") >= _time(rows, last["created_at"]))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*_newest_first(), F.asc("_digest"))


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows, with their digests."""
    keys = _top(rows, n) if n else []
    near = rows.filter(_until(rows, keys[-1])) if keys else rows.limit(0)
    return _in_order(near.withColumn("_digest", _digest(rows))).limit(n)


def page_after(rows: DataFrame, cursor: Cursor | None, size: int) -> tuple[DataFrame, Cursor | None]:
    """The ``size`` rows behind ``cursor`` (None: the first ones) and the cursor of their last row.

    The cursor is None when there are no more rows. Rows that equal the last one throughout are counted,
    not skipped one by one: they may be a large part of the table.
    """
    if cursor is None:
        page = _first(rows, size)
    else:
        at = (cursor.created_at, cursor.id)
        group = rows.filter(_is(rows, *at)).withColumn("_digest", _digest(rows))
        same, later = F.col("_digest") == cursor.digest, F.col("_digest") > cursor.digest
        equal, n = group.agg(F.count_if(same), F.count_if(later)).first()
        copies = min(size, max(equal - cursor.seen, 0))
        n = min(size - copies, n)
        behind = rows.filter(F.coalesce(_after(rows, *at), F.lit(False)))
        if cursor.created_at is not None:
            behind = behind.filter((F.col("created_at") <= _time(rows, cursor.created_at)) | F.col("created_at").isNull())
        page = group.filter(same).limit(copies).unionByName(_in_order(group.filter(later)).limit(n))
        page = _in_order(page.unionByName(_first(behind, size - copies - n)))
    ends = page.select("created_at", "id", "_digest").collect()
    if not ends:
        return page.drop("_digest"), None
    last = ends[-1]
    seen = sum(r == last for r in ends)
    if cursor is not None and tuple(last) == (cursor.created_at, cursor.id, cursor.digest):
        seen += cursor.seen
    return page.drop("_digest"), Cursor(*last, seen)


def row_range(rows: DataFrame, offset: int, size: int, shallow: int = SHALLOW) -> DataFrame:
    """Rows ``offset`` to ``offset + size``; pages by number and by cursor agree.

    Near the top a bounded sort of the keys serves. Deeper, ``seek`` finds the place by counting, so no
    task ever sorts or holds all rows above it.
    """
    if offset + size <= shallow:
        keys = _top(rows, offset + size)
        if len(keys) <= offset:
            return rows.limit(0)
        above = keys.index(keys[offset])
        near = rows.filter(_until(rows, keys[-1]) & ~_until_before(rows, keys[above]))
        return _in_order(near.withColumn("_digest", _digest(rows))).offset(offset - above).limit(size).drop("_digest")
    cursor = seek(rows, offset, shallow)
    return rows.limit(0) if cursor is None else page_after(rows, cursor, size)[0]


def _until_before(rows: DataFrame, first: Row) -> Column:
    """Rows whose key comes before ``first``."""
    at = (first["created_at"], first["id"])
    return ~F.coalesce(_is(rows, *at) | _after(rows, *at), F.lit(False))


def seek(rows: DataFrame, offset: int, shallow: int = SHALLOW) -> Cursor | None:
    """The cursor behind which row ``offset`` stands; None past the end.

    Counts by day, hour, ... then by ranges of ids, then by digits of the digest narrow the table to the
    few rows the place lies in; rows that are equal throughout need no narrowing.
    """
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("created_at"))
    pool, above, inside = rows, 0, shallow + 1

    def narrow(step: Column, descending: bool = True) -> None:
        nonlocal pool, above, inside
        slot, above, inside = _slot(pool, step, offset, above, descending)
        pool = pool.filter(step.eqNullSafe(F.lit(slot)))

    for unit in (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1):
        if inside > shallow:
            narrow(F.floor(micros / unit))
            if inside == 0:
                return None
    while inside > shallow:
        low, high, n = pool.agg(F.min("id"), F.max("id"), F.count("id")).first()
        if n == 0 or (low == high and n == inside):
            break
        narrow(F.floor((F.col("id") - low) / max(-(-(high - low + 1) // ID_SLOTS), 1)))
    pool = pool.withColumn("_digest", _digest(rows))
    digits = 0
    while inside > shallow:
        low, high = pool.agg(F.min("_digest"), F.max("_digest")).first()
        if low == high:
            break
        digits += DIGITS
        narrow(F.substring("_digest", 1, digits), descending=False)
    keys = pool.select("created_at", "id", "_digest")
    if inside > shallow:
        return Cursor(*keys.first(), offset - above)
    upto = _in_order(keys).limit(offset - above + 1).collect()
    return Cursor(*upto[-1], sum(r == upto[-1] for r in upto) - 1)


def _slot(pool: DataFrame, step: Column, offset: int, above: int, descending: bool) -> tuple[object, int, int]:
    """The slot holding row ``offset``, the rows above that slot, and the rows inside it (0: past the end)."""
    counts = pool.groupBy(step.alias("u")).agg(F.count(F.lit(1)).alias("n"))
    for row in counts.orderBy(F.desc("u") if descending else F.asc("u")).toLocalIterator():
        if above + row["n"] > offset:
            return row["u"], above, row["n"]
        above += row["n"]
    return None, above, 0
