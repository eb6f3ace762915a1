"""Best-fit packing of token pieces into sequences of a fixed length.

Every partition packs its own pieces by best fit (largest first), closes the bins that are nearly
full and hands the others on as items. The next round has fewer, merged partitions and packs these
items again, until one partition is left or a round merges nothing. A partition gets at most about
``ITEMS`` items, so no task grows with the input.

A null text is an empty one; an empty document still has its end id. A repeated row is packed again.
An empty table gives no sequences.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from mailsift.llm.bpe import PieceBytes, encode_bytes
from mailsift.llm.frames import keyed_texts, map_rows, struct_of
from mailsift.operators.scaling import cut_lineage

ITEMS = 20_000
# Share of the length from which a bin counts as nearly full.
NEARLY_FULL = 0.99
FAN_IN = 16
# Pieces a worker keeps the ids of; few, as a worker lives on after its task and new ones cost little.
KEPT = 60_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,salt:bigint>"
BINS = f"task long, bin long, closed boolean, fill long, members array<{MEMBER}>"


@cache
def pieces_by_library(path: str) -> PieceBytes:
    """Ids of single pieces by the rank-file encoder, which agrees with the library's own."""
    import tiktoken

    from mailsift.llm.bpe import vocabulary

    voc = vocabulary(path)
    ranks = {voc.strings[voc.of_byte[b]]: voc.of_byte[b] for b in range(256)}
    ranks |= {voc.strings[merged]: merged for _, merged in voc.merges.values()}
    order = [merged for _, merged in sorted(voc.merges.values())]
    if order != sorted(order):  # ids do not follow the ranks: merge by the table itself
        return PieceBytes(voc.encode_piece, KEPT)
    single = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return PieceBytes(single.encode_ordinary, KEPT)


def token_pieces(documents: DataFrame, path: str, length: int, end_id: int) -> DataFrame:
    """Encoded documents, each with its end id, cut into pieces of at most ``length`` ids.

    Only the first piece of a longer document may be shorter than ``length``.
    """

    def rows(slices):
        pieces = pieces_by_library(path)
        end = end_id.to_bytes(4, "little")
        for part in slices:
            out = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                data = encode_bytes(text, path, pieces) + end
                total = len(data) // 4
                at, n = 0, total % length or length
                number = 0
                while at < total:
                    out.append((doc_id, number, at, n, zlib.crc32(data[4 * at : 4 * (at + n)])))
                    at, n, number = at + n, length, number + 1
            yield out

    return map_rows(documents, rows, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Indexes by bin: each item, in the order given, goes where the least room is left.

    Bins are kept by their room (0 to ``capacity``); a bit set over rooms finds the tightest fit.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    bins: list[list[int]] = []
    for i, size in enumerate(sizes.tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


def _round(items: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """One best-fit round: items (fill, members) dealt to ``tasks`` groups by the number of their first member."""
    schema = struct_of(BINS)
    arrow = to_arrow_schema(schema)

    def pack(group: pa.Table) -> pa.Table:
        fills = group.column("fill").to_numpy()
        members = group.column("members").to_pylist()
        first = [(m[0]["doc_id"] is None, m[0]["doc_id"] or 0, m[0]["piece"], m[0]["ids_crc32"], m[0]["salt"]) for m in members]
        order = sorted(range(len(fills)), key=lambda i: (-fills[i], first[i]))
        task = group.column("task")[0].as_py()
        out = []
        for number, chosen in enumerate(best_fit(fills[order], capacity)):
            inside = [m for i in chosen for m in members[order[i]]]
            fill = sum(m["length"] for m in inside)
            out.append({"task": task, "bin": number, "closed": fill >= NEARLY_FULL * capacity, "fill": fill, "members": inside})
        return pa.Table.from_pylist(out, schema=arrow)

    head = F.element_at("members", 1)
    task = F.pmod(F.xxhash64(F.lit(tasks), head["doc_id"], head["piece"], head["salt"]), F.lit(tasks)).alias("task")
    return items.select(task, "fill", "members").groupBy("task").applyInArrow(pack, schema)


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Place pieces (PIECES columns) into sequences; adds sequence_id and offset."""
    pieces = cut_lineage(pieces.withColumn("salt", F.monotonically_increasing_id()))
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", "salt")
    whole = pieces.filter(F.col("length") == capacity)
    items = pieces.filter(F.col("length") < capacity).select(F.col("length").alias("fill"), F.array(member).alias("members"))
    done = [
        whole.select(
            F.xxhash64("doc_id", "piece").alias("task"),
            F.lit(0).cast("long").alias("round"),
            F.monotonically_increasing_id().alias("bin"),
            F.array(member).alias("members"),
        )
    ]
    left, number = items.count(), 0
    tasks = max(1, math.ceil(left / ITEMS))
    while left:
        number += 1
        bins = cut_lineage(_round(items, capacity, tasks))
        counts = bins.agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("closed")).alias("open")).first()
        last = tasks == 1 or counts["all"] >= left
        kept = bins if last else bins.filter("closed")
        done.append(kept.select("task", F.lit(number).cast("long").alias("round"), "bin", "members"))
        items = bins.filter(~F.col("closed")).select("fill", "members")
        left = 0 if last else counts["open"]
        tasks = max(math.ceil(tasks / FAN_IN), math.ceil(left / ITEMS), 1)
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    # 5 bits of round; whole pieces use Spark's own 33 + 31 bits of numbering, rounds a task and a bin.
    by_round = F.shiftleft("round", 58) + F.shiftleft("task", 32) + F.col("bin")
    sequence = F.when(F.col("round") == 0, F.col("bin")).otherwise(by_round)
    lengths = F.transform("members", lambda m: m["length"])
    placed = placed.select(sequence.alias("sequence_id"), F.posexplode("members").alias("at", "m"), lengths.alias("l"))
    offset = F.aggregate(F.slice("l", 1, F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.select("m.*", "sequence_id", offset.alias("offset")).drop("salt")


def pack_documents(
    documents: DataFrame, path: str, length: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode, cut and pack whole documents; one row per piece."""
    return pack_pieces(token_pieces(keyed_texts(documents, key, text), path, length, end_id), length)
