"""Shards of equal size that keep linked documents together: balanced label propagation.

Documents of one group (equal texts) are linked. Every document starts in the shard its id hashes to.
In each round a group counts its members by shard, and the members elsewhere ask to move to the shard
that holds most of them. Asks are granted against each other (around a cycle of shards as many rows leave
as come, so full shards take part) and into the room of a quota, until no ask is granted any more. A group
larger than a shard fills shard after shard. At the end documents without links, and any linked ones
beyond a quota, fill the shards up to exact sizes: their numbers of rows differ by one at most.

Ranks come from counts by bucket and a numbering inside small buckets, so no task sees a whole shard.
A null text is an empty one; empty texts are equal. Rows that repeat an id are rows of their own, null
ids hash like any other value. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsift.operators.scaling import cut_lineage

# Rounds at most; most tables need fewer.
ROUNDS = 32
# Free share of a shard's quota below which a group with more members to move looks elsewhere.
NEARLY = 0.04
# Rows numbered in one go, and the buckets that the moves from one shard to another are granted by.
BUCKET_ROWS = 20_000
GRANTS = 256


def exchanges(asks: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may go from one shard to another: around cycles of asks, or along a way that ends in room.

    Swaps come first, then ever longer ways; a shard's rows grow by no more than its room.
    """
    open_asks, room = {k: n for k, n in asks.items() if n > 0}, list(room)
    granted: dict[tuple[int, int], int] = {}

    def grant(way: list[tuple[int, int]], n: int) -> None:
        for k in way:
            granted[k] = granted.get(k, 0) + n
            open_asks[k] -= n
            if not open_asks[k]:
                del open_asks[k]

    for i, j in sorted(open_asks):
        if (n := min(open_asks.get((i, j), 0), open_asks.get((j, i), 0))) and i < j:
            grant([(i, j), (j, i)], n)
    for i, j in sorted(open_asks):
        # Each way uses up an ask or a room.
        while (i, j) in open_asks:
            out: dict[int, list[int]] = {}
            for a, b in open_asks:
                out.setdefault(a, []).append(b)
            came, queue, end = {j: i}, deque([j]), None
            while queue and end is None:
                at = queue.popleft()
                if room[at] > 0 or at == i:
                    end = at
                    break
                for b in out.get(at, []):
                    if b not in came:
                        came[b] = at
                        queue.append(b)
            if end is None:
                break
            way, at = [], end
            while at != j:
                way.append((came[at], at))
                at = came[at]
            way.append((i, j))
            n = min(open_asks[k] for k in way)
            if end != i:
                n = min(n, room[end])
                room[end] -= n
                room[i] += n
            grant(way, n)
    return granted


def numbered(df: DataFrame, keys: list[str], rows: int, order: list[str]) -> DataFrame:
    """Adds ``rank``, gapless from 0 within ``keys``.

    Rows are dealt to buckets by hash; a bucket's first number is the count of all buckets before.
    """
    buckets = max(16, rows // BUCKET_ROWS)
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(F.lit(5), *order), F.lit(buckets)))
    sizes = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")
    starts = sizes.select(*keys, "_b", before.alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    return dealt.withColumn("_i", inside).join(starts, [*keys, "_b"]).withColumn("rank", F.col("_start") + F.col("_i")).drop("_b", "_i", "_start", "_n")


def _propagate(linked: DataFrame, quotas: list[int]) -> DataFrame:
    """Rounds of moves over rows of g, h and shard; returns them with their last shard."""
    quota, idle = min(quotas), 0
    for number in range(ROUNDS):
        counts = cut_lineage(linked.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("c")))
        loads = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("c").alias("n")).collect()}
        room = [q - loads.get(s, 0) for s, q in enumerate(quotas)]
        free = F.get(F.array(*[F.lit(r).cast("long") for r in room]), F.col("shard"))
        totals = counts.groupBy("g").agg(F.sum("c").alias("all"))
        # The fullest shard of the group; not one it fills already. In even rounds shards with room are
        # preferred among equals, and many members look only where there is much room.
        even = F.lit(number % 2 == 0)
        choice = F.struct("c", (even & (free > 0)).alias("r"), F.xxhash64(F.lit(number), "g", "shard").alias("t"), "shard")
        many = F.col("all") - F.col("c") > quota * NEARLY
        fits = (F.col("c") < quota * (1 - NEARLY)) & ~(even & many & (free <= quota * NEARLY))
        best = (
            counts.join(totals, "g").filter((F.col("all") > F.col("c")) & fits)
            .groupBy("g")
            .agg(F.max(choice).alias("best"))
            .select("g", F.col("best.shard").alias("to"), F.col("best.c").alias("at"))
        )
        # Of shards with as many members the one chosen wins; the others' members move.
        asks = counts.join(best, "g").filter((F.col("shard") != F.col("to")) & (F.col("c") <= F.col("at")))
        bucket = F.pmod(F.xxhash64(F.lit(number), "g"), F.lit(GRANTS))
        asks = cut_lineage(asks.select("g", "shard", "to", "c", bucket.alias("b")))
        by_bucket = asks.groupBy("shard", "to", "b").agg(F.sum("c").alias("w"))
        by_way = by_bucket.groupBy("shard", "to").agg(F.sum("w").alias("w")).collect()
        grants = exchanges({(r["shard"], r["to"]): r["w"] for r in by_way}, room)
        # Rounds differ in what they prefer: two without a move end it.
        idle = 0 if grants else idle + 1
        if idle == 2:
            break
        if not grants:
            continue
        rows = [(i, j, n) for (i, j), n in grants.items()]
        allowed = linked.sparkSession.createDataFrame(rows, "shard int, to int, n long")
        upto = F.sum("w").over(Window.partitionBy("shard", "to").orderBy("b"))
        left = F.col("n") - (F.col("upto") - F.col("w"))
        # All of a bucket, or the share of each of its groups that is still granted.
        share = F.when(left >= F.col("w"), F.lit(1.0)).when(left <= 0, F.lit(0.0)).otherwise(left / F.col("w"))
        granted = by_bucket.withColumn("upto", upto).join(F.broadcast(allowed), ["shard", "to"])
        granted = granted.select("shard", "to", "b", share.alias("share")).filter("share > 0")
        plan = asks.join(F.broadcast(granted), ["shard", "to", "b"])
        plan = plan.select(F.col("g").alias("_cg"), F.col("shard").alias("_cs"), "to", "share")
        joined = linked.join(plan, (linked["g"] == plan["_cg"]) & (linked["shard"] == plan["_cs"]), "left")
        # A row's own number in [0, 1) decides whether it is within its group's share.
        lot = F.pmod(F.xxhash64(F.lit(number), "h"), F.lit(1 << 20)) / float(1 << 20)
        going = F.col("to").isNotNull() & (lot < F.col("share"))
        linked = cut_lineage(joined.select(*[c for c in linked.columns if c != "shard"], F.when(going, F.col("to")).otherwise(F.col("shard")).alias("shard")))
    return linked


def shard_documents(documents: DataFrame, shards: int = 16, group: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text and 1), text_crc32, shard and slot of every row.

    ``group``: what linked documents share; the text itself if not given. Null groups are not linked.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    data = F.encode(whole, "UTF-8")
    g = F.md5(data) if group is None else group.cast("string")
    rows = cut_lineage(
        documents.select(
            F.col(key).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"), g.alias("g"), F.xxhash64(F.lit(3), F.col(key)).alias("h"),
        )
    )
    n = rows.count()
    sizes = rows.filter(F.col("g").isNotNull()).groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tagged = cut_lineage(rows.join(sizes, "g", "left"))
    linked = tagged.filter("n is not null").withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).drop("n")
    exact = [n // shards + (s < n % shards) for s in range(shards)]
    linked = cut_lineage(_propagate(cut_lineage(linked), exact))
    order = ["h", "doc_id", "g"]
    quotas = F.array(*[F.lit(q).cast("long") for q in exact])
    placed = cut_lineage(numbered(linked, ["shard"], n // shards, order))
    stays = F.col("rank") < F.get(quotas, F.col("shard"))
    settled = placed.filter(stays).withColumnRenamed("rank", "slot")
    loads = {r["shard"]: r["count"] for r in settled.groupBy("shard").count().collect()}
    free = tagged.filter("n is null").drop("n").unionByName(placed.filter(~stays).drop("shard", "rank"))
    free = numbered(free.withColumn("_one", F.lit(0)), ["_one"], n, order).drop("_one")
    # The free rows' numbers run through the shards' open places, shard by shard.
    shard, slot, before = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        taken = loads.get(s, 0)
        here = F.col("rank").between(before, before + exact[s] - taken - 1)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("rank") - before + taken).otherwise(slot)
        before += exact[s] - taken
    dealt = free.select(*rows.columns, shard.alias("shard"), slot.cast("long").alias("slot"))
    every = settled.select(*rows.columns, "shard", F.col("slot").cast("long").alias("slot")).unionByName(dealt)
    return every.select("doc_id", "size", "text_crc32", "shard", "slot")
