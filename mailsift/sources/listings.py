"""Listings of mail that came in pages, each naming only the token of the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.operators.scaling import cut_lineage, first_by, lookup_join

PAGE = "listing string, pageToken string, messages array<struct<id string>>, nextPageToken string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages as JSON lines: the token a page was asked with, its message ids and the next token."""
    return parse_pages(spark.read.text(path).select(F.monotonically_increasing_id().alias("landed"), F.col("value").alias("raw")))


def parse_pages(raw: DataFrame) -> DataFrame:
    """landed and raw to listing, token ('' for the first page), next ('' for the last) and ids.

    Rows that are no page drop out: their absence breaks the chain, which ``rank_pages`` reports.
    """
    page = raw.select("landed", F.from_json("raw", PAGE).alias("p")).filter("p.messages IS NOT NULL OR p.nextPageToken IS NOT NULL")

    def text(name: str):
        return F.coalesce(F.col(f"p.{name}"), F.lit(""))

    return page.select(
        "landed",
        text("listing").alias("listing"),
        text("pageToken").alias("token"),
        text("nextPageToken").alias("next"),
        F.coalesce(F.transform("p.messages", lambda m: m["id"]), F.array().cast("array<string>")).alias("ids"),
    )


def rank_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages in order, rejects) of any number of listings at once.

    The first has listing, token, ``offset`` (ids on the pages before) and ids; the second listing, token
    and reject. A page that landed twice counts as it landed last.

    Tokens say only what comes next, so the order is a list ranking: every page learns who stands
    1, 2, 4, ... pages ahead, and from the first page the reached part doubles with each round. Rounds
    are the logarithm of the longest listing. Pages that no chain from a first page reaches are
    rejected, the gap is named; a listing whose chain runs into itself is rejected whole.
    """
    pages = cut_lineage(
        first_by(pages, ["listing", "token"], [F.desc("landed")]).select(
            "listing", "token", "next", "ids", F.size("ids").cast("long").alias("n")
        )
    )
    keys = ["listing", "token"]
    known = pages.select("listing", F.col("token").alias("ptr"), F.lit(True).alias("_there"))
    ahead = pages.select(*keys, F.when(F.col("next") != "", F.col("next")).alias("ptr"), F.col("n").alias("w"))
    ahead = lookup_join(ahead, known, ["listing", "ptr"], "left")
    ahead = cut_lineage(ahead.select(*keys, F.when(F.col("_there"), F.col("ptr")).alias("ptr"), "w"))
    reached = cut_lineage(pages.filter("token = ''").select(*keys, F.lit(0).cast("long").alias("offset")))
    ringed = None
    while True:
        hop = reached.join(ahead.filter("ptr IS NOT NULL"), keys).select(
            "listing", F.col("ptr").alias("token"), (F.col("offset") + F.col("w")).alias("offset"), F.lit(1).alias("hop")
        )
        both = reached.withColumn("hop", F.lit(0)).unionByName(hop).groupBy(*keys)
        # Met twice on one way means a ring; what a ring adds to an offset may be nothing, so visits count.
        now = cut_lineage(both.agg(F.min("offset").alias("offset"), F.count(F.lit(1)).alias("visits"), F.max("hop").alias("hop")))
        found = now.agg(F.max("hop"), F.max("visits")).first()
        if not found[0]:
            break
        reached = now.select(*keys, "offset")
        if found[1] > 1:
            rings = cut_lineage(now.filter("visits > 1").select("listing").distinct())
            ringed = rings if ringed is None else ringed.unionByName(rings).distinct()
            ahead = lookup_join(ahead, rings, ["listing"], "left_anti")
            reached = lookup_join(reached, rings, ["listing"], "left_anti")
        step = ahead.select("listing", F.col("token").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("w").alias("_w"))
        further = lookup_join(ahead, step, ["listing", "ptr"], "left")
        ahead = cut_lineage(further.select(*keys, F.col("_ptr").alias("ptr"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w")))
        reached = cut_lineage(reached)
    ranked = pages.join(reached, keys)
    lost = pages.join(reached, keys, "left_anti").select(*keys)
    in_ring = lost.limit(0) if ringed is None else lookup_join(lost, ringed, ["listing"], "left_semi")
    unreached = lost if ringed is None else lookup_join(lost, ringed, ["listing"], "left_anti")
    # The token that the last page of a chain names and no page answers.
    gap = ranked.filter("next <> ''").select("listing", F.col("next").alias("token"))
    gap = gap.join(pages.select(*keys), keys, "left_anti")
    rejects = (
        in_ring.withColumn("reject", F.lit("ring"))
        .unionByName(unreached.withColumn("reject", F.lit("not reached")))
        .unionByName(gap.withColumn("reject", F.lit("page missing")))
    )
    return ranked.select(*keys, "offset", "ids"), rejects


def listed_ids(ranked: DataFrame) -> DataFrame:
    """listing, pos and gmail_id: the listings in their order."""
    return ranked.select("listing", "offset", F.posexplode("ids").alias("_i", "gmail_id")).select(
        "listing", (F.col("offset") + F.col("_i")).alias("pos"), "gmail_id"
    )
