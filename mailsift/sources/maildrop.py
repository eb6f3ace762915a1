"""Fetched mail that landed as JSON: one message per row, parsed where it lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions import mime
from mailsift.operators.scaling import BROADCAST_ROWS, computed, cut_lineage, first_by, lookup_join, spread
from mailsift.schema import FETCH_SIZE


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as raw text; ``pos`` is the reading order."""
    return spark.read.text(path).select(
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("raw")
    )


def _read_parts(rows: DataFrame, parts: Column, keep: list[str], reject: Column) -> DataFrame:
    """body, attachment, reject, and ``_parts`` of the rows whose parts are not all read yet."""
    row = (
        rows.withColumn("_all", parts)
        .withColumn("_open", mime.unfinished(F.col("_all")))
        .withColumn("_read", F.when(~F.col("_open"), F.col("_all")))
        .withColumn("_texts", mime.decode_texts(mime.body_candidates(F.col("_read"), F.col("_top"))))
        .withColumn("_first", mime.first_text(F.col("_texts")))
    )
    return computed(
        row,
        keep,
        body=F.col("_first.text"),
        attachment=mime.attachment_names(F.col("_read")),
        reject=F.coalesce(reject, F.when(F.col("_first.broken"), "bad base64")),
        _top=F.when(F.col("_open"), F.col("_top")),
        _parts=F.when(F.col("_open"), F.col("_all")),
    )


def parse(raw: DataFrame) -> DataFrame:
    """pos and raw to gmail_id, subject, sender, body, attachment and ``reject`` (null when fine).

    Mail is parsed where it lies, in one pass, and written. Parts nested deeper than a pass reads are
    read in further passes over just those mails, whatever their depth; JSON that nests beyond the
    reader's own limit (1,000 brackets) is malformed.
    """
    top = F.col("_m.payload")
    named = ["pos", "gmail_id", "subject", "sender"]
    m = (
        spread(raw).withColumn("_m", mime.parse_message("raw"))
        .withColumn("_top", top["body"]["data"])
        .withColumn("gmail_id", F.col("_m.id"))
        .withColumn("subject", mime.header(top["headers"], "Subject"))
        .withColumn("sender", mime.header(top["headers"], "From"))
    )
    reject = F.when(F.col("_m._corrupt").isNotNull() | F.col("_m").isNull(), "malformed").when(
        F.col("_m.id").isNull(), "no id"
    )
    found = cut_lineage(_read_parts(m, mime.walk(top), named, reject))
    done = found.filter(F.col("_parts").isNull())
    while True:
        deep = found.filter(F.col("_parts").isNotNull())
        if deep.select("pos").limit(1).count() == 0:
            return done.drop("_top", "_parts")
        found = cut_lineage(_read_parts(deep.drop("body", "attachment"), mime.deepened(F.col("_parts")), named, F.col("reject")))
        done = done.unionByName(found.filter(F.col("_parts").isNull()))


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mail, rejects)."""
    ok = F.col("reject").isNull()
    return parsed.filter(ok).drop("reject"), parsed.filter(~ok).select("pos", "gmail_id", "reject")


def _wanted(listing: DataFrame, n: int) -> DataFrame:
    return first_by(listing.orderBy("pos").limit(n), ["gmail_id"], [F.col("pos")])


def fetch_recent(listing: DataFrame, parsed: DataFrame, n: int = FETCH_SIZE) -> DataFrame:
    """Bodies for the first ``n`` listed ids, in list order; ids without a response drop out."""
    answers = parsed.withColumnRenamed("pos", "_answer")
    hits = lookup_join(answers, _wanted(listing, n), ["gmail_id"], "inner", right_is_bounded=n <= BROADCAST_ROWS)
    return first_by(hits, ["gmail_id"], [F.desc("_answer")]).drop("_answer").orderBy("pos")


def fetch_landed(listing: DataFrame, raw: DataFrame, n: int = FETCH_SIZE) -> tuple[DataFrame, DataFrame]:
    """(mail, rejects) for the first ``n`` listed ids, from landed responses (pos, raw).

    Only the id of every response is read; what else it holds is parsed for the wanted ones alone.
    """
    ids = raw.withColumn("gmail_id", F.get_json_object("raw", "$.id"))
    wanted = _wanted(listing, n).select("gmail_id")
    hits = lookup_join(ids, wanted, ["gmail_id"], "left_semi", right_is_bounded=n <= BROADCAST_ROWS)
    mail, rejects = split_rejects(parse(hits.select("pos", "raw")))
    return fetch_recent(listing, mail, n), rejects
