"""The message store: reading lists and counts, new mail, row changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.text import (
    NO_SENDER,
    compose_content,
    compose_email,
    mail_content,
    percent,
    preview,
    route_lang,
    strip,
)
from mailsift.functions.verdict import pending_filter, to_tier, version_tag
from mailsift.operators.allowlist import flag_trusted, override_verdict
from mailsift.operators.pages import row_range
from mailsift.operators.scaling import first_by, is_small, lookup_join, spread
from mailsift.schema import PAGE_SIZE, VERSION_KO


# ---- counts -------------------------------------------------------------------------------
def _count_label(column: str, label: str, name: str) -> Column:
    return F.sum((F.col(column) == label).cast("bigint")).alias(name)


def verdict_stats(messages: DataFrame) -> DataFrame:
    """total / spam / review / ham; the three sums are null on an empty store."""
    return messages.agg(
        F.count(F.lit(1)).alias("total"),
        _count_label("predicted_label", "spam", "spam_count"),
        _count_label("predicted_label", "review", "review_count"),
        _count_label("predicted_label", "ham", "ham_count"),
    )


def stats_view(stats: DataFrame) -> DataFrame:
    """What a page shows: 0 instead of null."""
    return stats.na.fill(0)


def report_counts(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count(F.lit(1)).alias("total"),
        _count_label("user_label", "spam", "spam_count"),
        _count_label("user_label", "ham", "ham_count"),
    )


def pending_count(messages: DataFrame, label: str | None = "spam") -> DataFrame:
    return messages.filter(pending_filter(label)).agg(F.count(F.lit(1)).alias("n"))


# ---- lists --------------------------------------------------------------------------------
def newest(rows: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` rows; equal times fall back to the higher id."""
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def page_count(total: int, size: int = PAGE_SIZE) -> int:
    return max(1, -(-total // size))


def clamp_page(page: int, total: int, size: int = PAGE_SIZE) -> int:
    return max(0, min(page, page_count(total, size) - 1))


def pending_page(
    messages: DataFrame, label: str | None = "spam", page: int = 0, size: int = PAGE_SIZE
) -> DataFrame:
    """One page of pending mail, newest first; a page past the end shows the last one."""
    pending = messages.filter(pending_filter(label))
    page = clamp_page(page, pending.count(), size)
    return row_range(pending, page * size, size)


def history_rows(messages: DataFrame, n: int = 20) -> DataFrame:
    """The history list: time, label, percent, preview."""
    return newest(messages, n).select(
        "id",
        F.date_format("created_at", "MM-dd HH:mm").alias("shown_at"),
        "predicted_label",
        percent("spam_prob").alias("percent"),
        preview("content", 80).alias("preview"),
    )


def mailbox_rows(messages: DataFrame) -> DataFrame:
    """The mailbox list: sender, preview and colour class."""
    sender = F.when(F.coalesce(F.col("sender"), F.lit("")) != "", F.col("sender")).otherwise(NO_SENDER)
    return messages.select(
        "id",
        "gmail_id",
        preview(sender, 60).alias("sender"),
        preview("content", 200).alias("preview"),
        F.when(F.col("predicted_label") == "spam", "spam").otherwise("other").alias("colour"),
    )


# ---- new mail -----------------------------------------------------------------------------
def split_empty(mail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): a hand-entered mail needs a subject or a body."""

    def blank(column: str) -> Column:
        return F.coalesce(strip(column), F.lit("")) == ""

    empty = blank("subject") & blank("body")
    return mail.filter(~empty), mail.filter(empty)


def new_mail(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched mail that is not stored yet, each id once, the earliest ``pos`` kept.

    A batch is far smaller than the store, so its ids are sent to the store scan, which reads
    just the id column and is not shuffled; the ids found there are at most the batch's.
    """
    batch = first_by(fetched.filter(F.col("gmail_id").isNotNull()), ["gmail_id"], [F.col("pos")])
    ids = fetched.select("gmail_id").dropna().distinct()
    known = stored.select("gmail_id").filter(F.col("gmail_id").isNotNull())
    if is_small(ids):
        known = known.join(F.broadcast(ids), "gmail_id", "left_semi").distinct()
        return batch.join(F.broadcast(known), "gmail_id", "left_anti")
    return batch.join(known, "gmail_id", "left_anti")


def stored_content(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored content of the picked ids; ids that are not stored drop out."""
    rows = messages.select("gmail_id", "content").filter(F.col("gmail_id").isNotNull())
    return lookup_join(rows, ids.select("gmail_id").distinct(), ["gmail_id"], "left_semi")


def routed(mail: DataFrame) -> DataFrame:
    """Add ``lang`` (from subject and body)."""
    return spread(mail).withColumn("lang", route_lang("subject", "body"))


def composed(mail: DataFrame) -> DataFrame:
    """Add the composed model ``text``."""
    return mail.withColumn("text", compose_email("subject", "sender", "body", "attachment"))


def model_input(mail: DataFrame) -> DataFrame:
    """Add ``lang`` (from subject and body) and the composed model ``text``."""
    return composed(routed(mail))


def fetched_messages(scored: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows to store for fetched mail that carries ``lang`` and ``spam_prob``: tier and allowlist; texts whole."""
    tiered = scored.withColumn("predicted_label", to_tier("spam_prob"))
    return override_verdict(flag_trusted(tiered, patterns)).select(
        F.lit("gmail").alias("source"),
        "gmail_id",
        F.coalesce("sender", F.lit("")).alias("sender"),
        mail_content("subject", "body").alias("content"),
        "predicted_label",
        "spam_prob",
        version_tag("lang").alias("model_version"),
        F.lit(0).alias("actioned"),
    )


def entered_messages(scored: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows to store for hand-entered mail: labelled content, always the default version."""
    tiered = scored.withColumn("predicted_label", to_tier("spam_prob"))
    return override_verdict(flag_trusted(tiered, patterns)).select(
        F.lit("manual").alias("source"),
        F.lit(None).cast("string").alias("gmail_id"),
        F.when(strip("sender") != "", strip("sender")).alias("sender"),
        compose_content("subject", "sender", "body", "attachment").alias("content"),
        "predicted_label",
        "spam_prob",
        F.lit(VERSION_KO).alias("model_version"),
        F.lit(0).alias("actioned"),
    )


# ---- row changes --------------------------------------------------------------------------
def mark_actioned(messages: DataFrame, action_log: DataFrame) -> DataFrame:
    """Messages with ``actioned`` set for every id in the log; nothing is deleted."""
    done = action_log.select("gmail_id").dropna().distinct().withColumn("_done", F.lit(1))
    return lookup_join(messages, done, ["gmail_id"]).withColumn(
        "actioned", F.coalesce("_done", "actioned")
    ).drop("_done").select(*messages.columns)


def not_spam_reports(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """One ham report per picked id that has stored content."""
    return (
        stored_content(messages, ids)
        .filter(F.coalesce(F.col("content"), F.lit("")) != "")
        .select(
            "gmail_id",
            "content",
            F.lit("ham").alias("user_label"),
            F.lit("gmail_not_spam").alias("note"),
        )
    )


def apply_actions(mailbox: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply one action per id to the mailbox labels; an unknown action or id fails.

    ``mailbox`` has gmail_id and labels (array), ``actions`` has gmail_id and action, one row per id.
    """
    a = F.col("action")
    added = F.when(a == "trash", F.array(F.lit("TRASH"))).when(a == "spam", F.array(F.lit("SPAM"))).when(
        a == "not_spam", F.array(F.lit("INBOX"))
    )
    removed = F.when(a == "not_spam", F.array(F.lit("SPAM"))).otherwise(F.array(F.lit("INBOX")))
    boxes = mailbox.filter(F.col("gmail_id").isNotNull()).withColumn("_found", F.lit(True))
    ids = actions.select("gmail_id")
    if is_small(ids):  # few actions: the mailbox is scanned, not shuffled
        boxes = boxes.join(F.broadcast(ids), "gmail_id", "left_semi")
    ok = F.col("_found").isNotNull() & added.isNotNull()
    return lookup_join(actions, boxes, ["gmail_id"]).select(
        "gmail_id",
        "action",
        F.when(ok, "ok").otherwise("fail").alias("status"),
        F.when(ok, F.array_union(F.array_except("labels", removed), added))
        .otherwise(F.col("labels"))
        .alias("labels"),
    )


def action_counts(applied: DataFrame) -> DataFrame:
    return applied.agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "fail").alias("fail"),
    )
