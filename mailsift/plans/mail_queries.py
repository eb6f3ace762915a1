"""Queries over the mailbox, the allowlist and stored messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift import schema as S
from mailsift.functions import text as tx
from mailsift.functions import verdict as vd
from mailsift.operators import allowlist, mailbox, pages
from mailsift.operators.scaling import spread
from mailsift.plans import fixtures as fx
from mailsift.plans import sqltext as q
from mailsift.plans.registry import query

TS = "yyyy-MM-dd HH:mm:ss"
SQL_TS = "%Y-%m-%d %H:%M:%S"

# ---- verdicts -----------------------------------------------------------------------------
_EMAIL = q.email("sender")
TRUST_SQL = f"""
trust AS (
  SELECT m.*, COALESCE(email <> '' AND EXISTS (
      SELECT 1 FROM trusted_senders t
      WHERE t.pattern = m.email
         OR (NOT contains(t.pattern, '@') AND m.domain <> ''
             AND (m.domain = t.pattern OR ends_with(m.domain, '.' || t.pattern)))), false) AS trusted
  FROM (SELECT *, {q.domain('email')} AS domain FROM (SELECT *, {_EMAIL} AS email FROM mail)) m)"""
OVERRIDE_SQL = """
overridden AS (
  SELECT * EXCLUDE (predicted_label, spam_prob),
    CASE WHEN trusted THEN 'ham' ELSE predicted_label END AS predicted_label,
    CASE WHEN trusted THEN 0.0 ELSE spam_prob END AS spam_prob
  FROM trust)"""
_OVERRIDDEN = fx.with_views(fx.MAIL_SQL, fx.TRUSTED_SQL, TRUST_SQL, OVERRIDE_SQL)


def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = allowlist.flag_trusted(fx.mail(spark, sf_dir), fx.trusted_senders(spark))
    return allowlist.override_verdict(flagged)


_STATS = """
SELECT count(*) AS total,
  CAST(sum(CAST(predicted_label = 'spam' AS INTEGER)) AS BIGINT) AS spam_count,
  CAST(sum(CAST(predicted_label = 'review' AS INTEGER)) AS BIGINT) AS review_count,
  CAST(sum(CAST(predicted_label = 'ham' AS INTEGER)) AS BIGINT) AS ham_count
FROM """


@query("verdict_stats", _OVERRIDDEN + _STATS + "overridden")
def verdict_stats(spark, sf_dir):
    return mailbox.verdict_stats(overridden(spark, sf_dir))


@query(
    "verdict_stats_empty",
    fx.with_views(fx.MAIL_SQL) + _STATS + "mail WHERE spam_prob > 2",
)
def verdict_stats_empty(spark, sf_dir):
    return mailbox.verdict_stats(fx.mail(spark, sf_dir).filter("spam_prob > 2"))


@query(
    "verdict_tier",
    fx.with_views(fx.MAIL_SQL) + f"SELECT id, spam_prob, {q.tier('spam_prob')} AS tier FROM mail",
)
def verdict_tier(spark, sf_dir):
    return fx.mail(spark, sf_dir).select("id", "spam_prob", vd.to_tier("spam_prob").alias("tier"))


@query(
    "verdict_binary",
    fx.with_views(fx.MAIL_SQL)
    + """SELECT id, CASE WHEN spam_prob >= 0.5 THEN 'spam' ELSE 'ham' END AS verdict,
  round(1 / (1 + exp(-(8 * spam_prob - 4))), 9) AS prob_of_score FROM mail""",
)
def verdict_binary(spark, sf_dir):
    score = 8 * F.col("spam_prob") - 4
    return fx.mail(spark, sf_dir).select(
        "id",
        vd.to_binary("spam_prob").alias("verdict"),
        F.round(vd.sigmoid(score), 9).alias("prob_of_score"),
    )


@query(
    "trusted_override",
    _OVERRIDDEN + "SELECT id, sender, trusted, predicted_label, spam_prob FROM overridden",
)
def trusted_override(spark, sf_dir):
    return overridden(spark, sf_dir).select("id", "sender", "trusted", "predicted_label", "spam_prob")


# ---- allowlist ----------------------------------------------------------------------------
@query(
    "sender_email",
    fx.with_views(fx.MAIL_SQL)
    + f"SELECT id, email, {q.domain('email')} AS domain FROM (SELECT id, {_EMAIL} AS email FROM mail)",
)
def sender_email(spark, sf_dir):
    rows = fx.mail(spark, sf_dir).select("id", tx.extract_email("sender").alias("email"))
    return rows.withColumn("domain", tx.email_domain("email"))


@query(
    "sender_trusted",
    fx.with_views(fx.MAIL_SQL, fx.TRUST_LOG_SQL)
    + f""", allow AS (SELECT DISTINCT {q.domain('p')} AS pattern FROM (
    SELECT lower({q.strip('pattern')}) AS p FROM trust_log) WHERE p <> ''),
  keyed AS (SELECT id, {_EMAIL} AS email FROM mail)
SELECT id, email IN (SELECT pattern FROM allow)
  OR EXISTS (SELECT 1 FROM allow WHERE contains(email, '@')
     AND (list_extract(string_split(email, '@'), -1) = pattern
          OR ends_with(list_extract(string_split(email, '@'), -1), '.' || pattern))) AS trusted
FROM keyed""",
)
def sender_trusted(spark, sf_dir):
    log = fx.trust_log(spark, sf_dir)
    patterns = log.select(tx.email_domain(allowlist.clean_pattern("pattern")).alias("pattern"))
    flagged = allowlist.flag_trusted(fx.mail(spark, sf_dir), patterns.filter("pattern <> ''"))
    return flagged.select("id", "trusted")


def _from_ids_sql(pattern: str) -> str:
    return fx.with_views(fx.MAIL_SQL, fx.PICKED_SQL) + (
        f"SELECT DISTINCT {pattern} AS pattern, 'from_list' AS note FROM ("
        f"SELECT {_EMAIL} AS email FROM mail WHERE gmail_id IN (SELECT gmail_id FROM picked)"
        " AND sender <> '') WHERE email <> ''"
    )


@query("trust_patterns_from_ids", _from_ids_sql("email"))
def trust_patterns_from_ids(spark, sf_dir):
    return allowlist.patterns_from_ids(fx.mail(spark, sf_dir), fx.picked_ids(spark, sf_dir))


@query(
    "trust_domains_from_ids",
    _from_ids_sql(f"CASE WHEN contains(email, '@') THEN {q.domain('email')} ELSE email END"),
)
def trust_domains_from_ids(spark, sf_dir):
    return allowlist.patterns_from_ids(fx.mail(spark, sf_dir), fx.picked_ids(spark, sf_dir), True)


def list_sql(log_filter: str) -> str:
    return fx.with_views(fx.TRUST_LOG_SQL) + f""", log AS (
  SELECT id, lower({q.strip('pattern')}) AS pattern, note, op, created_at FROM trust_log),
live AS (
  SELECT a.* FROM log a WHERE a.pattern <> '' AND a.op = 'add' AND {log_filter}
    AND a.id > COALESCE((SELECT max(r.id) FROM log r
       WHERE r.pattern = a.pattern AND r.op = 'remove' AND {log_filter.replace('a.', 'r.')}), -1))
SELECT pattern, min(id) AS id, arg_max(note, id) AS note,
  strftime(arg_min(created_at, id), '{SQL_TS}') AS created_at FROM live GROUP BY pattern"""


def _listed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("created_at", F.date_format("created_at", TS))


@query("trust_upsert", list_sql("a.op = 'add'"))
def trust_upsert(spark, sf_dir):
    log = fx.trust_log(spark, sf_dir).filter("op = 'add'")
    return _listed(allowlist.current_list(allowlist.add_rows(log)))


@query("trust_remove", list_sql("true"))
def trust_remove(spark, sf_dir):
    return _listed(allowlist.current_list(fx.trust_log(spark, sf_dir)))


@query("trust_list", list_sql("true") + " ORDER BY created_at DESC, id DESC")
def trust_list(spark, sf_dir):
    return _listed(allowlist.newest_first(allowlist.current_list(fx.trust_log(spark, sf_dir))))


# ---- lists and counts ---------------------------------------------------------------------
MESSAGES_SQL = f"""
messages AS (SELECT *, {q.mail_content('subject', 'body')} AS content FROM mail)"""
_MESSAGES = fx.with_views(fx.MAIL_SQL, MESSAGES_SQL)
_PENDING = "source = 'gmail' AND gmail_id IS NOT NULL AND actioned = 0"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.mail(spark, sf_dir).withColumn("content", tx.mail_content("subject", "body"))


@query(
    "pending_page",
    _MESSAGES
    + f"""SELECT id, gmail_id, predicted_label, content, strftime(created_at, '{SQL_TS}') AS created_at
FROM messages WHERE {_PENDING} AND predicted_label IN ('spam', 'review')
ORDER BY messages.created_at DESC, id DESC LIMIT 10 OFFSET 30""",
)
def pending_page(spark, sf_dir):
    page = mailbox.pending_page(messages(spark, sf_dir), "spam", page=3)
    return page.select(
        "id", "gmail_id", "predicted_label", "content", F.date_format("created_at", TS).alias("created_at")
    )


@query(
    "pending_last_page",
    _MESSAGES
    + f""", p AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rn, count(*) OVER () AS n
  FROM messages WHERE {_PENDING} AND predicted_label = 'ham')
SELECT id FROM p WHERE rn > ((n - 1) // 10) * 10""",
)
def pending_last_page(spark, sf_dir):
    return mailbox.pending_page(messages(spark, sf_dir), "ham", page=10**9).select("id")


@query(
    "deep_row_range",
    fx.with_views(fx.MAIL_SQL)
    + "SELECT id FROM mail ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 150",
)
def deep_row_range(spark, sf_dir):
    rows = fx.mail(spark, sf_dir).select("id", "created_at")
    return mailbox.row_range(rows, 150, 25, shallow=100).select("id")


_TIED_SQL = """, tied AS (
  SELECT id // 10 AS id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(id // 50 AS INTEGER)) AS created_at FROM mail)
"""


def _tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are equal ten at a time, as a repeated load leaves them."""
    return fx.mail(spark, sf_dir).select(
        F.expr("id div 10").alias("id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id div 50 AS INT))").alias("created_at"),
    )


@query(
    "cursor_pages",
    fx.with_views(fx.MAIL_SQL).rstrip()
    + _TIED_SQL
    + """SELECT (row_number() OVER (ORDER BY created_at DESC, id DESC) - 1) // (count(*) OVER () // 5 + 1) AS page, id FROM tied""",
)
def cursor_pages(spark, sf_dir):
    """All pages of a table full of ties, each from where the last one ended."""
    rows = _tied(spark, sf_dir)
    size = rows.count() // 5 + 1
    found, cursor, number = None, None, 0
    while True:
        page, cursor = pages.page_after(rows, cursor and pages.Cursor.of(cursor.token()), size)
        if cursor is None:
            return found
        page = page.select(F.lit(number).cast("bigint").alias("page"), "id")
        found, number = page if found is None else found.unionByName(page), number + 1


@query(
    "deep_tied_page",
    fx.with_views(fx.MAIL_SQL).rstrip() + _TIED_SQL + "SELECT id FROM tied ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 157",
)
def deep_tied_page(spark, sf_dir):
    """A page by number below the reach of a sort, among rows that are equal throughout."""
    return pages.row_range(_tied(spark, sf_dir), 157, 25, shallow=5).select("id")


@query(
    "pending_count",
    _MESSAGES
    + f"""SELECT 'spam' AS filter, count(*) AS n FROM messages WHERE {_PENDING} AND predicted_label IN ('spam', 'review')
UNION ALL SELECT 'ham', count(*) FROM messages WHERE {_PENDING} AND predicted_label = 'ham'
UNION ALL SELECT 'all', count(*) FROM messages WHERE {_PENDING}""",
)
def pending_count(spark, sf_dir):
    rows = fx.mail(spark, sf_dir)
    parts = [
        mailbox.pending_count(rows, label).select(F.lit(label or "all").alias("filter"), "n")
        for label in ("spam", "ham", None)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "recent_history",
    _MESSAGES
    + f"""SELECT id, strftime(created_at, '%m-%d %H:%M') AS shown_at, predicted_label,
  CAST(CAST(round_even(spam_prob * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS percent,
  {q.preview('content', 80)} AS preview
FROM messages ORDER BY messages.created_at DESC, id DESC LIMIT 20""",
)
def recent_history(spark, sf_dir):
    return mailbox.history_rows(messages(spark, sf_dir))


@query(
    "recent_reports",
    fx.with_views(fx.REPORTS_SQL)
    + f"""SELECT id, content, user_label, strftime(created_at, '{SQL_TS}') AS created_at
FROM user_reports ORDER BY user_reports.created_at DESC, id DESC LIMIT 20""",
)
def recent_reports(spark, sf_dir):
    rows = mailbox.newest(fx.user_reports(spark, sf_dir))
    return rows.select("id", "content", "user_label", F.date_format("created_at", TS).alias("created_at"))


@query(
    "report_counts",
    fx.with_views(fx.REPORTS_SQL)
    + """SELECT count(*) AS total,
  CAST(sum(CAST(user_label = 'spam' AS INTEGER)) AS BIGINT) AS spam_count,
  CAST(sum(CAST(user_label = 'ham' AS INTEGER)) AS BIGINT) AS ham_count FROM user_reports""",
)
def report_counts(spark, sf_dir):
    return mailbox.report_counts(fx.user_reports(spark, sf_dir))


@query(
    "mailbox_preview",
    _MESSAGES
    + f"""SELECT id, gmail_id,
  {q.preview("(CASE WHEN COALESCE(sender, '') <> '' THEN sender ELSE '(발신자 없음)' END)", 60)} AS sender,
  {q.preview('content', 200)} AS preview,
  CASE WHEN predicted_label = 'spam' THEN 'spam' ELSE 'other' END AS colour FROM messages""",
)
def mailbox_preview(spark, sf_dir):
    return mailbox.mailbox_rows(spread(messages(spark, sf_dir), "id"))


# ---- new mail and row changes -------------------------------------------------------------
@query(
    "new_mail_only",
    fx.with_views(fx.MAIL_SQL)
    + """, fetched AS (
  SELECT gmail_id, id AS pos, subject FROM mail
  UNION ALL SELECT gmail_id, id + 1000000000 AS pos, 'again' FROM mail WHERE id % 10 = 1)
SELECT gmail_id, pos, subject FROM (
  SELECT *, row_number() OVER (PARTITION BY gmail_id ORDER BY pos) AS rn FROM fetched WHERE gmail_id IS NOT NULL)
WHERE rn = 1 AND gmail_id NOT IN (SELECT gmail_id FROM mail WHERE gmail_id IS NOT NULL AND id % 3 = 1)""",
)
def new_mail_only(spark, sf_dir):
    rows = fx.mail(spark, sf_dir)
    fetched = rows.select("gmail_id", F.col("id").alias("pos"), "subject").unionByName(
        rows.filter("id % 10 = 1").select(
            "gmail_id", (F.col("id") + 1_000_000_000).alias("pos"), F.lit("again").alias("subject")
        )
    )
    return mailbox.new_mail(fetched, rows.filter("id % 3 = 1"))


@query(
    "stored_content_for_ids",
    fx.with_views(fx.MAIL_SQL, MESSAGES_SQL, fx.PICKED_SQL)
    + "SELECT gmail_id, content FROM messages WHERE gmail_id IN (SELECT gmail_id FROM picked)",
)
def stored_content_for_ids(spark, sf_dir):
    return mailbox.stored_content(messages(spark, sf_dir), fx.picked_ids(spark, sf_dir))


@query(
    "not_spam_reports",
    fx.with_views(fx.MAIL_SQL, MESSAGES_SQL, fx.PICKED_SQL)
    + """SELECT gmail_id, content, 'ham' AS user_label, 'gmail_not_spam' AS note
FROM messages WHERE gmail_id IN (SELECT gmail_id FROM picked) AND content <> ''""",
)
def not_spam_reports(spark, sf_dir):
    return mailbox.not_spam_reports(messages(spark, sf_dir), fx.picked_ids(spark, sf_dir))


_HALF_EMPTY = """, typed AS (
  SELECT id, CASE WHEN id % 8 = 0 THEN '  ' WHEN id % 8 = 4 THEN NULL ELSE subject END AS subject,
    CASE WHEN id % 12 = 0 THEN chr(9) || ' ' ELSE body END AS body FROM mail)
"""


@query(
    "reject_empty",
    fx.with_views(fx.MAIL_SQL)
    + _HALF_EMPTY
    + f"""SELECT id, COALESCE({q.strip('subject')}, '') = '' AND COALESCE({q.strip('body')}, '') = '' AS rejected
FROM typed""",
)
def reject_empty(spark, sf_dir):
    typed = fx.mail(spark, sf_dir).select(
        "id",
        F.when(F.col("id") % 8 == 0, "  ").when(F.col("id") % 8 != 4, F.col("subject")).alias("subject"),
        F.when(F.col("id") % 12 == 0, "\t ").otherwise(F.col("body")).alias("body"),
    )
    usable, rejected = mailbox.split_empty(typed)
    return usable.select("id", F.lit(False).alias("rejected")).unionByName(
        rejected.select("id", F.lit(True).alias("rejected"))
    )


@query(
    "mark_actioned",
    fx.with_views(fx.MAIL_SQL, fx.PICKED_SQL)
    + """SELECT id, gmail_id,
  CASE WHEN gmail_id IN (SELECT gmail_id FROM picked) THEN 1 ELSE actioned END AS actioned FROM mail""",
)
def mark_actioned(spark, sf_dir):
    rows = fx.mail(spark, sf_dir).select("id", "gmail_id", "actioned")
    return mailbox.mark_actioned(rows, fx.picked_ids(spark, sf_dir))


_ACTIONS_SQL = fx.with_views(fx.MAIL_SQL) + """, boxes AS (
  SELECT gmail_id, CASE WHEN predicted_label = 'spam' THEN ['SPAM'] ELSE ['INBOX', 'UNREAD'] END AS labels
  FROM mail WHERE gmail_id IS NOT NULL),
actions AS (
  SELECT 'g' || doc_id AS gmail_id,
    CASE doc_id % 5 WHEN 0 THEN 'trash' WHEN 1 THEN 'spam' WHEN 2 THEN 'not_spam' WHEN 3 THEN 'archive' ELSE 'trash' END AS action
  FROM documents WHERE doc_id % 3 = 0),
applied AS (
  SELECT a.gmail_id, action, b.gmail_id IS NOT NULL AND action IN ('trash', 'spam', 'not_spam') AS ok, labels
  FROM actions a LEFT JOIN boxes b ON a.gmail_id = b.gmail_id)
"""


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx.mail(spark, sf_dir).select(
        "gmail_id",
        F.when(F.col("predicted_label") == "spam", F.array(F.lit("SPAM")))
        .otherwise(F.array(F.lit("INBOX"), F.lit("UNREAD")))
        .alias("labels"),
    )
    d = F.col("doc_id")
    actions = (
        fx.table(spark, sf_dir, "documents")
        .filter(d % 3 == 0)
        .select(
            F.concat(F.lit("g"), d.cast("string")).alias("gmail_id"),
            F.element_at(
                F.array(*[F.lit(a) for a in ("trash", "spam", "not_spam", "archive", "trash")]),
                (d % 5 + 1).cast("int"),
            ).alias("action"),
        )
    )
    return mailbox.apply_actions(boxes, actions)


@query(
    "mailbox_labels",
    _ACTIONS_SQL
    + """SELECT gmail_id, action, CASE WHEN ok THEN 'ok' ELSE 'fail' END AS status,
  array_to_string(list_sort(CASE WHEN NOT ok THEN labels
    WHEN action = 'not_spam' THEN list_distinct(list_concat(list_filter(labels, lambda x: x <> 'SPAM'), ['INBOX']))
    ELSE list_distinct(list_concat(list_filter(labels, lambda x: x <> 'INBOX'), [upper(action)])) END), ' ') AS labels
FROM applied""",
)
def mailbox_labels(spark, sf_dir):
    return _applied(spark, sf_dir).withColumn("labels", F.array_join(F.array_sort("labels"), " "))


@query("action_counts", _ACTIONS_SQL + "SELECT count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS fail FROM applied")
def action_counts(spark, sf_dir):
    return mailbox.action_counts(_applied(spark, sf_dir))


# ---- composed fields ----------------------------------------------------------------------
_FIELDS = ("subject", "sender", "body", "attachment")


@query("compose_text", fx.with_views(fx.MAIL_SQL) + f"SELECT id, {q.compose_email(*_FIELDS)} AS text FROM mail")
def compose_text(spark, sf_dir):
    return spread(fx.mail(spark, sf_dir), "id").select("id", tx.compose_email(*_FIELDS).alias("text"))


@query(
    "compose_content",
    fx.with_views(fx.MAIL_SQL) + f"SELECT id, {q.compose_content(*_FIELDS)} AS content FROM mail",
)
def compose_content(spark, sf_dir):
    return spread(fx.mail(spark, sf_dir), "id").select("id", tx.compose_content(*_FIELDS).alias("content"))


_LANG = q.lang_of("concat_ws(' ', subject, body)")
_STORED = f"""SELECT 'gmail' AS source, gmail_id, COALESCE(sender, '') AS sender,
  {q.mail_content('subject', 'body')} AS content, predicted_label, spam_prob,
  CASE WHEN {_LANG} = 'ko' THEN 'v1' ELSE 'v1-en' END AS model_version, 0 AS actioned
FROM overridden WHERE gmail_id IS NOT NULL"""


@query("mail_projection", _OVERRIDDEN + _STORED)
def mail_projection(spark, sf_dir):
    rows = mailbox.model_input(fx.mail(spark, sf_dir).filter("gmail_id IS NOT NULL"))
    return mailbox.fetched_messages(rows, fx.trusted_senders(spark))


@query(
    "manual_projection",
    _OVERRIDDEN
    + f"""SELECT 'manual' AS source, CAST(NULL AS VARCHAR) AS gmail_id,
  CASE WHEN {q.strip('sender')} <> '' THEN {q.strip('sender')} END AS sender,
  {q.compose_content(*_FIELDS)} AS content, predicted_label, spam_prob, 'v1' AS model_version, 0 AS actioned
FROM overridden WHERE gmail_id IS NULL""",
)
def manual_projection(spark, sf_dir):
    rows = mailbox.model_input(fx.mail(spark, sf_dir).filter("gmail_id IS NULL"))
    return mailbox.entered_messages(rows, fx.trusted_senders(spark))


@query("route_lang", fx.with_views(fx.MAIL_SQL) + f"SELECT id, {_LANG} AS lang FROM mail")
def route_lang(spark, sf_dir):
    return fx.mail(spark, sf_dir).select("id", tx.route_lang("subject", "body").alias("lang"))


@query(
    "conform_schema",
    _MESSAGES
    + f"""SELECT id, 'manual' AS source, gmail_id, CAST(NULL AS VARCHAR) AS sender, content, label AS predicted_label,
  spam_prob, 'v1' AS model_version, 0 AS actioned, CAST(NULL AS VARCHAR) AS created_at, label IN ('ham', 'review', 'spam') AS valid
FROM (SELECT *, CASE WHEN id % 5 = 0 THEN upper(predicted_label) ELSE predicted_label END AS label FROM messages)""",
)
def conform_schema(spark, sf_dir):
    """An older table without some columns, with out-of-domain labels, brought to the schema."""
    old = messages(spark, sf_dir).select(
        "spam_prob",
        F.col("id").cast("string").alias("id"),
        "gmail_id",
        "content",
        F.when(F.col("id") % 5 == 0, F.upper("predicted_label"))
        .otherwise(F.col("predicted_label"))
        .alias("predicted_label"),
    )
    rows = S.conform(old, S.MESSAGES, S.MESSAGE_DEFAULTS)
    valid, rejects = S.split_domain(rows, "predicted_label", S.TIER_LABELS)
    both = valid.withColumn("valid", F.lit(True)).unionByName(rejects.withColumn("valid", F.lit(False)))
    return both.withColumn("created_at", F.date_format("created_at", TS))
