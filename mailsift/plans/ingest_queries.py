"""Queries over landed mail, CSV sources, the store and synthetic mail."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsift.functions.text import collapse
from mailsift.operators import augment, mailbox, metrics
from mailsift.operators.features import load_vocabulary, save_vocabulary, vocabulary
from mailsift.operators.scaling import cut_lineage, spread
from mailsift.plans import fixtures as fx
from mailsift.plans import sqltext as q
from mailsift.plans.mail_queries import MESSAGES_SQL, SQL_TS, TS, list_sql, messages
from mailsift.plans.registry import query
from mailsift.session import shared_dir
from mailsift.sources import csv_files, listings, maildrop
from mailsift.sources.snapshots import ACTIONS, TRUST, Snapshots
from mailsift.sources.tables import Store, save_predictions, save_run


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


# ---- landed mail --------------------------------------------------------------------------
def _base64url(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", ""), "+/", "-_")


def _leaf(mime: str, filename: Column | None, text: Column | None) -> Column:
    data = _base64url(text) if text is not None else F.lit(None).cast("string")
    name = filename if filename is not None else F.lit("")
    return F.struct(
        F.lit(mime).alias("mimeType"), name.alias("filename"), F.struct(data.alias("data")).alias("body")
    )


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail as fetched JSON: mixed-case headers, nested parts, decoys, and broken rows."""
    d = F.col("id")
    header = F.array(
        F.struct(F.lit("X-Id").alias("name"), d.cast("string").alias("value")),
        F.struct(F.when(d % 2 == 0, "SUBJECT").otherwise("subject").alias("name"), F.col("subject").alias("value")),
        F.struct(F.lit("From").alias("name"), F.col("sender").alias("value")),
        F.struct(F.lit("from").alias("name"), F.lit("second@example.net").alias("value")),
    )
    plain = _leaf("text/plain", None, F.concat(F.lit(" \n"), F.col("body"), F.lit("\n")))
    inner = F.struct(
        F.lit("multipart/alternative").alias("mimeType"),
        F.array(_leaf("text/html", None, F.lit("<b>no</b>")), plain).alias("parts"),
    )
    nested = F.struct(
        header.alias("headers"),
        F.lit("multipart/mixed").alias("mimeType"),
        F.array(
            F.to_json(inner),
            F.to_json(_leaf("application/pdf", F.col("attachment"), None)),
            F.to_json(_leaf("text/plain", None, F.lit("second text, not read"))),
            F.to_json(_leaf("image/png", F.when(d % 5 == 0, "b.png").otherwise(""), None)),
        ).alias("parts"),
    )
    # The parts differ in shape, so they are put in as written JSON.
    tree = F.concat(
        F.lit('{"headers":'), F.to_json(header), F.lit(',"mimeType":"multipart/mixed","parts":['),
        F.array_join(nested["parts"], ","), F.lit("]}"),
    )
    flat = F.to_json(
        F.struct(
            header.alias("headers"),
            F.lit("text/html").alias("mimeType"),
            F.struct(_base64url(F.col("body")).alias("data")).alias("body"),
        )
    )
    raw = F.concat(
        F.lit('{"id":"m'), d.cast("string"), F.lit('","payload":'),
        F.when(d % 4 == 0, flat).otherwise(tree), F.lit("}"),
    )
    cut = F.substring(raw, 1, F.length(raw) - 7)
    return spread(fx.mail(spark, sf_dir), "id").select(d.alias("pos"), F.when(d % 11 == 0, cut).otherwise(raw).alias("raw"))


_MIME_SQL = fx.with_views(fx.MAIL_SQL)


@query(
    "mime_parse",
    _MIME_SQL
    + f"""SELECT id AS pos, 'm' || id AS gmail_id, subject, COALESCE(sender, '') AS sender, {q.strip('body')} AS body,
  CASE WHEN id % 4 = 0 THEN '' ELSE concat_ws(' ', CASE WHEN attachment <> '' THEN attachment END,
    CASE WHEN id % 5 = 0 THEN 'b.png' END) END AS attachment
FROM mail WHERE id % 11 <> 0""",
)
def mime_parse(spark, sf_dir):
    return maildrop.split_rejects(maildrop.parse(landed(spark, sf_dir)))[0]


@query(
    "mime_rejects",
    _MIME_SQL + "SELECT id AS pos, 'malformed' AS reject FROM mail WHERE id % 11 = 0",
)
def mime_rejects(spark, sf_dir):
    return maildrop.split_rejects(maildrop.parse(landed(spark, sf_dir)))[1].select("pos", "reject")


def _levels(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def landed_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail whose text lies 0 to 40 parts deep, every seventh level with a file name and a late decoy."""
    d = F.col("id")
    depth = d % 41
    opened = F.transform(
        _levels(depth),
        lambda i: F.concat(
            F.lit('{"mimeType":"multipart/mixed","filename":"'),
            F.when(i % 7 == 0, F.concat(F.lit("f"), i.cast("string"))).otherwise(""),
            F.lit('","parts":['),
        ),
    )
    late = F.concat(F.lit(","), F.to_json(_leaf("text/plain", F.lit("late.txt"), F.lit("too late"))))
    closed = F.transform(F.reverse(_levels(depth)), lambda i: F.concat(F.when(i % 7 == 0, late).otherwise(""), F.lit("]}")))
    leaf = F.to_json(_leaf("text/plain", F.col("attachment"), F.col("body")))
    payload = F.concat(F.array_join(opened, ""), leaf, F.array_join(closed, ""))
    raw = F.concat(F.lit('{"id":"m'), d.cast("string"), F.lit('","payload":'), payload, F.lit("}"))
    return spread(fx.mail(spark, sf_dir), "id").select(d.alias("pos"), raw.alias("raw"))


@query(
    "mime_deep",
    _MIME_SQL
    + f"""SELECT id AS pos, 'm' || id AS gmail_id, {q.strip('body')} AS body, array_to_string(
  list_transform(list_filter(range(1, (id % 41 + 1)::INT), lambda i: i % 7 = 0), lambda i: 'f' || i)
  || CASE WHEN attachment <> '' THEN [attachment] ELSE [] END
  || list_transform(list_filter(range(1, (id % 41 + 1)::INT), lambda i: i % 7 = 0), lambda i: 'late.txt'), ' ') AS attachment
FROM mail""",
)
def mime_deep(spark, sf_dir):
    """Texts and file names found at any depth."""
    mail, _ = maildrop.split_rejects(maildrop.parse(landed_deep(spark, sf_dir)))
    return mail.select("pos", "gmail_id", "body", "attachment")


@query(
    "fetch_recent",
    _MIME_SQL
    + """SELECT id AS pos, 'm' || id AS gmail_id, subject FROM mail
WHERE id IN (SELECT id FROM mail ORDER BY id LIMIT 100) AND id % 11 <> 0 ORDER BY pos""",
)
def fetch_recent(spark, sf_dir):
    """The newest hundred listed mails; those whose response is broken drop out."""
    listing = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"), F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("gmail_id")
    )
    mail, _ = maildrop.fetch_landed(listing, landed(spark, sf_dir))
    return mail.select("pos", "gmail_id", "subject")


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five listings in pages of twenty: the fourth lacks its third page, the fifth's last page leads back."""
    d = F.col("doc_id")
    rows = fx.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("L"), (d % 5).cast("string")).alias("listing"), F.expr("doc_id div 100").alias("page"), d
    )
    ids = F.array_sort(F.collect_list(F.struct("doc_id")))
    pages = rows.groupBy("listing", "page").agg(F.transform(ids, lambda x: F.struct(
        F.concat(F.lit("m"), x["doc_id"].cast("string")).alias("id"))).alias("messages"))
    last = rows.groupBy("listing").agg(F.max("page").alias("last"))

    def token(page: Column) -> Column:
        return F.md5(F.concat_ws("|", "listing", page.cast("string")))

    page = F.col("page")
    after = F.when(page < F.col("last"), token(page + 1)).when(F.col("listing") == "L4", token(F.lit(1)))
    kept = pages.join(last, "listing").filter("NOT (listing = 'L3' AND page = 2)")
    whole = F.struct("listing", F.when(page > 0, token(page)).alias("pageToken"), "messages", after.alias("nextPageToken"))
    return kept.select(F.xxhash64("listing", "page").alias("landed"), F.to_json(whole).alias("raw"))


_PAGES_SQL = """
WITH ids AS (SELECT doc_id, 'L' || doc_id % 5 AS listing, doc_id // 100 AS page FROM documents)
"""


@query(
    "listing_order",
    _PAGES_SQL
    + """SELECT listing, row_number() OVER (PARTITION BY listing ORDER BY doc_id) - 1 AS pos, 'm' || doc_id AS gmail_id
FROM ids WHERE listing IN ('L0', 'L1', 'L2') OR listing = 'L3' AND page < 2""",
)
def listing_order(spark, sf_dir):
    """Ids of paged listings, whose pages come in no order, in theirs."""
    ranked, _ = listings.rank_pages(listings.parse_pages(landed_pages(spark, sf_dir)))
    return listings.listed_ids(ranked)


@query(
    "listing_rejects",
    _PAGES_SQL
    + """, pages AS (SELECT DISTINCT listing, page, CASE WHEN page > 0 THEN md5(listing || '|' || page) ELSE '' END AS token FROM ids)
SELECT listing, token, CASE WHEN listing = 'L4' THEN 'ring' WHEN page = 2 THEN 'page missing' ELSE 'not reached' END AS reject
FROM pages WHERE listing = 'L4' OR listing = 'L3' AND page >= 2""",
)
def listing_rejects(spark, sf_dir):
    """Pages behind a gap, the missing one, and all of a listing that runs into itself."""
    return listings.rank_pages(listings.parse_pages(landed_pages(spark, sf_dir)))[1]


# ---- files and the store ------------------------------------------------------------------
@query(
    "csv_sources",
    f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  CASE WHEN doc_id % 2 = 0 THEN '한국어 "인용", ' || {q.collapse("regexp_replace(text, '[^ -~]', ' ', 'g')")} ELSE text END AS text,
  doc_id % 2 = 0 AS korean_charset FROM documents""",
)
def csv_sources(spark, sf_dir):
    """Documents written as CSV in two encodings with different headers, then read back."""
    docs = fx.table(spark, sf_dir, "documents")
    path = scratch(spark, "csv")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    ascii_text = collapse(F.regexp_replace("text", "[^ -~]", " "))
    korean = docs.filter("doc_id % 2 = 0").select(
        "doc_id", F.concat(F.lit('한국어 "인용", '), ascii_text).alias("내용")
    )
    other = docs.filter("doc_id % 2 = 1").select("text", "doc_id")
    options = {"header": True, "escape": '"'}
    korean.write.options(**options, encoding=csv_files.KOREAN_CHARSET).csv(f"{path}/ko")
    other.write.options(**options).csv(f"{path}/en")
    ko = csv_files.read_csv_any(spark, csv_files.glob_files(spark, f"{path}/ko/*.csv"))
    en = csv_files.read_csv_any(spark, csv_files.glob_files(spark, f"{path}/en/*.csv"))
    return ko.select("doc_id", F.col("내용").alias("text"), F.lit(True).alias("korean_charset")).unionByName(
        en.select("doc_id", "text", F.lit(False).alias("korean_charset"))
    )


@query(
    "corpus_reader",
    fx.with_views(fx.LABELLED_SQL)
    + """SELECT id, label, 'ko' AS lang, text, CASE WHEN label = 'SPAM' THEN 1 ELSE 0 END AS y FROM (
  SELECT id, upper(label) AS label, text FROM labelled WHERE id % 9 <> 4)""",
)
def corpus_reader(spark, sf_dir):
    """A labelled corpus written and read: language defaults to 'ko', rows without a label drop out."""
    path = scratch(spark, "corpus")
    rows = fx.labelled(spark, sf_dir).select(
        "id", F.when(F.col("id") % 9 != 4, F.upper("label")).alias("label"), "text"
    )
    csv_files.write_corpus(rows, path)
    return csv_files.read_corpus(spark, path).select("id", "label", "lang", "text", "y")


@query(
    "optional_source",
    "SELECT 'ham' AS label, text FROM benchmark",
)
def optional_source(spark, sf_dir):
    """A source that is there joined with one that is not."""
    path = scratch(spark, "optional")
    rows = fx.table(spark, sf_dir, "benchmark").select(F.lit("ham").alias("label"), "text")
    csv_files.write_corpus(rows, path, "csv")
    found = csv_files.read_optional(spark, path)
    return found.unionByName(csv_files.read_optional(spark, path + "-absent")).select("label", "text")


@query(
    "store_append",
    fx.with_views(fx.MAIL_SQL, MESSAGES_SQL)
    + f"""SELECT id, source, gmail_id, sender, content, predicted_label, spam_prob, 'v1' AS model_version, actioned,
  strftime(created_at, '{SQL_TS}') AS created_at FROM messages""",
)
def store_append(spark, sf_dir):
    """Messages appended in two writes and read back in the store's shape."""
    store = Store(spark, scratch(spark, "store"))
    rows = messages(spark, sf_dir).drop("subject", "body", "attachment")
    save_predictions(store, rows.filter("id % 2 = 0"))
    save_predictions(store, rows.filter("id % 2 = 1"))
    return store.read("messages").withColumn("created_at", F.date_format("created_at", TS))


@query(
    "store_cast_rejects",
    """SELECT 'user_reports' AS table_name, 'does not cast: created_at' AS reason, doc_id AS id FROM documents WHERE doc_id % 7 = 3
UNION ALL SELECT 'user_reports', 'does not cast: id, created_at', -1 FROM documents WHERE doc_id % 7 = 5
UNION ALL SELECT 'stored', '', doc_id FROM documents WHERE doc_id % 7 NOT IN (3, 5)""",
)
def store_cast_rejects(spark, sf_dir):
    """Reports as texts: what does not cast is kept as rejects, the rest is stored."""
    d = F.col("doc_id")
    rows = fx.table(spark, sf_dir, "documents").select(
        F.when(d % 7 == 5, F.concat(F.lit("no "), d.cast("string"))).otherwise(d.cast("string")).alias("id"),
        F.substring("text", 1, 40).alias("content"),
        F.lit("ham").alias("user_label"),
        F.when(d % 7 == 3, "yesterday").when(d % 7 == 5, "?").when(d % 7 == 4, None).otherwise("2024-02-03 04:05:06").alias("created_at"),
    )
    store = Store(spark, scratch(spark, "store"))
    store.append("user_reports", rows)
    rejects = store.read("rejects").select(
        "table_name", "reason", F.coalesce(F.get_json_object("row", "$.id").try_cast("bigint"), F.lit(-1).cast("bigint")).alias("id")
    )
    return rejects.unionByName(store.read("user_reports").select(F.lit("stored").alias("table_name"), F.lit("").alias("reason"), "id"))


@query(
    "store_reports",
    fx.with_views(fx.MAIL_SQL, MESSAGES_SQL, fx.PICKED_SQL)
    + """SELECT content, 'ham' AS user_label, 'gmail_not_spam' AS note
FROM messages WHERE gmail_id IN (SELECT gmail_id FROM picked) AND content <> ''""",
)
def store_reports(spark, sf_dir):
    store = Store(spark, scratch(spark, "store"))
    reports = mailbox.not_spam_reports(messages(spark, sf_dir), fx.picked_ids(spark, sf_dir))
    store.append("user_reports", reports)
    return store.read("user_reports").select("content", "user_label", "note")


def _trust_snapshots(spark: SparkSession, sf_dir: str) -> Snapshots:
    """The allowlist log in three appends with a snapshot after the first and second; some rows of the first come last."""
    store = Store(spark, scratch(spark, "store"))
    log = fx.trust_log(spark, sf_dir)
    top = log.agg(F.max("id")).first()[0]
    held = (F.col("id") % 50 == 7) & (F.col("id") < top / 3)
    snapshots = Snapshots(store, TRUST)
    store.append("trust_log", log.filter((F.col("id") < top / 3) & ~held))
    snapshots.take()
    store.append("trust_log", log.filter((F.col("id") >= top / 3) & (F.col("id") < 2 * top / 3)))
    snapshots.take()
    store.append("trust_log", log.filter((F.col("id") >= 2 * top / 3) | held))
    return snapshots


@query("trust_snapshot", list_sql("true"))
def trust_snapshot(spark, sf_dir):
    """The allowlist from a snapshot, the rows after it, and rows that came late."""
    return _trust_snapshots(spark, sf_dir).state().withColumn("created_at", F.date_format("created_at", TS))


@query(
    "trust_late_rows",
    fx.with_views(fx.TRUST_LOG_SQL)
    + f"""SELECT lower({q.strip('pattern')}) AS pattern, count(*) AS n FROM trust_log
WHERE id % 50 = 7 AND id < (SELECT max(id) FROM trust_log) / 3 GROUP BY 1""",
)
def trust_late_rows(spark, sf_dir):
    return _trust_snapshots(spark, sf_dir).late()


@query(
    "actions_snapshot",
    fx.with_views(fx.PICKED_SQL)
    + f"""SELECT gmail_id, strftime(TIMESTAMP '2024-01-01 00:00:00'
  + to_minutes(CAST(min(CAST(substr(gmail_id, 2) AS BIGINT) % 7) AS INTEGER)), '{SQL_TS}') AS acted_at FROM picked GROUP BY gmail_id""",
)
def actions_snapshot(spark, sf_dir):
    """First actions on mails, logged in seven appends with repeats, from a snapshot and what follows."""
    store = Store(spark, scratch(spark, "store"))
    number = F.substring("gmail_id", 2, 30).cast("long") % 7
    picked = fx.picked_ids(spark, sf_dir).withColumn("_at", number)
    snapshots = Snapshots(store, ACTIONS)
    for i in range(7):
        at = F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, {i})")
        store.append("action_log", picked.filter(F.col("_at") <= i).select("gmail_id", at.alias("acted_at")))
        if i in (2, 4):
            snapshots.take()
    return snapshots.state().withColumn("acted_at", F.date_format("acted_at", TS))


@query(
    "store_training_run",
    fx.with_views(fx.LABELLED_SQL)
    + """, c AS (SELECT count(*) FILTER (label = 'spam' AND spam_prob >= 0.5) AS tp,
    count(*) FILTER (label <> 'spam' AND spam_prob >= 0.5) AS fp,
    count(*) FILTER (label = 'spam' AND spam_prob < 0.5) AS fn, count(*) AS n FROM labelled)
SELECT v.model_version, v.train_size, v.test_size, (n - fp - fn) / n AS accuracy, tp / (tp + fp) AS precision_val,
  tp / (tp + fn) AS recall_val, 2 * tp / (2 * tp + fp + fn) AS f1_score
FROM c, (VALUES ('v1', 80::INTEGER, 20::INTEGER), ('en-v1-skipped', 8::INTEGER, 2::INTEGER)) AS v(model_version, train_size, test_size)""",
)
def store_training_run(spark, sf_dir):
    """Two training runs logged with the metrics of a scored set, and read back."""
    store = Store(spark, scratch(spark, "store"))
    scores = metrics.metrics(fx.labelled(spark, sf_dir))
    save_run(store, "v1", 80, 20, scores)
    save_run(store, "en-v1-skipped", 8, 2, scores)
    return store.read("training_runs").drop("id", "trained_at")


@query(
    "demo_reader",
    fx.with_views(fx.LABELLED_SQL) + "SELECT label, text, lang FROM labelled WHERE id % 3 = 0",
)
def demo_reader(spark, sf_dir):
    """A demo set written as CSV and read back."""
    path = scratch(spark, "demo")
    csv_files.write_corpus(fx.labelled(spark, sf_dir).filter("id % 3 = 0").select("label", "text", "lang"), path, "csv")
    return csv_files.read_demo(spark, path).select("label", "text", "lang")


@query(
    "vocabulary_saved",
    f"""WITH each AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos
  FROM (SELECT doc_id, {q.tokens('text', 'en')} AS t FROM documents)),
counted AS (SELECT token, count(*) AS n, min(doc_id) AS first_row, arg_min(pos, (doc_id, pos)) AS first_pos FROM each GROUP BY token)
SELECT token, CAST(row_number() OVER (ORDER BY n DESC, first_row, first_pos) + 1 AS INTEGER) AS id
FROM counted WHERE n >= 2 QUALIFY id <= 20001
UNION ALL SELECT '<pad>', 0 UNION ALL SELECT '<unk>', 1""",
)
def vocabulary_saved(spark, sf_dir):
    path = scratch(spark, "vocabulary")
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    save_vocabulary(vocabulary(docs, "en", "doc_id", specials=True), path)
    return load_vocabulary(spark, path)


@query(
    "csv_split_records",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents",
)
def csv_split_records(spark, sf_dir):
    """Whole texts with their line breaks and quotes as CSV, read back in splits of a megabyte."""
    path = scratch(spark, "csv")
    fx.table(spark, sf_dir, "documents").select("doc_id", "text").write.options(header=True, escape='"').csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = csv_files.read_csv_any(spark, csv_files.glob_files(spark, f"{path}/*.csv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return rows.select("doc_id", "text")


# ---- synthetic mail -----------------------------------------------------------------------
_TEMPLATES_SQL = """
templates AS (
  SELECT label, row_number() OVER (PARTITION BY label ORDER BY p_partkey) - 1 AS idx, subject, body FROM (
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'spam' ELSE 'ham' END AS label,
      '{place} ' || p_name AS subject,
      'Hi {name}, ' || p_name || ' ' || p_brand || ' ships on {day} or {day}. {other}' AS body FROM part)),
slots AS (
  SELECT (SELECT list(n_name ORDER BY n_nationkey) FROM nation) AS place,
    (SELECT list(r_name ORDER BY r_regionkey) FROM region) AS name)"""


def _fill_sql(template: str, part: str) -> str:
    row = "CAST(id AS VARCHAR)"
    h = q.seeded(row, f"'{part}'", "CAST(i - 1 AS VARCHAR)")

    def pick(values: str) -> str:
        return f"{values}[1 + {q.number(h, f'len({values})')}]"

    days = "['Monday', 'Friday', 'tomorrow']"
    pieces = f"regexp_extract_all({template}, '\\{{[^{{}}]*\\}}|[^{{}}]+')"
    return (
        f"array_to_string(list_transform({pieces}, lambda p, i: CASE p "
        f"WHEN '{{place}}' THEN {pick('place')} WHEN '{{name}}' THEN {pick('name')} "
        f"WHEN '{{day}}' THEN {pick(days)} ELSE p END), '')"
    )


_ROW = "CAST(id AS VARCHAR)"
_MADE_SQL = f"""
rows AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'spam' ELSE 'ham' END AS label FROM documents),
sized AS (SELECT r.*, (SELECT count(*) FROM templates t WHERE t.label = r.label) AS n FROM rows r),
drawn AS (
  SELECT s.id, s.label, t.subject, t.body, slots.place, slots.name FROM sized s
  JOIN templates t ON t.label = s.label AND t.idx = {q.number(q.seeded(_ROW, "'template'"), 's.n')}, slots),
made AS (
  SELECT id, label,
    {_fill_sql('subject', 'subject')} || ' ' || {_fill_sql('body', 'body')}
    || ['', '', ' 첨부파일 a.pdf', ' 첨부파일 b.exe'][1 + {q.number(q.seeded(_ROW, "'file'"), '4')}]
    || CASE WHEN {q.number(q.seeded(_ROW, "'link'"), '2')} = 0
       THEN ' ' || ['http://bit.ly/a1', 'goo.gl/b2'][1 + {q.number(q.seeded(_ROW, "'which link'"), '2')}] ELSE '' END AS text
  FROM drawn),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS rn FROM made) WHERE rn = 1)"""


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    part = fx.table(spark, sf_dir, "part").select(
        p,
        F.when(p % 3 == 0, "spam").otherwise("ham").alias("label"),
        F.concat(F.lit("{place} "), F.col("p_name")).alias("subject"),
        F.concat(
            F.lit("Hi {name}, "), F.col("p_name"), F.lit(" "), F.col("p_brand"),
            F.lit(" ships on {day} or {day}. {other}"),
        ).alias("body"),
    )
    # p_partkey runs from 0 without gaps, so the number within a label follows from it.
    idx = F.when(p % 3 == 0, F.expr("p_partkey div 3")).otherwise(
        F.expr("p_partkey - 1 - (p_partkey div 3)")
    )
    templates = part.select("label", idx.alias("idx"), "subject", "body")
    nation = fx.table(spark, sf_dir, "nation").agg(
        F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l")
    )
    region = fx.table(spark, sf_dir, "region").agg(
        F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("l")
    )
    places = nation.select(F.transform("l", lambda x: x["n_name"])).scalar()
    names = region.select(F.transform("l", lambda x: x["r_name"])).scalar()
    slots = F.create_map(
        F.lit("place"), places,
        F.lit("name"), names,
        F.lit("day"), F.array(F.lit("Monday"), F.lit("Friday"), F.lit("tomorrow")),
    )
    d = F.col("doc_id")
    rows = fx.table(spark, sf_dir, "documents").select(
        d.alias("id"), F.when(d % 4 == 0, "spam").otherwise("ham").alias("label")
    )
    return augment.augment(
        rows,
        templates,
        slots,
        F.array(F.lit("http://bit.ly/a1"), F.lit("goo.gl/b2")),
        F.array(F.lit(""), F.lit(""), F.lit("a.pdf"), F.lit("b.exe")),
        "id",
    )


_MADE = fx.with_views(_TEMPLATES_SQL, _MADE_SQL)


@query("augment_templates", _MADE + "SELECT id, label, text FROM pool")
def augment_templates(spark, sf_dir):
    return augment.distinct_pool(_made(spark, sf_dir), "id")


@query(
    "augment_demo_split",
    _MADE
    + f""", kept AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {q.seeded(_ROW)}) AS k FROM pool) WHERE k <= 700)
SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {q.seeded("'demo'", _ROW)}) <= 60 AS is_demo FROM kept""",
)
def augment_demo_split(spark, sf_dir):
    pool = cut_lineage(augment.distinct_pool(cut_lineage(_made(spark, sf_dir)), "id", 700))
    return augment.mark_demo(pool, "id").select("id", "label", "is_demo")


_POOL_SQL = """
templates AS (SELECT p_brand AS label, '{place} ' || p_name AS subject, p_name || ' on {day} {other}' AS body FROM part),
spots AS (SELECT DISTINCT r_name AS place FROM region), days AS (SELECT unnest(['Monday', 'Friday']) AS day),
files AS (SELECT unnest(['', ' 첨부파일 a.pdf']) AS file), links AS (SELECT unnest(['', ' http://bit.ly/a1', ' goo.gl/b2']) AS link),
every AS (
  SELECT label, count(DISTINCT replace(subject, '{place}', place) || ' ' || replace(body, '{day}', day) || file || link) AS most
  FROM templates, spots, days, files, links GROUP BY label)
"""


@query(
    "augment_filled",
    "WITH " + _POOL_SQL
    + """SELECT label, CAST(200 + 60 * (ascii(right(label, 1)) % 10) AS BIGINT) AS n,
  least(most, 200 + 60 * (ascii(right(label, 1)) % 10)) AS got FROM every""",
)
def augment_filled(spark, sf_dir):
    """How many distinct texts each brand's templates give of those wanted: all, or all there are."""
    part = fx.table(spark, sf_dir, "part")
    label = F.col("p_brand")
    own = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    templates = part.select(
        label.alias("label"),
        own.cast("long").alias("idx"),
        F.concat(F.lit("{place} "), F.col("p_name")).alias("subject"),
        F.concat(F.col("p_name"), F.lit(" on {day} {other}")).alias("body"),
    )
    region = fx.table(spark, sf_dir, "region").agg(F.collect_set("r_name").alias("l"))
    slots = F.create_map(F.lit("place"), region.select("l").scalar(), F.lit("day"), F.array(F.lit("Monday"), F.lit("Friday")))
    wanted = 200 + 60 * (F.ascii(F.right(F.col("label"), F.lit(1))) % 10)
    quotas = templates.select("label").distinct().select("label", wanted.cast("bigint").alias("n"))
    links = F.array(F.lit("http://bit.ly/a1"), F.lit("goo.gl/b2"))
    pool, _ = augment.filled_pool(quotas, templates, slots, links, F.array(F.lit(""), F.lit("a.pdf")))
    counts = pool.groupBy("label").agg(F.count_distinct("text").alias("got"))
    return quotas.join(counts, "label").select("label", "n", "got")
