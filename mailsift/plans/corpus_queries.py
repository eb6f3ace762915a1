"""Queries that build, balance and split the training corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions.verdict import is_spam
from mailsift.operators import corpus
from mailsift.operators.scaling import cut_lineage, lookup_join
from mailsift.plans import fixtures as fx
from mailsift.plans import sqltext as q
from mailsift.plans.registry import query

LABELLED = fx.with_views(fx.LABELLED_SQL)


@query(
    "corpus_clean",
    f"SELECT doc_id, text FROM (SELECT doc_id, {q.collapse('text')} AS text FROM documents) WHERE length(text) > 5",
)
def corpus_clean(spark, sf_dir):
    return corpus.clean(fx.table(spark, sf_dir, "documents").select("doc_id", "text"))


_NOISY_SQL = """
noisy AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'RETURNED mail: ' || text WHEN doc_id % 17 = 1 THEN '[반송] ' || text
    WHEN doc_id % 19 = 2 THEN text || ' i am Out Of The Office' WHEN doc_id % 6 = 3 THEN '안녕 ' || text ELSE text END AS text
  FROM documents)"""


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = F.col("doc_id"), F.col("text")
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d % 10 == 0, F.concat(F.lit("RETURNED mail: "), t))
        .when(d % 17 == 1, F.concat(F.lit("[반송] "), t))
        .when(d % 19 == 2, F.concat(t, F.lit(" i am Out Of The Office")))
        .when(d % 6 == 3, F.concat(F.lit("안녕 "), t))
        .otherwise(t)
        .alias("text"),
    )


@query(
    "noise_filter",
    fx.with_views(_NOISY_SQL)
    + """SELECT doc_id, regexp_matches(text, '[가-힣]') AS hangul FROM noisy
WHERE NOT regexp_matches(text, '(?i)반송|Returned mail|Auto reply|out of the office')""",
)
def noise_filter(spark, sf_dir):
    rows = corpus.drop_noise(_noisy(spark, sf_dir))
    korean = corpus.only_hangul(rows).select("doc_id", F.lit(True).alias("hangul"))
    return korean.unionByName(
        corpus.without_hangul(rows).select("doc_id", F.lit(False).alias("hangul"))
    )


@query(
    "label_recode",
    """SELECT doc_id, CASE WHEN n = 0 THEN 'ham' WHEN n = 1 THEN 'spam' END AS label,
  CASE WHEN n = 1 THEN 1 ELSE 0 END AS y
FROM (SELECT doc_id, TRY_CAST(code AS DOUBLE) AS n FROM (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unknown' WHEN doc_id % 11 = 0 THEN '2'
    WHEN doc_id % 5 = 0 THEN toxic || '.0' ELSE CAST(toxic AS VARCHAR) END AS code FROM labels))
WHERE n IN (0, 1)""",
)
def label_recode(spark, sf_dir):
    d, toxic = F.col("doc_id"), F.col("toxic").cast("string")
    code = (
        F.when(d % 7 == 0, "unknown")
        .when(d % 11 == 0, "2")
        .when(d % 5 == 0, F.concat(toxic, F.lit(".0")))
        .otherwise(toxic)
    )
    rows = fx.table(spark, sf_dir, "labels").select("doc_id", code.alias("label"))
    return corpus.recode_labels(rows).withColumn("y", is_spam("label"))


@query(
    "longest_text_column",
    """WITH m AS (
  SELECT 'lang' AS column_name, sum(length(COALESCE(lang, 'nan'))) / count(*) AS mean_length FROM documents
  UNION ALL SELECT 'text', sum(length(COALESCE(text, 'nan'))) / count(*) FROM documents
  UNION ALL SELECT 'source', sum(length(COALESCE(source, 'nan'))) / count(*) FROM documents)
SELECT column_name, mean_length, mean_length = max(mean_length) OVER () AS chosen FROM m""",
)
def longest_text_column(spark, sf_dir):
    return corpus.text_lengths(fx.table(spark, sf_dir, "documents").select("lang", "text", "source"))


_SOURCES_SQL = """
sources AS (
  SELECT 0 AS source_no, doc_id AS ord, 'ham' AS label, text FROM documents
  UNION ALL SELECT 1, id, 'spam', '  ' || text || chr(10) FROM labelled
  UNION ALL SELECT 2, conv_id * 1000 + turn, 'spam', CASE WHEN turn % 9 = 4 THEN ' ' ELSE text END FROM conversations)"""


@query(
    "corpus_union_distinct",
    fx.with_views(fx.LABELLED_SQL, _SOURCES_SQL)
    + f"""SELECT label, text, lang FROM (
  SELECT label, text, {q.lang_of('text')} AS lang, row_number() OVER (PARTITION BY text ORDER BY source_no, ord) AS rn
  FROM (SELECT source_no, ord, label, {q.strip('text')} AS text FROM sources) WHERE text <> '')
WHERE rn = 1""",
)
def corpus_union_distinct(spark, sf_dir):
    talk = fx.table(spark, sf_dir, "conversations")
    rows = corpus.union_sources(
        fx.table(spark, sf_dir, "documents").select(
            F.lit(0).alias("source_no"), F.col("doc_id").alias("ord"), F.lit("ham").alias("label"), "text"
        ),
        fx.labelled(spark, sf_dir).select(
            F.lit(1).alias("source_no"),
            F.col("id").alias("ord"),
            F.lit("spam").alias("label"),
            F.concat(F.lit("  "), "text", F.lit("\n")).alias("text"),
        ),
        talk.select(
            F.lit(2).alias("source_no"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
            F.lit("spam").alias("label"),
            F.when(F.col("turn") % 9 == 4, " ").otherwise(F.col("text")).alias("text"),
        ),
    )
    merged = corpus.merge_corpus(rows, [F.col("source_no"), F.col("ord")])
    return merged.select("label", "text", "lang")


_HASH = q.seeded("CAST(id AS VARCHAR)")


@query(
    "class_balance",
    LABELLED
    + f"""SELECT id, label FROM (
  SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH}) AS rn,
    (SELECT least(1000, min(n)) FROM (SELECT count(*) AS n FROM labelled GROUP BY label)) AS quota
  FROM labelled) WHERE rn <= quota""",
)
def class_balance(spark, sf_dir):
    return corpus.balance(fx.labelled(spark, sf_dir).select("id", "label"), "id")


@query(
    "spam_to_ham_count",
    fx.with_views(fx.MAIL_SQL)
    + f"""SELECT id, label FROM (
  SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH}) AS rn,
    (SELECT count(*) FROM mail WHERE predicted_label = 'ham') AS ham
  FROM (SELECT id, CASE WHEN predicted_label = 'ham' THEN 'ham' ELSE 'spam' END AS label FROM mail))
WHERE label = 'ham' OR rn <= ham""",
)
def spam_to_ham_count(spark, sf_dir):
    label = F.when(F.col("predicted_label") == "ham", "ham").otherwise("spam")
    rows = fx.mail(spark, sf_dir).select("id", label.alias("label"))
    return corpus.match_ham_count(rows, "id")


_SPLIT_SQL = f"""
split AS (
  SELECT *, rn <= (n * 20 + 50) // 100 AS is_test FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY {_HASH}) AS rn,
      count(*) OVER (PARTITION BY lang, label) AS n FROM labelled))"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.mark_test(fx.labelled(spark, sf_dir), ["lang", "label"], "id")


@query(
    "split_stratified",
    fx.with_views(fx.LABELLED_SQL, _SPLIT_SQL) + "SELECT id, lang, label, is_test FROM split",
)
def split_stratified(spark, sf_dir):
    return _marked(spark, sf_dir).select("id", "lang", "label", "is_test")


_FEEDBACK_SQL = """
feedback AS (
  SELECT id, user_label AS label, content AS text,
    CASE WHEN regexp_matches(content, '[가-힣]') THEN 'ko' ELSE 'en' END AS lang FROM user_reports),
train AS (
  SELECT id, label, lang, 0 AS copy FROM split WHERE NOT is_test
  UNION ALL SELECT id, label, lang, CAST(c AS INTEGER) FROM feedback, unnest([1, 2, 3, 4, 5]) AS u(c))"""
_TRAIN = fx.with_views(fx.LABELLED_SQL, _SPLIT_SQL, fx.REPORTS_SQL, _FEEDBACK_SQL)


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = fx.user_reports(spark, sf_dir)
    feedback = corpus.union_sources(
        corpus.feedback_rows(reports, "ko"), corpus.feedback_rows(reports, "en")
    )
    side = _marked(spark, sf_dir).filter(~F.col("is_test")).withColumn("y", is_spam("label"))
    columns = ["id", "label", "lang", "y"]
    return corpus.add_feedback(side.select(columns), feedback.select(columns))


@query("feedback_oversample", _TRAIN + "SELECT id, label, lang, copy FROM train")
def feedback_oversample(spark, sf_dir):
    return corpus.oversample(_train(spark, sf_dir), "ko", 1).select("id", "label", "lang", "copy")


@query(
    "language_oversample",
    _TRAIN
    + """SELECT lang, label, CAST(sum(CASE WHEN lang = 'ko' THEN 3 ELSE 1 END) AS BIGINT) AS n
FROM train GROUP BY lang, label""",
)
def language_oversample(spark, sf_dir):
    rows = corpus.oversample(_train(spark, sf_dir), "ko", 3)
    return rows.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "class_weight",
    _TRAIN
    + """SELECT n_pos, n_neg, n_neg / greatest(n_pos, 1) AS pos_weight FROM (
  SELECT count(*) FILTER (label = 'spam') AS n_pos, count(*) FILTER (label <> 'spam') AS n_neg FROM train)""",
)
def class_weight(spark, sf_dir):
    return corpus.class_weight(_train(spark, sf_dir))


@query("shuffle_order", LABELLED + f"SELECT id, {_HASH} AS position_key FROM labelled ORDER BY position_key")
def shuffle_order(spark, sf_dir):
    return corpus.shuffled(fx.labelled(spark, sf_dir).select("id"), "id")


# ---- source recipes over tables -----------------------------------------------------------
_KO_SQL = f"""
spam_raw AS (
  SELECT doc_id AS ord, {q.collapse("CASE WHEN doc_id % 4 = 0 THEN '무료 ' || text WHEN doc_id % 31 = 1 THEN '반송 ' || text ELSE text END")} AS subject,
    CASE doc_id % 3 WHEN 0 THEN 'a.exe' WHEN 1 THEN 'nan' END AS attachment FROM documents),
spam AS (
  SELECT ord, {q.compose_email('subject', 'NULL', 'NULL', 'attachment')} AS text FROM (
    SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ord) AS rn FROM spam_raw
    WHERE length(subject) > 5 AND regexp_matches(subject, '[가-힣]')
      AND NOT regexp_matches(subject, '(?i)반송|Returned mail|Auto reply|out of the office'))
  WHERE rn = 1),
ham AS (
  SELECT ord, text FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY ord) AS rn FROM (
      SELECT conv_id * 1000 + turn AS ord, {q.collapse('text')} AS text FROM conversations)
    WHERE length(text) > 5) WHERE rn = 1),
kept AS (
  SELECT 1 AS source_no, ord, 'spam' AS label, text FROM (
    SELECT *, row_number() OVER (ORDER BY {q.seeded("sha256('spam|' || text)")}) AS rn FROM spam)
  WHERE rn <= (SELECT count(*) FROM ham)
  UNION ALL SELECT 0, ord, 'ham', text FROM ham
  UNION ALL SELECT 2, item_id, CASE WHEN item_id % 2 = 0 THEN 'spam' ELSE 'ham' END, text FROM benchmark)"""


@query(
    "korean_corpus",
    fx.with_views(_KO_SQL)
    + f"""SELECT label, text, {q.lang_of('text')} AS lang FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_no, ord) AS rn
  FROM (SELECT source_no, ord, label, {q.strip('text')} AS text FROM kept) WHERE text <> '') WHERE rn = 1""",
)
def korean_corpus(spark, sf_dir):
    """Spam by column position, ham from the longest text column, synthetic rows last."""
    d, t = F.col("doc_id"), F.col("text")
    spam_raw = fx.table(spark, sf_dir, "documents").select(
        F.lit("2024-12-31").alias("received_on"),
        F.lit("00:00").alias("received_at"),
        F.lit("N").alias("accepted"),
        F.when(d % 4 == 0, F.concat(F.lit("무료 "), t))
        .when(d % 31 == 1, F.concat(F.lit("반송 "), t))
        .otherwise(t)
        .alias("title"),
        F.when(d % 3 == 0, "a.exe").when(d % 3 == 1, "nan").alias("file"),
        d.alias("ord"),
    )
    talk = fx.table(spark, sf_dir, "conversations")
    ham_raw = talk.select("role", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    item = F.col("item_id")
    synthetic = fx.table(spark, sf_dir, "benchmark").select(
        F.when(item % 2 == 0, "spam").otherwise("ham").alias("label"), "text", item.alias("ord")
    )
    return corpus.build_korean(
        corpus.korean_spam_source(spam_raw), corpus.korean_ham_source([ham_raw]), synthetic
    )


_EN_SQL = f"""
raw AS (
  SELECT l.doc_id AS ord, {q.collapse('d.text')} AS text, CASE WHEN l.toxic = 1 THEN 'spam' ELSE 'ham' END AS label
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id % 23 <> 5),
uniq AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY ord) AS rn FROM raw WHERE length(text) > 5)
  WHERE rn = 1),
picked AS (
  SELECT 0 AS source_no, ord, label, text FROM (
    SELECT ord, label, text, row_number() OVER (PARTITION BY label ORDER BY {q.seeded("CAST(ord AS VARCHAR)")}) AS k,
      (SELECT least(1000, min(n)) FROM (SELECT count(*) AS n FROM uniq GROUP BY label)) AS quota FROM uniq)
  WHERE k <= quota
  UNION ALL SELECT 1, item_id, 'ham', text FROM benchmark)"""


@query(
    "english_corpus",
    fx.with_views(_EN_SQL)
    + f"""SELECT label, text FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_no, ord) AS rn
  FROM (SELECT source_no, ord, label, {q.strip('text')} AS text FROM picked) WHERE text <> '') WHERE rn = 1""",
)
def english_corpus(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    d = F.col("doc_id")
    raw = lookup_join(docs, labels, ["doc_id"], "inner").select(
        F.col("text").alias("Body"),
        F.when(d % 23 == 5, "?").otherwise(F.col("toxic").cast("string")).alias("Label"),
        d.alias("ord"),
    )
    synthetic = fx.table(spark, sf_dir, "benchmark").select(
        F.lit("ham").alias("label"), "text", F.col("item_id").alias("ord")
    )
    return corpus.build_english(corpus.english_source(cut_lineage(raw)), synthetic)
