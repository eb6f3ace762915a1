"""The operators over their whole tables, as registered queries, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import (
    bpe,
    chunks,
    collisions,
    conversations,
    imatch,
    line_quality,
    outliers,
    packing,
    sharding,
    shingle_join,
    spelling,
    token_counts,
    toxicity,
)
from mailsift.llm.frames import keyed_texts, table
from mailsift.llm.labelled import remainder

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, length=2048, end_id=0)


def _judged(scores: DataFrame, modulus: int, held: int, least: float) -> DataFrame:
    """Scores with the contract's split and decision."""
    held_out = (remainder(F.col("doc_id"), modulus) == held).alias("held_out")
    return scores.select("doc_id", held_out, "score", (F.col("score") >= least).cast("int").alias("predicted"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return _judged(toxicity.score_texts(docs, toxicity_model(spark, docs, sf_dir)), 3, 1, toxicity.REJECT_FROM)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards with numbers of rows at most one apart."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    model = line_quality.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return _judged(line_quality.score_texts(docs, model), 5, 0, 0.3)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds."""
    found = chunks.deduplicated(table(spark, sf_dir, "documents"))
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return found.select("row.doc_id", "row.text", "n_chunks", "n_duplicate_chunks", cut.alias("n_removed_chars"), "removed")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after two edits drawn from its own text.

    In the middle 12 characters give way to the first 24 of the text; at a fifth its last 7 are put in.
    """
    docs = keyed_texts(table(spark, sf_dir, "documents"))
    n = F.char_length("text")

    def edit(position, delete, insert):
        return F.struct(position.cast("long").alias("position"), F.lit(delete).alias("delete"), insert.alias("insert"))

    middle = edit(F.floor(n / 2), 12, F.substring("text", 1, 24))
    fifth = edit(F.floor(n / 5), 0, F.substring("text", -7, 7))
    return token_counts.counted(docs.withColumn("edits", F.array(middle, fifth)), VOCABULARY)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, and of it with half its text replaced by the next one's."""
    return imatch.compare_with_edits(table(spark, sf_dir, "documents"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingle sets are alike by 85 % or more."""
    return shingle_join.linked_components(table(spark, sf_dir, "documents"), width=4, percent=85)


OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    return outliers.judged(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut short, repeated or given to the user, by a checksum.

    A null is one space, also in the checksum's text.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("_h") == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" ")))
    marked = rows.select("conv_id", "turn", "role", "text", (F.crc32(key) % 20).alias("_h")).filter("_h <> 0")
    copies = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("_copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every damaged conversation."""
    given = table(spark, sf_dir, "conversations")
    found = conversations.repair(damaged(given))
    hashed = conversations.digests(found.conversations(), F.concat("role", F.lit(":"), "text"))
    report = found.report().withColumn("repaired_sha256", F.lit(None).cast("string"))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def without_rows(df: DataFrame, sha: Column) -> DataFrame:
        zeros = [F.lit(0).cast("long").alias(c) for c in numbers]
        return df.select("conv_id", *zeros, F.lit("").alias("audit"), sha.alias("repaired_sha256"))

    whole = conversations.merged(
        report, without_rows(hashed, F.col("sha256")), without_rows(given.select("conv_id").distinct(), F.lit(None).cast("string"))
    )
    return whole.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(k))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), hashed AS (
  SELECT keyed.*, xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 20 AS h
  FROM keyed, crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE h <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS r
  FROM hurt
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' 
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair
  FROM placed
), ins(st, nx, c, a, o) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
    (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])
), moves(st, r, a, nx, c, nr) AS (
  SELECT st, r, 'D', st, 3, NULL::VARCHAR FROM range(4) AS s(st), unnest(['s', 'u', 'a', '?']) AS q(r)
  UNION ALL VALUES (0, 's', 'K', 1, 0, NULL), (0, 'u', 'K', 2, 0, NULL), (1, 'u', 'K', 2, 0, NULL),
    (2, 'a', 'K', 3, 0, NULL), (3, 'u', 'K', 2, 0, NULL)
  UNION ALL SELECT st, r, 'R', CASE WHEN st = 2 THEN 3 ELSE 2 END, 2, CASE WHEN st = 2 THEN 'assistant' ELSE 'user' END
  FROM range(4) AS s(st), unnest(['s', 'u', 'a', '?']) AS q(r)
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0::BIGINT AS st, {'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]} AS best FROM marked
  UNION ALL
  SELECT w.conv_id, w.i + 1, m.nx::BIGINT, min({
    'c': w.best.c + n.c + m.c + CASE WHEN m.a <> 'D' AND d.fault = 'truncated' THEN 1 ELSE 0 END,
    'a': w.best.a || n.a || m.a,
    'o': w.best.o || n.o || CASE WHEN m.a = 'D' THEN [] ELSE [coalesce(m.nr, d.role) || ':' || d.text] END})
  FROM walk w JOIN marked d ON d.conv_id = w.conv_id AND d.i = w.i + 1
  JOIN ins n ON n.st = w.st
  JOIN moves m ON m.st = n.nx AND m.r = d.r AND (m.a = 'D' OR d.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.conv_id, w.i + 1, m.nx
), sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), best AS (
  SELECT w.conv_id, min({'c': w.best.c + n.c, 'a': w.best.a || n.a, 'o': w.best.o || n.o}) AS b
  FROM walk w JOIN sums USING (conv_id) JOIN ins n ON n.st = w.st
  WHERE w.i = sums.n AND n.nx IN (0, 3) GROUP BY w.conv_id
)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
  coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN sums USING (conv_id) LEFT JOIN best USING (conv_id)
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, one run in 97 misspelt, with their near words, forms and roots."""
    return spelling.grouped(spelling.counted_words(table(spark, sf_dir, "documents")))


OP12_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(k))
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
      string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END))),
    lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS h
  FROM runs, crc
), w AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END
    AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5
), holes AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM w, unnest(range(length(word))) AS u(i)
), pairs AS (
  SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM holes a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM holes a JOIN w b ON a.rest = b.word
), best AS (
  SELECT p.word, count(*) AS n_near, min({'less': -o.n, 'form': p.other}) AS best
  FROM pairs p JOIN w o ON o.word = p.other GROUP BY p.word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -best.less >= 2 * w.n THEN best.form END AS form, CASE WHEN -best.less >= 2 * w.n THEN -best.less END AS form_n
  FROM w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON f.word = walk.next
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    return collisions.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_bpe": op7_bpe,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_shingle_join": op9_shingle_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_nearest_vectors": op13_nearest_vectors,
}
SQL: dict[str, str] = {
    "op9_shingle_join": OP9_SQL.strip(),
    "op11_conversation_repair": OP11_SQL.strip(),
    "op12_spelling_variants": OP12_SQL.strip(),
}
