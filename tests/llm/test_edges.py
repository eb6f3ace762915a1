"""Missing and repeated ids, columns whose names clash, and empty tables, for operators that give a row for each row."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mailsift.llm import bpe, line_quality, token_counts, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(None, "some text here"), (None, None), (1, "some text here"), (1, "some text here"), (2, ""), (3, "x " * 5000)]
DDL = "doc_id long, text string, y int, score double, weight double, n_tokens long, toxic int, quality int, piece int"


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, 0.5, 2.0, 3, 0, 1, 4) for r in rows], DDL).repartition(2)


def tokens(df):
    return bpe.round_trip(df, PATH)


def edited(df):
    edit = F.struct(F.lit(2).cast("long").alias("position"), F.lit(1).alias("delete"), F.lit("ab ").alias("insert"))
    return token_counts.counted(df.withColumn("edits", F.array(edit)), PATH)


def by_toxicity(df):
    return toxicity.score_texts(df, toxicity.ToxicityModel(b"  some  some  ", b"  some  some  text  text  "))


def by_quality(df):
    return line_quality.score_texts(df, line_quality.LineField())


@pytest.mark.parametrize("operator", [tokens, edited, by_toxicity, by_quality])
def test_a_row_for_each_row(spark, operator):
    got = sorted((tuple(r) for r in operator(table(spark)).collect()), key=str)
    assert sorted(str(r[0]) for r in got) == sorted(str(i) for i, _ in ROWS)
    # Equal texts have equal results, whatever their ids.
    assert len({r[1:] for r in got if r[0] == 1}) == 1
    assert {r[1:] for r in got if r[0] == 1} <= {r[1:] for r in got if r[0] is None}
    assert operator(table(spark, [])).count() == 0


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (line_quality, "quality")])
def test_labels_without_rows_or_ids(spark, module, label):
    docs = table(spark)
    for rows in ([], [(None, 1)], [(1, 1), (1, 0), (2, None), (3, 7), (99, 0)]):
        labels = spark.createDataFrame(rows, f"doc_id long, {label} int")
        model = module.fit(docs, labels)
        scores = module.score_texts(docs, model).collect()
        assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
