"""Table schemas, label domains and the constants that decide results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They must equal the studied classifier's for equal results.
BINARY_THRESHOLD = 0.5
REVIEW_LOW = 0.4
SPAM_HIGH = 0.7
KO_MAX_LEN = 250
EN_MAX_LEN = 300
MIN_FREQ = 2
KO_VOCAB_SIZE = 10_000
EN_VOCAB_SIZE = 20_000
PAD_TOKEN, PAD_ID = "<pad>", 0
UNK_TOKEN, UNK_ID = "<unk>", 1
FEEDBACK_COPIES = 5
TEST_SHARE = 0.2
SEED = 42
EN_PER_CLASS = 1000
RETRAIN_THRESHOLD = 5
MAX_F1_DROP = 0.02
MAX_BACKUPS = 3
PAGE_SIZE = 10
FETCH_SIZE = 100
MIN_TEXT_LEN = 5
VERSION_KO = "v1"
VERSION_EN = "v1-en"
RUN_VERSION = {"ko": "v1", "en": "en-v1"}
SKIPPED_SUFFIX = "-skipped"

TIER_LABELS = ("ham", "review", "spam")
REPORT_LABELS = ("ham", "spam")

MESSAGES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("gmail_id", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("predicted_label", T.StringType()),
        T.StructField("spam_prob", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("actioned", T.IntegerType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)
MESSAGE_DEFAULTS = {"source": "manual", "model_version": VERSION_KO, "actioned": 0}

TRAINING_RUNS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("train_size", T.IntegerType()),
        T.StructField("test_size", T.IntegerType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision_val", T.DoubleType()),
        T.StructField("recall_val", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
        T.StructField("trained_at", T.TimestampNTZType()),
    ]
)

USER_REPORTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("user_label", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

TRUSTED_SENDERS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

CORPUS = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
    ]
)

VOCABULARY = T.StructType(
    [T.StructField("token", T.StringType()), T.StructField("id", T.IntegerType())]
)

# One row per change of a model: kind is 'deploy' or 'backup'.
REGISTRY = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("backup_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("logged_at", T.TimestampNTZType()),
    ]
)


def conform(
    df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None
) -> DataFrame:
    """Bring ``df`` to ``schema``: add absent columns, fill defaults, cast and reorder.

    Applying it twice changes nothing. A value that does not cast becomes null; ``failed_casts`` finds such rows.
    """
    defaults = defaults or {}
    out = []
    for field in schema.fields:
        col = F.col(field.name).try_cast(field.dataType) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            col = F.coalesce(col, F.lit(defaults[field.name]))
        out.append(col.cast(field.dataType).alias(field.name))
    return df.select(*out)


_WIDER = {
    T.ByteType: (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType),
    T.ShortType: (T.IntegerType, T.LongType, T.FloatType, T.DoubleType),
    T.IntegerType: (T.LongType, T.DoubleType),
    T.LongType: (T.DoubleType,),
    T.FloatType: (T.DoubleType,),
    T.TimestampType: (T.TimestampNTZType,),
    T.TimestampNTZType: (T.TimestampType,),
    T.DateType: (T.TimestampType, T.TimestampNTZType),
}


def _may_fail(have: T.DataType, want: T.DataType) -> bool:
    safe = have == want or isinstance(want, T.StringType) or isinstance(have, T.NullType)
    return not safe and not isinstance(want, _WIDER.get(type(have), ()))


def failed_casts(df: DataFrame, schema: T.StructType) -> Column | None:
    """Names of the columns whose value is there but does not cast, joined by commas; '' when all do.

    None when no column's type can fail, so that nothing need be looked at.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    risky = [f for f in schema.fields if f.name in have and _may_fail(have[f.name], f.dataType)]
    if not risky:
        return None
    lost = [F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull() for f in risky]
    return F.concat_ws(", ", *[F.when(bad, f.name) for bad, f in zip(lost, risky, strict=True)])


def in_domain(column: str, allowed: Sequence[str]) -> Column:
    """True where a label is one of the allowed values; null labels are not."""
    return F.coalesce(F.col(column).isin(*allowed), F.lit(False))


def split_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, reject rows) by label domain."""
    ok = in_domain(column, allowed)
    return df.filter(ok), df.filter(~ok)
