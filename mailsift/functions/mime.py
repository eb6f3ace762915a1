"""Mail payload parsing inside one row: no explode, no regrouping by message.

A message is a tree of parts of any depth. One pass reads DEPTH levels and keeps what lies below as the
JSON it was; ``deepened`` reads the next levels of that, and so on until nothing is left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.functions.text import strip

# Levels of nested parts that one pass reads.
DEPTH = 8


def _part(level: int) -> T.StructType:
    # The innermost level keeps its parts as raw text, for the next pass.
    parts = T.ArrayType(_part(level + 1)) if level < DEPTH else T.StringType()
    fields = [
        T.StructField("mimeType", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("body", T.StructType([T.StructField("data", T.StringType())])),
        T.StructField("parts", parts),
    ]
    if level == 0:
        header = [T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]
        fields.append(T.StructField("headers", T.ArrayType(T.StructType(header))))
    return T.StructType(fields)


MESSAGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("payload", _part(0)),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def parse_message(raw: Column | str) -> Column:
    """JSON text to the message struct; ``_corrupt`` holds text that does not parse."""
    return F.from_json(raw, MESSAGE, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})


def header(headers: Column, name: str) -> Column:
    """Value of the first header of that name in any letter case, else ''."""
    hit = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.get(hit, F.lit(0))["value"], F.lit(""))


def _empty_like(array: Column) -> Column:
    return F.slice(array, 1, 0)


def walk(part: Column, level: int = 0) -> Column:
    """The parts of the tree in pre-order as (mime, filename, data, rest).

    ``rest`` is the JSON of the parts below the innermost level; they follow right behind their parent.
    """
    parts = part["parts"]
    rest = F.lit(None).cast("string")
    if level == DEPTH:
        rest = F.when(~F.trim(parts).isin("", "[]", "null"), parts)
    here = F.array(
        F.struct(
            part["mimeType"].alias("mime"),
            part["filename"].alias("filename"),
            part["body"]["data"].alias("data"),
            rest.alias("rest"),
        )
    )
    if level == DEPTH:
        return here
    below = F.flatten(F.transform(parts, lambda p: walk(p, level + 1)))
    return F.concat(here, F.coalesce(below, _empty_like(here)))


def unfinished(parts: Column) -> Column:
    """True when some part has a rest to be read."""
    return F.coalesce(F.exists(parts, lambda p: p["rest"].isNotNull()), F.lit(False))


def deepened(parts: Column) -> Column:
    """The parts with each rest replaced by the parts it holds, DEPTH levels further down."""
    below = T.ArrayType(_part(1))

    def opened(p: Column) -> Column:
        here = F.array(F.struct(p["mime"].alias("mime"), p["filename"].alias("filename"), p["data"].alias("data"),
                                F.lit(None).cast("string").alias("rest")))
        found = F.flatten(F.transform(F.from_json(p["rest"], below), lambda q: walk(q, 1)))
        return F.concat(here, F.coalesce(found, _empty_like(here)))

    return F.flatten(F.transform(parts, opened))


def decode_texts(data: Column) -> Column:
    """An array of URL-safe base64 to texts; bytes that are not UTF-8 are dropped.

    Null stands for base64 that cannot be decoded. Each step is a pass of its own over the array,
    so nothing is evaluated twice.
    """
    digits = F.transform(data, lambda d: F.translate(d, "-_", "+/"))
    raw = F.transform(
        digits,
        lambda d: F.coalesce(
            F.try_to_binary(d, F.lit("base64")),
            F.try_to_binary(F.regexp_replace(d, "[^A-Za-z0-9+/]", ""), F.lit("base64")),
        ),
    )
    texts = F.transform(raw, lambda b: b.cast("string"))
    return F.transform(texts, lambda t: F.when(F.is_valid_utf8(t), t).otherwise(_drop_broken_bytes(t)))


def _drop_broken_bytes(text: Column) -> Column:
    # A replacement character that was in the mail is held aside while broken bytes are removed.
    held = F.replace(text, F.lit("\ufffd"), F.lit("\ufdd0"))
    cleaned = F.replace(F.make_valid_utf8(held), F.lit("\ufffd"), F.lit(""))
    return F.replace(cleaned, F.lit("\ufdd0"), F.lit("\ufffd"))


def body_candidates(parts: Column, top_data: Column) -> Column:
    """Encoded bodies in the order they are tried: text/plain parts, then the top-level body."""
    plain = F.filter(parts, lambda p: p["mime"] == "text/plain")
    data = F.concat(F.transform(plain, lambda p: p["data"]), F.array(top_data))
    return F.filter(data, lambda d: d != "")


def first_text(texts: Column) -> Column:
    """Struct of the first decoded body that is not empty: ``broken`` when it did not decode."""
    hits = F.filter(texts, lambda t: t.isNull() | (t != ""))
    return F.struct(
        ((F.size(hits) > 0) & F.get(hits, F.lit(0)).isNull()).alias("broken"),
        strip(F.coalesce(F.get(hits, F.lit(0)), F.lit(""))).alias("text"),
    )


def attachment_names(parts: Column) -> Column:
    """File names in pre-order joined by a space."""
    names = F.filter(F.transform(parts, lambda p: p["filename"]), lambda n: n != "")
    return F.array_join(names, " ")
