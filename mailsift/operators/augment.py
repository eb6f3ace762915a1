"""Synthetic mail from templates: each row picks a template and fills its slots by seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.text import compose_email
from mailsift.operators.corpus import distinct_texts
from mailsift.operators.scaling import cut_lineage, hash_number, lookup_join, mark_smallest, seeded_hash
from mailsift.schema import SEED

SLOT = r"\{[^{}]*\}|[^{}]+"


def fill(template: Column, slots: Column, row: Column, part: str, seed: int = SEED) -> Column:
    """Replace each ``{name}`` by a value of that slot; every occurrence draws anew.

    ``slots`` is a small map from name to values. An unknown name stays as written.
    """
    pieces = F.regexp_extract_all(template, F.lit(f"({SLOT})"), F.lit(1))

    def piece(p: Column, i: Column) -> Column:
        values = F.element_at(slots, F.regexp_replace(p, r"[{}]", ""))
        draw = hash_number(seeded_hash(seed, row, F.lit(part), i), F.size(values))
        return F.when(p.startswith("{") & values.isNotNull(), F.get(values, draw.cast("int"))).otherwise(p)

    return F.array_join(F.transform(pieces, piece), "")


def draw_templates(rows: DataFrame, templates: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Give each row (key, label) one template of its label.

    ``templates`` has label, idx (0, 1, ... per label), subject, body. Draws are uniform, so the
    join key is even; a long template table is shuffled instead of broadcast.
    """
    sizes = templates.groupBy("label").agg(F.count(F.lit(1)).alias("_size"))
    drawn = lookup_join(rows, sizes, ["label"], "inner").withColumn(
        "idx", hash_number(seeded_hash(seed, key, F.lit("template")), F.col("_size"))
    )
    return lookup_join(drawn.drop("_size"), templates, ["label", "idx"], "inner")


def _some(values: str) -> Column:
    """Size of an array, 1 for an empty one, of which nothing can be drawn."""
    return F.greatest(F.size(values), F.lit(1))


def augment(
    rows: DataFrame,
    templates: DataFrame,
    slots: Column,
    links: Column,
    attachments: Column,
    key: str,
    seed: int = SEED,
) -> DataFrame:
    """label, text per row: subject and body filled, attachment drawn, a link on about half.

    ``links`` and ``attachments`` are array columns; an empty attachment means none. Whether a
    link is added does not depend on the label.
    """
    k = F.col(key)
    drawn = draw_templates(rows, templates, key, seed).withColumns(
        {"_slots": slots, "_links": links, "_files": attachments}
    )
    file_no = hash_number(seeded_hash(seed, k, F.lit("file")), _some("_files")).cast("int")
    link_no = hash_number(seeded_hash(seed, k, F.lit("which link")), _some("_links")).cast("int")
    linked = hash_number(seeded_hash(seed, k, F.lit("link")), 2) == 0
    text = compose_email(
        fill(F.col("subject"), F.col("_slots"), k, "subject", seed),
        F.lit(None).cast("string"),
        fill(F.col("body"), F.col("_slots"), k, "body", seed),
        F.get("_files", file_no),
    )
    link = F.when(linked, F.get("_links", link_no))
    return drawn.select(key, "label", F.concat_ws(" ", text, link).alias("text"))


def distinct_pool(made: DataFrame, key: str, n: int | None = None, seed: int = SEED) -> DataFrame:
    """Distinct texts, per label at most ``n`` of them."""
    pool = distinct_texts(made, [F.col(key)])
    if n is None:
        return pool
    marked = mark_smallest(
        pool, ["label"], seeded_hash(seed, key), lambda s: s.withColumn("quota", F.lit(n).cast("bigint"))
    )
    return marked.filter("selected").drop("selected")


def mark_demo(pool: DataFrame, key: str, n_demo: int = 60, seed: int = SEED) -> DataFrame:
    """Mark ``n_demo`` rows of each label as demo; the others are for training."""
    return mark_smallest(
        pool,
        ["label"],
        seeded_hash(seed, F.lit("demo"), key),
        lambda s: s.withColumn("quota", F.lit(n_demo).cast("bigint")),
        "is_demo",
    )


# ---- pools of an exact size ---------------------------------------------------------------
# Draws of one generated row, and texts beyond which a template's space is not told apart.
CHUNK = 10_000
ENDLESS = 1 << 60
# A space of up to this many times the wanted texts is gone through instead of drawn from.
SMALL_SPACE = 4
# Of the texts a round draws for, the part below which drawing has become hopeless.
LEAST_YIELD = 0.1


def _pieces(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(f"({SLOT})"), F.lit(1))


def _values(slots: Column, piece: Column) -> Column:
    """Distinct values of the slot a piece names, null for plain text and unknown names."""
    known = F.element_at(slots, F.regexp_replace(piece, r"[{}]", ""))
    return F.when(piece.startswith("{"), F.array_distinct(known))


def _times(a: Column, b: Column) -> Column:
    """The product of two long numbers, ENDLESS at most."""
    b = F.greatest(b.cast("long"), F.lit(1).cast("long"))
    return F.when(a > F.floor(F.lit(ENDLESS) / b), F.lit(ENDLESS)).otherwise(a * b)


def _ways(template: Column, slots: Column) -> Column:
    one = F.lit(1).cast("long")
    return F.aggregate(_pieces(template), one, lambda a, p: _times(a, F.coalesce(F.size(_values(slots, p)), F.lit(1))))


def _filled_at(template: Column, slots: Column, number: Column) -> Column:
    """(text, rest): slots filled by the digits of a number in mixed radix, and what is left of it."""
    start = F.struct(F.lit("").alias("text"), number.alias("rest"))

    def step(acc: Column, piece: Column) -> Column:
        values = _values(slots, piece)
        n = F.greatest(F.size(values), F.lit(1))
        drawn = F.get(values, (acc["rest"] % n).cast("int"))
        hit = drawn.isNotNull()
        return F.struct(
            F.concat(acc["text"], F.when(hit, drawn).otherwise(piece)).alias("text"),
            F.when(hit, F.floor(acc["rest"] / n).cast("long")).otherwise(acc["rest"]).alias("rest"),
        )

    return F.aggregate(_pieces(template), start, step)


def with_space(templates: DataFrame, slots: Column, links: Column, attachments: Column) -> DataFrame:
    """Add ``space``, how many ways a template can be filled, and the distinct values as columns."""
    valued = templates.withColumns(
        {"_slots": slots, "_links": F.array_distinct(links), "_files": F.array_distinct(attachments)}
    )
    ways = _times(_ways(F.col("subject"), F.col("_slots")), _ways(F.col("body"), F.col("_slots")))
    return valued.withColumn("space", _times(_times(ways, F.size("_files")), F.size("_links") + 1))


def _numbered(df: DataFrame, n: Column, name: str) -> DataFrame:
    """``df`` with a row for each number below ``n``, made in chunks that all tasks share."""
    chunks = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / CHUNK), F.lit(1)) - 1)
    dealt = df.withColumn("_n", n).withColumn("_chunk", F.explode(chunks)).filter("_n > 0")
    cores = df.sparkSession.sparkContext.defaultParallelism
    low = F.col("_chunk") * CHUNK
    high = F.least(low + CHUNK, F.col("_n")) - 1
    return dealt.repartition(cores).withColumn(name, F.explode(F.sequence(low, high))).drop("_n", "_chunk")


def all_texts(templates: DataFrame, slots: Column, links: Column, attachments: Column) -> DataFrame:
    """label and text of every way to fill every template; equal texts are not merged."""
    spaced = with_space(templates, slots, links, attachments)
    row = _numbered(spaced, F.col("space"), "_no")
    row = row.withColumn("_subject", _filled_at(F.col("subject"), F.col("_slots"), F.col("_no")))
    row = row.withColumn("_body", _filled_at(F.col("body"), F.col("_slots"), F.col("_subject.rest")))
    files, links_ = _some("_files"), F.size("_links") + 1
    rest = F.col("_body.rest")
    file = F.get("_files", (rest % files).cast("int"))
    link_no = (F.floor(rest / files) % links_).cast("int")
    text = compose_email(F.col("_subject.text"), F.lit(None).cast("string"), F.col("_body.text"), file)
    # The last number stands for no link.
    return row.select("label", F.concat_ws(" ", text, F.get("_links", link_no)).alias("text"))


def filled_pool(
    quotas: DataFrame, templates: DataFrame, slots: Column, links: Column, attachments: Column, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """(pool, report): exactly ``n`` distinct texts of each label of ``quotas`` (label, n), or all there are.

    Texts are drawn, those the pool has already drop out, and what is missing is drawn again. A label
    whose templates have few more fillings than wanted, or whose draws bring too little new, is gone
    through filling by filling, so its count is the exact maximum. The pool has label and text; the report
    label, n, got and space. A label without templates gets nothing.
    """
    few = templates.select("label", "idx", "subject", "body")
    spaces = with_space(few, slots, links, attachments).groupBy("label").agg(
        F.least(F.sum(F.col("space").cast("double")), F.lit(float(ENDLESS))).cast("long").alias("space")
    )
    wanted = cut_lineage(
        quotas.select("label", F.col("n").cast("long").alias("n")).join(spaces, "label", "left").na.fill(0, ["space"])
    )
    texts = wanted.sparkSession.createDataFrame([], "label string, text string")
    pool, number, before = cut_lineage(texts), 0, None
    through = wanted.select("label").limit(0)
    while True:
        got = pool.groupBy("label").agg(F.count(F.lit(1)).alias("got"))
        state = wanted.join(got, "label", "left").na.fill(0, ["got"]).join(through, "label", "left_anti")
        state = state.withColumn("missing", F.col("n") - F.col("got")).filter("missing > 0 AND space > 0")
        if before is not None:
            state = state.join(before, "label", "left")
            stuck = F.col("got") - F.col("_got") < LEAST_YIELD * F.col("_missing")
        else:
            stuck = F.lit(False)
        state = cut_lineage(
            state.select(*wanted.columns, "got", "missing", F.coalesce((F.col("space") <= SMALL_SPACE * F.col("n")) | stuck, F.lit(False)).alias("all"))
        )
        if state.limit(1).count() == 0:
            break
        ended = state.filter("all").select("label")
        whole = all_texts(few.join(ended, "label", "left_semi"), slots, links, attachments)
        rows = _numbered(state.filter("NOT all").select("label", "missing"), F.col("missing") * 2, "_no")
        rows = rows.select("label", F.concat_ws("|", F.lit(number).cast("string"), "label", F.col("_no").cast("string")).alias("_key"))
        drawn = augment(rows, few, slots, links, attachments, "_key", seed).select("label", "text")
        pool = cut_lineage(pool.unionByName(whole).unionByName(drawn).distinct())
        through = cut_lineage(through.unionByName(ended))
        before = state.select("label", F.col("got").alias("_got"), F.col("missing").alias("_missing"))
        number += 1
    chosen = mark_smallest(
        cut_lineage(pool), ["label"], seeded_hash(seed, "label", "text"), lambda s: s.join(wanted.select("label", F.col("n").alias("quota")), "label")
    )
    kept = cut_lineage(chosen.filter("selected").select("label", "text"))
    counts = kept.groupBy("label").agg(F.count(F.lit(1)).alias("got"))
    report = wanted.join(counts, "label", "left").select("label", "n", F.coalesce("got", F.lit(0)).alias("got"), "space")
    return kept, report
