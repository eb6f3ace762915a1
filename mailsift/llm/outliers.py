"""Quality rules: documents whose statistics lie far from the bulk of their language and source.

Each text gives counts (words, characters in words, symbols, repeated lines, words in repeated
three-word windows). Texts that fail the plain limits go. The others become vectors of transformed
ratios; per language and source a minimum-covariance-determinant estimate gives a centre and a scatter
that junk cannot pull, and rows with a large Mahalanobis distance go. The estimate starts from several
fixed parts of the rows; each goes through concentration steps (keep the three quarters of the rows
nearest to the present centre, estimate again) until its determinant falls no further, and the one with
the least determinant holds.

Everything is DataFrame expressions: counting stays inside the row, estimates are sums by group, and
quantiles come from counted distance classes, so that a source with most of the rows is no heavier
than its share. Groups with fewer than ``MIN_ROWS`` rows take the estimate of their language, languages
with fewer that of all rows, and if even these are fewer, only the plain limits decide.

A null text has no words and fails. Null languages and sources form groups of their own. Repeated rows
count each. An empty table gives an empty result. Window repeats are found by 64-bit hashes of three
words, compared within one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsift.operators.scaling import BROADCAST_ROWS, cut_lineage, first_by

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_ROWS = 100
# A start's steps end when they lessen the logarithm of its determinant by no more than this, as a rule
# after some five; STEPS only ends rounding that goes to and fro.
LEAST_GAIN, STEPS = 1e-3, 50
# Share of rows an estimate rests on, and the factor that makes it hold for normal data of 4 columns.
HALF = 0.75
CONSISTENCY = 1.485
# Least standard deviation of each column: clean texts have no symbols or repeats at all, and an
# estimate of nought there would make one stray symbol an outlier.
FLOOR = (0.05, 0.15, 0.30, 0.30)
# Squared distance that one in 10,000 normal vectors of 4 columns exceeds.
CUTOFF = 23.51
CLASSES_PER_DOUBLING = 32

X = ("x1", "x2", "x3", "x4")
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array, the first included."""

    def of_windows(hashes: Column) -> Column:
        def covered(order: Column) -> Column:
            def again(e: Column, k: Column) -> Column:
                before, after = F.get(order, k - 1)["h"], F.get(order, k + 1)["h"]
                return ((k > 0) & (before == e["h"])) | F.coalesce(after == e["h"], F.lit(False))

            places = F.sort_array(F.transform(F.filter(order, again), lambda e: e["i"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
            return F.aggregate(
                places,
                start,
                lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
                lambda a: a["n"],
            )

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            bind(pairs, covered)
        )

    places = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(bind(windows, of_windows))


def statistics(documents: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The documents' columns (as struct ``row``, if asked with the text) and their counts, in one pass."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.btrim(whole, F.lit(BLANKS))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeat_words(words).alias("n_repeat_words"),
        )

    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))
    dup_lines = bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    others = [F.col(f"`{c}`") for c in documents.columns if keep_text or c != text]
    return documents.select(
        F.struct(*others).alias("row"),
        bind(words, of_words).alias("w"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        dup_lines.alias("n_dup_lines"),
    ).select("row", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vectors() -> dict[str, Column]:
    """Transformed ratios: mean word length, symbols, repeated lines and repeated words per word."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x2": F.log1p(10 * F.col("n_symbols") / n),
        "x3": F.sqrt(10 * F.col("n_dup_lines") / n),
        "x4": F.sqrt(F.col("n_repeat_words") / n),
    }


def _estimates(rows: DataFrame) -> DataFrame:
    """Centre and Cholesky factor of the scatter by ``g``, with ``n``; sums only."""
    sums = [F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(X))]
    sums += [F.avg(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS]
    out = rows.groupBy("g").agg(*sums)
    for i, j in PAIRS:
        cov = (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
        if i == j:
            cov = F.greatest(cov, F.lit(0.0)) + FLOOR[i] ** 2
        for k in range(j):
            cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        # What is left of a diagonal entry is at least its floor, up to rounding.
        cell = F.sqrt(F.greatest(cov, F.lit(FLOOR[i] ** 2 / 2))) if i == j else cov / F.col(f"l{j}{j}")
        out = out.withColumn(f"l{i}{j}", cell)
    return out.select("g", "n", *(f"m{i}" for i in range(4)), *(f"l{i}{j}" for i, j in PAIRS))


def _by_group(rows: DataFrame, groups: DataFrame, small: bool, how: str = "inner", on: tuple = ("g",)) -> DataFrame:
    """Join a table with one row per group: broadcast if the groups were counted and are few."""
    return rows.join(F.broadcast(groups) if small else groups, list(on), how)


def _with_distance(rows: DataFrame, estimates: DataFrame, small: bool) -> DataFrame:
    """Squared Mahalanobis distance ``d`` by forward substitution."""
    out = _by_group(rows, estimates, small, "left")
    for i in range(4):
        z = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    distance = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, 4)), F.col("z0") * F.col("z0"))
    return out.withColumn("d", distance).select(*rows.columns, "d")


def _nearest(rows: DataFrame, small: bool) -> DataFrame:
    """The ``HALF`` of each group with the least ``d`` (all of the distance class that holds the cut)."""
    d_class = F.floor(F.log2(F.col("d") + 1e-9) * CLASSES_PER_DOUBLING).cast("int")
    classed = rows.withColumn("c", d_class)
    counts = classed.groupBy("g", "c").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("g")
    run = counts.select("g", "c", "k", F.sum("k").over(w.orderBy("c")).alias("cum"), F.sum("k").over(w).alias("n"))
    edge = run.filter(F.col("cum") >= HALF * F.col("n")).groupBy("g").agg(F.min("c").alias("edge"))
    return _by_group(classed, edge, small).filter(F.col("c") <= F.col("edge")).drop("c", "edge")


def _log_determinant() -> Column:
    return sum((2 * F.log(f"l{i}{i}") for i in range(1, 4)), 2 * F.log("l00"))


def _starts(rows: DataFrame, small: bool) -> DataFrame:
    """First estimates, the start's number before the group in ``g``.

    0: all rows; 1: those without symbols and repeated lines; 2: those with no more than the mean of
    symbols, repeated lines and repeated words. The last two count where they are half of a group or more.
    """
    whole = _estimates(rows)
    n = whole.select("g", F.col("n").alias("_n"))
    clean = _estimates(rows.filter((F.col("x2") == 0) & (F.col("x3") == 0)))
    means = whole.select("g", *(F.col(f"m{i}").alias(f"_m{i}") for i in (1, 2, 3)))
    mild = _by_group(rows, means, small).filter("x2 <= _m1 AND x3 <= _m2 AND x4 <= _m3").select("g", *X)
    out = whole.withColumn("g", F.concat(F.lit("0"), "g"))
    for number, part in ((1, clean), (2, _estimates(mild))):
        enough = _by_group(part, n, small).filter(2 * F.col("n") >= F.col("_n")).drop("_n")
        out = out.unionByName(enough.withColumn("g", F.concat(F.lit(str(number)), "g")))
    return out


def robust_estimates(rows: DataFrame, small: bool) -> DataFrame:
    """Of each ``g`` the estimate of least determinant over all starts and steps."""
    each = rows.select(F.explode(F.array(*[F.concat(F.lit(s), "g") for s in "012"])).alias("g"), *X)
    now, best, before = cut_lineage(_starts(rows, small)), None, None
    for _ in range(STEPS):
        active = _by_group(each, now.select("g"), small, "left_semi")
        step = _estimates(_nearest(_with_distance(active, now, small), small)).withColumn("_det", _log_determinant())
        now = cut_lineage(step)
        best = now if best is None else best.unionByName(now)
        if before is not None:
            last = before.select("g", F.col("_det").alias("_last"))
            now = _by_group(now, last, small).filter(F.col("_det") < F.col("_last") - LEAST_GAIN).drop("_last")
            if not now.limit(1).count():
                break
        before = now
    found = best.withColumns({"_start": F.substring("g", 1, 1), "g": F.expr("substring(g, 2)")})
    # A row for each start and step of a group.
    return first_by(found, ["g"], [F.asc("_det"), F.asc("_start")]).drop("_det", "_start")


def judged(
    documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = False
) -> DataFrame:
    """Counts, base_failed, distance and kept for every row; the documents' columns are in ``row``.

    With ``keep_text`` the whole rows are written beside their counts, and no join by id is needed
    to filter them; the passes that estimate read only the counts.
    """
    counts = cut_lineage(statistics(documents, text, keep_text))
    names = {c.lower() for c in documents.columns}

    def key(column: str) -> Column:
        if column.lower() not in names:
            return F.lit("")
        value = F.col(f"row.`{column}`").cast("string")
        return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("="), value))

    by_lang = F.concat(F.lit("l"), key(lang))
    by_source = F.concat(F.lit("s"), F.sha2(F.concat_ws("\x00", key(lang), key(source)), 256))
    rows = counts.filter(~base_failed()).select(
        by_source.alias("s"), by_lang.alias("l"), *(c.alias(n) for n, c in vectors().items())
    )
    # Each group's level: its own rows if they are enough, else its language, else all.
    sizes = rows.groupBy("l", "s").agg(F.count(F.lit(1)).alias("n"))
    by_l = Window.partitionBy("l")
    level = (
        F.when(F.col("n") >= MIN_ROWS, F.col("s"))
        .when(F.sum("n").over(by_l) >= MIN_ROWS, F.col("l"))
        .otherwise(F.lit("all"))
    )
    levels = cut_lineage(sizes.select("l", "s", level.alias("g")))
    # Three starts make three rows of a group.
    small = levels.count() <= BROADCAST_ROWS // 4
    used = levels.select("g").distinct()
    every = rows.select(F.explode(F.array("s", "l", F.lit("all"))).alias("g"), *X)
    estimates = robust_estimates(cut_lineage(_by_group(every, used, small, "left_semi")), small)
    enough = estimates.filter(F.col("n") >= HALF * MIN_ROWS).drop("n")
    full = counts.withColumns({"s": by_source, "l": by_lang, **vectors()})
    measured = _with_distance(_by_group(full, levels, small, "left", ("l", "s")), enough, small)
    failed = base_failed()
    kept = ~failed & F.coalesce(F.col("d") <= CUTOFF, F.lit(True))
    return measured.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), kept.alias("kept"), F.col("d").alias("distance"),
    )


def filter_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with their columns."""
    return judged(documents, text, keep_text=True).filter("kept").select("row.*")
