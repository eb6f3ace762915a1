"""Document fingerprints from terms of middling frequency, hashed under several random lexicons.

Terms are lower-cased words. The lexicon keeps those whose share of documents lies in a band (an
inverse-document-frequency band): with at least a share ``LOW`` of the documents each, it has at most
(mean number of distinct terms of a document) / ``LOW`` terms whatever the number of documents, and so
can be a lookup beside every row. Should it be larger than ``LEXICON_ROWS``, the band's lower end is
doubled until it fits. A document's distinct lexicon terms are sorted, and every random subset of the lexicon
gives one hash over the terms it holds. The subsets come in four densities: a dense one tells nearly
equal texts, a sparse one still agrees where half of a long text was changed.

Only DataFrame expressions are used. Texts without a lexicon term (empty and null ones among them)
are hashed over all their terms in every slot. Equal texts have equal fingerprints. Repeated rows get
equal ones each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsift.llm.frames import keyed_texts
from mailsift.llm.outliers import BLANK_RUN, BLANKS, bind
from mailsift.operators.scaling import HashLookup, cut_lineage

# Band of the share of documents a term stands in: idf between ln 10 and ln 200.
LOW, HIGH = 0.005, 0.10
# One term in so many belongs to a subset of each density; 16 subsets of each, one bit of a word each.
DENSITIES = (4, 16, 64, 256)
SUBSETS = 16
# What stands for a subset that holds none of a text's terms.
NONE, NO_DIGITS = -1, "-" * 8
# A density with fewer filled slots than this says little; its agreement counts over so many.
LEAST_SLOTS = 4
LEXICON_ROWS = 200_000


def terms(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    trimmed = F.btrim(F.lower(text), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(trimmed, BLANK_RUN)))


def lexicon(documents: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Terms in the band, each with its hash and its subsets; counts cover all documents."""
    texts = documents.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = texts.count()
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    banded = cut_lineage(counts.filter((F.col("df") >= low * n) & (F.col("df") <= high * n)))
    while banded.filter(F.col("df") >= low * n).count() > LEXICON_ROWS:
        low *= 2
    return banded.filter(F.col("df") >= low * n).select(
        "term", F.struct(F.xxhash64("term").alias("h"), _subsets(F.col("term")).alias("mask")).alias("entry")
    )


def _subsets(term: Column) -> Column:
    """The subsets a term belongs to, as 64 bits: 16 for each density.

    A bit that is set in two random words stands for one term in four, in four words for one in 16,
    and so on.
    """
    words = [F.xxhash64(F.lit(i), term) for i in range(2 * len(DENSITIES))]
    mask = words[0].bitwiseAND(words[1])
    denser = 0
    for d in range(1, len(DENSITIES)):
        denser |= 0xFFFF << (16 * (d - 1))
        both = words[2 * d].bitwiseAND(words[2 * d + 1])
        mask = mask.bitwiseAND(both.bitwiseOR(F.lit(denser)))
    return mask


def _slots(found: Column) -> Column:
    """32-bit hash of each subset's share of the sorted lexicon terms, NONE where it holds none of them."""

    def slot(k: int, entries: Column) -> Column:
        inside = F.filter(entries, lambda e: F.shiftrightunsigned(e["mask"], k).bitwiseAND(F.lit(1)) == 1)
        digest = F.xxhash64(F.lit(k), F.transform(inside, lambda e: e["h"])).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(F.size(inside) == 0, F.lit(NONE).cast("long")).otherwise(digest)

    def density(d: int) -> Column:
        # Few terms are in any sparse subset; look through these only.
        any_bit = F.filter(found, lambda e: F.shiftrightunsigned(e["mask"], 16 * d).bitwiseAND(F.lit(0xFFFF)) != 0)
        return bind(any_bit, lambda x: F.array(*[slot(16 * d + k, x) for k in range(SUBSETS)]))

    return F.concat(*map(density, range(len(DENSITIES))))


class Fingerprinter:
    """Turns a text column into fingerprints by one lexicon: a narrow projection, no join or shuffle."""

    def __init__(self, words: DataFrame):
        self.lookup = HashLookup(words, "term", "entry", max(words.count(), 1))

    def attach(self, df: DataFrame) -> DataFrame:
        return self.lookup.attach(df, "_lexicon")

    def column(self, text: Column) -> Column:
        """Fingerprint of ``text`` in a frame made by ``attach``: an array of slots."""

        def of_terms(t: Column) -> Column:
            known = F.filter(F.transform(t, lambda x: self.lookup.probe(x, "_lexicon")), lambda h: h.isNotNull())
            whole = F.xxhash64(F.sort_array(t)).bitwiseAND(F.lit(0xFFFFFFFF))
            alone = F.array_repeat(whole, len(DENSITIES) * SUBSETS)
            return bind(F.sort_array(known), lambda h: F.when(F.size(h) > 0, _slots(h)).otherwise(alone))

        return bind(terms(text), of_terms)


def digits(slots: Column) -> Column:
    """A fingerprint as one string, eight hex digits a slot."""
    one = lambda x: F.when(x == NONE, F.lit(NO_DIGITS)).otherwise(F.lpad(F.lower(F.hex(x)), 8, "0"))
    return F.array_join(F.transform(slots, one), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the best agreement of two fingerprints over the densities; equal ones have 1.

    For a density, slots that are filled and equal against slots filled in either.
    """

    def both(x: Column, y: Column) -> Column:
        # Two counts in one number: equal and filled in the upper half, filled in either in the lower.
        either = F.when((x != NONE) | (y != NONE), F.lit(1)).otherwise(F.lit(0))
        return F.when((x == y) & (x != NONE), F.lit((1 << 16) + 1)).otherwise(either)

    def ratio(pairs: Column, d: int) -> Column:
        total = F.aggregate(F.slice(pairs, 1 + SUBSETS * d, SUBSETS), F.lit(0), lambda s, x: s + x)
        return bind(total, lambda t: F.shiftright(t, 16) / F.greatest(t.bitwiseAND(F.lit(0xFFFF)), F.lit(LEAST_SLOTS)))

    best = bind(F.zip_with(a, b, both), lambda p: F.greatest(*[ratio(p, d) for d in range(len(DENSITIES))]))
    return F.when(a == b, F.lit(1.0)).otherwise(best)


def next_ids(ids: DataFrame) -> DataFrame:
    """doc_id and next_id, the next larger id (after the largest: the smallest), for distinct ids.

    Ids are dealt by range and looked up within each range; only the first id of every range meets
    in one place.
    """
    ranged = cut_lineage(ids.select("doc_id").distinct().repartitionByRange("doc_id").withColumn("p", F.spark_partition_id()))
    inside = ranged.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("p").orderBy("doc_id")))
    firsts = ranged.groupBy("p").agg(F.min("doc_id").alias("first"))
    row = Window.orderBy("p")  # one row per range
    every = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("p", F.coalesce(F.lead("first").over(row), F.first("first").over(every)).alias("after"))
    return inside.join(F.broadcast(after), "p").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def half_replaced(texts: DataFrame) -> DataFrame:
    """Each row with the text in which the next document's beginning takes the place of the second half.

    ``texts`` has doc_id and text. Of the next id's rows, if it is repeated, the one with the least
    beginning counts. Rows without an id have no next document and lose the half.
    """
    n_chars = F.char_length("text").cast("long")
    half = F.floor(n_chars / 2).cast("int")
    head = F.substr(F.col("text"), F.lit(1), n_chars.cast("int") - half)
    # The same rows on both sides of the join by id, so that Spark shuffles the texts once.
    known = texts.filter(F.col("doc_id").isNotNull())
    ids = cut_lineage(known.groupBy("doc_id").agg(F.max(n_chars).alias("n"), F.count(F.lit(1)).alias("rows")))
    need = next_ids(ids).join(ids, "doc_id").select(
        F.col("doc_id").alias("for_id"), "next_id", F.floor(F.col("n") / 2).cast("int").alias("half")
    )
    need = cut_lineage(need)
    start = F.substr(F.col("text"), F.lit(1), F.col("half")).alias("start")
    starts = known.join(need, known["doc_id"] == need["next_id"]).select("for_id", "next_id", start)
    if ids.filter("rows > 1").limit(1).count():
        starts = starts.groupBy("for_id", "next_id").agg(F.min("start").alias("start"))
    joined = known.join(starts, known["doc_id"] == starts["for_id"], "left").select(
        "doc_id", "text", n_chars.alias("n_chars"), "next_id",
        F.concat(head, F.coalesce(F.substr(F.col("start"), F.lit(1), half), F.lit(""))).alias("edited"),
    )
    unknown = texts.filter(F.col("doc_id").isNull()).select(
        "doc_id", "text", n_chars.alias("n_chars"), F.col("doc_id").alias("next_id"), head.alias("edited")
    )
    return joined.unionByName(unknown)


def compare_with_edits(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their half-replaced versions, and how alike they are.

    A repeated next id counts with the least of its fingerprints.
    """
    texts = keyed_texts(documents, key, text)
    prints = Fingerprinter(lexicon(documents, text))
    rows = prints.attach(half_replaced(texts)).select(
        "doc_id", "next_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        prints.column(F.col("text")).alias("fingerprint"),
        prints.column(F.col("edited")).alias("edited_fingerprint"),
    )
    rows = cut_lineage(rows)
    nexts = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.min("fingerprint").alias("after"))
    return rows.join(nexts, rows["next_id"] == nexts["_id"], "left").select(
        "doc_id", "n_chars", "edited_sha256",
        digits(F.col("fingerprint")).alias("fingerprint"),
        digits(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("after")), F.lit(0.0)).alias("near_next"),
    )
