"""All pairs of documents with nearly the same set of word shingles, as components.

The universe of shingles is dealt into segments by hash, as many as two sets that are alike enough can
differ in shingles, and one more. Two such sets then agree in at least one whole segment (pigeonhole).
Sets meet by size band: each is indexed among its own band and the one below, with as many segments as
that pair of bands needs.

What a set is indexed by is a matter of cost. A size that leaves slack may skip as many segments; the
ones with fewest shingles, which tell least, are skipped. A segment left with one shingle or none is
not used alone but together with its neighbour's one-deletion neighbourhood: if two alike sets agree
in such segments only, then in one of the neighbours they differ by one shingle at most, or the sum of
differences were too large. So no pair is lost.

Candidates are verified by the texts themselves, first against the partner a set shares most segments
with, then against the first set of each other component it meets, at last every remaining pair of
different components that share a segment. Sets already in one component need no further check.
Equal sets are one representative throughout. Where many sets of different components share one
segment, the last step makes no rows of their pairs: the sets such segments tie together are dealt to
blocks, and every two blocks are compared inside one task, which returns only links between components.

Null and empty texts and texts without a word have an empty set and are linked with nothing; with
fewer than ``width`` words the whole sequence is one shingle. Rows without an id get no component.
Rows that repeat an id are one document: linked to what any of them is linked to. An empty table gives
an empty result. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsift.llm.frames import keyed_texts, map_rows, struct_of
from mailsift.operators.scaling import BROADCAST_ROWS, cut_lineage, first_by, lookup_join

WIDTH, PERCENT = 4, 85
# Segments with this many shingles or fewer are only used with their neighbour's deletions.
THIN = 1
# A segment shared by more sets than this is compared by blocks; sets in a block.
CROWD, BLOCK = 32, 300

U = np.uint64
_RANDOM = np.random.default_rng(99)
BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]  # A-Z count as a-z
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BYTE[BLANK] = 0
STEP = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (one to one)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x5851F42D4C957F2D, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes that are not blanks."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    word = ~BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    starts_of = starts[np.maximum(np.cumsum(first) - 1, 0)]
    place = np.arange(len(data)) - starts_of
    place[~word] = 0
    longest = 1 << int(place.max() + 1).bit_length()
    return mix(np.add.reduceat(BYTE[data] * _powers(longest)[place], starts))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = word_hashes(np.frombuffer(text.encode(), dtype=np.uint8))
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    h = words[: n - k + 1] + U(k)
    for i in range(1, k):
        h = mix(h * STEP + words[i : n - k + 1 + i])
    return np.unique(mix(h + U(k)))


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Bands:
    """Size bands and the number of segments for each pair of neighbouring bands.

    Alike sets of sizes x <= y have 100 x >= percent y, and differ in at most
    (100 - percent) (x + y) / (100 + percent) shingles.
    """

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1, 2]
        self.num, self.den = 100 - percent, 100 + percent

    def _grow(self, size: int) -> None:
        while self.starts[-3 if len(self.starts) > 2 else 0] <= size:
            last = self.starts[-1]
            # The largest size alike to one below ``last`` falls into the next band at most.
            self.starts.append(max(last + 1, (last - 1) * 100 // self.percent + 1))

    def band(self, size: int) -> int:
        self._grow(size)
        return bisect_right(self.starts, size) - 1

    def _largest(self, band: int) -> tuple[int, int]:
        """Largest sizes of the lower and the upper set of a pair in this band's space."""
        low = self.starts[band + 1] - 1
        return low, min(self.starts[band + 2] - 1, low * 100 // self.percent)

    def segments(self, band: int) -> int:
        low, high = self._largest(band)
        return self.num * (low + max(low, high)) // self.den + 1

    def skips(self, band: int, size: int, upper: bool) -> int:
        """Segments that a set of this size may leave out: half of what its worst pair has to spare."""
        low, _ = self._largest(band)
        partner = min(size, low) if upper else max(size, min(size * 100 // self.percent, self.starts[band + 2] - 1))
        spare = (self.segments(band) - 1) * self.den - self.num * (size + partner)
        return max(spare // (2 * self.den), 0)


@cache
def bands(percent: int) -> Bands:
    return Bands(percent)


def signatures(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Index keys of a set: two sets that are alike share at least one."""
    plan, size = bands(percent), len(tokens)
    own = plan.band(size)
    out = []
    value = mix(tokens + STEP)
    low, high = (value & U(0xFFFFFFFF)).astype(np.float64), (value >> U(32)).astype(np.float64)
    for band in (own, own - 1) if own else (own,):
        m = plan.segments(band)
        salt = U((band * 0x632BE59BD9B4E019 + 1) & (2**64 - 1))
        place = ((mix(tokens ^ salt) >> U(32)) * U(m) >> U(32)).astype(np.int64)
        count = np.bincount(place, minlength=m)
        # Sums of token values by segment, exact in two halves.
        total = np.bincount(place, weights=low, minlength=m).astype(np.uint64)
        total += np.bincount(place, weights=high, minlength=m).astype(np.uint64) << U(32)
        skip = plan.skips(band, size, band != own)
        used = np.ones(m, dtype=bool)
        if skip:
            used[np.argsort(count, kind="stable")[:skip]] = False
        tag = mix(np.arange(m, dtype=np.uint64) * STEP + salt)
        keys = mix(total * STEP + tag)
        out.append(keys[used & (count > THIN)])
        for i in np.flatnonzero(used & (count <= THIN)).tolist():
            j = (i + 1) % m
            near = np.append(total[j] - value[place == j], total[j])
            out.append(mix((near ^ mix(keys[i : i + 1] + U(7))) * STEP + tag[j]))
    return np.concatenate(out).view(np.int64)


def facts(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, size and 128-bit digest of each row's set (null digest if empty)."""

    def rows(slices):
        for part in slices:
            out = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                s = shingles(text, width)
                d = [int(mix(s + U(k)).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for k in (11, 12)]
                out.append((doc_id, len(s), *d))
            yield out

    return map_rows(texts, rows, "doc_id long, n_shingles long, d1 long, d2 long")


def index_rows(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, doc): the index keys of each different set of a partition, under the first id that has it."""
    schema = struct_of("sig long, doc long")

    def run(batches):
        known: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, ids = [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingles(text, width)
                    if len(s):
                        mark = mix(s + U(11)).sum(dtype=np.uint64).tobytes() + mix(s + U(12)).sum(dtype=np.uint64).tobytes()
                        if mark not in known:
                            known.add(mark)
                            sig = signatures(s, percent)
                            keys.append(sig)
                            ids.append(np.full(len(sig), doc_id, dtype=np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["sig", "doc"])

    return texts.filter("doc_id is not null").mapInArrow(run, schema)


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt out by its keys, never broadcast.

    Tables of pairs, copies, sizes and labels grow with the input. A broadcast of one, which Spark may choose
    anew for each of the many joins here, passes the driver; dealt out they leave nothing there.
    """
    return df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node it is connected with) for undirected edges (a, b)."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        there = labels.select(F.col("node").alias("b"), F.col("comp").alias("c"))
        least = both.join(_dealt(there), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        joined = labels.join(_dealt(least), "node").select("node", "comp", F.least("comp", "c").alias("c"))
        # Jump: take over the component of the node that names one's own.
        jump = labels.select(F.col("node").alias("c"), F.col("comp").alias("cc"))
        new = cut_lineage(joined.join(_dealt(jump), "c", "left").select("node", "comp", F.least("c", "cc").alias("new")))
        changed = new.filter("new <> comp").limit(1).count()
        labels = new.select("node", F.col("new").alias("comp"))
        if not changed:
            return labels


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts are alike; ``texts`` has doc and text."""
    right = pairs.join(_dealt(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))), "b")
    both = right.join(_dealt(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))), "a")

    def run(batches):
        last, mine = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b, text_a, text_b = (part.column(i).to_pylist() for i in range(4))
                keep = []
                for x, y, s, t in zip(a, b, text_a, text_b, strict=True):
                    if x != last:
                        last, mine = x, shingles(s, width)
                    if alike(mine, shingles(t, width), percent):
                        keep.append((x, y))
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep, strict=True)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, struct_of("a long, b long"))


def spanning_links(ids: list[int], comps: list[int], sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between different components that join all which links join; ``side`` 0 against 1, 2 with all.

    Common shingles are counted by products of presence matrices, some thousand shingles at a time.
    """
    n = len(sets)
    token, place = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(n), [len(x) for x in sets])
    often = np.bincount(place, minlength=len(token)) > 1
    column = np.cumsum(often) - 1
    use = often[place]
    doc, column = doc[use], column[place[use]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    common = np.zeros((n, n), dtype=np.float32)
    width = 4096
    for at in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        present = np.zeros((n, width), dtype=np.float32)
        present[doc[a:b], column[a:b] - at] = 1
        common += present @ present.T
    size = np.array([len(x) for x in sets])
    both = np.rint(common).astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    comp, part = np.array(comps), np.array(side)
    linked &= comp[:, None] != comp[None, :]
    linked &= (part[:, None] != part[None, :]) | (part[:, None] == 2)
    top = {c: c for c in comps}

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked))), strict=True):
        a, b = find(comps[i]), find(comps[j])
        if a != b:
            top[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return out


def links_in_crowds(crowded: DataFrame, bodies: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components among sets (sig, doc, c) that share a crowded segment."""
    # Groups of components that a crowded segment ties together; far fewer than their sets.
    heads = crowded.groupBy("sig").agg(F.min("c").alias("a"))
    ties = crowded.join(heads, "sig").filter("a <> c").select("a", F.col("c").alias("b")).distinct()
    groups = components(ties)
    member = crowded.select("doc", "c").distinct().join(_dealt(groups), F.col("c") == F.col("node")).select("doc", "c", "comp")
    member = cut_lineage(member)
    sizes = member.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = member.join(_dealt(sizes), "comp").withColumn("mine", F.pmod(F.xxhash64(F.lit(8), "doc"), F.col("blocks")).cast("int"))
    # A set takes part in as many comparisons as its group has blocks.
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("doc", "c", "comp", "mine", others).select(
        "doc", "c", "comp",
        F.least("mine", "other").alias("lo"),
        F.greatest("mine", "other").alias("hi"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    schema = struct_of("a long, b long")

    def compare(group: pa.Table) -> pa.Table:
        g = group.to_pydict()
        # Rows of one block against another: the pairs inside a block are another task's.
        sets = [shingles(t, width) for t in g["text"]]
        links = spanning_links(g["doc"], g["c"], sets, g["side"], percent) if len(set(g["c"])) > 1 else []
        return pa.table({k: pa.array([x[i] for x in links], pa.int64()) for i, k in enumerate("ab")})

    return dealt.join(_dealt(bodies), "doc").groupBy("comp", "lo", "hi").applyInArrow(compare, schema)


def linked_components(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    texts = keyed_texts(documents, key, text)
    known = cut_lineage(facts(texts, width))
    sets = known.filter("doc_id is not null and d1 is not null")
    # A representative for each different set; ids that repeat with different sets are tied by edges.
    reps = sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = sets.join(reps.filter("n > 1"), ["d1", "d2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    copies = cut_lineage(copies.filter("a <> b").distinct())
    size = sets.groupBy(F.col("doc_id").alias("doc")).agg(F.max("n_shingles").alias("most"), F.min("n_shingles").alias("least"))

    index = index_rows(texts, width, percent)
    w = Window.partitionBy("sig").orderBy("doc")
    met = index.select("sig", "doc", F.first("doc").over(w).alias("head"), F.lead("doc").over(w).alias("after"))
    met = met.filter((F.col("head") != F.col("doc")) | (F.col("after") != F.col("doc"))).select("sig", "doc", "head")
    # From here on only sets that share a key with another document's.
    met = cut_lineage(met)
    rep = copies.select(F.col("b").alias("doc"), F.col("a").alias("rep"))

    def by_rep(pairs: DataFrame) -> DataFrame:
        """Pairs of representatives that can be alike by size, each once, with its number of rows."""
        a = pairs.join(_dealt(rep.select(F.col("doc").alias("x"), F.col("rep").alias("rx"))), "x", "left")
        a = a.join(_dealt(rep.select(F.col("doc").alias("y"), F.col("rep").alias("ry"))), "y", "left")
        a = a.select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"), "n")
        a = a.filter("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("n").alias("n"))
        a = a.join(_dealt(size.select(F.col("doc").alias("a"), F.col("most").alias("ma"), F.col("least").alias("la"))), "a")
        a = a.join(_dealt(size.select(F.col("doc").alias("b"), F.col("most").alias("mb"), F.col("least").alias("lb"))), "b")
        fits = (100 * F.col("ma") >= percent * F.col("lb")) & (100 * F.col("mb") >= percent * F.col("la"))
        return a.filter(fits).select("a", "b", "n")

    stars = met.filter("head <> doc").groupBy(F.col("head").alias("x"), F.col("doc").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    stars = cut_lineage(by_rep(stars))
    # Texts of the sets that may take part in a pair; of an id with several, each is tried.
    wanted = met.select(F.col("doc").alias("d")).distinct().join(_dealt(rep.select(F.col("doc").alias("d"), "rep")), "d", "left")
    wanted = cut_lineage(wanted.select(F.coalesce("rep", "d").alias("doc_id")).distinct())
    small = wanted.count() <= BROADCAST_ROWS
    bodies = texts.join(F.broadcast(wanted) if small else wanted, "doc_id", "left_semi")
    bodies = cut_lineage(bodies.select(F.col("doc_id").alias("doc"), "text").distinct())

    # First the partner a set shares most keys with.
    best = Window.partitionBy("b").orderBy(F.desc("n"), "a")
    first = stars.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("a", "b")
    tried = cut_lineage(first)
    edges = cut_lineage(copies.unionByName(verified(tried, bodies, width, percent)))
    labels = components(edges)

    def of(df: DataFrame, column: str, name: str) -> DataFrame:
        """Adds the component of a node; a node without edges is its own."""
        at = labels.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
        joined = df.join(_dealt(at), df[column] == at["_node"], "left")
        return joined.withColumn(name, F.coalesce("_comp", column)).drop("_node", "_comp")

    # Then one set of each other component that a star meets, then all that is left.
    for step in ("stars", "all"):
        if step == "stars":
            todo = stars.select("a", "b")
        else:
            node = met.select("sig", "doc").join(_dealt(rep), "doc", "left").select("sig", F.coalesce("rep", "doc").alias("doc")).distinct()
            node = of(node, "doc", "c")
            several = node.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k"))
            node = cut_lineage(node.join(several.filter("lo <> hi").select("sig", "k"), "sig"))
            crowded = node.filter(F.col("k") > CROWD).select("sig", "doc", "c")
            if crowded.limit(1).count():
                edges = cut_lineage(edges.unionByName(links_in_crowds(crowded, bodies, width, percent)))
                labels = components(edges)
            node = node.filter(F.col("k") <= CROWD)
            x = node.select("sig", F.col("doc").alias("x"), F.col("c").alias("cx"))
            y = node.select("sig", F.col("doc").alias("y"), F.col("c").alias("cy"))
            todo = x.join(_dealt(y), "sig").filter("cx <> cy and x < y").select("x", "y").distinct().withColumn("n", F.lit(1))
            todo = by_rep(todo).select("a", "b")
        todo = of(of(todo, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
        todo = cut_lineage(todo.join(_dealt(tried), ["a", "b"], "left_anti"))
        if not todo.limit(1).count():
            continue
        tried = tried.unionByName(todo)
        found = cut_lineage(verified(todo, bodies, width, percent))
        if found.limit(1).count():
            edges = edges.unionByName(found)
            labels = components(edges)
    out = of(known.select("doc_id", "n_shingles"), "doc_id", "component_id")
    return out.select("doc_id", "n_shingles", "component_id")


def _sequence(text: str) -> Column:
    """Digest of a text's words in order; null without a word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate(F.col(text).cast("string"), upper, lower), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.md5(F.array_join(words, " ")))


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each group, with all its columns: of the smallest id of each component one row.

    Rows that repeat an id stay once for each different sequence of words. Rows without an id are not
    compared shingle by shingle: of those with the same words one stays, and none if a row with an id
    has these words. Rows without a word all stay.
    """
    found = linked_components(documents, key, text, width, percent)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = documents.join(gone, documents[key] == gone["_gone"], "left_anti")
    odd = documents.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | F.col(key).isNull())
    odd = cut_lineage(odd.select(key))
    if not odd.limit(1).count():
        return kept
    repeated = odd.filter(F.col(key).isNotNull())
    single = lookup_join(kept.filter(F.col(key).isNotNull()), repeated, [key], "left_anti")
    many = lookup_join(kept.filter(F.col(key).isNotNull()), repeated, [key], "left_semi")
    many = many.unionByName(kept.filter(F.col(key).isNull())).withColumn("_words", _sequence(text))
    # A group is cut to one row in each task before it is shuffled.
    firsts = first_by(many.filter("_words IS NOT NULL"), [key, "_words"], [F.lit(1)])
    of_others = documents.filter(F.col(key).isNotNull()).select(_sequence(text).alias("_words")).dropna().distinct()
    nameless = firsts.filter(F.col(key).isNull()).join(of_others, "_words", "left_anti")
    rest = many.filter("_words IS NULL").unionByName(firsts.filter(F.col(key).isNotNull())).unionByName(nameless)
    return single.select(*documents.columns).unionByName(rest.select(*documents.columns))
