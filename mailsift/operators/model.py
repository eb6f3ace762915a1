"""One weighted classifier per language with Spark ML, and routed scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions.text import tokens
from mailsift.functions.verdict import to_binary, to_tier
from mailsift.operators.corpus import class_weight, feedback_rows, mark_test
from mailsift.operators.features import counted_tokens, counted_vectors, text_vectors, token_counts, vocabulary
from mailsift.operators.metrics import metrics, metrics_by_lang
from mailsift.operators.scaling import cut_lineage, hash_number, lookup_join, seeded_hash, spread
from mailsift.schema import FEEDBACK_COPIES, SEED


@dataclass(frozen=True)
class Recipe:
    """What a model sees: token counts and, with ``grams``, runs of so many tokens, hashed."""

    grams: tuple[int, ...] = ()
    reg: float = 0.01
    buckets: int = 1 << 14


BAG = Recipe()
# Runs of tokens tell their order, as a reader of sequences does; one is chosen by folds.
ORDERED = (BAG, Recipe((2,)), Recipe((2, 3)))


@dataclass
class LanguageModel:
    """A fitted pipeline for one language."""

    lang: str
    pipeline: PipelineModel

    def score(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """Add ``spam_prob``; a narrow pass over the rows."""
        stages = self.pipeline.stages
        if any(isinstance(s, NGram) for s in stages):
            rows_in = rows.withColumn("_tokens", tokens(text, self.lang))
        else:
            rows_in = rows.withColumn("_counts", text_vectors(text, self.lang, stages[0].vocabulary))
        scored = _transformed(stages, rows_in)
        kept = [c for c in rows.columns if c != "spam_prob"]
        return scored.select(*kept, vector_to_array("_probability")[1].alias("spam_prob"))

    def weights(self) -> tuple[DataFrame, float]:
        """(token and weight, intercept) of a model of token counts: what a token adds to the score's logit."""
        counts, *between, regression = self.pipeline.stages
        if len(between) != 1:
            raise ValueError("hashed runs of tokens have no tokens to name")
        idf = between[0].idf.toArray()
        rows = zip(counts.vocabulary, (regression.coefficients.toArray() * idf).tolist(), strict=True)
        return SparkSession.active().createDataFrame(list(rows), "token string, weight double"), regression.intercept

    def save(self, path: str) -> None:
        """Write once to a new folder; the registry log points at it."""
        self.pipeline.save(path)

    @classmethod
    def load(cls, lang: str, path: str) -> LanguageModel:
        return cls(lang, PipelineModel.load(path))


def score_by_weights(rows: DataFrame, weights: DataFrame, intercepts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Add ``spam_prob`` from stored weights instead of a pipeline; ``key`` is unique in ``rows``.

    ``weights`` has lang, token, weight, ``intercepts`` lang, intercept. Rows of all languages are scored
    in one pass; a row whose language has no intercept gets null. Tokens are counted in their row before
    they meet the weights, and what is summed per row lies in one task already.
    """
    lang = F.col("lang")
    per = F.when(lang == "ko", tokens(text, "ko")).otherwise(tokens(text, "en"))
    each = rows.select(key, "lang", F.explode(per).alias("token")).groupBy(key, "lang", "token").agg(F.count(F.lit(1)).alias("_n"))
    met = lookup_join(each, weights, ["lang", "token"], "inner")
    sums = met.groupBy(key).agg(F.sum(F.col("_n") * F.col("weight")).alias("_sum"))
    logit = F.coalesce("_sum", F.lit(0.0)) + F.col("intercept")
    joined = lookup_join(rows, intercepts, ["lang"], "left").join(sums, key, "left")
    kept = [c for c in rows.columns if c != "spam_prob"]
    return joined.select(*kept, (1 / (1 + F.exp(-logit))).alias("spam_prob"))


def tokenized(train: DataFrame, lang: str) -> DataFrame:
    """Training rows with their tokens, written: what follows reads tokens, never texts."""
    rows = spread(train.select("ord", "text", "y", "copies"), "ord").withColumn("_tokens", tokens("text", lang))
    return cut_lineage(rows.drop("text"))


def counted_rows(train: DataFrame, lang: str) -> DataFrame:
    """Training rows with each of their tokens once, in ``_words``, and how often, in ``_times``; written.

    All that counts of tokens need; runs of tokens need the rows of ``tokenized``.
    """
    rows = spread(train.select("ord", "text", "y", "copies"), "ord").withColumn("_found", counted_tokens("text", lang))
    kept = [F.col("_found.words").alias("_words"), F.col("_found.times").alias("_times")]
    return cut_lineage(rows.select("ord", "y", "copies", *kept))


def known_words(train: DataFrame, lang: str, counts: DataFrame | None = None) -> list[str]:
    """The vocabulary of the rows' tokens, in order of its ids; bounded by its size limit."""
    words = "_tokens"
    if "_words" in train.columns:
        words = "_words"
        counts = token_counts(train, lang, "ord", "copies", words, times="_times") if counts is None else counts
    vocab = vocabulary(train, lang, "ord", copies="copies", words=words, counts=counts)
    return [r["token"] for r in vocab.orderBy("id").collect()]


def _counter(words: Sequence[str], column: str = "_counts") -> CountVectorizerModel:
    return CountVectorizerModel.from_vocabulary(words, inputCol="_tokens", outputCol=column)


def _hashed(n: int, buckets: int) -> str:
    return f"_hashed{n}_{buckets}"


def _run_stages(recipe: Recipe) -> list:
    """What makes a recipe's hashed runs of tokens; none for token counts alone."""
    out = []
    for n in recipe.grams:
        runs = f"_grams{n}_{recipe.buckets}"
        out.append(NGram(n=n, inputCol="_tokens", outputCol=runs))
        out.append(HashingTF(numFeatures=recipe.buckets, inputCol=runs, outputCol=_hashed(n, recipe.buckets)))
    return out


def _transformed(stages: Sequence, rows: DataFrame) -> DataFrame:
    """``rows`` through those stages whose output they do not hold yet."""
    held = {s for s in stages if s.hasParam("outputCol") and s.getOutputCol() in rows.columns}
    # Runs of tokens serve their hashes only.
    held |= {a for a, b in zip(stages, stages[1:]) if isinstance(a, NGram) and b in held}
    return PipelineModel([s for s in stages if s not in held]).transform(rows)


def fit(
    train: DataFrame, lang: str, max_iter: int = 30, recipe: Recipe = BAG, words: Sequence[str] | None = None
) -> LanguageModel:
    """Fit on rows with ord, y, copies and text, or what ``tokenized`` or ``counted_rows`` makes of it.

    The vocabulary is of these rows only, spam rows are weighted. The vocabulary is bounded by its size
    limit; it and the coefficients are the only data that pass the driver. Tokens are counted once and the
    counts written, as the fit reads them again and again; rows that hold ``_counts`` by ``words`` are taken
    as they are.
    """
    counted_before = words is not None and "_counts" in train.columns
    if words is None:
        if not {"_tokens", "_words"} & set(train.columns):
            train = (tokenized if recipe.grams else counted_rows)(train, lang)
        words = known_words(train, lang)
        if "_words" in train.columns:
            train = train.withColumn("_counts", counted_vectors("_words", "_times", words))
    weight = class_weight(train, F.col("copies")).first()["pos_weight"]
    stages = [_counter(words), *_run_stages(recipe)]
    counted = "_counts"
    if recipe.grams:
        parts = ["_counts", *[_hashed(n, recipe.buckets) for n in recipe.grams]]
        stages.append(VectorAssembler(inputCols=parts, outputCol="_joined"))
        counted = "_joined"
    rows = train.withColumn("_w", F.col("copies") * F.when(F.col("y") == 1, weight).otherwise(1.0))
    rows = _transformed(stages, rows).select("y", "_w", counted)
    if not counted_before:
        rows = cut_lineage(rows)
    idf = IDF(inputCol=counted, outputCol="_features").fit(rows)
    regression = LogisticRegression(
        featuresCol="_features",
        labelCol="y",
        weightCol="_w",
        rawPredictionCol="_raw",
        probabilityCol="_probability",
        predictionCol="_prediction",
        maxIter=max_iter,
        regParam=recipe.reg,
    ).fit(idf.transform(rows))
    return LanguageModel(lang, PipelineModel([*stages, idf, regression]))


def _counted_by_folds(rows: DataFrame, lang: str, recipes: Sequence[Recipe], folds: int) -> tuple[DataFrame, list]:
    """Rows with ``_counts<k>`` by the words of all folds but k and every recipe's hashed runs; and those words.

    Neither depends on what is fitted, so tokens are counted by fold in one pass and read once more.
    """
    apart = cut_lineage(token_counts(rows, lang, "ord", "copies", "_tokens", by="_fold"))
    words = []
    for k in range(folds):
        rest = apart.filter(F.col("_fold") != k).groupBy("token")
        rest = rest.agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))
        words.append(known_words(rows.filter(F.col("_fold") != k), lang, rest))
    stages = {s.getOutputCol(): s for r in recipes for s in _run_stages(r)}
    made = PipelineModel([*[_counter(w, f"_counts{k}") for k, w in enumerate(words)], *stages.values()]).transform(rows)
    kept = [f"_counts{k}" for k in range(folds)] + [c for c, s in stages.items() if isinstance(s, HashingTF)]
    return cut_lineage(made.select("ord", "y", "copies", "_fold", *kept)), words


def tune(
    train: DataFrame, lang: str, recipes: Sequence[Recipe] = ORDERED, folds: int = 3, max_iter: int = 30
) -> list[float]:
    """F1 of each recipe over all folds; every row is scored by a model that has not seen it.

    Rows of equal tokens are in one fold, so that repeated feedback does not judge itself. Recipes share
    the counts of a fold.
    """
    rows = train if "_tokens" in train.columns else tokenized(train, lang)
    fold = hash_number(seeded_hash(SEED, F.lit("fold"), F.concat_ws(" ", "_tokens")), folds)
    rows = cut_lineage(rows.withColumn("_fold", fold))
    rows, words = _counted_by_folds(rows, lang, recipes, folds)
    out = []
    for recipe in recipes:
        scored = None
        for k in range(folds):
            counted = rows.withColumnRenamed(f"_counts{k}", "_counts")
            model = fit(counted.filter(F.col("_fold") != k), lang, max_iter, recipe, words[k])
            held = _transformed(model.pipeline.stages, counted.filter(F.col("_fold") == k))
            held = held.select(
                F.when(F.col("y") == 1, "spam").otherwise("ham").alias("label"), vector_to_array("_probability")[1].alias("spam_prob")
            )
            scored = held if scored is None else scored.unionByName(held)
        out.append(metrics(scored).first()["f1"])
    return out


def train_and_evaluate(
    corpus: DataFrame, reports: DataFrame, lang: str, max_iter: int = 30, recipes: Sequence[Recipe] = (BAG,)
) -> tuple[LanguageModel, DataFrame, int, int]:
    """Split, add feedback to the training side, fit, score the test side.

    ``corpus`` has id, label, text, lang, y. Korean is split within language and class, English
    within class. All reports are learnt from; they count FEEDBACK_COPIES times, as a weight instead of repeated rows. Of
    several ``recipes`` the one with the best F1 over folds of the training side is fitted.
    Returns (model, one-row metrics, training rows, test rows).
    """
    strata = ["lang", "label"] if lang == "ko" else ["y"]
    marked = cut_lineage(mark_test(corpus, strata, "id"))
    test = marked.filter("is_test")
    side = marked.filter(~F.col("is_test")).select("text", "y", F.lit(1).alias("copies"))
    feedback = feedback_rows(reports, lang).select("text", "y", F.lit(FEEDBACK_COPIES).alias("copies"))
    # Corpus rows come before feedback rows; writing the table fixes the numbers.
    train = side.unionByName(feedback).withColumn("ord", F.monotonically_increasing_id())
    train = (tokenized if any(r.grams for r in recipes) else counted_rows)(cut_lineage(train), lang)
    recipe = recipes[0]
    if len(recipes) > 1:
        found = tune(train, lang, recipes, max_iter=max_iter)
        recipe = recipes[max(range(len(found)), key=lambda i: (found[i], -i))]
    model = fit(train, lang, max_iter, recipe)
    n_train = train.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    return model, metrics(model.score(test)), n_train, test.count()


def evaluate_by_lang(models: Mapping[str, LanguageModel], test: DataFrame) -> DataFrame:
    return metrics_by_lang(score_routed(test, models))


def score_routed(rows: DataFrame, models: Mapping[str, LanguageModel]) -> DataFrame:
    """Add ``spam_prob`` from the model of each row's ``lang``.

    A row whose language has no model fails the job; another model never stands in.
    """
    out = None
    for lang, model in models.items():
        part = model.score(rows.filter(F.col("lang") == lang))
        out = part if out is None else out.unionByName(part)
    rest = rows.filter(~F.col("lang").isin(*models) | F.col("lang").isNull())
    missing = F.raise_error(F.concat(F.lit("no model for language "), F.coalesce("lang", F.lit("null"))))
    rest = rest.withColumn("spam_prob", missing.cast("double"))
    return rest if out is None else out.unionByName(rest)


def verdicts(scored: DataFrame) -> DataFrame:
    """Add the binary and the three-tier verdict to scored rows."""
    return scored.withColumn("binary", to_binary("spam_prob")).withColumn("tier", to_tier("spam_prob"))
