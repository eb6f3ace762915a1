"""Whole jobs over the store: a mailbox pass, a retrain round, 'not spam' feedback."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.operators import lifecycle, mailbox
from mailsift.operators.model import LanguageModel, score_routed, train_and_evaluate
from mailsift.operators.scaling import cut_lineage
from mailsift.schema import RUN_VERSION, SKIPPED_SUFFIX, TIER_LABELS, in_domain
from mailsift.sources.snapshots import DEPLOYED, TRUST, Snapshots
from mailsift.sources.tables import Store, save_predictions, save_rejects, save_reports, save_run

log = logging.getLogger(__name__)

Scorer = Callable[[DataFrame], DataFrame]


def scored_batch(fetched: DataFrame, stored: DataFrame, patterns: DataFrame, scorer: Scorer) -> DataFrame:
    """Message rows for the mail of a batch that is not stored yet.

    ``scorer`` adds spam_prob to rows with lang and text.
    """
    return mailbox.fetched_messages(scorer(mailbox.model_input(mailbox.new_mail(fetched, stored))), patterns)


def mailbox_pass(store: Store, fetched: DataFrame, models: Mapping[str, LanguageModel]) -> tuple[int, int]:
    """Score and store new mail; returns (saved, fetched). Rows refused by the store count as fetched only.

    ``fetched`` is read for its ids, for its rows and for its count: hand in a written table, as
    ``maildrop.parse`` returns. New mail is written by language, so every model reads its own alone; the
    model's text is composed as it is read. Mail without an id goes to the rejects.
    """
    patterns = Snapshots(store, TRUST).state()
    refused = fetched.filter(F.col("gmail_id").isNull())
    if refused.limit(1).count():
        save_rejects(store, "messages", refused, F.lit("no id"))
    new = mailbox.new_mail(fetched, store.read("messages"))
    fresh = mailbox.composed(cut_lineage(mailbox.routed(new), by="lang"))
    rows = cut_lineage(mailbox.fetched_messages(score_routed(fresh, models), patterns))
    save_predictions(store, rows)
    return rows.filter(in_domain("predicted_label", TIER_LABELS)).count(), fetched.count()


def load_models(store: Store) -> dict[str, LanguageModel]:
    """The deployed model of each language, read from where the registry points."""
    in_use = Snapshots(store, DEPLOYED).state()
    return {r["lang"]: LanguageModel.load(r["lang"], r["path"]) for r in in_use.toLocalIterator()}


def deploy(store: Store, lang: str, model: LanguageModel, at: datetime) -> str:
    """Save a model to a folder of its own and put it in use."""
    path = f"{store.root}/models/{lang}/{at:%Y%m%d_%H%M%S_%f}"
    model.save(path)
    store.append("registry", lifecycle.replace_rows(store.read("registry"), lang, path, at))
    return path


def retrain_round(store: Store, corpora: Mapping[str, DataFrame], at: datetime | None = None) -> dict[str, str]:
    """Retrain each language with enough new feedback; deploy it unless F1 fell too far.

    Returns the outcome per retrained language. A skipped attempt is logged too, so the same
    reports do not trigger another try. A language that fails is reported as 'failed' with its error,
    and does not stop the others; without a logged attempt it stays due.
    """
    at = at or datetime.now(timezone.utc).replace(tzinfo=None)
    reports, runs = store.read("user_reports"), store.read("training_runs")
    outcome = {}
    for row in lifecycle.retrain_due(reports, runs).filter("due").toLocalIterator():
        lang = row["lang"]
        try:
            outcome[lang] = _retrain(store, lang, corpora[lang], reports, runs, at)
        except Exception as error:  # noqa: BLE001
            log.exception("retraining of %s failed", lang)
            outcome[lang] = f"failed: {type(error).__name__}: {error}"
    return outcome


def _retrain(store: Store, lang: str, corpus: DataFrame, reports: DataFrame, runs: DataFrame, at: datetime) -> str:
    model, scores, n_train, n_test = train_and_evaluate(corpus, reports, lang)
    candidate = scores.select(F.lit(lang).alias("lang"), F.col("f1").alias("new_f1"))
    verdict = lifecycle.promotion_gate(candidate, runs).first()
    version = RUN_VERSION[lang]
    if verdict["decision"] == "promoted":
        deploy(store, lang, model, at)
    else:
        version += SKIPPED_SUFFIX
    save_run(store, version, n_train, n_test, scores)
    return verdict["decision"]


def mark_not_spam(
    store: Store,
    ids: DataFrame,
    labels: DataFrame | None = None,
    corpora: Mapping[str, DataFrame] | None = None,
) -> tuple[int, DataFrame | None]:
    """Ham reports for the picked ids, appended at once; and the mailbox labels after the action.

    With ``corpora`` the new reports may make a language due, which is then retrained.
    """
    reports = cut_lineage(mailbox.not_spam_reports(store.read("messages"), ids))
    save_reports(store, reports.drop("gmail_id"))
    if corpora is not None:
        retrain_round(store, corpora)
    if labels is None:
        return reports.count(), None
    actions = ids.select("gmail_id").distinct().withColumn("action", F.lit("not_spam"))
    return reports.count(), mailbox.apply_actions(labels, actions)
