"""Seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mailsift.plans.catalog import QUERIES  # noqa: E402
from mailsift.session import local_session  # noqa: E402

HEADLINE = (
    "verdict_stats",
    "trusted_override",
    "mail_projection",
    "new_mail_only",
    "pending_page",
    "mark_actioned",
    "mailbox_labels",
    "trust_remove",
    "compose_text",
    "mime_parse",
    "tokens_char",
    "tokens_word",
    "vocab_char",
    "vocab_word",
    "encoded_char",
    "encoded_word",
    "corpus_clean",
    "corpus_union_distinct",
    "class_balance",
    "split_stratified",
    "feedback_oversample",
    "korean_corpus",
    "length_stats_word",
    "length_histogram_word",
    "token_doc_freq_word",
    "signal_tokens_word",
    "source_distinct",
    "metrics_by_lang",
    "retrain_due",
    "promotion_gate",
    "registry_list",
    "augment_templates",
    "english_corpus",
    "sender_trusted",
    "fetch_recent",
    "train_eval",
    "score_mailbox",
    "stream_scoring",
    "stream_feedback",
    "stream_stats",
    "mime_deep",
    "listing_order",
    "cursor_pages",
    "csv_split_records",
    "trust_snapshot",
    "stored_id_index",
    "stream_feedback_counter",
    "augment_filled",
    "score_by_weights",
)


def calibration(spark) -> float:
    """Seconds of a fixed job, the best of three: rounds are compared after dividing by it."""
    found = []
    for _ in range(3):
        start = time.perf_counter()
        spark.range(200_000_000).selectExpr("sum(xxhash64(id) % 1000)").collect()
        found.append(time.perf_counter() - start)
    return round(min(found), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    # One small run first, so the first query does not pay for starting up.
    QUERIES["verdict_stats"](spark, sf_dir).collect()
    fixed = calibration(spark)
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "calibration": fixed,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
