"""All registered queries."""

from mailsift.plans import (  # noqa: F401
    corpus_queries,
    explore_queries,
    ingest_queries,
    lifecycle_queries,
    mail_queries,
    model_queries,
    stream_queries,
    text_queries,
)
from mailsift.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
