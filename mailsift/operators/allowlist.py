"""Trusted senders: matching, override, and the list kept as a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.text import email_domain, extract_email, strip
from mailsift.operators.scaling import BROADCAST_ROWS, HashLookup, lookup_join, size_up_to


def trust_keys(email: Column) -> Column:
    """Patterns that would trust an address: itself, its domain and every parent domain.

    An address without '@' has only itself, so a bare word never matches as a domain.
    """
    domain = email_domain(email)
    dots = F.length(domain) - F.length(F.replace(domain, F.lit("."), F.lit("")))
    suffixes = F.transform(
        F.sequence(F.lit(1), dots + 1), lambda n: F.call_function("substring_index", domain, F.lit("."), -n)
    )
    return (
        F.when(email == "", F.array().cast("array<string>"))
        .when(domain == "", F.array(email))
        .otherwise(F.concat(F.array(email), suffixes))
    )


def flag_trusted(mail: DataFrame, patterns: DataFrame, name: str = "trusted") -> DataFrame:
    """Add a boolean: does the allowlist cover ``sender``?

    A list of ordinary size is probed in place. A longer one is matched against the distinct
    senders only, and the verdict joined back by sender with hot senders kept apart.
    """
    patterns = patterns.select("pattern").dropna().distinct()
    size = size_up_to(patterns)
    if size <= BROADCAST_ROWS:
        lookup = HashLookup(patterns.withColumn("hit", F.lit(1)), "pattern", "hit", size)
        # Steps of their own: the address is extracted once, not once per use.
        keyed = mail.withColumn("_email", extract_email("sender")).withColumn(
            "_keys", trust_keys(F.col("_email"))
        )
        return (
            lookup.attach(keyed, "_allow")
            .withColumn(name, F.exists("_keys", lambda k: lookup.probe(k, "_allow").isNotNull()))
            .drop("_email", "_keys", "_allow")
        )
    senders = mail.select("sender").dropna().distinct()
    keys = senders.select("sender", F.explode(trust_keys(extract_email("sender"))).alias("pattern"))
    # Nearly every sender has "com" and the like among its keys.
    hits = lookup_join(keys, patterns, ["pattern"], "left_semi").select("sender", F.lit(True).alias(name)).distinct()
    return lookup_join(mail, hits, ["sender"]).withColumn(name, F.coalesce(name, F.lit(False)))


def override_verdict(scored: DataFrame) -> DataFrame:
    """A trusted sender makes a mail ham with probability 0, whatever the model said."""
    return scored.withColumn(
        "predicted_label", F.when(F.col("trusted"), "ham").otherwise(F.col("predicted_label"))
    ).withColumn("spam_prob", F.when(F.col("trusted"), 0.0).otherwise(F.col("spam_prob")))


def pattern_of(sender: Column | str, use_domain: bool = False) -> Column:
    """Allowlist pattern for a sender: the address, or its domain; '' when there is none."""
    email = extract_email(sender)
    if not use_domain:
        return email
    return F.when(email.contains("@"), email_domain(email)).otherwise(email)


def patterns_from_ids(messages: DataFrame, ids: DataFrame, use_domain: bool = False) -> DataFrame:
    """Distinct patterns of the senders of the picked mails, ready to add."""
    picked = lookup_join(
        messages.select("gmail_id", "sender"), ids.select("gmail_id").distinct(), ["gmail_id"], "left_semi"
    )
    return (
        picked.filter(F.coalesce(F.col("sender"), F.lit("")) != "")
        .select(pattern_of("sender", use_domain).alias("pattern"))
        .filter(F.col("pattern") != "")
        .distinct()
        .withColumn("note", F.lit("from_list"))
    )


def clean_pattern(pattern: Column | str) -> Column:
    return F.lower(strip(pattern))


def current_list(log: DataFrame) -> DataFrame:
    """The allowlist as it stands after a log of add and remove rows.

    A later add changes the note but keeps the first insert's time and id; a removal ends the
    pattern, a still later add starts it anew. ``id`` orders the log.
    """
    rows = log.withColumn("pattern", clean_pattern("pattern")).filter(F.col("pattern") != "")
    removed = (
        rows.filter(F.col("op") == "remove").groupBy("pattern").agg(F.max("id").alias("_removed"))
    )
    live = lookup_join(rows.filter(F.col("op") == "add"), removed, ["pattern"]).filter(
        F.col("_removed").isNull() | (F.col("id") > F.col("_removed"))
    )
    return live.groupBy("pattern").agg(
        F.min("id").alias("id"),
        F.max_by("note", "id").alias("note"),
        F.min_by("created_at", "id").alias("created_at"),
    )


def add_rows(patterns: DataFrame) -> DataFrame:
    """Log rows that add patterns; blank ones are ignored."""
    return (
        patterns.withColumn("pattern", clean_pattern("pattern"))
        .filter(F.col("pattern") != "")
        .withColumn("op", F.lit("add"))
    )


def remove_rows(patterns: DataFrame) -> DataFrame:
    """Log rows that remove patterns."""
    return patterns.withColumn("pattern", clean_pattern("pattern")).withColumn("op", F.lit("remove"))


def newest_first(trusted: DataFrame) -> DataFrame:
    return trusted.orderBy(F.desc("created_at"), F.desc("id"))
