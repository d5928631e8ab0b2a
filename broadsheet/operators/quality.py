"""Ordered quality rules and exact duplicates with a deterministic original."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.config import TopicConfig
from broadsheet.functions.text import date_prefix, first_term, normalize_title
from broadsheet.functions.urls import contains_any, domain_of, in_domains, normalize_url
from broadsheet.session import any_of, durable


def rule_reason(topic: TopicConfig) -> Column:
    """Reason of the first rule a story breaks, null if it passes all; needs url_norm and title_norm."""
    q = topic.quality
    published = date_prefix(F.col("publish_date"))
    language = F.lower(F.col("language"))
    bare_title = F.regexp_replace(F.col("title"), r"^\s+|\s+$", "")
    term = first_term(F.col("title_norm"), list(q.exclude_title_terms))
    rules = (
        (language.isNull() | ~language.isin(*[x.casefold() for x in topic.languages]), F.lit("bad_lang")),
        (published.isNull() | ~published.between(F.lit(topic.start_date), F.lit(topic.end_date)), F.lit("out_of_range")),
        (F.col("url_norm").isNull() | contains_any(F.col("url"), list(q.exclude_url_patterns)), F.lit("bad_url")),
        (bare_title.isNull() | (F.length(bare_title) < q.min_title_chars), F.lit("short_title")),
        (term.isNotNull(), F.concat(F.lit("excluded_title:"), term)),
        (~in_domains(domain_of(F.col("url_norm")), list(topic.domain_allowlist)), F.lit("off_domain")),
    )
    return F.coalesce(*[F.when(broken, reason) for broken, reason in rules])


def normalized(stories: DataFrame, outlets: list[str] = ()) -> DataFrame:
    """Stories with url_norm and title_norm made anew."""
    return stories.withColumns({"url_norm": normalize_url(F.col("url")), "title_norm": normalize_title(F.col("title"), F.col("media_name"), outlets)})


def decide(stories: DataFrame, topic: TopicConfig, outlets: list[str] = ()) -> DataFrame:
    """story_id, publish_date, url_norm, title_norm, qc_status, qc_reason (one row per input row)."""
    df = normalized(stories, outlets).withColumn("qc_reason", rule_reason(topic))
    status = F.when(F.col("qc_reason").isNull(), "ok").otherwise(F.substring_index("qc_reason", ":", 1))
    return df.select("story_id", "publish_date", "url_norm", "title_norm", status.alias("qc_status"), "qc_reason")


def mark(states: DataFrame, key: str, reason: str) -> DataFrame:
    """States with all but the original of each group of equal ``key`` marked as duplicates.

    Only rows still ok with a key take part. The original has the earliest date (missing last),
    then the smallest id: a grouped minimum, combined before the shuffle and joined back, so a
    key shared by a third of all rows is one row per task. The join has the key's hash as a second
    key, so that the minima are shuffled for it as the states are: only then can the adaptive skew
    join split a hot key.
    """
    order = F.struct(date_prefix(F.col("publish_date")).isNull().alias("a"), date_prefix(F.col("publish_date")).alias("b"), F.col("story_id").alias("c"))
    first = states.filter((F.col("qc_status") == "ok") & F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("size"))
    first = first.filter("size > 1").select(F.col(key).alias("__key"), F.xxhash64(key).alias("__h"), F.col("first.c").alias("__first"))
    # Rows without a key match nothing; a hash of their id spreads them.
    keyed = states.withColumn("__k", F.when(F.col("qc_status") == "ok", F.col(key)))
    keyed = keyed.withColumn("__g", F.when(F.col("__k").isNull(), F.xxhash64("story_id")).otherwise(F.xxhash64("__k")))
    df = keyed.join(first, (F.col("__k") == F.col("__key")) & (F.col("__g") == F.col("__h")), "left")
    dup = F.col("__first").isNotNull() & (F.col("__first") != F.col("story_id"))
    return df.withColumns(
        {
            "qc_status": F.when(dup, "dup").otherwise(F.col("qc_status")),
            "qc_reason": F.when(dup, reason).otherwise(F.col("qc_reason")),
            "dup_of_story_id": F.when(dup, F.col("__first")).otherwise(F.col("dup_of_story_id")),
        }
    ).drop("__k", "__g", "__h", "__key", "__first")


def flatten(states: DataFrame) -> DataFrame:
    """Duplicates of a duplicate point to the final original (a chain has at most two links)."""
    hop = states.filter(F.col("dup_of_story_id").isNotNull()).select(F.col("story_id").alias("__via"), F.col("dup_of_story_id").alias("__end"))
    df = states.join(hop, F.col("dup_of_story_id") == F.col("__via"), "left")
    return df.withColumn("dup_of_story_id", F.coalesce("__end", "dup_of_story_id")).drop("__via", "__end")


def deduplicate(stories: DataFrame, topic: TopicConfig, outlets: list[str] = ()) -> DataFrame:
    """Rules, then equal urls, then equal titles among what is left, then final originals."""
    # Every pass reads the states twice; they are narrow, and made once.
    states = durable(decide(stories, topic, outlets).withColumn("dup_of_story_id", F.lit(None).cast("string")))
    states = mark(mark(states, "url_norm", "duplicate_url"), "title_norm", "duplicate_title")
    return flatten(states)


def summary(states: DataFrame, topic: str) -> DataFrame:
    """topic, processed, succeeded, skipped, failed in one row."""
    ok = F.count_if(F.col("qc_status") == "ok")
    return states.agg(F.lit(topic).alias("topic"), F.count("*").alias("processed"), ok.alias("succeeded"), (F.count("*") - ok).alias("skipped"), F.lit(0).cast("long").alias("failed"))


def pending(fetch_status: Column, has_row: Column) -> Column:
    """No article yet, or one whose status is known and not ok; a null status isn't pending."""
    return ~has_row | F.coalesce(fetch_status != "ok", F.lit(False))


def title_priority(title: Column, terms: list[str]) -> Column:
    """Index of the first term the title holds, else the number of terms."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(*[F.when(low.contains(t.lower()), F.lit(i)) for i, t in enumerate(terms)], F.lit(len(terms)))


def title_hit(title: Column, terms: list[str]) -> Column:
    """0 if the title holds any term, else 1."""
    return F.when(any_of(F.lower(F.coalesce(title, F.lit(""))).contains(t.lower()) for t in terms), 0).otherwise(1)
