"""Search windows: closed date ranges, fingerprints, resume state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.errors import ConfigurationError
from broadsheet.functions.text import canonical_hash

CONTRACT_VERSION = 1


def date_windows(spark: SparkSession, start: dt.date, end: dt.date, days: int) -> DataFrame:
    """ordinal, window_start, window_end: closed windows of ``days`` days, the last one clipped."""
    if days < 1 or end < start:
        raise ConfigurationError("windows need at least one day and an end not before the start")
    one = spark.range(1).select(F.posexplode(F.sequence(F.lit(start), F.lit(end), F.make_dt_interval(F.lit(days)))).alias("ordinal", "window_start"))
    return one.select(F.col("ordinal").cast("int"), "window_start", F.least(F.date_add("window_start", days - 1), F.lit(end)).alias("window_end"))


def query_inputs(query: str, platform: str, collections, sources, languages) -> dict:
    """What a search means, whatever the order its lists were written in; the page size is no part of it."""
    return {
        "collections": sorted(collections), "contract": CONTRACT_VERSION, "languages": sorted(languages), "platform": platform, "query": query, "sources": sorted(sources),
    }


def query_hash(**inputs) -> str:
    return canonical_hash(query_inputs(**inputs))


def fingerprint(start: dt.date, end: dt.date, **inputs) -> str:
    return canonical_hash(query_inputs(**inputs) | {"end": end, "start": start})


def resume_state(windows: DataFrame, page_size: int, stored_page_size: Column) -> DataFrame:
    """Windows with ``resume``: complete, failed (can't go on), continue or start."""
    pages = F.coalesce("pages_fetched", F.lit(0))
    done = F.coalesce(F.col("pagination_completed").cast("boolean"), F.lit(False))
    token = F.col("next_pagination_token")
    state = (
        F.when(done, "complete")
        .when((pages > 0) & token.isNull(), "failed: pages without a token")
        .when((pages > 0) & (stored_page_size.isNull() | (stored_page_size != page_size)), "failed: page size changed")
        .when(pages > 0, "continue")
        .otherwise("start")
    )
    return windows.withColumn("resume", state)


def rank(page_number: Column, page_size: Column | int, offset: Column) -> Column:
    """Rank over all pages of a window, from 1."""
    return (page_number - 1) * page_size + offset


def metadata(raw: Column) -> Column:
    """Window metadata with defaults for missing, broken or non-object JSON."""
    parsed = F.from_json(raw, "estimate struct<relevant:long,total:long>, pages array<struct<page:int,size:int>>")
    return F.struct(parsed["estimate"].alias("estimate"), F.coalesce(parsed["pages"], F.from_json(F.lit("[]"), "array<struct<page:int,size:int>>")).alias("pages"))
