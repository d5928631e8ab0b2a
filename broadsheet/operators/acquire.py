"""Acquisition: which source a text comes from, and the status of a recorded response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.urls import is_fetchable

# Statuses a site answers with when it turns a reader away, and accepted media types.
BLOCKED = (401, 403, 429, 451)
MEDIA_TYPES = ("text/html", "application/xhtml+xml")


def http_class(status: Column) -> Column:
    """ok, blocked or fetch_failed; null status is fetch_failed."""
    return F.when(status.isin(*BLOCKED), "blocked").when(F.coalesce(status.between(200, 299), F.lit(False)), "ok").otherwise("fetch_failed")


def accepted_media(content_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.substring_index(content_type, ";", 1))).isin(*MEDIA_TYPES), F.lit(False))


def outcome(url: Column, robots: Column, status: Column, content_type: Column, size: Column, text: Column, max_bytes: int, least: int) -> Column:
    """Status of a recorded fetch, the first that applies.

    robots: allowed, denied or unavailable (null counts as allowed); size: bytes of the body.
    """
    kind = http_class(status)
    return (
        F.when(~is_fetchable(url), "invalid_url")
        .when(robots == "unavailable", "robots_unavailable")
        .when(robots == "denied", "robots_denied")
        .when(kind != "ok", kind)
        .when(~accepted_media(content_type), "unsupported_content")
        .when(F.coalesce(size > max_bytes, F.lit(False)), "fetch_failed")
        .when(F.coalesce(F.length(text) >= least, F.lit(False)), "ok")
        .otherwise("too_short")
    )


def source_plan(provided: Column, stored: Column, least: int) -> Column:
    """provider if its text is long enough, else stored_html if there is any, else url."""
    return F.when(F.coalesce(F.length(provided) >= least, F.lit(False)), "provider").when(stored.isNotNull(), "stored_html").otherwise("url")


def decoded(body: Column) -> Column:
    """Bytes as UTF-8 text, broken sequences replaced."""
    return F.decode(body, "UTF-8")


def elapsed_ms(seconds: Column) -> Column:
    """Milliseconds, half to even."""
    return F.bround(seconds * 1000).cast("long")
