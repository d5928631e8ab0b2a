"""Paginated search as a Spark data source, batch and streaming, over a pluggable client.

A client has ``story_list(query, start, end, token, page_size) -> (stories, next_token or None)``
and ``story_count(query, start, end) -> (relevant, total)``. Every window is a partition of its own.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from broadsheet.functions.urls import host_of
from broadsheet.operators.pacing import with_retries
from broadsheet.session import ship


class ClientError(Exception):
    """A search client's own failure; ``status`` is the answer's status where there was one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class SearchClient(Protocol):
    def story_list(self, query: str, start: dt.date, end: dt.date, token: str | None, page_size: int) -> tuple[list[dict], str | None]: ...

    def story_count(self, query: str, start: dt.date, end: dt.date) -> tuple[int, int]: ...


class FolderClient:
    """Recorded pages: ``<folder>/<start>_<end>/<n>.json`` with {"stories": [...], "next_token": ...}."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _pages(self, start, end) -> list[Path]:
        return sorted((self.folder / f"{start}_{end}").glob("*.json"), key=lambda p: int(p.stem))

    def story_list(self, query, start, end, token, page_size):
        pages = self._pages(start, end)
        at = int(token) if token else 0
        if at >= len(pages):
            return [], None
        page = json.loads(pages[at].read_text(encoding="utf-8"))
        return page["stories"], str(at + 1) if at + 1 < len(pages) else None

    def story_count(self, query, start, end):
        n = sum(len(json.loads(p.read_text(encoding="utf-8"))["stories"]) for p in self._pages(start, end))
        return n, n


def transient(error: Exception) -> bool:
    """Transport failures, too many requests and server errors are worth another try."""
    status = getattr(error, "status", None)
    return isinstance(error, (ConnectionError, TimeoutError)) or status == 429 or (isinstance(status, int) and status >= 500)


def client_from(options: dict) -> SearchClient:
    """Client named by the option ``client`` (``module:callable``, called with the option ``argument``)."""
    module, _, name = options.get("client", "broadsheet.sources.pages:FolderClient").partition(":")
    return getattr(importlib.import_module(module), name)(options.get("argument", ""))


PAGE_SCHEMA = T.StructType(
    [
        T.StructField("window_start", T.DateType()), T.StructField("window_end", T.DateType()), T.StructField("page_number", T.IntegerType()),
        T.StructField("offset", T.IntegerType()), T.StructField("next_token", T.StringType()), T.StructField("story_json", T.StringType()),
    ]
)
COUNT_SCHEMA = T.StructType(
    [T.StructField("window_start", T.DateType()), T.StructField("window_end", T.DateType()), T.StructField("relevant_count", T.LongType()), T.StructField("total_count", T.LongType())]
)


class _Window(InputPartition):
    def __init__(self, start: dt.date, end: dt.date):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        pairs = json.loads(self.options["windows"])
        return [_Window(dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for a, b in pairs]

    def read(self, partition):
        client, query = client_from(self.options), self.options.get("query", "")
        size, retries = int(self.options.get("pagesize", 1000)), int(self.options.get("retries", 3))
        if self.options.get("mode") == "count":
            yield (partition.start, partition.end, *with_retries(lambda: client.story_count(query, partition.start, partition.end), retries, transient))
            return
        token, page = self.options.get("token"), int(self.options.get("firstpage", 1))
        last = page + int(self.options.get("maxpages", 50))
        while page < last:
            stories, token = with_retries(lambda t=token: client.story_list(query, partition.start, partition.end, t, size), retries, transient)
            for i, story in enumerate(stories):
                yield (partition.start, partition.end, page, i + 1, token, json.dumps(story, ensure_ascii=False, default=str))
            page += 1
            if token is None:
                return


class _Stream(SimpleDataSourceStreamReader):
    """One window after another, page by page; the offset is (window, page, token)."""

    def __init__(self, options: dict):
        self.options = options
        self.windows = json.loads(options["windows"])

    def initialOffset(self):
        return {"window": 0, "page": 1, "token": None}

    def read(self, start):
        if start["window"] >= len(self.windows):
            return iter([]), start
        a, b = (dt.date.fromisoformat(x) for x in self.windows[start["window"]])
        stories, token = client_from(self.options).story_list(self.options.get("query", ""), a, b, start["token"], int(self.options.get("pagesize", 1000)))
        rows = [(a, b, start["page"], i + 1, token, json.dumps(s, ensure_ascii=False, default=str)) for i, s in enumerate(stories)]
        done = token is None
        return iter(rows), {"window": start["window"] + done, "page": 1 if done else start["page"] + 1, "token": token}

    def readBetweenOffsets(self, start, end) -> Iterator[tuple]:
        while start != end:
            rows, start = self.read(start)
            yield from rows


class StoryPages(DataSource):
    """Format ``story_pages``; options windows (JSON list of date pairs), query, client, argument, pagesize, mode."""

    @classmethod
    def name(cls):
        return "story_pages"

    def schema(self):
        return COUNT_SCHEMA if self.options.get("mode") == "count" else PAGE_SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema):
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(StoryPages)


STORY_SCHEMA = "id string, title string, url string, media_name string, media_url string, language string, publish_date string, indexed_date string, text string"


def stories_of(pages: DataFrame, page_size: int) -> tuple[DataFrame, DataFrame]:
    """(stories, errors) of page rows.

    A record whose id isn't a non-empty string is an error row (window, rank, error, raw_json); its
    page goes on. A malformed url gives a null domain; a text that is no string is dropped.
    """
    r = F.from_json("story_json", STORY_SCHEMA)
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json("story_json"), "$.id", "variant"))
    text_kind = F.schema_of_variant(F.variant_get(F.try_parse_json("story_json"), "$.text", "variant"))
    rank = (F.col("page_number") - 1) * page_size + F.col("offset")
    df = pages.withColumns({"r": r, "id_kind": kind, "text_kind": text_kind, "result_rank": rank})
    good = (F.col("id_kind") == "STRING") & (F.col("r.id") != "")
    stories = df.filter(good).select(
        "window_start", "window_end", "page_number", "result_rank", F.col("r.id").alias("story_id"), "r.title", "r.url", host_of(F.col("r.url")).alias("domain"),
        F.substring("r.publish_date", 1, 10).alias("publish_date"), "r.media_name", "r.media_url", "r.language", F.col("r.indexed_date").alias("indexed_at"),
        F.when(F.col("text_kind") == "STRING", F.col("r.text")).alias("mc_text"), F.col("story_json").alias("raw_json"),
    )
    errors = df.filter(~F.coalesce(good, F.lit(False))).select("window_start", "window_end", "result_rank", F.lit("story id must be a non-empty string").alias("error"), F.col("story_json").alias("raw_json"))
    return stories, errors
