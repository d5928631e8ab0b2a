"""Pages over the network: robots rules per origin, pace, redirects and a byte cap, one attempt each.

Urls are put in lanes by domain, so one task meets all urls of a domain: it reads an origin's
robots.txt once and keeps the domain's pause. The global rate is shared by the lanes. Requests go
through a transport, a callable that the caller can replace (tests, proxies, recorded responses).
"""

from __future__ import annotations

import gzip
import time
import urllib.error
import urllib.request
import urllib.robotparser
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.config import FetchConfig
from broadsheet.functions.urls import host_of
from broadsheet.operators.acquire import BLOCKED, MEDIA_TYPES
from broadsheet.operators.pacing import DomainDelay, TokenBucket
from broadsheet.session import map_batches, ship

CHUNK = 64 * 1024


@dataclass
class Response:
    status: int
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    chunks: Iterator[bytes] | list[bytes] = ()
    close: Callable[[], None] = lambda: None

    def header(self, name: str) -> str | None:
        return next((v for k, v in self.headers.items() if k.lower() == name.lower()), None)


class Transport(Protocol):
    """Raises OSError where nothing answers; an error status is a response like any other."""

    def __call__(self, url: str, headers: dict[str, str], timeout: float) -> Response: ...


def over_http(most_redirects: int = 5) -> Transport:
    """Transport of the standard library, redirects followed, nothing retried."""

    def get(url: str, headers: dict[str, str], timeout: float) -> Response:
        class Redirects(urllib.request.HTTPRedirectHandler):
            max_redirections = most_redirects

        opener = urllib.request.build_opener(Redirects())
        try:
            got = opener.open(urllib.request.Request(url, headers=headers), timeout=timeout)
        except urllib.error.HTTPError as e:
            got = e
        return Response(got.status, got.url, dict(got.headers.items()), iter(lambda: got.read(CHUNK), b""), got.close)

    return get


def body(response: Response, most: int) -> bytes:
    """The body, read no further than ``most`` bytes; a longer one raises ValueError."""
    parts, size = [], 0
    try:
        for chunk in response.chunks:
            size += len(chunk)
            if size > most:
                raise ValueError(f"the response has more than {most} bytes")
            parts.append(chunk)
    finally:
        response.close()
    return b"".join(parts)


def decoded(content: bytes, content_type: str | None) -> str:
    """Text in the declared encoding, else UTF-8; what can't be decoded is replaced."""
    name = next((p.partition("=")[2].strip("\"' ") for p in (content_type or "").split(";")[1:] if p.strip().lower().startswith("charset=")), "utf-8")
    try:
        return content.decode(name, "replace")
    except LookupError:
        return content.decode("utf-8", "replace")


#: One row per request: the page's own, and those for robots.txt (kind robots).
SCHEMA = (
    "story_id string, kind string, request_url string, final_url string, robots string, http_status int, content_type string, retry_after string, "
    "elapsed_ms long, html string, status string, error string"
)


class Reader:
    """Reads pages one after another; robots rules are kept per origin."""

    def __init__(self, config: FetchConfig, transport: Transport, rate: float, clock=time.monotonic, sleep=time.sleep, draw=None):
        self.config, self.transport, self.clock = config, transport, clock
        self.bucket = TokenBucket(rate, clock=clock, sleep=sleep)
        self.delay = DomainDelay(1.0, config.per_domain_delay_s, **({"draw": draw} if draw else {}), clock=clock, sleep=sleep)
        self.rules: dict[str, urllib.robotparser.RobotFileParser | None] = {}

    def _ask(self, url: str, domain: str) -> tuple[Response | None, bytes | None, dict]:
        """(response, body or None, facts of the request)."""
        self.bucket.acquire()
        self.delay.wait(domain)
        began, facts, response, content = self.clock(), {"request_url": url}, None, None
        try:
            response = self.transport(url, {"User-Agent": self.config.user_agent}, self.config.timeout_s)
            facts |= {"final_url": response.url, "http_status": response.status, "content_type": response.header("Content-Type"), "retry_after": response.header("Retry-After")}
            if 200 <= response.status < 300:
                content = body(response, self.config.max_response_bytes)
            else:
                response.close()
        except (OSError, ValueError) as e:
            facts["error"] = str(e)[:1000]
        facts["elapsed_ms"] = round((self.clock() - began) * 1000)
        return response, content, facts

    def robots(self, url: str, domain: str) -> tuple[str, dict | None]:
        """(allowed, denied or unavailable, the request if one was made). Anything but an answer of 2xx makes the rules unavailable."""
        if not self.config.respect_robots:
            return "allowed", None
        parts = urlsplit(url)
        origin = f"{parts.scheme}://{parts.netloc.lower()}"
        asked = None
        if origin not in self.rules:
            _, content, asked = self._ask(f"{origin}/robots.txt", domain)
            self.rules[origin] = None
            if content is not None:
                self.rules[origin] = urllib.robotparser.RobotFileParser()
                self.rules[origin].parse(decoded(content, asked.get("content_type")).splitlines())
        rules = self.rules[origin]
        return ("unavailable" if rules is None else "allowed" if rules.can_fetch(self.config.user_agent, url) else "denied"), asked

    def read(self, story_id: str, url: str | None) -> list[dict]:
        """Rows of :data:`SCHEMA` for one story, the page's own last."""
        row = {"story_id": story_id, "kind": "page", "request_url": url}
        try:
            parts = urlsplit(url or "")
            parts.port  # noqa: B018 - raises for a malformed one
        except ValueError:
            parts = urlsplit("")
        if parts.scheme not in ("http", "https") or not parts.hostname:
            return [row | {"status": "invalid_url"}]
        domain = parts.hostname.lower()
        verdict, asked = self.robots(url, domain)
        rows = [asked | {"story_id": story_id, "kind": "robots", "robots": verdict}] if asked else []
        row["robots"] = verdict
        if verdict != "allowed":
            return [*rows, row | {"status": f"robots_{verdict}"}]
        response, content, facts = self._ask(url, domain)
        row |= facts
        if response is None or (content is None and 200 <= response.status < 300):
            status = "fetch_failed"
        elif content is None:
            status = "blocked" if response.status in BLOCKED else "fetch_failed"
        elif (facts.get("content_type") or "").split(";")[0].strip().lower() not in MEDIA_TYPES:
            status = "unsupported_content"
        else:
            status, row["html"] = "read", decoded(content, facts.get("content_type"))
        return [*rows, row | {"status": status}]


def stored_pages(spark: SparkSession, folder: str) -> DataFrame:
    """story_id, html of pages kept as ``<folder>/**/<story_id>.html.gz``; a file that can't be unpacked has null html."""
    ship(spark)

    @F.pandas_udf("string")
    def unpacked(contents: pd.Series) -> pd.Series:
        def one(content):
            try:
                return gzip.decompress(content).decode("utf-8", "replace")
            except (OSError, EOFError, zlib.error):
                return None

        return contents.map(one)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html.gz").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.html\.gz$", 1).alias("story_id"), unpacked("content").alias("html"))


def fetch_pages(stories: DataFrame, config: FetchConfig, transport: Callable[[], Transport] = over_http, lanes: int = 1, pause=time.sleep) -> DataFrame:
    """Rows of :data:`SCHEMA` for stories (story_id, url), in as many lanes as may ask at once.

    ``transport`` makes the transport, once in each task. A status of ``read`` still has to be judged
    by the text the page yields. Run with one attempt per task and without speculation, and write the
    result before it is read again: a task that runs twice asks twice.
    """
    config.check_live()

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(config, transport(), config.global_max_rps / lanes, sleep=pause)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            for story, url in zip(pdf["story_id"], pdf["url"], strict=True):
                out = pd.DataFrame(reader.read(story, url)).reindex(columns=names)
                yield out.astype({"http_status": "Int32", "elapsed_ms": "Int64"}).astype({c: "object" for c in names if c not in ("http_status", "elapsed_ms")}).where(out.notna(), None)

    lane = F.coalesce(host_of(F.col("url")), F.lit(""))
    placed = stories.select("story_id", "url", lane.alias("lane")).repartition(lanes, "lane").sortWithinPartitions("lane", "story_id").select("story_id", "url")
    return map_batches(placed, serve, SCHEMA)
