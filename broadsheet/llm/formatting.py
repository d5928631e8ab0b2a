"""Records that differ only in how they were typed, collapsed with their number of copies.

1. Byte-identical (title, url) rows are collapsed first, with counts, before any text is touched.
2. Only the distinct survivors are canonicalised (Arrow batches, one pass).
3. The survivors are grouped again on the full canonical text, and the counts are summed under
   its 128-bit digest.

Two titles say the same if their words agree in order, or if they agree after sorting the
parts that separators set off. The second grouping therefore runs in two steps: per page and
word sequence the spelling with the most parts is kept, then pages are grouped by sorted parts.
All groupings combine before the shuffle, so a record with a third of all rows is one row per
task; members find their record by joins on digests of the full text, which the adaptive
join splits where a key is hot.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.session import durable, filled, map_batches, table

#: Query parameters that say where a reader came from, not which page it is (fixed values).
TRACKING = re.compile(r"^(utm_\w*|fbclid|gclid|dclid|msclkid|igshid|mc_cid|mc_eid|yclid|_ga)$")
SEPARATOR = re.compile(r"\s*[|·•–—―»«]+\s*|\s+-+\s+|\s*:\s+|\s+:\s*|\s+/+\s+|\s*::+\s*")
WORD = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
_THOUSANDS = re.compile(r"(?<=\d)[,.](?=\d{3}(?!\d))")
_ENTITY = re.compile(r"&#?\w+;")
_URL = re.compile(r"^\s*(?:([a-z][a-z0-9+.-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.I)


def plain(text: str) -> str:
    """Text with entities resolved, compatible characters unified, unseen ones removed, case folded."""
    for _ in range(2):  # only entities with their semicolon; "&section=" is none
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    text = unicodedata.normalize("NFKC", text)
    if not text.isascii():
        text = "".join(c for c in text if unicodedata.category(c) != "Cf" and c not in "\u034f\u115f\u1160ㅤ\ufe0f")
    return unicodedata.normalize("NFC", text.casefold())


def _words(part: str) -> str:
    return " ".join(_THOUSANDS.sub("", w).replace(",", ".") if w[0].isdigit() else w for w in WORD.findall(part))


def title_keys(title: str) -> tuple[str, str, int]:
    """(words in order, sorted parts, number of parts)."""
    text = plain(title)
    parts = [p for p in (_words(x) for x in SEPARATOR.split(text)) if p]
    return " ".join(parts), " | ".join(sorted(parts)), len(parts)


def page_key(url: str) -> str:
    """What chooses the page: host without www and default port, path, sorted parameters."""
    url = plain(url).strip()
    m = _URL.match(url)
    if not m:
        return url
    host = m[2].rpartition("@")[2].removeprefix("www.")
    host = re.sub(r":(?:80|443)?$", "", host).rstrip(".")
    path = re.sub(r"/+", "/", unquote(m[3] or "")).rstrip("/")
    path = re.sub(r"/index\.(?:html?|php|aspx)$", "", path)
    pairs = [unquote(p.replace("+", " ")) for p in (m[4] or "").split("&") if p]
    pairs = sorted(p for p in pairs if not TRACKING.match(p.partition("=")[0]))
    return host + path + ("?" + "&".join(pairs) if pairs else "")


def _canonical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys = [title_keys(t) for t in pdf["title"]]
        pdf["page"] = [page_key(u) for u in pdf["url"]]
        pdf["said"], pdf["parts"], pdf["n_parts"] = ([k[i] for k in keys] for i in range(3))
        yield pdf[["raw_id", "page", "said", "parts", "n_parts"]]


def _digest(*columns: str):
    return F.unhex(F.md5(F.concat_ws("\u0001", *columns)))


def collapse(rows: DataFrame, key: str = "story_id") -> tuple[DataFrame, DataFrame]:
    """(records, members) of ``rows`` with columns key, title and url.

    records: first_<key>, copies (distinct keys), spellings (distinct raw texts); one row per
    record, single ones included. members: first_<key>, <key> for every member of a record of
    two or more. Rows whose title or url is null, blank or a word for no value take no part;
    titles without any word take no part either. Rows repeated whole count once. An empty
    table gives two empty tables; other columns are ignored. Ties can't occur: the first key
    is the smallest.
    """
    first = f"first_{key}"
    given = rows.filter(F.col(key).isNotNull() & filled(F.col("title")) & filled(F.col("url"))).select(F.col(key).alias("k"), "title", "url")
    # Byte-identical texts collapse before the shuffle; who holds them, and how many, travels as digests.
    holders = given.select("k", _digest("title", "url").alias("raw_id")).distinct()
    counts = holders.groupBy("raw_id").agg(F.min("k").alias("least"), F.count("*").alias("n"))
    raw = given.select("title", "url").distinct().withColumn("raw_id", _digest("title", "url"))
    canon = map_batches(raw, _canonical, "raw_id binary, page string, said string, parts string, n_parts int").filter(F.col("said") != "")
    # Canonical texts are made once and go on as digests; of two spellings with as many parts that of the larger digest is kept.
    canon = durable(canon.select("raw_id", _digest("page", "said").alias("said_id"), _digest("page", "parts").alias("parts_id"), "n_parts"))
    record_of = canon.groupBy("said_id").agg(F.max(F.struct("n_parts", "parts_id")).alias("best")).select("said_id", F.col("best.parts_id").alias("record_id"), F.hash("said_id").alias("hash"))
    # The hash as a second key has both sides shuffled for the join, so that the adaptive join can split a hot record.
    of_raw = canon.select("raw_id", "said_id", F.hash("said_id").alias("hash")).join(record_of, ["said_id", "hash"]).select("raw_id", "record_id")
    summed = of_raw.join(counts, "raw_id").groupBy("record_id").agg(F.min("least").alias(first), F.sum("n").alias("copies"), F.count("*").alias("spellings"))
    several = summed.filter("copies > 1").select("record_id", first)
    members = of_raw.join(several, "record_id").join(holders, "raw_id").select(first, F.col("k").alias(key)).distinct()
    return summed.select(first, "copies", "spellings"), members


def found(spark, root: str) -> DataFrame:
    """p2_found: one row for each further story of a record."""
    _, members = collapse(table(spark, root, "stories", ["story_id", "title", "url"]))
    return members.filter("story_id != first_story_id")


def records(spark, root: str) -> DataFrame:
    """Every record of two or more copies with its counts."""
    return collapse(table(spark, root, "stories", ["story_id", "title", "url"]))[0].filter("copies > 1")
