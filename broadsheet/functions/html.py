"""Paragraph text of HTML pages as one JVM expression, and the cascade of extractors."""

from __future__ import annotations

import importlib
import importlib.util

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Named character references resolved in paragraph text; "&amp;" comes last.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&amp;", "&"))


def paragraphs(html: Column) -> Column:
    """Texts of closed ``<p>`` elements, white space collapsed, empty ones dropped, joined by blank lines.

    A new ``<p>`` discards an unclosed one before it. Comments, scripts and styles are removed
    first. Null gives null, a page without paragraphs an empty text.
    """
    clean = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    parts = F.slice(F.split(clean, r"(?i)<p(?:\s[^>]*)?>"), 2, 1_000_000_000)
    closed = F.filter(parts, lambda p: p.rlike(r"(?i)</p\s*>"))

    def text(part: Column) -> Column:
        body = F.regexp_replace(F.regexp_extract(part, r"(?is)^(.*?)</p\s*>", 1), r"(?s)<[^>]*>", "")
        for name, sign in ENTITIES:
            body = F.replace(body, F.lit(name), F.lit(sign))
        return F.trim(F.regexp_replace(body, r"[\s\u00a0]+", " "))

    return F.array_join(F.filter(F.transform(closed, text), lambda t: t != ""), "\n\n")


def main_block(html: Column) -> Column:
    """Paragraphs inside the page's ``<article>`` or ``<main>`` element; empty where there is none."""
    inner = F.regexp_extract(html, r"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>", 2)
    return paragraphs(inner)


def _trafilatura(page: str) -> str | None:
    return importlib.import_module("trafilatura").extract(page)


def _readability(page: str) -> str | None:
    summary = importlib.import_module("readability").Document(page).summary()
    return importlib.import_module("lxml.html").fromstring(summary).text_content()


#: Parsers outside this package, in the order they are tried; each takes part only where it is installed.
PARSERS = {"trafilatura": ("trafilatura", _trafilatura), "readability-lxml": ("readability", _readability)}


def installed(parsers: dict = PARSERS) -> dict:
    return {name: read for name, (module, read) in parsers.items() if importlib.util.find_spec(module)}


def parsed(html: Column, least: int, parsers: dict) -> Column:
    """Struct (text, extractor) of the first parser that yields at least ``least`` characters; a page a parser fails on goes to the next."""

    @F.pandas_udf("text string, extractor string")
    def read(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            row = (None, None)
            for name, parser in parsers.items() if page else ():
                try:
                    text = parser(page)
                except Exception:  # noqa: BLE001 - whatever a foreign parser raises on a page
                    continue
                if text is not None and len(text) >= least:
                    row = (text, name)
                    break
            rows.append(row)
        return pd.DataFrame(rows, columns=["text", "extractor"])

    return read(html)


def extract(html: Column, least: int, parsers: dict | None = None) -> Column:
    """Struct (text, extractor) of the first extractor that yields at least ``least`` characters.

    First come the outside parsers that are installed (none by default here), then the page's main
    block, then its paragraphs; the last two are JVM expressions.
    """
    parsers = installed() if parsers is None else parsers
    tiers = (("main_block", main_block(html)), ("paragraphs", paragraphs(html)))
    hits = [F.when(F.length(t) >= least, F.struct(t.alias("text"), F.lit(n).alias("extractor"))) for n, t in tiers]
    if parsers:
        found = parsed(html, least, parsers)
        hits.insert(0, F.when(found["text"].isNotNull(), found))
    return F.coalesce(*hits)
