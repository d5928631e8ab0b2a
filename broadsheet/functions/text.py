"""Column functions over titles, dates, tokens and errors; pandas functions where only Python is exact."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import urllib.robotparser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: separators that may set an outlet's name off at the end of a title, tried in this order.
TITLE_SEPARATORS = (" | ", " - ", " — ")
BYTES_PER_TOKEN = 2
PROMPT_OVERHEAD = 16
ERROR_CHARS = 1000


#: What case folding still changes in lower-case letters, by rule: to one character, and to several.
_FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x20000)) if c.lower() == c and c.casefold() != c}
_TO_ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1}
_TO_MORE = {c: f for c, f in _FOLDED.items() if len(f) > 1}


def fold_case(value: Column) -> Column:
    """Full Unicode case folding, in the JVM; letters that fold to several are replaced only where there are any."""
    low = F.translate(F.lower(value), "".join(_TO_ONE), "".join(_TO_ONE.values()))
    pairs = F.array(*[F.struct(F.lit(c).alias("from"), F.lit(f).alias("to")) for c, f in _TO_MORE.items()])
    more = F.aggregate(pairs, low, lambda text, p: F.replace(text, p["from"], p["to"]))
    return F.when(low.rlike("[" + "".join(_TO_MORE) + "]"), more).otherwise(low)


def words(value: Column) -> Column:
    """Case-folded words separated by single blanks; null if there are none."""
    return F.nullif(F.trim(F.regexp_replace(fold_case(value), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def normalize_title(title: Column, media_name: Column, outlets: list[str] = ()) -> Column:
    """Words of a title without one trailing outlet name (a known one, or the row's own)."""
    known = [o.casefold() for o in outlets]
    bare = F.regexp_replace(title, r"^\s+|\s+$", "")
    own = fold_case(F.regexp_replace(media_name, r"^\s+|\s+$", ""))
    out = bare
    for separator in reversed(TITLE_SEPARATORS):
        pattern = "(?s)^(.*)" + separator.replace("|", r"\|") + "(.*)$"
        suffix = fold_case(F.trim(F.regexp_extract(bare, pattern, 2)))
        hit = bare.rlike(pattern) & F.coalesce((suffix == own) | suffix.isin(*known) if known else suffix == own, F.lit(False)) & (suffix != "")
        out = F.when(hit, F.regexp_extract(bare, pattern, 1)).otherwise(out)
    return words(out)


def first_term(title_norm: Column, terms: list[str]) -> Column:
    """First configured term that stands in the title as whole words, else null."""
    padded = F.concat(F.lit(" "), title_norm, F.lit(" "))
    return F.coalesce(*[F.when(padded.contains(f" {t} "), F.lit(t)) for t in terms], F.lit(None).cast("string"))


def date_prefix(value: Column) -> Column:
    """Date in the first ten characters, strictly parsed; anything else is null."""
    head = F.substring(value, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def year_prefix(value: Column) -> Column:
    head = F.substring(value, 1, 4)
    return F.when(head.rlike("^[0-9]{4}$"), head.try_cast("int"))


def safe_component(value: Column) -> Column:
    """Value usable as a file name: letters, digits, ``-`` and ``_`` kept."""
    return F.coalesce(F.nullif(F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "_"), F.lit("")), F.lit("unknown"))


def clipped_error(value: Column) -> Column:
    return F.left(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(ERROR_CHARS))


def token_estimate(value: Column) -> Column:
    """At least 1, else half the UTF-8 bytes rounded up."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(value) + BYTES_PER_TOKEN - 1) / BYTES_PER_TOKEN).cast("int"))


def token_count(value: Column, vocabulary: str | None = None, pattern: str | None = None) -> Column:
    """Tokens of the model's own vocabulary (a file of byte-pair ranks and its splitting pattern) where it is known, else the estimate."""
    if vocabulary is None or pattern is None:
        return token_estimate(value)

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encode = tiktoken.Encoding("model", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return texts.map(lambda t: None if t is None else max(1, len(encode(t)))).astype("Int32")

    return count(value)


def prompt_estimate(system: Column, user: Column) -> Column:
    return token_estimate(system) + token_estimate(user) + PROMPT_OVERHEAD


def truncate_utf8(value: Column, tokens: int) -> Column:
    """Longest start of a text within the bytes of that many tokens, no character cut in two."""

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        limit = max(0, tokens) * BYTES_PER_TOKEN
        return texts.map(lambda t: t.encode()[:limit].decode(errors="ignore"), na_action="ignore")

    return cut(value)


def case_key(topic: Column, story: Column, version: Column, ordinal: Column) -> Column:
    """``topic:story:version:NN``; null parts give null, a colon or an empty part raises."""
    parts = [topic, story, version]
    bad = F.lit(False)
    for p in parts:
        bad = bad | (p == "") | p.contains(":")
    made = F.concat_ws(":", *parts, F.format_string("%02d", ordinal))
    whole = topic.isNotNull() & story.isNotNull() & version.isNotNull() & ordinal.isNotNull()
    return F.when(whole & (bad | (ordinal < 0)), F.raise_error(F.lit("case key parts must be non-empty, without a colon, and the ordinal not negative")).cast("string")).when(whole, made)


def canonical_json(payload: object) -> str:
    """Sorted keys, no blanks, ASCII escapes, ISO dates; other types raise TypeError."""

    def plain(value):
        if isinstance(value, (dt.date, dt.datetime)):
            return value.isoformat()
        raise TypeError(f"not serialisable: {type(value).__name__}")

    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=plain)


def canonical_hash(payload: object) -> str:
    return hashlib.sha256(canonical_json(payload).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_json_text(value: pd.Series) -> pd.Series:
    """JSON text in canonical form; null where it can't be parsed."""

    def one(text):
        try:
            return canonical_json(json.loads(text))
        except (TypeError, ValueError):
            return None

    return value.map(one, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def retry_after_seconds(header: pd.Series, now: pd.Series) -> pd.Series:
    """Seconds a Retry-After header asks for: whole seconds or an HTTP date against ``now``, else null."""

    from email.utils import parsedate_to_datetime

    def one(text, at):
        if text is None or pd.isna(text):
            return None
        text = text.strip()
        if text.isascii() and text.isdigit():
            return float(text)
        try:
            when = parsedate_to_datetime(text)
        except (TypeError, ValueError):
            return None
        when = when if when.tzinfo else when.replace(tzinfo=dt.timezone.utc)
        return max(0.0, (when - pd.Timestamp(at).tz_localize("UTC").to_pydatetime()).total_seconds())

    return pd.Series([one(h, n) for h, n in zip(header, now, strict=True)], dtype="float64")


def robots_allowed(rules: Column, url: Column, agent: str) -> Column:
    """Whether a robots.txt text lets ``agent`` fetch the url; null rules and malformed urls give null."""

    @F.pandas_udf(T.BooleanType())
    def allowed(texts: pd.Series, urls: pd.Series) -> pd.Series:
        parsed: dict[str, urllib.robotparser.RobotFileParser] = {}
        out = []
        for text, target in zip(texts, urls, strict=True):
            if text is None or target is None:
                out.append(None)
                continue
            if text not in parsed:
                parsed[text] = urllib.robotparser.RobotFileParser()
                parsed[text].parse(text.splitlines())
            try:
                out.append(parsed[text].can_fetch(agent, target))
            except ValueError:  # no url at all
                out.append(None)
        return pd.Series(out, dtype="object")

    return allowed(rules, url)
