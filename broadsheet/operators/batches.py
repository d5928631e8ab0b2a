"""Prompts and batches: greedy packing that keeps the order, and response checks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.config import ExtractionField
from broadsheet.errors import ConfigurationError, ExtractionFailure
from broadsheet.functions.text import BYTES_PER_TOKEN, PROMPT_OVERHEAD
from broadsheet.session import ship


def article_block(story_id: str, title: str | None, text: str, year: int | None) -> str:
    """One article of a prompt; id and title are JSON strings, so no text can imitate a header."""
    return f"Article {json.dumps(story_id)}\nTitle: {json.dumps(title or '')}\nYear: {year if year is not None else 'unknown'}\n{text}"


#: Text that one task packs.
SHARD_BYTES = 64 << 20


def estimate(size: int) -> int:
    return max(1, (size + BYTES_PER_TOKEN - 1) // BYTES_PER_TOKEN)


def article_text(story: Column, title: Column, text: Column, year: Column) -> Column:
    """:func:`article_block` as an expression."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("Article "), quoted(story), F.lit("\nTitle: "), quoted(F.coalesce(title, F.lit(""))), F.lit("\nYear: "), F.coalesce(year.cast("string"), F.lit("unknown")), F.lit("\n"), text)


def ask(client, prompt: str, attempts: int, bucket=None) -> tuple[str | None, str | None, int]:
    """(content or None, last error, attempts made): every attempt is paced, only typed failures are tried again."""
    error = None
    for used in range(1, attempts + 1):
        if bucket:
            bucket.acquire()
        try:
            return client(prompt), None, used
        except ExtractionFailure as e:
            error = str(e)[:1000]
    return None, error, attempts


def pack(articles: list[tuple[str, str | None, str, int | None]], head_bytes: int, system_bytes: int, cap: int, most: int | None) -> list[list[tuple[str, str]]]:
    """Batches of (story_id, text), in order, each within ``cap`` tokens and ``most`` articles.

    An article is added unless the prompt would pass the cap or the count; one that alone passes
    it is cut to the bytes left. A cap too small for any text raises. Bytes are summed and
    turned into tokens once per prompt, as the whole prompt is what counts.
    """
    fixed = estimate(system_bytes) + PROMPT_OVERHEAD
    batches: list[list[tuple[str, str]]] = []
    now: list[tuple[str, str]] = []
    used = head_bytes
    for story, title, text, year in articles:
        size = len(article_block(story, title, text, year).encode()) + 2
        if now and (fixed + estimate(used + size) > cap or (most is not None and len(now) >= most)):
            batches.append(now)
            now, used = [], head_bytes
        if fixed + estimate(used + size) > cap:
            frame = size - len(text.encode())
            left = (cap - fixed) * BYTES_PER_TOKEN - used - frame
            if left <= 0:
                raise ConfigurationError("the token cap leaves no room for an article")
            text = text.encode()[:left].decode(errors="ignore")
            size = frame + len(text.encode())
        now.append((story, text))
        used += size
    return [*batches, now] if now else batches


def packed(candidates: DataFrame, cap: int, most: int | None, head: str = "", system: str = "", shard: Column | None = None) -> DataFrame:
    """topic, shard, batch_no, position, story_id, title, year, text of candidates (topic, ordinal, story_id, title, text, year).

    The fold is sequential within a topic and shard, in order of ``ordinal``. A shard is a range
    of ordinals: as many as have ``SHARD_BYTES`` of text on average, so no task holds a topic of any
    size, and the order over all batches stays that of the candidates.
    """
    ship(candidates.sparkSession)
    schema = "topic string, shard long, batch_no int, position int, story_id string, title string, year int, text string"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ordinal", "story_id"])
        rows = [(a, None if pd.isna(b) else b, c, None if pd.isna(d) else int(d)) for a, b, c, d in zip(pdf["story_id"], pdf["title"], pdf["text"], pdf["year"], strict=True)]
        batches = pack(rows, len(head.encode()), len(system.encode()), cap, most)
        about = {a: (b, d) for a, b, _, d in rows}
        out = [(key[0], key[1], n, i, s, *about[s], t) for n, batch in enumerate(batches) for i, (s, t) in enumerate(batch)]
        return pd.DataFrame(out, columns=["topic", "shard", "batch_no", "position", "story_id", "title", "year", "text"]).astype({"year": "Int32"})

    piece = shard
    if piece is None:
        size = candidates.filter(F.col("text").isNotNull()).agg(F.avg(F.octet_length(F.encode("text", "UTF-8")))).first()[0] or 1.0
        piece = F.floor(F.col("ordinal") / max(1, int(SHARD_BYTES // max(1.0, size))))
    df = candidates.filter(F.col("text").isNotNull()).select("topic", piece.cast("long").alias("shard"), "ordinal", "story_id", "title", "text", "year")
    return df.groupBy("topic", "shard").applyInPandas(one, schema)


def case_schema(fields: tuple[ExtractionField, ...]) -> dict:
    """JSON Schema of one case: every field required and nullable, nothing else allowed."""

    def prop(f: ExtractionField) -> dict:
        out: dict = {"type": ["string", "null"], "description": f.description}
        if f.regex is not None:
            out["pattern"] = f"^(?:{f.regex})$"
        if f.allowed_values is not None:
            out["enum"] = [*f.allowed_values, None]
        return out

    return {"type": "object", "additionalProperties": False, "required": [f.name for f in fields], "properties": {f.name: prop(f) for f in fields}}


def case_struct(fields: tuple[ExtractionField, ...]) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in fields])


def response_schema(fields: tuple[ExtractionField, ...], phase: str) -> dict:
    if phase == "screening":
        item = {"type": "object", "additionalProperties": False, "required": ["story_id", "relevant"], "properties": {"story_id": {"type": "string"}, "relevant": {"type": "boolean"}}}
        name = "decisions"
    else:
        item = {
            "type": "object", "additionalProperties": False, "required": ["story_id", "cases"],
            "properties": {"story_id": {"type": "string"}, "cases": {"type": "array", "items": case_schema(fields)}},
        }
        name = "results"
    return {"type": "object", "additionalProperties": False, "required": [name], "properties": {name: {"type": "array", "items": item}}}


def field_ok(f: ExtractionField) -> Column:
    """Null, or a value that matches the whole pattern and is one of the allowed ones."""
    c = F.col(f.name)
    ok = F.lit(True)
    if f.regex is not None:
        ok = ok & c.rlike(rf"\A(?:{f.regex})\z")
    if f.allowed_values is not None:
        ok = ok & c.isin(*f.allowed_values)
    return c.isNull() | ok


_TRUE, _FALSE = {True, 1, "1", "true", "yes", "on", "t", "y"}, {False, 0, "0", "false", "no", "off", "f", "n"}


def parse_flag(value: object) -> bool:
    value = value.strip().lower() if isinstance(value, str) else value
    if isinstance(value, (bool, int, str)) and value in _TRUE:
        return True
    if isinstance(value, (bool, int, str)) and value in _FALSE:
        return False
    raise ValueError(f"{value!r} is no truth value")


def check_response(content: str | None, expected: list[str], fields: tuple[ExtractionField, ...], phase: str) -> tuple[str, str | None, list[tuple[str, bool, list[dict]]]]:
    """(valid / invalid / unparsed, error, [(story_id, relevant, cases)]) of a model's answer.

    Screening must name every expected id once. Extraction may leave ids out: those are valid,
    not relevant and flagged by the caller; ids it wasn't asked about or named twice are invalid.
    """
    try:
        data = json.loads(content)
    except (TypeError, ValueError) as e:
        return "unparsed", str(e)[:200], []
    name, other = ("decisions", "relevant") if phase == "screening" else ("results", "cases")
    try:
        if not isinstance(data, dict) or set(data) != {name} or not isinstance(data[name], list):
            raise ValueError(f"an object with only {name} is needed")
        out = []
        for item in data[name]:
            if not isinstance(item, dict) or not isinstance(item.get("story_id"), str) or set(item) - {"story_id", other}:
                raise ValueError("unknown keys or no story_id")
            if phase == "screening":
                if other not in item:
                    raise ValueError("relevant is missing")
                out.append((item["story_id"], parse_flag(item[other]), []))
            else:
                out.append((item["story_id"], True, [_case(c, fields) for c in item.get(other, [])]))
        ids = [i for i, _, _ in out]
        if len(set(ids)) != len(ids) or set(ids) - set(expected) or (phase == "screening" and set(ids) != set(expected)):
            raise ValueError("story ids don't fit the request")
    except ValueError as e:
        return "invalid", str(e)[:200], []
    return "valid", None, out


def _case(value: object, fields: tuple[ExtractionField, ...]) -> dict:
    if not isinstance(value, dict) or set(value) - {f.name for f in fields}:
        raise ValueError("unknown keys in a case")
    for f in fields:
        v = value.get(f.name)
        if v is None:
            continue
        if not isinstance(v, str) or (f.regex is not None and not re.fullmatch(f.regex, v)) or (f.allowed_values is not None and v not in f.allowed_values):
            raise ValueError(f"{f.name} is not allowed to be {v!r}")
    return {f.name: value.get(f.name) for f in fields}


def checked(responses: DataFrame, fields: tuple[ExtractionField, ...], phase: str) -> DataFrame:
    """batch_id, story_id, validation_status, validation_error, relevant, omitted, payload_json.

    responses: batch_id, content, expected (array of ids). One row per expected id; a failed
    batch gives each of its stories the failure.
    """
    ship(responses.sparkSession)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for batch, content, expected in zip(pdf["batch_id"], pdf["content"], pdf["expected"], strict=True):
                status, error, found = check_response(content, list(expected), fields, phase)
                named = {i: (r, c) for i, r, c in found}
                for story in expected:
                    relevant, cases = named.get(story, (False if status == "valid" else None, []))
                    payload = json.dumps({"cases": cases}, ensure_ascii=False) if status == "valid" and story in named else None
                    rows.append((batch, story, status, error, relevant, status == "valid" and story not in named, payload))
            yield pd.DataFrame(rows, columns=["batch_id", "story_id", "validation_status", "validation_error", "relevant", "omitted", "payload_json"])

    schema = "batch_id string, story_id string, validation_status string, validation_error string, relevant boolean, omitted boolean, payload_json string"
    return responses.select("batch_id", "content", "expected").mapInPandas(judge, schema)


def case_rows(results: DataFrame, fields: tuple[ExtractionField, ...], topic: str, version: str) -> DataFrame:
    """Cases of valid results, numbered by their place in the answer, with their key."""
    from broadsheet.functions.text import case_key

    parsed = F.from_json("payload_json", T.StructType([T.StructField("cases", T.ArrayType(case_struct(fields)))]))
    df = results.filter("validation_status = 'valid' AND relevant").select("story_id", F.posexplode(parsed["cases"]).alias("ordinal", "case"))
    return df.select(case_key(F.lit(topic), F.col("story_id"), F.lit(version), F.col("ordinal")).alias("case_id"), F.lit(topic).alias("topic"), "story_id", "ordinal", "case.*")


def run_client(batches: DataFrame, client, attempts: int, per_minute: float | None = None) -> DataFrame:
    """Answers of a client for batches (batch_id, prompt, expected): one partition, in order, every attempt paced.

    ``client(prompt) -> str`` may raise :class:`ExtractionFailure`; after ``attempts`` failures the content is null.
    """
    ship(batches.sparkSession)

    def serve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from broadsheet.operators.pacing import TokenBucket

        bucket = TokenBucket(per_minute / 60, 1) if per_minute else None
        for pdf in frames:
            rows = []
            for batch, prompt, expected in zip(pdf["batch_id"], pdf["prompt"], pdf["expected"], strict=True):
                content, error, used = ask(client, prompt, attempts, bucket)
                rows.append((batch, content, list(expected), used, error))
            yield pd.DataFrame(rows, columns=["batch_id", "content", "expected", "attempts", "error"])

    return batches.select("batch_id", "prompt", "expected").coalesce(1).mapInPandas(serve, "batch_id string, content string, expected array<string>, attempts int, error string")
