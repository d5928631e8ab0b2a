"""Versioned schemas of the stored tables; columns added later read as nulls from older files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.errors import StorageError

SCHEMA_VERSION = 4

S, L, I, D, B, TS, DT = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(), T.DateType()  # noqa: E741


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


#: table -> (since version, columns); later entries add columns.
_HISTORY: dict[str, list[tuple[int, T.StructType]]] = {
    "pipeline_runs": [(1, _struct(run_uuid=S, topic=S, stage=S, status=S, config_hash=S, config_json=S, revision=S, versions_json=S, at=TS, error=S))],
    "search_windows": [
        (1, _struct(window_id=S, topic=S, query_hash=S, request_fingerprint=S, query=S, platform=S, collection_ids_json=S, source_ids_json=S, languages_json=S,
                    window_start=DT, window_end=DT, relevant_count=L, total_count=L, pages_fetched=I, pagination_completed=B, status=S, client_version=S,
                    completed_at=TS, error=S, raw_json=S)),
        (2, _struct(next_pagination_token=S)),
    ],
    "stories": [(1, _struct(story_id=S, title=S, url=S, url_norm=S, domain=S, publish_date=S, media_name=S, media_url=S, language=S, indexed_at=S, mc_text=S,
                            title_norm=S, raw_json=S, first_seen_at=TS, last_seen_at=TS))],
    "story_topic_state": [(1, _struct(topic=S, story_id=S, qc_status=S, qc_reason=S, dup_of_story_id=S, decided_at=TS))],
    "search_hits": [(1, _struct(window_id=S, story_id=S, page_number=I, result_rank=I, raw_json=S, found_at=TS))],
    "articles": [(1, _struct(story_id=S, fetch_status=S, source=S, http_status=I, final_url=S, extractor=S, text=S, text_chars=L, byline=S, extracted_date=S,
                             attempts=I, error=S, raw_html_path=S, fetched_at=TS))],
    "raw_pages": [(4, _struct(story_id=S, html=S, http_status=I, content_type=S, final_url=S, fetched_at=TS))],
    "fetch_attempts": [(1, _struct(story_id=S, attempt_number=I, source=S, request_url=S, final_url=S, http_status=I, elapsed_ms=L, retry_after_s=D, extractor=S,
                                   text_chars=L, error=S, attempted_at=TS))],
    "extraction_batches": [(1, _struct(batch_id=S, topic=S, phase=S, model=S, prompt_version=S, prompt_hash=S, schema_hash=S, status=S, story_ids_json=S,
                                       attempt_count=I, request_json=S, response_json=S, usage_json=S, at=TS))],
    "story_extractions": [(1, _struct(topic=S, story_id=S, prompt_version=S, batch_id=S, relevant=B, reject_reason=S, validation_status=S, validation_error=S,
                                      payload_json=S, extracted_at=TS))],
    "cases": [
        (1, _struct(case_id=S, topic=S, story_id=S, prompt_version=S, ordinal=I, case_type=S, person_name=S, jurisdiction=S, evidence_verified=B, raw_json=S, created_at=TS)),
        (3, _struct(private_org=S, private_time=S, public_org=S, public_time=S)),
    ],
}

KEYS = {
    "pipeline_runs": ["run_uuid"], "search_windows": ["topic", "request_fingerprint", "window_start", "window_end"], "stories": ["story_id"],
    "story_topic_state": ["topic", "story_id"], "search_hits": ["window_id", "story_id"], "articles": ["story_id"], "raw_pages": ["story_id"], "fetch_attempts": ["story_id", "attempt_number"],
    "extraction_batches": ["batch_id"], "story_extractions": ["topic", "story_id", "prompt_version"], "cases": ["case_id"],
}
REFERENCES = (
    ("story_topic_state", "story_id", "stories"), ("search_hits", "story_id", "stories"), ("search_hits", "window_id", "search_windows"),
    ("articles", "story_id", "stories"), ("fetch_attempts", "story_id", "articles"), ("story_extractions", "story_id", "stories"),
)
ALLOWED = {("story_extractions", "validation_status"): ("valid", "invalid", "unparsed")}


def schema(table: str, version: int = SCHEMA_VERSION) -> T.StructType:
    """Columns of a table as of a version; an unknown table or a newer version raises."""
    if version > SCHEMA_VERSION:
        raise StorageError(f"stored version {version} is newer than {SCHEMA_VERSION}")
    if table not in _HISTORY:
        raise StorageError(f"no table {table}")
    return T.StructType([f for since, part in _HISTORY[table] if since <= version for f in part.fields])


def tables() -> tuple[str, ...]:
    return tuple(_HISTORY)


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns, missing ones null, enumerations checked when read."""
    out = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(table).fields]
    df = df.select(*out)
    for (name, column), values in ALLOWED.items():
        if name == table:
            bad = F.col(column).isNotNull() & ~F.col(column).isin(*values)
            df = df.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit(f"{name}.{column}: "), F.col(column))).cast("string")).otherwise(F.col(column)))
    return df


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str | None = None) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    known = parent.select(F.col(key or column).alias("__key")).distinct()
    return child.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__key"), "left_anti")
