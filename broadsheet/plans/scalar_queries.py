"""Queries over single tables: normal forms, predicates, identifiers, estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.config import SAMPLE_TOPIC
from broadsheet.functions import html, text, urls
from broadsheet.operators import acquire, batches, quality, windows
from broadsheet.session import ship, table

ALLOWED_DOMAINS = ["example"]
LEAST_CHARS = 500
MAX_BYTES = 5_242_880
SYSTEM = "Return only JSON that fits the schema."


def _stories(spark, root, *columns):
    return table(spark, root, "stories", columns).distinct()


def url_normalize(spark, root):
    return _stories(spark, root, "url").select("url", urls.normalize_url(F.col("url")).alias("norm"))


def title_normalize(spark, root):
    return _stories(spark, root, "title", "media_name").select("title", "media_name", text.normalize_title(F.col("title"), F.col("media_name")).alias("norm"))


def host_domain(spark, root):
    df = _stories(spark, root, "url")
    return df.select("url", urls.host_of(F.col("url")).alias("host"), urls.domain_of(urls.normalize_url(F.col("url"))).alias("norm_domain"), urls.origin_of(F.col("url")).alias("origin"), urls.is_fetchable(F.col("url")).alias("fetchable"))


def domain_allowlist(spark, root):
    df = _stories(spark, root, "domain")
    return df.select("domain", urls.in_domains(F.col("domain"), ALLOWED_DOMAINS).alias("allowed"), urls.in_domains(F.col("domain"), []).alias("without_list"))


def title_terms(spark, root):
    df = _stories(spark, root, "title")
    return df.select("title", text.first_term(text.words(F.col("title")), ["land swap", "ferry lease", "rail study"]).alias("term"))


def url_patterns(spark, root):
    return _stories(spark, root, "url").select("url", urls.contains_any(F.col("url"), ["/Sports/", "/video/"]).alias("excluded"))


def date_prefix(spark, root):
    return _stories(spark, root, "publish_date").select("publish_date", text.date_prefix(F.col("publish_date")).alias("day"), text.year_prefix(F.col("publish_date")).alias("year"))


def safe_component(spark, root):
    df = _stories(spark, root, "media_name").withColumn("safe", text.safe_component(F.col("media_name")))
    return df.select("media_name", "safe", F.substring("safe", 1, 2).alias("directory"))


def error_text(spark, root):
    df = table(spark, root, "fetch_review", ["story_id", "error", "text"]).distinct()
    return df.select("story_id", text.clipped_error(F.coalesce("error", "text")).alias("clipped"))


def token_estimate(spark, root):
    df = table(spark, root, "documents", ["doc_id", "text"])
    return df.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.prompt_estimate(F.lit(SYSTEM), F.col("text")).alias("prompt_tokens"))


def truncate_utf8(spark, root):
    df = table(spark, root, "documents", ["doc_id", "text"])
    return df.select("doc_id", text.truncate_utf8(F.col("text"), 100).alias("cut"))


def sha256_ids(spark, root):
    df = table(spark, root, "documents", ["doc_id", "text"])
    return df.select("doc_id", F.sha2(F.to_binary("text", F.lit("utf-8")), 256).alias("digest"))


def canonical_json_hash(spark, root):
    ship(spark)
    df = table(spark, root, "events", ["event_id", "props"]).withColumn("canonical", text.canonical_json_text(F.col("props")))
    return df.select("event_id", "canonical", F.sha2("canonical", 256).alias("digest"))


def json_path(spark, root):
    df = table(spark, root, "events", ["event_id", "event_type", "props"])
    return df.select("event_id", F.get_json_object("props", "$.ref").alias("ref"), F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


def status_group(spark, root):
    df = table(spark, root, "search_windows", ["status", "pages_fetched", "relevant_count"])
    return df.groupBy("status").agg(F.count("*").alias("windows"), F.sum("pages_fetched").alias("pages"), F.sum("relevant_count").alias("relevant"))


def http_status_class(spark, root):
    df = table(spark, root, "fetch_review", ["story_id", "url", "http_status", "text", "extractor"]).distinct()
    media = F.when(F.col("extractor").isNotNull(), "Text/HTML; charset=utf-8").otherwise("application/pdf")
    robots = F.when(F.col("url").contains("/tag/"), "denied").when(F.col("url").isNull(), "unavailable").otherwise("allowed")
    out = acquire.outcome(F.col("url"), robots, F.col("http_status"), media, F.octet_length(F.coalesce("text", F.lit(""))), F.col("text"), MAX_BYTES, LEAST_CHARS)
    return df.select("story_id", "http_status", acquire.http_class(F.col("http_status")).alias("http_class"), acquire.accepted_media(media).alias("media_ok"), out.alias("status"))


def acquire_source_plan(spark, root):
    df = table(spark, root, "stories", ["story_id", "mc_text"]).distinct()
    stored = table(spark, root, "fetch_review", ["story_id", "text"]).filter("text IS NOT NULL").select("story_id", F.lit(1).alias("stored")).distinct()
    plan = df.join(stored, "story_id", "left").select(acquire.source_plan(F.col("mc_text"), F.col("stored"), LEAST_CHARS).alias("source"))
    return plan.groupBy("source").agg(F.count("*").alias("stories"))


def _pages(spark, root):
    df = table(spark, root, "fetch_review", ["story_id", "text"]).filter("text IS NOT NULL").distinct()
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform(F.split(escaped, "\n"), lambda x: F.concat(F.lit('<P class="x">'), x, F.lit("</p >"))), "\n")
    head = F.lit("<html><script>var a = '<p>no</p>';</script><!-- <p>no</p> --><p>never closed")
    return df.withColumn("html", F.concat(head, body, F.lit("<p>cut off")))


def html_paragraphs(spark, root):
    return _pages(spark, root).select("story_id", html.paragraphs(F.col("html")).alias("paragraphs"))


def extract_cascade(spark, root):
    df = _pages(spark, root).select("story_id", html.extract(F.col("html"), LEAST_CHARS).alias("x"))
    return df.select("story_id", F.col("x.extractor").alias("extractor"), F.length("x.text").alias("chars"))


def date_windows(spark, root):
    return windows.date_windows(spark, SAMPLE_TOPIC.start_date, SAMPLE_TOPIC.end_date, 30)


def window_fingerprints(spark, root):
    """Hashes of what each stored window asks for; the few windows are hashed on the driver."""
    import datetime as dt
    import json

    rows = table(spark, root, "search_windows").collect()  # bounded: windows of a search, not documents
    out = []
    for r in rows:
        inputs = {"query": r.query, "platform": r.platform, "collections": json.loads(r.collection_ids_json or "[]"), "sources": json.loads(r.source_ids_json or "[]"), "languages": json.loads(r.languages_json or "[]")}
        out.append((r.id, windows.query_hash(**inputs), windows.fingerprint(dt.date.fromisoformat(r.window_start[:10]), dt.date.fromisoformat(r.window_end[:10]), **inputs)))
    return spark.createDataFrame(out, "id long, query_hash string, fingerprint string")


def result_rank(spark, root):
    df = table(spark, root, "search_hits", ["search_window_id", "story_id", "page_number", "result_rank"]).distinct()
    offset = (F.col("result_rank") - 1) % 1000 + 1
    return df.select("search_window_id", "story_id", windows.rank(F.col("page_number"), 1000, offset).alias("global_rank"))


def window_resume(spark, root):
    df = table(spark, root, "search_windows", ["id", "pages_fetched", "pagination_completed", "next_pagination_token"])
    stored = F.when(F.col("id") % 7 == 0, F.lit(500)).otherwise(F.lit(1000))
    return windows.resume_state(df, 1000, stored).select("id", "resume")


def window_metadata(spark, root):
    df = table(spark, root, "events", ["event_id", "props"]).select("event_id", windows.metadata(F.col("props")).alias("m"))
    return df.select("event_id", F.col("m.estimate.total").alias("total"), F.size("m.pages").alias("pages"))


def validate_fields(spark, root):
    df = table(spark, root, "cases", ["id", *[f.name for f in SAMPLE_TOPIC.fields]]).distinct()
    checks = {f.name: batches.field_ok(f) for f in SAMPLE_TOPIC.fields if f.regex or f.allowed_values}
    return df.select("id", *[ok.alias(f"{n}_ok") for n, ok in checks.items()])


def retry_after(spark, root):
    ship(spark)
    df = table(spark, root, "events", ["event_id", "ts"])
    header = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 120).cast("string")).when(
        F.col("event_id") % 3 == 1, F.date_format(F.col("ts") + F.expr("INTERVAL 90 SECONDS"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    ).otherwise("soon")
    return df.select("event_id", text.retry_after_seconds(header, F.date_trunc("second", "ts")).alias("seconds"))


def robots_allow(spark, root):
    rules = F.lit("User-agent: *\nDisallow: /video/\nDisallow: /photo/\nAllow: /\n")
    return _stories(spark, root, "url").select("url", text.robots_allowed(rules, F.col("url"), "reader").alias("allowed"))


def elapsed(spark, root):
    df = table(spark, root, "events", ["event_id", "value"])
    return df.select("event_id", acquire.elapsed_ms(F.col("value")).alias("ms"))


def fold_case(spark, root):
    return _stories(spark, root, "title").select("title", text.fold_case(F.col("title")).alias("folded"))


def fetch_priority(spark, root):
    terms = list(SAMPLE_TOPIC.priority_terms)
    df = _stories(spark, root, "story_id", "title")
    return df.select("story_id", quality.title_priority(F.col("title"), terms).alias("priority"), quality.title_hit(F.col("title"), terms).alias("miss"))


_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: CTEs from a table u(url) to n(url, host, port, netloc, norm).
URL_SQL = rf"""
t AS (SELECT url, regexp_replace(url, '^[\s\x00-\x1f]+|[\s\x00-\x1f]+$', '', 'g') AS b FROM u),
s AS (SELECT url, b, regexp_replace(regexp_extract(b, '{_URL}', 1), '^.*@', '') AS netloc, regexp_replace(regexp_extract(b, '{_URL}', 2), '/+$', '') AS path, regexp_extract(b, '{_URL}', 3) AS q FROM t),
a AS (SELECT *, lower(regexp_replace(netloc, ':\d*$', '')) AS host, regexp_extract(netloc, ':(\d*)$', 1) AS port FROM s),
p AS (SELECT *, list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''),
   lambda x: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': CASE WHEN instr(x, '=') > 0 THEN url_decode(replace(substr(x, instr(x, '=') + 1), '+', ' ')) ELSE '' END}}),
   lambda z: NOT starts_with(lower(z.k), 'utm_') AND lower(z.k) <> 'fbclid')) AS pairs FROM a),
n AS (SELECT *, CASE WHEN host <> '' AND NOT regexp_matches(host, '[\[\]\s]') AND NOT contains(host, ':') AND (port = '' OR TRY_CAST(port AS INTEGER) <= 65535)
   THEN regexp_replace(host, '^www\.', '') || CASE WHEN port <> '' THEN ':' || CAST(TRY_CAST(port AS INTEGER) AS VARCHAR) ELSE '' END || path ||
   CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(list_transform(pairs, lambda z: replace(url_encode(z.k), '%20', '+') || '=' || replace(url_encode(z.v), '%20', '+')), '&') ELSE '' END END AS norm FROM p)
"""
# The foldings beyond lower case that occur in Latin and Greek text, stated for the SQL on their own.
FOLD = "lower({0})"
for _from, _to in (("ß", "ss"), ("ς", "σ"), ("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ŉ", "ʼn")):
    FOLD = f"replace({FOLD}, '{_from}', '{_to}')"
WORDS = "nullif(trim(regexp_replace(" + FOLD + r", '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '')"


def _title_sql(title: str = "title", media: str = "media_name") -> str:
    bare = rf"regexp_replace({title}, '^\s+|\s+$', '', 'g')"
    own = FOLD.format(rf"regexp_replace({media}, '^\s+|\s+$', '', 'g')")
    cases = []
    for sep in (r" \| ", " - ", " — "):
        pattern = f"(?s)^(.*){sep}(.*)$"
        suffix = FOLD.format(f"trim(regexp_extract({bare}, '{pattern}', 2))")
        cases.append(f"WHEN regexp_matches({bare}, '{pattern}') AND {suffix} = {own} AND {suffix} <> '' THEN regexp_extract({bare}, '{pattern}', 1)")
    return WORDS.format("(CASE " + " ".join(cases) + f" ELSE {bare} END)")


TITLE_SQL = _title_sql()
_TERM = " ".join(f"WHEN contains(' ' || {WORDS.format('title')} || ' ', ' {t} ') THEN '{t}'" for t in ("land swap", "ferry lease", "rail study"))
DAY_SQL = r"CASE WHEN regexp_matches(substr({0}, 1, 10), '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN CAST(try_strptime(substr({0}, 1, 10), '%Y-%m-%d') AS DATE) END"
_CLASS = "CASE WHEN http_status IN (401, 403, 429, 451) THEN 'blocked' WHEN http_status BETWEEN 200 AND 299 THEN 'ok' ELSE 'fetch_failed' END"
_PRIORITY = " ".join(f"WHEN contains(lower(coalesce(title, '')), '{t}') THEN {i}" for i, t in enumerate(SAMPLE_TOPIC.priority_terms))
_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{00A0}]+', ' ', 'g'))), lambda x: x <> '')"
_JURISDICTIONS = ", ".join(f"'{v}'" for v in SAMPLE_TOPIC.fields[-1].allowed_values)

QUERIES = {
    "url_normalize": (url_normalize, f"WITH u AS (SELECT DISTINCT url FROM stories), {URL_SQL} SELECT url, norm FROM n"),
    "title_normalize": (title_normalize, f"SELECT title, media_name, {TITLE_SQL} AS norm FROM (SELECT DISTINCT title, media_name FROM stories)"),
    "host_domain": (
        host_domain,
        rf"""WITH u AS (SELECT DISTINCT url FROM stories), {URL_SQL} SELECT url, CASE WHEN host <> '' AND NOT regexp_matches(host, '[\[\]\s]') THEN host END AS host,
        split_part(split_part(norm, '/', 1), ':', 1) AS norm_domain, nullif(regexp_extract(b, '^(?i)(https?://[^/?#]+)', 1), '') AS origin,
        coalesce(regexp_matches(b, '^(?i)https?://[^/?#\s]+'), false) AS fetchable FROM n""",
    ),
    "domain_allowlist": (domain_allowlist, "SELECT domain, coalesce(domain = 'example' OR ends_with(domain, '.example'), false) AS allowed, true AS without_list FROM (SELECT DISTINCT domain FROM stories)"),
    "title_terms": (title_terms, f"SELECT title, CASE {_TERM} END AS term FROM (SELECT DISTINCT title FROM stories)"),
    "url_patterns": (url_patterns, "SELECT url, coalesce(contains(lower(url), '/sports/') OR contains(lower(url), '/video/'), false) AS excluded FROM (SELECT DISTINCT url FROM stories)"),
    "date_prefix": (
        date_prefix,
        f"""SELECT publish_date, {DAY_SQL.format('publish_date')} AS day, CASE WHEN regexp_matches(substr(publish_date, 1, 4), '^[0-9]{{4}}$') THEN CAST(substr(publish_date, 1, 4) AS INTEGER) END AS year
        FROM (SELECT DISTINCT publish_date FROM stories)""",
    ),
    "safe_component": (
        safe_component,
        r"""WITH x AS (SELECT media_name, coalesce(nullif(regexp_replace(media_name, '[^\p{L}\p{N}_-]', '_', 'g'), ''), 'unknown') AS safe FROM (SELECT DISTINCT media_name FROM stories))
        SELECT media_name, safe, substr(safe, 1, 2) AS directory FROM x""",
    ),
    "error_text": (error_text, r"SELECT story_id, substr(trim(regexp_replace(coalesce(error, text), '\s+', ' ', 'g')), 1, 1000) AS clipped FROM (SELECT DISTINCT story_id, error, text FROM fetch_review)"),
    "token_estimate": (
        token_estimate,
        f"SELECT doc_id, CAST(greatest(1, (strlen(text) + 1) // 2) AS INTEGER) AS tokens, CAST(greatest(1, (strlen('{SYSTEM}') + 1) // 2) + greatest(1, (strlen(text) + 1) // 2) + 16 AS INTEGER) AS prompt_tokens FROM documents",
    ),
    "truncate_utf8": (truncate_utf8, "SELECT doc_id, substr(text, 1, CAST(list_max(list_filter(range(0, 201), lambda i: strlen(substr(text, 1, CAST(i AS BIGINT))) <= 200)) AS BIGINT)) AS cut FROM documents"),
    "sha256_ids": (sha256_ids, "SELECT doc_id, sha256(text) AS digest FROM documents"),
    "canonical_json_hash": (
        canonical_json_hash,
        """WITH c AS (SELECT event_id, '{' || array_to_string(list_transform(list_sort(json_keys(props)), lambda k: '"' || k || '":' || CAST(json_extract(props, '$."' || k || '"') AS VARCHAR)), ',') || '}' AS canonical FROM events)
        SELECT event_id, canonical, sha256(canonical) AS digest FROM c""",
    ),
    "json_path": (json_path, "SELECT event_id, props ->> '$.ref' AS ref, props ->> '$.k' AS k, props ->> '$.missing' AS missing FROM events"),
    "status_group": (status_group, "SELECT status, count(*) AS windows, CAST(sum(pages_fetched) AS BIGINT) AS pages, CAST(sum(relevant_count) AS BIGINT) AS relevant FROM search_windows GROUP BY status"),
    "http_status_class": (
        http_status_class,
        rf"""WITH r AS (SELECT DISTINCT story_id, url, http_status, text, extractor FROM fetch_review), c AS (SELECT *, {_CLASS} AS http_class FROM r)
        SELECT story_id, http_status, http_class, extractor IS NOT NULL AS media_ok, CASE
        WHEN NOT coalesce(regexp_matches(regexp_replace(url, '^[\s\x00-\x1f]+|[\s\x00-\x1f]+$', '', 'g'), '^(?i)https?://[^/?#\s]+'), false) THEN 'invalid_url'
        WHEN url IS NULL THEN 'robots_unavailable' WHEN contains(url, '/tag/') THEN 'robots_denied' WHEN http_class <> 'ok' THEN http_class
        WHEN extractor IS NULL THEN 'unsupported_content' WHEN strlen(coalesce(text, '')) > {MAX_BYTES} THEN 'fetch_failed' WHEN length(text) >= {LEAST_CHARS} THEN 'ok' ELSE 'too_short' END AS status FROM c""",
    ),
    "acquire_source_plan": (
        acquire_source_plan,
        f"""SELECT CASE WHEN length(mc_text) >= {LEAST_CHARS} THEN 'provider' WHEN stored IS NOT NULL THEN 'stored_html' ELSE 'url' END AS source, count(*) AS stories
        FROM (SELECT DISTINCT story_id, mc_text FROM stories) LEFT JOIN (SELECT DISTINCT story_id, 1 AS stored FROM fetch_review WHERE text IS NOT NULL) USING (story_id) GROUP BY 1""",
    ),
    "html_paragraphs": (html_paragraphs, f"SELECT story_id, array_to_string({_LINES}, chr(10) || chr(10)) AS paragraphs FROM (SELECT DISTINCT story_id, text FROM fetch_review WHERE text IS NOT NULL)"),
    "extract_cascade": (
        extract_cascade,
        f"""WITH x AS (SELECT story_id, array_to_string({_LINES}, chr(10) || chr(10)) AS body FROM (SELECT DISTINCT story_id, text FROM fetch_review WHERE text IS NOT NULL))
        SELECT story_id, CASE WHEN length(body) >= {LEAST_CHARS} THEN 'paragraphs' END AS extractor, CAST(CASE WHEN length(body) >= {LEAST_CHARS} THEN length(body) END AS INTEGER) AS chars FROM x""",
    ),
    "date_windows": (
        date_windows,
        f"""SELECT CAST(i AS INTEGER) AS ordinal, CAST(DATE '{SAMPLE_TOPIC.start_date}' + CAST(30 * i AS INTEGER) AS DATE) AS window_start,
        CAST(least(DATE '{SAMPLE_TOPIC.start_date}' + CAST(30 * i + 29 AS INTEGER), DATE '{SAMPLE_TOPIC.end_date}') AS DATE) AS window_end FROM range(0, 1000) r(i) WHERE DATE '{SAMPLE_TOPIC.start_date}' + CAST(30 * i AS INTEGER) <= DATE '{SAMPLE_TOPIC.end_date}'""",
    ),
    "window_fingerprints": (
        window_fingerprints,
        """WITH p AS (SELECT id, window_start, window_end, '{"collections":[' || array_to_string(list_sort(from_json(coalesce(collection_ids_json, '[]'), '["BIGINT"]')), ',') || '],"contract":1,' AS head,
        '"languages":[' || array_to_string(list_transform(list_sort(from_json(coalesce(languages_json, '[]'), '["VARCHAR"]')), lambda x: '"' || x || '"'), ',') || '],"platform":' || CAST(to_json(platform) AS VARCHAR) || ',"query":' || CAST(to_json(query) AS VARCHAR) || ',"sources":[' || array_to_string(list_sort(from_json(coalesce(source_ids_json, '[]'), '["BIGINT"]')), ',') || ']' AS rest FROM search_windows)
        SELECT id, sha256(head || rest || '}') AS query_hash, sha256(head || '"end":"' || left(window_end, 10) || '",' || replace(rest, ',"sources":[', ',"sources":[') || ',"start":"' || left(window_start, 10) || '"}') AS fingerprint FROM p""",
    ),
    "result_rank": (
        result_rank,
        "SELECT search_window_id, story_id, CAST((page_number - 1) * 1000 + (result_rank - 1) % 1000 + 1 AS INTEGER) AS global_rank FROM (SELECT DISTINCT search_window_id, story_id, page_number, result_rank FROM search_hits)",
    ),
    "window_resume": (
        window_resume,
        """SELECT id, CASE WHEN coalesce(pagination_completed, 0) <> 0 THEN 'complete' WHEN coalesce(pages_fetched, 0) > 0 AND next_pagination_token IS NULL THEN 'failed: pages without a token'
        WHEN coalesce(pages_fetched, 0) > 0 AND id % 7 = 0 THEN 'failed: page size changed' WHEN coalesce(pages_fetched, 0) > 0 THEN 'continue' ELSE 'start' END AS resume FROM search_windows""",
    ),
    "window_metadata": (
        window_metadata,
        "SELECT event_id, CAST(json_extract(props, '$.estimate.total') AS BIGINT) AS total, CAST(coalesce(json_array_length(json_extract(props, '$.pages')), 0) AS INTEGER) AS pages FROM events",
    ),
    "validate_fields": (
        validate_fields,
        rf"""SELECT id, private_time IS NULL OR regexp_full_match(private_time, '\d{{4}}(?:-\d{{4}})?') AS private_time_ok, public_time IS NULL OR regexp_full_match(public_time, '\d{{4}}(?:-\d{{4}})?') AS public_time_ok,
        jurisdiction IS NULL OR jurisdiction IN ({_JURISDICTIONS}) AS jurisdiction_ok FROM (SELECT DISTINCT id, person_name, private_org, private_time, public_org, public_time, jurisdiction FROM cases)""",
    ),
    "retry_after": (
        retry_after,
        "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id % 120 AS DOUBLE) WHEN 1 THEN CAST(90 AS DOUBLE) END AS seconds FROM events",
    ),
    "robots_allow": (
        robots_allow,
        r"SELECT DISTINCT url, CASE WHEN url IS NULL OR regexp_matches(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*[\[\]]') THEN NULL ELSE NOT regexp_matches(url, '^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?/(?:video|photo)/') END AS allowed FROM stories",
    ),
    "elapsed_ms": (elapsed, "SELECT event_id, CAST(round_even(value * 1000, 0) AS BIGINT) AS ms FROM events"),
    "fold_case": (fold_case, f"SELECT title, {FOLD.format('title')} AS folded FROM (SELECT DISTINCT title FROM stories)"),
    "fetch_priority": (
        fetch_priority,
        f"SELECT story_id, CAST(CASE {_PRIORITY} ELSE {len(SAMPLE_TOPIC.priority_terms)} END AS INTEGER) AS priority, CAST(CASE WHEN {' OR '.join(f'''contains(lower(coalesce(title, '')), '{t}')''' for t in SAMPLE_TOPIC.priority_terms)} THEN 0 ELSE 1 END AS INTEGER) AS miss FROM (SELECT DISTINCT story_id, title FROM stories)",
    ),
}
