"""Queries over several tables: reachability, decisions, reviews, candidates, changes, audits.

The shared tables stand in for the stored ones: ``fetch_review`` holds the articles (one row per
story), and the answers of both phases are derived from ``cases``, whose key holds the prompt version.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from broadsheet.config import SAMPLE_TOPIC
from broadsheet.operators import batches, quality, review, upsert
from broadsheet.plans.scalar_queries import DAY_SQL, TITLE_SQL, URL_SQL
from broadsheet.session import durable, numbered, table

VERSION = "v7"
TERMS = list(SAMPLE_TOPIC.priority_terms)
#: Columns of a story that the reviews show.
SHOWN = ("title", "url", "domain", "publish_date", "media_name", "language")


def stories(spark, root, *columns):
    """Distinct stories with the named columns only: a DISTINCT over all of them can't be pruned."""
    return table(spark, root, "stories", ("story_id", *columns)).distinct()


def state(spark, root):
    return table(spark, root, "story_topic_state").distinct()


def hits(spark, root):
    return table(spark, root, "search_hits", ["search_window_id", "story_id", "page_number", "result_rank"]).distinct()


def windows(spark, root):
    return table(spark, root, "search_windows")


def articles(spark, root, *columns):
    """One row per story: the row of the smallest topic."""
    wanted = columns or ("fetch_status", "source", "http_status", "extractor", "text", "text_chars", "fetched_at")
    df = table(spark, root, "fetch_review", ["story_id", "topic", *wanted])
    return df.groupBy("story_id").agg(F.min_by(F.struct(*wanted), "topic").alias("r")).select("story_id", "r.*")


def extractions(spark, root):
    """Answers per (topic, story, version) as the cases' keys tell them; unverified ones stand for invalid answers."""
    df = table(spark, root, "cases", ["case_id", "topic", "story_id", "evidence_verified", "created_at"])
    version = F.element_at(F.split("case_id", ":"), -2)
    df = df.filter("case_id IS NOT NULL").groupBy("topic", "story_id", version.alias("prompt_version"))
    df = df.agg(F.max("created_at").alias("extracted_at"), F.max("evidence_verified").alias("ok"))
    return df.select("topic", "story_id", "prompt_version", "extracted_at", F.when(F.coalesce("ok", F.lit(False)), "valid").otherwise("invalid").alias("validation_status"), F.lit(True).alias("relevant"))


def _reach(spark, root):
    return review.reachable(table(spark, root, "search_hits", ["search_window_id", "story_id"]), windows(spark, root))


def reachable_distinct(spark, root):
    return _reach(spark, root)


def qc_decisions(spark, root):
    return quality.decide(stories(spark, root, "title", "url", "media_name", "publish_date", "language"), SAMPLE_TOPIC).select("story_id", "qc_status", "qc_reason")


def _states(spark, root):
    df = quality.decide(stories(spark, root, "title", "url", "media_name", "publish_date", "language"), SAMPLE_TOPIC)
    return durable(df.withColumn("dup_of_story_id", F.lit(None).cast("string")))


def dedup_url(spark, root):
    return quality.mark(_states(spark, root), "url_norm", "duplicate_url").filter("qc_status = 'dup'").select("story_id", "dup_of_story_id")


def dedup_title(spark, root):
    df = quality.mark(quality.mark(_states(spark, root), "url_norm", "duplicate_url"), "title_norm", "duplicate_title")
    return df.filter("qc_reason = 'duplicate_title'").select("story_id", "dup_of_story_id")


def dedup_flatten(spark, root):
    df = quality.deduplicate(stories(spark, root, "title", "url", "media_name", "publish_date", "language"), SAMPLE_TOPIC)
    return df.select("story_id", "qc_status", "qc_reason", "dup_of_story_id")


def dedup_summary(spark, root):
    df = quality.deduplicate(stories(spark, root, "title", "url", "media_name", "publish_date", "language"), SAMPLE_TOPIC)
    return quality.summary(df, "sample")


def dedup_review_rows(spark, root):
    return review.dedup_rows(_reach(spark, root), stories(spark, root, *SHOWN), state(spark, root))


def dedup_review_stats(spark, root):
    return review.dedup_stats(_reach(spark, root), state(spark, root))


def search_review_rows(spark, root):
    return review.search_rows(hits(spark, root), windows(spark, root), stories(spark, root, *SHOWN))


def search_review_stats(spark, root):
    return review.search_stats(hits(spark, root), windows(spark, root))


def fetch_review_topk(spark, root):
    return review.newest(review.fetch_rows(_reach(spark, root), state(spark, root), stories(spark, root, "title", "url"), articles(spark, root, "fetch_status", "source", "http_status", "extractor", "text_chars", "fetched_at")), 50)


def pending_fetch_priority(spark, root):
    return review.pending_rows(_reach(spark, root), state(spark, root), stories(spark, root, "title", "url", "domain", "publish_date"), articles(spark, root, "fetch_status"), TERMS)


def fetch_counts(spark, root):
    return review.fetch_counts(_reach(spark, root), state(spark, root), articles(spark, root, "fetch_status"))


def _candidates(spark, root):
    """Candidates with ``text`` standing for its length: what decides is made before the shuffle, so no text takes part in it."""
    df = table(spark, root, "fetch_review", ["story_id", "topic", "fetch_status", "text"])
    length = F.when(F.length(F.trim("text")) > 0, F.length("text"))
    df = df.select("story_id", "topic", "fetch_status", length.cast("string").alias("text"))
    held = df.groupBy("story_id").agg(F.min_by(F.struct("fetch_status", "text"), "topic").alias("r")).select("story_id", "r.*")
    return review.candidates(state(spark, root), stories(spark, root, "title", "publish_date"), held, extractions(spark, root), VERSION, TERMS)


def screening_candidates(spark, root):
    return _candidates(spark, root).select("topic", "story_id", "attempted", "extracted_at", "miss", "publish_date", F.col("text").cast("int").alias("chars"))


def next_candidates(spark, root):
    order = ["attempted", F.col("extracted_at").asc_nulls_first(), "miss", F.col("publish_date").asc_nulls_first(), "story_id", "topic"]
    return _candidates(spark, root).orderBy(*order).limit(40).select("topic", "story_id", "attempted")


def extraction_candidates(spark, root):
    e = extractions(spark, root)
    screened = state(spark, root).filter("qc_status IN ('ok', 'dup')").select("topic", "story_id", F.lit("valid").alias("validation_status"), (F.col("qc_status") == "ok").alias("relevant"))
    return review.relevant_candidates(screened, e)


def json_requests(spark, root):
    """Hits of the windows whose request, as JSON, says completed; windows stand for batches, hits for answers."""
    asked = windows(spark, root).select(F.col("id").alias("batch_id"), F.to_json(F.struct("topic", "status")).alias("request_json"))
    df = review.of_requests(hits(spark, root).withColumnRenamed("search_window_id", "batch_id"), asked, "$.status", "completed")
    return df.groupBy("batch_id").agg(F.count("*").alias("answers"))


def latest_outcome(spark, root):
    return upsert.latest(extractions(spark, root), ["story_id"], ["extracted_at", "topic", "prompt_version"])


def case_export(spark, root):
    cases = table(spark, root, "cases").distinct().withColumn("raw_json", F.to_json(F.struct(F.col("person_name"), F.col("status").alias("extra"))))
    fields = [f.name for f in SAMPLE_TOPIC.fields] + ["extra"]
    return review.case_rows(cases, extractions(spark, root), stories(spark, root, "media_name", "url", "publish_date"), fields, F.concat(F.lit("link:"), F.col("topic")))


def article_audit(spark, root):
    e = extractions(spark, root)
    return review.audit(_reach(spark, root), stories(spark, root, "title", "url", "publish_date"), state(spark, root), articles(spark, root, "fetch_status", "text_chars"), e.filter("prompt_version < 'v5'"), e)


def window_counts(spark, root):
    counted = hits(spark, root).groupBy("search_window_id").agg(F.count("*").alias("hits"), F.max("page_number").alias("last_page"))
    return windows(spark, root).select("id", "topic", "pages_fetched").join(counted, F.col("id") == F.col("search_window_id"), "left").select("id", "topic", F.coalesce("hits", F.lit(0)).alias("hits"), F.greatest(F.col("pages_fetched"), F.col("last_page")).alias("pages"))


def upsert_coalesce(spark, root):
    df = stories(spark, root, "title", "media_name", "mc_text").withColumnRenamed("mc_text", "raw")
    again = df.select("story_id", F.lit(None).cast("string").alias("title"), F.upper("media_name").alias("media_name"), F.lit(None).cast("string").alias("raw"), F.lit(2).alias("seq"))
    return upsert.coalesced(df.select("story_id", "title", "media_name", "raw", F.lit(1).alias("seq")).unionByName(again), ["story_id"], ["seq"], replace=["raw"]).select("story_id", "title", "media_name", "raw")


def upsert_changed_only(spark, root):
    old = state(spark, root)
    new = old.select("topic", "story_id", F.when(F.col("qc_status") == "bad_lang", "ok").otherwise(F.col("qc_status")).alias("qc_status"), F.when(F.col("qc_status") != "bad_lang", F.col("qc_reason")).alias("qc_reason"), "dup_of_story_id")
    return upsert.change_only(old, new, ["topic", "story_id"], ["qc_status", "qc_reason", "dup_of_story_id"], "decided_at", dt.datetime(2026, 1, 1))


def stale_anti(spark, root):
    return upsert.stale(state(spark, root).select("topic", "story_id"), _reach(spark, root), ["topic", "story_id"])


def reconcile_counts(spark, root):
    return review.reconciled(review.dedup_rows(_reach(spark, root), stories(spark, root, *SHOWN), state(spark, root)), _reach(spark, root), ["topic"])


def attempt_numbers(spark, root):
    e = table(spark, root, "events", ["event_id", "user_id", "ts", "event_type"])
    old = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.count("*").cast("int").alias("attempt_number"))
    return upsert.numbered_attempts(old, e.filter("event_type = 'error'"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "attempt_number")


def pack_batches(spark, root):
    """Packing over all texts in the order of their ids, 20 articles and 30,000 tokens a prompt."""
    df = articles(spark, root, "text").filter("text IS NOT NULL")
    place = numbered(df.select("story_id"), "story_id")
    df = df.join(place, "story_id").select(F.lit("all").alias("topic"), "ordinal", "story_id", F.lit(None).cast("string").alias("title"), "text", F.lit(None).cast("int").alias("year"))
    return batches.packed(df, 30_000, 20)


def pack_sound(spark, root):
    """What must hold of the batches: every text once, in order, no batch of too many articles or tokens."""
    df = durable(pack_batches(spark, root).select("shard", "batch_no", "position", "story_id", F.octet_length(F.encode("text", "UTF-8")).alias("bytes")))
    each = df.groupBy("shard", "batch_no").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    per = each.agg(F.count_if(F.col("n") > 20).alias("too_many"), F.count_if(F.col("bytes") > 60_000).alias("too_long"))
    edges = df.groupBy("shard", "batch_no").agg(F.min("story_id").alias("least"), F.max("story_id").alias("most"))
    ahead = F.lag("most").over(Window.partitionBy("shard").orderBy("batch_no"))
    order = edges.withColumn("before", ahead).agg(F.count_if(F.col("before") >= F.col("least")).alias("out_of_order"))
    count = df.agg(F.count("*").alias("placed"), F.count_distinct("story_id").alias("stories"))
    return count.crossJoin(per).crossJoin(order)  # one row each


def response_ids(spark, root):
    """Which windows' answers (stories of page 1) name exactly, or only, the stories asked for."""
    per_story = hits(spark, root).groupBy("search_window_id", "story_id").agg(F.count_if(F.col("page_number") == 1).alias("n"))
    df = per_story.groupBy("search_window_id").agg(F.count("*").alias("asked"), F.sum("n").alias("got"), F.count_if(F.col("n") > 0).alias("different")).filter("got > 0")
    once = F.col("got") == F.col("different")
    return df.select("search_window_id", (once & (F.col("different") == F.col("asked"))).alias("complete"), once.alias("allowed"))


def stage_counters(spark, root):
    s = F.col("fetch_status")
    return articles(spark, root, "source", "fetch_status").groupBy("source").agg(F.count("*").alias("processed"), F.count_if(s == "ok").alias("succeeded"), F.count_if(s != "ok").alias("failed"))


def analysis_counts(spark, root):
    e = extractions(spark, root).groupBy("topic").agg(F.count("*").alias("extractions"))
    c = table(spark, root, "cases", ["topic", "case_id"]).groupBy("topic").agg(F.count_distinct("case_id").alias("cases"))
    return e.join(c, "topic", "full")


def integrity_orphans(spark, root):
    from broadsheet.schemas import orphans

    s = stories(spark, root)
    return orphans(state(spark, root).select("topic", "story_id", "dup_of_story_id"), "dup_of_story_id", s, "story_id")


_S = "stories_d AS (SELECT DISTINCT * FROM stories), state_d AS (SELECT DISTINCT * FROM story_topic_state), hits_d AS (SELECT DISTINCT search_window_id, story_id, page_number, result_rank FROM search_hits)"
_R = _S + ", reach AS (SELECT DISTINCT w.topic, h.story_id FROM hits_d h JOIN search_windows w ON h.search_window_id = w.id)"


def _art(*columns: str) -> str:
    return "art AS (SELECT story_id, unnest(r) FROM (SELECT story_id, min_by({" + ", ".join(f"'{c}': {c}" for c in columns) + "}, topic) AS r FROM fetch_review GROUP BY story_id))"


_E = """ext AS (SELECT topic, story_id, prompt_version, extracted_at, CASE WHEN coalesce(ok, false) THEN 'valid' ELSE 'invalid' END AS validation_status, true AS relevant FROM
 (SELECT topic, story_id, string_split(case_id, ':')[-2] AS prompt_version, max(created_at) AS extracted_at, bool_or(evidence_verified) AS ok FROM cases WHERE case_id IS NOT NULL GROUP BY 1, 2, 3))"""
_q = SAMPLE_TOPIC.quality
_LANGS = ", ".join(f"'{x}'" for x in SAMPLE_TOPIC.languages)
_DECIDE = rf"""u AS (SELECT DISTINCT url FROM stories), {URL_SQL},
 base AS (SELECT DISTINCT story_id, title, url, media_name, publish_date, language FROM stories),
 nrm AS (SELECT b.*, n.norm AS url_norm, {TITLE_SQL} AS title_norm, {DAY_SQL.format('publish_date')} AS day FROM base b LEFT JOIN n ON b.url IS NOT DISTINCT FROM n.url),
 rules AS (SELECT *, CASE WHEN language IS NULL OR lower(language) NOT IN ({_LANGS}) THEN 'bad_lang' WHEN day IS NULL OR day NOT BETWEEN DATE '{SAMPLE_TOPIC.start_date}' AND DATE '{SAMPLE_TOPIC.end_date}' THEN 'out_of_range'
  WHEN url_norm IS NULL OR {' OR '.join(f"contains(lower(url), '{p}')" for p in _q.exclude_url_patterns)} THEN 'bad_url' WHEN title IS NULL OR length(regexp_replace(title, '^\s+|\s+$', '', 'g')) < {_q.min_title_chars} THEN 'short_title'
  {' '.join(f"WHEN contains(' ' || title_norm || ' ', ' {t} ') THEN 'excluded_title:{t}'" for t in _q.exclude_title_terms)} END AS qc_reason FROM nrm),
 dec AS (SELECT *, CASE WHEN qc_reason IS NULL THEN 'ok' ELSE split_part(qc_reason, ':', 1) END AS qc_status FROM rules)"""


def _mark(src: str, dst: str, key: str, reason: str, prior: str) -> str:
    return f"""{dst}_f AS (SELECT *, CASE WHEN qc_status = 'ok' AND {key} IS NOT NULL THEN first_value(story_id) OVER (PARTITION BY CASE WHEN qc_status = 'ok' THEN {key} END ORDER BY day ASC NULLS LAST, story_id) END AS f FROM {src}),
 {dst} AS (SELECT * EXCLUDE (f, qc_status, qc_reason{', dup' if prior else ''}), CASE WHEN f <> story_id THEN 'dup' ELSE qc_status END AS qc_status, CASE WHEN f <> story_id THEN '{reason}' ELSE qc_reason END AS qc_reason,
 CASE WHEN f <> story_id THEN f ELSE {prior or 'NULL'} END AS dup FROM {dst}_f)"""


_MARKS = f"{_DECIDE}, {_mark('dec', 'm1', 'url_norm', 'duplicate_url', '')}, {_mark('m1', 'm2', 'title_norm', 'duplicate_title', 'dup')}"
_FLAT = _MARKS + ", flat AS (SELECT a.story_id, a.qc_status, a.qc_reason, coalesce(b.dup, a.dup) AS dup_of_story_id FROM m2 a LEFT JOIN m2 b ON a.dup = b.story_id AND b.dup IS NOT NULL)"
_HIT = " OR ".join(f"contains(lower(coalesce(title, '')), '{t}')" for t in TERMS)
_PRI = " ".join(f"WHEN contains(lower(coalesce(title, '')), '{t}') THEN {i}" for i, t in enumerate(TERMS))
_CAND = f"""{_S}, {_art('fetch_status', 'text')}, {_E}, cand AS (SELECT s.topic, s.story_id, CAST(e.validation_status IS NOT NULL AS INTEGER) AS attempted, e.extracted_at, CAST(CASE WHEN {_HIT} THEN 0 ELSE 1 END AS INTEGER) AS miss,
 t.publish_date, CAST(length(a.text) AS INTEGER) AS chars FROM state_d s JOIN stories_d t USING (story_id) JOIN art a ON a.story_id = s.story_id AND a.fetch_status = 'ok' AND a.text IS NOT NULL AND length(trim(a.text)) > 0
 LEFT JOIN ext e ON e.topic = s.topic AND e.story_id = s.story_id AND e.prompt_version = '{VERSION}' WHERE s.qc_status = 'ok' AND (e.validation_status IS NULL OR e.validation_status IN ('invalid', 'unparsed')))"""
_FIELDS = [f.name for f in SAMPLE_TOPIC.fields]

QUERIES = {
    "reachable_distinct": (reachable_distinct, f"WITH {_R} SELECT * FROM reach"),
    "qc_decisions": (qc_decisions, f"WITH {_DECIDE} SELECT story_id, qc_status, qc_reason FROM dec"),
    "dedup_url": (dedup_url, f"WITH {_MARKS} SELECT story_id, dup AS dup_of_story_id FROM m1 WHERE qc_status = 'dup'"),
    "dedup_title": (dedup_title, f"WITH {_MARKS} SELECT story_id, dup AS dup_of_story_id FROM m2 WHERE qc_reason = 'duplicate_title'"),
    "dedup_flatten": (dedup_flatten, f"WITH {_FLAT} SELECT * FROM flat"),
    "dedup_summary": (dedup_summary, f"WITH {_FLAT} SELECT 'sample' AS topic, count(*) AS processed, count(*) FILTER (qc_status = 'ok') AS succeeded, count(*) FILTER (qc_status <> 'ok') AS skipped, CAST(0 AS BIGINT) AS failed FROM flat"),
    "dedup_review_rows": (
        dedup_review_rows,
        f"""WITH {_R} SELECT r.topic, r.story_id, s.title, s.url, s.domain, s.publish_date, s.media_name, s.language, d.qc_status, d.qc_reason, d.dup_of_story_id, o.title AS original_title, o.url AS original_url
        FROM reach r JOIN stories_d s USING (story_id) LEFT JOIN state_d d ON d.topic = r.topic AND d.story_id = r.story_id LEFT JOIN stories_d o ON o.story_id = d.dup_of_story_id""",
    ),
    "dedup_review_stats": (
        dedup_review_stats,
        f"""WITH {_R} SELECT r.topic, count(*) AS stories, count(qc_status) AS decided, count(*) FILTER (qc_status = 'ok') AS accepted, count(*) FILTER (qc_status = 'dup') AS duplicates,
        count(*) FILTER (qc_status NOT IN ('ok', 'dup')) AS rejected, count(*) FILTER (qc_reason = 'duplicate_url') AS duplicate_urls, count(*) FILTER (qc_reason = 'duplicate_title') AS duplicate_titles,
        count(*) - count(qc_status) AS undecided FROM reach r LEFT JOIN state_d d ON d.topic = r.topic AND d.story_id = r.story_id GROUP BY r.topic""",
    ),
    "search_review_rows": (
        search_review_rows,
        f"""WITH {_S} SELECT h.search_window_id, h.story_id, h.page_number, h.result_rank, w.topic, w.window_start, w.window_end, w.query_hash, w.status AS window_status, s.title, s.url, s.domain, s.publish_date, s.media_name, s.language
        FROM hits_d h JOIN search_windows w ON w.id = h.search_window_id JOIN stories_d s USING (story_id)""",
    ),
    "search_review_stats": (
        search_review_stats,
        f"""WITH {_S}, w AS (SELECT topic, count(*) AS windows, count(*) FILTER (pagination_completed <> 0) AS completed_windows, CAST(coalesce(sum(pages_fetched), 0) AS BIGINT) AS pages FROM search_windows GROUP BY topic),
        h AS (SELECT w.topic, count(*) AS hits, count(DISTINCT h.story_id) AS distinct_stories FROM hits_d h JOIN search_windows w ON w.id = h.search_window_id GROUP BY w.topic)
        SELECT w.*, coalesce(hits, 0) AS hits, coalesce(distinct_stories, 0) AS distinct_stories, windows - completed_windows AS incomplete_windows, coalesce(hits, 0) - coalesce(distinct_stories, 0) AS duplicate_hits FROM w LEFT JOIN h USING (topic)""",
    ),
    "fetch_review_topk": (
        fetch_review_topk,
        f"""WITH {_R}, {_art('fetch_status', 'source', 'http_status', 'extractor', 'text_chars', 'fetched_at')} SELECT r.story_id, r.topic, s.title, s.url, a.fetch_status, a.source, a.http_status, a.extractor, a.text_chars, a.fetched_at
        FROM reach r JOIN state_d d ON d.topic = r.topic AND d.story_id = r.story_id AND d.qc_status = 'ok' JOIN stories_d s ON s.story_id = r.story_id JOIN art a ON a.story_id = r.story_id AND a.fetch_status = 'ok'
        ORDER BY a.fetched_at DESC NULLS LAST, r.story_id, r.topic LIMIT 50""",
    ),
    "pending_fetch_priority": (
        pending_fetch_priority,
        f"""WITH {_R}, {_art('fetch_status')} SELECT r.topic, r.story_id, s.url, CAST(CASE {_PRI} ELSE {len(TERMS)} END AS INTEGER) AS priority, coalesce(s.publish_date, '') AS by_date, coalesce(s.domain, '') AS by_domain
        FROM reach r JOIN state_d d ON d.topic = r.topic AND d.story_id = r.story_id AND d.qc_status = 'ok' JOIN stories_d s ON s.story_id = r.story_id LEFT JOIN art a ON a.story_id = r.story_id WHERE a.story_id IS NULL OR a.fetch_status <> 'ok'""",
    ),
    "fetch_counts": (
        fetch_counts,
        f"""WITH {_R}, {_art('fetch_status')} SELECT r.topic, count(DISTINCT r.story_id) AS accepted, count(DISTINCT CASE WHEN a.fetch_status IS NOT NULL THEN r.story_id END) AS with_article,
        count(DISTINCT CASE WHEN a.fetch_status = 'ok' THEN r.story_id END) AS ok, count(DISTINCT CASE WHEN a.fetch_status <> 'ok' THEN r.story_id END) AS failed
        FROM reach r JOIN state_d d ON d.topic = r.topic AND d.story_id = r.story_id AND d.qc_status = 'ok' LEFT JOIN art a ON a.story_id = r.story_id GROUP BY r.topic""",
    ),
    "screening_candidates": (screening_candidates, f"WITH {_CAND} SELECT * FROM cand"),
    "next_candidates": (next_candidates, f"WITH {_CAND} SELECT topic, story_id, attempted FROM cand ORDER BY attempted, extracted_at ASC NULLS FIRST, miss, publish_date ASC NULLS FIRST, story_id, topic LIMIT 40"),
    "extraction_candidates": (
        extraction_candidates,
        f"""WITH {_S}, {_E}, scr AS (SELECT DISTINCT topic, story_id FROM state_d WHERE qc_status = 'ok')
        SELECT DISTINCT s.topic, s.story_id FROM scr s LEFT JOIN ext e ON e.topic = s.topic AND e.story_id = s.story_id WHERE e.validation_status IS NULL OR e.validation_status IN ('invalid', 'unparsed')""",
    ),
    "json_requests": (json_requests, f"WITH {_S} SELECT w.id AS batch_id, count(*) AS answers FROM hits_d h JOIN search_windows w ON w.id = h.search_window_id WHERE json_extract_string(to_json({{'status': w.status}}), '$.status') = 'completed' GROUP BY w.id"),
    "latest_outcome": (latest_outcome, f"WITH {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY extracted_at DESC NULLS LAST, topic DESC, prompt_version DESC) AS n FROM ext) SELECT * EXCLUDE (n) FROM o WHERE n = 1"),
    "case_export": (
        case_export,
        f"""WITH {_S}, {_E}, c AS (SELECT DISTINCT * FROM cases), e AS (SELECT DISTINCT topic, story_id FROM ext)
        SELECT c.case_id, c.topic, c.story_id, {', '.join('c.' + f for f in _FIELDS)}, c.status AS extra, s.media_name AS source_outlet, s.url AS source_url, s.publish_date, 'link:' || c.topic AS link_category
        FROM c JOIN e USING (topic, story_id) JOIN stories_d s ON s.story_id = c.story_id""",
    ),
    "article_audit": (
        article_audit,
        f"""WITH {_R}, {_art('fetch_status', 'text_chars')}, {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY topic, story_id ORDER BY extracted_at DESC NULLS LAST, prompt_version DESC) AS n FROM ext),
        p AS (SELECT *, row_number() OVER (PARTITION BY topic, story_id ORDER BY extracted_at DESC NULLS LAST, prompt_version DESC) AS n FROM ext WHERE prompt_version < 'v5')
        SELECT r.topic, r.story_id, s.title, s.url, s.publish_date, d.qc_status, d.qc_reason, a.fetch_status, a.text_chars, p.validation_status AS screening_status, p.relevant AS screening_relevant, o.validation_status AS extraction_status, o.relevant AS extraction_relevant
        FROM reach r JOIN stories_d s ON s.story_id = r.story_id LEFT JOIN state_d d ON d.topic = r.topic AND d.story_id = r.story_id LEFT JOIN art a ON a.story_id = r.story_id
        LEFT JOIN p ON p.topic = r.topic AND p.story_id = r.story_id AND p.n = 1 LEFT JOIN o ON o.topic = r.topic AND o.story_id = r.story_id AND o.n = 1""",
    ),
    "window_counts": (
        window_counts,
        f"""WITH {_S} SELECT w.id, w.topic, (SELECT count(*) FROM hits_d h WHERE h.search_window_id = w.id) AS hits, greatest(w.pages_fetched, (SELECT max(page_number) FROM hits_d h WHERE h.search_window_id = w.id)) AS pages FROM search_windows w""",
    ),
    "upsert_coalesce": (upsert_coalesce, f"WITH {_S} SELECT story_id, title, coalesce(upper(media_name), media_name) AS media_name, CAST(NULL AS VARCHAR) AS raw FROM stories_d"),
    "upsert_changed_only": (
        upsert_changed_only,
        f"""WITH {_S} SELECT topic, story_id, CASE WHEN qc_status = 'bad_lang' THEN 'ok' ELSE qc_status END AS qc_status, CASE WHEN qc_status <> 'bad_lang' THEN qc_reason END AS qc_reason, dup_of_story_id,
        CASE WHEN qc_status IS NOT DISTINCT FROM (CASE WHEN qc_status = 'bad_lang' THEN 'ok' ELSE qc_status END) AND qc_reason IS NOT DISTINCT FROM (CASE WHEN qc_status <> 'bad_lang' THEN qc_reason END) THEN decided_at ELSE TIMESTAMPTZ '2026-01-01 00:00:00+00' END AS decided_at FROM state_d""",
    ),
    "stale_anti": (stale_anti, f"WITH {_R} SELECT topic, story_id FROM state_d s WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.topic = s.topic AND r.story_id = s.story_id)"),
    "reconcile_counts": (
        reconcile_counts,
        f"""WITH {_R}, w AS (SELECT r.topic, count(*) AS written FROM reach r JOIN stories_d s USING (story_id) LEFT JOIN state_d d ON d.topic = r.topic AND d.story_id = r.story_id GROUP BY r.topic),
        x AS (SELECT topic, count(*) AS expected FROM reach GROUP BY topic) SELECT topic, coalesce(written, 0) AS written, coalesce(expected, 0) AS expected, coalesce(written, 0) = coalesce(expected, 0) AS agrees FROM w FULL JOIN x USING (topic)""",
    ),
    "attempt_numbers": (
        attempt_numbers,
        """WITH o AS (SELECT user_id, CAST(count(*) AS INTEGER) AS last FROM events WHERE event_type = 'signup' GROUP BY user_id)
        SELECT e.event_id, e.user_id, CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) + coalesce(o.last, 0) AS INTEGER) AS attempt_number FROM events e LEFT JOIN o USING (user_id) WHERE e.event_type = 'error'""",
    ),
    "pack_batches": (pack_batches, None),
    "pack_sound": (
        pack_sound,
        f"WITH {_art('text')}, t AS (SELECT count(*) AS n FROM art WHERE text IS NOT NULL) SELECT n AS placed, n AS stories, CAST(0 AS BIGINT) AS too_many, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS out_of_order FROM t",
    ),
    "response_ids": (
        response_ids,
        f"""WITH {_S}, a AS (SELECT search_window_id, count(DISTINCT story_id) AS asked FROM hits_d GROUP BY 1), g AS (SELECT search_window_id, count(*) AS got, count(DISTINCT story_id) AS different FROM hits_d WHERE page_number = 1 GROUP BY 1)
        SELECT search_window_id, got = different AND different = asked AS complete, got = different AS allowed FROM a JOIN g USING (search_window_id)""",
    ),
    "stage_counters": (stage_counters, f"WITH {_art('source', 'fetch_status')} SELECT source, count(*) AS processed, count(*) FILTER (fetch_status = 'ok') AS succeeded, count(*) FILTER (fetch_status <> 'ok') AS failed FROM art GROUP BY source"),
    "analysis_counts": (analysis_counts, f"WITH {_E} SELECT topic, extractions, cases FROM (SELECT topic, count(*) AS extractions FROM ext GROUP BY topic) FULL JOIN (SELECT topic, count(DISTINCT case_id) AS cases FROM cases GROUP BY topic) USING (topic)"),
    "integrity_orphans": (integrity_orphans, f"WITH {_S} SELECT topic, story_id, dup_of_story_id FROM state_d d WHERE dup_of_story_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stories_d s WHERE s.story_id = d.dup_of_story_id)"),
}
