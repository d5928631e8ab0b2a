"""Whole stages over a warehouse: search, decisions, acquisition, extraction, export.

Every stage reads the newest commit, builds its result lazily and commits it at once, so a rerun
of an unchanged input changes nothing and a failure leaves the last commit in place.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import importlib.metadata
import json
import subprocess
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.config import AppConfig, TopicConfig
from broadsheet.errors import ConfigurationError, EngineError, ExtractionFailure
from broadsheet.functions.html import extract
from broadsheet.functions.text import canonical_hash, canonical_json, year_prefix
from broadsheet.operators import acquire, batches, quality, review, upsert, windows
from broadsheet.schemas import conform
from broadsheet.session import durable, numbered
from broadsheet.sources import csv_files, pages, web
from broadsheet.sources.store import Warehouse

# Column orders of the exported files.
AUDIT_COLUMNS = (
    "topic", "story_id", "title", "url", "publish_date", "qc_status", "qc_reason", "fetch_status", "text_chars",
    "screening_status", "screening_relevant", "extraction_status", "extraction_relevant",
)
CASE_HEAD = ("case_id", "topic", "link_category", "story_id", "source_outlet", "source_url", "publish_date")


@dataclasses.dataclass(frozen=True)
class Summary:
    topic: str
    processed: int
    succeeded: int
    skipped: int
    failed: int
    details: tuple[str, ...] = ()

    def __str__(self) -> str:
        head = f"{self.topic}: processed {self.processed}, succeeded {self.succeeded}, skipped {self.skipped}, failed {self.failed}"
        return "\n".join((head, *self.details))


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def revision() -> str:
    """Revision of the working tree, with a mark if it has changes; ``unknown`` outside one."""
    try:
        run = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, check=True, cwd=Path(__file__).parent).stdout.strip()
        return run("rev-parse", "HEAD") + ("-changed" if run("status", "--porcelain") else "")
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def package_version(name: str) -> str:
    try:
        return importlib.metadata.version(name)
    except importlib.metadata.PackageNotFoundError:
        return "unknown"


def provenance(config: AppConfig, topic: str) -> dict[str, str]:
    settings = dataclasses.asdict(config.topic(topic)) | {"fetch": dataclasses.asdict(config.fetch), "model": dataclasses.asdict(config.model), "search": dataclasses.asdict(config.search)}
    versions = {"pyspark": package_version("pyspark"), "pandas": package_version("pandas")}
    return {"config_hash": canonical_hash(settings), "config_json": canonical_json(settings), "revision": revision(), "versions_json": canonical_json(versions)}


def recorded(store: Warehouse, config: AppConfig, topic: str, stage: str, body: Callable[[], tuple[dict[str, DataFrame], Summary]]) -> Summary:
    """Run a stage and commit its tables together with its run record; a failure is recorded and raised again."""
    facts = {"run_uuid": str(uuid.uuid4()), "topic": topic, "stage": stage, **provenance(config, topic)}

    def runs(status: str, error: str | None) -> DataFrame:
        from broadsheet.schemas import schema

        old = store.read("pipeline_runs")
        row = facts | {"status": status, "error": error and error[:1000], "at": now()}
        names = schema("pipeline_runs").names
        return old.unionByName(store.spark.createDataFrame([tuple(row.get(n) for n in names)], schema("pipeline_runs")))

    try:
        changes, summary = body()
        store.commit(changes | {"pipeline_runs": runs("complete", None)})
        return summary
    except EngineError as e:
        store.commit({"pipeline_runs": runs("failed", str(e))})
        raise


# search ------------------------------------------------------------------------


def planned_windows(store: Warehouse, config: AppConfig, topic_name: str) -> DataFrame:
    """The topic's windows with their fingerprint and what is stored of them (few rows)."""
    topic = config.topic(topic_name)
    inputs = {"query": topic.query, "platform": config.search.platform, "collections": topic.collection_ids, "sources": topic.source_ids, "languages": topic.languages}
    rows = windows.date_windows(store.spark, topic.start_date, topic.end_date, config.search.window_days).collect()
    hashed = [(topic_name, windows.query_hash(**inputs), windows.fingerprint(r.window_start, r.window_end, **inputs), r.ordinal, r.window_start, r.window_end) for r in rows]
    made = store.spark.createDataFrame(hashed, "topic string, query_hash string, request_fingerprint string, ordinal int, window_start date, window_end date")
    made = made.withColumn("window_id", F.sha2(F.concat_ws("|", "topic", "request_fingerprint", "window_start", "window_end"), 256))
    old = store.read("search_windows").select("window_id", "relevant_count", "total_count", "pages_fetched", "pagination_completed", "next_pagination_token", "raw_json")
    stored = F.get_json_object("raw_json", "$.page_size").try_cast("int")
    return windows.resume_state(made.join(old, "window_id", "left"), config.search.page_size, stored)


def probe(store: Warehouse, config: AppConfig, topic_name: str, client: pages.SearchClient, most: int = 1, size: int = 10) -> list[str]:
    """One JSON line per window: its counts and what the first page of at most ten stories holds. Nothing is stored."""
    topic = config.topic(topic_name)
    lines = []
    for r in sorted(planned_windows(store, config, topic_name).collect(), key=lambda r: r.ordinal)[:most]:
        relevant, total = client.story_count(topic.query, r.window_start, r.window_end)
        stories, token = client.story_list(topic.query, r.window_start, r.window_end, None, min(size, 10))
        texts = sum(isinstance(s.get("text"), str) and bool(s["text"]) for s in stories)
        lines.append(canonical_json({"window": f"{r.window_start}..{r.window_end}", "relevant": relevant, "total": total, "page": len(stories), "with_text": texts, "more": token is not None}))
    return lines


def estimate(store: Warehouse, config: AppConfig, topic_name: str, options: dict) -> Summary:
    """Count each window not counted or completed yet."""
    topic = config.topic(topic_name)
    plan = planned_windows(store, config, topic_name)
    todo = [r for r in plan.collect() if r.resume != "complete" and r.relevant_count is None]  # a topic has few windows

    def body():
        if not todo:
            return {}, Summary(topic_name, 0, 0, plan.count(), 0)
        pages.register(store.spark)
        spans = json.dumps([[str(r.window_start), str(r.window_end)] for r in todo])
        counted = store.spark.read.format("story_pages").options(**options, windows=spans, query=topic.query, mode="count", retries=str(config.search.max_retries)).load()
        got = plan.drop("relevant_count", "total_count").join(counted, ["window_start", "window_end"])
        got = got.withColumns({"status": F.lit("counted"), "query": F.lit(topic.query), "platform": F.lit(config.search.platform)})
        kept = store.read("search_windows").join(got.select("window_id"), "window_id", "left_anti")
        return {"search_windows": kept.unionByName(conform(got, "search_windows"))}, Summary(topic_name, len(todo), len(todo), plan.count() - len(todo), 0)

    return recorded(store, config, topic_name, "estimate", body)


def search(store: Warehouse, config: AppConfig, topic_name: str, client: pages.SearchClient, limit: int | None = None, dry_run: bool = False) -> Summary:
    """Page through the windows that aren't complete; each page is committed before the next is asked for.

    Completed windows are skipped, interrupted ones go on from their token, windows that can't go
    on fail without a call, and one window's failure doesn't stop the others.
    """
    from broadsheet.operators.pacing import with_retries
    from broadsheet.streaming.ingest import fresh_stories

    topic = config.topic(topic_name)
    plan = sorted(planned_windows(store, config, topic_name).collect(), key=lambda r: r.ordinal)[: limit if limit else None]
    if dry_run:
        return Summary(topic_name, len(plan), 0, len(plan), 0, tuple(f"{r.window_start} {r.window_end} {r.resume}" for r in plan[:20]))
    spark, size = store.spark, config.search.page_size
    done = skipped = failed = 0
    bad: list[str] = []

    def save(r, status: str, page: int, token: str | None, error: str | None, rows: list) -> None:
        at = now()
        state = spark.createDataFrame([(r.window_id, topic_name, r.query_hash, r.request_fingerprint, topic.query, config.search.platform, r.window_start, r.window_end, r.relevant_count, r.total_count, page, status == "complete", token, status, at if status == "complete" else None, error, json.dumps({"page_size": size}))],
            "window_id string, topic string, query_hash string, request_fingerprint string, query string, platform string, window_start date, window_end date, relevant_count long, total_count long, pages_fetched int, pagination_completed boolean, next_pagination_token string, status string, completed_at timestamp, error string, raw_json string")
        changes = {"search_windows": store.read("search_windows").filter(F.col("window_id") != r.window_id).unionByName(conform(state, "search_windows"))}
        added = {}
        if rows:
            got, broken = pages.stories_of(spark.createDataFrame(rows, pages.PAGE_SCHEMA), size)
            bad.extend(f"rank {b.result_rank}: {b.error}" for b in broken.select("result_rank", "error").collect())  # of one page
            hits = got.select(F.lit(r.window_id).alias("window_id"), "story_id", "page_number", "result_rank", "raw_json", F.lit(at).alias("found_at"))
            # Of a story that stands twice on a page the later row counts; a page is small.
            last = got.groupBy("story_id").agg(F.max_by(F.struct(*[c for c in got.columns if c != "story_id"]), "result_rank").alias("r")).select("story_id", "r.*")
            added = {"stories": fresh_stories(last, at), "search_hits": hits.dropDuplicates(["window_id", "story_id"])}
        store.commit(changes, added)

    for r in plan:
        if r.resume == "complete":
            skipped += 1
            continue
        if r.resume.startswith("failed"):
            save(r, "failed", r.pages_fetched or 0, r.next_pagination_token, r.resume, [])
            failed += 1
            continue
        page, token = r.pages_fetched or 0, r.next_pagination_token
        try:
            while True:
                if page >= config.search.max_pages_per_window:
                    save(r, "page_limit", page, token, None, [])
                    skipped += 1
                    break
                stories, token = with_retries(lambda t=token: client.story_list(topic.query, r.window_start, r.window_end, t, size), config.search.max_retries, pages.transient)
                page += 1
                rows = [(r.window_start, r.window_end, page, i + 1, token, json.dumps(s, ensure_ascii=False, default=str)) for i, s in enumerate(stories)]
                save(r, "complete" if token is None else "running", page, token, None, rows)
                if token is None:
                    done += 1
                    break
        except (OSError, ValueError, KeyError, EngineError, pages.ClientError) as e:  # one window's failure is its own; bugs aren't failures of a window
            save(r, "failed", page, token, str(e)[:1000], [])
            failed += 1
    return recorded(store, config, topic_name, "search", lambda: ({}, Summary(topic_name, len(plan), done, skipped, failed, tuple(bad[:20]))))


# decisions ---------------------------------------------------------------------


def topic_reach(store: Warehouse, topic: str) -> DataFrame:
    w = store.read("search_windows").filter(F.col("topic") == topic).select("window_id", "topic")
    return store.read("search_hits").select("window_id", "story_id").join(w, "window_id").select("topic", "story_id").distinct()


def dedup(store: Warehouse, config: AppConfig, topic_name: str) -> Summary:
    """Decide every reachable story anew; unchanged decisions keep their time, unreachable ones go."""
    topic = config.topic(topic_name)

    def body():
        reach = topic_reach(store, topic_name)
        stories = store.read("stories").join(reach.select("story_id"), "story_id", "left_semi")
        states = durable(quality.deduplicate(stories, topic).withColumn("topic", F.lit(topic_name)))
        old = store.read("story_topic_state")
        mine = upsert.change_only(old.filter(F.col("topic") == topic_name), states, ["topic", "story_id"], ["qc_status", "qc_reason", "dup_of_story_id"], "decided_at", now())
        norms = states.select("story_id", F.col("url_norm").alias("un"), F.col("title_norm").alias("tn"))
        with_norms = store.read("stories").join(norms, "story_id", "left").withColumns({"url_norm": F.coalesce("un", "url_norm"), "title_norm": F.coalesce("tn", "title_norm")})
        r = quality.summary(states, topic_name).first()
        return {"story_topic_state": store.replace_topic("story_topic_state", topic_name, mine), "stories": with_norms}, Summary(topic_name, r.processed, r.succeeded, r.skipped, r.failed)

    return recorded(store, config, topic_name, "dedup", body)


# acquisition -------------------------------------------------------------------


def read_pages(store: Warehouse, config: AppConfig, todo: DataFrame, transport, lanes: int) -> DataFrame:
    """Pages of ``todo`` (story_id, url) from the network, stored before anything is made of them."""
    asked = durable(web.fetch_pages(todo, config.fetch, transport, lanes))
    page = asked.filter("kind = 'page'")
    at = now()
    kept = store.read("raw_pages")
    fresh = page.filter("html IS NOT NULL").select("story_id", "html", "http_status", "content_type", "final_url", F.lit(at).alias("fetched_at"))
    log = store.read("fetch_attempts")
    tried = asked.select("story_id", F.col("kind").alias("source"), "request_url", "final_url", "http_status", "elapsed_ms", F.col("retry_after").try_cast("double").alias("retry_after_s"), "error", F.lit(at).alias("attempted_at"))
    tried = tried.filter("request_url IS NOT NULL")
    numbered = upsert.numbered_attempts(log, conform(tried, "fetch_attempts").drop("attempt_number"), "story_id", ["attempted_at", F.col("source").desc()]).select(*log.columns)
    store.commit({"raw_pages": kept.join(fresh.select("story_id"), "story_id", "left_anti").unionByName(conform(fresh, "raw_pages")), "fetch_attempts": log.unionByName(numbered)})
    return page


def fetch(store: Warehouse, config: AppConfig, topic_name: str, raw_html: DataFrame | None = None, limit: int | None = None, dry_run: bool = False, transport=None, lanes: int = 1) -> Summary:
    """Texts of pending stories from the provider's text, stored HTML or the network.

    HTML is taken from ``raw_html`` (story_id, html, http_status, content_type), else from pages read
    before; with a ``transport`` the rest is read from the network in ``lanes`` (see
    :mod:`broadsheet.sources.web`) and stored, else it stays pending.
    """
    topic = config.topic(topic_name)
    least = config.fetch.min_text_chars
    reach = topic_reach(store, topic_name)
    articles = store.read("articles")
    todo = review.pending_rows(reach, store.read("story_topic_state"), store.read("stories"), articles, list(topic.priority_terms))
    ordered = todo.orderBy("priority", "by_date", "by_domain", "story_id")
    todo = ordered.limit(limit) if limit else ordered
    stored = raw_html if raw_html is not None else store.read("raw_pages").select("story_id", "html", "http_status", "content_type")
    df = todo.select("story_id", "url").join(store.read("stories").select("story_id", "mc_text"), "story_id").join(stored, "story_id", "left")
    df = df.withColumn("source", acquire.source_plan(F.col("mc_text"), F.col("html"), least))
    if dry_run:
        counts = {r.source: r["count"] for r in df.groupBy("source").count().collect()}
        n = sum(counts.values())
        head = tuple(f"{r.story_id} {r.source}" for r in df.limit(20).collect())
        return Summary(topic_name, n, 0, n, 0, (json.dumps(counts, sort_keys=True), *head, *([f"and {n - 20} more"] if n > 20 else [])))

    def body():
        found = F.col("found")
        nonlocal df
        df = df.withColumn("read_status", F.lit(None).cast("string"))
        if transport is not None:
            got = read_pages(store, config, df.filter("source = 'url'").select("story_id", "url"), transport, lanes)
            got = got.select("story_id", F.col("html").alias("h"), F.col("http_status").alias("s"), F.col("content_type").alias("c"), F.col("status").alias("r"))
            df = df.join(got, "story_id", "left").select("story_id", "url", "mc_text", F.coalesce("html", "h").alias("html"), F.coalesce("http_status", "s").alias("http_status"), F.coalesce("content_type", "c").alias("content_type"), F.when(F.col("r").isNull(), F.col("source")).otherwise("page").alias("source"), F.col("r").alias("read_status"))
        df = durable(df.withColumn("found", extract(F.col("html"), least)))
        text = F.when(F.col("source") == "provider", F.col("mc_text")).otherwise(found["text"])
        status = F.when(F.col("source") == "provider", "ok").when(F.col("read_status") != "read", F.col("read_status")).otherwise(
            acquire.outcome(F.coalesce("url", F.lit("https://stored/")), F.lit("allowed"), F.coalesce("http_status", F.lit(200)), F.coalesce("content_type", F.lit("text/html")), F.octet_length("html"), text, config.fetch.max_response_bytes, least)
        )
        got = df.filter("source <> 'url'").select("story_id", status.alias("fetch_status"), "source", "http_status", F.col("url").alias("final_url"), F.when(F.col("source") == "provider", "provider").otherwise(found["extractor"]).alias("extractor"), text.alias("text"), F.length(text).cast("long").alias("text_chars"), F.lit(now()).alias("fetched_at"))
        got = durable(got)
        kept = articles.join(got.select("story_id"), "story_id", "left_anti")
        tried = conform(got.filter("source = 'stored_html'").withColumn("attempted_at", F.col("fetched_at")).drop("attempt_number"), "fetch_attempts").drop("attempt_number")
        log = store.read("fetch_attempts")
        numbered = upsert.numbered_attempts(log, tried, "story_id", ["attempted_at"]).select(*log.columns)
        ok = got.filter("fetch_status = 'ok'").count()
        n, total = got.count(), df.count()
        return {"articles": kept.unionByName(conform(got, "articles")), "fetch_attempts": log.unionByName(numbered)}, Summary(topic_name, total, ok, total - n, n - ok)

    return recorded(store, config, topic_name, "fetch", body)


# extraction --------------------------------------------------------------------


def system_prompt(phase: str) -> str:
    return "You read news articles. Return only JSON that fits the schema you are given. Never add keys."


def prompt_head(topic: TopicConfig, phase: str) -> str:
    """What a prompt says before its articles."""
    if phase == "screening":
        return f"For every article say whether it is relevant.\nRelevant means: {topic.relevance or topic.query}\n\n"
    wanted = "\n".join(f"- {f.name}: {f.description or 'as written in the article'}, or null" for f in topic.fields)
    return f"List the cases each article reports. Relevant means: {topic.relevance or topic.query}\nFields of a case:\n{wanted}\n\n"


def planned_batches(store: Warehouse, config: AppConfig, topic_name: str, phase: str, limit: int | None = None) -> DataFrame:
    """topic, shard, batch_no, position, story_id, text of the work still to do, best first."""
    topic = config.topic(topic_name)
    state = store.read("story_topic_state").filter(F.col("topic") == topic_name)
    done = store.read("story_extractions").filter(F.col("topic") == topic_name)
    df = review.candidates(state, store.read("stories"), store.read("articles"), done, config.model.version(phase), list(topic.priority_terms))
    if phase == "extraction":
        yes = done.filter((F.col("prompt_version") == config.model.version("screening")) & (F.col("validation_status") == "valid") & F.col("relevant"))
        df = df.join(yes.select("story_id"), "story_id", "left_semi")
    # Places are made without the texts; they depend on the order alone, so the same work gives the same batches.
    order = ("attempted", F.col("extracted_at").asc_nulls_first(), "miss", F.col("publish_date").asc_nulls_first(), "story_id")
    place = numbered(df.drop("text", "title"), *order).select("story_id", "ordinal")
    place = place.filter(F.col("ordinal") < limit) if limit else place
    ranked = df.join(place, "story_id").withColumn("year", year_prefix(F.col("publish_date")))
    most = config.model.max_articles_per_batch if phase == "extraction" else None
    return batches.packed(ranked, config.model.budget(phase), most, prompt_head(topic, phase), system_prompt(phase))


def requests(planned: DataFrame, topic: TopicConfig, phase: str) -> DataFrame:
    """batch_id, prompt, expected: the whole text of each request (a batch is bounded by its cap)."""
    block = batches.article_text(F.col("story_id"), F.col("title"), F.col("text"), F.col("year"))
    one = planned.groupBy("topic", "shard", "batch_no").agg(F.array_sort(F.collect_list(F.struct("position", "story_id", block.alias("block")))).alias("a"))
    head = prompt_head(topic, phase)
    return one.select(
        F.concat_ws("-", F.lit(phase), "topic", "shard", "batch_no").alias("batch_id"),
        F.concat(F.lit(head), F.array_join(F.col("a.block"), "\n\n")).alias("prompt"),
        F.col("a.story_id").alias("expected"),
    )


def answers_name(config: AppConfig, topic_name: str, phase: str) -> str:
    return f"{topic_name}/{phase}-{config.model.version(phase)}-{canonical_hash(batches.response_schema(config.topic(topic_name).fields, phase))[:12]}"


ANSWERS = "batch_id string, prompt_hash string, prompt string, expected array<string>, content string, attempts int, error string, provenance string"


def answered(store: Warehouse, wanted: DataFrame, name: str, client, attempts: int, per_minute: float | None, report: Callable[[str], None] | None = None) -> DataFrame:
    """Answers for ``wanted`` (batch_id, prompt_hash, prompt, expected), each written as it comes.

    The model is asked for one batch after another, at the configured rate; that is the bound, not
    the driver, which holds one partition of prompts at a time. A run that stops goes on where it
    was: what was answered (the same prompt for the same version) isn't asked for again, failures
    are. Once the phase is committed its answers are removed, so a later run asks anew.
    """
    from broadsheet.operators.pacing import TokenBucket

    spark, path = store.spark, f"{store.root}/_answers/{name}"
    have = spark.read.schema(ANSWERS).parquet(path) if store.exists(f"_answers/{name}") else spark.createDataFrame([], ANSWERS)
    todo = wanted.join(have.filter("content IS NOT NULL").select("prompt_hash").distinct(), "prompt_hash", "left_anti").orderBy("batch_id")
    bucket = TokenBucket(per_minute / 60, 1) if per_minute else None
    total, failed = todo.count(), 0
    for i, r in enumerate(todo.toLocalIterator(prefetchPartitions=False)):
        content, error, used = batches.ask(client, r.prompt, attempts, bucket)
        failed += content is None
        provenance = canonical_json(getattr(client, "last", None) or {})
        spark.createDataFrame([(r.batch_id, r.prompt_hash, r.prompt, r.expected, content, used, error, provenance)], ANSWERS).write.mode("append").parquet(path)
        if report:
            report(f"{i + 1}/{total} {r.batch_id[:60]} {'failed' if content is None else 'answered'}, failed {failed}")
    if not store.exists(f"_answers/{name}"):
        return have
    got = spark.read.schema(ANSWERS).parquet(path).join(wanted.select("prompt_hash"), "prompt_hash", "left_semi")
    # A prompt asked again after a failure has several rows: an answer stands before a failure.
    last = got.groupBy("prompt_hash").agg(F.max_by(F.struct("batch_id", "prompt", "expected", "content", "attempts", "error", "provenance"), F.struct(F.col("content").isNotNull(), "batch_id")).alias("r"))
    return durable(last.select("prompt_hash", "r.*"))


def run_phase(store: Warehouse, config: AppConfig, topic_name: str, phase: str, client, limit: int | None = None) -> tuple[dict[str, DataFrame], Summary]:
    topic, version = config.topic(topic_name), config.model.version(phase)
    wanted = durable(requests(planned_batches(store, config, topic_name, phase, limit), topic, phase).withColumn("prompt_hash", F.sha2("prompt", 256)))
    at = now()
    schema_hash = canonical_hash(batches.response_schema(topic.fields, phase))
    facts = {"topic": topic_name, "phase": phase, "model": config.model.model, "prompt_version": version, "schema_hash": schema_hash}
    pending = wanted.select("batch_id", "prompt_hash", F.lit("pending").alias("status"), F.to_json("expected").alias("story_ids_json"), F.to_json(F.struct("prompt")).alias("request_json"), F.lit(at).alias("at"), *[F.lit(v).alias(k) for k, v in facts.items()])
    mine = (F.col("topic") == topic_name) & (F.col("phase") == phase) & (F.col("status") == "pending")
    store.commit({"extraction_batches": store.read("extraction_batches").filter(~F.coalesce(mine, F.lit(False))).unionByName(conform(pending, "extraction_batches"))})
    answers = answered(store, wanted, answers_name(config, topic_name, phase), client, config.model.max_retries + 1, config.model.max_requests_per_min)
    results = durable(batches.checked(answers, topic.fields, phase))
    at = now()
    rows = results.select(
        F.lit(topic_name).alias("topic"), "story_id", F.lit(version).alias("prompt_version"), "batch_id", "relevant", F.when(F.col("omitted"), "omitted_from_response").alias("reject_reason"),
        "validation_status", "validation_error", "payload_json", F.lit(at).alias("extracted_at"),
    )
    old = store.read("story_extractions")
    kept = old.join(rows.select("topic", "story_id", "prompt_version"), ["topic", "story_id", "prompt_version"], "left_anti")
    changes = {"story_extractions": kept.unionByName(conform(rows, "story_extractions"))}
    log = answers.select("batch_id", "prompt_hash", F.when(F.col("content").isNull(), "failed").otherwise("answered").alias("status"), F.to_json("expected").alias("story_ids_json"), F.to_json(F.struct("prompt")).alias("request_json"), F.col("attempts").alias("attempt_count"), F.col("content").alias("response_json"), F.col("provenance").alias("usage_json"), F.lit(at).alias("at"), *[F.lit(v).alias(k) for k, v in facts.items()])
    changes["extraction_batches"] = store.read("extraction_batches").filter(~F.coalesce(mine, F.lit(False))).unionByName(conform(log, "extraction_batches"))
    if phase == "extraction":
        made = batches.case_rows(results, topic.fields, topic_name, version).withColumns({"prompt_version": F.lit(version), "created_at": F.lit(at)})
        names = [f.name for f in topic.fields]
        made = made.withColumn("raw_json", F.to_json(F.struct(*names))) if names else made
        before = store.read("cases").join(rows.select("topic", "story_id", "prompt_version"), ["topic", "story_id", "prompt_version"], "left_anti")
        changes["cases"] = before.unionByName(conform(made, "cases"))
    counts = results.agg(F.count("*").alias("n"), F.count_if(F.col("validation_status") == "valid").alias("valid")).first()
    total, valid = counts.n, counts.valid
    return changes, Summary(topic_name, total, valid, 0, total - valid)


def answer_phase(store: Warehouse, config: AppConfig, topic_name: str, phase: str, client, limit: int | None = None) -> Summary:
    done = recorded(store, config, topic_name, phase, lambda: run_phase(store, config, topic_name, phase, client, limit))
    store.remove(f"_answers/{answers_name(config, topic_name, phase)}")
    return done


def plan_summary(store: Warehouse, config: AppConfig, topic_name: str, phase: str, limit: int | None = None) -> Summary:
    """What a phase would ask for: one JSON line per planned batch, the first 20 of them."""
    planned = planned_batches(store, config, topic_name, phase, limit)
    each = planned.groupBy("shard", "batch_no").agg(F.array_sort(F.collect_list(F.struct("position", "story_id"))).alias("a"), F.sum(F.octet_length(F.encode("text", "UTF-8"))).alias("bytes"))
    each = durable(each.select("shard", "batch_no", F.col("a.story_id").alias("stories"), "bytes"))
    lines = tuple(r.line for r in each.orderBy("shard", "batch_no").limit(20).select(F.to_json(F.struct(F.lit(phase).alias("phase"), "shard", "batch_no", "stories", "bytes")).alias("line")).collect())
    n = each.agg(F.coalesce(F.sum(F.size("stories")), F.lit(0)).alias("n")).first().n
    return Summary(topic_name, n, 0, n, 0, lines)


def extract_cases(store: Warehouse, config: AppConfig, topic_name: str, client: Callable[[str], str], limit: int | None = None) -> tuple[Summary, Summary]:
    """Screen what is new, then extract what has become relevant, each phase committed on its own."""
    return answer_phase(store, config, topic_name, "screening", client, limit), answer_phase(store, config, topic_name, "extraction", client, limit)


def reset(store: Warehouse, topic: str) -> None:
    """Forget a topic's answers and cases; earlier commits still hold them."""
    store.commit({t: store.read(t).filter(F.col("topic") != topic) for t in ("cases", "story_extractions")})


# export ------------------------------------------------------------------------


def export(store: Warehouse, config: AppConfig, topic_name: str, folder: str | Path) -> Summary:
    """Case and audit files, written together and reconciled with independent counts."""
    topic = config.topic(topic_name)
    mine = lambda t: store.read(t).filter(F.col("topic") == topic_name)
    version = config.model.version("extraction")
    answers = mine("story_extractions")
    names = [f.name for f in topic.fields]
    columns = [*CASE_HEAD, *names]
    if len(set(columns)) != len(columns):
        raise ConfigurationError("a configured field has the name of an exported column")
    cases = mine("cases").filter(F.col("prompt_version") == version)
    rows = review.case_rows(cases, answers.filter(F.col("prompt_version") == version), store.read("stories"), names, F.lit(topic.label)).orderBy("publish_date", "story_id", "case_id")
    reach = topic_reach(store, topic_name)
    screened = answers.filter(F.col("prompt_version") == config.model.version("screening"))
    audited = review.audit(reach, store.read("stories"), mine("story_topic_state"), store.read("articles"), screened, answers.filter(F.col("prompt_version") == version)).orderBy("publish_date", "story_id")
    folder = Path(folder)
    written = csv_files.write(
        [(folder / f"{topic_name}_cases.csv", rows, columns, cases.count()), (folder / f"{topic_name}_audit.csv", audited, AUDIT_COLUMNS, reach.count())]
    )
    return Summary(topic_name, sum(written), sum(written), 0, 0)


def review_csv(store: Warehouse, topic_name: str, kind: str, path: str | Path, limit: int = 100) -> int:
    """Review file of a stage: search, dedup or fetch."""
    reach = topic_reach(store, topic_name)
    stories, state = store.read("stories"), store.read("story_topic_state").filter(F.col("topic") == topic_name)
    if kind == "search":
        hits = store.read("search_hits").withColumnRenamed("window_id", "search_window_id").drop("raw_json")
        w = store.read("search_windows").filter(F.col("topic") == topic_name).withColumnRenamed("window_id", "id")
        df = review.search_rows(hits, w, stories).orderBy("window_start", "window_end", "page_number", "result_rank", "story_id")
    elif kind == "dedup":
        df = review.dedup_rows(reach, stories, state).orderBy("publish_date", "story_id")
    elif kind == "fetch":
        df = review.newest(review.fetch_rows(reach, state, stories, store.read("articles")), limit)
    else:
        raise ConfigurationError(f"no review of {kind}")
    return csv_files.write([(path, df, df.columns, df.count())])[0]


def manual_request(store: Warehouse, config: AppConfig, topic_name: str, phase: str, number: int = 0) -> str:
    """The n-th planned request of a phase as text."""
    planned = planned_batches(store, config, topic_name, phase).filter(F.col("batch_no") == number)
    row = requests(planned, config.topic(topic_name), phase).orderBy("batch_id").first()
    if row is None:
        raise ExtractionFailure(f"no planned request {number}")
    schema = canonical_json(batches.response_schema(config.topic(topic_name).fields, phase))
    return f"# system\n{system_prompt(phase)}\n# schema\n{schema}\n# stories\n{json.dumps(list(row.expected))}\n# user\n{row.prompt}\n"
