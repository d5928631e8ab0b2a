"""Review and audit tables: what a topic reaches, decided, fetched and extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.quality import pending, title_hit, title_priority
from broadsheet.operators.upsert import latest


def reachable(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct (topic, story_id) of hits; the windows are few and broadcast only while they are small."""
    w = windows.select(F.col("id").alias("search_window_id"), "topic")
    return hits.join(w, "search_window_id").select("topic", "story_id").distinct()


def search_rows(hits: DataFrame, windows: DataFrame, stories: DataFrame) -> DataFrame:
    """Every hit with its window and story."""
    w = windows.select(F.col("id").alias("search_window_id"), "topic", "window_start", "window_end", "query_hash", F.col("status").alias("window_status"))
    s = stories.select("story_id", "title", "url", "domain", "publish_date", "media_name", "language")
    return hits.join(w, "search_window_id").join(s, "story_id")


def search_stats(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per topic: windows, completed, incomplete, pages, hits, distinct stories, repeated hits."""
    done = F.coalesce(F.col("pagination_completed").cast("boolean"), F.lit(False))
    per_window = windows.groupBy("topic").agg(F.count("*").alias("windows"), F.count_if(done).alias("completed_windows"), F.coalesce(F.sum("pages_fetched"), F.lit(0)).cast("long").alias("pages"))
    topic_hits = hits.join(windows.select(F.col("id").alias("search_window_id"), "topic"), "search_window_id")
    # Two-level count: distinct stories per topic first, so no topic is one reducer's set.
    per_story = topic_hits.groupBy("topic", "story_id").agg(F.count("*").alias("n"))
    per_hit = per_story.groupBy("topic").agg(F.sum("n").alias("hits"), F.count("*").alias("distinct_stories"))
    df = per_window.join(per_hit, "topic", "left").fillna(0, ["hits", "distinct_stories"])
    return df.withColumns({"incomplete_windows": F.col("windows") - F.col("completed_windows"), "duplicate_hits": F.col("hits") - F.col("distinct_stories")})


def dedup_rows(reach: DataFrame, stories: DataFrame, state: DataFrame) -> DataFrame:
    """Reachable stories with their decision and, for duplicates, the original's title and url."""
    original = stories.select(F.col("story_id").alias("dup_of_story_id"), F.col("title").alias("original_title"), F.col("url").alias("original_url"))
    s = stories.select("story_id", "title", "url", "domain", "publish_date", "media_name", "language")
    d = state.select("topic", "story_id", "qc_status", "qc_reason", "dup_of_story_id")
    return reach.join(s, "story_id").join(d, ["topic", "story_id"], "left").join(original, "dup_of_story_id", "left")


def dedup_stats(reach: DataFrame, state: DataFrame) -> DataFrame:
    """Counts of decisions per topic."""
    q, r = F.col("qc_status"), F.col("qc_reason")
    df = reach.join(state.select("topic", "story_id", "qc_status", "qc_reason"), ["topic", "story_id"], "left")
    out = df.groupBy("topic").agg(
        F.count("*").alias("stories"), F.count("qc_status").alias("decided"), F.count_if(q == "ok").alias("accepted"), F.count_if(q == "dup").alias("duplicates"),
        F.count_if(q.isNotNull() & ~q.isin("ok", "dup")).alias("rejected"), F.count_if(r == "duplicate_url").alias("duplicate_urls"), F.count_if(r == "duplicate_title").alias("duplicate_titles"),
    )
    return out.withColumn("undecided", F.col("stories") - F.col("decided"))


def fetch_rows(reach: DataFrame, state: DataFrame, stories: DataFrame, articles: DataFrame) -> DataFrame:
    """Accepted reachable stories whose article is held."""
    ok = state.filter("qc_status = 'ok'").select("topic", "story_id")
    got = articles.filter("fetch_status = 'ok'").select("story_id", "fetch_status", "source", "http_status", "extractor", "text_chars", "fetched_at")
    return reach.join(ok, ["topic", "story_id"]).join(stories.select("story_id", "title", "url"), "story_id").join(got, "story_id")


def newest(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest rows, as a top-k per partition and a merge; ties by story and topic."""
    if isinstance(most, bool) or not 1 <= most <= 100:
        raise ValueError("between 1 and 100 rows can be reviewed")
    return rows.orderBy(F.col("fetched_at").desc_nulls_last(), "story_id", "topic").limit(most)


def pending_rows(reach: DataFrame, state: DataFrame, stories: DataFrame, articles: DataFrame, terms: list[str]) -> DataFrame:
    """Accepted stories still to be fetched, with the keys they are fetched by in order."""
    ok = state.filter("qc_status = 'ok'").select("topic", "story_id")
    had = articles.select("story_id", "fetch_status", F.lit(True).alias("has_row"))
    df = reach.join(ok, ["topic", "story_id"]).join(stories.select("story_id", "title", "url", "domain", "publish_date"), "story_id").join(had, "story_id", "left")
    df = df.filter(pending(F.col("fetch_status"), F.coalesce("has_row", F.lit(False))))
    return df.select("topic", "story_id", "url", title_priority(F.col("title"), terms).alias("priority"), F.coalesce("publish_date", F.lit("")).alias("by_date"), F.coalesce("domain", F.lit("")).alias("by_domain"))


def fetch_counts(reach: DataFrame, state: DataFrame, articles: DataFrame) -> DataFrame:
    """Per topic: accepted stories, those with an article, with a good one, and failed ones."""
    ok = state.filter("qc_status = 'ok'").select("topic", "story_id")
    df = reach.join(ok, ["topic", "story_id"]).join(articles.select("story_id", "fetch_status"), "story_id", "left")
    once = df.groupBy("topic", "story_id").agg(F.max(F.col("fetch_status").isNotNull()).alias("a"), F.max(F.coalesce(F.col("fetch_status") == "ok", F.lit(False))).alias("g"), F.max(F.coalesce(F.col("fetch_status") != "ok", F.lit(False))).alias("f"))
    return once.groupBy("topic").agg(F.count("*").alias("accepted"), F.count_if("a").alias("with_article"), F.count_if("g").alias("ok"), F.count_if("f").alias("failed"))


def candidates(state: DataFrame, stories: DataFrame, articles: DataFrame, extractions: DataFrame, version: str, terms: list[str]) -> DataFrame:
    """Accepted stories with a non-blank text that this prompt version hasn't validly answered.

    Never attempted ones come first, then the longest waiting, then titles with a term; ``rank``
    gives that order within a topic without sorting the texts.
    """
    seen = extractions.filter(F.col("prompt_version") == version).select("topic", "story_id", "validation_status", "extracted_at")
    text = articles.filter((F.col("fetch_status") == "ok") & F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)).select("story_id", "text")
    df = state.filter("qc_status = 'ok'").select("topic", "story_id").join(stories.select("story_id", "title", "publish_date"), "story_id").join(text, "story_id")
    df = df.join(seen, ["topic", "story_id"], "left").filter(F.col("validation_status").isNull() | F.col("validation_status").isin("invalid", "unparsed"))
    attempted = F.col("validation_status").isNotNull().cast("int")
    return df.select("topic", "story_id", "title", "text", attempted.alias("attempted"), "extracted_at", title_hit(F.col("title"), terms).alias("miss"), "publish_date")


def relevant_candidates(screened: DataFrame, extracted: DataFrame) -> DataFrame:
    """(topic, story_id) judged relevant by a valid screening and not yet validly extracted."""
    yes = screened.filter("validation_status = 'valid' AND relevant").select("topic", "story_id").distinct()
    e = extracted.select("topic", "story_id", F.col("validation_status").alias("was"))
    return yes.join(e, ["topic", "story_id"], "left").filter(F.col("was").isNull() | F.col("was").isin("invalid", "unparsed")).select("topic", "story_id").distinct()


def of_requests(extractions: DataFrame, batches: DataFrame, path: str, value: str) -> DataFrame:
    """Extractions whose batch's request holds ``value`` at the JSON path (as the phase of a screening does)."""
    asked = batches.filter(F.get_json_object("request_json", path) == value).select("batch_id")
    return extractions.join(asked, "batch_id")


def case_rows(cases: DataFrame, extractions: DataFrame, stories: DataFrame, fields: list[str], link_category: Column) -> DataFrame:
    """Cases with their story; a configured field is the stored JSON's value, else the column's, if there is one."""
    held = [F.coalesce(F.get_json_object("raw_json", f"$.{f}"), F.col(f)).alias(f) if f in cases.columns else F.get_json_object("raw_json", f"$.{f}").alias(f) for f in fields]
    c = cases.select("case_id", "topic", "story_id", *held)
    s = stories.select("story_id", F.col("media_name").alias("source_outlet"), F.col("url").alias("source_url"), "publish_date")
    return c.join(extractions.select("topic", "story_id").distinct(), ["topic", "story_id"]).join(s, "story_id").withColumn("link_category", link_category)


def audit(reach: DataFrame, stories: DataFrame, state: DataFrame, articles: DataFrame, screenings: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row per reachable story with its decision, article and latest answers of both phases."""
    s = stories.select("story_id", "title", "url", "publish_date")
    d = state.select("topic", "story_id", "qc_status", "qc_reason")
    a = articles.select("story_id", "fetch_status", "text_chars")
    last = lambda df, p: latest(df.select("topic", "story_id", "extracted_at", "prompt_version", "validation_status", "relevant"), ["topic", "story_id"], ["extracted_at", "prompt_version"]).select(
        "topic", "story_id", F.col("validation_status").alias(f"{p}_status"), F.col("relevant").alias(f"{p}_relevant")
    )
    df = reach.join(s, "story_id").join(d, ["topic", "story_id"], "left").join(a, "story_id", "left")
    return df.join(last(screenings, "screening"), ["topic", "story_id"], "left").join(last(extractions, "extraction"), ["topic", "story_id"], "left")


def reconciled(written: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Rows written and expected per key, and whether they agree (two independent counts)."""
    a = written.groupBy(*by).agg(F.count("*").alias("written"))
    b = expected.groupBy(*by).agg(F.count("*").alias("expected"))
    df = a.join(b, by, "full").fillna(0, ["written", "expected"])
    return df.withColumn("agrees", F.col("written") == F.col("expected"))
