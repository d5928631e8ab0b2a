"""Search pages as a stream: normalised, deduplicated within a watermark, added to the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.sources.pages import register, stories_of
from broadsheet.sources.store import Warehouse

STORY_COLUMNS = ("title", "url", "domain", "publish_date", "media_name", "media_url", "language", "indexed_at", "mc_text", "raw_json")


def fresh_stories(new: DataFrame, now) -> DataFrame:
    """Rows to add to the stored stories: the store keeps each column's newest non-null value, the newest raw_json and the first first_seen_at."""
    at = F.lit(now).cast("timestamp")
    return new.select("story_id", *STORY_COLUMNS, at.alias("first_seen_at"), at.alias("last_seen_at")).dropDuplicates(["story_id"])


def start(spark: SparkSession, warehouse: Warehouse, options: dict, page_size: int, checkpoint: str, watermark: str = "1 day") -> StreamingQuery:
    """Run the ``story_pages`` stream into the tables stories and search_hits."""
    register(spark)
    pages = spark.readStream.format("story_pages").options(**options).load()
    stories, _ = stories_of(pages, page_size)
    timed = stories.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", watermark)
    once = timed.dropDuplicatesWithinWatermark(["window_start", "window_end", "story_id"])

    def save(batch: DataFrame, _: int) -> None:
        batch = batch.withColumn("window_id", F.concat_ws("_", "window_start", "window_end"))
        now = batch.sparkSession.sql("SELECT current_timestamp()").first()[0]
        hits = batch.select("window_id", "story_id", "page_number", "result_rank", "raw_json", F.lit(now).alias("found_at"))
        warehouse.commit({}, {"stories": fresh_stories(batch, now), "search_hits": hits.dropDuplicates(["window_id", "story_id"])})

    return once.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()


def hit_counts(hits: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Hits per search window and tumbling time window of a stream with ``found_at``; late ones wait ``late``."""
    return hits.withWatermark("found_at", late).groupBy(F.window("found_at", every), "search_window_id").agg(F.count("*").alias("hits")).select(F.col("window.start").alias("from_time"), "search_window_id", "hits")
