"""Joins on a key that holds a third of all rows: the executed plan splits it."""

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import quality
from broadsheet.session import durable

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
}


@pytest.fixture
def eager_to_split(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_url_is_split(eager_to_split):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") / 2).cast("int").cast("string"))
    nothing = F.lit(None).cast("string")
    states = durable(eager_to_split.range(60_000).select(F.col("id").cast("string").alias("story_id"), F.lit("2021-01-01").alias("publish_date"), key.alias("url_norm"), F.lit("ok").alias("qc_status"), nothing.alias("qc_reason"), nothing.alias("dup_of_story_id")))
    marked = quality.mark(states, "url_norm", "duplicate_url")
    assert sum(r.dup_of_story_id == "0" for r in marked.collect()) >= 19_999
    assert "skew=true" in marked._jdf.queryExecution().executedPlan().toString()
