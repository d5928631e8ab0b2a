"""A hub with a third of all edges, and a line with a third of a site's texts: the executed plans split them."""

from pyspark.sql import functions as F

from broadsheet.llm import components, sitelines
from broadsheet.session import durable
from tests.test_skew import eager_to_split  # noqa: F401


def test_a_hub_is_split(eager_to_split):  # noqa: F811
    hub = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") + 9).cast("long")
    edges = durable(eager_to_split.range(60_000).select((F.col("id") + 10).alias("a"), hub.alias("b")))
    star = components._star(edges, larger_only=False)
    star.collect()
    assert "skew=true" in star._jdf.queryExecution().executedPlan().toString()


def test_a_hot_line_is_split(eager_to_split):  # noqa: F811
    line = F.when(F.col("id") % 3 == 0, F.lit("the same line")).otherwise(F.concat(F.lit("x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")))
    rows = durable(eager_to_split.range(300_000).select(F.col("id").cast("string").alias("story_id"), F.lit("a.test").alias("domain"), line.alias("text")))
    found = sitelines.repeated_lines(rows)
    assert found.count() == 100_000
    found.collect()
    assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
