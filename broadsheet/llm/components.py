"""Connected components of an edge list, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join of the edges with
those minima, so a hub with a third of all edges is one row on the joined side. The join has
the node's hash as a second key, so that the minima are shuffled for it as the edges are: only
then can the adaptive skew join split a hub's edges. Nothing is collected but counters per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.session import durable


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Edges (a, b), a > b, relinked to the smallest neighbour of a (or of either end)."""
    pairs = edges
    if not larger_only:
        pairs = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = pairs.withColumn("hash", F.hash("a")).join(least.withColumn("hash", F.hash("a")), ["a", "hash"])
    if larger_only:
        out = joined.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))))
    else:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in an edge; component is its smallest node.

    Null ends, loops and repeated edges are ignored. Raises if ``max_rounds`` don't suffice
    (the rounds needed grow with the logarithm of the longest path).
    """
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = durable(e.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        e = durable(_star(_star(e, larger_only=False), larger_only=True))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before:
            stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError("components did not settle")
