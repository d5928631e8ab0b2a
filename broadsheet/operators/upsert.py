"""Keyed changes over files that can't be updated in place: logs, latest views, guarded rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalesced(log: DataFrame, keys: Sequence[str], order: Sequence[str], replace: Sequence[str] = (), first: Sequence[str] = ()) -> DataFrame:
    """One row per key: for every column its latest non-null value, for ``replace`` columns the latest value, for ``first`` columns the earliest non-null one.

    A grouped maximum over (order, value), combined before the shuffle; no window, no sort.
    """
    rank = F.struct(*[F.col(c) for c in order])
    rest = [c for c in log.columns if c not in keys]

    def chosen(c: str):
        value, known = F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), rank)
        return (F.max_by(value, rank) if c in replace else F.min_by(value, known) if c in first else F.max_by(value, known))["v"].alias(c)

    return log.groupBy(*keys).agg(*[chosen(c) for c in rest])


def change_only(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], stamp: str, now) -> DataFrame:
    """New rows; ``stamp`` stays as it was where no value changed (null-safe), else becomes ``now``.

    Keys missing from ``new`` are gone from the result, as a rewrite of the key's partition drops them.
    """
    before = old.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(v).alias(f"__v_{v}") for v in values], F.col(stamp).alias("__stamp"), F.lit(True).alias("__had"))
    on = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    df = new.select(*keys, *values).join(before, on, "left")
    same = F.coalesce(F.col("__had"), F.lit(False))
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__v_{v}"))
    return df.select(*keys, *values, F.when(same, F.col("__stamp")).otherwise(F.lit(now)).alias(stamp))


def stale(states: DataFrame, reachable: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States that nothing reaches any more."""
    return states.join(reachable.select(*keys).distinct(), list(keys), "left_anti")


def numbered_attempts(previous: DataFrame, attempts: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """New attempts numbered on from the highest number a key already has."""
    from pyspark.sql import Window

    highest = previous.groupBy(key).agg(F.max("attempt_number").alias("__last"))
    within = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return attempts.withColumn("__n", within).join(highest, key, "left").withColumn("attempt_number", F.col("__n") + F.coalesce("__last", F.lit(0))).drop("__n", "__last")


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order`` (as ROW_NUMBER over the order, newest first, = 1)."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("__r")).select(*keys, "__r.*")
