"""The best representative of each group of duplicates, and the record fused from the group.

Groups are the connected components of the duplicate ties of a topic. For every group and field
the distinct values its members state are candidate facts; an outlet that states something for
the field either claims a fact or, by stating something else, denies it. A latent two-sided
quality model gives each outlet a sensitivity (share of true facts it claims) and a specificity
(share of false facts it doesn't claim), both inferred with the truth of the facts by
expectation-maximisation, run until no outlet's quality changes by more than ``TOLERANCE`` in a
round; a field keeps every value judged true.

All sums are linear in the claims: the denials of a group's outlets are summed once per group
and field, and each claim adds its correction, so no list of a group's members or pairs is ever
formed and a group with a third of all rows is a few partial sums per task. Facts claimed by the
same outlets, in groups where the same outlets speak, have the same probability in every round:
they are one row with a count, so a round costs what such patterns cost, not what facts do. Up
to ``FEW`` rows of patterns are fitted on the driver, more by joins; both do the same sums.
Quality tables have one row per outlet.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.components import components
from broadsheet.operators.timestamps import normal_times
from broadsheet.session import durable, filled, strip_blanks, table

FILLED_FIELDS = ("title", "url", "domain", "media_name", "media_url", "language")
FUSED_FIELDS = ("title", "media_name", "media_url", "language", "publish_day", "indexed_utc")
#: The fit has converged when no sensitivity or specificity changes by more than this in a round.
TOLERANCE = 1e-4
#: Rounds after which a fit that hasn't converged is given up with a warning.
MOST_ROUNDS = 500
#: Rows of patterns that the driver may hold (24 bytes each).
FEW = 200_000
PRIOR = 0.5
#: Probabilities this near to the highest are as likely: sums of doubles depend on their order.
TIE = 1e-6
#: Pseudo-counts (claimed, missed) of true facts and (claimed, denied) of false ones.
SENSITIVITY_PRIOR = (8.0, 4.0)
SPECIFICITY_PRIOR = (1.0, 9.0)


def group_members(state: DataFrame) -> DataFrame:
    """(topic, story_id, component, qc_status) of groups of two or more stories of a topic.

    Ties to the story itself, to null, or to a story without a row in the topic don't count;
    cycles and chains are followed; repeated rows count once. Of several rows for one key with
    different verdicts the one ranking best is kept.
    """
    s = state.filter(F.col("topic").isNotNull() & F.col("story_id").isNotNull()).select("topic", "story_id", "qc_status", "dup_of_story_id").distinct()
    node = lambda c: F.concat_ws("\u0001", "topic", c)
    ties = s.filter(F.col("dup_of_story_id").isNotNull() & (F.col("dup_of_story_id") != F.col("story_id")))
    ties = ties.select("topic", F.col("dup_of_story_id").alias("target"), "story_id")
    known = s.select("topic", F.col("story_id").alias("target")).distinct()
    ties = ties.join(known, ["topic", "target"], "left_semi")
    parts = components(ties.select(node("story_id").alias("a"), node("target").alias("b")), "a", "b")
    rank = F.when(F.col("qc_status").isin("ok", "dup"), 0).otherwise(1)
    keyed = s.groupBy(node("story_id").alias("node"), "topic", "story_id").agg(F.min(F.struct(rank.alias("r"), F.col("qc_status"))).alias("q"))
    return keyed.join(parts, "node").select("topic", "story_id", "component", F.col("q.r").alias("status_rank"), F.col("q.qc_status").alias("qc_status"))


def described(members: DataFrame, stories: DataFrame, outlets: DataFrame) -> DataFrame:
    """Members with their stories' fields (nulls where none is held), normal times and filled count.

    A story with several rows gives several members; the best of them counts for the choice.
    """
    columns = ["story_id", *FILLED_FIELDS, "publish_date", "indexed_at"]
    wanted = stories.select(*columns).join(members.select("story_id").distinct(), "story_id", "left_semi")
    df = members.join(normal_times(wanted, outlets), "story_id", "left")
    tests = [filled(F.col(c)) for c in FILLED_FIELDS] + [F.col("publish_day").isNotNull(), F.col("indexed_utc").isNotNull()]
    return df.withColumn("n_filled", sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0)))


def _value(field: str) -> Column:
    c = F.regexp_replace(strip_blanks(F.col(field)), r"\s+", " ")
    return F.when(filled(F.col(field)), F.lower(c) if field in ("media_url", "language") else c)


def _pattern(ids: DataFrame, by: list[str], name: str) -> DataFrame:
    """A digest of the set of outlets ``s`` under each key; ``ids`` holds each outlet once per key."""
    return ids.groupBy(*by).agg(F.struct(F.bit_xor(F.xxhash64("s", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("s", F.lit(2))).alias("y"), F.count("*").alias("n")).alias(name))


def _fit(classes: pd.DataFrame, speakers: pd.DataFrame, claimers: pd.DataFrame, rounds: int | None) -> tuple[pd.DataFrame, pd.DataFrame, float]:
    """The rounds of :func:`judge` over patterns held in memory: (facts, quality, last change)."""
    sources = np.unique(speakers["s"])
    v, c = np.unique(classes["v"]), np.unique(classes["c"])
    n, at_v, at_c = classes["n"].to_numpy(), np.searchsorted(v, classes["v"]), np.searchsorted(c, classes["c"])
    speak, spoken = np.searchsorted(sources, speakers["s"]), np.searchsorted(v, speakers["v"])
    claim, claimed = np.searchsorted(sources, claimers["s"]), np.searchsorted(c, claimers["c"])
    sensitivity, specificity, p = np.full(len(sources), 0.7), np.full(len(sources), 0.9), np.full(len(n), PRIOR)
    total = lambda at, x, size: np.bincount(at, x, size)
    (a, b), (x, y) = SENSITIVITY_PRIOR, SPECIFICITY_PRIOR
    done, change = 0, float("inf")
    while len(n) and done < (MOST_ROUNDS if rounds is None else rounds) and (rounds is not None or change > TOLERANCE):
        deny = np.log((1 - sensitivity) / specificity)
        odds = np.log(PRIOR / (1 - PRIOR)) + total(claimed, (np.log(sensitivity / (1 - specificity)) - deny)[claim], len(c))[at_c] + total(spoken, deny[speak], len(v))[at_v]
        p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        tp, fp = (total(claim, total(at_c, w, len(c))[claimed], len(sources)) for w in (n * p, n * (1 - p)))
        t, u = (total(speak, total(at_v, w, len(v))[spoken], len(sources)) for w in (n * p, n * (1 - p)))
        new = (tp + a) / (t + a + b), 1 - (fp + x) / (u + x + y)
        change = float(max(np.abs(new[0] - sensitivity).max(), np.abs(new[1] - specificity).max()))
        sensitivity, specificity = new
        done += 1
    return classes.assign(p=p), pd.DataFrame({"s": sources, "sensitivity": sensitivity, "specificity": specificity}), change if len(n) else 0.0


def _fit_joined(classes: DataFrame, speakers: DataFrame, claimers: DataFrame, rounds: int | None) -> tuple[DataFrame, DataFrame, float]:
    """What :func:`_fit` does, by joins."""
    quality = durable(speakers.select("s").distinct().withColumns({"sensitivity": F.lit(0.7), "specificity": F.lit(0.9)}))
    facts, done, change = classes.withColumn("p", F.lit(PRIOR)), 0, float("inf")
    while done < (MOST_ROUNDS if rounds is None else rounds) and (rounds is not None or change > TOLERANCE):
        deny = F.log((1 - F.col("sensitivity")) / F.col("specificity"))
        weights = F.broadcast(quality.select("s", (F.log(F.col("sensitivity") / (1 - F.col("specificity"))) - deny).alias("claim"), deny.alias("deny")))
        denied = speakers.join(weights.select("s", "deny"), "s").groupBy("v").agg(F.sum("deny").alias("denied"))
        support = claimers.join(weights.select("s", "claim"), "s").groupBy("c").agg(F.sum("claim").alias("support"))
        p = 1 / (1 + F.exp(-(F.log(F.lit(PRIOR / (1 - PRIOR))) + F.col("support") + F.col("denied"))))
        facts = durable(classes.join(denied, "v").join(support, "c").select("v", "c", "n", p.alias("p")))
        true, false = F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p")))
        per_claim = claimers.join(facts.groupBy("c").agg(true.alias("tp"), false.alias("fp")), "c").select("s", "tp", "fp", F.lit(0.0).alias("t"), F.lit(0.0).alias("u"))
        per_voice = speakers.join(facts.groupBy("v").agg(true.alias("t"), false.alias("u")), "v").select("s", F.lit(0.0).alias("tp"), F.lit(0.0).alias("fp"), "t", "u")
        sums = per_claim.unionAll(per_voice).groupBy("s").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "t", "u")])
        (a, b), (c, d) = SENSITIVITY_PRIOR, SPECIFICITY_PRIOR
        last = F.broadcast(quality.select("s", F.col("sensitivity").alias("a"), F.col("specificity").alias("b")))
        quality = durable(
            sums.join(last, "s").select(
                "s",
                ((F.col("tp") + a) / (F.col("t") + a + b)).alias("sensitivity"),
                (1 - (F.col("fp") + c) / (F.col("u") + c + d)).alias("specificity"),
                "a",
                "b",
            )
        )
        if rounds is None:
            change = quality.agg(F.max(F.greatest(F.abs(F.col("sensitivity") - F.col("a")), F.abs(F.col("specificity") - F.col("b"))))).first()[0] or 0.0
        quality = quality.select("s", "sensitivity", "specificity")
        done += 1
    return facts, quality, change


def judge(members: DataFrame, rounds: int | None = None, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(facts, quality) by expectation-maximisation over the members' statements.

    facts: topic, component, field, value, p (probability of being true); quality: source,
    sensitivity, specificity. A member without a known outlet speaks as the source ``?``.
    Groups whose members state nothing for a field have no facts for it. Rounds go on until the
    qualities have converged, or for exactly ``rounds`` rounds where that is given.
    """
    source = F.lower(F.coalesce(F.when(filled(F.col("domain")), strip_blanks(F.col("domain"))), F.lit("?")))
    stated = F.array(*[F.struct(F.lit(f).alias("field"), _value(f).alias("value")) for f in FUSED_FIELDS])
    claims = members.select("component", source.alias("source"), F.inline(stated)).filter(F.col("value").isNotNull()).distinct()
    claims = durable(claims.withColumns({"s": F.xxhash64("source"), "g": F.xxhash64("component", "field"), "f": F.xxhash64("component", "field", "value")}))
    # An outlet's voice counts once per group and field; v is who speaks in a group, c who claims a fact.
    ids = claims.select("s", "g", "f")
    voices = ids.select("s", "g").distinct()
    spoken = _pattern(voices, ["g"], "v")
    held = durable(_pattern(ids, ["g", "f"], "c").join(spoken, "g").select("g", "f", F.xxhash64("v", F.lit(0)).alias("v"), F.xxhash64("c", F.lit(0)).alias("c")))
    classes = durable(held.groupBy("v", "c").agg(F.count("*").cast("double").alias("n"), F.min("g").alias("g"), F.min("f").alias("f")))
    # Who is in a pattern is read from one of its groups and one of its facts.
    speakers = durable(voices.join(classes.groupBy("v").agg(F.min("g").alias("g")), "g").select("v", "s"))
    claimers = durable(ids.join(classes.groupBy("c").agg(F.min("f").alias("f")), "f").select("c", "s"))
    classes = classes.select("v", "c", "n")
    small = sum(x.count() for x in (classes, speakers, claimers)) <= few
    if small:
        spark = members.sparkSession
        fitted, learned, change = _fit(classes.toPandas(), speakers.toPandas(), claimers.toPandas(), rounds)
        facts = spark.createDataFrame(fitted.astype({"v": "int64", "c": "int64"}), "v long, c long, n double, p double")
        quality = spark.createDataFrame(learned.astype({"s": "int64"}), "s long, sensitivity double, specificity double")
    else:
        facts, quality, change = _fit_joined(classes, speakers, claimers, rounds)
    if rounds is None and change > TOLERANCE:
        warnings.warn(f"outlets' quality still changes by {change:.2g} after {MOST_ROUNDS} rounds", stacklevel=2)
    named = claims.groupBy("f").agg(F.min(F.struct("component", "field", "value")).alias("n")).join(held.join(facts.select("v", "c", "p"), ["v", "c"]).select("f", "p"), "f")
    return named.select("n.component", "n.field", "n.value", "p"), claims.select("s", "source").distinct().join(quality, "s").drop("s")


def best_representatives(state: DataFrame, stories: DataFrame, outlets: DataFrame, rounds: int | None = None) -> DataFrame:
    """One row per group: topic, component, story_id of the survivor, size, and the fused fields.

    The survivor has qc_status ok or dup before any other or none; then the most filled fields;
    then the latest day of publication; then the smallest story_id. Each ``fused_<field>`` is the
    sorted array of every value judged true (p > 0.5), or, where none is, of the likeliest ones;
    within ``TIE``; it is null where no member states the field. Stories without a row in ``stories`` count as
    empty. Empty tables give an empty result; extra columns are ignored.
    """
    members = durable(described(group_members(state), stories, outlets))
    order = F.struct(
        F.col("status_rank").alias("a"),
        (-F.col("n_filled")).alias("b"),
        F.coalesce(-F.unix_date(F.to_date("publish_day")), F.lit(1 << 30)).alias("c"),
        F.col("story_id"),
    )
    chosen = members.groupBy("topic", "component").agg(F.min(order).alias("best"), F.count_distinct("story_id").alias("size"))
    facts, _ = judge(members, rounds)
    top = facts.groupBy("component", "field").agg(F.max("p").alias("top"))
    held = facts.join(top, ["component", "field"]).filter((F.col("p") > 0.5) | ((F.col("top") <= 0.5) & (F.col("p") >= F.col("top") - TIE)))
    fused = held.groupBy("component").pivot("field", list(FUSED_FIELDS)).agg(F.array_sort(F.collect_set("value")))
    fused = fused.select("component", *[F.col(f).alias(f"fused_{f}") for f in FUSED_FIELDS])
    return chosen.join(fused, "component", "left").select("topic", "component", F.col("best.story_id").alias("story_id"), "size", *[f"fused_{f}" for f in FUSED_FIELDS])


def _all(spark, root: str) -> DataFrame:
    state = table(spark, root, "story_topic_state", ["topic", "story_id", "qc_status", "dup_of_story_id"])
    stories = table(spark, root, "stories", ["story_id", *FILLED_FIELDS, "publish_date", "indexed_at"])
    return best_representatives(state, stories, table(spark, root, "outlets", ["domain", "tz", "date_order"]))


def found(spark, root: str) -> DataFrame:
    """p1_found: the survivor of every group of two or more."""
    return _all(spark, root).select("topic", "story_id")


def fused(spark, root: str) -> DataFrame:
    return _all(spark, root).select(
        "topic", "story_id", "size", *[F.array_join(f"fused_{f}", " | ").alias(f"fused_{f}") for f in FUSED_FIELDS]
    )
