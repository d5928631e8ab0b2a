"""Items of varying length in containers of fixed capacities, with little room left over.

Variable-capacity best fit: items come largest first; each goes to the open container with the
least room that still takes it, else a container of the least costly size is opened; at the end
every container shrinks to the smallest capacity that holds its contents. Which size to open is optimised jointly for all permitted sizes: a policy has one size
for large items and one for small ones, every pair of sizes is tried with every bound between
them, and the packing that needs the least capacity in all is kept.

Documents are dealt by hash into shards of about ``SHARD_TOKENS`` tokens, each packed in one
task; a shard ends with at most a few open containers, so the room lost by sharding is a
constant of a shard, well under a percent, at any size of the corpus.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.tokens import TOKENIZER, sized
from broadsheet.session import durable, ship, table

SHARD_TOKENS = 3_000_000


def _fit(sizes: list[int], capacities: list[int], large: int, small: int, bound: int) -> tuple[list[int], list[int]]:
    """(bin of each item, used room of each bin) for sizes in falling order; bins open with ``large`` for items above ``bound``, else ``small``."""
    room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r: a bin with r tokens of room is open
    at, caps, left = [], [], []
    for s in sizes:
        fitting = open_rooms >> s
        if fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            b = len(caps)
            caps.append(next(c for c in capacities if c >= max(s, large if s > bound else small)))
            r = caps[b]
            left.append(r)
        at.append(b)
        left[b] = r - s
        room.setdefault(r - s, []).append(b)
        open_rooms |= 1 << (r - s)
    return at, [c - x for c, x in zip(caps, left, strict=True)]


def best_fit(sizes: list[int], capacities: list[int]) -> tuple[list[int], list[int]]:
    """(bin of each item in the order given, final capacity of each bin); no size may exceed the largest capacity."""
    capacities = sorted(set(capacities))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    falling = [sizes[i] for i in order]
    best = None
    # A policy opens one size for items above a bound and another for the rest; both sizes and the bound are tried jointly.
    bounds = sorted({0, *capacities[:-1], *(c // 2 for c in capacities)}) if len(capacities) > 1 else [0]
    tried = {(c, c, 0) for c in capacities} | {(x, y, b) for x in capacities for y in capacities for b in bounds if b and x != y}
    for large, small, bound in sorted(tried):
        at, used = _fit(falling, capacities, large, small, bound)
        final = [next(c for c in capacities if c >= u) for u in used]  # downsizing
        if best is None or (sum(final), len(final)) < best[0]:
            best = ((sum(final), len(final)), at, final)
    where = [0] * len(sizes)
    for i, b in zip(order, best[1] if best else [], strict=True):
        where[i] = b
    return where, best[2] if best else []


def pieces(n: int, largest: int) -> list[tuple[int, int]]:
    """(start, length) of an item's pieces: itself, or full pieces and a rest if it exceeds the capacity."""
    return [(0, n)] if n <= largest else [(s, min(largest, n - s)) for s in range(0, n, largest)]


def pack(documents: DataFrame, plans: dict[str, list[int]], tokenizer: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Every document placed once under each plan (name: permitted capacities).

    Result: plan, container_id, capacity, doc_id, piece, start_token, n_tokens. Only a text longer
    than the plan's largest capacity is cut, into full pieces and a rest. Empty texts take no
    room but are placed; null texts are left out; texts under several ids are placed for each;
    equal sizes are placed in order of doc_id. Empty input, or no plan, gives an empty table;
    other columns are ignored. Capacities must be positive.
    """
    plans = {k: sorted({c for c in v if c is not None}) for k, v in plans.items()}
    plans = {k: v for k, v in plans.items() if v}
    if any(c <= 0 for v in plans.values() for c in v):
        raise ValueError("capacities must be positive")
    sizes = durable(sized(documents, tokenizer=tokenizer).distinct())
    total = sizes.agg(F.sum("n_tokens"), F.count("*")).first()
    shards = max(1, -(-(total[0] or 0) // shard_tokens), -(-total[1] // 200_000))
    spark = documents.sparkSession
    ship(spark)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        frames = []
        for plan, capacities in plans.items():
            cut = [(d, i, s, n) for d, size in zip(pdf["doc_id"], pdf["n_tokens"], strict=True) for i, (s, n) in enumerate(pieces(int(size), capacities[-1]))]
            at, final = best_fit([c[3] for c in cut], capacities)
            out = pd.DataFrame(cut, columns=["doc_id", "piece", "start_token", "n_tokens"])
            out["plan"], out["capacity"] = plan, [final[b] for b in at]
            out["container_id"] = [f"{plan}-{key[0]}-{b}" for b in at]
            frames.append(out)
        names = ["plan", "container_id", "capacity", "doc_id", "piece", "start_token", "n_tokens"]
        return pd.concat(frames, ignore_index=True)[names] if frames else pd.DataFrame(columns=names)

    schema = "plan string, container_id string, capacity long, doc_id long, piece int, start_token long, n_tokens long"
    if not plans:
        return spark.createDataFrame([], schema)
    dealt = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(one, schema)


def _plans(spark, root: str) -> dict[str, list[int]]:
    """One plan for each kind of container, and one that may use all their sizes."""
    kinds = {r.container_kind: [r.capacity_tokens] for r in table(spark, root, "containers").collect()}
    return kinds | {"all kinds": [c for v in kinds.values() for c in v]}


def placed(spark, root: str) -> DataFrame:
    return pack(table(spark, root, "documents", ["doc_id", "text"]), _plans(spark, root))


def sound(spark, root: str) -> DataFrame:
    """What must hold of each plan: every document placed once and whole, no container over its capacity, none larger than permitted.

    plan, largest (permitted capacity), documents (placed), twice (pieces placed more than once or
    missing), overfull (containers), needlessly_cut (documents cut though the largest takes
    them), too_large (containers above the largest).
    """
    plans = _plans(spark, root)
    df = durable(placed(spark, root))
    known = spark.createDataFrame([(k, max(v)) for k, v in plans.items()], "plan string, largest long")
    docs = df.groupBy("plan", "doc_id").agg(F.count("*").alias("pieces"), F.count_distinct("piece").alias("different"), F.sum("n_tokens").alias("tokens")).join(F.broadcast(known), "plan")
    cut = (F.col("pieces") > 1) & (F.col("tokens") <= F.col("largest"))
    by_doc = docs.groupBy("plan", "largest").agg(F.count("*").alias("documents"), F.count_if(F.col("pieces") != F.col("different")).alias("twice"), F.count_if(cut).alias("needlessly_cut"))
    bins = df.groupBy("plan", "container_id", "capacity").agg(F.sum("n_tokens").alias("tokens")).join(F.broadcast(known), "plan")
    by_bin = bins.groupBy("plan").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"), F.count_if(F.col("capacity") > F.col("largest")).alias("too_large"))
    return by_doc.join(by_bin, "plan").select("plan", "largest", "documents", "twice", "overfull", "needlessly_cut", "too_large")


def filling(spark, root: str) -> DataFrame:
    """How full the containers of each plan and size are."""
    df = placed(spark, root)
    each = df.groupBy("plan", "container_id", "capacity").agg(F.sum("n_tokens").alias("tokens"))
    return each.groupBy("plan", "capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("capacity")).alias("filled"))
