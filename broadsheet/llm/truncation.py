"""Text cut off by field limits, found by comparing its ending with what usually follows it.

A backward character n-gram model reads from the end of a value: for its final context it
compares how often texts of that language end there with how often they go on. Characters are
taken as they are, but a capitalised word is one symbol, every digit is the same symbol, and
white space is a blank or a line break, so that invented names don't hide the context.

1. One reading takes the final context of every value (up to 32 symbols), after a sign or remnant
   of a cut (dots, "(more)", half an entity or tag) is taken off, and the context before one place
   inside the text, chosen by the text's digest: an artificial cut. All that follows about
   endings works on these. Copies of a text, and copies that differ only in that sign, count
   once: else a cut text held twice would make its own cut a known ending.
2. Contexts that end at least ``max(2, SHARE x values)`` values of a language are kept, so the
   model has at most orders / SHARE rows per language, whatever the corpus. A second reading, of
   the distinct texts, counts the places where a kept context stands in them.
3. A value is scored by the longest of its contexts the model holds from other values: the
   log-odds of ending there against going on. The threshold of each language and column is fitted to the scores of
   the artificial cuts and of all values: :func:`threshold`.

Only the second reading shuffles texts, once; copies are collapsed within each task before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.session import durable, map_batches, table

ORDERS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
SHARE = 1e-5
LANGUAGES = ("en", "fr", "?")
#: So many other values have to end in a context for it to be used.
OTHERS = 1
#: Score of a value no text ends like, width of the bins scores are counted in, and the number of bins.
NEVER, WIDTH, BINS = -20.0, 0.05, 800
#: A language with fewer distinct values takes the threshold fitted to all languages together.
FEWEST = 500

_NAME = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][^\W\d_]+)*")
_FIGURE = re.compile(r"\d")
REMNANT = re.compile(r"(?:\s*(?:\[(?:\.\.\.|…)\]|\.{3,}|…|\((?:more|suite|continued|à suivre)\)|&#?\w{0,6}|�+|<[^<>\n]{0,80}))+\s*$", re.I)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_STEP = 0xA0761D6478BD642F
_BACK = np.uint64(pow(_STEP, -1, 1 << 64))
_BITS = 22
_SPACES = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
_BREAK = re.compile(r"\s*\n\s*")
#: Signs a remnant of a cut can hold; without one of them there is none to look for.
_SIGNS = re.compile(r"[\].…)&<\ufffd]")


def symbols(text: str) -> str:
    """The text in the model's alphabet, with a line break before it."""
    text = _FIGURE.sub("9", _NAME.sub("A", "\n" + text))
    return _SPACES.sub(" ", _BREAK.sub("\n", text))


def bare_end(text: str) -> str:
    """The last characters of a value without trailing white space and the remnant of a cut."""
    text = text.rstrip()[-2000:]
    while _SIGNS.search(text, max(0, len(text) - 100)):
        head, tail = text[:-200], text[-200:]  # no single remnant is that long
        cut = REMNANT.sub("", tail).rstrip()
        if cut == tail:
            break
        text = (head + cut).rstrip()
    return text


def final_context(text: str) -> str:
    """The last symbols of a value without trailing white space and the remnant of a cut."""
    return _last_symbols(bare_end(text))


def _last_symbols(text: str) -> str:
    if len(text) > 600:  # far more raw characters than the longest context has symbols
        text = text[text.rfind("\n" if "\n" in text[-600:-500] else " ", 0, len(text) - 500) :]
        return symbols(text)[1:].rstrip()[-ORDERS[-1] :]
    return symbols(text).rstrip()[-ORDERS[-1] :]


def artificial_cut(text: str, digest: bytes) -> str | None:
    """The context before a place inside a text that its digest chooses; null for very short texts."""
    if len(text) < 80:
        return None
    at = 40 + int.from_bytes(digest[:8], "big") % (len(text) - 40)
    return _last_symbols(text[max(0, at - 2000) : at].rstrip())


class Windows:
    """Hashes of the windows of a sequence of codes, by their end and length (a power sum, so any window costs two look-ups)."""

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            one = (codes.astype(np.uint64) + np.uint64(1)) * _BASE
            one ^= one >> np.uint64(29)
            powers = np.full(len(codes), _STEP, np.uint64)
            back = np.full(len(codes), _BACK, np.uint64)
            if len(codes):
                powers[0] = back[0] = 1
            self.back = np.cumprod(back)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * np.cumprod(powers))])

    def ending(self, ends: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the windows of length ``k`` whose last code is at ``ends`` (each at least k - 1)."""
        with np.errstate(over="ignore"):
            h = (self.sums[ends + 1] - self.sums[ends + 1 - k]) * self.back[ends] + np.uint64(k)
            h = (h ^ (h >> np.uint64(31))) * _MIX
            return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def context_hashes(contexts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, which contexts are long enough, signed hashes of their last ``order`` symbols), shortest first."""
    windows = Windows(_codes("\0".join(contexts)))
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes + 1) - 2
    for k in ORDERS:
        fit = np.flatnonzero(sizes >= k)
        yield k, fit, windows.ending(ends[fit], k).view(np.int64)


def _language():
    bare = F.lower(F.substring(F.trim("lang"), 1, 2))
    return F.when(bare.isin("en", "fr"), bare).otherwise(F.lit("?"))


def _finals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of each text without the remnant of a cut, its final context and that of an artificial cut."""
    for pdf in batches:
        rows = []
        for text in pdf.pop("text"):
            end = bare_end(text)
            bare = text.rstrip()[:-2000] + end
            digest = hashlib.blake2b(bare.encode("utf-8", "replace"), digest_size=16).digest()
            rows.append((digest, _last_symbols(end), artificial_cut(bare, digest)))
        pdf[["digest", "context", "probe"]] = pd.DataFrame(rows, index=pdf.index, columns=["digest", "context", "probe"], dtype="object")
        yield pdf


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for g, part in pdf.groupby("g")["context"]:
            for k, _, hashes in context_hashes(list(part)):
                h, n = np.unique(hashes, return_counts=True)
                yield pd.DataFrame({"g": g, "k": np.full(len(h), k, np.int32), "h": h, "n": n})


class Model:
    """Log-odds of ending against going on, by language, order and context, as sorted arrays.

    It holds at most orders / SHARE contexts a language, of 16 bytes each (16 MB), and as many again
    for all languages together.
    """

    def __init__(self, rows: pd.DataFrame):
        """rows: g, k, h, ends, places."""
        pooled = rows.groupby(["k", "h"], as_index=False)[["ends", "places"]].sum().assign(g="?")
        self.tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for part in (rows[rows["g"] != "?"], pooled):  # a value of unknown language is held against all languages together
            for key, x in part.sort_values("h").groupby(["g", "k"]):
                on = (x["places"] - x["ends"]).clip(lower=0)
                self.tables[key] = x["h"].to_numpy(np.int64), x["ends"].to_numpy(np.float32), np.log(on + 0.5).to_numpy(np.float32)

    def score(self, language: str, contexts: list[str], own: np.ndarray) -> np.ndarray:
        """Log-odds of the longest context that the language's model or that of all languages holds.

        ``own`` is 1 where the model has counted the context as an ending itself: that one is taken
        out, so that a value is judged by the others. At least ``OTHERS`` others have to end like it.
        """
        out = np.full(len(contexts), NEVER)
        for k, fit, hashes in context_hashes(contexts) if contexts else ():
            for g in ("?", language):  # the language's own model last, so that it prevails
                known, ends, on = self.tables.get((g, k), (None, None, None))
                if known is not None and len(fit):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    others = ends[at] - own[fit]
                    hit = (known[at] == hashes) & (others >= OTHERS)
                    out[fit[hit]] = np.log(others[hit]) - on[at[hit]]
        return out


def fit(values: DataFrame, texts: DataFrame) -> Model:
    """Model of distinct ``values`` (g, context) over the ``texts`` (g, text) they end."""
    sizes = values.groupBy("g").agg(F.greatest(F.lit(2), F.ceil(F.count("*") * SHARE)).alias("least"))
    counted = map_batches(values.select("g", "context"), _ends, "g string, k int, h long, n long").groupBy("g", "k", "h").agg(F.sum("n").alias("n"))
    kept = counted.join(F.broadcast(sizes), "g").filter("n >= least").select("g", "k", "h", F.col("n").alias("ends"))  # sizes: one row per language
    ends = kept.toPandas()  # at most orders / SHARE rows per language
    known = {int(k): np.unique(x.to_numpy(np.int64)) for k, x in ends.groupby("k")["h"]}
    sent = values.sparkSession.sparkContext.broadcast(known)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps = {}  # made in the worker: a bit per hash prefix, so most windows are dismissed at once
        for k, hashes in sent.value.items():
            maps[k] = np.zeros(1 << _BITS, bool)
            maps[k][hashes.view(np.uint64) >> np.uint64(64 - _BITS)] = True
        for pdf in batches:
            for g, texts in pdf.groupby("g")["text"]:
                found = {k: np.zeros(len(h), np.int64) for k, h in sent.value.items()}
                part, size = [], 0
                values = list(texts)
                for i, t in enumerate(values):
                    part.append(symbols(t).rstrip())
                    size += len(part[-1])
                    if size < 200_000 and i < len(values) - 1:
                        continue
                    codes = _codes("\0".join(part))
                    windows, at = Windows(codes), np.arange(len(codes))
                    for k in ORDERS:  # what ends in a kept context ends in its shorter ones, which are kept as well
                        if k not in found or not len(at):
                            break
                        at = at[np.searchsorted(at, k - 1) :]
                        h = windows.ending(at, k)
                        maybe = maps[k][h >> np.uint64(64 - _BITS)]
                        at, h = at[maybe], h[maybe].view(np.int64)
                        row = np.minimum(np.searchsorted(sent.value[k], h), len(sent.value[k]) - 1)
                        sure = sent.value[k][row] == h
                        at = at[sure]
                        found[k] += np.bincount(row[sure], minlength=len(sent.value[k]))
                    part, size = [], 0
                frames = [pd.DataFrame({"g": g, "k": k, "h": sent.value[k][n > 0], "n": n[n > 0]}) for k, n in found.items() if n.any()]
                if frames:
                    yield pd.concat(frames, ignore_index=True).astype({"k": "int32"})

    counts = map_batches(texts.distinct(), places, "g string, k int, h long, n long").groupBy("g", "k", "h").agg(F.sum("n").alias("places")).toPandas()  # only kept contexts
    rows = ends.merge(counts, on=["g", "k", "h"], how="left")
    rows["places"] = rows["places"].fillna(rows["ends"])
    return Model(rows)


def threshold(whole: np.ndarray, cut: np.ndarray) -> float:
    """The score under which a value counts as cut, from counts of scores by bin.

    ``whole`` counts all values (most of them whole), ``cut`` artificial cuts. Far down, where whole
    texts hardly score, the ratio of the two shares tells how many values were cut; with that,
    the threshold has the least expected number of wrong verdicts, in the middle of the best ones.
    """
    seen, made = np.cumsum(whole) / max(1, whole.sum()), np.cumsum(cut) / max(1, cut.sum())
    enough = made >= 0.5
    prior = float(np.clip((seen[enough] / made[enough]).min(), 1e-4, 0.5)) if enough.any() else 0.05
    wrong = prior - 2 * prior * made + seen
    best = np.flatnonzero(wrong <= wrong.min() + 0.02 * prior)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    middle = next(r for r in runs if wrong.argmin() in r).mean()
    return NEVER + WIDTH * (middle + 1)


def thresholds(values: DataFrame, score) -> dict[str, float]:
    """Fitted threshold of each language; ``score`` is the model over (g, context) batches."""
    kinds = values.select("g", F.inline(F.array(F.struct(F.lit(0).alias("cut"), F.col("context")), F.struct(F.lit(1).alias("cut"), F.col("probe").alias("context"))))).filter("context IS NOT NULL")
    bins = F.least(F.greatest(F.floor((F.col("log_odds") - NEVER) / WIDTH), F.lit(0)), F.lit(BINS - 1)).cast("int")
    counted = score(kinds, "g string, cut int, context string").groupBy("g", "cut", bins.alias("bin")).agg(F.count("*").alias("n")).toPandas()  # bins of three languages
    table = {key: np.bincount(x["bin"], x["n"], BINS) for key, x in counted.groupby(["g", "cut"])}
    none = np.zeros(BINS)
    every = [sum((x for (_, c), x in table.items() if c == cut), none) for cut in (0, 1)]
    chosen = {g: (table.get((g, 0), none), table.get((g, 1), none)) for g in LANGUAGES}
    return {g: threshold(*(own if own[0].sum() >= FEWEST else every)) for g, own in chosen.items()}


def scored(rows: DataFrame, column: str = "text") -> DataFrame:
    """rows' doc_id and source with ``log_odds`` and ``truncated``.

    rows: doc_id, ``column``, lang, source. Null, empty and blank texts were not cut (log_odds
    null); null or unknown languages use all languages together; a text under several ids
    counts under each, but once in the model; repeated rows stay. Score equal to the threshold: not cut. An empty table
    gives an empty table; other columns are ignored.
    """
    rows = rows.select("doc_id", F.col(column).alias("text"), "source", _language().alias("g"))
    full = rows.filter(F.col("text").rlike(r"\S"))
    ends = durable(map_batches(full, _finals, "doc_id long, source string, g string, digest binary, context string, probe string"))
    values = durable(ends.select("g", "digest", "context", "probe").distinct())
    model = ends.sparkSession.sparkContext.broadcast(fit(values, full.select("g", "text")))

    def score(df: DataFrame, schema: str) -> DataFrame:
        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                odds = pd.Series(NEVER, index=pdf.index, dtype="float64")
                for g, part in pdf.groupby("g"):
                    odds[part.index] = model.value.score(g, list(part["context"]), 1 - part["cut"].to_numpy())
                yield pdf.assign(log_odds=odds)

        return map_batches(df, judge, schema + ", log_odds double")

    limits = thresholds(values, score)
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("g")]
    known = score(ends.select("doc_id", "source", "g", F.lit(0).alias("cut"), "context"), "doc_id long, source string, g string, cut int, context string")
    blank = rows.filter(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).select("doc_id", "source", F.lit(None).cast("double").alias("log_odds"), F.lit(False).alias("truncated"))
    return known.select("doc_id", "source", "log_odds", (F.col("log_odds") < limit).alias("truncated")).unionAll(blank)


def found(spark, root: str) -> DataFrame:
    """p10_found: documents whose text was cut."""
    return scored(table(spark, root, "documents", ["doc_id", "text", "lang", "source"]).filter(F.col("text").rlike(r"\S"))).filter("truncated").select("doc_id").distinct()


def shares(spark, root: str) -> DataFrame:
    """How often each source cuts its texts."""
    df = scored(table(spark, root, "documents", ["doc_id", "text", "lang", "source"]))
    return df.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("truncated").alias("cut"), (F.count_if("truncated") / F.count("*")).alias("share"))
