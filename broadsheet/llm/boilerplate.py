"""The main body of a page: a recurrent labeller of its lines.

A page is a sequence of lines (the leaves of the extracted text). Every line gets a vector of
hashed words (a learned embedding, averaged) and of its path, which for extracted text is its
layout: extractor, marks at either end, length, case, blank lines around it, place in the
document, and whether it is the story's title. A bidirectional LSTM in numpy reads the whole
sequence, so each line is judged in the context of the document.

The network is fitted on the driver on a bounded sample: at most ``sample`` documents, chosen by
the hash of their id, labelled by how lines recur and where they stand
(:mod:`broadsheet.llm.structure`), not by their wording; lines without a label take part as
context only. Every document is then read whole in the workers. The fit takes the same time for
every size of the corpus and is deterministic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import residue
from broadsheet.llm.lines import CLOSE, headline, letters, own_title, squeeze
from broadsheet.llm.structure import labels as structural_labels
from broadsheet.session import map_batches, table

SAMPLE = 1500
BUCKETS = 2048
EMBED = 12
HIDDEN = 14
EPOCHS = 10
BATCH = 24
SEED = 7

_EXTRACTORS = ("trafilatura", "beautifulsoup", "readability-lxml")
_ITEM = re.compile(r"(?:\d{4} ?: |\* |[-–] |• |\d+\) )")
_POINT = re.compile(r"(?:[»›] |\d{1,2}\. )")
_DIGIT = re.compile(r"\d")
N_PATH = 26


class _Buckets(dict):
    """Bucket of a word, remembered; names and figures have buckets by shape and are never remembered."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode()) % (BUCKETS - 8) + 8
        if len(self) < 100_000:  # the memory is bounded, the value isn't affected
            self[word] = value
        return value


_BUCKET = _Buckets()


def _shape(word: str) -> int:
    c = word[0]
    if c.isupper():
        return 3
    if c.isdigit() or c in "$€#":
        return 2 if len(word) == 4 and word.isdigit() else 1
    return _BUCKET[word]


def line_tokens(line: str) -> list[int]:
    """Hash buckets of a line's words; the first word also as such; names and figures by their shape."""
    if line.upper() == line:
        line = line.lower()
    words = line.split()
    bucket = _BUCKET
    out = [bucket[w] if "a" <= w[0] <= "z" else _shape(w) for w in words]
    if out:
        first = words[0].lower()
        out[0] = bucket[first] if not first[0].isdigit() else out[0]
        out.append(bucket["^" + first] if not first[0].isdigit() else 4)
        out.append(bucket[words[-1].lower() + "$"] if not words[-1][0].isupper() else 5)
    return out or [0]


def read(text: str, title: str | None, extractor: str | None) -> tuple[list[int], list[str], list[list[int]], np.ndarray]:
    """Line numbers, squeezed lines, tokens and path vectors of the lines that aren't blank."""
    own = letters(title)
    longest = 2 * len(title) + 40 if title else 0
    numbers, lines, gaps = [], [], []
    gap = 0
    for i, x in enumerate(text.split("\n")):
        bare = x.strip()
        if not bare:
            gap = 1
            continue
        numbers.append(i + 1)
        lines.append(squeeze(x) or bare)
        gaps.append(gap)
        gap = 0
    n = len(lines)
    which = [0.0] * 4
    which[_EXTRACTORS.index(extractor) if extractor in _EXTRACTORS else 3] = 1.0
    rows = []
    for i, line in enumerate(lines):
        size, first = len(line), line[0]
        closed = line.endswith(CLOSE)
        rows.append(
            (
                1, log1p(size) / 5, size > 60, size > 120, closed, ": " in line or line[-1] == ":", "|" in line, "·" in line,
                _ITEM.match(line) is not None, _POINT.match(line) is not None, first in "\"“«", first in "©»›•*-–",
                line.upper() == line, line.lower() == line, _DIGIT.search(line) is not None, size <= longest and headline(line, own),
                gaps[i], i / n, i == 0, i == n - 1, n / 40, size > 60 and closed, *which,
            )
        )
    return numbers, lines, [line_tokens(x) for x in lines], np.array(rows, np.float32).reshape(n, N_PATH)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Embedding bag and path vector, bidirectional LSTM, logistic output; numpy only."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        inside = EMBED + N_PATH
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": (0.3 * rng.standard_normal((BUCKETS, EMBED))).astype(np.float32), "v": draw(2 * HIDDEN + inside), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {"W" + d: draw(inside, 4 * HIDDEN), "U" + d: draw(HIDDEN, 4 * HIDDEN), "b" + d: np.zeros(4 * HIDDEN, np.float32)}
            self.p["b" + d][HIDDEN : 2 * HIDDEN] = 1

    def inputs(self, docs: list[tuple[list[list[int]], np.ndarray]]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(steps, documents, features), mask, and what the backward pass needs of the embedding."""
        steps, n = max(len(t) for t, _ in docs), len(docs)
        x = np.zeros((steps, n, EMBED + N_PATH), np.float32)
        mask = np.zeros((steps, n), np.float32)
        flat = np.concatenate([np.fromiter(t, np.int64) for tokens, _ in docs for t in tokens])
        sizes = np.array([len(t) for tokens, _ in docs for t in tokens])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        bags = np.add.reduceat(self.p["E"][flat], starts, axis=0) / np.sqrt(sizes)[:, None]
        at = 0
        for j, (tokens, path) in enumerate(docs):
            k = len(tokens)
            x[:k, j, :EMBED] = bags[at : at + k]
            x[:k, j, EMBED:] = path
            mask[:k, j] = 1
            at += k
        return x, mask, (flat, sizes)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        steps, n, _ = x.shape
        pre = x @ self.p["W" + d] + self.p["b" + d]
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p["U" + d]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, g, c, h, tc, m))
            c = new * m + c * (1 - m)
            h = (o * tc) * m + h * (1 - m)
            out[t] = h
        return out

    def scores(self, docs) -> tuple[np.ndarray, np.ndarray]:
        x, mask, _ = self.inputs(docs)
        top = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b"), x], axis=2)
        return _sigmoid(top @ self.p["v"] + self.p["c"]), mask

    def gradients(self, docs, labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask, (flat, sizes) = self.inputs(docs)
        kept = {"f": [], "b": []}
        hf, hb = (self._run(x, mask, d, kept[d]) for d in "fb")
        top = np.concatenate([hf, hb, x], axis=2)
        y = _sigmoid(top @ self.p["v"] + self.p["c"])
        delta = np.zeros_like(y)
        for j, known in enumerate(labels):
            on = known >= 0
            delta[: len(known), j][on] = y[: len(known), j][on] - known[on]
        delta /= max(1, sum(int((k >= 0).sum()) for k in labels))
        g = {"v": np.tensordot(delta, top, ([0, 1], [0, 1])), "c": np.array([delta.sum()], np.float32)}
        dtop = delta[:, :, None] * self.p["v"]
        dx = dtop[:, :, 2 * HIDDEN :].copy()
        for d, part in (("f", dtop[:, :, :HIDDEN]), ("b", dtop[:, :, HIDDEN : 2 * HIDDEN])):
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            g["U" + d] = np.zeros_like(self.p["U" + d])
            for t, i, f, o, gg, c, h, tc, m in reversed(kept[d]):
                dh = dh + part[t]
                live, dead = dh * m, dh * (1 - m)
                do = live * tc
                dnew = live * o * (1 - tc * tc) + dc * m
                dz = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - gg * gg)], axis=1)
                dz_all[t] = dz
                g["U" + d] += h.T @ dz
                dh = dz @ self.p["U" + d].T + dead
                dc = dnew * f + dc * (1 - m)
            g["W" + d] = np.tensordot(x, dz_all, ([0, 1], [0, 1]))
            g["b" + d] = dz_all.sum((0, 1))
            dx += dz_all @ self.p["W" + d].T
        bags = np.concatenate([dx[: len(t), j, :EMBED] for j, (t, _) in enumerate(docs)]) / np.sqrt(sizes)[:, None]
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], flat, np.repeat(bags, sizes, axis=0))
        return g

    def fit(self, docs, labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.012, seed: int = SEED) -> Labeller:
        """Adam over batches of documents of like length."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = sorted(range(len(docs)), key=lambda i: len(docs[i][0]))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        step = 0
        for epoch in range(epochs):
            for b in rng.permutation(len(batches)):
                chosen = batches[b]
                g = self.gradients([docs[i] for i in chosen], [labels[i] for i in chosen])
                step += 1
                lr = rate * (0.5 if epoch >= epochs - 3 else 1) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] = (self.p[k] - lr * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        return self


def fit(rows: DataFrame, index: residue.Index, sample: int = SAMPLE) -> Labeller:
    """Labeller fitted on at most ``sample`` stories whose hashed id is small (a fixed bound), residue left out."""
    share = min(1.0, 2 * sample / max(1, index.documents))
    pick = rows.filter(F.pmod(F.xxhash64("story_id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(6 * sample)
    docs, pages, seen = [], [], set()
    for r in sorted(pick.collect(), key=lambda r: (zlib.crc32(r.story_id.encode()), r.story_id, r.text)):
        if r.story_id in seen or len(docs) >= sample or residue.is_residue(r.text, r.title, index):
            continue
        seen.add(r.story_id)
        _, lines, tokens, path = read(r.text, r.title, r.extractor)
        if lines:
            docs.append((tokens, path))
            pages.append((r.domain, r.media_name, r.title, lines))
    return Labeller().fit(docs, structural_labels(pages)) if docs else Labeller()


def label(model: Labeller, texts, titles, extractors, size: int = 192) -> list[list[tuple[int, float]]]:
    """(line_no, probability of being the page's own) of every line that isn't blank, by document."""
    parsed = [read(*x) for x in zip(texts, titles, extractors, strict=True)]
    owns = [letters(t) for t in titles]
    out: list[list[tuple[int, float]]] = [[] for _ in parsed]
    order = sorted((i for i, x in enumerate(parsed) if x[0]), key=lambda i: len(parsed[i][0]))
    for at in range(0, len(order), size):
        chunk = order[at : at + size]
        y, _ = model.scores([(parsed[i][2], parsed[i][3]) for i in chunk])
        for j, i in enumerate(chunk):
            numbers, lines = parsed[i][:2]
            # The exact check that follows: the story's own title is the article's whatever the network says.
            out[i] = [(n, 0.0 if p > 0.5 and own_title(x, owns[i]) else p) for n, x, p in zip(numbers, lines, y[: len(numbers), j].tolist(), strict=True)]
    return out


COLUMNS = ("story_id", "title", "extractor", "text", "domain", "media_name")


def judged(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(story_id, text, lines, bad): page lines of each text, and whether it is residue.

    rows: story_id, title, extractor, text; domain and media_name where there are any, for the
    labels only. Texts are read once; they travel on only if a caller selects them.
    """
    given = rows.select(*[c if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])
    given = given.filter(F.col("text").isNotNull() & F.col("story_id").isNotNull())
    index = residue.exemplar_index(given)
    sent = given.sparkSession.sparkContext.broadcast((fit(given, index, sample), index))  # as large for every corpus, but for mined exemplars (see residue)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, index = sent.value
        for pdf in batches:
            for start in range(0, len(pdf), 2000):
                part = pdf.iloc[start : start + 2000]
                bad = [residue.is_residue(x, t, index) for x, t in zip(part["text"], part["title"], strict=True)]
                good = part.loc[[not b for b in bad]]
                found = iter(label(model, good["text"], good["title"], good["extractor"]))
                lines = [[] if b else [n for n, p in next(found) if p > 0.5] for b in bad]
                yield part[["story_id", "text"]].assign(lines=lines, bad=bad)

    return map_batches(given.select("story_id", "title", "extractor", "text"), judge, "story_id string, text string, lines array<int>, bad boolean")


def page_lines(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(story_id, line_no) of lines that are the page's own, stories with residue left out.

    rows: as for :func:`judged`. Residue is judged in the same pass, so no text is
    shuffled; a story is left out if any of its texts is residue. Lines are split at line feeds
    and numbered from 1, blank ones counted but never returned. Null and empty texts give no
    lines, null titles, extractors and sites are allowed, repeated rows give one result, several
    texts of a story give the lines of each, texts of any length are read whole, other columns are
    ignored; an empty table gives an empty table. A line scoring exactly one half belongs to the
    article.
    """
    marked = judged(rows, sample).select("story_id", F.when(F.col("bad"), F.array(F.lit(0))).otherwise(F.col("lines")).alias("lines"))
    by_story = marked.groupBy("story_id").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("lines"))
    return by_story.filter(~F.array_contains("lines", 0)).select("story_id", F.explode("lines").alias("line_no"))


def bodies(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(story_id, text) with only the article's lines, one row per distinct text of a story without residue.

    Blank lines are dropped. Each text loses its own page lines, whatever a story's other texts hold.
    """
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("lines", (i + 1).cast("int")) & line.rlike(r"\S"))
    each = judged(rows, sample).select("story_id", "bad", F.when(~F.col("bad"), F.array_join(kept, "\n")).alias("text")).distinct()
    bad = each.filter("bad").select("story_id").distinct()
    return each.filter(~F.col("bad")).join(bad, "story_id", "left_anti").select("story_id", "text")


def found(spark, root: str) -> DataFrame:
    """p6_found: the page's own lines, stories of p3_found left out."""
    return page_lines(table(spark, root, "fetch_review", COLUMNS))


def article_texts(spark, root: str) -> DataFrame:
    return bodies(table(spark, root, "fetch_review", COLUMNS))
