import random

import numpy as np
import pytest

from broadsheet.llm import truncation

SCHEMA = "doc_id long, text string, lang string, source string, g string, k int"
ENDS = ["The committee adjourned.", "Status: active", "With files from Ann Lee", "Estimated value $60.0 million", "[Proceedings continue in camera]", "He only smiled …"]


def sentence(rng):
    a, b = ("".join(rng.choice("aeiou") + rng.choice("rstln") for _ in range(3)).title() for _ in range(2))
    return rng.choice([f"{a} told the board that nobody at {b} had discussed the file before May.", f"The contract of {a} with {b} was worth ${rng.randrange(90)}.{rng.randrange(9)} million and ran until June 20{rng.randrange(10, 25)}.", f"{a} now advises {b} on dealings with the harbour authority, a role that did not exist before."])


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(sentence(rng) for _ in range(rng.randint(4, 9))) + "\n" + rng.choice(ENDS) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def by_order(context):
    return {k: int(h[0]) for k, fit, h in truncation.context_hashes([context]) if len(fit)}


def test_windows_hash_alike_wherever_they_stand():
    a, b = "xx end of it all, said the man", "another text: no end of it all, said the man"
    assert by_order(a)[24] == by_order(b)[24] and 32 not in by_order(a) and by_order(a)[16] != by_order(a)[12]
    assert [by_order(c) for c in (a, b)] == [{k: int(h[list(fit).index(i)]) for k, fit, h in truncation.context_hashes([a, b]) if i in fit} for i in (0, 1)]
    windows = truncation.Windows(np.array([1, 2, 3, 1, 2, 3], np.uint32))
    assert windows.ending(np.array([2]), 3) == windows.ending(np.array([5]), 3) != windows.ending(np.array([3]), 3)
    assert by_order("") == {}


def test_threshold_lies_between_the_two_kinds():
    whole, cut = np.zeros(truncation.BINS), np.zeros(truncation.BINS)
    whole[400:420], cut[100:120] = 48, 10
    whole[100:120] += 2  # one value in 25 was cut
    at = (truncation.threshold(whole, cut) - truncation.NEVER) / truncation.WIDTH
    assert 120 <= at <= 400
    assert truncation.threshold(np.zeros(truncation.BINS), np.zeros(truncation.BINS)) is not None


def test_bare_end_takes_off_several_remnants_and_keeps_the_rest():
    assert truncation.bare_end("He met the bo... (more)  &#82") == "He met the bo"
    assert truncation.bare_end("See (the annex)") == "See (the annex)" and truncation.bare_end("x" * 5000) == "x" * 2000


@pytest.mark.parametrize("tail", ["...", "…", " [...]", " […]", " (more)", "&nbs", "&#82", "�", " ", "\n", "<stro"])
def test_remnants_are_taken_off(tail):
    assert truncation.final_context("He met the bo" + tail) == truncation.final_context("He met the bo")


def test_long_texts_end_like_short_ones():
    t = "word " * 5000 + "Ann Lee told the board that nobody knew"
    assert truncation.final_context(t) == "A A told the board that nobody knew"[-truncation.ORDERS[-1] :]


def test_cut_texts_are_found(spark):
    rng = random.Random(2)
    whole = texts(1500)
    rows = [(i, t, ("en", "EN", "fr", None, "und")[i % 5], f"s{i % 3}") for i, t in enumerate(whole)]
    cut = {i for i in range(1500) if rng.random() < 0.08}
    for i in cut:
        body = whole[i].split("\n")[0]
        at = rng.randrange(60, len(body) - 2)
        while body[at - 1] in " ." or body[:at].rstrip()[-1] == "." or body[at - 2] in ".$":
            at += 1
        rows[i] = (i, body[:at] + rng.choice(["", "...", "…", " [...]", "&nbs", "�"]), *rows[i][2:])
    extra = [(9000, None, "en", "s0"), (9001, "", "en", "s0"), (9002, " \n", None, None), rows[0], (9003, rows[min(cut)][1], "en", "s1"), (9004, ". ".join(whole[:400]), "en", "s0")]
    got = {r.doc_id for r in truncation.scored(frame(spark, rows + extra)).filter("truncated").collect()}
    assert not got & {9000, 9001, 9002, 9004} and 9003 in got
    found, wrong = len(got & cut), len(got - cut - {9003})
    assert found >= 0.93 * len(cut) and wrong <= 0.05 * len(cut), (found, len(cut), wrong)


def test_copies_of_a_cut_text_do_not_vouch_for_their_cut(spark):
    whole = texts(600, seed=5)
    rows = [(i, t, "en", "s0") for i, t in enumerate(whole)]
    body = "The contract of Ann with Lee was worth $5.0 million and ran until June 2020. "
    twice, often, signed = (body + x for x in ("A second inquiry looked into how the minister had reg", "Nobody on the board knew which of the tenders were subm", "The harbour authority then asked its lawyers to rev"))
    rows += [(1000 + i, twice, "en", "s1") for i in range(2)]
    rows += [(2000 + i, often, "en", "s1") for i in range(80)]
    rows += [(3000 + i, signed + x, "en", "s2") for i, x in enumerate(["", "...", " [...]", "&nbs", " "])]
    rows += [(4000 + i, whole[0], "en", "s2") for i in range(50)]
    got = {r.doc_id for r in truncation.scored(frame(spark, rows)).filter("truncated").collect()}
    assert {1000, 1001} <= got and {2000 + i for i in range(80)} <= got and {3000 + i for i in range(5)} <= got
    assert not got & {4000 + i for i in range(50)}


def test_shares_and_empty(spark, tmp_path):
    rows = [(i, t, "en", "a" if i % 2 else "b") for i, t in enumerate(texts(300))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.source: r.documents for r in truncation.shares(spark, str(tmp_path)).collect()} == {"a": 150, "b": 150}
    assert truncation.scored(frame(spark, [])).count() == 0
    assert truncation.scored(frame(spark, [(1, None, None, None)])).first().log_odds is None
