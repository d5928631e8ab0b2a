import re
from collections import defaultdict

from broadsheet.llm import sitelines

SCHEMA = "story_id string, domain string, text string, site string, line string, h1 long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


def brute(rows, least=4):
    docs = {(s, d.strip().lower(), t) for s, d, t in rows if s and t is not None and d and d.strip().lower() not in ("", "n/a", "-")}
    letters = lambda x: re.sub(r"[\W\d_]+", "", x).lower()
    stories = defaultdict(set)
    for s, d, t in docs:
        for x in t.split("\n"):
            stories[d, letters(x)].add(s)
    return {(s, i + 1) for s, d, t in docs for i, x in enumerate(t.split("\n")) if letters(x) and len(stories[d, letters(x)]) >= least}


ROWS = [(f"s{i}", " A.test" if i % 2 else "a.test", f"Share THIS, story {i}!\n\nunique {chr(97 + i) * 5}\r\n12 34\nshare this story\n{'é' * (i // 4)}") for i in range(12)]
ROWS += [("b1", "b.test", "Share this story"), ("n1", None, "Share this story"), ("n2", "N/A", "x"), ("n3", "a.test", None), ("n4", "a.test", ""), (None, "a.test", "Share this story")]
ROWS += [ROWS[0], ROWS[1], ("long", "a.test", "Share this story\n" * 3000 + "x" * 200_000)]


def test_against_brute_force(spark):
    got = {(r.story_id, r.line_no) for r in sitelines.repeated_lines(frame(spark, ROWS)).collect()}
    assert got == brute(ROWS) and ("s0", 1) in got and ("s0", 4) not in got
    assert sitelines.repeated_lines(frame(spark, [])).count() == 0


def test_texts_without_them(spark):
    got = {r.story_id: r.text for r in sitelines.cleaned(frame(spark, ROWS)).collect()}
    drop = brute(ROWS)
    for s, d, t in ROWS:
        if s in got and d and t is not None:
            assert got[s] == "\n".join(x for i, x in enumerate(t.split("\n")) if (s, i + 1) not in drop)
    assert got["n4"] == "" and got["b1"] == "Share this story"


def test_share_of_the_site(spark):
    rows = [(f"s{i}", "a.test", "often" if i < 8 else "seldom" if i < 12 else f"x{'y' * i}") for i in range(20)]
    assert {r.story_id for r in sitelines.repeated_lines(frame(spark, rows), min_share=0.3).collect()} == {f"s{i}" for i in range(8)}
