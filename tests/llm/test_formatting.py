import random

import pytest

from broadsheet.llm import formatting

SCHEMA = "story_id string, title string, url string, k string, least string, n long"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)
    records, members = formatting.collapse(df)
    return {r.first_story_id: (r.copies, r.spellings) for r in records.collect()}, {r.story_id: r.first_story_id for r in members.collect()}


SAME = [
    ("Who is X, the chair: a study?", "https://www.a.test/p/x?id=1&utm_source=q"),
    ("who is x  the chair – a study", "http://A.test:80/p/x/?id=1#top"),
    ("a study | Who is X, the chair", "https://a.test/p/x?UTM_Medium=z&id=1"),
    ("Who\u00a0is X, the ch\u200bair: a study…", "https://a.test/%70/x?id=1&fbclid=7"),
    ("WHO IS X &#44; THE CHAIR: A STUDY", "https://a.test/P/x?id=1&gclid="),
]
OTHERS = [
    ("Who is X, the chair: a study, again", "https://a.test/p/x?id=1"),
    ("Who is X, the chair: a study", "https://a.test/p/x?id=2"),
    ("Who is X, the chair: a study", "https://b.test/p/x?id=1"),
    ("Is who X, the chair: a study", "https://a.test/p/x?id=1"),
]


def test_spellings_collapse(spark):
    rows = [(f"s{i}", *r) for i, r in enumerate(SAME)] + [(f"o{i}", *r) for i, r in enumerate(OTHERS)] + [("s0", *SAME[0]), ("s9", *SAME[0])]
    records, members = run(spark, rows)
    assert members == {f"s{i}": "s0" for i in (0, 1, 2, 3, 4, 9)}
    assert records["s0"] == (6, 5) and len(records) == 5


@pytest.mark.parametrize(("a", "b"), [("paid $50.7 million", "paid $507 million"), ("met 5 times", "met 7 times"), ("A sues B", "B sues A"), ("cost 17,9", "cost 19,9")])
def test_amounts_and_order_matter(a, b):
    assert formatting.title_keys(a)[0] != formatting.title_keys(b)[0]


@pytest.mark.parametrize(("a", "b"), [("cost 80,050", "cost 80050"), ("ofﬁce", "office"), ("e\u0301cole", "école"), ("L’affaire", "L'affaire"), ("snow-clearing", "snow clearing")])
def test_encodings_do_not(a, b):
    assert formatting.title_keys(a)[0] == formatting.title_keys(b)[0]


def test_pages():
    key = formatting.page_key
    assert key("https://x.test/story?section=a&id=1") == key("HTTP://www.X.test/story/?id=1&section=a&utm_x=1#c")
    assert key("https://x.test/story?id=1&page=1") != key("https://x.test/story?id=1&page=3")
    assert key("//u@x.test:443/a//b/index.html") == key("https://x.test/a/b")
    assert key("https://[bad") == key("http://[BAD") == "[bad" and key("") == ""


def test_against_grouping_in_python(spark):
    rng = random.Random(5)
    variants = [lambda t: t, str.upper, lambda t: t.replace(" ", "  "), lambda t: f" {t}!", lambda t: t.replace(" ", "\u00a0", 1)]
    rows = [(f"{i:04}", rng.choice(variants)(f"story number {rng.randrange(40)} of many"), f"https://a.test/{rng.randrange(3)}" + rng.choice(["", "/", "#x", "?utm_id=1"])) for i in range(600)]
    want = {}
    for i, t, u in rows:
        want.setdefault((formatting.title_keys(t)[0], formatting.page_key(u)), []).append(i)
    records, members = run(spark, rows)
    assert members == {i: min(v) for v in want.values() if len(v) > 1 for i in v}
    assert {k: c for k, (c, _) in records.items()} == {min(v): len(v) for v in want.values()}


def test_odd_input(spark):
    long = "word " * 20_000
    rows = [("1", None, "u"), ("2", "t", None), ("3", " ", "https://a.test/"), ("4", "?!", "https://a.test/"), (None, "t", "https://a.test/"), ("5", long, "https://a.test/"), ("6", long.upper(), "https://a.test"), ("7", "N/A", "https://a.test/")]
    records, members = run(spark, rows)
    assert members == {"5": "5", "6": "5"} and set(records) == {"5"}
    assert run(spark, []) == ({}, {})
