import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from broadsheet.functions import html, text, urls
from broadsheet.session import filled, numbered, ship


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'int' if isinstance(values[n], int) else 'string'}" for n in names))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("url", "norm"),
    [
        ("HTTPS://www.Example.test/path/?b=2&utm_source=newsletter&a=1#section", "example.test/path?a=1&b=2"),
        ("https://[invalid/story", None),
        ("", None),
        ("   ", None),
        (None, None),
        ("//user:pw@www.Example.test:8080/A/B//", "example.test:8080/A/B"),
        ("http://example.test:99999/x", None),
        ("http://example.test?UTM_x=1&FBCLID=2&q=a+b&q=a*b~c&empty=", "example.test?empty=&q=a+b&q=a%2Ab~c"),
        ("not a url", None),
    ],
)
def test_url_normal_form(spark, url, norm):
    assert one(spark, urls.normalize_url(F.col("u")), u=url) == norm


@pytest.mark.parametrize(
    ("title", "media", "norm"),
    [
        ("Policy - impacts", "Example News", "policy impacts"),
        ("Policy - The Globe and Mail", "x", "policy"),
        ("Policy | Custom Outlet", "Custom Outlet", "policy"),
        ("A | B - Custom Outlet", "custom outlet", "a b"),
        ("Straße — Σίσυφος", None, "strasse σίσυφοσ"),
        ("...", "x", None),
        (None, None, None),
        ("Custom Outlet", "Custom Outlet", "custom outlet"),
    ],
)
def test_title_normal_form(spark, title, media, norm):
    assert one(spark, text.normalize_title(F.col("t"), F.col("m"), ["The Globe and Mail"]), t=title, m=media) == norm


def test_title_normal_form_is_stable(spark):
    titles = ["National-Hockey League — rules", "ÉCOLE d'été | x", "a  b\tc", "ß ς", "12,5 % de plus"]
    df = spark.createDataFrame([(t,) for t in titles], "t string").withColumn("n", text.words(F.col("t")))
    assert df.filter(~F.col("n").eqNullSafe(text.words(F.col("n")))).count() == 0


@pytest.mark.parametrize(
    ("title", "terms", "term"),
    [
        ("National-Hockey League lobby rules change", ["national hockey league"], "national hockey league"),
        ("National hockey leaguee lobby rules change", ["national hockey league"], None),
        ("Football-lobby rules change", ["baseball", "football"], "football"),
        ("A footballer discusses lobbying rules", ["football"], None),
    ],
)
def test_terms_are_whole_words(spark, title, terms, term):
    assert one(spark, text.first_term(text.words(F.col("t")), terms), t=title) == term


def test_case_key(spark):
    key = text.case_key(F.col("a"), F.col("b"), F.lit("v1"), F.col("n"))
    assert one(spark, key, a="topic_ca", b="story-1", n=0) == "topic_ca:story-1:v1:00"
    assert one(spark, key, a="topic_ca", b="story-1", n=100) == "topic_ca:story-1:v1:100"
    for a, b, n in (("x:y", "s", 0), ("", "s", 0), ("x", "s", -1)):
        with pytest.raises(PySparkException):
            one(spark, key, a=a, b=b, n=n)


def test_canonical_json():
    assert text.canonical_json({"b": 1, "a": 2}) == '{"a":2,"b":1}'
    assert text.canonical_json([dt.date(2021, 1, 1), "é"]) == '["2021-01-01","\\u00e9"]'
    with pytest.raises(TypeError):
        text.canonical_json(object())
    assert text.canonical_hash({"a": 1, "b": 2}) == text.canonical_hash({"b": 2, "a": 1})


def test_python_functions(spark):
    ship(spark)
    df = spark.createDataFrame([("12", "2024-01-01 00:00:00"), ("Mon, 01 Jan 2024 00:01:30 GMT", "2024-01-01 00:00:00"), ("Mon, 01 Jan 2024 00:00:00 GMT", "2025-01-01 00:00:00"), ("soon", "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00")], "h string, n string")
    got = [r[0] for r in df.select(text.retry_after_seconds("h", F.to_timestamp("n"))).collect()]
    assert got[:3] == [12.0, 90.0, 0.0] and all(v is None or v != v for v in got[3:])
    rules = "User-agent: *\nDisallow: /private/\n"
    df = spark.createDataFrame([(rules, "https://a.test/private/x"), (rules, "https://a.test/x"), (None, "https://a.test/x"), (rules, "http://[bad")], "r string, u string")
    assert [r[0] for r in df.select(text.robots_allowed(F.col("r"), F.col("u"), "reader")).collect()] == [False, True, None, None]
    df = spark.createDataFrame([("éééé",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(text.truncate_utf8(F.col("t"), 1)).collect()] == ["é", "ab", None]


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=60), st.integers(0, 20))
def test_truncation_keeps_whole_characters(value, tokens):
    cut = value.encode()[: tokens * 2].decode(errors="ignore")
    assert value.startswith(cut) and len(cut.encode()) <= tokens * 2


def test_paragraphs(spark):
    page = '<p>lost<!-- <p>x</p> --><script>"<p>y</p>"</script><P class=a>One\n <b>two</b> &amp;lt; &copy;</p ><p> </p><p>three<p>four</p>tail<p>cut'
    assert one(spark, html.paragraphs(F.col("h")), h=page) == "One two &lt; ©\n\nfour"
    assert one(spark, html.paragraphs(F.col("h")), h=None) is None
    assert one(spark, html.paragraphs(F.col("h")), h="no paragraphs") == ""
    body = "<article><p>" + "a" * 30 + "</p></article><p>" + "b" * 80 + "</p>"
    assert one(spark, html.extract(F.col("h"), 20)["extractor"], h=body) == "main_block"
    assert one(spark, html.extract(F.col("h"), 50)["extractor"], h=body) == "paragraphs"
    assert one(spark, html.extract(F.col("h"), 500), h=body) is None


def test_words_for_no_value(spark):
    df = spark.createDataFrame([("x",), (None,), (" ",), ("\u200b\u00a0",), (" N/A ",), ("Unknown",), ("-",), ("0",)], "v string")
    assert [r[0] for r in df.select(filled(F.col("v"))).collect()] == [True, False, False, False, False, False, False, True]


def test_case_folding_is_complete(spark):
    letters = [chr(c) for c in range(0x20, 0x2FA20) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)]
    rows = [(f"x{c}y",) for c in letters] + [("Maße ΣΑΣ ﬁn",), (None,), ("",)]
    got = [(r.v, r.f) for r in spark.createDataFrame(rows, "v string").select("v", text.fold_case(F.col("v")).alias("f")).collect()]
    wrong = [(v, f) for v, f in got if f != (v.casefold() if v is not None else None)]
    assert len(wrong) <= 0.02 * len(got), wrong[:20]  # letters newer than the JVM's tables
    assert dict(got)["Maße ΣΑΣ ﬁn"] == "masse σας fin".replace("ς", "σ")


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_numbered_depends_on_the_order_alone(spark, parts):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("k")).repartition(parts)
    got = sorted((r.ordinal, r.k) for r in numbered(df, "k").collect())
    assert [o for o, _ in got] == list(range(500)) and [k for _, k in got] == sorted(k for _, k in got)
    assert numbered(df.filter("k < 0"), "k").count() == 0


def test_token_count(spark, tmp_path):
    import base64

    ranks = [bytes([i]) for i in range(256)] + [b"ab"]
    (tmp_path / "v.tiktoken").write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(ranks)))
    df = spark.createDataFrame([("abab",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.token_count(F.col("t"), str(tmp_path / "v.tiktoken"), r"\w+|\W+")).collect()] == [2, 1, None]
    assert [r[0] for r in df.select(text.token_count(F.col("t"))).collect()][:2] == [2, 1]
