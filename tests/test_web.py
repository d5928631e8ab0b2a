"""Reading pages with a replaced transport: robots, pace, statuses, byte cap, stored pages."""

import datetime as dt
import json

import pytest

from broadsheet import config
from broadsheet.errors import ConfigurationError
from broadsheet.plans import stages
from broadsheet.sources import web
from broadsheet.sources.store import Warehouse

TEXT = "<html><body><article><p>" + "word " * 200 + "</p></article></body></html>"
SETTINGS = config.FetchConfig(user_agent="reader (a@example.test)", max_response_bytes=5000, min_text_chars=100, per_domain_delay_s=5.0)


class Net:
    """Answers by url; counts what is asked."""

    def __init__(self, pages):
        self.pages, self.asked = pages, []

    def __call__(self, url, headers, timeout):
        self.asked.append(url)
        found = self.pages.get(url, (404, "", "text/plain"))
        if isinstance(found, Exception):
            raise found
        status, content, kind = found
        content = content.encode() if isinstance(content, str) else content
        return web.Response(status, url, {"content-type": kind, "Retry-After": "7"}, iter([content[i : i + 1000] for i in range(0, len(content), 1000)]))


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def reader(pages, **changes):
    net, clock = Net(pages), Clock()
    return web.Reader(config.dataclasses.replace(SETTINGS, **changes), net, 0.5, clock, clock.sleep, lambda a, b: b), net, clock


OPEN = (200, "User-agent: *\nDisallow: /private/", "text/plain")


@pytest.mark.parametrize(
    ("url", "answer", "status"),
    [
        ("https://a.test/1", (200, TEXT, "Text/HTML; charset=utf-8"), "read"), ("https://a.test/1", (403, "no", "text/html"), "blocked"), ("https://a.test/1", (500, "", "text/html"), "fetch_failed"),
        ("https://a.test/1", (200, "x", "application/pdf"), "unsupported_content"), ("https://a.test/1", (200, "x" * 6000, "text/html"), "fetch_failed"), ("https://a.test/1", ConnectionError("gone"), "fetch_failed"),
        ("https://a.test/private/1", (200, TEXT, "text/html"), "robots_denied"), ("ftp://a.test/1", None, "invalid_url"), ("https://[x/1", None, "invalid_url"), (None, None, "invalid_url"), ("https://b.test/1", (200, TEXT, "text/html"), "robots_unavailable"),
    ],
)
def test_statuses(url, answer, status):
    r, net, _ = reader({"https://a.test/robots.txt": OPEN, url: answer})
    rows = r.read("s", url)
    assert rows[-1]["status"] == status and (rows[-1].get("html") is not None) == (status == "read")
    assert ("https://a.test/private/1" in net.asked) is False and len(rows) <= 2


def test_long_bodies_are_read_no_further():
    taken = []

    def chunks():
        for i in range(100):
            taken.append(i)
            yield b"x" * 1000

    with pytest.raises(ValueError):
        web.body(web.Response(200, "u", {}, chunks()), 5000)
    assert len(taken) == 6


def test_rules_are_read_once_and_a_domain_is_given_time():
    r, net, clock = reader({"https://a.test/robots.txt": OPEN, "https://c.test/robots.txt": OPEN, **{f"https://a.test/{i}": (200, TEXT, "text/html") for i in range(3)}})
    for i in range(3):
        r.read(str(i), f"https://a.test/{i}")
    assert net.asked.count("https://a.test/robots.txt") == 1 and clock.now >= 3 * 5.0
    before = clock.now
    r.read("x", "https://c.test/robots.txt")
    assert clock.now - before <= 5.0 + 2 * 2.0  # the rate, one pause for the same domain


@pytest.mark.parametrize(("content", "kind", "text"), [("é".encode("latin-1"), "text/html; charset=ISO-8859-1", "é"), ("é".encode(), "text/html", "é"), (b"\xff", None, "�"), (b"a", "text/html; charset=nonsense", "a")])
def test_declared_encodings(content, kind, text):
    assert web.decoded(content, kind) == text


def test_only_a_named_reader_may_ask(spark):
    with pytest.raises(ConfigurationError):
        web.fetch_pages(spark.createDataFrame([], "story_id string, url string"), config.FetchConfig())


def transport():
    pages = {"https://a.test/robots.txt": OPEN, "https://a.test/1": (200, TEXT, "text/html"), "https://a.test/2": (403, "", "text/html")}
    return Net(pages)


def test_pages_are_stored_and_used_again(spark, tmp_path):
    topic = config.TopicConfig(label="T", query="q", start_date=dt.date(2021, 1, 1), end_date=dt.date(2021, 1, 9), collection_ids=(1,))
    settings = config.AppConfig({"t": topic}, fetch=config.dataclasses.replace(SETTINGS, global_max_rps=1000.0, per_domain_delay_s=0.01))
    store = Warehouse(spark, str(tmp_path / "w"))
    store.initialise()
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    store.commit({
        "stories": make([(f"s{i}", f"A title number {i}", f"https://a.test/{i}") for i in (1, 2)], "story_id string, title string, url string"),
        "story_topic_state": make([("t", f"s{i}", "ok") for i in (1, 2)], "topic string, story_id string, qc_status string"),
        "search_windows": make([("w", "t")], "window_id string, topic string"), "search_hits": make([("w", f"s{i}") for i in (1, 2)], "window_id string, story_id string"),
    })
    summary = stages.fetch(store, settings, "t", transport=transport)
    assert (summary.processed, summary.succeeded, summary.failed) == (2, 1, 1)
    assert {r.story_id: r.fetch_status for r in store.read("articles").collect()} == {"s1": "ok", "s2": "blocked"}
    assert [r.story_id for r in store.read("raw_pages").collect()] == ["s1"]
    log = [(r.story_id, r.source, r.attempt_number) for r in store.read("fetch_attempts").orderBy("story_id", "attempt_number").collect()]
    assert sorted(x[1] for x in log) == ["page", "page", "robots"] and len({(a, c) for a, _, c in log}) == 3
    store.commit({"articles": store.read("articles").filter("story_id <> 's1'")})
    again = stages.fetch(store, settings, "t")  # no transport: the stored page is enough, the other stays pending
    assert (again.processed, again.succeeded, again.skipped) == (2, 1, 1)


def test_answers_survive_a_stopped_run(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"))
    wanted = spark.createDataFrame([(f"b{i}", f"h{i}", f"prompt {i}", [f"s{i}"]) for i in range(4)], "batch_id string, prompt_hash string, prompt string, expected array<string>")
    asked = []

    def client(prompt):
        asked.append(prompt)
        if len(asked) == 3:
            raise KeyboardInterrupt
        return json.dumps({"p": prompt})

    with pytest.raises(KeyboardInterrupt):
        stages.answered(store, wanted, "t/screening", client, 2, None)
    got = {r.batch_id: r.content for r in stages.answered(store, wanted, "t/screening", client, 2, None).collect()}
    assert asked == ["prompt 0", "prompt 1", "prompt 2", "prompt 2", "prompt 3"] and set(got) == {f"b{i}" for i in range(4)}


def test_stored_pages(spark, tmp_path):
    import gzip

    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / "s1.html.gz").write_bytes(gzip.compress(TEXT.encode()))
    (tmp_path / "ab" / "s2.html.gz").write_bytes(b"no archive")
    (tmp_path / "other.txt").write_text("x")
    assert {r.story_id: r.html for r in web.stored_pages(spark, str(tmp_path)).collect()} == {"s1": TEXT, "s2": None}


def first(page):
    return "x" * 200 if "long" in page else None


def broken(page):
    raise RuntimeError(page)


def test_outside_parsers_come_first(spark):
    from pyspark.sql import functions as F

    from broadsheet.functions import html

    pages = spark.createDataFrame([("a", "<p>long</p>"), ("b", TEXT), ("c", None)], "k string, html string")
    got = {r.k: r.x and r.x.extractor for r in pages.select("k", html.extract(F.col("html"), 100, {"broken": broken, "first": first}).alias("x")).collect()}
    assert got == {"a": "first", "b": "main_block", "c": None}
    assert set(html.installed()) <= set(html.PARSERS)
