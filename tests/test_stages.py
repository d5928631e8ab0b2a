"""Quality rules, duplicates, and the whole chain of stages over a small warehouse."""

import csv
import datetime as dt
import json

import pytest

from broadsheet import cli, config, schemas
from broadsheet.errors import ConfigurationError, CredentialError, ExportFailure, ExtractionFailure, StorageError
from broadsheet.operators import batches, quality, upsert, windows
from broadsheet.plans import stages
from broadsheet.sources import csv_files, pages
from broadsheet.sources.store import Warehouse

LONG = "A headline that is long enough for the rules"
TOPIC = config.TopicConfig(
    label="Topic", query="q", start_date=dt.date(2021, 1, 1), end_date=dt.date(2021, 12, 31), collection_ids=(1,), domain_allowlist=("example.test",),
    quality=config.QualityConfig(20, ("/sports/",), ("football", "National Hockey  League")), fields=(config.ExtractionField("person"), config.ExtractionField("years", regex=r"\d{4}(?:-\d{4})?")),
)


def _stories(spark, rows):
    return spark.createDataFrame(rows, "story_id string, title string, url string, publish_date string, language string, media_name string")


def _story(i, title=None, url="", date="2021-06-01", lang="en", media=None):
    return (i, title or f"{LONG} {i}", f"https://www.example.test/{i}" if url == "" else url, date, lang, media)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_rules_and_duplicates(spark, parts):
    rows = [
        _story("a-title", f"{LONG} - Outlet", date="2021-04-01", media="Outlet"),
        _story("bad-lang", lang="fr", date="2020-01-01", url="https://[x"),
        _story("bad-url", url=None),
        _story("off-domain", url="https://outside.test/1"),
        _story("out-of-range", date="2022-01-01"),
        _story("short-title", "Short"),
        _story("url-earlier", url="https://example.test/same?utm_source=x", date="2021-02-01"),
        _story("url-later", url="http://www.example.test/same/", date="2021-03-01"),
        _story("z-title", f"{LONG} | Other", media="other"),
        _story("term", "National-hockey league rules are changing"),
    ]
    df = _stories(spark, rows).repartition(parts)
    got = {r.story_id: (r.qc_status, r.qc_reason, r.dup_of_story_id) for r in quality.deduplicate(df, TOPIC).collect()}
    assert got == {
        "a-title": ("ok", None, None), "bad-lang": ("bad_lang", "bad_lang", None), "bad-url": ("bad_url", "bad_url", None), "off-domain": ("off_domain", "off_domain", None),
        "out-of-range": ("out_of_range", "out_of_range", None), "short-title": ("short_title", "short_title", None), "url-earlier": ("ok", None, None),
        "url-later": ("dup", "duplicate_url", "url-earlier"), "z-title": ("dup", "duplicate_title", "a-title"),
        "term": ("excluded_title", "excluded_title:national hockey league", None),
    }
    assert tuple(quality.summary(quality.deduplicate(df, TOPIC), "t").first()) == ("t", 10, 2, 8, 0)


def test_chain_and_null_keys(spark):
    rows = [
        _story("title-canonical", LONG, date="2021-01-01"), _story("url-canonical", LONG, url="https://example.test/u", date="2021-02-01"),
        _story("url-copy", url="https://example.test/u", date="2021-03-01"), _story("n1", "." * 30), _story("n2", "." * 30),
    ]
    got = {r.story_id: (r.qc_reason, r.dup_of_story_id) for r in quality.deduplicate(_stories(spark, rows), TOPIC).collect()}
    assert got["url-canonical"] == ("duplicate_title", "title-canonical") and got["url-copy"] == ("duplicate_url", "title-canonical")
    assert got["n1"] == got["n2"] == (None, None)
    assert quality.deduplicate(_stories(spark, []), TOPIC).count() == 0


def test_windows(spark):
    got = [(r.window_start, r.window_end) for r in windows.date_windows(spark, dt.date(2020, 2, 28), dt.date(2020, 3, 2), 2).collect()]
    assert got == [(dt.date(2020, 2, 28), dt.date(2020, 2, 29)), (dt.date(2020, 3, 1), dt.date(2020, 3, 2))]
    base = {"query": "q", "platform": "p", "collections": [2, 1], "sources": [], "languages": ["fr", "en"]}
    assert windows.query_hash(**base) == windows.query_hash(**(base | {"collections": [1, 2], "languages": ["en", "fr"]}))
    assert windows.fingerprint(dt.date(2020, 1, 1), dt.date(2020, 1, 2), **base) != windows.fingerprint(dt.date(2020, 1, 1), dt.date(2020, 1, 3), **base)


def test_change_only_and_stale(spark):
    old = spark.createDataFrame([("t", "a", "ok", None, dt.datetime(2020, 1, 1)), ("t", "b", None, "x", dt.datetime(2020, 1, 1)), ("t", "gone", "ok", None, dt.datetime(2020, 1, 1))], "topic string, story_id string, s string, r string, at timestamp")
    new = spark.createDataFrame([("t", "a", "ok", None), ("t", "b", "ok", "x"), ("t", "c", None, None)], "topic string, story_id string, s string, r string")
    later = dt.datetime(2021, 1, 1)
    got = {r.story_id: r.at for r in upsert.change_only(old, new, ["topic", "story_id"], ["s", "r"], "at", later).collect()}
    assert got == {"a": dt.datetime(2020, 1, 1), "b": later, "c": later}
    assert [r.story_id for r in upsert.stale(old, new, ["topic", "story_id"]).collect()] == ["gone"]
    log = spark.createDataFrame([("k", 1, "a", "r1"), ("k", 2, None, None), ("k", 3, "c", None)], "k string, seq int, v string, raw string")
    assert tuple(upsert.coalesced(log.filter("seq < 3"), ["k"], ["seq"], ["raw"]).select("v", "raw").first()) == ("a", None)


def test_packing():
    big = "x" * 10_000
    got = batches.pack([("1", "t", big, 2020), ("2", "t", big, None)], 20, 20, 2_000, None)
    assert [[s for s, _ in b] for b in got] == [["1"], ["2"]] and len(got[0][0][1]) < 10_000
    tiny = [(str(i), "t", "x", 2020) for i in range(11)]
    assert [len(b) for b in batches.pack(tiny, 20, 20, 10_000, 10)] == [10, 1]
    with pytest.raises(ConfigurationError):
        batches.pack([("1", "t", big, None)], 20, 20, 10, None)
    for b in batches.pack([(str(i), None, "é" * (37 * i % 400), None) for i in range(300)], 50, 30, 600, None):
        size = 50 + sum(len(batches.article_block(s, None, t, None).encode()) + 2 for s, t in b)
        assert batches.estimate(30) + batches.PROMPT_OVERHEAD + batches.estimate(size) <= 600


def test_packed_keeps_order_and_rows(spark):
    df = spark.createDataFrame([("t", i, f"s{i:03}", None, "word " * (i % 50), None) for i in range(200)], "topic string, ordinal long, story_id string, title string, text string, year int")
    out = batches.packed(df, 500, 7).orderBy("shard", "batch_no", "position").collect()
    assert [r.story_id for r in out] == [f"s{i:03}" for i in range(200)]
    assert batches.packed(df.limit(0), 500, 7).count() == 0


@pytest.mark.parametrize(
    ("content", "phase", "status"),
    [
        ('{"decisions":[{"story_id":"1","relevant":"yes"},{"story_id":"2","relevant":0}]}', "screening", "valid"),
        ('{"decisions":[{"story_id":"1","relevant":true}]}', "screening", "invalid"),
        ('{"decisions":[{"story_id":"1","relevant":true},{"story_id":"1","relevant":true}]}', "screening", "invalid"),
        ('{"decisions":[{"story_id":1,"relevant":true},{"story_id":"2","relevant":true}]}', "screening", "invalid"),
        ("not json", "screening", "unparsed"),
        (None, "extraction", "unparsed"),
        ('{"results":[]}', "extraction", "valid"),
        ('{"results":[{"story_id":"1","cases":[{"person":"A","years":"2020"}]}]}', "extraction", "valid"),
        ('{"results":[{"story_id":"1","cases":[{"person":"A","years":"May 2020"}]}]}', "extraction", "invalid"),
        ('{"results":[{"story_id":"1","cases":[{"person":"A","years":"2020\\n"}]}]}', "extraction", "invalid"),
        ('{"results":[{"story_id":"1","cases":[{"extra":"A"}]}]}', "extraction", "invalid"),
        ('{"results":[{"story_id":"9","cases":[]}]}', "extraction", "invalid"),
    ],
)
def test_responses(content, phase, status):
    assert batches.check_response(content, ["1", "2"], TOPIC.fields, phase)[0] == status


def test_config():
    with pytest.raises(ConfigurationError):
        config.ExtractionField("not a name")
    with pytest.raises(ConfigurationError):
        config.ExtractionField("x", regex="(")
    with pytest.raises(ConfigurationError):
        config.QualityConfig(exclude_title_terms=("A b", "a  B"))
    with pytest.raises(ConfigurationError):
        config.positive("n", True)
    with pytest.raises(ConfigurationError):
        config.FetchConfig(user_agent="x").check_live()
    assert config.ModelConfig(screening_max_input_tokens=5).budget("screening") == 5
    assert TOPIC.quality.exclude_title_terms == ("football", "national hockey league")


def test_credentials(tmp_path, monkeypatch):
    (tmp_path / "env").write_text("# c\nexport A_KEY='x'\nB_KEY=\n")
    monkeypatch.delenv("A_KEY", raising=False)
    assert config.credential("A_KEY", tmp_path / "env") == "x"
    monkeypatch.setenv("A_KEY", "y")
    assert config.credential("A_KEY", tmp_path / "env") == "y"
    with pytest.raises(CredentialError):
        config.credential("B_KEY", tmp_path / "env")


def test_csv_is_reconciled(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc', None, True)], "i int, s string, n string, b boolean")
    path = tmp_path / "x.csv"
    assert csv_files.write([(path, df, ["i", "s", "n", "b"], 1)]) == [1]
    assert path.read_bytes() == b'i,s,n,b\r\n1,"a ""b""\nc",,1\r\n'
    with pytest.raises(ExportFailure):
        csv_files.write([(path, df.limit(0), ["i", "s", "n", "b"], 1)])
    assert path.read_bytes().startswith(b"i,s") and len(list(tmp_path.iterdir())) == 1


def test_store(spark, tmp_path):
    with pytest.raises(StorageError):
        Warehouse(spark, str(tmp_path / "none"), must_exist=True)
    store = Warehouse(spark, str(tmp_path / "w"))
    assert set(store.initialise()["tables"]) == set(schemas.tables())
    row = spark.createDataFrame([("s1", "t")], "story_id string, title string")
    store.commit({"stories": row})
    store.commit({"stories": store.read("stories").unionByName(schemas.conform(spark.createDataFrame([("s2", "u")], "story_id string, title string"), "stories"))})
    assert store.read("stories").count() == 2
    assert store.prune(keep=1) >= 2 and store.read("stories").count() == 2
    bad = spark.createDataFrame([("t", "s", "v", "nonsense")], "topic string, story_id string, prompt_version string, validation_status string")
    with pytest.raises(Exception):  # noqa: B017, PT011
        store.commit({"story_extractions": bad})
    assert store.read("story_extractions").count() == 0


def _pages(folder):
    story = lambda i, **k: {"id": f"s{i}", "title": f"{LONG} number {i}", "url": f"https://www.example.test/{i}", "publish_date": "2021-01-05", "language": "en", "media_name": "Outlet", "text": "word " * 200} | k
    first = folder / "2021-01-01_2021-01-30"
    first.mkdir(parents=True)
    (first / "1.json").write_text(json.dumps({"stories": [story(1), {"id": 42, "title": "bad"}, story(2, url="https://[bad")]}))
    (first / "2.json").write_text(json.dumps({"stories": [story(3), story(1, title=None)]}))
    return first


def test_page_source(spark, tmp_path):
    _pages(tmp_path)
    pages.register(spark)
    options = {"windows": json.dumps([["2021-01-01", "2021-01-30"], ["2021-01-31", "2021-03-01"]]), "argument": str(tmp_path)}
    df = spark.read.format("story_pages").options(**options).load()
    good, bad = pages.stories_of(df, 1000)
    assert sorted((r.story_id, r.result_rank, r.domain) for r in good.collect()) == [("s1", 1, "www.example.test"), ("s1", 1002, "www.example.test"), ("s2", 3, None), ("s3", 1001, "www.example.test")]
    assert [(r.result_rank, json.loads(r.raw_json)["id"]) for r in bad.collect()] == [(2, 42)]
    counts = {str(r.window_start): r.total_count for r in spark.read.format("story_pages").options(**options, mode="count").load().collect()}
    assert counts == {"2021-01-01": 5, "2021-01-31": 0}


def test_stream(spark, tmp_path):
    from broadsheet.streaming import ingest

    _pages(tmp_path / "pages")
    store = Warehouse(spark, str(tmp_path / "w"))
    options = {"windows": json.dumps([["2021-01-01", "2021-01-30"]]), "argument": str(tmp_path / "pages")}
    query = ingest.start(spark, store, options, 1000, str(tmp_path / "checkpoint"))
    try:
        deadline = dt.datetime.now() + dt.timedelta(seconds=60)
        while store.read("search_hits").count() < 3 and dt.datetime.now() < deadline and query.isActive:
            query.awaitTermination(1)
    finally:
        query.stop()
    assert sorted(r.story_id for r in store.read("search_hits").collect()) == ["s1", "s2", "s3"]
    assert store.read("stories").count() == 3


def _answer(prompt):
    ids = json.loads("[" + ",".join(x.split("\n")[0].strip("[]") for x in prompt.split("Article ")[1:]) + "]")
    if prompt.startswith("For every"):
        return json.dumps({"decisions": [{"story_id": i, "relevant": i == "s1"} for i in ids]})
    return json.dumps({"results": [{"story_id": i, "cases": [{"person": "Ann", "years": "2020"}]} for i in ids]})


def test_whole_chain(spark, tmp_path, capsys):
    _pages(tmp_path / "pages")
    settings = {"topics": {"t": {"label": "T", "query": "q", "start_date": "2021-01-01", "end_date": "2021-01-30", "collection_ids": [1], "fields": [{"name": "person"}, {"name": "years", "regex": r"\d{4}"}]}}}
    (tmp_path / "c.json").write_text(json.dumps(settings))
    base = ["--warehouse", str(tmp_path / "w"), "--config", str(tmp_path / "c.json")]
    run = lambda *a: cli.main([*base, *a], spark)
    assert run("init-db") == 0 and run("dedup", "--topic", "nope") == ConfigurationError.exit_code
    assert run("search", "--topic", "t", "--argument", str(tmp_path / "pages")) == 0
    store, loaded = Warehouse(spark, str(tmp_path / "w")), config.load(tmp_path / "c.json")
    assert store.read("pipeline_runs").filter("stage = 'search' AND status = 'complete'").count() == 1
    before = len(store._manifests())
    assert run("probe", "--topic", "t", "--argument", str(tmp_path / "pages"), "--windows", "2") == 0 and len(store._manifests()) == before
    assert store.read("stories").filter("story_id = 's1'").first().title is not None  # kept over a later null
    assert run("search", "--topic", "t", "--argument", str(tmp_path / "nowhere")) == 0  # complete: nothing is asked again
    assert run("dedup", "--topic", "t") == 0
    before = {r.story_id: r.decided_at for r in store.read("story_topic_state").collect()}
    assert run("dedup", "--topic", "t") == 0
    assert {r.story_id: r.decided_at for r in store.read("story_topic_state").collect()} == before and len(before) == 3
    assert run("fetch", "--topic", "t", "--dry-run") == 0 and run("fetch", "--topic", "t") == 0
    assert store.read("articles").filter("fetch_status = 'ok'").count() == 2
    assert run("extract", "--topic", "t", "--dry-run") == 0 and store.read("extraction_batches").count() == 0
    first, second = stages.extract_cases(store, loaded, "t", _answer)
    assert (first.processed, first.succeeded, second.processed) == (2, 2, 1)
    assert [r.case_id for r in store.read("cases").collect()] == ["t:s1:extract-1:00"]
    again, more = stages.extract_cases(store, loaded, "t", _answer)
    assert again.processed == more.processed == 0
    assert run("export", "--topic", "t", "--output", str(tmp_path / "out")) == 0
    with (tmp_path / "out" / "t_cases.csv").open(newline="") as f:
        assert [r["person"] for r in csv.DictReader(f)] == ["Ann"]
    with (tmp_path / "out" / "t_audit.csv").open(newline="") as f:
        assert {r["story_id"]: r["extraction_status"] for r in csv.DictReader(f)} == {"s1": "valid", "s2": "", "s3": ""}
    for kind in ("search", "dedup", "fetch"):
        assert run(f"review-{kind}", "--topic", "t", "--output", str(tmp_path / f"{kind}.csv")) == 0
    stages.reset(store, "t")
    assert store.read("cases").count() == 0
    assert "Article" in stages.manual_request(store, loaded, "t", "screening")
    capsys.readouterr()


def test_failed_answers(spark, tmp_path):
    def broken(prompt):
        raise ExtractionFailure("no")

    one = spark.createDataFrame([("b", "p", ["1", "2"])], "batch_id string, prompt string, expected array<string>")
    out = batches.run_client(one, broken, 3).collect()
    assert (out[0].attempts, out[0].content, out[0].error) == (3, None, "no")
    got = batches.checked(spark.createDataFrame(out, "batch_id string, content string, expected array<string>, attempts int, error string"), TOPIC.fields, "screening").collect()
    assert [(r.story_id, r.validation_status, r.relevant) for r in got] == [("1", "unparsed", None), ("2", "unparsed", None)]
    omitted = spark.createDataFrame([("b", '{"results":[]}', ["1"])], "batch_id string, content string, expected array<string>")
    r = batches.checked(omitted, TOPIC.fields, "extraction").first()
    assert (r.validation_status, r.relevant, r.omitted) == ("valid", False, True)


def test_orphans(spark):
    child = spark.createDataFrame([("1",), ("2",), (None,)], "story_id string")
    assert [r.story_id for r in schemas.orphans(child, "story_id", spark.createDataFrame([("1",)], "story_id string")).collect()] == ["2"]


def test_added_rows_are_merged_when_read(spark, tmp_path, monkeypatch):
    from broadsheet.sources import store as stores

    w = Warehouse(spark, str(tmp_path / "w"))
    row = lambda i, title, raw, at: spark.createDataFrame([(i, title, raw, dt.datetime(2021, 1, at))], "story_id string, title string, raw_json string, first_seen_at timestamp")
    w.commit({"stories": row("a", "one", "r1", 1)})
    w.commit({}, {"stories": row("a", None, None, 2)})
    w.commit({}, {"stories": row("b", "two", "r2", 3)})
    got = {r.story_id: (r.title, r.raw_json, r.first_seen_at.day) for r in w.read("stories").collect()}
    assert got == {"a": ("one", None, 1), "b": ("two", "r2", 3)} and len(w.manifest()["tables"]["stories"]) == 3
    monkeypatch.setattr(stores, "MOST_PARTS", 3)
    w.commit({}, {"stories": row("b", "three", "r3", 4)})
    assert isinstance(w.manifest()["tables"]["stories"], str)
    assert {r.story_id: (r.title, r.first_seen_at.day) for r in w.read("stories").collect()} == {"a": ("one", 1), "b": ("three", 3)}
    assert w.prune(1) >= 4 and w.read("stories").count() == 2
