"""Normal times against a plain statement of the rules with zoneinfo."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import timestamps

OUTLETS = [("a.test", "America/Toronto", "MDY"), ("b.test", "America/St_Johns", "DMY"), ("c.test", "America/Regina", "DMY")]
CASES = [
    # publish_date, indexed_at, host -> day, second
    ("2021-11-06", "2021-11-06T05:09:07Z", "a.test", "2021-11-06", "2021-11-06T05:09:07Z"),
    ("11/05/2021", "2021-11-07T01:30:00", "a.test", "2021-11-05", None),  # two instants
    ("11/05/2021", "2022-03-13T02:26:00", "b.test", "2021-05-11", None),  # skipped
    ("22/02/2025", "15/05/2025 23:17", "b.test", "2025-02-22", "2025-05-16T01:47:00Z"),
    ("02/22/2025", "02/22/2025 11:17 PM", "b.test", None, None),  # month 22
    ("2023-02-30", "2023-13-05T09:10:00Z", "a.test", None, None),
    ("0000-00-00", "2023-06-01T25:10:00Z", "a.test", None, None),
    ("1er avril 2025", "15 mai 2025 à 2 h 04", "a.test", "2025-04-01", "2025-05-15T06:04:00Z"),
    ("22 Jun 2022", "28 mars 2024 à 1 h 13 (HAE)", "c.test", "2022-06-22", "2024-03-28T05:13:00Z"),
    ("Mon, Mar 27, 2023", "Feb 27, 2023 6:03 AM NST", "c.test", "2023-03-27", "2023-02-27T09:33:00Z"),
    ("November 22, 2024", "Apr 8, 2022 12:43 p.m. EDT", "c.test", "2024-11-22", "2022-04-08T16:43:00Z"),
    ("July 3, 2023", "Dec 20, 2022 12:53 AM EST", "c.test", "2023-07-03", "2022-12-20T05:53:00Z"),
    ("20230710", "20250828T124942Z", "c.test", "2023-07-10", "2025-08-28T12:49:42Z"),
    ("1744753399", "1721791015963", "c.test", "2025-04-15", "2024-07-24T03:16:55Z"),
    ("2023-05-26T23:14:41", "1718216235071149", "a.test", "2023-05-27", "2024-06-12T18:17:15Z"),
    ("2023-05-26 23:14", " 2023-04-17 03:17:33 -0400\u00a0", "c.test", "2023-05-27", "2023-04-17T07:17:33Z"),
    ("2025-09-12T23:01:31-04:00", "Tue, 13 Jul 2021 02:12:54 -0230", "a.test", "2025-09-13", "2021-07-13T04:42:54Z"),
    ("2021/07/08", "Fri, 27 May 2022 07:46:08 GMT", "a.test", "2021-07-08", "2022-05-27T07:46:08Z"),
    ("2022", "2022-05-27", "a.test", None, None),
    ("yesterday", "null", "a.test", None, None),
    ("11/05/2021", "2021-06-07T01:30:00", "unknown.test", None, None),
    (None, "", "a.test", None, None),
    ("x" * 100_000, " ", "a.test", None, None),
    ("2023-05-26 23:14:00.123456", "2021-10-26T09:51:38,971", "a.test", "2023-05-27", "2021-10-26T13:51:38Z"),
]


def _frames(spark, rows):
    stories = spark.createDataFrame(
        [(str(i), p, x, f"https://www.{h}/s", None, "kept", "kept too") for i, (p, x, h, _, _) in enumerate(rows)],
        "story_id string, publish_date string, indexed_at string, url string, domain string, outlet_tz string, o_tz string",
    )
    return stories, spark.createDataFrame(OUTLETS, "domain string, tz string, date_order string")


def test_table_of_notations(spark):
    got = {r.story_id: r for r in timestamps.normal_times(*_frames(spark, CASES)).collect()}
    for i, (p, x, h, day, second) in enumerate(CASES):
        assert (got[str(i)].publish_day, got[str(i)].indexed_utc) == (day, second), (p and p[:40], x, h)
        assert (got[str(i)].outlet_tz, got[str(i)].o_tz) == ("kept", "kept too")


def test_local_times_against_zoneinfo(spark):
    start = dt.datetime(2022, 3, 12)
    locals_ = [start + dt.timedelta(minutes=37 * i) for i in range(120)] + [dt.datetime(2022, 11, 5, 20) + dt.timedelta(minutes=17 * i) for i in range(80)]
    rows = [("2022-01-01", t.strftime("%Y-%m-%d %H:%M:%S"), h, None, None) for t in locals_ for h in ("a.test", "b.test", "c.test")]
    got = {r.story_id: r.indexed_utc for r in timestamps.normal_times(*_frames(spark, rows)).collect()}
    zones = {d: ZoneInfo(z) for d, z, _ in OUTLETS}
    for i, (_, text, h, _, _) in enumerate(rows):
        wall, zone = dt.datetime.fromisoformat(text), zones[h]
        fits = set()
        for fold in (0, 1):
            utc = wall.replace(tzinfo=zone, fold=fold).astimezone(dt.timezone.utc)
            if utc.astimezone(zone).replace(tzinfo=None) == wall:
                fits.add(utc.strftime("%Y-%m-%dT%H:%M:%SZ"))
        assert got[str(i)] == (fits.pop() if len(fits) == 1 else None), (text, h)


def test_domain_is_the_second_choice_and_empty_tables(spark):
    stories = spark.createDataFrame([("1", "05/04/2022", None, None, "WWW.b.test "), ("2", "05/04/2022", None, "not a url", None)], "story_id string, publish_date string, indexed_at string, url string, domain string")
    outlets = spark.createDataFrame(OUTLETS, "domain string, tz string, date_order string")
    got = {r.story_id: r.publish_day for r in timestamps.normal_times(stories, outlets).collect()}
    assert got == {"1": "2022-04-05", "2": None}
    assert timestamps.normal_times(stories.limit(0), outlets).count() == 0
    assert timestamps.normal_times(stories, outlets.limit(0)).filter(F.col("publish_day").isNotNull()).count() == 0


@pytest.mark.parametrize("copies", [1, 3])
def test_found_has_no_repeats(spark, tmp_path, copies):
    stories, outlets = _frames(spark, CASES)
    for _ in range(copies - 1):
        stories = stories.unionAll(stories)
    stories.write.parquet(str(tmp_path / "stories.parquet"))
    outlets.write.parquet(str(tmp_path / "outlets.parquet"))
    rows = timestamps.found(spark, str(tmp_path)).collect()
    assert len(rows) == len({(r.story_id, r.field_name) for r in rows})
    assert ("0", "publish_date") not in {(r.story_id, r.field_name) for r in rows}
    assert ("15", "indexed_at", "2023-04-17T07:17:33Z") in {tuple(r) for r in rows}
