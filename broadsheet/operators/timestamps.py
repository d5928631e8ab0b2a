"""Dates and times written in many notations, brought to one form.

An ordered cascade of anchored patterns decides which notation a value is written in; the
first pattern that matches the whole value wins, and its parts are then parsed strictly, so
that a value with month 13 or 30 February is unknown instead of being shifted. Everything is
built from JVM expressions: no shuffle, no Python, one scan.

Policy for values that need a zone:

* an offset or a known zone abbreviation in the value wins over everything;
* otherwise the zone of the source is taken from a lookup; without one the value is unknown;
* a local time the source's clock skipped is unknown;
* a local time that fits two instants is unknown for instants, and for days only where the
  two instants fall on two UTC days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.session import strip_blanks, table

# Month names and their abbreviations, English and French, and zone abbreviations.
MONTHS = {
    "jan": 1, "january": 1, "janvier": 1, "janv": 1,
    "feb": 2, "february": 2, "février": 2, "fevrier": 2, "févr": 2,
    "mar": 3, "march": 3, "mars": 3,
    "apr": 4, "april": 4, "avril": 4, "avr": 4,
    "may": 5, "mai": 5,
    "jun": 6, "june": 6, "juin": 6,
    "jul": 7, "july": 7, "juillet": 7, "juil": 7,
    "aug": 8, "august": 8, "août": 8, "aout": 8,
    "sep": 9, "sept": 9, "september": 9, "septembre": 9,
    "oct": 10, "october": 10, "octobre": 10,
    "nov": 11, "november": 11, "novembre": 11,
    "dec": 12, "december": 12, "décembre": 12, "decembre": 12, "déc": 12,
}
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "hnt": -210, "hat": -150, "hna": -240, "haa": -180, "hne": -300, "hae": -240,
    "hnc": -360, "hac": -300, "hnr": -420, "har": -360, "hnp": -480, "hap": -420,
}

_NAME = r"([a-zéûôà]{3,9})\.?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s*([ap])\.?\s?m\.?)?"
_ZONE = r"(?:\s*\(?(z|[a-z]{3}|[+-]\d{2}(?::?\d{2})?)\)?)?"

#: (pattern, order of the groups before the clock); y, m, d are figures, n a month name, a and b
#: figures whose order the source decides. Clock groups are hour, minute, second, half, zone.
NOTATIONS = (
    (r"(\d{4})-(\d{2})-(\d{2})", "ymd"),
    (r"(\d{4})/(\d{2})/(\d{2})", "ymd"),
    (r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", "aby"),
    (rf"{_WEEKDAY}(\d{{1,2}})(?:er)?\s+{_NAME},?\s+(\d{{4}})", "dny"),
    (rf"{_WEEKDAY}{_NAME}\s+(\d{{1,2}}),?\s+(\d{{4}})", "ndy"),
)
_CLOCKED = rf"(?:(?:t|,?\s+)(?:at\s+)?{_CLOCK}{_ZONE})?"
_FRENCH_CLOCK = rf"\s+à\s+(\d{{1,2}})\s*h\s*(\d{{2}})()()" + _ZONE
_COMPACT = r"(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(\d{2})?()" + _ZONE + ")?"


def _map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _parts(value: Column, day_first: Column) -> Column:
    """Struct of the strings the first fitting notation finds; null where none fits."""

    def pick(pattern: str, layout: str) -> Column:
        group = lambda i: F.regexp_extract(value, f"^{pattern}$", i)
        at = {c: group(i + 1) for i, c in enumerate(layout)}
        if "a" in at:
            at["d"] = F.when(day_first, at["a"]).when(~day_first, at["b"])
            at["m"] = F.when(day_first, at["b"]).when(~day_first, at["a"])
        month = _map(MONTHS)[at["n"]] if "n" in at else at["m"].cast("int")
        rest = [group(len(layout) + i) for i in range(1, 6)]
        fields = [at["y"].cast("int"), month, at["d"].cast("int"), *rest]
        names = ["y", "m", "d", "hh", "mi", "ss", "half", "zone"]
        return F.when(value.rlike(f"^{pattern}$"), F.struct(*[c.alias(n) for c, n in zip(fields, names, strict=True)]))

    cascade = [pick(p + _CLOCKED, layout) for p, layout in NOTATIONS]
    cascade += [pick(NOTATIONS[3][0] + _FRENCH_CLOCK, "dny"), pick(_COMPACT, "ymd")]
    return F.coalesce(*cascade)


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each evaluated once.

    They come out of a one-row generator, which the optimizer doesn't look through: a filter on a
    result can't be rewritten into the whole nested expression, which grows with every level.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse(df: DataFrame, value: str, zone: str, day_first: str, out: str) -> DataFrame:
    """Add struct ``out`` (day, instant, timed) for the string column ``value``.

    ``zone`` names a column with the source's zone, ``day_first`` one that says whether a day in
    figures comes before the month; null in either means unknown. ``day`` is the UTC day where a
    time of day is given, else the day as written; ``instant`` is a UTC timestamp, null where no
    single one fits. Null, blank, impossible and partial values give nulls in every field.
    Extra columns pass through untouched; temporary columns carry a reserved prefix.
    """
    t = "__ts_"
    v = F.lower(strip_blanks(F.regexp_replace(F.col(value), r"[\u00a0\u2009\u202f]", " ")))
    df = df.withColumn(t + "v", v)
    df = _settled(df, **{t + "p": _parts(F.col(t + "v"), F.col(day_first))})
    p = F.col(t + "p")
    hour = F.expr(f"try_cast({t}p.hh AS INT)")
    hour = F.when(p["half"] == "", hour).when(hour.between(1, 12), hour % 12 + F.when(p["half"] == "p", 12).otherwise(0))
    second = F.when(p["ss"] == "", 0).otherwise(F.expr(f"try_cast({t}p.ss AS INT)"))
    timed = p["hh"] != ""
    day = F.when(
        p["y"].between(1, 9999) & p["m"].between(1, 12) & p["d"].between(1, 31),
        F.expr(f"try_to_date(format_string('%04d-%02d-%02d', {t}p.y, {t}p.m, {t}p.d), 'yyyy-MM-dd')"),
    )
    minute = F.expr(f"try_cast({t}p.mi AS INT)")
    sound = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    offset = F.coalesce(
        _map(ZONE_MINUTES)[p["zone"]],
        F.when(
            p["zone"].rlike(r"^[+-]"),
            F.when(p["zone"].startswith("-"), -1).otherwise(1) * (F.substring(p["zone"], 2, 2).cast("int") * 60 + F.when(F.length(p["zone"]) > 3, F.expr(f"right({t}p.zone, 2)").cast("int")).otherwise(0)),
        ),
    )
    epoch = F.col(t + "v").rlike(r"^(?:\d{10}|\d{13}|\d{16})$")
    df = _settled(
        df,
        **{
            t + "day": day,
            t + "timed": F.coalesce(timed, epoch, F.lit(False)),
            t + "local": F.when(timed & sound & day.isNotNull(), F.unix_timestamp(day.cast("timestamp")) + hour * 3600 + minute * 60 + second),
            t + "offset": F.when(p["zone"] != "", F.coalesce(offset, F.lit(9999))),
            t + "epoch": F.when(epoch, F.expr(f"try_cast(left({t}v, 10) AS BIGINT)")),
        },
    )
    # Seconds since 1970 are read as UTC wall clocks here; the session runs in UTC.
    local, where = F.timestamp_seconds(F.col(t + "local")), F.col(zone)
    early = F.to_utc_timestamp(local, where)
    shifted = lambda minutes: F.timestamp_seconds(F.unix_timestamp(early) + minutes * 60)
    fits = lambda u: F.from_utc_timestamp(u, where) == local
    # The zone rules give one instant; a second one, if any, lies one clock change away.
    others = [F.when(fits(shifted(m)), shifted(m)) for m in (-120, -60, -30, 30, 60, 120)]
    df = _settled(
        df,
        **{
            t + "a": F.when(F.col(t + "offset").isNull() & where.isNotNull() & fits(early), early),
            t + "b": F.when(F.col(t + "offset").isNull() & where.isNotNull() & fits(early), F.coalesce(*others)),
        },
    )
    fixed = F.when(F.col(t + "offset").between(-1440, 1440), F.timestamp_seconds(F.col(t + "local") - F.col(t + "offset") * 60))
    absolute = F.coalesce(F.timestamp_seconds(F.col(t + "epoch")), fixed)
    a, b = F.col(t + "a"), F.col(t + "b")
    result = F.struct(
        F.coalesce(
            F.to_date(absolute),
            F.when(F.col(t + "timed"), F.when(b.isNull() | (F.to_date(a) == F.to_date(b)), F.to_date(a))).otherwise(F.col(t + "day")),
        ).alias("day"),
        F.coalesce(absolute, F.when(b.isNull(), a)).alias("instant"),
        F.col(t + "timed").alias("timed"),
    )
    return _settled(df, **{out: result}).drop(*[t + n for n in ("v", "p", "day", "timed", "local", "offset", "epoch", "a", "b")])


def host(url: Column) -> Column:
    """Lower-case host of a url without user, port and a leading ``www.``; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[\s\u00a0]*(?i:https?:)?//(?:[^/?#@]*@)?([^/?#:\[\]\s]+)", 1))
    return F.nullif(F.regexp_replace(found, r"^www\.", ""), F.lit(""))


def with_outlet(stories: DataFrame, outlets: DataFrame) -> DataFrame:
    """Add ``__outlet_tz`` and ``__outlet_day_first``, found by the url's host, else by domain.

    The outlet table is small by nature (one row per site); Spark broadcasts it only while its
    size is under the session's threshold. Stories without a known outlet get nulls.
    """
    o = outlets.select(F.lower(F.col("domain")).alias("o_domain"), F.col("tz").alias("o_tz"), (F.upper(F.col("date_order")) == "DMY").alias("o_dmy"))
    o = o.filter(F.col("o_domain").isNotNull()).dropDuplicates(["o_domain"])
    bare = F.regexp_replace(F.lower(strip_blanks(F.col("domain"))), r"^www\.", "")
    df = stories.withColumns({"__h": host(F.col("url")), "__d": bare})
    by = lambda n: o.select(*[F.col(c).alias(f"__{n}_{c}") for c in o.columns])
    df = df.join(by("h"), F.col("__h") == F.col("__h_o_domain"), "left").join(by("d"), F.col("__d") == F.col("__d_o_domain"), "left")
    return df.withColumns(
        {"__outlet_tz": F.coalesce(F.col("__h_o_tz"), F.col("__d_o_tz")), "__outlet_day_first": F.coalesce(F.col("__h_o_dmy"), F.col("__d_o_dmy"))}
    ).drop("__h", "__d", *[f"__{n}_{c}" for n in "hd" for c in o.columns])


def normal_times(stories: DataFrame, outlets: DataFrame) -> DataFrame:
    """Stories with ``publish_day`` (``YYYY-MM-DD``) and ``indexed_utc`` (``YYYY-MM-DDTHH:MM:SSZ``).

    Both are null where the normal form can't be told: null, blank, impossible or partial values,
    local times without a known outlet, skipped local times, and, for ``indexed_at``, local times
    that fit two instants and days without a time. All other columns pass through; repeated rows
    stay repeated; an empty table gives an empty table.
    """
    df = with_outlet(stories, outlets)
    df = parse(df, "publish_date", "__outlet_tz", "__outlet_day_first", "__p")
    df = parse(df, "indexed_at", "__outlet_tz", "__outlet_day_first", "__i")
    iso = F.date_format(F.col("__i.instant"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return df.withColumns({"publish_day": F.date_format(F.col("__p.day"), "yyyy-MM-dd"), "indexed_utc": iso}).drop("__p", "__i", "__outlet_tz", "__outlet_day_first")


def found(spark, root: str) -> DataFrame:
    """p5_found: values whose normal form can be told and isn't what is written."""
    stories = table(spark, root, "stories", ["story_id", "publish_date", "indexed_at", "url", "domain"])
    df = normal_times(stories, table(spark, root, "outlets", ["domain", "tz", "date_order"]))
    pairs = F.array(
        F.struct(F.lit("publish_date").alias("field_name"), F.col("publish_day").alias("normal_value"), F.col("publish_date").alias("raw")),
        F.struct(F.lit("indexed_at").alias("field_name"), F.col("indexed_utc").alias("normal_value"), F.col("indexed_at").alias("raw")),
    )
    df = df.select("story_id", F.inline(F.filter(pairs, lambda x: x["normal_value"].isNotNull() & (x["normal_value"] != x["raw"]))))
    return df.select("story_id", "field_name", "normal_value").distinct()
