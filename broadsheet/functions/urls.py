"""Column functions over urls: normal form, host, domain, origin, allow lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.session import any_of

# Query parameters dropped by the normal form (keys compared in lower case).
TRACKING_PREFIX, TRACKING_KEYS = "utm_", ("fbclid",)

_SPLIT = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _trimmed(url: Column) -> Column:
    return F.regexp_replace(url, r"^[\s\u0000-\u001f]+|[\s\u0000-\u001f]+$", "")


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(_trimmed(url), _SPLIT, i)


def authority(url: Column) -> Column:
    """Host and explicit port, lower-cased, without user info and a leading ``www.``; null if malformed."""
    netloc = F.regexp_replace(_part(url, 1), r"^.*@", "")
    host = F.lower(F.regexp_replace(netloc, r":\d*$", ""))
    port = F.regexp_extract(netloc, r":(\d*)$", 1)
    sound = (host != "") & ~host.rlike(r"[\[\]\s]") & ~host.contains(":") & ((port == "") | F.coalesce(port.try_cast("int") <= 65535, F.lit(False)))
    return F.when(sound, F.concat(F.regexp_replace(host, r"^www\.", ""), F.when(port != "", F.concat(F.lit(":"), port.try_cast("int").cast("string"))).otherwise("")))


def _decode(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), F.replace(value, F.lit("+"), F.lit(" ")))


def _encode(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_string(query: Column) -> Column:
    """Parameters without tracking keys, blanks kept, sorted by key and value, encoded again."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(
        pairs,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            F.when(F.instr(p, "=") > 0, _decode(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda s: ~F.lower(s["k"]).startswith(TRACKING_PREFIX) & ~F.lower(s["k"]).isin(*TRACKING_KEYS))
    return F.array_join(F.transform(F.array_sort(kept), lambda s: F.concat(_encode(s["k"]), F.lit("="), _encode(s["v"]))), "&")


def normalize_url(url: Column) -> Column:
    """Scheme and fragment dropped, path without trailing slashes, query as in :func:`query_string`."""
    query = query_string(_part(url, 3))
    path = F.regexp_replace(_part(url, 2), r"/+$", "")
    return F.when(authority(url).isNotNull(), F.concat(authority(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def domain_of(url_norm: Column) -> Column:
    """What stands before the first slash and colon of a normal form."""
    return F.substring_index(F.substring_index(url_norm, "/", 1), ":", 1)


def host_of(url: Column) -> Column:
    """Lower-case host as written, ``www.`` kept; null where there is none."""
    host = F.lower(F.regexp_replace(F.regexp_replace(_part(url, 1), r"^.*@", ""), r":\d*$", ""))
    return F.when((host != "") & ~host.rlike(r"[\[\]\s]"), host)


def origin_of(url: Column) -> Column:
    """``scheme://netloc`` of an absolute http url, else null."""
    found = F.regexp_extract(_trimmed(url), r"^(?i)(https?://[^/?#]+)", 1)
    return F.nullif(found, F.lit(""))


def is_fetchable(url: Column) -> Column:
    """True for an absolute http or https url with a host."""
    return F.coalesce(_trimmed(url).rlike(r"^(?i)https?://[^/?#\s]+"), F.lit(False))


def in_domains(domain: Column, allowed: list[str]) -> Column:
    """Equal to or below an allowed domain; an empty list allows all, a null domain none."""
    if not allowed:
        return F.lit(True)
    clean = [a.casefold().removeprefix("www.").rstrip("/") for a in allowed]
    return F.coalesce(any_of((domain == a) | domain.endswith("." + a) for a in clean), F.lit(False))


def contains_any(url: Column, patterns: list[str]) -> Column:
    return F.coalesce(any_of(F.lower(url).contains(p.casefold()) for p in patterns), F.lit(False))
