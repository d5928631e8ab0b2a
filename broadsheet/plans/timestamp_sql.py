"""The same rules for times as :mod:`broadsheet.operators.timestamps`, stated in SQL for comparison."""

from __future__ import annotations

# The notations, months and zones are stated here anew and not imported, so that the comparison can find them wrong (fixed values).
_MONTH_NAMES = (
    "jan january janvier janv", "feb february février fevrier févr", "mar march mars", "apr april avril avr", "may mai", "jun june juin", "jul july juillet juil", "aug august août aout",
    "sep sept september septembre", "oct october octobre", "nov november novembre", "dec december décembre decembre déc",
)
MONTHS = {name: number for number, names in enumerate(_MONTH_NAMES, 1) for name in names.split()}
#: Hours west of Greenwich in winter by the letter of the zone; summer time (d, a) is an hour less.
_WEST = {"n": 3.5, "a": 4, "e": 5, "c": 6, "m": 7, "p": 8}
ZONE_MINUTES = {"z": 0, "utc": 0, "gmt": 0}
for _letter, _hours in _WEST.items():
    ZONE_MINUTES |= {f"{_letter}st": int(-60 * _hours), f"{_letter}dt": int(-60 * (_hours - 1))}
for _letter, _hours in {"t": 3.5, "a": 4, "e": 5, "c": 6, "r": 7, "p": 8}.items():  # French: heure normale, heure avancée
    ZONE_MINUTES |= {f"hn{_letter}": int(-60 * _hours), f"ha{_letter}": int(-60 * (_hours - 1))}
_Z = r"(?:\s*\(?(z|[a-z]{3}|[+-]\d\d(?::?\d\d)?)\)?)?"
_T = r"(?:(?:t|,?\s+)(?:at\s+)?(\d\d?):(\d\d)(?::(\d\d)(?:[.,]\d+)?)?(?:\s*([ap])\.?\s?m\.?)?" + _Z + ")?"
_D = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_WRITTEN = (
    (r"(\d{4})-(\d\d)-(\d\d)" + _T, "ymd"), (r"(\d{4})/(\d\d)/(\d\d)" + _T, "ymd"), (r"(\d\d?)[/.-](\d\d?)[/.-](\d{4})" + _T, "aby"),
    (_D + r"(\d\d?)(?:er)?\s+([a-zéûôà]{3,9})\.?,?\s+(\d{4})" + _T, "dny"), (_D + r"([a-zéûôà]{3,9})\.?\s+(\d\d?),?\s+(\d{4})" + _T, "ndy"),
    (_D + r"(\d\d?)(?:er)?\s+([a-zéûôà]{3,9})\.?,?\s+(\d{4})\s+à\s+(\d\d?)\s*h\s*(\d\d)()()" + _Z, "dny"), (r"(\d{4})(\d\d)(\d\d)(?:t(\d\d)(\d\d)(\d\d)?()" + _Z + ")?", "ymd"),
)

_EDGE = r"[\s\x{00a0}\x{00ad}\x{034f}\x{061c}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"


def _bare(column: str) -> str:
    return f"regexp_replace({column}, '^{_EDGE}+|{_EDGE}+$', '', 'g')"


def _case(expression: str, values: dict[str, int]) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _read() -> str:
    """First fitting notation as a struct of strings."""
    branches = []
    for pattern, layout in _WRITTEN:
        whole = "^" + pattern.replace("'", "''") + "$"
        group = lambda i, w=whole: f"regexp_extract(x, '{w}', {i})"
        at = {c: group(i + 1) for i, c in enumerate(layout)}
        if "a" in at:
            at["d"] = f"CASE WHEN dmy THEN {at['a']} WHEN NOT dmy THEN {at['b']} END"
            at["m"] = f"CASE WHEN dmy THEN {at['b']} WHEN NOT dmy THEN {at['a']} END"
        month = _case(at["n"], MONTHS) if "n" in at else f"CAST({at['m']} AS INTEGER)"
        rest = [group(len(layout) + i) for i in range(1, 6)]
        names = ("hh", "mi", "ss", "half", "zone")
        fields = [f"'y': CAST({at['y']} AS INTEGER)", f"'m': {month}", f"'d': CAST({at['d']} AS INTEGER)", *(f"'{n}': {r}" for n, r in zip(names, rest, strict=True))]
        branches.append(f"WHEN regexp_matches(x, '{whole}') THEN {{{', '.join(fields)}}}")
    return "CASE " + " ".join(branches) + " END"


_HOST = r"nullif(regexp_replace(lower(regexp_extract(url, '^[\s\x{00a0}]*(?i:https?:)?//(?:[^/?#@]*@)?([^/?#:\[\]\s]+)', 1)), '^www\.', ''), '')"

#: CTEs up to n(story_id, field_name, raw, normal_value).
CTES = rf"""
s AS (SELECT DISTINCT story_id, publish_date, indexed_at, {_HOST} AS host, regexp_replace(lower({_bare('domain')}), '^www\.', '') AS site FROM stories),
o AS (SELECT lower(domain) AS site, any_value(tz) AS tz, any_value(upper(date_order) = 'DMY') AS dmy FROM outlets GROUP BY 1),
j AS (SELECT s.story_id, s.publish_date, s.indexed_at, coalesce(a.tz, b.tz) AS tz, coalesce(a.dmy, b.dmy) AS dmy FROM s LEFT JOIN o a ON a.site = s.host LEFT JOIN o b ON b.site = s.site),
v AS (SELECT story_id, tz, dmy, 'publish_date' AS field_name, publish_date AS raw FROM j UNION ALL SELECT story_id, tz, dmy, 'indexed_at', indexed_at FROM j),
x AS (SELECT *, lower({_bare('raw')}) AS x FROM v WHERE raw IS NOT NULL),
r AS (SELECT *, {_read()} AS p FROM x),
f AS (SELECT *, TRY_CAST(printf('%04d-%02d-%02d', p.y, p.m, p.d) AS DATE) AS day, p.hh <> '' AS clock,
  CASE WHEN p.half = '' THEN TRY_CAST(p.hh AS INTEGER) WHEN TRY_CAST(p.hh AS INTEGER) BETWEEN 1 AND 12 THEN TRY_CAST(p.hh AS INTEGER) % 12 + CASE WHEN p.half = 'p' THEN 12 ELSE 0 END END AS hour,
  TRY_CAST(p.mi AS INTEGER) AS minute, CASE WHEN p.ss = '' THEN 0 ELSE TRY_CAST(p.ss AS INTEGER) END AS second,
  CASE WHEN p.zone <> '' THEN coalesce({_case('p.zone', ZONE_MINUTES)}, CASE WHEN p.zone[1] IN ('+', '-') THEN CASE WHEN p.zone[1] = '-' THEN -1 ELSE 1 END * (CAST(p.zone[2:3] AS INTEGER) * 60 + CASE WHEN length(p.zone) > 3 THEN CAST(right(p.zone, 2) AS INTEGER) ELSE 0 END) END, 9999) END AS off,
  CASE WHEN regexp_matches(x, '^(?:\d{{10}}|\d{{13}}|\d{{16}})$') THEN TRY_CAST(left(x, 10) AS BIGINT) END AS unix FROM r),
l AS (SELECT *, CASE WHEN clock AND day IS NOT NULL AND hour BETWEEN 0 AND 23 AND minute BETWEEN 0 AND 59 AND second BETWEEN 0 AND 59 THEN CAST(day AS TIMESTAMP) + to_hours(hour) + to_minutes(minute) + to_seconds(second) END AS wall FROM f),
z AS (SELECT *, CASE WHEN off IS NULL THEN (wall AT TIME ZONE tz) AT TIME ZONE 'UTC' END AS guess FROM l),
g AS (SELECT *, list_distinct(list_filter(list_transform([0, -30, 30, -60, 60, -120, 120], lambda m: guess + to_minutes(m)), lambda u: ((u AT TIME ZONE 'UTC') AT TIME ZONE tz) = wall)) AS fits FROM z),
a AS (SELECT *, CASE WHEN unix IS NOT NULL THEN make_timestamp(unix * 1000000) WHEN off BETWEEN -1440 AND 1440 THEN wall - to_minutes(off) END AS absolute FROM g),
n AS (SELECT story_id, field_name, raw, CASE WHEN field_name = 'indexed_at' THEN strftime(coalesce(absolute, CASE WHEN len(fits) = 1 THEN fits[1] END), '%Y-%m-%dT%H:%M:%SZ')
  ELSE strftime(coalesce(CAST(absolute AS DATE), CASE WHEN clock OR unix IS NOT NULL THEN CASE WHEN len(list_distinct(list_transform(fits, lambda u: CAST(u AS DATE)))) = 1 THEN CAST(fits[1] AS DATE) END ELSE day END), '%Y-%m-%d') END AS normal_value FROM a)"""
SQL = f"WITH {CTES} SELECT DISTINCT story_id, field_name, normal_value FROM n WHERE normal_value IS NOT NULL AND normal_value <> raw"
