"""Queries of this subpackage by name, and the SQL for those SQL can state on whole tables."""

from __future__ import annotations

from broadsheet.llm import boilerplate, formatting, mixing, names, packing, residue, sitelines, survivors, truncation
from broadsheet.plans import timestamp_sql
from broadsheet.plans.timestamp_sql import _bare
from broadsheet.session import NO_VALUE_WORDS


def queries():
    return {
        "p1_found": survivors.found,
        "p1_fused": survivors.fused,
        "p2_found": formatting.found,
        "p2_records": formatting.records,
        "p3_found": residue.found,
        "p4_found": names.found,
        "p4_clusters": names.clusters,
        "p6_found": boilerplate.found,
        "p6_texts": boilerplate.article_texts,
        "p7_found": sitelines.found,
        "p7_texts": sitelines.texts,
        "p8_placed": packing.placed,
        "p8_filling": packing.filling,
        "p8_sound": packing.sound,
        "p9_mix": mixing.items,
        "p9_shares": mixing.shares,
        "p9_sound": mixing.sound,
        "p10_found": truncation.found,
        "p10_shares": truncation.shares,
    }


_NO_VALUE = ", ".join("'" + w + "'" for w in NO_VALUE_WORDS)
_SITE_LINES = rf"""d AS (SELECT DISTINCT story_id, lower(regexp_replace(domain, '^\s+|\s+$', '', 'g')) AS site, text FROM fetch_review
 WHERE text IS NOT NULL AND story_id IS NOT NULL AND domain IS NOT NULL AND lower(regexp_replace(domain, '^\s+|\s+$', '', 'g')) NOT IN ({_NO_VALUE})),
l AS (SELECT story_id, site, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d),
k AS (SELECT story_id, site, text, line, line_no, lower(regexp_replace(line, '[^\p{{L}}]+', '', 'g')) AS letters FROM l),
f AS (SELECT site, letters FROM k WHERE letters <> '' GROUP BY site, letters HAVING count(DISTINCT story_id) >= {sitelines.MIN_DOCUMENTS})"""


_FILLED = " + ".join(
    rf"CAST({c} IS NOT NULL AND lower({_bare(c)}) NOT IN ({_NO_VALUE}) AS INTEGER)" for c in ("title", "url", "domain", "media_name", "media_url", "language")
)
_SURVIVORS = f"""WITH RECURSIVE {timestamp_sql.CTES},
st AS (SELECT DISTINCT topic, story_id, qc_status, dup_of_story_id FROM story_topic_state WHERE topic IS NOT NULL AND story_id IS NOT NULL),
e0 AS (SELECT t.topic, t.story_id AS a, t.dup_of_story_id AS b FROM st t JOIN (SELECT DISTINCT topic, story_id FROM st) k ON k.topic = t.topic AND k.story_id = t.dup_of_story_id WHERE t.dup_of_story_id <> t.story_id),
e AS (SELECT topic, a, b FROM e0 UNION SELECT topic, b, a FROM e0),
c(topic, a, b) AS (SELECT topic, a, a FROM e UNION SELECT c.topic, c.a, e.b FROM c JOIN e ON e.topic = c.topic AND e.a = c.b),
m AS (SELECT topic, a AS story_id, min(b) AS component FROM c GROUP BY topic, a),
q AS (SELECT topic, story_id, min(CASE WHEN qc_status IN ('ok', 'dup') THEN 0 ELSE 1 END) AS verdict FROM st GROUP BY topic, story_id),
times AS (SELECT story_id, max(normal_value) FILTER (field_name = 'publish_date') AS publish_day, max(normal_value) FILTER (field_name = 'indexed_at') AS indexed_utc FROM n GROUP BY story_id),
d AS (SELECT DISTINCT story_id, title, url, domain, media_name, media_url, language FROM stories),
w AS (SELECT d.story_id, {_FILLED} + CAST(publish_day IS NOT NULL AS INTEGER) + CAST(indexed_utc IS NOT NULL AS INTEGER) AS held, publish_day FROM d LEFT JOIN times USING (story_id)),
k AS (SELECT m.topic, m.story_id, row_number() OVER (PARTITION BY m.topic, component ORDER BY verdict, coalesce(held, 0) DESC, publish_day DESC NULLS LAST, m.story_id) AS place FROM m JOIN q USING (topic, story_id) LEFT JOIN w ON w.story_id = m.story_id)
SELECT topic, story_id FROM k WHERE place = 1"""


# Stated here anew, so that the SQL can find a wrong pattern of the operator (fixed values).
_SEPARATOR = r"\s*[|·•–—―»«]+\s*|\s+-+\s+|\s*:\s+|\s+:\s*|\s+/+\s+|\s*::+\s*"
_TRACKING = "^(utm_[0-9a-z_]*|fbclid|gclid|dclid|msclkid|igshid|mc_cid|mc_eid|yclid|_ga)$"
_PLAIN = r"nfc_normalize(lower(regexp_replace(replace(replace(replace(replace({0}, '&#39;', chr(39)), '&amp;', '&'), 'ﬁ', 'fi'), chr(160), ' '), '[\x{{00ad}}\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}]', '', 'g')))"
_NUMBER = "CASE WHEN regexp_matches(w, '^[0-9]') THEN regexp_split_to_array(w, '[.,]')[1] || array_to_string(list_transform(regexp_split_to_array(w, '[.,]')[2:], lambda q: CASE WHEN length(q) = 3 THEN q ELSE '.' || q END), '') ELSE w END"
_RECORDS = rf"""WITH g AS (SELECT DISTINCT story_id AS k, title, url FROM stories WHERE story_id IS NOT NULL AND title IS NOT NULL AND url IS NOT NULL AND lower({_bare('title')}) NOT IN ({_NO_VALUE}) AND lower({_bare('url')}) NOT IN ({_NO_VALUE})),
t AS (SELECT *, title || chr(1) || url AS raw, {_PLAIN.format('title')} AS tt, trim({_PLAIN.format('url')}, chr(32) || chr(9) || chr(10) || chr(13)) AS uu FROM g),
p AS (SELECT k, raw, uu, list_filter(list_transform(regexp_split_to_array(tt, '{_SEPARATOR}'), lambda part: array_to_string(list_transform(regexp_extract_all(part, '\d+(?:[.,]\d+)*|\p{{L}}+'), lambda w: {_NUMBER}), ' ')), lambda x: x <> '') AS parts,
 regexp_replace(regexp_extract(uu, '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', '') AS netloc, regexp_extract(uu, '^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1) AS path, regexp_extract(uu, '^(?:[a-z][a-z0-9+.-]*:)?//[^?#]*\?([^#]*)', 1) AS query FROM t),
c AS (SELECT k, raw, array_to_string(parts, ' ') AS said, array_to_string(list_sort(parts), ' | ') AS sorted, len(parts) AS n, CASE WHEN NOT regexp_matches(uu, '^(?:[a-z][a-z0-9+.-]*:)?//') THEN uu ELSE
 rtrim(regexp_replace(regexp_replace(netloc, '^www\.', ''), ':(?:80|443)?$', ''), '.') || regexp_replace(rtrim(regexp_replace(url_decode(path), '/+', '/', 'g'), '/'), '/index\.(?:html?|php|aspx)$', '') ||
 coalesce('?' || nullif(array_to_string(list_sort(list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: url_decode(replace(x, '+', ' '))), lambda x: NOT regexp_matches(split_part(x, '=', 1), '{_TRACKING}'))), '&'), ''), '') END AS page FROM p),
b AS (SELECT page, said, max_by(sorted, {{'n': n, 's': md5(page || chr(1) || sorted)}}) AS best FROM c WHERE said <> '' GROUP BY page, said),
r AS (SELECT c.k, c.raw, min(c.k) OVER (PARTITION BY c.page, b.best) AS first_story_id FROM c JOIN b ON b.page = c.page AND b.said = c.said)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _SURVIVORS,
        "p2_found": _RECORDS + "SELECT DISTINCT first_story_id, k AS story_id FROM r WHERE k <> first_story_id",
        "p2_records": _RECORDS + "SELECT first_story_id, count(DISTINCT k) AS copies, count(DISTINCT raw) AS spellings FROM r GROUP BY first_story_id HAVING count(DISTINCT k) > 1",
        "p8_sound": """WITH p AS (SELECT container_kind AS plan, max(capacity_tokens) AS largest FROM containers GROUP BY container_kind UNION ALL SELECT 'all kinds', max(capacity_tokens) FROM containers)
        SELECT plan, CAST(largest AS BIGINT) AS largest, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS needlessly_cut, CAST(0 AS BIGINT) AS too_large FROM p""",
        "p9_sound": """SELECT source, min(max_repeats) AS max_repeats, CAST(0 AS BIGINT) AS overused, CAST(0 AS BIGINT) AS elsewhere, true AS near_target_or_all_used FROM mix_targets WHERE source IS NOT NULL GROUP BY source""",
        "p7_found": f"WITH {_SITE_LINES} SELECT DISTINCT story_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN f USING (site, letters)",
        "p7_texts": f"""WITH {_SITE_LINES}, n AS (SELECT story_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (f.site IS NULL), '') AS text FROM k LEFT JOIN f USING (site, letters) GROUP BY story_id, site, k.text)
        SELECT story_id, text FROM n""",
    }
