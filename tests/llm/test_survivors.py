"""Groups, survivors and fused values against plain Python."""

import math
import random

from broadsheet.llm import components, survivors

STATE = "topic string, story_id string, qc_status string, dup_of_story_id string, component string, node string"
STORY = "story_id string, title string, url string, domain string, media_name string, media_url string, language string, publish_date string, indexed_at string, topic string, n_filled int"
OUTLETS = [("a.test", "America/Toronto", "MDY")]


def frames(spark, state, stories):
    return (
        spark.createDataFrame([(*r, "x", "y") for r in state], STATE),
        spark.createDataFrame([(*r, "clash", 9) for r in stories], STORY),
        spark.createDataFrame(OUTLETS, "domain string, tz string, date_order string"),
    )


def story(i, title="T", url="https://a.test/1", domain="a.test", media="A", media_url="m", language="en", day="2021-01-01", at="2021-01-01T00:00:00Z"):
    return (i, title, url, domain, media, media_url, language, day, at)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(400):03}", f"n{rng.randrange(400):03}") for _ in range(260)] + [(f"c{i:04}", f"c{i + 1:04}") for i in range(120)] + [("hub", f"l{i:03}") for i in range(150)] + [("x", "x"), (None, "y")]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        if a and b and a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    want = {}
    for v in parent:
        want.setdefault(find(v), set()).add(v)
    got = {}
    for r in components.components(spark.createDataFrame(edges + edges, "a string, b string"), "a", "b").collect():
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}
    assert all(k == min(v) for k, v in got.items())
    assert components.components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_rules(spark):
    state = [
        ("t", "a", "ok", None), ("t", "b", "dup", "a"), ("t", "b", "dup", "a"),  # equal in all: smallest id
        ("t", "c", "bad_lang", "d"), ("t", "d", None, None),  # neither ok: most filled
        ("t", "e", "ok", "f"), ("t", "f", "off_domain", "e"), ("t", "g", "dup", "e"),  # a cycle; latest day
        ("t", "h", "dup", "h"), ("t", "i", "dup", "nobody"), ("u", "a", "ok", None), ("t", "j", "dup", None),  # no groups
        ("u", "b", "ok", "c"), ("u", "c", "bad_url", None),  # verdict before fields; c has no stories row here
        (None, "z", "dup", "a"), ("t", None, "dup", "a"),
    ]
    stories = [
        story("a"), story("a"), story("b"), story("c", title=None), story("d", title="N/A", language=" "), story("e", day="2021-02-01", title="-"), story("f"),
        story("g", day="03/05/2021", at="not a time", title="x"), story("b2"),
    ]
    out = {(r.topic, r.story_id): r for r in survivors.best_representatives(*frames(spark, state, stories)).collect()}
    assert set(out) == {("t", "a"), ("t", "c"), ("t", "g"), ("u", "b")}
    assert out["t", "g"].size == 3 and out["t", "a"].fused_media_name == ["A"]


def test_fusion_prefers_reliable_sources(spark):
    state, stories = [], []
    for k in range(60):
        good = [f"g{k}a", f"g{k}b", f"g{k}c"]
        state += [("t", i, "ok", good[0] if n else None) for n, i in enumerate(good)]
        stories += [story(good[0], domain="one.test", media="Right"), story(good[1], domain="two.test", media="Right"), story(good[2], domain="three.test", media=f"Wrong {k}")]
    rows = survivors.best_representatives(*frames(spark, state, stories)).collect()
    assert len(rows) == 60 and all(r.fused_media_name == ["Right"] for r in rows)
    members = survivors.described(survivors.group_members(frames(spark, state, stories)[0]), *frames(spark, state, stories)[1:])
    quality = {r.source: r for r in survivors.judge(members)[1].collect()}
    assert quality["one.test"].sensitivity > quality["three.test"].sensitivity
    assert quality["one.test"].specificity > quality["three.test"].specificity


def test_fused_values_against_planted_truth(spark):
    """Two true names a group; good outlets state each of them mostly, bad ones mostly make one up."""
    rng = random.Random(5)
    state, stories, truth = [], [], {}
    for k in range(150):
        truth[k] = {f"True {k}", f"Real {k}"}
        n = 0
        for d in ("good1", "good2", "good3", "bad1", "bad2"):
            said = [v for v in sorted(truth[k]) if rng.random() < (0.9 if d[0] == "g" else 0.25)] + ([f"Made up {d} {k}"] if rng.random() < (0.03 if d[0] == "g" else 0.8) else [])
            for v in said:
                state.append(("t", f"{k}_{n}", "ok", f"{k}_0" if n else None))
                stories.append(story(f"{k}_{n}", None, None, f"{d}.test", v, None, None, None, None))
                n += 1
    kept = {int(r.component.split("\u0001")[1].split("_")[0]): set(r.fused_media_name) for r in survivors.best_representatives(*frames(spark, state, stories)).collect()}
    both = sum(len(kept[k] & truth[k]) for k in kept)
    assert both >= 0.95 * sum(len(truth[k] & {s[4] for s in stories if s[0].startswith(f"{k}_")}) for k in kept) and both >= 0.97 * sum(map(len, kept.values()))


def fit(claims, rounds):
    """Plain expectation-maximisation: claims is {(group, value): outlets}; probabilities and qualities."""
    speak = {}
    for (g, _), who in claims.items():
        speak.setdefault(g, set()).update(who)
    q = {s: (0.7, 0.9) for who in claims.values() for s in who}
    for _ in range(rounds):
        p = {k: 1 / (1 + math.exp(-sum(math.log(q[s][0] / (1 - q[s][1])) if s in who else math.log((1 - q[s][0]) / q[s][1]) for s in speak[k[0]]))) for k, who in claims.items()}
        new = {}
        for s in q:
            tp, fp = (sum(x(p[k]) for k, who in claims.items() if s in who) for x in (lambda v: v, lambda v: 1 - v))
            t, u = (sum(x(p[k]) for k in claims if s in speak[k[0]]) for x in (lambda v: v, lambda v: 1 - v))
            new[s] = ((tp + 8) / (t + 12), 1 - (fp + 1) / (u + 10))
        moved, q = max(abs(a - b) for s in q for a, b in zip(q[s], new[s], strict=True)), new
    return p, q, moved


def test_quality_converges(spark):
    rng = random.Random(8)
    state, stories, claims = [], [], {}
    for k in range(120):
        for n, d in enumerate(rng.sample("abcdefg", rng.randint(2, 5))):
            state.append(("t", f"{k}_{n}", "ok", f"{k}_0" if n else None))
            media = "Right" if rng.random() < 0.9 - 0.12 * "abcdefg".index(d) else f"Wrong {rng.randrange(2)}"
            stories.append(story(f"{k}_{n}", None, None, d, media, None, None, None, None))
            claims.setdefault((k, media), set()).add(d)
    members = survivors.described(survivors.group_members(frames(spark, state, stories)[0]), *frames(spark, state, stories)[1:])
    facts, quality = survivors.judge(members)
    got = {r.source: (r.sensitivity, r.specificity) for r in quality.collect()}
    p, want, moved = fit(claims, 400)
    early = fit(claims, 3)[1]
    off = lambda x: max(abs(a - b) for s in want for a, b in zip(x[s], want[s], strict=True))
    assert moved < 1e-9 and got.keys() == want.keys()
    joined = {r.source: (r.sensitivity, r.specificity) for r in survivors.judge(members, 2, few=0)[1].collect()}
    two = fit(claims, 2)[1]
    assert max(abs(a - b) for s in two for a, b in zip(joined[s], two[s], strict=True)) < 1e-9
    assert off(early) > 0.02 and off(got) < 0.005, (off(early), off(got))
    held = sorted((r.value, r.p) for r in facts.collect())
    assert len(held) == len(claims) and all(v == w and abs(x - y) < 0.05 for (v, x), (w, y) in zip(held, sorted((k[1], x) for k, x in p.items()), strict=True))


def test_empty(spark):
    assert survivors.best_representatives(*frames(spark, [], [])).count() == 0
    assert survivors.best_representatives(*frames(spark, [("t", "a", "ok", "b"), ("t", "b", "dup", None)], [])).select("story_id").first()[0] == "a"
