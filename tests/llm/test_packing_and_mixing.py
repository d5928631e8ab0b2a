from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from broadsheet.llm import mixing, packing, tokens

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(tokens.TOKENIZER), reason="no public tokenizer here")
DOC = "doc_id long, text string, source string, n_tokens long, t string, shard int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", 3) for r in rows], DOC)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=80), st.sets(st.sampled_from([64, 80, 100, 128]), min_size=1))
def test_best_fit(sizes, capacities):
    at, final = packing.best_fit(sizes, sorted(capacities))
    fill = defaultdict(int)
    for s, b in zip(sizes, at, strict=True):
        fill[b] += s
    assert len(at) == len(sizes) and all(fill[b] <= final[b] for b in fill) and set(fill) == set(range(len(final)))
    assert all(final[b] == min(c for c in capacities if c >= fill[b]) for b in fill)


def test_joint_sizes_beat_each_alone():
    sizes = [60] * 10 + [30] * 7
    joint = sum(packing.best_fit(sizes, [30, 60, 100])[1])
    assert joint == sum(sizes) and all(joint <= sum(packing.best_fit(sizes, [c])[1]) for c in (60, 100))


def test_pieces():
    assert packing.pieces(10, 10) == [(0, 10)] and packing.pieces(0, 10) == [(0, 0)] and packing.pieces(25, 10) == [(0, 10), (10, 10), (20, 5)]


def test_pack(spark):
    rows = [(i, "word " * (i % 37), "s") for i in range(300)] + [(900, "long " * 700, "s"), (901, None, "s"), (902, "", "s"), (0, "", "s")]
    out = packing.pack(docs(spark, rows), {"small": [64], "any": [64, 256, None]}, shard_tokens=2_000).collect()
    for plan, largest in (("small", 64), ("any", 256)):
        mine = [r for r in out if r.plan == plan]
        assert {r.doc_id for r in mine} == {*range(300), 900, 902}
        fill, capacity = defaultdict(int), {}
        for r in mine:
            fill[r.container_id] += r.n_tokens
            capacity[r.container_id] = r.capacity
        assert all(fill[c] <= capacity[c] for c in fill)
        per_doc = defaultdict(list)
        for r in mine:
            per_doc[r.doc_id].append((r.start_token, r.n_tokens))
        assert all(len(p) == 1 for d, p in per_doc.items() if d != 900)
        at = 0
        for start, n in sorted(per_doc[900]):
            assert start == at and n <= largest
            at += n
        assert at == len(tokens.encoding(tokens.TOKENIZER).encode_ordinary("long " * 700))
    assert packing.pack(docs(spark, []), {"small": [64]}).count() == 0 and packing.pack(docs(spark, rows), {}).count() == 0
    with pytest.raises(ValueError, match="positive"):
        packing.pack(docs(spark, rows), {"bad": [0]})


@pytest.mark.parametrize(
    ("held", "targets", "repeats", "total", "want"),
    [
        ({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 200, {"a": 100, "b": 100}),
        ({"a": 10, "b": 190}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, 200, {"a": 20, "b": 180}),
        ({"a": 10}, {"a": 0.5, "none": 0.5}, {"a": 3, "none": 9}, 20, {"a": 20, "none": 0}),
        ({"a": 10}, {"a": 0.0}, {"a": 3}, 10, {"a": 0}),
        ({}, {}, {}, 0, {}),
        ({"a": 10, "b": 10, "c": 80}, {"a": 0.4, "b": 0.4, "c": 0.2}, {"a": 1, "b": 2, "c": 1}, 100, {"a": 10, "b": 20, "c": 70}),
    ],
)
def test_allotment(held, targets, repeats, total, want):
    assert mixing.allot(held, targets, repeats, total) == pytest.approx(want)


def test_mix(spark):
    rows = [(i, f"{'alpha ' * (5 + i % 40)}{i}", "a") for i in range(400)] + [(1000 + i, f"{'beta ' * 20}{i}", "b") for i in range(40)]
    rows += [(2000, rows[0][1], "b"), (2001, None, "a"), (2002, "", "a"), (2003, "no source", None), (2004, "no target", "x"), rows[5]]
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 4), ("empty", 0.2, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    items, shares = mixing.mix(docs(spark, rows), targets)
    used = items.collect()
    by = {r.source: r for r in shares.collect()}
    assert set(by) == {"a", "b", "empty"} and by["empty"].used_tokens == 0
    assert by["b"].used_tokens == 4 * by["b"].held_tokens and by["b"].most_copies == 4 and by["a"].most_copies <= 2
    assert 2000 not in {r.doc_id for r in used} and len({(r.doc_id, r.copy) for r in used}) == len(used)
    total = sum(len(tokens.encoding(tokens.TOKENIZER).encode_ordinary(t)) for i, t, s in dict.fromkeys(rows) if t and s)
    assert abs(sum(r.n_tokens for r in used) - total) < 0.02 * total
    assert by["a"].reached_share + by["b"].reached_share == pytest.approx(1)
    assert sorted(map(tuple, mixing.mix(docs(spark, rows), targets)[0].collect())) == sorted(map(tuple, used))
    none, shares = mixing.mix(docs(spark, []), targets)
    assert none.count() == 0 and {r.reached_share for r in shares.collect()} == {0.0}
    assert mixing.mix(docs(spark, rows), targets.limit(0))[0].count() == 0
