import random

import pytest

from broadsheet.llm import names

GIVEN = {"thomas", "priya", "benoit", "theodore", "edward", "anthony"}
SCHEMA = "id long, person_name string, private_org string, public_org string, head string, form string, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def test_trie_finds_what_comparison_finds():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    trie = names.Trie(vocabulary)
    for word in vocabulary[:200] + ["", "zzz"]:
        assert trie.near(word) == {w for w in vocabulary if names.within_one(word, w)}


@pytest.mark.parametrize(("a", "b", "near"), [("abc", "acb", True), ("abc", "ab", True), ("abc", "abcd", True), ("abc", "xbc", True), ("abcd", "badc", False), ("abc", "cab", False), ("", "a", True)])
def test_one_edit(a, b, near):
    assert names.within_one(a, b) is near and names.within_one(b, a) is near


def test_near_heads_share_a_piece():
    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + a[i + 1 :], a[:i] + "x" + a[i:], a[:i] + "y" + a[i + 1 :], a[:i] + a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :]])
        if b:
            assert set(names.pieces(a)) & set(names.pieces(b)), (a, b)


@pytest.mark.parametrize(
    ("name", "form"),
    [
        ("Watiers, T.", ("watiers", "t", "initial")), ("Dr. Thomas  Watiers ", ("watiers", "thomas", "")), ("WATIERS, Thomas H", ("watiers", "thomas", "")),
        ("Veartam Benot", ("veartam", "benoit", "")), ("Kastox-Theebox, Priya", ("kastox theebox", "priya", "")), ("Ted Duel", ("duel", "edward theodore", "nickname")),
        ("Anthony (Mr.) Lee", ("lee", "anthony", "")), ("Tony Lee", ("lee", "anthony", "")), ("...", None), ("Lee", ("lee", "", "initial")),
    ],
)
def test_person_forms(name, form):
    assert names.person_form(name, GIVEN, names.Trie(sorted(GIVEN))) == form


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Nealdent  constr. l.l.p.", "The Nealdent Construction LLP", True), ("Dev. Driseley", "Driseley-Developments", True), ("X Eng. (Canada) Group", "X Engineering Grp.", True),
        ("Barnux Energy Services", "Barnux Pharmaceuticals", False), ("Wendynt Construction Ltd.", "Wendynt Construction Limitée", True), ("Wendynt Construction Ltd.", "Wendynt Construction Inc.", False),
        ("Stone & Co.", "STONE AND COMPANY", True),
    ],
)
def test_private_forms(a, b, same):
    assert (names.private_form(a) == names.private_form(b)) is same


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Mulir Water Comm'n", "Commission des eaux de Mulir", True), ("The Town of Lee", "Municipality/Town of LEE", True), ("Lee (Town)", "Lee County", False), ("Lee RHA", "Regional Health Authority of Lee", True),
        ("Lee Dist. School Bd.", "Lee DSB", True), ("Lee Harbor Authority", "Hbr. Auth. (Lee)", True), ("Police Services Board, Lee", "Lee Police Board", True),
    ],
)
def test_public_forms(a, b, same):
    assert (names.public_form(a) == names.public_form(b)) is same


@pytest.mark.parametrize("shard", [2, 5, 20_000])
def test_blocks_lose_no_pair(spark, shard):
    rng = random.Random(4)
    heads = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(5, 8))) for _ in range(250)})
    rows = [(i, "public_org", h, "town", "") for i, h in enumerate(heads)]
    got = {(r.a, r.b): r.apart for r in names.neighbours(spark.createDataFrame(rows, "form long, field string, head string, role string, partial string"), shard).collect()}
    want = {(i, j): 1 for i, a in enumerate(heads) for j, b in enumerate(heads) if i < j and names.within_one(a, b)}
    assert {k: min(v, 1) for k, v in got.items()} == want and want
    assert all((v == 2) == names.another_name(heads[a], heads[b]) for (a, b), v in got.items())


def test_links(spark):
    base = [("Priya Keessick", "Nealdent Construction LLP", "Startywick Regional Health Authority")] * 3
    rows = [(i, *r) for i, r in enumerate(base)]
    rows += [
        (10, "Keessick, P.", "NEALDENT CONSTR. L.L.P.", "Startywick RHA"), (11, "Keesick Priya", "Nealdent Constr.", "Startywcik RHA"), (12, "Thomas Keessick", "Nealdent Paving LLP", "Startywick DSB"),
        *[(20 + i, f"Priya {x}ealand", None, None) for i, x in enumerate(("Br", "Str", "M", "Gl", "Tw"))],  # so that the column knows the given name
        (13, None, " ", "N/A"), (14, "x" * 50_000, "?", "-"), (0, *base[0]),
    ]
    got = {tuple(r) for r in names.linked_cases(frame(spark, rows)).collect()}
    want = {("person_name", a, b) for a, b in ((0, 10), (1, 10), (2, 10), (0, 11), (1, 11), (2, 11), (10, 11))}
    want |= {(f, a, b) for f in ("private_org", "public_org") for a, b in ((0, 10), (1, 10), (2, 10), (0, 11), (1, 11), (2, 11), (10, 11))}
    assert got == want
    assert names.linked_cases(frame(spark, [])).count() == 0
    clusters = names.link(frame(spark, rows)).collect()
    assert len(clusters) == len({(r.field_name, r.name) for r in clusters})


def test_known_names_that_resemble_each_other_stay_apart(spark):
    rows = [(i, n, None, None) for i, n in enumerate(["Priya Gokeber", "Gokeber, Priya", "PRIYA GOKEBER", "Priya Gomeber", "Gomeber, Priya", "P. Gokeber", "Priya Goseber"])]
    got = {(r.id_1, r.id_2) for r in names.linked_cases(frame(spark, rows)).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (3, 4), (0, 5), (1, 5), (2, 5)}


def test_near_heads_of_many_words_meet():
    for a, b in (("alpha beta gamma delta", "alpha beta gamma edlta"), ("zeta beta gamma delta", "eta beta gamma delta")):
        shared = {(side, piece) for _, side, piece in names.pieces(a)} & {(side, piece) for _, side, piece in names.pieces(b)}
        assert any((1, 2, 1) in names._join_shard(f"f\u0001k\u00010{side}\u0001{piece}", [(1, a)], [(2, b)]) for side, piece in shared)


def test_short_heads_need_agreeing_cases(spark):
    rows = [(i, n, o, None) for i, (n, o) in enumerate([("Priya Khan", "Nealdent Construction LLP"), ("Priya Kahn", "Nealdent Constr. LLP"), ("Priya Wong", None), ("Priya Wnog", None)])]
    rows += [(100 + i, f"Priya {x}{y}ealand", f"{y.title()}{x.lower()}ovel Paving", None) for i, (x, y) in enumerate((x, y + z) for x in ("Br", "Str", "M", "Gl", "Tw") for y in "aeiou" for z in "bdfghklm")]
    got = {(r.id_1, r.id_2) for r in names.linked_cases(frame(spark, rows)).filter("field_name = 'person_name' AND id_2 < 100").collect()}
    assert got == {(0, 1)}


@pytest.mark.parametrize("times", [3, 20])
def test_copies_of_cases_change_no_link(spark, data, times):
    from pyspark.sql import functions as F

    from broadsheet.session import table

    cases = table(spark, data, "cases", ["id", *names.FIELDS])
    copies = cases.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).withColumn("id", F.col("id") + F.col("copy") * 1_000_000)
    links = [{(r.field_name, r.name, r.cluster) for r in names.link(x).collect()} for x in (cases, copies)]
    assert links[0] == links[1] and len({c for _, _, c in links[0]}) < len(links[0])
