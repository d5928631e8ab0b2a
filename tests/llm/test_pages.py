"""Residue, line kinds and the recurrent labeller."""

import random
from collections import Counter

import numpy as np
import pytest

from broadsheet.llm import boilerplate, lines, residue, structure

ARTICLE = "Records reviewed for this story show 42 meetings between two firms and officials of the harbour authority. The contract ran until May 2019."
NAMES = [a + b for a in ("Bar", "Cor", "Den", "Fal", "Gor", "Hul", "Mot", "Nas") for b in ("den", "lik", "mot", "nas", "pel", "rin", "sov", "tul")]
PAGE = ["Skip to main content", "By Ann Lee, Staff Reporter", "Share this story on social media", "© 2024 The Herald. All rights reserved.", "Comments need JavaScript. Turn it on to take part.", "12. Donor named to board"]


def article(i):
    return f"{NAMES[i]} and {NAMES[i - 7]} told the board that {NAMES[i - 3].lower()} firms had met officials of the harbour authority. The contract ran until May 2019."


TITLE = "Donor Smith named to the Harbour Authority board"

RESIDUE = [
    f"Please enable JavaScript to continue reading {TITLE}.", "403 Forbidden (abc-1234) nginx", f"404 - the page for {TITLE} could not be found. It may have been moved or deleted.",
    "Page introuvable : « Un titre quelconque » n'existe plus.", "Gateway timeout. The upstream abc-99 did not answer.", "Lorem ipsum dolor sit amet nulla velit aliqua tempor dolore. Magna elit sed do enim.",
    "This is sample text. Click to edit this block. Do not publish. Test test test.", f"{TITLE} {{{{headline}}}}\nBy {{{{headline}}}} Smith", "<%= lead_paragraph %> x-12", "null null abc-123 null",
    ARTICLE.replace("42 meetings", "42 {author_name} meetings"), "\n".join(PAGE + ["Access denied. You don't have permission to view /x on this server. Reference q-12"]),
    f"{TITLE} - this app works best with JavaScript enabled. Your browser does not run scripts.", "Checking your browser before opening The Herald. Ray q-1234",
]
ARTICLES = [
    ARTICLE, "\n".join([*PAGE, ARTICLE]), '"Access denied is all the screen said," Lee recalled of the day the registry moved to the harbour authority.',
    'A form letter addressed to "Dear [name]" reached 16 homes in town; the authority blamed the printer for the mistake.',
    'Visitors to the site met the words "404 page not found" for 41 days while the company rebuilt it at great cost.',
    "The firm billed $22,588 for a portal that asked users to enable JavaScript and then did nothing, the auditor wrote.", "", "Short.", "The committee adjourned.",
]
SCHEMA = "story_id string, title string, text string, extractor string, line_no int, kind int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def test_residue(spark):
    rows = [(f"r{i}", TITLE if i % 2 == 0 else None, t, None) for i, t in enumerate(RESIDUE)] + [(f"a{i}", TITLE, t, "x") for i, t in enumerate(ARTICLES)]
    rows = [(s, TITLE if t and "Donor" in t else title, t, e) for s, title, t, e in rows]
    rows += [("null", TITLE, None, None), (None, None, RESIDUE[1], None), rows[0], ("long", None, (ARTICLE + "\n") * 4000, None)]
    assert {r.story_id for r in residue.residue(frame(spark, rows)).collect()} == {f"r{i}" for i in range(len(RESIDUE))}
    assert residue.residue(frame(spark, [])).count() == 0


@pytest.mark.parametrize("line", PAGE + ["Related: x y z", "More on Ann and Bob Ltd.", "Copy link!", "| Advertisement |", "Ewan Lee | The Herald", "LISTEN TO THIS ARTICLE · 1 MIN", "À lire aussi : x", "Susan Lee, political reporter »"])
def test_page_kinds(line):
    assert lines.kind(lines.squeeze(line), lines.letters(TITLE)) == 1


@pytest.mark.parametrize("line", [ARTICLE, TITLE, TITLE.upper() + " | The Herald"])
def test_article_kinds(line):
    assert lines.kind(lines.squeeze(line), lines.letters(TITLE)) == 0


@pytest.mark.parametrize("line", ["The Smith file", "2015: Lee registers as a lobbyist", "- Ann Lee, director, until 2018", "Related: " + TITLE])
def test_lines_without_wording_or_shape_get_no_kind_as_articles(line):
    assert lines.kind(lines.squeeze(line), lines.letters(TITLE)) != 0


# Messages in wording of other sites, none of them an exemplar.
UNSEEN = [
    "We couldn't load this page. Check your connection and try again.", "Sorry, the page you were looking for is not here. It may have moved.", "Your browser does not support scripts. Please turn on JavaScript and reload this page.",
    "You do not have permission to view this page on this server.", "The server encountered an error while processing your request. Please try again later.", "Please sign in to your account to continue reading this article.",
    "Please complete the captcha to confirm you are not a robot.", "This site is down for scheduled maintenance. Please check back soon.", "The requested page could not be found on this server.", "This content is not available in your region.",
    "Your account session expired. Please log in again to continue.", "The gateway did not receive a response from the upstream server.", "Your text goes here. This is placeholder text.", "Uncaught exception: undefined index on line 14",
]


def test_messages_in_other_words():
    index = residue.Index(1000, {w: 900 for w in ("the", "to", "of", "a", "is", "in", "and", "on", "this", "you", "your", "not", "it")})
    hits = [residue.is_residue(t, None, index) for t in UNSEEN]
    assert sum(hits) >= 0.75 * len(UNSEEN), [t for t, h in zip(UNSEEN, hits, strict=True) if not h]
    assert not any(residue.is_residue(t, TITLE, index) for t in ARTICLES)


@pytest.mark.parametrize("family", sorted(set(residue.EXEMPLARS) - {"http"}))
def test_messages_of_a_family_left_out_are_mined(spark, monkeypatch, family):
    """A family the exemplars lack is found where its messages stand on several sites; short articles aren't."""
    gone = [x for x in residue.EXEMPLARS[family] if len(x.split()) >= 4 and "'" not in x]
    monkeypatch.setitem(residue.EXEMPLARS, family, ())
    rows = [(f"m{i}-{j}", f"Donor number {chr(97 + j)} named to board {i}", x.capitalize() + ".", f"site{j}.example") for i, x in enumerate(gone) for j in range(6)]
    rng = random.Random(3)
    syllables = ("Bar", "Cor", "Den", "Fal", "Gor", "Hul", "Mot", "Nas")
    said = (
        "{} told the board that nobody had discussed the file before the vote.", "The contract of {} ran until the spring and was then renewed.", "Auditors counted the invoices of {} that carried no date.",
        "The ethics office found that {} had waited too long in the matter.", "Residents learned of the deal with {} from a notice on a door in your town.", "A judge ordered the release of the letters of {} in full.",
        "Critics say that {} has turned too often since the election is over.", "This is what {} and you could read in the minutes of the year.", "Nobody knows if {} will be back in time for the hearing.", "It was {} who asked for more, on the page that you have not seen.",
    )
    rows += [(f"a{i}", f"The story {i}", " ".join(x.format("".join(rng.sample(syllables, 2))) for x in rng.sample(said, 2 if i % 8 == 0 else 8)), f"site{i % 6}.example") for i in range(700)]
    df = spark.createDataFrame(rows, "story_id string, title string, text string, domain string")
    got = {r.story_id for r in residue.residue(df).collect()}
    wanted = {r[0] for r in rows if r[0][0] == "m"}
    assert len(got & wanted) >= 0.75 * len(wanted), sorted({rows[i][2] for i, r in enumerate(rows) if r[0] in wanted - got})
    assert not got - wanted


def test_gradients_against_differences():
    model = boilerplate.Labeller(seed=1)
    docs = [boilerplate.read(t, TITLE, "trafilatura")[2:] for t in ("\n".join(PAGE[:3] + [ARTICLE]), "\n".join([TITLE, ARTICLE]))]
    labels = [np.array([1, 1, 1, 0], np.float32), np.array([0, -1], np.float32)]
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        y, _ = model.scores(docs)
        terms = [-(t * np.log(y[i, j]) + (1 - t) * np.log(1 - y[i, j])) for j, known in enumerate(labels) for i, t in enumerate(known) if t >= 0]
        return sum(terms) / len(terms)

    g = model.gradients(docs, labels)
    rng = np.random.default_rng(0)
    for name in ("Wf", "Ub", "bf", "v", "c", "E"):
        flat = np.flatnonzero(np.abs(g[name]) > 1e-4) if np.any(np.abs(g[name]) > 1e-4) else np.arange(g[name].size)
        for i in rng.choice(flat, 3):
            at = np.unravel_index(i, g[name].shape)
            old = model.p[name][at]
            model.p[name][at] = old + 1e-2
            up = loss()
            model.p[name][at] = old - 1e-2
            down = loss()
            model.p[name][at] = old
            assert abs((up - down) / 2e-2 - g[name][at]) < 2e-3 + 0.05 * abs(g[name][at]), name


def test_labels_without_wording_agree_with_the_wording(spark, data):
    """The labels know no wording; the patterns of page lines, which they never see, are the held-out families."""
    from broadsheet.session import table

    rows = [r for r in table(spark, data.replace("sf0.001", "sf0.01"), "fetch_review", list(boilerplate.COLUMNS)).filter("text IS NOT NULL").dropDuplicates(["story_id"]).orderBy("story_id").collect()]
    index = residue.Index(len(rows), {})
    rows = [r for r in rows if not residue.is_residue(r.text, r.title, index)]
    parsed = [boilerplate.read(r.text, r.title, r.extractor) for r in rows]
    known = structure.labels([(r.domain, r.media_name, r.title, p[1]) for r, p in zip(rows, parsed, strict=True)], annotated=())
    half = len(rows) // 2
    model = boilerplate.Labeller().fit([p[2:] for p in parsed[:half]], known[:half], epochs=20)
    right = Counter()
    for r, p in zip(rows[half:], parsed[half:], strict=True):
        y, _ = model.scores([p[2:]])
        for x, v in zip(p[1], y[: len(p[1]), 0], strict=True):
            right[lines.kind(x, lines.letters(r.title)), bool(v > 0.5)] += 1
    assert right[1, True] >= 0.93 * (right[1, True] + right[1, False]) and right[0, False] >= 0.97 * (right[0, True] + right[0, False]), right


def test_page_lines(spark):
    rows = [(f"s{i}", f"{TITLE} of {NAMES[i]}", "\n".join([PAGE[i % 6], "", f"{TITLE} of {NAMES[i]}", "  ", article(i), PAGE[(i + 1) % 6]]) + ("\r\n" if i % 3 else ""), ("trafilatura", None, "new")[i % 3]) for i in range(60)]
    rows += [("res", TITLE, RESIDUE[1], None), ("null", TITLE, None, None), ("empty", None, "", None), rows[0], ("long", TITLE, "\n".join([ARTICLE] * 3000), None), ("bars", None, "|\n***\n" + ARTICLE, None)]
    got = {(r.story_id, r.line_no) for r in boilerplate.page_lines(frame(spark, rows)).collect()}
    stories = {f"s{i}" for i in range(60)}
    assert {(s, n) for s, n in got if s in stories} == {(s, n) for s in stories for n in (1, 6)}
    assert not {"res", "null", "empty"} & {s for s, _ in got}
    assert boilerplate.page_lines(frame(spark, [])).count() == 0
    texts = {r.story_id: r.text for r in boilerplate.bodies(frame(spark, rows)).collect()}
    assert texts["s0"] == f"{TITLE} of {NAMES[0]}\n{article(0)}" and "res" not in texts


def test_each_text_of_a_story_loses_its_own_lines(spark):
    own = [f"{TITLE} of {x}" for x in NAMES]
    rows = [(f"s{i}", own[i], "\n".join([PAGE[i % 6], own[i], article(i), PAGE[(i + 1) % 6]]), "trafilatura") for i in range(60)]
    rows.append(("s0", own[0], "\n".join([article(61), article(62), article(63)]), "trafilatura"))
    texts = {r.text for r in boilerplate.bodies(frame(spark, rows)).filter("story_id = 's0'").collect()}
    assert texts == {f"{own[0]}\n{article(0)}", rows[-1][2]}
