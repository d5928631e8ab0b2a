"""Labels of lines from where they stand and how they recur, not from what they say.

Over a sample of pages, these hold for a line of the page itself and not for an article's:

* it recurs, the outlet's own name left out, under several different titles;
* it leads to another story: most of it is the title of one, names and figures masked;
* lines of its shape (names and figures masked) are the same text wherever one site has several;
* lines of its shape stand before the first or after the last sentence of prose.

The story's own title, prose, and lines whose shape stands among prose are the article's. What a
line starts with is labelled with the rest if nearly all lines that start so are alike. Other
lines get no label. :data:`ANNOTATED` holds the few labels that were set by hand.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from broadsheet.llm.lines import letters, own_title, sentence, template

#: Lines labelled by hand, as shapes: notes that stand among prose, differ every time and aren't the article's.
ANNOTATED = ("This story is one of several on the Lee papers and Oakmere.", "Part of our series on Lee and Oakmere.")
#: Different titles under which a line recurs; lines of a shape that tell; share of them that decides.
TITLES, ENOUGH, AMONG, OUTSIDE, ALIKE = 3, 5, 0.75, 0.4, 0.95
_PARTS = re.compile(r"\s*\|\s*|\s{2,}|\s(?=[^\W\d_]\w+: )")
_TRIM = " .!…»|"


def _lead(line: str) -> tuple[str, bool]:
    """What a line starts with, figures masked, and whether that is a mark: one word that ends in a sign, else two words."""
    first, _, rest = re.sub(r"\d+", "9", line.casefold()).partition(" ")
    mark = not first[-1:].isalnum()
    return (first, True) if mark else (first + " " + rest.partition(" ")[0], False)


def labels(pages: list[tuple[str | None, str | None, str | None, list[str]]], annotated: tuple[str, ...] = ANNOTATED) -> list[np.ndarray]:
    """1 page, 0 article, -1 unknown for every line of ``pages`` (site, outlet, title, squeezed lines)."""
    titles = [letters(t) for _, _, t, _ in pages]
    shapes_of_titles = {template(t.rstrip(_TRIM)) for _, _, t, _ in pages if t and len(t) > 20}
    by_hand = {template(x.rstrip(_TRIM)) for x in annotated}

    def leads_on(line: str) -> bool:
        for part in _PARTS.split(line):
            words = template(part.rstrip(_TRIM)).split(" ")
            for i in range(len(words) // 2 + 1):
                if len(words) - i >= 4 and " ".join(words[i:]) in shapes_of_titles:
                    return True
        return False

    def bare(line: str, outlet: str | None) -> str:
        name = letters(outlet)
        return letters(line).replace(name, "") if len(name) > 4 else letters(line)

    under: dict[str, set[str]] = defaultdict(set)
    place: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    texts: dict[tuple[str, str | None], Counter] = defaultdict(Counter)
    seen = []
    for (site, outlet, _, lines), title in zip(pages, titles, strict=True):
        for x in lines:
            under[bare(x, outlet)].add(title)
    for (site, outlet, _, lines), title in zip(pages, titles, strict=True):
        recurs = [len(under[bare(x, outlet)]) >= TITLES and letters(x) != "" for x in lines]
        prose = [i for i, x in enumerate(lines) if sentence(x) and not recurs[i]]
        first, last = (prose[0], prose[-1]) if prose else (len(lines), -1)
        shapes = [template(x) for x in lines]
        own = [own_title(x, title) for x in lines]
        for i, x in enumerate(lines):
            if not own[i]:
                place[shapes[i]][0 if first <= i <= last else 1] += 1
                texts[shapes[i], site][letters(x)] += 1
        seen.append((recurs, set(prose), shapes, own))
    same: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for (shape, _), counts in texts.items():
        n = sum(counts.values())
        if n > 1:
            same[shape][0] += sum(k * (k - 1) for k in counts.values()) / (n - 1)
            same[shape][1] += n

    out, sure = [], defaultdict(lambda: [0, 0])
    for (_, _, _, lines), (recurs, prose, shapes, own) in zip(pages, seen, strict=True):
        given = np.full(len(lines), -1, np.float32)
        for i, x in enumerate(lines):
            inside, outside = place[shapes[i]]
            strong = None  # evidence other than the place of the shape
            if own[i]:
                given[i] = 0
            elif recurs[i] or shapes[i].rstrip(_TRIM) in by_hand or leads_on(x) or (same[shapes[i]][1] >= ENOUGH - 1 and same[shapes[i]][0] >= OUTSIDE * same[shapes[i]][1]):
                given[i] = strong = 1
            elif inside + outside >= ENOUGH:
                share = inside / (inside + outside)
                given[i] = 0 if share >= AMONG else 1 if share <= OUTSIDE else -1
                strong = 0 if share > OUTSIDE else None
            elif i in prose:
                given[i] = 0  # a weak label: it follows its lead
            if strong is not None:
                sure[_lead(x)[0]][strong] += 1
        out.append(given)
    for (_, _, _, lines), (_, prose, shapes, own), given in zip(pages, seen, out, strict=True):
        for i, x in enumerate(lines):
            lead, mark = _lead(x)
            article, page = sure[lead]
            weak = given[i] == -1 or (mark and i in prose and given[i] == 0 and sum(place[shapes[i]]) < ENOUGH)
            if weak and not own[i] and article + page >= 2 * ENOUGH and page >= ALIKE * (article + page):
                given[i] = 1
    return out
