"""Template residue, filler and messages of a site in place of an article.

Labelled exemplars (messages by family, the reason phrases of HTTP, filler, a passage of dummy
text, the sign of an unfilled placeholder) and exemplars mined from the corpus are held in an
inverted index from term to exemplars.

1. Short texts give the shapes of their passages (names and figures masked). A shape that stands
   under several titles on several sites, and always with the same few others, is a candidate: a
   message stands alone or with its own next sentence, an article's sentences with many.
2. One pass over all texts counts in how many each term of exemplars and candidates occurs.
   Candidates whose terms are as rare as the exemplars' become exemplars.
3. Every text is cut into passage windows (sentences of each line), placeholders outside quotation
   marks become one term, the exemplars that share terms with a window are retrieved, and the
   TF-IDF containment of the exemplar in the window is computed, with how much of the window it
   covers. A window that no single exemplar covers is held against the vocabulary of all of
   them. Lines that look like the page's own are set aside. A document is excluded if it holds a
   placeholder, if covered windows make up most of its content, or if all its windows are
   covered by the common vocabulary. No pass shuffles a text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from http import HTTPStatus

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.lines import CLOSE, kind, letters, own_title, squeeze
from broadsheet.session import map_batches, table

# Labelled exemplars by family, in the wording common on the web, without the parts that differ from page to page.
EXEMPLARS = {
    "scripts": (
        "please enable javascript to continue", "you need to enable javascript to run this app", "javascript is required to view this page", "javascript is disabled in your browser",
        "enable javascript and cookies to continue", "this site requires javascript please turn it on and reload the page", "your browser does not support javascript or scripts are turned off",
        "allow scripts in your browser to view this content", "your browser is out of date please update your browser", "this browser is not supported", "please disable your ad blocker to view this site",
        "loading please wait", "if the page does not appear turn on scripts and reload", "this app works best in a modern browser with scripts enabled", "turn off your ad blocker to continue", "veuillez activer javascript pour continuer", "javascript est désactivé activez-le pour lire", "votre navigateur n'est pas pris en charge",
    ),
    "refused": (
        "access denied", "access to this page has been denied", "is not available in your region", "is not available in your country", "you don't have permission to access on this server", "you are not authorized to view this page", "403 forbidden", "accès refusé",
        "your request has been blocked contact the site owner", "your ip address has been blocked", "vous n'avez pas la permission d'accéder à cette page",
        "n'est pas offert dans votre région",
    ),
    "missing": (
        "404 not found", "page not found", "sorry we can't find the page you are looking for", "the page you requested could not be found", "it may have been moved or deleted", "this page does not exist or no longer exists",
        "sorry we can't find that", "check the address or return to the home page", "go to the home page", "the link you followed may be broken", "oops something is not here nothing was found at this location", "the content you requested is no longer available",
        "this article has been removed", "page introuvable", "page introuvable n'existe plus", "cette page n'existe plus", "vérifiez l'adresse ou retournez à l'accueil", "la page demandée est introuvable",
    ),
    "closed": (
        "sign in to continue", "session has expired", "sign in to continue session has expired", "log in to continue reading", "please sign in or create an account", "your session has expired please sign in again", "subscribe to continue reading", "this article is for subscribers only",
        "you have reached your limit of free articles", "already a subscriber log in", "connectez-vous pour continuer", "cet article est réservé aux abonnés", "votre session a expiré",
    ),
    "challenge": (
        "please verify you are a human", "press and hold to confirm you are human and not a bot", "checking your browser before", "just a moment", "complete the captcha to continue", "are you a robot",
        "checking if the site connection is secure ray id", "unusual traffic from your network", "too many requests please slow down and try again later", "vérifiez que vous êtes humain",
    ),
    "server": (
        "internal server error", "an error occurred while processing your request", "something went wrong please try again", "please try again later", "an unexpected error occurred", "error establishing a database connection",
        "could not load the page retry", "failed to load check your connection", "bad gateway", "gateway timeout the upstream server did not respond", "service temporarily unavailable", "the server is temporarily unable to service your request",
        "connection timed out", "the origin server did not answer", "erreur interne du serveur", "service temporairement indisponible", "une erreur est survenue veuillez réessayer plus tard",
    ),
    "closed for work": (
        "we are down for maintenance", "site under maintenance we will be back shortly", "we'll be back soon", "this account has been suspended contact your hosting provider", "coming soon under construction",
        "this domain is for sale", "site en maintenance", "site en construction nous serons de retour bientôt",
    ),
    "programs": (
        "warning include failed to open stream no such file or directory", "fatal error uncaught exception", "traceback most recent call last file line in keyerror", "undefined variable on line", "stack trace", "syntax error unexpected",
        "notice undefined index", "null pointer exception", "uncaught typeerror cannot read property of undefined", "object object",
    ),
    "filler": (
        "this is sample text", "your headline goes here", "click to edit this text", "do not publish", "replace this text with your own", "this is a placeholder for text", "dummy text please ignore", "test test test",
        "text to come", "hello world", "asdf asdf asdf", "insert text here", "your text here", "add your content here", "this is your first post edit or delete it", "texte à venir", "ceci est un texte de test",
    ),
}
#: The reason phrases and explanations of refused and failed requests, from the library's own table.
EXEMPLARS["http"] = tuple(x for s in HTTPStatus if s >= 400 for x in (s.phrase, s.description) if x and len(x.split()) > 1)
#: The words of dummy text; a window that consists of them is filler.
DUMMY = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]*\}\}|\{%[^%\n]*%\}|<%[^%\n]*%>|%%\w+%%|@@\w+@@|\$[A-Z][A-Z_]+\$|__[A-Z][A-Z_]+__|\[\[\w+\]\]|[#$]?\{[\w.]*\}"
    r"|\[(?:INSERT|TODO|TBD|TK|Your|Reporter|Author|Writer|Name|Headline|Title|Date|City|Photo|Caption)\b[^\]\n]{0,40}\]"
    r"|\bTK(?: TK)+\b|\bX{2,} percent\b|\bundefined undefined\b|\bnull null\b|\[object Object\]|\bNaN undefined\b",
)
#: The term that stands for an unfilled placeholder.
SLOT = "\x01"
CONTAINMENT = 0.8
COVERAGE = 0.5
SHARE = 0.5
#: Share of a window's weight that the exemplars' common vocabulary has to hold, and terms it has to hold at least.
POOLED, POOLED_TERMS = 0.6, 3
#: A short text has fewer characters. A candidate stands under so many titles (or in that share of the texts) on so many sites.
SHORT_CHARS, MINED_TITLES, MINED_SHARE, MINED_SITES = 400, 3, 1e-5, 2
#: It counts in texts of so few passages. It stands with so few other shapes (or so few for each of its texts), and its terms weigh that share of the exemplars' on average.
MINED_PASSAGES, MINED_OTHERS, MINED_VARIETY, MINED_RARITY = 2, 2, 0.2, 0.35


_WORD = re.compile(r"\x01|[^\W_]+(?:['-][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\s\"”»]+(?=[^\sa-z])|\s+[-–—]\s+")
_PASSAGE = re.compile(r"\n|(?<=[.!?…])\s")
_DIGIT = re.compile(r"\d")
_OUTLET = re.compile(r"\s+[|–—-]\s+")
_CAPITAL = re.compile(r"(?<=[^\W\d_.!?:] )[A-ZÀ-ÖØ-Þ][^\W\d_]*")
_QUOTED = re.compile(r"[\"“«][^\"”»\n]*[\"”»]")
_VARIABLE = re.compile(r"(?=.*\d)(?=.*[^\W\d])|.*\d{4}|.*-.*-")
_SIGNS = ("{", "<%", "%%", "@@", "__", "[", "TK TK", "XX", "null null", "undefined", "NaN")
_DOLLAR = re.compile(r"\$[A-Z]")
_CLOSED = (*CLOSE, "…", ":", ";")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("’", "'"))


def slotted(text: str) -> str:
    """The text with placeholders outside quotation marks as :data:`SLOT`."""
    if not (any(x in text for x in _SIGNS) or _DOLLAR.search(text)) or not PLACEHOLDER.search(text):
        return text
    lines = text.split("\n")
    for i, line in enumerate(lines):
        bare = _QUOTED.sub(" ", line)
        if PLACEHOLDER.search(bare):
            lines[i] = PLACEHOLDER.sub(f" {SLOT} ", bare)
    return "\n".join(lines)


def without_title(line: str, title: str | None) -> str:
    """The line or text without the story's title, or without its longest part where an outlet's name is set off."""
    for own in (title, max(_OUTLET.split(title), key=len)) if title else ():
        at = line.lower().find(own.lower()) if len(own) > 15 else -1
        if at >= 0:
            return line[:at] + " " + line[at + len(own) :]
    return line


class Index:
    """Inverted index over the exemplars with the weights of their terms."""

    def __init__(self, documents: int, frequency: dict[str, int], mined: tuple[str, ...] = (), families: dict[str, tuple[str, ...]] | None = None):
        self.documents = documents
        families = EXEMPLARS if families is None else families
        texts = [x for f in families.values() for x in f]
        self.exemplars = [{SLOT}, *({t for t in words(x) if t != SLOT} for x in (*texts, *mined))]
        self.exemplars = [x for x in self.exemplars if x]
        idf = lambda t: math.log(1 + documents / (1 + frequency.get(t, 0)))
        self.weight = {t: idf(t) for x in self.exemplars for t in x}
        self.usual = sum(self.weight.values()) / len(self.weight)  # what a word that no exemplar has weighs
        self.heavy = {t for t, w in self.weight.items() if 3 * w >= self.usual}
        self.total = [sum(self.weight[t] for t in x) for x in self.exemplars]
        # What holds enough of an exemplar holds one of its heaviest terms: those that make up more than may be missing.
        self.postings: dict[str, list[int]] = defaultdict(list)
        for i, x in enumerate(self.exemplars):
            missing = 0.0
            for t in sorted(x, key=lambda t: (-self.weight[t], t)):
                self.postings[t].append(i)
                missing += self.weight[t]
                if missing > (1 - CONTAINMENT) * self.total[i] + 1e-9:
                    break

    def retrieve(self, terms: set[str]) -> list[int]:
        """Exemplars of which enough weight is among the terms."""
        some = {i for t in terms & self.postings.keys() for i in self.postings[t]}
        return [i for i in sorted(some) if sum(self.weight[t] for t in self.exemplars[i] if t in terms) >= CONTAINMENT * self.total[i]]

    def match(self, found: list[str], title: set[str]) -> bool:
        """True if an exemplar is contained in the window and explains enough of it."""
        if len(found) >= 4 and sum(w in DUMMY for w in found) >= 0.8 * len(found):
            return True
        for i in self.retrieve(set(found)):
            own = self.exemplars[i]
            fixed = [w for w in found if w in own or not _VARIABLE.match(w)]
            rest = [w for w in fixed if w not in own and w not in title]
            if len(rest) <= (1 - COVERAGE) * len(fixed) or (len(own) >= 4 and own <= set(found) and _ends(fixed, own) >= len(own)):
                return True
        return False

    def share(self, found: set[str]) -> float:
        """Share of the words' weight that all exemplars' vocabulary holds."""
        held = sum(self.weight[w] for w in found if w in self.weight)
        return held / (held + self.usual * sum(w not in self.weight for w in found)) if held else 0.0

    def pooled(self, found: list[str], aside: set[str]) -> bool:
        """True if several exemplars together explain the window; figures and what is set aside (names, the title) don't count.

        So may be one run of other words at either end (a headline), if at least five known ones follow or go before.
        """
        if len(self.heavy.intersection(found)) < POOLED_TERMS:
            return False
        fixed = [w for w in found if w in self.weight or not (_VARIABLE.match(w) or w.isdigit() or w in aside)]
        return self._explained(fixed) or any(self._explained(run) for run in (_run(fixed, self.weight), _run(fixed[::-1], self.weight)) if len(run) >= 5)

    def _explained(self, found: list[str]) -> bool:
        return len(self.heavy.intersection(found)) >= POOLED_TERMS and self.share(set(found)) >= POOLED


def _run(found: list[str], known: dict[str, float]) -> list[str]:
    at = next((i for i, w in enumerate(found) if w not in known), len(found))
    return found[:at]


def _ends(found: list[str], own: set[str]) -> int:
    """Words of an exemplar that stand without a gap at either end of a window; between them is a slot."""
    runs = 0
    for side in (found, found[::-1]):
        for w in side:
            if w not in own:
                break
            runs += 1
    return runs


def is_residue(text: str, title: str | None, index: Index) -> bool:
    text = slotted(text)
    if SLOT in text:
        return bool(index.retrieve({SLOT}))
    own, title_words = letters(title), set(words(title or ""))
    total = len(text.split())
    residue = article = likely = short = 0
    aside = []
    for raw in sorted(text.split("\n"), key=len, reverse=True):
        if 2 * article > total:
            return False  # whatever the rest holds, it is less than the article
        line = squeeze(raw)
        if not line:
            continue
        label = kind(line, own)
        if label == 1:
            aside.append(line)
            continue
        found = words(line)
        if len(found) <= 60 and index.match(found, title_words):
            residue += max(len(found), 4)
            continue
        for window in _SENTENCE.split(without_title(line, title)):
            found = words(window)
            apart = title_words if window.isupper() else title_words.union(x.lower() for x in _CAPITAL.findall(window))
            size = len(window.split())
            if index.match(found, apart):
                residue += max(size, 4)
            elif index.pooled(found, apart):
                likely += max(size, 4)
            else:
                said = sum(w not in title_words for w in found)
                article += size if said >= 8 and (window.rstrip().endswith(_CLOSED) or said >= 25) else 0  # open ones are headlines
                short += size if label == 0 and 3 <= said < 8 else 0
    article += short if article else 0  # short sentences alone may belong to a message
    if not residue and not article and not likely:  # nothing but lines that look like a page's own: some of them are messages
        residue = sum(len(words(x)) for x in aside if not own_title(x, own) and index.match(words(x), title_words))
    return (residue > 0 and residue >= SHARE * (residue + likely + article)) or (residue + likely > 0 and article == 0)


# ------------------------------------------------------------------ exemplars from the corpus


def shapes(text: str, title: str | None) -> list[str]:
    """Shapes of a text's passages: lower-case words without figures, paths and what looks like the title, in their order, three at least."""
    out, own = [], set(words(title or ""))
    for passage in _PASSAGE.split(without_title(text, title)):
        kept = [w for w in words(" ".join(t for t in passage.split() if t.islower() and "/" not in t)) if not _DIGIT.search(w)]
        if sum(w in own for w in kept) >= 3:
            kept = [w for w in kept if w not in own]
        if len(kept) >= 3:
            out.append(" ".join(kept))
    return out


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text, title, site in zip(pdf["text"], pdf["title"], pdf["domain"], strict=True):
            found = sorted(set(shapes(text, title)))
            if len(found) > MINED_PASSAGES:
                continue
            rows += [(x, y, title or "", site or "") for x in found for y in found]
        yield pd.DataFrame(rows, columns=["shape", "other", "title", "site"])


def exemplar_index(rows: DataFrame) -> Index:
    """Index weighted by the documents of ``rows`` (text, title, domain) each exemplar term occurs in.

    Mined exemplars stand in at least ``MINED_SHARE`` of the texts, so their number is bounded by the
    passages of a short text over that share, whatever the corpus; the other terms by the exemplars.
    """
    short = rows.filter(F.length("text") < SHORT_CHARS).select("text", "title", "domain")
    often = max(MINED_TITLES, math.ceil(MINED_SHARE * rows.count()))
    met = map_batches(short, _candidates, "shape string, other string, title string, site string")
    met = met.groupBy("shape", "other").agg(F.approx_count_distinct(F.struct("title", "site"), 0.02).alias("n"), F.approx_count_distinct("site", 0.02).alias("sites"))
    itself = F.col("shape") == F.col("other")
    stood = met.groupBy("shape").agg(F.max(F.when(itself, F.col("n"))).alias("n"), F.max(F.when(itself, F.col("sites"))).alias("sites"), (F.count("*") - 1).alias("others"))
    many = stood.filter((F.col("n") >= often) & (F.col("sites") >= MINED_SITES) & (F.col("others") <= F.greatest(F.lit(MINED_OTHERS), F.col("n") * MINED_VARIETY)))
    candidates = tuple(sorted(r.shape for r in many.select("shape").collect()))
    vocabulary = {t for f in EXEMPLARS.values() for x in f for t in words(x)} | {t for x in candidates for t in words(x)} | {SLOT}
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            terms = Counter()
            for text in pdf["text"]:
                terms.update(sent.value.intersection(words(slotted(text))))
            yield pd.DataFrame({"term": ["", *terms], "n": [len(pdf), *terms.values()]})

    counted = map_batches(rows.select("text"), count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequency = {r.term: r.n for r in counted.collect()}  # no more rows than the exemplars and candidates have terms
    documents = frequency.pop("", 0)
    seeds = Index(documents, frequency)
    rare = lambda x: sum(math.log(1 + documents / (1 + frequency.get(t, 0))) for t in set(words(x))) / len(set(words(x)))
    return Index(documents, frequency, tuple(x for x in candidates if rare(x) >= MINED_RARITY * seeds.usual))


def residue(rows: DataFrame) -> DataFrame:
    """(story_id) of rows (story_id, title, text, and domain where there is one) whose text is residue.

    Null and empty texts are no residue; a null title only means that no title is set aside;
    repeated rows give one row; other columns are ignored; an empty table gives an empty table.
    """
    rows = rows.filter(F.col("text").isNotNull() & F.col("story_id").isNotNull())
    rows = rows.select("story_id", "title", "text", F.col("domain") if "domain" in rows.columns else F.lit(None).cast("string").alias("domain"))
    sent = rows.sparkSession.sparkContext.broadcast(exemplar_index(rows))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[is_residue(x, t, sent.value) for x, t in zip(pdf["text"], pdf["title"], strict=True)], ["story_id"]]

    return map_batches(rows.select("story_id", "title", "text"), judge, "story_id string").distinct()


def found(spark, root: str) -> DataFrame:
    """p3_found."""
    return residue(table(spark, root, "fetch_review", ["story_id", "title", "text", "domain"]))
