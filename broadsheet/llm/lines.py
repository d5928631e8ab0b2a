"""Lines of page text: tidying, comparing, masking, and wording that pages put around articles."""

from __future__ import annotations

import re

# Patterns of whole lines (white space collapsed, case ignored) that belong to a page; the residue search sets such lines aside.
PAGE_KINDS = {
    "byline": r"by [^.:]{3,60}|par [^.:]{3,60}|written by .* for .*|un texte de .*|posted by .*|[^.:|]{3,40}, (?:\w+ ){0,2}(?:reporter|correspondent|columnist|writer|editor|journaliste)\b.*|[^|.]{4,40} \| (?:the |la |le |les |l')?[^|.]{4,45}",
    "date": r"posted \d+.*|published .*|publié .*|last updated.*|updated:? \d.*|mis à jour.*|\d+ min(?:utes?)? read|lecture de \d+.*|listen to this .*|écouter .*",
    "menu": r"menu|ouvrir le menu|skip to .*|aller au contenu.*|back to top|haut de page|breadcrumb.*|home ?[|>·].*|accueil ?[|>·].*|news politics .*|today's paper.*|search .*|rechercher.*|log ?in|sign ?in\b.{0,30}|se connecter|about us ·.*|à propos ·.*|advertise with us|annoncez.*|.* (?:weather|météo) ?: .*|(?:advertisement|publicité|sponsored)",
    "share": r"share (?:on|this)\b.*|share tweet .*|partager.*|copy link|copier le lien.*|send this article .*|follow .{2,60} for more|follow us.*|suivez .*|\d+ shares|\d+ partages|save for later.*|print",
    "comments": r"comments? \(\d+\)|commentaires? \(\d+\)|comments (?:need|are) .*|.* pour commenter.*|.{3,60} commented \d+ \w+ ago:.*|.{3,60} a commenté.*",
    "consent": r"we use cookies.*|this site uses cookies.*|ce site utilise des témoins.*|nous utilisons des témoins.*|your privacy choices.*|by clicking .*|.* store information on your device.*|.* conservent des données.*",
    "outlet": r"©.*|copyright \d{4}.*|this article may not be .*|toute reproduction .*|tous droits .*|all rights reserved.*|.* is a member of the press council.*|editor's note:.*|note de la rédaction.*|corrections:.*|support local journalism.*|soutenez .*|subscribe(?: to .{3,50}| now| today)?|abonnez-vous.*|get the .* newsletter.*|recevez l'infolettre.*|download the .* app|téléchargez .*|video not loading.*|la vidéo .*",
    "pointer": r"related:.*|read next.*|most read.*|trending now.*|recommended for you.*|more on .*|more from .*|previous:.*|next:.*|tags?:.*|topics? ·.*|sujets ?:.*|à lire aussi.*|les plus lus.*|sur le même sujet.*|part of (?:our|a) series.*|this (?:story|article|report) is (?:part|one) of .*|[»›] .*|\d{1,2}\. .*|voir aussi.*",
}
_TAIL = r"[\s.!?…»|]*"
_PAGE = re.compile("^(?:" + "|".join(PAGE_KINDS.values()) + ")" + _TAIL + "$", re.I)
_FRAME = re.compile(r"^[|\s*_=~]+|[|\s*_=~]+$")
_LETTERS = re.compile(r"[\W_]+")
_NAME = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’.-][^\W\d_]+)*")
_FIGURE = re.compile(r"\d+(?:[.,:]\d+)*")
_NAMES = re.compile(r"\bA(?: A)+\b")
CLOSE = tuple(".?!”\"»)")


def squeeze(line: str) -> str:
    """Line with single spaces, plain apostrophes and no frame of bars or rules."""
    if not line.isascii():
        line = line.replace("’", "'").replace("\u00ad", "").replace("\u200b", "")
    line = " ".join(line.split())
    if line[:1] in ("|", "*", "_", "=", "~") and not line.startswith("* "):
        line = _FRAME.sub("", line)
    return line.rstrip(" |")


def letters(text: str | None) -> str:
    return _LETTERS.sub("", text.casefold()) if text else ""


def template(line: str) -> str:
    """The line with runs of capitalised words and all figures masked."""
    return _NAMES.sub("A", _FIGURE.sub("9", _NAME.sub("A", line)))


def headline(line: str, title: str) -> bool:
    """True if the line is the story's own title, with or without the outlet's name. title: letters()."""
    own = letters(line)
    return len(own) >= 12 and len(title) >= 12 and (own == title or (own in title and len(own) > 0.55 * len(title)) or (title in own and len(title) > 0.55 * len(own)))


def own_title(line: str, title: str) -> bool:
    """A headline that starts as the title does, so no pointer to the story."""
    return headline(line, title) and letters(line)[:12] == title[:12]


def sentence(line: str) -> bool:
    """Long enough for prose, and closed like it."""
    return len(line) >= 60 and line.endswith(CLOSE)


def kind(line: str, title: str) -> int | None:
    """1 page, 0 article, None where neither wording nor shape says. line: squeezed, not empty."""
    if own_title(line, title):
        return 0
    if _PAGE.match(line):
        return 1
    return 0 if sentence(line) else None
