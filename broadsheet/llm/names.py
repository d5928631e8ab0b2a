"""Variant spellings of names that people typed, linked field by field.

Every distinct name is brought to a form: a head (surname, or the rare word of a body), a role
(given name, line of business with legal suffix, or kind of public body) and whether the role is
only partly known (an initial, a nickname of several names, a missing suffix). Titles, case,
accents, punctuation, abbreviations, nicknames and the order of the parts are settled here.

Heads are then joined by tries. A pair within one edit (insertion, deletion, substitution or
swap of neighbours) agrees on a prefix or a suffix of half its length, or, where it is short, on
what is left after one letter of either is taken out, so heads are sharded by field, role and
that piece; each shard is a trie of the rest of its heads, which a Levenshtein automaton
traverses for every head. A shard beyond ``SHARD`` heads is cut into blocks, and every
block of queries meets every block of tries in a task of its own, so no task holds more than
two blocks and no pair is lost. Heads of up to three words are compared in every order of words,
longer ones also as the sorted words with one left out, whose left-out words are compared.

Neighbours become links by rules: a spelling seen once, or far less often than its neighbour,
joins the nearest better known one; two well known spellings, two that differ by a consonant
between vowels, and two very short ones stay apart unless other fields of their cases agree; a partly
known role joins the one full form it fits, or the one whose cases agree. How often a spelling is
seen is counted in records that differ in some name, so copies of a case don't count, and cases
agree if their other names coincide more often than names of that share would by chance.
Clusters are the connected components; pairs of cases are formed from pairs of differing strings.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.components import components
from broadsheet.session import durable, filled, map_batches, strip_blanks, table

#: Heads of up to so many words are compared in every order of them.
ORDERED = 3
FIELDS = ("person_name", "private_org", "public_org")
SHARD = 20_000
#: A token is a known given name if it stands in that many names, mostly where given names stand.
GIVEN_LEAST, GIVEN_SHARE, SLIP = 5, 2e-4, 8
#: A spelling so many times rarer than its neighbour is a slip that several made.
RARER = 8
#: Cases agree if so many coincidences of their other names have a chance under exp(-AGREEMENT).
AGREEMENT = 3.0
#: Two heads that both have fewer letters need agreeing cases to be linked.
SHORT = 5

TITLES = set("mr mrs ms mx miss dr prof professor hon honourable me maitre sir madam mme m mlle rev sen jr sr".split()) - {"m"}
# Short forms of given names; several full names make the short form ambiguous.
NICKNAMES = {
    "al": "albert alan", "alex": "alexander alexandra", "andy": "andrew", "drew": "andrew", "tony": "anthony", "barb": "barbara", "babs": "barbara",
    "ben": "benjamin", "benny": "benjamin", "charlie": "charles", "chuck": "charles", "chris": "christopher christine", "dan": "daniel", "danny": "daniel",
    "dave": "david", "deb": "deborah", "debbie": "deborah", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "theodore edward", "teddy": "theodore edward",
    "theo": "theodore", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "fred": "frederick",
    "freddy": "frederick", "gerry": "gerald", "jerry": "gerald", "greg": "gregory", "jackie": "jacqueline", "jim": "james", "jimmy": "james", "jamie": "james",
    "jo": "joanne", "joe": "joseph", "joey": "joseph", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kay": "katherine", "larry": "lawrence",
    "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "mike": "michael", "mick": "michael", "nick": "nicholas", "pat": "patricia patrick",
    "patty": "patricia", "trish": "patricia", "tricia": "patricia", "becky": "rebecca", "becca": "rebecca", "rick": "richard", "dick": "richard", "rich": "richard",
    "rob": "robert", "bob": "robert", "bobby": "robert", "sam": "samuel samantha", "sandy": "alexander sandra", "sue": "susan", "susie": "susan", "tom": "thomas",
    "tommy": "thomas", "vicky": "victoria", "vic": "victor victoria", "tori": "victoria", "bill": "william", "billy": "william", "will": "william", "liam": "william",
}
#: Letters an initial of a given name can be: its own and those of its short forms (T. for Tony, Anthony).
INITIALS: dict[str, str] = {}
for _short, _full in NICKNAMES.items():
    for _name in _full.split():
        INITIALS[_name] = "".join(sorted(set(INITIALS.get(_name, _name[0]) + _short[0])))
# Words of business names with their abbreviations, and legal suffixes.
BUSINESS = {
    "engineering": "eng engg engr", "software": "sftw softw sw", "developments": "dev devs devel development", "investments": "inv invest investment", "paving": "pav",
    "construction": "constr const", "communications": "comm comms communication", "transportation": "transp transport", "logistics": "log logist", "industries": "ind inds industry",
    "consulting": "cons consult", "resources": "res resource", "technologies": "tech techs technology", "painting": "ptg paint", "holdings": "hldgs hldg holding",
    "management": "mgmt mgt", "pharmaceuticals": "pharma pharm", "shipbuilding": "shipbldg shipb", "international": "int'l intl int", "services": "svcs svc serv service",
    "relations": "rel rels", "affairs": "aff", "contracting": "contr", "products": "prod prods product", "brothers": "bros", "government": "govt gov gov't", "public": "pub", "energy": "en",
    "forest": "for", "aggregates": "aggr agg", "stone": "", "and": "",
}
SUFFIXES = {"co": "company cie", "corp": "corporation", "inc": "incorporated incorporee", "ltd": "limited ltee limitee", "llp": "", "group": "grp groupe", "lp": ""}
# Words that tell the kind of a public body; the first that occurs decides.
BODIES = (
    ("rha", "rha health sante"), ("dsb", "dsb school scolaire"), ("police", "police"), ("airport", "airport aeroport"), ("harbour", "harbour harbor hbr port"),
    ("housing", "housing hsg logement"), ("transit", "transit transport"), ("water", "water eaux eau"), ("county", "county cnty comte"), ("town", "town municipality ville municipalite"),
)
BODY_WORDS = set(
    "of the de des du la le les l d and et regional reg health auth authority district dist school board bd police services svcs service airport corporation corp "
    "harbour harbor hbr housing hsg agency transit commission comm comm'n commn water eaux eau county cnty town municipality city village rha dsb logement office".split()
)
_UNBUSINESS = {a: k for k, v in BUSINESS.items() for a in (k, *v.split())}
_UNSUFFIX = {a: k for k, v in SUFFIXES.items() for a in (k, *v.split())}
_KIND = {a: k for k, v in BODIES for a in v.split()}
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|\d+")
_VOWELS = set("aeiouy")


def as_read(word: str) -> str:
    """The word with letters that scans confuse brought to one of them ("rn" and "m")."""
    return word.replace("rn", "m")


def fold(text: str) -> str:
    """Lower case without accents, with plain apostrophes."""
    text = unicodedata.normalize("NFKD", text.replace("’", "'")).casefold()
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


# ------------------------------------------------------------------ tries and automata


def within_one(a: str, b: str) -> bool:
    """True if one insertion, deletion, substitution or swap of neighbours (or none) makes a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def another_name(a: str, b: str) -> bool:
    """True if the two differ by one consonant between vowels: both then read like names, and a slip is no likelier than two people."""
    if len(a) != len(b):
        return False
    at = [i for i in range(len(a)) if a[i] != b[i]]
    return len(at) == 1 and 0 < at[0] < len(a) - 1 and not {a[at[0]], b[at[0]]} & _VOWELS and a[at[0] - 1] in _VOWELS and a[at[0] + 1] in _VOWELS


class Trie:
    """Words in a trie, searched with the Levenshtein automaton for one edit (with swaps)."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str) -> set[str]:
        """All words within one edit. A state is (node, place in word, edits so far)."""
        n, found = len(word), set()
        states = [(self.root, 0, 0)]
        while states:
            node, at, edits = states.pop()
            if edits:  # only the exact rest is left
                while at < n and node is not None:
                    node = node.get(word[at])
                    at += 1
                if node is not None and "" in node:
                    found.add(node[""])
                continue
            if at == n:
                if "" in node:
                    found.add(node[""])
                for c, child in node.items():
                    if c and "" in child:
                        found.add(child[""])  # one more letter at the end
                continue
            here = word[at]
            states.append((node, at + 1, 1))  # a letter of the word is missing in the trie
            for c, child in node.items():
                if not c:
                    continue
                if c == here:
                    states.append((child, at + 1, 0))
                else:
                    states.append((child, at + 1, 1))  # another letter
                    if at + 1 < n and c == word[at + 1] and here in child:
                        states.append((child[here], at + 2, 1))  # swapped neighbours
                states.append((child, at, 1))  # a letter too many in the trie
        return found


def pieces(head: str) -> list[tuple[int, str, str]]:
    """(length, side, piece): two heads within one edit share one of these.

    Sides are prefix, suffix, what a short head is with a letter left out, and the sorted words
    of a long name with one left out (there for a left-out word within one edit).
    """
    out = set()
    for size in {len(head), len(head) - 1}:
        if size < SHORT:
            out |= {(0, "d", head)} | {(0, "d", head[:i] + head[i + 1 :]) for i in range(len(head))}
        else:
            k = (size - 2) // 2
            out |= {(k, "p", head[:k]), (k, "s", head[len(head) - k :])}
    return sorted(out | {(0, "w", rest) for rest, _ in _left_out(head)})


def _left_out(head: str) -> list[tuple[str, str]]:
    """(sorted words without one, that one) of a head of more words than are put in every order."""
    words = head.split(" ")
    return [(" ".join(sorted(words[:i] + words[i + 1 :])), w) for i, w in enumerate(words)] if len(words) > ORDERED else []


# ------------------------------------------------------------------ forms


def person_tokens(name: str) -> tuple[list[str], list[str]]:
    """(tokens before a comma or all, tokens after it), titles and bracketed titles taken out."""
    text = re.sub(r"\((?:[^()]*)\)", lambda m: " " if all(t in TITLES for t in _TOKEN.findall(fold(m[0]))) else m[0], name)
    left, _, right = fold(text).partition(",")
    cut = lambda part: [t.strip("'") for t in _TOKEN.findall(part) if t not in TITLES]
    return cut(left), cut(right)


def person_form(name: str, given: set[str], trie: Trie, seen: set[str] | None = None) -> tuple[str, str, str] | None:
    """(head, role, partial): role is the given name, or what is known of it.

    A short form of several names means those that the column itself has (``seen``), if any.
    """
    left, right = person_tokens(name)

    def settle(token: str) -> str:
        if token in given or token in NICKNAMES or len(token) < 4:
            return token
        near = trie.near(token)
        alike = {n for n in near if as_read(n) == as_read(token)} or near
        if len(alike) != 1:
            return token
        one = min(alike)
        return one if one in given or one in NICKNAMES else min((g for g in given if as_read(g) == one), default=token)

    known = lambda t: t in given or t in NICKNAMES
    if right and left:
        last, first = left, [settle(t) for t in right]
    else:
        tokens = left or right
        full = [t for t in tokens if len(t) > 1]
        if len(full) <= 1:
            last, first = full, [t for t in tokens if len(t) == 1]
        else:
            settled = [settle(t) for t in full]
            at = next((i for i in (0, len(full) - 1) if known(full[i])), next((i for i in (0, len(full) - 1) if known(settled[i])), None))
            edge = next((t for t in (tokens[0], tokens[-1]) if len(t) == 1), None)
            if at is None and edge:  # an initial and a surname of several words
                last, first = full, [edge]
            else:
                at = at or 0
                first, last = [settled[at]], [t for i, t in enumerate(full) if i != at]
    last = [t for t in last if len(t) > 1]
    if not last:
        return None
    head = " ".join(sorted(last))
    whole = [t for t in first if len(t) > 1]
    if not whole:
        return (head, first[0], "initial") if first else (head, "", "initial")
    options = NICKNAMES.get(whole[0], whole[0]).split() if whole[0] not in given or whole[0] in NICKNAMES else [whole[0]]
    fitting = [o for o in options if o in (given if seen is None else seen)] or options
    return (head, fitting[0], "") if len(fitting) == 1 else (head, " ".join(sorted(fitting)), "nickname")


def private_form(name: str) -> tuple[str, str, str] | None:
    """(head, business + suffix, partial)."""
    text = re.sub(r"\(\s*canada\s*\)", " ", fold(name))
    text = re.sub(r"\bl\.?\s?l\.?\s?p\b\.?", " llp ", text).replace("int'l", "international").replace("gov't", "government").replace("&", " ")
    tokens = [t for t in _TOKEN.findall(text) if t not in ("the", "and", "of", "canada")]
    suffix = ""
    while len(tokens) > 1 and tokens[-1] in _UNSUFFIX:
        suffix = _UNSUFFIX[tokens.pop()] if not suffix or _UNSUFFIX[tokens[-1]] != "co" else (suffix, tokens.pop())[0]
    business = sorted({_UNBUSINESS[t] for t in tokens if t in _UNBUSINESS})
    head = [t for t in tokens if t not in _UNBUSINESS]
    if not head:
        head, business = tokens, []
    if not head:
        return None
    return " ".join(sorted(head)), " ".join(business), suffix


def public_form(name: str) -> tuple[str, str, str] | None:
    """(head, kind of body, "")."""
    tokens = _TOKEN.findall(fold(name))
    kind = next((k for k, v in BODIES if any(t in v.split() for t in tokens)), "")
    head = [t for t in tokens if t not in BODY_WORDS and t not in ("n",)] if kind else [t for t in tokens if t not in ("the", "of", "de", "la", "le")]
    head = head or tokens
    return (" ".join(sorted(head)), kind, "") if head else None


def _tokens_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for name in pdf["name"]:
            left, right = person_tokens(name)
            if left and right:
                rows += [(t, 0, 1) for t in left if len(t) > 1] + [(t, 1, 1) for t in right if len(t) > 1]
            else:
                full = [t for t in left or right if len(t) > 1]
                rows += [(t, int(i == 0 and len(full) > 1), 1) for i, t in enumerate(full)]
        out = pd.DataFrame(rows, columns=["token", "given", "n"])
        yield out.groupby("token", as_index=False).sum().astype({"given": "int64", "n": "int64"})


def given_names(names: DataFrame) -> set[str]:
    """Given names known from the column itself: at most tokens / GIVEN_SHARE of them.

    A token within one edit of one ``SLIP`` times as frequent is a slip that many made ("umaa"), no name.
    """
    persons = names.filter(F.col("field") == "person_name").select("name")
    least = max(GIVEN_LEAST, int(GIVEN_SHARE * persons.count()))
    counted = map_batches(persons, _tokens_of, "token string, given long, n long").groupBy("token").agg(F.sum("given").alias("g"), F.sum("n").alias("n"))
    held = {r.token: r.n for r in counted.filter((F.col("n") >= least) & (F.col("g") > 0.6 * F.col("n"))).select("token", "n").collect()}
    trie = Trie(sorted(held))
    return {t for t, n in held.items() if not any(held[o] >= SLIP * n for o in trie.near(t))}


def forms(names: DataFrame) -> DataFrame:
    """names (field, name, n, records) with head, role and partial; names without any word are left out."""
    seen = given_names(names)
    given = seen | {x for v in NICKNAMES.values() for x in v.split()}
    trie = Trie(sorted(given | {n for n in NICKNAMES if len(n) > 2} | {as_read(g) for g in seen}))

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for field, name in zip(pdf["field"], pdf["name"], strict=True):
                form = person_form(name, given, trie, seen) if field == "person_name" else private_form(name) if field == "private_org" else public_form(name)
                made.append(form or (None, None, None))
            pdf[["head", "role", "partial"]] = pd.DataFrame(made, index=pdf.index, columns=["head", "role", "partial"], dtype="object")
            yield pdf

    return map_batches(names, shape, "field string, name string, n long, records long, head string, role string, partial string").filter(F.col("head").isNotNull())


# ------------------------------------------------------------------ trie join


def _role_keys(field: str, role: str, partial: str) -> list[str]:
    """Keys under which a form meets others: full given names also under their initial."""
    if field != "person_name":
        return [role]
    if partial == "initial":
        return ["i:" + role]
    return ["g:" + r for r in role.split()] + sorted({"i:" + c for r in role.split() for c in INITIALS.get(r, r[:1])})


def _to_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [
            (form, head, f"{field}\u0001{key}\u0001{k}{side}\u0001{piece}")
            for form, field, head, role, partial in zip(pdf["form"], pdf["field"], pdf["head"], pdf["role"], pdf["partial"], strict=True)
            for key in _role_keys(field, role, partial)
            for order in _orders(head)
            for k, side, piece in pieces(order)
        ]
        yield pd.DataFrame(rows, columns=["form", "head", "shard"])


def _orders(head: str) -> set[str]:
    """The head in every order of its words (up to ``ORDERED``), as written and as a scan may have read it."""
    return {" ".join(p) for h in {head, as_read(head)} for p in permutations(h.split())} if head.count(" ") < ORDERED else {head, as_read(head)}


def _rests(head: str, side: str, piece: str) -> set[str]:
    """What a head adds to the piece of a shard, in every order of its words that fits the piece."""
    k = len(piece)
    if side == "w":
        return {w for h in {head, as_read(head)} for rest, w in _left_out(h) if rest == piece}
    if side == "d":
        return {h for h in _orders(head) if h == piece or (len(h) == k + 1 and within_one(h, piece))}
    if side == "p":
        return {h[k:] for h in _orders(head) if h.startswith(piece)}
    return {h[: len(h) - k][::-1] for h in _orders(head) if h.endswith(piece)}


def _join_shard(shard: str, queries: list[tuple[int, str]], index: list[tuple[int, str]]) -> set[tuple[int, int, int]]:
    """Pairs (a, b, apart) of forms, a < b, whose heads are within one edit in some order of their words."""
    side, piece = shard.rsplit("\u0001", 2)[1][-1], shard.rsplit("\u0001", 1)[1]
    whole = {"p": lambda r: piece + r, "s": lambda r: r[::-1] + piece}.get(side, lambda r: r)
    held: dict[str, list[int]] = defaultdict(list)
    for form, head in index:
        for rest in _rests(head, side, piece):
            held[rest].append(form)
    trie = Trie(held)
    out = set()
    for form, head in queries:
        for rest in _rests(head, side, piece):
            own = whole(rest)
            for near in trie.near(rest):
                other = whole(near)
                apart = 0 if other == own else 3 if side != "w" and max(len(own), len(other)) < SHORT else 1 + another_name(other, own)
                out |= {(min(form, b), max(form, b), apart) for b in held[near] if b != form}
    return out


def _join_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards arrive sorted; only the current block of queries and the current block of its trie are held."""
    now, queries, index, out = None, [], [], []

    def flush() -> list:
        return sorted(_join_shard(now[0], queries, index)) if now and queries and index else []

    frame = lambda rows: pd.DataFrame(rows, columns=["a", "b", "apart"]).astype({"a": "int64", "b": "int64", "apart": "int32"})
    for pdf in batches:
        for shard, q, i, query, form, head in pdf.itertuples(index=False, name=None):
            if (shard, q, i) != now:
                out += flush()
                now, queries, index = (shard, q, i), [], []
                if len(out) > 20_000:
                    yield frame(out)
                    out = []
            if query & 1:
                queries.append((form, head))
            if query & 2:
                index.append((form, head))
    yield frame(out + flush())


def neighbours(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """(a, b, apart): pairs of forms under a common role key with heads at most one edit apart.

    apart is 0 for equal heads, 2 where the edit makes :func:`another_name`, 3 where both are very short, else 1.
    """
    placed = map_batches(nodes.select("form", "field", "head", "role", "partial"), _to_shards, "form long, head string, shard string").distinct()
    sizes = placed.groupBy("shard").agg(F.count("*").alias("size")).filter("size > 1")
    placed = placed.join(sizes, "shard").withColumn("blocks", F.ceil(F.col("size") / shard).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("form"), F.col("blocks")).cast("int"))
    # Block x of the queries meets block y of the tries in task (x, y); a form is a query in row x and in the trie of column y.
    cells = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda y: F.when(y == F.col("block"), F.array(F.struct(y.alias("q"), y.alias("i"), F.lit(3).alias("query")))).otherwise(
                F.array(F.struct(F.col("block").alias("q"), y.alias("i"), F.lit(1).alias("query")), F.struct(y.alias("q"), F.col("block").alias("i"), F.lit(2).alias("query")))
            ),
        )
    )
    placed = placed.select("shard", "form", "head", F.inline(cells)).select("shard", "q", "i", "query", "form", "head")
    placed = placed.repartition("shard", "q", "i").sortWithinPartitions("shard", "q", "i")
    return map_batches(placed, _join_shards, "a long, b long, apart int").groupBy("a", "b").agg(F.min("apart").alias("apart"))


# ------------------------------------------------------------------ links


def agreeing(near: DataFrame, mentions: DataFrame) -> DataFrame:
    """(a, b, agree = 1): pairs of forms whose records' other names coincide more often than by chance.

    mentions: record, field, form, said (the head of the name). The expected coincidences of a and b
    are the shares of what a's records say, summed, times b's records (or the other way round, if
    that is less); the observed ones have at most the chance exp(expected - seen - seen *
    ln(expected / seen)). Shares make the test the same at any size, so no name is too common to
    be counted. A form with a third of all records meets its neighbours' names by joins on the name.
    """
    mentions = durable(mentions.distinct())
    records = mentions.agg(F.count_distinct("record")).first()[0]
    share = mentions.groupBy("said").agg((F.count_distinct("record") / F.lit(float(max(1, records)))).alias("share"))
    mine = mentions.select("record", "form", "field")
    other = mentions.select("record", "said", F.col("field").alias("of"))
    wanted = near.select(F.col("a").alias("form")).unionAll(near.select(F.col("b").alias("form"))).distinct()
    said = durable(mine.join(wanted, "form", "left_semi").join(other, "record").filter("field != of").select("form", "said").distinct().join(share, "said"))
    known = said.groupBy("form").agg(F.sum("share").alias("mass")).join(mentions.select("form", "record").distinct().groupBy("form").agg(F.count("*").alias("records")), "form")
    seen = near.select("a", "b").join(said.select(F.col("form").alias("a"), "said"), "a").join(said.select(F.col("form").alias("b"), "said"), ["b", "said"]).groupBy("a", "b").agg(F.count("*").alias("seen"))
    side = lambda p: known.select(F.col("form").alias(p), F.col("mass").alias(f"mass_{p}"), F.col("records").alias(f"records_{p}"))
    both = seen.join(side("a"), "a").join(side("b"), "b").withColumn("expected", F.least(F.col("mass_a") * F.col("records_b"), F.col("mass_b") * F.col("records_a")))
    surprise = F.col("seen") * F.log(F.col("seen") / F.col("expected")) - F.col("seen") + F.col("expected")
    return both.filter((F.col("seen") > F.col("expected")) & (surprise >= AGREEMENT)).select("a", "b", F.lit(1).alias("agree"))


def link(cases: DataFrame, shard: int = SHARD) -> DataFrame:
    """(field_name, name, cluster, n): every distinct name of a field with the cluster it belongs to.

    cases: id, person_name, private_org, public_org. Nulls, blanks and words for no value are no
    names; repeated rows count once, and n counts cases, so copies of cases under other ids change n
    but no link; a name linked to nothing is a cluster of its own; a name without any word is left out. Ties between equally good links go to the smaller form. An
    empty table gives an empty table; other columns are ignored.
    """
    rows = cases.filter(F.col("id").isNotNull()).select("id", *FIELDS).distinct()
    # Cases that say the same in all fields are one record with a count: copies neither make a spelling known nor agree with one another.
    records = rows.groupBy(*FIELDS).agg(F.count("*").alias("n"))
    stack = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("name")) for f in FIELDS])
    named = durable(records.select(F.xxhash64(*FIELDS).alias("record"), "n", F.inline(stack)).filter(filled(F.col("name"))))
    shaped = durable(forms(named.groupBy("field", "name").agg(F.sum("n").alias("n"), F.count("*").alias("records"))))
    shaped = shaped.withColumn("form", F.xxhash64("field", "head", "role", "partial"))
    nodes = durable(shaped.groupBy("form", "field", "head", "role", "partial").agg(F.sum("records").alias("n")))
    near = durable(neighbours(nodes, shard))
    agree = agreeing(near, named.join(shaped.select("field", "name", "form", "head"), ["field", "name"]).select("record", "field", "form", F.xxhash64("field", "head").alias("said")))
    part = lambda p: nodes.select(F.col("form").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("field", "head", "role", "partial", "n")])
    pairs = near.join(part("a"), "a").join(part("b"), "b").join(agree, ["a", "b"], "left").fillna(0, ["agree"])
    turned = {c: "b" + c[1:] if c == "a" or c.startswith("a_") else "a" + c[1:] if c == "b" or c.startswith("b_") else c for c in pairs.columns}
    pairs = durable(pairs)  # narrow, and read by every rule below
    both = pairs.unionByName(pairs.select(*[F.col(c).alias(turned[c]) for c in pairs.columns]))
    # x = a looks for a parent among the b.
    person = F.col("a_field") == "person_name"
    private = F.col("a_field") == "private_org"
    a_part = F.when(person, F.col("a_partial") != "").when(private, F.col("a_partial") == "").otherwise(F.lit(False))
    b_part = F.when(person, F.col("b_partial") != "").when(private, F.col("b_partial") == "").otherwise(F.lit(False))
    initials = F.create_map(*[F.lit(x) for pair in INITIALS.items() for x in pair])
    nickname = (F.col("a_partial") == "nickname") & ~F.array_contains(F.split("b_role", " "), F.col("a_role"))
    fits = (
        F.when(person & (F.col("a_partial") == "initial"), F.when(F.col("b_partial") == "initial", F.col("a_role") == F.col("b_role")).otherwise(F.coalesce(initials[F.col("b_role")], F.substring("b_role", 1, 1)).contains(F.col("a_role")) & (F.col("a_role") != "")))
        .when(person & nickname, F.array_contains(F.split("a_role", " "), F.col("b_role")))
        .when(person, F.col("a_role") == F.col("b_role"))
        .when(private, (F.col("a_role") == F.col("b_role")) & (a_part | b_part | (F.col("a_partial") == F.col("b_partial"))))
        .otherwise(F.col("a_role") == F.col("b_role"))
    )
    better = F.struct("b_n", "b") > F.struct("a_n", "a")
    once = ((F.least("a_n", "b_n") == 1) | (F.least("a_n", "b_n") * RARER <= F.greatest("a_n", "b_n"))) & (F.col("apart") < 2)
    both = both.filter(fits).withColumns({"a_part": a_part, "b_part": b_part})
    same_kind = both.filter((F.col("a_part") == F.col("b_part")) & better & ((F.col("agree") == 1) | once))
    # Spellings seen once have no better known one among them: they are all tied to one another.
    singles = both.filter((F.col("a_part") == F.col("b_part")) & once & (F.col("a_n") == 1) & (F.col("b_n") == 1)).select("a", "b")
    to_full = both.filter(F.col("a_part") & ~F.col("b_part") & ((F.col("apart") < 2) | (F.col("agree") == 1)))
    best = F.struct(F.col("agree"), -F.col("apart"), F.col("b_n"), F.col("b"))
    like = same_kind.groupBy("a").agg(F.max(best).alias("s")).select("a", F.col("s.b").alias("b"))
    # A partial form takes the one full form it fits best: same head before a near one, agreeing cases first.
    graded = to_full.withColumn("level", F.when(F.col("apart") == 0, F.when(F.col("agree") == 1, 3).otherwise(1)).otherwise(F.when(F.col("agree") == 1, 2).otherwise(0)))
    top = graded.groupBy("a").agg(F.max("level").alias("top"))
    chosen = graded.join(top, "a").filter(F.col("level") == F.col("top")).groupBy("a").agg(F.count("*").alias("c"), F.max("b").alias("b")).filter("c = 1").select("a", "b")
    # One way only: a partial form that found its full form doesn't also lean on another partial one.
    like = like.unionAll(singles).join(chosen.select("a"), "a", "left_anti")
    parts = components(durable(like.unionAll(chosen)), "a", "b")
    return (
        shaped.join(parts, F.col("form") == F.col("node"), "left")
        .select(F.col("field").alias("field_name"), "name", F.coalesce("component", "form").alias("cluster"), "n")
    )


def linked_cases(cases: DataFrame, shard: int = SHARD) -> DataFrame:
    """(field_name, id_1, id_2): cases that name the same one by differing strings.

    Pairs are formed between the distinct strings of a cluster and only then between their cases,
    so rows that share a string are never compared with one another.
    """
    clusters = durable(link(cases, shard))
    some = clusters.groupBy("cluster", "field_name").agg(F.count("*").alias("c")).filter("c > 1").select("cluster", "field_name")
    names = clusters.join(some, ["cluster", "field_name"])
    left = names.select("field_name", "cluster", F.col("name").alias("x"))
    pairs = left.join(names.select("field_name", "cluster", F.col("name").alias("y")), ["field_name", "cluster"]).filter("x < y").select("field_name", "x", "y")
    stack = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("name")) for f in FIELDS])
    ids = cases.select("id", F.inline(stack)).filter(F.col("name").isNotNull() & F.col("id").isNotNull()).distinct()
    first = pairs.join(ids.select("field_name", F.col("name").alias("x"), F.col("id").alias("i")), ["field_name", "x"])
    second = first.join(ids.select("field_name", F.col("name").alias("y"), F.col("id").alias("j")), ["field_name", "y"])
    return second.filter("i != j").select("field_name", F.least("i", "j").alias("id_1"), F.greatest("i", "j").alias("id_2")).distinct()


def found(spark, root: str) -> DataFrame:
    """p4_found."""
    return linked_cases(table(spark, root, "cases", ["id", *FIELDS]))


def clusters(spark, root: str) -> DataFrame:
    """One row per distinct name with its cluster and number of cases."""
    df = link(table(spark, root, "cases", ["id", *FIELDS]))
    return df.select("field_name", F.col("name"), "cluster", "n").filter(strip_blanks(F.col("name")) != "")
