"""Personal details in free text: found by anchors, expanded and checked locally, and replaced by typed placeholders.

One Aho-Corasick automaton finds the anchors (at-signs and their spellings, street words, personal titles, learned surnames), all in
one pass over a text whatever their number; digits are anchors of their own. A deterministic parser expands each anchor to both sides,
as far as its grammar goes, and checks what it finds.

Names are learned first, over all documents and from their surroundings alone: a title before a word, a full name in the sentence of
an address, phone, identity number or email that was found and checked, or a common first name before a word. A word is a private surname
if a large enough share of its uses stands so (towns and companies share their letters with people, but not these places), less the
roster of members. In a second pass every mention of a learned surname is an anchor, so that a surname alone is found in documents that
never introduce it. A surname of a member is an anchor too: with a private first name that no member of that name has, it is a private person.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabarit.session import materialize

SPANS = "doc_id long, start_pos int, end_pos int, pii_type string"
MAX_NAMES = 2_000_000  # learned words that the executors hold as an automaton; beyond, learn per language or source

#: Words of the four checks, by kind.
STREET_EN = ["road", "rd", "lane", "street", "st", "row", "terrace", "close", "avenue", "ave", "drive", "way", "crescent", "court", "square", "gardens", "walk", "grove", "hill", "place"]
STREET_DE = ["straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ring", "ufer", "damm"]
STREET_FR = ["rue", "avenue", "chemin", "impasse", "boulevard", "allée", "place", "quai", "route", "passage", "sentier", "cours"]
AT_SIGNS = ["@", "(at)", "[at]", "(ät)", " at ", "\nat ", " at\n", " arobase "]
COMPANY = r"(?:Ltd|Limited|GmbH|SARL|AG|Inc|plc|PLC|LLC|LLP|SA|KG|OHG|SAS|& Co)\b"
TITLES = ["mrs", "mr", "ms", "miss", "dr", "prof", "herrn", "herr", "frau", "mme", "mlle", "monsieur", "madame", "docteur"]
#: Offices that are addressed like a name.
OFFICES = ["president", "minister", "speaker", "chairman", "chair", "secretary", "chancellor", "präsident", "präsidentin", "ministerin", "vorsitzender", "vorsitzende", "kanzler", "kanzlerin", "kollege", "kollegin", "président", "présidente", "ministre", "rapporteur", "député", "députée", "collègue"]
#: Common first names of the three languages, a first hint where nothing is learned yet.
FIRST_NAMES = {
    "en": ["alice", "andrew", "anne", "charles", "david", "edward", "elizabeth", "emma", "george", "helen", "henry", "james", "jane", "john", "margaret", "mary", "michael", "paul", "peter", "richard", "robert", "sarah", "susan", "thomas", "walter", "william"],
    "de": ["andreas", "birgit", "christian", "dieter", "fritz", "hans", "heinrich", "ingrid", "jürgen", "karin", "karl", "klaus", "monika", "otto", "petra", "sabine", "stefan", "ursula", "werner", "wolfgang"],
    "fr": ["catherine", "claire", "françois", "hélène", "henri", "isabelle", "jacques", "jean", "julie", "louis", "marie", "michel", "monique", "nathalie", "nicole", "philippe", "pierre", "rené", "sophie", "sylvie"],
}
#: Articles, prepositions and the like, which no name begins with.
ARTICLES = ["the", "a", "an", "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "le", "la", "les", "un", "une", "du", "au", "aux"]
SMALL_WORDS = [*ARTICLES, "of", "in", "on", "at", "by", "to", "for", "from", "with", "and", "or", "but", "as", "if", "no", "this", "that", "my", "his", "her", "im", "am", "auch", "und", "von", "mit", "et", "ce", "cette", "sa", "son", "ses", "que", "qui"]
NEAR_SHARE = 0.1  # of a word's uses, from which full names beside other details make it a surname
TITLED_SHARE = 0.02  # and titles
FIRST_SHARE = 0.1  # and places before a surname make it a first name

_W = r"[^\W\d_]+(?:['’][^\W\d_]+)*(?:-[^\W\d_]+)*"
_PART = rf"(?:[^\W\d_]\.|{_W})"
_UP = "A-ZÀ-ÖØ-ÞŒŠŸŽ"
_TAIL = r"[^\W\d_]*(?:['’][^\W\d_]+)*(?:-[^\W\d_]+)*"
CAPITAL_WORD = re.compile(rf"[{_UP}](?<!\w[{_UP}]){_TAIL}")
# patterns begin with the letters that they may begin with, so that all else is passed over at once
FULL_NAME = re.compile(rf"[{_UP}](?<![\w.'’-][{_UP}])(?:\.|{_TAIL})(?:,\s+[{_UP}]{_TAIL}(?:\s+[{_UP}]\.)?(?=\s*[,;/])|(?:\s+[{_UP}](?:\.|{_TAIL})){{1,3}})")
AFTER_TITLE = re.compile(rf"{_PART}(?:\s+{_PART}){{0,3}}")
SENTENCE = re.compile(r"[.!?:»)\]—–\n](?:(?<=[!?:»)\]—–])|(?<=[^\W\d_]{3}\.)|(?<=\d\.)|(?<=\n)(?=\n))\s+")

PHONE_OR_ID = re.compile(r"(?<![\w])(?:\+\d|\(0|\(\d|\d)[\d() ./  ‑\n-]*\d(?!\w)")
_PHONE = re.compile(
    r"\+\d{1,3}[ .\n-]?(?:\(0\)[ .\n-]?)?\d{1,5}(?:[ .\n-]?\d{2,8}){0,5}"  # international
    r"|00\d{2}[ .\n-]\d{1,5}(?:[ .\n-]\d{2,8}){1,4}"
    r"|\(\d{3}\)[ \n]?\d{3}[ .\n-]\d{4}|\d{3}([.-])\d{3}\1\d{4}"  # North America
    r"|\(0\d{2,4}\)[ \n]?\d{3,8}(?:[ .\n-]\d{2,5}){0,2}"  # area code in brackets
    r"|0\d{2,4}[ /.\n-]\d{3,8}(?:[ .\n-]\d{2,5}){0,3}"
    r"|0\d(?:([ .\n-])\d{2})(?:\2\d{2}){3}|0\d{9,10}"
)
_ID = re.compile(r"\d{9}|\d{3}([ .\n-])\d{3}\1\d{3}|\d{8}[ -]\d|\d([ -])\d{7,8}")
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_AT = r"(?:\s?@\s?|\s*[(\[](?:at|ät)[)\]]\s*|\s+(?:at|arobase)\s+)"
_DOT = r"(?:\.|\s*[(\[](?:dot|punkt|point)[)\]]\s*|\s+(?:dot|punkt|point)\s+)"
AT_SIGN = re.compile(_AT, re.I)
DOMAIN = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+", re.I)
SPELT_DOT = re.compile(r"\s(?:dot|punkt|point)\s|[(\[](?:dot|punkt|point)[)\]]", re.I)
_UNIT = r"(?:(?:Unit|Flat|Apartment|Apt\.?|Suite|Room)\s+\d+[a-z]?,?\s+)?"
ADDRESS_EN = re.compile(rf"(?<![\w.,/-]){_UNIT}[1-9]\d{{0,3}}[a-z]?\s+(?:(?!The\b)[A-ZÀ-Ý][\w'’-]*\s+){{1,3}}(?:{'|'.join(w.capitalize() for w in STREET_EN)})\b(?!\s+(?:closures|scheme)\b)")
ADDRESS_DE = re.compile(rf"(?:(?:Am|An der|Im|Zum|Zur)\s+)?[A-ZÄÖÜ][\wäöüß-]*?(?:{'|'.join(re.escape(w) for w in STREET_DE)})\s+[1-9]\d{{0,3}}(?:\s?[a-z])?\b(?:,?\s+(?:Wohnung|Whg\.?|Top|Tür)\s+\d+)?")
ADDRESS_FR = re.compile(
    rf"(?<![\w.,/-])(?:(?:appartement|appt\.?|apt\.?)\s+\d+,?\s+)?[1-9]\d{{0,3}}(?:\s+(?:bis|ter|quater)\b|[a-z]\b)?,?\s+(?:{'|'.join(STREET_FR)})\s+(?:(?:du|des|de\s+la|de|au|aux)\s+)?(?:(?:de\s+)?[ld]['’]\s?)?[A-ZÀ-Ý][\w-]*(?:\s+(?:d['’]|de\s+|du\s+|des\s+|de\s+la\s+)[\w-]+)?"
)


COMPANY_NEXT = re.compile(rf"\s+{COMPANY}")
_FIRM = re.compile(r"(?:Firma|société|company)\s+$")
_HYPHENED = re.compile(r"-[^\W\d_]+")
_NEXT = re.compile(r"\s+([^\W\d_]+)")
_FOLLOWING = re.compile(r"(,?\s+)([^\W\d_]+(?:-[^\W\d_]+)*)(?:\s+[^\W\d_]\.(?=[,;\s]))?")
_STREETS = {*STREET_EN, *STREET_FR}

_DIGIT = re.compile(r"\d")
_DE_NUMBER = re.compile(r"\.?\s+[1-9]")
_SPELT_AT = re.compile(r"\s+(?:at|arobase)\s+[\w-]+(?:\.\w|\s+(?:dot|punkt|point)\s|\s*[(\[](?:dot|punkt|point))", re.I)


def lower_same(text: str) -> str:
    """Lower case with every code point at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def luhn(digits: str) -> bool:
    """The mod-10 check, every second digit from the right doubled."""
    total = sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def numbers(text: str) -> Iterator[tuple[int, int, str]]:
    """Phones and identity numbers: maximal runs of digits and separators, cut at " / ", each part told by its form."""
    for m in PHONE_OR_ID.finditer(text):
        at = m.start()
        for part in re.split(r"( / |\s/\s|  +|\n\n+)", m.group()):
            yield from _number(text, at, part)
            at += len(part)


def _number(text: str, at: int, part: str) -> Iterator[tuple[int, int, str]]:
    digits = re.sub(r"\D", "", part)
    if len(digits) < 8:
        return
    if len(digits) == 9 and _ID.fullmatch(part) and luhn(digits):
        yield at, at + len(part), "id_number"
        return
    best = _PHONE.fullmatch(part) or _PHONE.match(part)
    if best is None:  # a count before a phone, or the reverse: the first place where a form fits
        for k in range(1, len(part)):
            if not part[k - 1].isdigit() and (best := _PHONE.match(part, k)):
                break
    if best and 9 <= len(re.sub(r"\D", "", best.group())) <= 15 and not (best.end() < len(part) and part[best.end()].isdigit()):
        yield at + best.start(), at + best.end(), "phone"


def in_address_of_scheme(text: str, at: int) -> bool:
    """Whether a place lies in the user part of an address with a scheme (ftp://user:word@host), whose at-sign is no email's."""
    while at and not text[at - 1].isspace():
        if text.startswith("://", at - 3) and at >= 3:
            return True
        if text[at - 1] in "<>()\"'":
            return False
        at -= 1
    return False


def back(text: str, at: int, words: int) -> int:
    """The place where the last so many words before a place begin."""
    for _ in range(words):
        while at and text[at - 1].isspace():
            at -= 1
        while at and not text[at - 1].isspace():
            at -= 1
    return at


def ahead(text: str, at: int, words: int) -> int:
    """The place where the so many words from a place on end."""
    for _ in range(words):
        while at < len(text) and text[at].isspace():
            at += 1
        while at < len(text) and not text[at].isspace():
            at += 1
    return at


def emails(text: str, at: int) -> tuple[int, int, str] | None:
    """The address round the at-sign (or its spelling) that begins at a place, blanks before it included."""
    while at and text[at - 1].isspace():
        at -= 1
    if text[at].isspace() and text[at + 1 : at + 2].isalpha() and not _SPELT_AT.match(text, at):
        return None
    sign = AT_SIGN.match(text, at)
    start = at
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
        start -= 1
    domain = sign and start < at and DOMAIN.match(text, sign.end())
    if not domain or text[domain.end() : domain.end() + 1] == "@" or in_address_of_scheme(text, start):
        return None
    name = text[start:at].lstrip(".-+%")
    word = re.fullmatch(r"\s+\w+\s+", sign.group())
    if not name or (word and not SPELT_DOT.search(domain.group()) and not re.search(r"[\d._+-]", name)):
        return None
    return at - len(name), domain.end(), "email"


def address(text: str, at: int, end: int, kind: str) -> tuple[int, int, str] | None:
    """The address whose street word is at a place; kind: en, de or fr. What is no whole word, or has no number where the kind has it, is dismissed first."""
    if kind == "de":
        if not _DE_NUMBER.match(text, end):
            return None
        rx, lo, hi = ADDRESS_DE, back(text, at, 3), ahead(text, end, 4)
    else:
        if not at or not text[at - 1].isspace() or (end < len(text) and text[end].isalnum()):
            return None
        lo, hi = back(text, at, 7), ahead(text, end, 6 if kind == "fr" else 2)
        if kind == "en" and not text[at].isupper() or not _DIGIT.search(text, lo, at):
            return None
        rx = ADDRESS_EN if kind == "en" else ADDRESS_FR
    for m in rx.finditer(text, lo, hi):
        if m.start() <= at < m.end():
            return m.start(), m.end(), "street_address"
        if m.start() > at:
            break
    return None


def surname_of(name: str) -> tuple[list[str], list[str]]:
    """(parts of the surname, first names) of a name as written: the part before a comma, the one in capitals, else the last word."""
    if "," in name:
        sur, _, rest = name.partition(",")
        sur, rest = sur.split()[-1:], rest.split()
    else:
        words = [w for w in name.split() if not w.endswith(".")]
        caps = [w for w in words if w.isupper() and len(w) > 1]
        sur = caps if caps and len(caps) < len(words) else words[-1:]
        rest = [w for w in words if w not in sur]
    return [p.lower() for w in sur for p in w.split("-")], [w.lower() for w in rest if not w.endswith(".")]


def one_edit_from(word: str, words: set[str]) -> bool:
    """Whether one letter left out, put in, changed or swapped with its neighbour makes a word one of the words."""
    letters = {c for w in words for c in w}
    cut = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    return any(a + b[1:] in words for a, b in cut if b) or any(a + b[1] + b[0] + b[2:] in words for a, b in cut if len(b) > 1) or any(a + c + rest in words for a, b in cut for c in letters for rest in (b, b[1:]))


class Finder:
    """Anchors in one automaton and the parsers behind them; surnames and given: learned words in lower case; roster: members' names in lower case."""

    def __init__(self, roster: set[str], surnames: frozenset[str] = frozenset(), given: frozenset[str] = frozenset()):
        self.first_of: dict[str, set[str]] = {}  # first names of the members of a surname
        for n in roster:
            parts = n.split()
            for p in parts[-1].split("-") if parts else ():
                self.first_of.setdefault(p, set()).update(parts[:-1])
        self.roster = {p for n in roster for p in re.split(r"[\s-]+", n)}
        self.surnames, self.given = surnames, given
        self.hints = {w for names in FIRST_NAMES.values() for w in names} - self.roster
        payload: dict[str, list] = {}
        for w in AT_SIGNS:
            payload.setdefault(w, []).append(("at", None))
        for k, words in (("en", STREET_EN), ("de", STREET_DE), ("fr", STREET_FR)):
            for w in words:
                payload.setdefault(w, []).append(("street", k))
        for w in [*TITLES, "m."]:
            payload.setdefault(w, []).append(("title", None))
        for w in surnames:
            payload.setdefault(w, []).append(("name", None))
        for w in set(self.first_of) - surnames:
            payload.setdefault(w, []).append(("shared", None))
        self.auto = ahocorasick.Automaton()
        for w, p in payload.items():
            self.auto.add_word(w, (w, p))
        self.auto.make_automaton()

    def anchors(self, text: str, low: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[str, int, int]]]:
        """(details other than names as rank, start, end, type; anchors of names as kind, start, end) of one text."""
        hits = [(1, s, e, t) for s, e, t in numbers(text)]
        names = []
        for end, (w, payload) in self.auto.iter(low):
            at = end + 1 - len(w)
            for kind, arg in payload:
                if kind == "at":
                    if f := emails(text, at):
                        hits.append((0, *f))
                elif kind == "street":
                    if f := address(text, at, end + 1, arg):
                        hits.append((2, *f))
                else:
                    names.append((kind, at, end + 1))
        return hits, names

    def named(self, words: list[str], said: Counter, why: str | None, first: bool = True) -> None:
        """Count one name as written: its surname under `why`, if given, and, if asked for, the word before it, to be a first name should this be a surname."""
        sur, rest = surname_of(" ".join(words))
        if not sur or any(w in OFFICES or w in TITLES for w in [*sur, *rest]):
            return
        if why:
            said.update((p, why, "") for p in sur if len(p) > 2 and p not in self.roster)
        if first:
            said.update((p, "before", q) for w in rest[-1:] for p in w.split("-") if len(p) > 1 for q in sur if len(q) > 2)

    def learn(self, text: str, lang: str | None) -> Counter:
        """(word, titled, near, hint or uses, "") and (word, before, the word that may be a surname) -> how often, of one text."""
        low, said = lower_same(text), Counter()
        hits, names = self.anchors(text, low)
        said.update((w.lower(), "uses", "") for w in CAPITAL_WORD.findall(text))
        for kind, s, e in names:
            if kind == "title" and (not s or not text[s - 1].isalnum()) and text[s].isupper() and (low[s:e] != "m." or lang == "fr"):
                e += text[e : e + 1] == "."
                m = AFTER_TITLE.match(text, e + 1) if text[e : e + 1].isspace() else None
                words = list(takewhile(lambda w: w[0].isupper(), m.group().split() if m else ()))
                if words and words[-1].rstrip(".").lower() not in TITLES:
                    self.named(words, said, "titled")
        cuts = [0, *(m.end() for m in SENTENCE.finditer(text))]
        in_sentence: dict[int, list[tuple[int, int]]] = {}  # the details of each sentence
        for _, s, e, _ in hits:
            for k in range(bisect_right(cuts, s) - 1, bisect_right(cuts, e - 1)):
                in_sentence.setdefault(k, []).append((s, e))
        for m in FULL_NAME.finditer(text):
            k = bisect_right(cuts, m.start()) - 1
            here, parts, begins = in_sentence.get(k, ()), m.group().split(), m.start() == cuts[k]
            if text[back(text, m.start(), 1) : m.start()].strip().lower() in ARTICLES:
                parts = parts[1:]  # what an article stands before is no name
            while parts and (parts[0].rstrip(".").lower() in TITLES or parts[0].lower() in SMALL_WORDS):
                parts, begins = parts[2 if parts[0].lower() in ARTICLES else 1 :], False
            words = list(takewhile(lambda w: w.lower() not in TITLES, parts))
            if len(words) < 2 or any(s < m.end() and m.start() < e for s, e in here) or COMPANY_NEXT.match(text, m.end()):
                continue
            hint = words[0].lower() in self.hints and words[-1].lower() not in _STREETS
            # the first word of a sentence may be any word, unless it is the surname, in capitals
            first = not begins or len([w for w in words if not w.endswith(".")]) > 2 or (words[0].isupper() and not words[1].isupper())
            self.named(words, said, "near" if here else "hint" if hint else None, first)
        return said

    def widen(self, text: str, s: int, e: int, lang: str | None) -> tuple[int, int, list[str]] | None:
        """(start, end, first names) of the whole name round a surname: hyphens, first names and initials; none for a company, a street or inside a word."""
        while s > 1 and text[s - 1] == "-" and text[s - 2].isalpha():
            s -= 1
            while s and (text[s - 1].isalpha() or text[s - 1] in "'’"):
                s -= 1
        while m := _HYPHENED.match(text, e):
            e = m.end()
        if (s and (text[s - 1].isalnum() or text[s - 1] in "_@+-")) or (e < len(text) and (text[e].isalnum() or text[e] in "_@+")):
            return None
        if COMPANY_NEXT.match(text, e) or _FIRM.search(text, back(text, s, 1), s):
            return None
        if (m := _NEXT.match(text, e)) and m.group(1)[0].isupper() and m.group(1).lower() in _STREETS:
            return None
        bare, first = s, []
        while True:
            lo = back(text, s, 1)
            left = text[lo:s].rstrip()
            if re.fullmatch(r"[\"“”'(\[]*[^\W\d_]\.", left):
                letter = left[-2]
                more = text[back(text, lo, 1) : lo].strip().lower()
                if letter.isupper() and not (lang == "fr" and letter == "M" and more not in self.given):
                    s = lo + len(left) - 2
                    continue
            word = re.search(rf"(?:{_W})$", left)
            if word and (not word.start() or not left[word.start() - 1].isalnum()) and all(p in self.given for p in word.group().lower().split("-")):
                first.append(word.group().lower())
                s = lo + word.start()
                if not word.start():
                    continue
            break
        shown = text[bare:e]
        if s == bare and (m := _FOLLOWING.match(text, e)):
            if ("," in m.group(1) or shown.isupper()) and m.group(2).lower() in self.given and m.group(2)[0].isupper():
                first.append(m.group(2).lower())
                e = m.end()
        return None if shown.islower() and s == bare else (s, e, first)

    def find(self, text: str, lang: str | None) -> list[tuple[int, int, str]]:
        """Non-overlapping (start, end, type) of one text, in order; null and empty texts have none."""
        if not text:
            return []
        low = lower_same(text)
        hits, names = self.anchors(text, low)
        for kind, s, e in names:
            if kind == "title" or not (f := self.widen(text, s, e, lang)):
                continue
            # with a member's surname, a private person has first names that no member of that name has
            if kind == "name" or (f[2] and not any(g in self.first_of[low[s:e]] for g in f[2])):
                hits.append((4, f[0], f[1], "name"))
        taken: list[tuple[int, int, str]] = []
        for _, s, e, t in sorted(set(hits), key=lambda h: (h[0], h[1] - h[2], h[1])):
            if all(e <= s2 or s >= e2 for s2, e2, _ in taken):
                taken.append((s, e, t))
        return sorted(taken)


def roster_names(members: DataFrame) -> set[str]:
    """The roster's names in lower case. The roster is bounded: it names the members of one house."""
    return {r[0].lower().strip() for r in members.select("full_name").distinct().collect() if r[0]}


FLUSH = 200_000  # words that a task counts before it passes them on


def learned_names(documents: DataFrame, members: DataFrame) -> DataFrame:
    """(word, kind, n): surnames and first names of private persons, with the number of places that show it, over all documents.

    documents: text, lang. A surname: titled, hinted at, or in full names beside other details, each in a share of its uses; a first name: before a
    surname in a share of its uses, or once if a member has it too. A word that is both is a surname if as many places show that. Members' surnames are
    none, nor, unless it stands beside other details, a word one letter from a member's name.
    """
    roster = roster_names(members)

    def learn(batches):
        finder, total = Finder(roster), Counter()
        out = lambda: pd.DataFrame([(*k, n) for k, n in total.items()], columns=["word", "kind", "of", "n"])
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                if text:
                    total.update(finder.learn(text, lang))
            if len(total) > FLUSH:
                yield out()
                total.clear()
        yield out()

    rows = documents.select("text", "lang").mapInPandas(learn, "word string, kind string, of string, n long")
    rows = materialize(rows.groupBy("word", "kind", "of").agg(F.sum("n").alias("n")), "name-words")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(kind)

    @F.pandas_udf("boolean")
    def misspelt(word: pd.Series) -> pd.Series:
        parts = {p for n in roster for p in re.split(r"[\s-]+", n)}
        return word.map(lambda w: one_edit_from(w, parts))

    words = rows.filter("kind <> 'before'").groupBy("word").agg(*[of(k) for k in ("titled", "near", "hint", "uses")])
    words = words.withColumn("shown", F.col("titled") + F.col("near") + F.col("hint"))
    surname = ((F.col("near") >= NEAR_SHARE * F.col("uses")) & (F.col("near") > 0)) | ((F.col("titled") + F.col("hint") > 0) & (F.col("shown") >= TITLED_SHARE * F.col("uses")))
    surnames = words.filter(surname).filter((F.col("near") > 0) | ~misspelt("word")).select("word", "shown")
    surnames = materialize(surnames, "surnames")
    before = rows.filter("kind = 'before'").join(surnames.select(F.col("word").alias("of")), "of").groupBy("word").agg(F.sum("n").alias("given"))
    firsts = sorted({p for n in roster for w in n.split()[:-1] for p in w.split("-")})  # members' first names are first names of others too
    given = before.join(words.select("word", "uses"), "word").filter((F.col("given") >= FIRST_SHARE * F.col("uses")) | F.col("word").isin(firsts))
    both = surnames.join(given, "word", "full_outer").select("word", F.coalesce("shown", F.lit(0)).alias("s"), F.coalesce("given", F.lit(0)).alias("g"))
    return both.select("word", F.when(F.col("s") >= F.col("g"), "surname").otherwise("given").alias("kind"), F.greatest("s", "g").alias("n"))


def _shared_names(documents: DataFrame, members: DataFrame):
    """What a Finder needs, as a broadcast: roster, surnames, first names. Raises beyond MAX_NAMES."""
    names = materialize(learned_names(documents, members), "names")
    held = names.limit(MAX_NAMES + 1).collect()
    if len(held) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names learned")
    of = lambda kind: frozenset(r["word"] for r in held if r["kind"] == kind)
    hints = frozenset(w for words in FIRST_NAMES.values() for w in words)
    return documents.sparkSession.sparkContext.broadcast((roster_names(members), of("surname"), of("given") | hints))


def personal_spans(documents: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos, pii_type): every personal detail, as 0-based code points, end exclusive; spans of a text do not overlap.

    documents: doc_id, text, lang (null: any); repeated rows give their spans once. Raises if more than MAX_NAMES
    words are learned, as each executor holds them.
    """
    shared = _shared_names(documents, members)

    def find(batches):
        finder = Finder(*shared.value)
        for pdf in batches:
            rows = [(d, *f) for d, t, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]) if t for f in finder.find(t, lang)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_pos", "end_pos", "pii_type"])

    return documents.select("doc_id", "text", "lang").mapInPandas(find, SPANS).distinct()


def replaced(documents: DataFrame, members: DataFrame) -> DataFrame:
    """documents (doc_id, text) with each personal detail replaced by its type in capitals in square brackets, the rest unchanged."""
    shared = _shared_names(documents, members)

    def swap(batches):
        finder = Finder(*shared.value)
        for pdf in batches:
            out = []
            for t, lang in zip(pdf["text"], pdf["lang"]):
                parts, at = [], 0
                for s, e, kind in finder.find(t, lang) if t else ():
                    parts += [t[at:s], f"[{kind.upper()}]"]
                    at = e
                out.append(None if t is None else "".join([*parts, t[at:]]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": out})

    return documents.select("doc_id", "text", "lang").mapInPandas(swap, "doc_id long, text string")
