"""Personal information inside free text (problem 8).

A semi-Markov conditional random field labels whole spans.  Anchors (digit runs, at-signs, street words, capitalised
runs, given names) propose candidate spans of bounded length with the types they can have; features look at the whole
span and its surroundings; dynamic programming over the candidates of a neighbourhood chooses boundaries and types
together, everything else is left as text.  Weights are fitted by conditional likelihood on a bounded sample of texts
(``SAMPLE`` texts, chosen by hash) that labelling rules mark as certain; the fitted field then judges every text whole.

Defined results: null, empty and blank texts have no rows; found_text is the exact substring; repeated texts are judged
each; a text that holds the same wording twice gives one row; very long texts are read whole; an empty given-names
table leaves the field without that feature.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.sampling import bounded
from graphloom.session import cut, spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
SAMPLE = 9000
EPOCHS = 4

U, L = "A-ZÀ-ÖØ-ÞŁŚŠŽ", "a-zß-öø-ÿœłńśšžćčęą"
NAME = rf"[{U}][{L}]+(?:[-'’][{U}][{L}]+)?"
# Patterns begin with the character that they search, and look back over it: so the search skips all others at once.
RUN = re.compile(rf"[{U}](?<![\w.@+/`-][{U}])(?:[{L}]+(?:[-'’][{U}][{L}]+)?|\.)(?:[ \xa0](?:{NAME}|[{U}]\.))+(?![\w@`])")
PART = re.compile(rf"{NAME}|[{U}]\.")
SURNAME_FIRST = re.compile(rf"[{U}](?<![\w.@+-][{U}])[{U}]{{2,}}(?:-[{U}]{{2,}})?,[ \xa0](?:{NAME}|[{U}]\.)(?:[ \xa0][{U}]\.)?(?![\w@])")
LOWER_TAIL = re.compile(rf"(?:-[{L}]+)?[ \xa0](?:[{L}]\.[ \xa0])?[{L}]{{4,}}(?![\w@-])")
LOWER_INITIAL = re.compile(rf"\.(?<=[{L}]\.)(?<![\w.@+-][{L}]\.)[ \xa0][{L}]{{5,}}(?![\w@.-])")  # from its point on
CODE_START = re.compile(r"[+(A-Z\d](?<![\w.@/#-][+(A-Z\d])(?:(?<=\d)|(?<=[+(])(?=[+(A-Z\d])|(?<=[A-Z])(?=[A-Z]?[\d -]))")
CODE = re.compile(
    r"(?!\d{4}-\d\d-\d\d[T ]\d)[+(]{0,2}(?:[A-Z]{1,2}(?=[\d-]|[ ]\d\d[ ])[ -]?)?\d[\dA-Z]*(?:(?:[ \xa0]?\(|\)[ \xa0]?|[ \xa0.\-/])(?:\d[\dA-Z]*|[A-Z]\b(?!['’])))*(?![\w@])"
)
SERIAL = re.compile(r"[A-Z](?<![\w.@/#-][A-Z])[A-Z0-9]{8}(?![\w@-])")
GROUP = re.compile(r"[ \xa0]")
AT = re.compile(r"@|[ \xa0]?[\[({]at[\])}][ \xa0]?|[ \xa0]AT[ \xa0]|[ \xa0]at[ \xa0](?=[\w-]+[ \xa0]dot[ \xa0])")
DOT = r"(?:\.|[ \xa0]?[\[({]dot[\])}][ \xa0]?|[ \xa0]DOT[ \xa0]|[ \xa0]dot[ \xa0])"
DOMAIN = re.compile(rf"[\w-]+(?:{DOT}[\w-]+)*")
# Words for ways, by where they stand.
AFTER = "Street|Road|Lane|Avenue|Ave|Drive|Close|Court|Square|Terrace|Place|Way|Crescent|Gardens|Boulevard|Blvd|St|Rd"
BEFORE_FR = "rue|avenue|boulevard|chemin|impasse|allée|quai|place|route"
BEFORE_ES = r"Calle|C/|Plaza|Paseo|Avenida|Avda\.|Av\.|Rua|R\.|Travessa|Praça|Alameda|Via|Viale|Piazza|Largo"
PROPER = rf"[{U}][{L}]+(?:[-][{U}][{L}]+)?"
STREET = re.compile(
    rf"(?<![\w.-])(?P<en>\d{{1,5}}(?:-?[A-Za-z])?[ \xa0](?:{PROPER}[ \xa0]){{1,3}}(?:{AFTER})\b\.?)"
    rf"|(?<![\w.-])(?P<fr>\d{{1,5}}(?:[ ](?:bis|ter|quater))?,?[ ](?:{BEFORE_FR})[ ](?:des?[ ]|du[ ]|de[ ]la[ ]|de[ ]l['’]|d['’])?{PROPER}(?:[ ]{PROPER})?)"
    rf"|(?<!\w)(?P<es>(?:{BEFORE_ES})[ ](?:d[eao]s?[ ]|del[ ]|de[ ]las?[ ]|de[ ]los[ ])?{PROPER}(?:[ ]{PROPER})?,?[ ](?:n\.?[º°o]\.?[ ])?\d{{1,5}}[A-Za-z]?\b)"
    rf"|(?<!\w)(?P<am>(?:Am|An[ ]der|An[ ]den|Im|In[ ]der|Zum|Zur|Auf[ ]dem|Auf[ ]der|Unter[ ]den|Hinter[ ]dem)[ ]{PROPER}[ ]\d{{1,5}}(?:[ ]?[a-z]\b)?(?:[-–/]\d{{1,5}}[a-z]?)?(?!\w))"
    rf"|(?<!\w)(?P<de>(?:{PROPER}[ ])?{PROPER}(?:straße|strasse|str\.|-Straße|-Weg|weg|gasse|platz|allee|ufer|-Allee|-Platz)[ ]\d{{1,5}}(?:[ ]?[a-z]\b)?(?:[-–/]\d{{1,5}}[a-z]?)?(?!\w))"
    r"|(?P<ja>[぀-ヿ一-鿿]{1,8}[町村区丁目]\d{1,3}(?:-\d{1,3}){1,3}(?!\d))"
)
# Literals that every address or spelled-out at-sign holds; only their surroundings are searched.
STREET_ANCHORS = [
    *(b + w for w in AFTER.split("|") for b in " \xa0"), *(w + " " for w in BEFORE_FR.split("|")), *(w.replace("\\", "") + " " for w in BEFORE_ES.split("|")),
    *(w + " " for w in ("straße", "strasse", "str.", "Straße", "weg", "Weg", "gasse", "platz", "Platz", "allee", "Allee", "ufer", "Am", "An der", "An den", "Im", "In der", "Zum", "Zur", "Auf dem", "Auf der", "Unter den", "Hinter dem")),
    "町", "村", "区", "丁目",
]
AT_ANCHORS = ["@", *(o + "at" + c for o in "[({" for c in "])}"), " AT ", " at ", "\xa0AT\xa0", "\xa0at\xa0"]
DIGIT = re.compile(r"\d")
BEFORE, AFTERWARDS = 7, 9
MOST_DIGITS = 24  # longer numbers are no numbers of a person
NAME_BEFORE = re.compile(rf"({NAME})[ \xa0]$")
WORD_LEFT = re.compile(r"(\w+)?(\W{0,3})$")
WORD_RIGHT = re.compile(r"(\W{0,3})(\w+)?")
TOKEN = re.compile(r"\w{3,}")  # shorter words are in no list
SPACES, CAPITAL, DIGITS, FIGURE, DOTS = (re.compile(x) for x in (r"\s+", r"[A-Z]", r"\d+", r"[9A]+", DOT))

Candidate = tuple[int, int, str, str]  # start, end, kind, form


class Lexicon:
    """Given names (also in lower case, as an automaton); common words and fixed phrases of the corpus."""

    def __init__(self, given: list[str], common: set[str], fixed: set[str] = frozenset()):
        self.given, self.common, self.fixed = set(given), common, fixed
        self.lower = {g.lower() for g in given}
        self._automaton = None

    def __getstate__(self):
        return self.given, self.common, self.fixed, self.lower

    def __setstate__(self, state):
        self.given, self.common, self.fixed, self.lower = state
        self._automaton = None

    def hits(self, text: str) -> Iterator[tuple[int, int]]:
        """Places of lower-case given names that stand as words."""
        if not self.lower:
            return
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for g in self.lower:
                self._automaton.add_word(g, len(g))
            self._automaton.make_automaton()
        n = len(text)
        for last, size in self._automaton.iter(text):
            a, b = last - size + 1, last + 1
            if (a == 0 or not (text[a - 1].isalnum() or text[a - 1] in "_.@+-")) and b < n and text[b] in " \xa0-":
                yield a, b


@lru_cache(maxsize=1)
def anchors():
    """Automaton of the literals, each with its size and whether it belongs to an address."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in AT_ANCHORS:
        a.add_word(w, (len(w), False))
    for w in STREET_ANCHORS:
        a.add_word(w, (len(w), True))
    a.make_automaton()
    return a


def anchored(text: str) -> tuple[list[re.Match], list[re.Match]]:
    """The at-signs of a text and its street addresses.

    An address has at most BEFORE blanks before its anchor and AFTERWARDS behind it; words may be as long as they like.
    """
    ats: dict[int, re.Match] = {}
    windows: list[list[int]] = []
    blanks: list[int] | None = None
    for last, (size, street) in anchors().iter(text):
        at = last - size + 1
        if street:
            if blanks is None:
                blanks = [m.start() for m in GROUP.finditer(text)]
            k, q = bisect_left(blanks, at) - BEFORE, bisect_left(blanks, last) + AFTERWARDS
            low, high = blanks[k] if k >= 0 else 0, blanks[q] if q < len(blanks) else len(text)
            if windows and low <= windows[-1][1]:
                windows[-1][1] = max(high, windows[-1][1])
            else:
                windows.append([low, high])
        else:
            m = AT.match(text, at - 1 if at and text[at - 1] in " \xa0" else at) or AT.match(text, at)
            if m:
                ats.setdefault(m.end(), m)
    streets: dict[int, re.Match] = {}
    for low, high in windows:
        if DIGIT.search(text, low, high):
            for m in STREET.finditer(text, low, high):
                streets[m.start()] = m
    return list(ats.values()), list(streets.values())


def local_part(text: str, end: int) -> int:
    """Where the local part of an address begins that ends before the at-sign."""
    at = end
    while at and (text[at - 1].isalnum() or text[at - 1] in "_.+%-"):
        at -= 1
    return at


def codes(text: str) -> Iterator[re.Match]:
    """Numbers of several groups, from left to right."""
    end = 0
    for start in CODE_START.finditer(text):
        if start.start() >= end and (m := CODE.match(text, start.start())):
            end = m.end()
            yield m


def candidates(text: str, lex: Lexicon) -> list[Candidate]:
    """All spans that may be entities; spans of one text may overlap."""
    out: list[Candidate] = []
    ats, streets = anchored(text)
    for m in ats:
        left = local_part(text, m.start())
        right = DOMAIN.match(text, m.end())
        if left < m.start() and right:
            end = right.end()
            while text[end - 1] in "-_":
                end -= 1
            out.append((left, end, "email", "@" if m.group() == "@" else m.group().strip().lower()))
    for m in codes(text):
        s = m.group()
        if len(s) < 7 or sum(c.isdigit() for c in s) < 6:
            continue
        starts = [0, *(g.end() for g in GROUP.finditer(s))]
        ends = [*(g.start() for g in GROUP.finditer(s)), len(s)]
        for a in range(len(starts)):
            for b in range(a, len(ends)):
                part = s[starts[a] : ends[b]]
                trimmed = part.rstrip(" .-/(\xa0")
                digits = sum(c.isdigit() for c in trimmed)
                if digits > MOST_DIGITS:
                    break
                if trimmed[-2:-1] in (" ", "\xa0") and trimmed[-1].isalpha() and not trimmed[0].isalpha():
                    continue  # the first word of the next sentence
                letters = sum(c.isalpha() for c in trimmed)
                if digits + letters < 7 or digits < 6:
                    continue
                at = m.start() + starts[a]
                if not trimmed[0].isalpha():
                    if not letters:
                        out.append((at, at + len(trimmed), "phone", "run"))
                    out.append((at, at + len(trimmed), "id_number", "run"))
                else:
                    out.append((at, at + len(trimmed), "id_number", "letter"))
    for m in SERIAL.finditer(text):
        if not m.group()[1:].isdigit():
            out.append((m.start(), m.end(), "id_number", "serial"))
    out += [(m.start(), m.end(), "street_address", m.lastgroup) for m in streets]
    out += runs(text)
    for m in SURNAME_FIRST.finditer(text):
        out.append((m.start(), m.end(), "person_name", "surname_first"))
    out += lower_names(text, lex)
    for m in LOWER_INITIAL.finditer(text):
        out.append((m.start() - 1, m.end(), "person_name", "lower_initial"))
    out.sort()
    return out


def runs(text: str) -> list[Candidate]:
    """Names in runs of capitalised words."""
    out: list[Candidate] = []
    for m in RUN.finditer(text):
        parts = [(m.start() + p.start(), m.start() + p.end()) for p in PART.finditer(m.group())]
        for i in range(len(parts) - 1):
            for j in range(i + 1, min(i + 3, len(parts))):
                if text[parts[j][1] - 1] == "." or j == i + 2 and text[parts[i + 1][1] - 1] != ".":
                    continue
                form = "initial" if text[parts[i][1] - 1] == "." else "given"
                out.append((parts[i][0], parts[j][1], "person_name", form))
    return out


def lower_names(text: str, lex: Lexicon) -> list[Candidate]:
    """Names in lower case that begin with a given name."""
    out: list[Candidate] = []
    for a, b in lex.hits(text):
        m = LOWER_TAIL.match(text, b)
        if m:
            out.append((a, m.end(), "person_name", "lower"))
    return out


def name_parts(text: str, c: Candidate) -> tuple[str, str]:
    s = text[c[0] : c[1]].replace("\xa0", " ")
    if c[3] == "surname_first":
        sur, _, given = s.partition(", ")
        return given.split(" ")[0], sur
    words = s.split(" ")
    return words[0], words[-1]


def features(text: str, c: Candidate, lex: Lexicon) -> tuple[str, ...]:
    """Whole-span features and surroundings of a candidate, each with its kind."""
    a, b, kind, form = c
    left = WORD_LEFT.search(text[max(0, a - 24) : a])
    right = WORD_RIGHT.match(text[b : b + 24])
    lw, lp, rp, rw = (left.group(1) or "").lower(), left.group(2), right.group(1), (right.group(2) or "").lower()
    if lw[:1].isdigit():
        lw = "9"
    if rw[:1].isdigit():
        rw = "9"
    if not lw.isascii() and len(lw) > 3 and any("぀" <= x <= "鿿" for x in lw):
        lw = lw[-2:]
    if not rw.isascii() and any("぀" <= x <= "鿿" for x in rw):
        rw = rw[:2]
    lp = SPACES.sub("~" if "\n" in lp else " ", lp)
    rp = SPACES.sub("~" if "\n" in rp else " ", rp)
    f = ["bias", "form=" + form, "lw=" + lw, "lp=" + lp, "rp=" + rp, "rw=" + rw, "l=" + lw + lp, "r=" + rp + rw]
    if kind == "person_name":
        given, sur = name_parts(text, c)
        low = sur.lower()
        known = any(p in (lex.lower if form.startswith("lower") else lex.given) for p in given.split("-"))
        f += [f"known={known}", "s3=" + low[-3:], "s4=" + low[-4:], f"common={low in lex.common}", f"first_common={given.lower() in lex.common}", f"{form},{known},{low in lex.common}"]
        f.append(f"fixed={text[a:b].lower() in lex.fixed}")
        before = NAME_BEFORE.search(text[max(0, a - 24) : a])
        if before:  # a name that goes on to the left was cut
            f.append(f"cut={before.group(1) in lex.given}")
        mail = text[b : b + 60].lower()
        f.append(f"mail={low[:5] in mail}")
    elif kind == "email":
        s = text[a:b]
        at = AT.search(s)
        local, domain = s[: at.start()], s[at.end() :]
        f += [f"digit={domain[:1].isdigit()}", f"dots={min(2, len(DOTS.findall(domain)))}", "local=" + (local if local in ("git", "user", "hg", "svn") else ""), f"path={text[b : b + 1] == ':' and text[b + 1 : b + 2].isalnum()}"]
    elif kind in ("phone", "id_number"):
        s = text[a:b]
        mask = CAPITAL.sub("A", DIGIT.sub("9", s)).replace("\xa0", " ")
        f += ["mask=" + mask, "groups=" + ",".join(str(len(x)) for x in DIGITS.findall(s)), "head=" + mask[:2], "seps=" + FIGURE.sub("", mask)[:4], f"digits={sum(x.isdigit() for x in s)}"]
        before, after = text[max(0, a - 2) : a], text[b : b + 2]
        f += [f"cut_left={before[-1:] in (' ', chr(160)) and before[:1].isdigit()}", f"cut_right={after[:1] in (' ', chr(160)) and after[1:2].isdigit()}", f"touch={before[-1:]}"]
    else:
        f += [f"n={len(DIGITS.search(text, a, b).group())}"]
    return tuple(f"{kind}:{x}" for x in f)


NEAR = 4  # spans with at most so many characters between them are linked


def clusters(cands: list[Candidate], near: int = NEAR) -> Iterator[list[Candidate]]:
    """Neighbourhoods: candidates that overlap or nearly touch."""
    group: list[Candidate] = []
    end = -1
    for c in cands:
        if group and c[0] > end + near:
            yield group
            group = []
        group.append(c)
        end = max(end, c[1]) if len(group) > 1 else c[1]
    if group:
        yield group


def link(text: str, a: Candidate, b: Candidate) -> str:
    return f"{a[2]}>{b[2]}" if b[0] - a[1] <= NEAR else ""


class Field:
    """Weights of the field; scores of equal feature sets are remembered."""

    def __init__(self, weights: dict[str, float], lex: Lexicon, room: int = 200_000):
        self.w, self.lex, self.known, self.room = weights, lex, {}, room

    def score(self, f: tuple[str, ...]) -> float:
        s = self.known.get(f)
        if s is None:
            if len(self.known) > self.room:
                self.known.clear()
            get = self.w.get
            s = self.known[f] = sum(get(x, 0.0) for x in f)
        return s

    def decode(self, text: str) -> list[Candidate]:
        """The best set of spans of a text, by dynamic programming within each neighbourhood."""
        found: list[Candidate] = []
        for group in clusters(candidates(text, self.lex)):
            n = len(group)
            scores = [self.score(features(text, c, self.lex)) for c in group]
            if n == 1:
                if scores[0] > 0:
                    found.append(group[0])
                continue
            best, back = [0.0] * n, [-1] * n
            by_end = sorted(range(n), key=lambda k: group[k][1])
            passed, top, at = 0, 0.0, -1  # the best of the spans that end too far before c to be linked with it
            for j, c in enumerate(group):
                while passed < n and group[by_end[passed]][1] < c[0] - NEAR:
                    i = by_end[passed]
                    if best[i] > top:
                        top, at = best[i], i
                    passed += 1
                most, pick, q = top, at, passed
                while q < n and group[by_end[q]][1] <= c[0]:
                    i = by_end[q]
                    v = best[i] + self.w.get(link(text, group[i], c), 0.0)
                    if v > most:
                        most, pick = v, i
                    q += 1
                best[j], back[j] = most + scores[j], pick
            j = max(range(n), key=best.__getitem__)
            if best[j] <= 0:
                continue
            while j >= 0:
                found.append(group[j])
                j = back[j]
        return sorted(found)


# ---- labelling rules: what is certain enough to learn from
# Plain words of several languages that announce or deny an entity; what else tells one is for the field to learn.
PHONE_CUE = re.compile(r"(?i)(?:\btel|\btél|phone|mobile|\bcell|\bfax|telefon|teléfono|telefone|\bmobil|\bcall|\bdial|電話|電話番号)\w*[ .:=]*\s*$")
CODE_DENIED = re.compile(r"(?i)(?:\bticket|\bissue|\btrace|\bseed|\brange|\bbuild|\brows?|\bversion|\btimestamp|\bid|\bcommit|\bjob|\bspan|\bisbn|\b[a-z]{2,5}-|\bv)[ -]*$")
ID_CUE = re.compile(
    r"(?i)(?:ssn|social security(?: no\.?| number)?|passport|driver licen[cs]e|national insurance number|steuer-id|sozialversicherungsnummer|\bdni|\bnif|\bnie|\bcpf|sécurité sociale|マイナンバー|reisepass|pasaporte|passeport|personalausweis)(?: n[°ºr]\.?| no\.?)?\W{0,4}$"
)
# Formats that are public: numbers with a country or trunk prefix; of Spain, Brazil and the United States; of hosts.
PHONE_FORM = re.compile(r"\+\d[\d \xa0().-]{7,18}|0\d{1,4}[-./ ]\d[\d -]{5,9}")
ID_FORM = re.compile(r"\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3}-\d{2}-\d{4}")
IPV4 = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
NAME_CUE = re.compile(
    r"(?i)(?:thanks to|reviewed-by:|signed-off-by:|co-authored-by:|talked to|according to|assigned to|reported by|maintainer:|owner:|@author|attendees:|contact:|cc|merci à|danke an|gracias a|obrigado a|signalé par|enviado por|from: \"?|reporter\": \"|報告者)\s*$"
)
NO_ADDRESS = re.compile(r"(?i)\b(?:step|section|chapter|figure|table|version|ticket|issue|build|release|line|page)[ #]*$")


def verdict(text: str, c: Candidate, lex: Lexicon) -> int:
    """1 an entity, -1 none, 0 not certain."""
    a, b, kind, form = c
    left, right = text[max(0, a - 40) : a], text[b : b + 40]
    if kind == "email":
        s = text[a:b]
        at = AT.search(s)
        domain, local = s[at.end() :], s[: at.start()]
        ok = len(re.findall(DOT, domain)) >= 1 and not domain[:1].isdigit() and local not in ("git", "user", "hg", "svn") and not (right[:1] == ":" and right[1:2].isalnum())
        return 1 if ok else -1
    if kind in ("phone", "id_number"):
        inner_right = right[:1] in (" ", "\xa0") and (right[1:2].isdigit() or re.match(r"[ \xa0][A-Z]\b" if kind == "id_number" and text[a].isalpha() else r"[ \xa0][A-Z]\b(?! [a-zà-ÿ])", right) is not None)
        phone, number = PHONE_CUE.search(left), ID_CUE.search(left)
        if not inner_right and (phone if kind == "phone" else number):
            return 1
        if CODE_DENIED.search(left) or number or phone or IPV4.fullmatch(text, a, b):
            return -1
        inner_left = left[-1:] in (" ", "\xa0") and left[-2:-1].isdigit()
        return int(not inner_left and not inner_right and (PHONE_FORM if kind == "phone" else ID_FORM).fullmatch(text, a, b) is not None)
    if kind == "street_address":
        if NO_ADDRESS.search(left):
            return -1
        named = [w.lower() for w in re.findall(PROPER, text[a:b])]
        return 0 if named and all(w in lex.common for w in named) else 1
    if text[a:b].lower() in lex.fixed:
        return -1
    given, sur = name_parts(text, c)
    names = lex.lower if form.startswith("lower") else lex.given
    known = any(p in names for p in given.split("-"))
    common = sur.lower() in lex.common
    if form == "surname_first":
        return 1 if known and not common else 0
    if common:
        return -1
    if known:
        return 1
    if form == "initial":
        return 1 if NAME_CUE.search(left) else 0
    if form == "lower_initial":
        return 1 if NAME_CUE.search(left) else -1
    if NAME_CUE.search(left):
        return 1
    return 0 if given.lower() not in lex.common else -1


#: Invented sentences that the labelling rules decide; they keep a small sample from leaving gaps.
EXAMPLES = [
    "Mail it to ann.bell@host.example, please.", "Reach me at bob AT host DOT example if it breaks.", "write to cid [at] mail [dot] host [dot] example", "Clone git@host.example:team/repo.git first. Install tool@1.2.3 now.", "Use `user@host` style remotes.",
    "Call +44 20 7946 0123 for access.", "phone: (212) 555-0123", "Tel. 030/23125-777", "mobile=212.555.0199&lang=en", "Tél. : 01 99 00 12 34", "Teléfono: +34 600 000 123", "電話 03-0000-1234", "Range 1234-567 8901 maps to lines.", "Build 1234-567-8901 failed.", "version 1234.567.8901 of it",
    "SSN: 912-34-5678", "passport: X12345678", "DNI 12345678Z", "CPF 123.456.789-00", "Rows 555-01-2345 of the sample were dropped.", "Timestamp 1700000000000000 is in microseconds", "Ticket QX-1234567 supersedes 1234567", "commit 1234567 is fine",
    "Ship it to 12 Maple Street, second floor.", "Anschrift: Lindenweg 12", "Adresse : 12 rue des Lilas", "Calle Mayor 12", "Reviewed-by: Alice Bellweather", "Thanks to Peter Stonecroft for the review.", "cc J. Stonecroft", "Grace Period is a feature flag", "STONECROFT, Alice asked",
]


MOST_WORDS = 500_000  # entries of a list that all workers share


def tally(text: str, lex: Lexicon, words: Counter[str], named: Counter[tuple[str, str, str]]) -> None:
    """Count the tokens of a text, its pairs of given name and surname, and the given names that a cue announces."""
    words.update(TOKEN.findall(text))
    for c in (*runs(text), *lower_names(text, lex)):
        if c[3] in ("given", "lower"):
            g, s = name_parts(text, c)
            named["pair", g.lower(), s.lower()] += 1
            if c[3] == "given" and NAME_CUE.search(text[max(0, c[0] - 40) : c[0]]):
                named["cued", g, s.lower()] += 1


def counted(documents: DataFrame, given: list[str]) -> DataFrame:
    """(kind, a, b, n): the counts of ``tally`` over all different texts, and their number."""
    spark = documents.sparkSession
    texts = documents.where("text IS NOT NULL").select("text").unionByName(spark.createDataFrame([(t,) for t in EXAMPLES], "text string")).distinct()
    shared = spark.sparkContext.broadcast(Lexicon(given, set()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, texts = shared.value, 0
        words: Counter[str] = Counter()
        named: Counter[tuple[str, str, str]] = Counter()

        def emit() -> pa.RecordBatch:
            rows = [("word", w, "", n) for w, n in words.items() if len(w) > 2 and w.islower()] + [(*k, n) for k, n in named.items()] + [("text", "", "", texts)]
            words.clear()
            named.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["kind", "a", "b", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                tally(t, lex, words, named)
                texts += 1
                if len(words) + len(named) > 300_000:
                    yield emit()
                    texts = 0
        yield emit()

    return texts.mapInArrow(run, "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def listed(rows: DataFrame) -> list:
    """The rows of a list that is small by its thresholds; one that is not is refused, never cut."""
    out = rows.limit(MOST_WORDS + 1).collect()
    if len(out) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} entries in a shared list")
    return out


def lexicon(documents: DataFrame, given: list[str], per: int = SAMPLE) -> Lexicon:
    """Common words, fixed phrases and given names that the table lacks, from all texts.

    Thresholds are numbers per ``per`` texts, so that a corpus of any size has the same lists but for less chance; that of
    fixed phrases grows with the root only, as more texts tell them better from names, and a rare given name is also taken
    if a cue announces a tenth of its places.
    """
    counts = cut(counted(documents, given))
    scale = max(1.0, (counts.where("kind = 'text'").agg(F.sum("n")).collect()[0][0] or 0) / per)
    common = counts.where("kind = 'word'").where(F.col("n") >= int(8 * scale)).select("a")
    pairs, cued = counts.where("kind = 'pair'"), counts.where("kind = 'cued'")
    # A name meets many partners, a fixed phrase of two capitalised words always the same one.
    phrase = pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("top"), F.sum("n").alias("total")).where((F.col("top.n") >= int(5 * scale**0.5)) & (F.col("total") - F.col("top.n") < int(scale)))
    # Given names that the table lacks: first words in telling places, before several surnames.
    free = pairs.join(phrase.select("b"), "b", "left_anti").groupBy("a").agg(F.count(F.lit(1)).alias("partners"))
    places = pairs.groupBy("a").agg(F.sum("n").alias("places"))
    told = cued.join(common.select(F.col("a").alias("b")), "b", "left_anti").groupBy(F.col("a").alias("g")).agg(F.sum("n").alias("n")).where("n >= 2").withColumn("a", F.lower("g"))
    new = told.join(free, "a").join(places, "a").where("partners >= 2").where((F.col("n") >= int(2 * scale)) | (F.col("n") >= 0.1 * F.col("places")))
    names = sorted({p for r in listed(new.select("g")) for p in r[0].split("-")})
    return Lexicon([*given, *names], {r[0] for r in listed(common)}, {f"{r[0]} {r[1]}" for r in listed(phrase.select("top.a", "b"))})


def sample_lexicon(texts: list[str], given: list[str]) -> Lexicon:
    """The same lists from texts in memory."""
    words: Counter[str] = Counter()
    named: Counter[tuple[str, str, str]] = Counter()
    plain = Lexicon(given, set())
    for t in texts:
        words.update(TOKEN.findall(t))
    for t in dict.fromkeys(texts):
        tally(t, plain, Counter(), named)
    common = {w for w, n in words.items() if n >= 8 and len(w) > 2 and w.islower()}
    partners: dict[tuple[int, str], set[str]] = defaultdict(set)
    told: Counter[str] = Counter()
    for (kind, g, s), n in named.items():
        if kind == "pair":
            partners[0, g].add(s)
            partners[1, s].add(g)
        elif s not in common:
            told[g] += n
    fixed = {f"{g} {s}" for (kind, g, s), n in named.items() if kind == "pair" and n >= 5 and len(partners[1, s]) == 1}
    new = [p for g, n in told.items() if n >= 2 and len(partners[0, g.lower()] - {x.split(" ")[1] for x in fixed}) >= 2 for p in g.split("-")]
    return Lexicon([*given, *new], common, fixed)


def fit(texts: list[str], given: list[str], lex: Lexicon | None = None) -> Field:
    """Fit the field on the certain neighbourhoods of the texts by conditional likelihood (AdaGrad).

    ``lex`` has the word lists of the whole corpus; without it they come from the texts.
    """
    texts = [*texts, *EXAMPLES]
    lex = lex or sample_lexicon(texts, given)
    texts = list(dict.fromkeys(texts))
    spans = [candidates(t, lex) for t in texts]
    problems: Counter = Counter()
    for t, found in zip(texts, spans, strict=True):
        for group in clusters(found):
            if len(group) > 40:
                continue
            v = [verdict(t, c, lex) for c in group]
            gold: list[int] = []
            for k in sorted((k for k in range(len(group)) if v[k] == 1), key=lambda k: group[k][0] - group[k][1]):
                if all(group[k][1] <= group[g][0] or group[k][0] >= group[g][1] for g in gold):
                    gold.append(k)
            if any(v[k] == 0 and all(group[k][1] <= group[g][0] or group[k][0] >= group[g][1] for g in gold) for k in range(len(group))):
                continue
            before = tuple(tuple(i for i in range(j) if group[i][1] <= group[j][0]) for j in range(len(group)))
            links = tuple(tuple(link(t, group[i], group[j]) for i in before[j]) for j in range(len(group)))
            problems[tuple(features(t, c, lex) for c in group), before, links, tuple(sorted(gold))] += 1
    return Field(likelihood(problems), lex)


def likelihood(problems: Counter) -> dict[str, float]:
    """Weights by AdaGrad on the conditional log-likelihood with a quadratic penalty; equal problems are taken together."""
    w: dict[str, float] = defaultdict(float)
    g2: dict[str, float] = defaultdict(lambda: 1e-6)
    order = sorted(problems.items(), key=repr)
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(order)):
            (feats, before, links, gold), times = order[k]
            n = len(feats)
            scores = [sum(w[x] for x in f) for f in feats]
            # forward: log-sum over all sets of spans that end with j
            alpha = [0.0] * n
            for j in range(n):
                terms = [0.0, *(alpha[i] + (w[x] if x else 0.0) for i, x in zip(before[j], links[j], strict=True))]
                m = max(terms)
                alpha[j] = scores[j] + m + math.log(sum(math.exp(t - m) for t in terms))
            m = max(0.0, *alpha)
            total = m + math.log(math.exp(-m) + sum(math.exp(a - m) for a in alpha))
            # backward: log-sum over continuations after j
            beta = [0.0] * n
            for i in range(n - 1, -1, -1):
                terms = [0.0]
                for j in range(i + 1, n):
                    if i in before[j]:
                        x = links[j][before[j].index(i)]
                        terms.append(scores[j] + (w[x] if x else 0.0) + beta[j])
                m = max(terms)
                beta[i] = m + math.log(sum(math.exp(t - m) for t in terms))
            grad: dict[str, float] = defaultdict(float)
            chosen = set(gold)
            for j in range(n):
                d = (j in chosen) - math.exp(alpha[j] + beta[j] - total)
                if abs(d) > 1e-4:
                    for x in feats[j]:
                        grad[x] += d
                for i, x in zip(before[j], links[j], strict=True):
                    if x:
                        p = math.exp(alpha[i] + w[x] + scores[j] + beta[j] - total)
                        follows = j in chosen and i in chosen and not any(i < q < j for q in chosen)
                        grad[x] += follows - p
            rate = 0.5 * min(3.0, 1 + math.log(times))
            for x, d in grad.items():
                d -= 1e-3 * w[x]
                g2[x] += d * d
                w[x] += rate * d / math.sqrt(g2[x])
    return {x: v for x, v in w.items() if abs(v) > 1e-3}


def train(documents: DataFrame, given_names: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` texts chosen by hash (a bounded driver-side sample, used for nothing but the weights; the word lists come from all texts)."""
    rows = bounded(documents, "text IS NOT NULL AND length(text) BETWEEN 20 AND 6000", F.concat_ws("|", "doc_id", "text"), [F.col("text")], sample)
    names = sorted(r[0] for r in listed(given_names.where("given_name IS NOT NULL").select("given_name").distinct()))
    return fit([r[0] for r in rows], names, lexicon(documents, names))


def judged(documents: DataFrame, field: Field, with_text: bool = False) -> DataFrame:
    """(doc_id, entities array<struct<start, kind, found_text>>[, redacted]) of every text."""
    # Weights bounded by the sample, word lists by their thresholds and MOST_WORDS.
    shared = documents.sparkSession.sparkContext.broadcast((field.w, field.lex))
    kind = dict(documents.dtypes)["doc_id"]
    entity = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("found_text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [model.decode(t) for t in texts]
            columns = [batch.column("doc_id"), pa.array([[{"start": a, "kind": k, "found_text": t[a:b]} for a, b, k, _ in f] for t, f in zip(texts, found, strict=True)], entity)]
            if with_text:
                columns.append(pa.array([redact(t, f) if raw is not None else None for t, f, raw in zip(texts, found, batch.column("text").to_pylist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "entities", *["redacted"] * with_text])

    schema = f"doc_id {kind}, entities array<struct<start int, kind string, found_text string>>" + ", redacted string" * with_text
    return spread(documents.select("doc_id", "text")).mapInArrow(run, schema)


def redact(text: str, found: list[Candidate]) -> str:
    """The text with typed placeholders in place of the spans and otherwise unchanged."""
    out, at = [], 0
    for a, b, kind, _ in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def found(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, kind, found_text)."""
    return (
        judged(documents, train(documents, given_names))
        .select("doc_id", F.explode("entities").alias("e"))
        .select("doc_id", "e.kind", "e.found_text")
        .distinct()
    )


def redacted(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, redacted, n_entities)."""
    return judged(documents, train(documents, given_names), True).select("doc_id", "redacted", F.size("entities").alias("n_entities"))
