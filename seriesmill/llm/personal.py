"""Personal data with offset-preserving deobfuscation.

Plain identifiers (e-mail, IPv4, card, phone) are found in the text as it stands. Then small transducers rewrite disguises and
keep, for each character they put out, the source characters it stands for: homoglyphs and full-width or foreign digits become ASCII,
invisible characters go, spelled digits become digits, "at" and "dot" in their disguises become @ and a full stop. What
the detectors find in the rewritten text is mapped back to source characters, and joins the base spans where it meets
none of its kind. Two stricter forms also recover a phone or card that stands next to other digits.

Defined cases: null text is empty; an empty text has no spans; rows are independent, so ties, repeated rows and empty
tables need no rule; columns besides doc_id and text are ignored. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive repeats and the look-behind only spare retries: a match begins at the start of its run of digits
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")
#: Forms strict enough to stand next to other digits.
_ONE_PHONE = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])")
_ONE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}|[0-9]{14,19})(?![0-9])")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    even = sum(map(int, digits[-1::-2]))
    return (even + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _is_card(text: str) -> bool:
    digits = _NO_DIGITS.sub("", text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 10 <= len(_NO_DIGITS.sub("", text)) <= 15


def plain(text: str) -> list[Span]:
    """The base spans: leftmost, non-overlapping within a kind; failing matches are dropped without another try."""
    found: list[Span] = []
    over, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            over = m.end()
            found.append(("email", start, over))
        at = text.find("@", max(over, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and _is_card(m.group()):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if _is_phone(m.group())]
    return found


#: Letters that look like ASCII ones, in pairs: fixed values.
_LOOKALIKES = "аa еe оo рp сc уy хx іi јj ѕs кk мm тt нh вb АA ЕE ОO РP СC УY ХX ІI ЈJ ЅS КK МM ТT НH ВB οo αa ρp νv ιi κk υu χx ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ıi ɡg"
_GLYPHS = {p[0]: p[1] for p in _LOOKALIKES.split()} | {chr(c + 0xFEE0): chr(c) for c in range(33, 127)}
_INVISIBLE = "­​‌‍⁠﻿"
_ODD = re.compile(f"[{_INVISIBLE}{''.join(map(re.escape, _GLYPHS))}]|(?![0-9])\\d")
_DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0", "plus": "+"}
_DIGIT = "(?:zero|one|two|three|four|five|six|seven|eight|nine|oh)"
_SPELLED = re.compile(rf"\b(?:plus[\x20-]{{1,2}})?{_DIGIT}(?:[\x20,.-]{{1,2}}{_DIGIT}){{6,}}\b", re.IGNORECASE)
_AT = r"(?:\x20?[\[({<]\x20?(?:at|@|arroba|arobase)\x20?[\])}>]\x20?)"
_BOXED_DOT = r"\x20?[\[({<]\x20?(?:dot|\.|punto|punkt|point)\x20?[\])}>]\x20?"
_DOT = rf"(?:{_BOXED_DOT}|\x20(?:dot|punto|punkt)\x20)"
_OCTET = rf"(?:[0-9]++|\b{_DIGIT}(?:[\x20-]{_DIGIT}){{0,2}}\b)"
_OCTETS = re.compile(rf"(?<![0-9]){_OCTET}(?:(?:\.|{_DOT}){_OCTET}){{3}}", re.IGNORECASE)
_OCTET_PART = re.compile(rf"({_DOT})|(\.)|([0-9]+)|[A-Za-z]+", re.IGNORECASE)
_BETWEEN_DIGITS = re.compile(rf"(?<=[0-9]){_BOXED_DOT}(?=[0-9])", re.IGNORECASE)
_LABEL = "[A-Za-z0-9-]+"
#: Ends of a domain that bare words may spell: fixed values.
_ENDS = "(?:com|org|net|edu|gov|info|biz|io|co|dev|app|ai|eu|uk|us|de|fr|es|it|nl|ch|at|se|no|fi|pl|ru|cn|jp|in|br|au|ca|test|example)(?![A-Za-z0-9-])"
# a bare "at" counts only before a domain whose dots are spelled as well and that ends as domains do, a plain @ also before
# one with a bracketed dot; a bracketed one before any domain
_SIGN = re.compile(rf"({_AT})|(@)|\x20(?:at|arroba|arobase)(?=\x20)", re.IGNORECASE)
_ANY_DOMAIN = re.compile(rf"{_LABEL}(?:(?:\.|{_DOT}){_LABEL})+", re.IGNORECASE)
_BOXED_DOMAIN = re.compile(rf"{_LABEL}(?:\.{_LABEL})*(?:{_BOXED_DOT}{_LABEL}(?:\.{_LABEL})*)+", re.IGNORECASE)
_SPELLED_DOMAIN = re.compile(rf"{_LABEL}(?:(?:\.|{_DOT}){_LABEL})*{_DOT}{_ENDS}(?:(?:\.|{_DOT}){_ENDS})*", re.IGNORECASE)
_SOME_DOT = re.compile(_DOT, re.IGNORECASE)
_PART = re.compile(rf"({_AT}|\x20(?:at|arroba|arobase)\x20)|({_DOT})", re.IGNORECASE)
_WORD = re.compile("[A-Za-z]+")
_TRIGGER = re.compile(r"[\[({< ](?:at|@|arroba|arobase|dot|\.|punto|punkt|point)[\])}> ]|(?:zero|one|two|three|four|five|six|seven|eight|nine|oh)[\x20,.-]", re.IGNORECASE)


class Tape:
    """Text with, for each character, the source range it stands for."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None, changed: list[bool] | None = None):
        n = len(text)
        self.text = text
        self.start = list(range(n)) if start is None else start
        self.end = list(range(1, n + 1)) if end is None else end
        self.changed = [False] * n if changed is None else changed

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Edits (start, end, replacement) in order, none overlapping; each replacement stands for the whole range."""
        parts, start, end, changed, done = [], [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[done:a], new]
            start += self.start[done:a] + [self.start[a]] * len(new)
            end += self.end[done:a] + [self.end[b - 1]] * len(new)
            changed += self.changed[done:a] + [True] * len(new)
            done = b
        return Tape("".join([*parts, self.text[done:]]), start + self.start[done:], end + self.end[done:], changed + self.changed[done:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def glyph_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "" if m.group() in _INVISIBLE else _GLYPHS.get(m.group()) or str(unicodedata.digit(m.group()))) for m in _ODD.finditer(text)]


def digit_edits(text: str) -> list[tuple[int, int, str]]:
    """Each digit word of a spelled number, with the separator before it."""
    edits = []
    for m in _SPELLED.finditer(text):
        done = m.start()
        for w in _WORD.finditer(text, m.start(), m.end()):
            edits.append((done, w.end(), _DIGITS[w.group().lower()]))
            done = w.end()
    return edits


def octet_edits(text: str) -> list[tuple[int, int, str]]:
    """Dots and digit words of four octets, with the separators inside an octet."""
    edits = []
    for m in _OCTETS.finditer(text):
        own, spelled, done, dots = [], "", None, 0
        for p in _OCTET_PART.finditer(text, m.start(), m.end()):
            if p.group(1) or p.group(2):
                new, done = ".", None
                dots += p.group(2) is not None
            elif p.group(3):
                new = p.group()
            else:
                new = _DIGITS[p.group().lower()]
            if new != p.group():
                own.append((p.start() if done is None else done, p.end(), new))
            if new != "." and not p.group(3):
                done = p.end()
            spelled += new
        # ten or more spelled digits with plain dots alone are a telephone number's form
        if all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in spelled.split(".")) and (dots < 3 or len(spelled) < 13):
            edits += own
    return edits


def dot_edits(text: str) -> list[tuple[int, int, str]]:
    """Bracketed dots between digits."""
    return [(m.start(), m.end(), ".") for m in _BETWEEN_DIGITS.finditer(text)]


_LABEL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
#: Characters of the longest spelled dot.
_DOT_SIZE = 11


def name_before(text: str, end: int, least: int) -> int:
    """Where a name that ends at ``end`` begins, not before ``least``; ``end`` if there is none. Read backwards, part by part."""
    start = at = end
    starts = []
    while True:
        while at > least and text[at - 1] in _LABEL_CHARACTERS:
            at -= 1
        if at == start:
            break
        start = at
        starts.append(start)
        if at > least and text[at - 1] == ".":
            at -= 1
        else:
            near = max(least, at - _DOT_SIZE)
            dot = next((k for k in range(near, at) if _SOME_DOT.fullmatch(text, k, at)), at)
            if dot == at:
                break
            at = dot
        start = at
    # the name may not go on to the left of its beginning
    return next((s for s in reversed(starts) if not s or text[s - 1] not in _LABEL_CHARACTERS and text[s - 1] != "."), end)


def sign_edits(text: str) -> list[tuple[int, int, str]]:
    """Signs and dots of disguised addresses. Each sign is looked at from both sides, so a text is read a fixed number of times
    however many dots it spells."""
    edits, over = [], 0
    for m in _SIGN.finditer(text):
        boxed, plain_ = m.group(1), m.group(2)
        tests = (_ANY_DOMAIN,) if boxed else (_BOXED_DOMAIN, _SPELLED_DOMAIN) if plain_ else (_SPELLED_DOMAIN,)
        start = name_before(text, m.start(), over)
        if start == m.start():
            continue
        after = m.end() + (not boxed and not plain_)  # a bare sign's space behind it
        domain = next((d for t in tests if (d := t.match(text, after))), None)
        if domain:
            edits += [(p.start(), p.end(), "@" if p.group(1) else ".") for p in _PART.finditer(text, start, domain.end())]
            over = domain.end()
    return edits


def disguised(text: str) -> list[Span]:
    """Spans that only the rewritten text shows."""
    odd = not text.isascii() and _ODD.search(text)
    if not odd and not _TRIGGER.search(text):
        return []
    tape = Tape(text)
    for edits_of in (glyph_edits, octet_edits, digit_edits, dot_edits, sign_edits):
        if edits := edits_of(tape.text):
            tape = tape.rewrite(edits)
    if tape.text == text:
        return []
    found = plain(tape.text) + adjacent(tape.text)
    for m in re.finditer(r"(?<![0-9+])[0-9]{10,15}(?![0-9])", tape.text):  # a spelled number without a plus
        if all(tape.changed[m.start() : m.end()]):
            found.append(("phone", m.start(), m.end()))
    return [(k, *tape.source(a, b)) for k, a, b in found if any(tape.changed[a:b])]


def adjacent(text: str) -> list[Span]:
    found = [("phone", m.start(), m.end()) for m in _ONE_PHONE.finditer(text) if _is_phone(m.group())] if "+" in text else []
    return found + [("card", m.start(), m.end()) for m in _ONE_CARD.finditer(text) if _is_card(m.group())]


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start, then kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = plain(text)
    every, more = list(base), sorted(adjacent(text) + disguised(text), key=order)
    for kind in KINDS:
        # base spans of a kind don't overlap each other, and an added one comes after those added before it
        own = sorted((a, b) for k, a, b in base if k == kind)
        starts, over = [a for a, _ in own], -1
        for k, a, b in more:
            at = bisect_right(starts, a)
            if k == kind and a >= over and not (at and own[at - 1][1] > a) and not (at < len(own) and own[at][0] < b):
                every.append((kind, a, b))
                over = b
    return sorted(base, key=order), sorted(every, key=order)


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def make() -> Callable[[str], tuple]:
        def one(text: str) -> tuple:
            base, every = spans(text)
            return (*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every))

        return one

    return map_texts(docs, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
