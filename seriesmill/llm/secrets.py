"""Secret scans with one combined automaton.

All rules' expressions are compiled together, by subset construction and minimisation, into one transition array that
reads each byte of a text once. Where it says that a rule's match ends, that rule's own two small automata find the
leftmost start (backwards, not before the rule's last match) and the longest end. Matches are leftmost,
longest and don't overlap within a kind; then a rule's own test may drop a match (its text stays consumed).

Defined cases: null text is empty; an empty text has no spans; rows are independent, so ties, repeated rows and
empty tables need no rule; columns besides doc_id and text are ignored by ``find``. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Dfa
from .common import map_texts, tidy


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: What the matched bytes must hold, or else the match is dropped.
    keep: str = ""


_NAMES = "|".join(map(any_case, ("password", "passwd", "secret", "token"))) + "|" + any_case("api") + "_?" + any_case("key")
#: Base kinds first, in the order in which equal starts are listed. Least lengths are tests on the match, as counted
#: repeats of several rules would multiply the states of the joint automaton; only hex, whose letters are everywhere in
#: prose, carries its own (a shorter run can't hold a longer match, so nothing else changes).
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""),
    Rule("access", r"AKIA[A-Z0-9]+", r"^.{20,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"^.{30,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", r"^.{24,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", r"^.{18,}"),
    Rule("keyblock", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """All rules at once: ``spans(text)`` -> [(kind index, start, end)] in code points, by start, then kind."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Dfa([r.pattern for r in rules], search=True)
        self.ahead = [Dfa([r.pattern]) for r in rules]
        self.back = [Dfa([r.pattern], backwards=True) for r in rules]
        self.keep = [re.compile(r.keep.encode()) if r.keep else None for r in rules]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        data = text.encode("utf-8")
        dfa = self.all
        step, first_hit, state = dfa.step, dfa.first_hit, dfa.start
        over = [0] * len(self.rules)
        found = []
        for at, c in enumerate(data.translate(dfa.classes)):
            state = step[state + c]
            if state >= first_hit:
                for k in dfa.hits[state // dfa.width]:
                    if at >= over[k]:
                        start = self.back[k].longest(data, at + 1, -1, over[k])
                        if start is None:  # that match began inside the last one
                            continue
                        end = self.ahead[k].longest(data, start)
                        over[k] = end
                        if self.keep[k] is None or self.keep[k].search(data[start:end]):
                            found.append((k, start, end))
        if found and len(data) != len(text):
            # code points before each byte that a span begins or ends at, in one walk
            place, done, n = {}, 0, 0
            for p in sorted({p for _, a, b in found for p in (a, b)}):
                n += len(data[done:p].decode("utf-8"))
                done, place[p] = p, n
            found = [(k, place[a], place[b]) for k, a, b in found]
        return sorted(found, key=lambda x: (x[1], x[0]))


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once on the driver; tasks get the finished arrays."""
    return Scanner(rules)


def written(spans, kinds) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_<base kind>..., base_sha256, spans."""
    kinds, scanner = [r.kind for r in rules], compiled(rules)

    def make() -> Callable[[str], tuple]:
        def one(text: str) -> tuple:
            spans = scanner.spans(text)
            own = [s for s in spans if kinds[s[0]] in base]
            digest = hashlib.sha256(written(own, kinds).encode()).hexdigest()
            return (*(sum(kinds[k] == b for k, _, _ in own) for b in base), digest, written(spans, kinds))

        return one

    return map_texts(docs, make, ", ".join(f"n_{b} long" for b in base) + ", base_sha256 string, spans string")


def mask(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret's characters replaced by ``*``: the same columns, the same length of text. Null text stays."""
    scanner, at = compiled(rules), f"c{docs.columns.index('text')}"
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # mapInPandas finds no names with dots

    def run(batches):
        def one(text):
            if text is None or not (spans := scanner.spans(text)):
                return text
            out, done = [], 0
            for _, a, b in spans:
                if b > done:
                    out += [text[done : max(a, done)], "*" * (b - max(a, done))]
                    done = b
            return "".join(out) + text[done:]

        for batch in batches:
            yield batch.assign(**{at: [one(t) for t in batch[at]]})
        tidy()

    return plain.mapInPandas(run, plain.schema).toDF(*docs.columns)
