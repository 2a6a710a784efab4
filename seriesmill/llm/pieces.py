"""Cutting whole texts into the parts that a byte-level BPE encodes one by one, with a memory of parts met before.

The expression's matches never join the two sides of a single space that has a non-space on both sides, other than
that the space opens the right side's first piece. So a text without other white space next to a space falls apart at its
spaces, and each distinct part (with its space) is encoded once; any other text is encoded as a whole. A line end between
non-spaces is a piece of its own, so texts whose line ends are all like that fall apart there too. Letters with one
of a few marks behind them are the letters' piece and the mark's. Arrow cuts and numbers the parts of many texts at once,
numpy puts the ids of all of them together, and only parts not met before are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Arrow's expressions of texts that don't fall apart at their spaces, or not at their line ends. Unicode white space is as the
#: encoders' own engines understand \\s.
_UNCUT = r"^ | $|  |[\t\n\x0b\f\r] | [\t\n\x0b\f\r]|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNLINED = r"^\n|\n$|\n\n|[\t\x0b\f\r]"
_LETTERS, _MARKED = r"^\pL+$", r"^\pL+[.,;:!?]$"
#: Characters of texts that go through together.
CHUNK = 8 << 20


def exact(pattern: str) -> str:
    """``pattern`` with \\s and \\S spelled out: Python counts four control characters as white space, Unicode doesn't."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def _is(strings: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(strings, pattern).to_numpy(zero_copy_only=False).astype(bool)


def _list(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


class PartMemory:
    """encode_all(texts): the ids of each text, as unsigned 32-bit numbers. ``encode_parts(strings, letters)`` gives the ids of
    strings, each taken for itself; ``letters``: they are letters alone, with or without a space in front. Texts that hold one
    of ``uncut`` stay whole. The memory starts afresh before a chunk of texts once its strings and ids hold more than ``most``
    bytes."""

    #: What a remembered string takes besides its own bytes.
    OVERHEAD = 150

    def __init__(self, encode_parts: Callable[[list[str], bool], list[list[int]]], most: int, uncut: tuple[str, ...] = ()):
        self.encode_parts, self.most, self.uncut = encode_parts, most, uncut
        self.clear()

    def clear(self) -> None:
        #: Places of strings that open a text, and of those behind a space (kept without it) or that begin with a line end.
        self.opening: dict[str, int] = {}
        self.inner: dict[str, int] = {}
        self.held = self.used = 0
        #: Where each place's ids begin in the pool, how many there are, and the pool itself, all growing. Place 0 is empty.
        self.places, self.begin, self.size, self.pool = 1, np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def _add(self, found: list[list[int]]) -> range:
        n, sizes = len(found), np.fromiter(map(len, found), np.int64, len(found))
        ends = self.used + np.cumsum(sizes)
        at, last = self.places, int(ends[-1]) if n else self.used
        for name, need in (("begin", at + n), ("size", at + n), ("pool", last)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need, 2 * len(held)) - len(held), held.dtype)]))
        self.begin[at : at + n], self.size[at : at + n] = ends - sizes, sizes
        self.pool[self.used : last] = np.fromiter(chain.from_iterable(found), np.uint32, last - self.used)
        self.places, self.used = at + n, last
        return range(at, at + n)

    def _learn(self, known: dict[str, int], strings: pa.Array, space: str) -> np.ndarray:
        """The places of distinct strings, learnt where they are new."""
        own = _list(strings)
        place = np.fromiter((known.get(x, -1) for x in own), np.int64, len(own))
        fresh, letters = place < 0, _is(strings, _LETTERS)
        for some, plain in ((fresh & letters, True), (fresh & ~letters, False)):
            if len(where := np.flatnonzero(some)):
                new = [own[i] for i in where.tolist()]
                ids = self.encode_parts([x if x[0] == "\n" else space + x for x in new], plain)
                at = self._add(ids)
                place[where] = at
                known.update(zip(new, at, strict=True))
                self.held += sum(map(len, new)) + 4 * sum(map(len, ids)) + self.OVERHEAD * len(new)
        return place

    def _gather(self, place: np.ndarray) -> np.ndarray:
        """The ids of all these places, one after the other."""
        size = self.size[place]
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.begin[place] - (ends - size), size) + np.arange(ends[-1])] if len(place) else np.zeros(0, np.uint32)

    def _cut(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of texts that fall apart at their spaces."""
        lined = pc.and_not(pc.match_substring(texts, "\n"), pc.match_substring_regex(texts, _UNLINED))
        split = pc.split_pattern(pc.if_else(lined, pc.replace_substring(texts, "\n", " \n"), texts), " ")
        offsets, parts = split.offsets.to_numpy().astype(np.int64), split.values
        first = np.zeros(len(parts), bool)
        first[offsets[:-1]] = True
        place = np.zeros((len(parts), 2), np.int64)  # of the letters, of the mark behind them
        for some, known, space in ((first, self.opening, ""), (~first, self.inner, " ")):
            numbered = parts.filter(pa.array(some)).dictionary_encode()
            distinct = numbered.dictionary
            marked = pa.array(_is(distinct, _MARKED))
            bases = pc.if_else(marked, pc.utf8_slice_codeunits(distinct, 0, -1), distinct).dictionary_encode()
            both = np.zeros((len(distinct), 2), np.int64)
            both[:, 0] = self._learn(known, bases.dictionary, space)[bases.indices.to_numpy()]
            marks = pc.utf8_slice_codeunits(distinct.filter(marked), -1).dictionary_encode()
            both[marked.to_numpy(zero_copy_only=False), 1] = self._learn(self.opening, marks.dictionary, "")[marks.indices.to_numpy()]
            place[some] = both[numbered.indices.to_numpy()]
        place = place.reshape(-1)
        ids, at = self._gather(place), np.concatenate([[0], np.cumsum(self.size[place])])[2 * offsets]
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        """Texts that fall apart at their spaces, by parts; others whole."""
        if self.held > self.most:
            self.clear()
        every = pa.array(texts, pa.large_string())
        whole = _is(every, _UNCUT) | (np.array(list(map(len, texts))) == 0)
        for x in self.uncut:
            whole |= pc.match_substring(every, x).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        where = [k for k in np.flatnonzero(whole).tolist() if texts[k]]
        for k, ids in zip(where, self.encode_parts([texts[k] for k in where], False) if where else (), strict=True):
            out[k] = np.array(ids, np.uint32)
        if not whole.all():
            for k, ids in zip(np.flatnonzero(~whole).tolist(), self._cut(every.filter(pa.array(~whole))), strict=True):
                out[k] = ids
        return out

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        begin = n = 0
        for k, t in enumerate(texts):
            n += len(t)
            if n >= CHUNK or k + 1 == len(texts):
                yield from self._many(texts[begin : k + 1])
                begin, n = k + 1, 0
