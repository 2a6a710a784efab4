"""Byte-level BPE as a lazily determinised transducer, with streaming decoding.

A prefix of a piece has one BPE encoding, and its last token starts at an earlier boundary, its parent: boundaries form
a tree. A boundary is live while some token may still start there, that is while the bytes after it begin a token. Tokens
on the way to the deepest common ancestor of all live boundaries can't change any more and are emitted, so the lookahead
is bounded by the longest token. What is left (the live boundaries, the tokens from that ancestor to each, the token before it)
is the state; states and arcs are numbers, made when first met. A token may follow another if no merge crosses their border: the
merges that build the left one's right edge and the right one's left edge are replayed in order of rank. Pieces are taken in
order of their bytes, so that those with a common beginning share its states.

Defined cases: null text is empty; an empty text has no tokens; rows are independent, so repeated rows, ties and empty
tables need no rule; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_many
from .pieces import PartMemory, exact

RANKS = "byte_bpe_multi_50k.tiktoken"
#: States that a worker's machine keeps, and bytes of parts that it remembers.
STATES, MEMORY = 400_000, 60 << 20
#: Bytes of a piece whose states are held for the next piece.
SHARED = 64
NEVER = 1 << 60


class Merges:
    """A rank table: bytes of a token -> its rank, which is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelled = {i: t for t, i in ranks.items()}
        self.edges: dict[bytes, tuple[list[bytes], list[bytes]]] = {}
        #: By the ids of both, as one number.
        self.fits: dict[int, bool] = {}
        self._begin()

    def _begin(self) -> None:
        """The trie of all tokens: ``below`` has a node's child by node * 256 + byte, ``ends`` its token or -1, ``inner`` 1 if it
        has children. Node 0 is the empty beginning."""
        self.below: dict[int, int] = {}
        self.ends, self.inner = [-1], bytearray(1)
        below, ends, inner = self.below, self.ends, self.inner
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                to = below.get(node << 8 | byte)
                if to is None:
                    inner[node] = 1
                    to = below[node << 8 | byte] = len(ends)
                    ends.append(-1)
                    inner.append(0)
                node = to
            ends[node] = rank

    def merge(self, piece: bytes, below: int = NEVER) -> list[bytes]:
        """Plain merging by rank, lowest and leftmost first: for single tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spines(self, token: bytes) -> tuple[list[bytes], list[bytes]]:
        """The tokens that stand at its left and at its right edge while it is merged, from one byte to itself."""
        if token not in self.edges:
            halves = self.merge(token, self.ranks[token]) if len(token) > 1 else []
            left, right = (self.spines(halves[0])[0], self.spines(halves[-1])[1]) if halves else ([], [])
            self.edges[token] = ([*left, token], [*right, token])
        return self.edges[token]

    def may_follow(self, one: int, two: int) -> bool:
        key = one << 32 | two
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._stays(self.spelled[one], self.spelled[two])
        return known

    def _stays(self, one: bytes, two: bytes) -> bool:
        ranks, right, left = self.ranks, self.spines(one)[1], self.spines(two)[0]
        i = j = 0
        while True:
            cross = ranks.get(right[i] + left[j], NEVER)
            grow_one = ranks[right[i + 1]] if i + 1 < len(right) else NEVER
            grow_two = ranks[left[j + 1]] if j + 1 < len(left) else NEVER
            if cross < grow_one and cross <= grow_two:
                return False
            if grow_one == grow_two == NEVER:
                return True
            if grow_one <= grow_two:
                i += 1
            else:
                j += 1


class Transducer:
    """Pieces to ids. A state is a tuple of its live boundaries from left to right, two entries for each: the trie node of the bytes
    after it, and its path: the token left of the root boundary (-1: none, or it doesn't matter any more), then the tokens from
    the root to it. The last one is the end of what was read. At most ``most`` states are kept, then the machine starts
    afresh, in the middle of a piece too: the state at hand goes on."""

    START = (0, (-1,))

    def __init__(self, merges: Merges, most: int = STATES):
        self.merges, self.most, self.resets = merges, most, -1
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        #: By state * 256 + byte: the next state, or the complement of a place in ``emits``, which has it behind the ids emitted.
        self.arcs: dict[int, int] = {}
        self.emits: list[tuple[tuple[int, ...], int]] = []
        self.reset()

    def reset(self) -> None:
        for held in (self.numbers, self.states, self.arcs, self.emits, self.merges.fits):
            held.clear()
        self.resets += 1
        self._number(self.START)

    def _number(self, state: tuple) -> int:
        to = self.numbers.get(state)
        if to is None:
            if len(self.states) >= max(self.most, 2):
                self.reset()
                return self._number(state)
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
        return to

    def _extend(self, at: int, byte: int) -> int:
        merges, state, resets = self.merges, self.states[at], self.resets
        below, ends, inner = merges.below, merges.ends, merges.inner
        here, nodes, paths = None, [], []
        for k in range(0, len(state), 2):
            node = below.get(state[k] << 8 | byte)
            if node is None:
                continue
            path = state[k + 1]
            if here is None and (token := ends[node]) >= 0 and (path[-1] < 0 or merges.may_follow(path[-1], token)):
                here = (*path, token)
            if inner[node]:
                nodes.append(node)
                paths.append(path)
        nodes.append(0)
        paths.append(here)
        first, least, same = paths[0], min(map(len, paths)), 1
        while same < least and all(p[same] == first[same] for p in paths):
            same += 1
        if least > same:  # no token starts at the root any more
            if same > 1 or first[0] >= 0:
                paths = [(-1, *p[same:]) for p in paths]
        elif same > 1:
            paths = [p[same - 1 :] for p in paths]
        to = self._number(tuple([x for pair in zip(nodes, paths, strict=True) for x in pair]))
        if same > 1:
            self.emits.append((first[1:same], to))
            to = -len(self.emits)
        if resets == self.resets:
            self.arcs[at << 8 | byte] = to
        return to

    def encode_many(self, pieces: list[bytes]) -> list[list[int]]:
        """In order of their bytes: a piece goes on from the state that it and the piece before have in common, sought among
        the first ``SHARED`` bytes."""
        ranks, arcs, emits, found = self.merges.ranks, self.arcs, self.emits, [[]] * len(pieces)
        last, ids, passed, sizes, resets = b"", [], [0], [0], self.resets  # states passed, and how many ids there were
        for k in sorted(range(len(pieces)), key=pieces.__getitem__):
            piece = pieces[k]
            whole = ranks.get(piece)
            if whole is not None:
                found[k] = [whole]
                continue
            if resets != self.resets:
                last, ids, passed, sizes, resets = b"", [], [0], [0], self.resets
            head = piece[:SHARED]
            at, most = 0, min(len(head), len(last))
            while at < most and head[at] == last[at]:
                at += 1
            del passed[at + 1 :], sizes[at + 1 :], ids[sizes[at] :]
            state, last = passed[at], head
            for byte in head[at:]:
                to = arcs.get(state << 8 | byte)
                if to is None:
                    to = self._extend(state, byte)
                if to < 0:
                    more, to = emits[~to]
                    ids += more
                state = to
                passed.append(state)
                sizes.append(len(ids))
            for byte in piece[SHARED:]:
                to = arcs.get(state << 8 | byte)
                if to is None:
                    to = self._extend(state, byte)
                if to < 0:
                    more, to = emits[~to]
                    ids += more
                state = to
            found[k] = [*ids, *self.states[state][-1][1:]]
        return found


class Utf8Machine:
    """Incremental UTF-8: ``feed`` takes bytes and gives back those that complete characters; the rest waits.
    States count the continuation bytes to come; four of them also narrow the next byte's range."""

    ACCEPT, BAD = "", "bad"
    LEADS = (((0x00, 0x7F), ""), ((0xC2, 0xDF), "1"), ((0xE0, 0xE0), "2a"), ((0xE1, 0xEC), "2"), ((0xED, 0xED), "2b"), ((0xEE, 0xEF), "2"), ((0xF0, 0xF0), "3a"), ((0xF1, 0xF3), "3"), ((0xF4, 0xF4), "3b"))
    NEXT = {"1": (0x80, 0xBF, ""), "2": (0x80, 0xBF, "1"), "2a": (0xA0, 0xBF, "1"), "2b": (0x80, 0x9F, "1"), "3": (0x80, 0xBF, "2"), "3a": (0x90, 0xBF, "2"), "3b": (0x80, 0x8F, "2")}

    def __init__(self):
        self.waiting = b""

    @classmethod
    def step(cls, state: str, byte: int) -> str:
        if state == cls.ACCEPT:
            return next((to for (a, b), to in cls.LEADS if a <= byte <= b), cls.BAD)
        low, high, to = cls.NEXT.get(state, (1, 0, ""))
        return to if low <= byte <= high else cls.BAD

    def feed(self, data: bytes) -> bytes:
        data = self.waiting + data
        lead = len(data)
        while lead and len(data) - lead < 3 and data[lead - 1] & 0xC0 == 0x80:
            lead -= 1
        lead -= bool(lead)  # the last character's first byte, or a byte that no character begins with
        state = self.ACCEPT
        for byte in data[lead:]:
            state = self.step(state, byte)
        done = len(data) if state in (self.ACCEPT, self.BAD) else lead
        self.waiting = data[done:]
        data[:done].decode("utf-8")  # raises where the ids don't spell text
        return data[:done]


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Whole texts to ids and back. ``states`` bounds the machine, ``most`` the bytes of remembered parts."""

    #: Characters of parts that are cut and encoded together.
    CUT = 1 << 20

    def __init__(self, ranks: dict[bytes, int], pattern: str, states: int, most: int):
        merges = Merges(ranks)
        self.transducer = Transducer(merges, states)
        self.cut = regex.compile(exact(pattern)).findall
        self.memory = PartMemory(self._encode, most)
        self.spelled = merges.spelled

    def _encode(self, parts: list[str], letters: bool) -> list[list[int]]:
        """Letters alone, with a space or not, need no expression to cut them."""
        encode = self.transducer.encode_many
        if letters:
            return encode([x.encode("utf-8") for x in parts])
        out, group, n = [], [], 0
        for k, x in enumerate(parts):
            group.append(self.cut(x))
            n += len(x)
            if n >= self.CUT or k + 1 == len(parts):
                distinct = list(dict.fromkeys(chain.from_iterable(group)))
                known = dict(zip(distinct, encode([p.encode("utf-8") for p in distinct]), strict=True))
                out += [[i for p in cuts for i in known[p]] for cuts in group]
                group, n = [], 0
        return out

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        return self.memory.encode_all(texts)

    def decode(self, ids: Iterable[int], block: int = 4096) -> Iterator[bytes]:
        """Stream of decoded bytes; each item ends with a whole character."""
        machine, ids = Utf8Machine(), list(ids)
        for at in range(0, len(ids), block):
            yield machine.feed(b"".join(map(self.spelled.__getitem__, ids[at : at + block])))
        if machine.waiting:
            raise ValueError("the ids end inside a character")


@lru_cache(maxsize=1)
def codec(path: str | None = None, states: int = STATES, most: int = MEMORY) -> Codec:
    """One per Python worker, made where it is used, from a vocabulary file that every machine has; what it has learnt
    serves the worker's later tasks."""
    gc.set_threshold(200_000, 20, 100)  # its states are many and long-lived
    import public_tokenizers

    return Codec(load_ranks(path or public_tokenizers.path(RANKS)), public_tokenizers.PATTERN, states, most)


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False, states: int = STATES, most: int = MEMORY, forgetful: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids (array of int). ``states`` and
    ``most`` (bytes of parts) bound what a Python worker remembers; ``forgetful``: it remembers nothing from task to task."""

    def make():
        own = codec.__wrapped__(path, states, most) if forgetful else codec(path, states, most)

        def rows(many: list[str]) -> Iterator[tuple]:
            for ids in own.encode_all(many):
                back = hashlib.sha256()
                for data in own.decode(ids.tolist()):
                    back.update(data)
                row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), back.hexdigest())
                yield (*row, ids.astype("int32")) if keep_ids else row

        return rows

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_many(docs, make, columns, 1000 if keep_ids else 4000, forgetful)
