"""SentencePiece BPE by vectorised merge rounds, and decoding of its ids.

The symbols of all new words of a chunk of texts stand in one flat array, cut into segments that no piece of the vocabulary
can cross. In each round the segmented minimum gives every segment its best pair; that pair's occurrences are merged
from the left, all at once and in all segments at once; the arrays are compacted, and segments without a pair leave, until
none remains. A merge may go ahead in all its places only if no pair with the new symbol is better than, or as good as, the
one merged, and if no other piece has the same score; otherwise a round merges the leftmost place alone. Such segments
(runs of blanks, whose pieces all tie) go on in a heap of the same order after ``SINGLE`` rounds, so that a run
of n blanks costs n log n.

Only distinct words are merged: Arrow numbers the words of a chunk, a memory of bounded bytes keeps their ids, and numpy
puts the ids of whole texts together and takes them apart again into bytes.

Defined cases: null text is empty; an empty text has the begin and end ids alone; a character outside the vocabulary is
spelled by its bytes' pieces; the character U+2581 decodes to a blank, as in the library; rows are independent, so repeated
rows, ties and empty tables need no rule; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_many

MODEL = "piece_bpe_32k.model"
#: Bytes of words and ids that a Python worker remembers; characters of texts that go through together; rounds of
#: single merges after which a segment goes on in a heap.
MEMORY, CHUNK, SINGLE = 60 << 20, 4 << 20, 64
BLANK = "▁"
_BLANK = BLANK.encode()
#: Symbols are piece ids, or ``n pieces + code point`` for characters that are no piece; both fit below this.
_WIDE = 1 << 21
NEVER = np.int64(1) << 60


class Vocabulary:
    """Pieces, their pairs in order of score, and their spelling, as arrays. ``pieces`` and ``scores`` by id; ``spelled``: the byte
    that a piece stands for, or -1; ``silent``: pieces that decode to nothing."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], spelled: Sequence[int], silent: Sequence[bool], begin: int, end: int):
        self.n, self.begin, self.end = len(pieces), begin, end
        plain = [i for i in range(self.n) if spelled[i] < 0 and not silent[i]]
        ids = {pieces[i]: i for i in plain}
        byte_ids = {b: i for i, b in enumerate(spelled) if b >= 0}
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int64)
        self.char = np.arange(0x110000, dtype=np.int64) + self.n
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        # equal scores have equal ranks, lower ranks are better
        levels = {s: k for k, s in enumerate(sorted({scores[i] for i in plain}, reverse=True))}
        rank = {i: levels[scores[i]] for i in plain}
        symbol = lambda part: int(self.char[ord(part)]) if len(part) == 1 else ids.get(part)
        pairs = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                left, right = symbol(p[:cut]), symbol(p[cut:])
                if left is not None and right is not None:
                    pairs[left * _WIDE + right] = i
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()], np.int64)
        self.rank = np.array([rank[i] for i in self.merged.tolist()], np.int64)
        # ranks whose merges may be made in all their places at once
        best_with = np.full(self.n + 0x110000, NEVER, np.int64)
        np.minimum.at(best_with, self.pair // _WIDE, self.rank)
        np.minimum.at(best_with, self.pair % _WIDE, self.rank)
        pieces_of_rank = np.bincount([rank[i] for i in plain], minlength=len(levels))
        self.together = pieces_of_rank == 1
        for i in plain:
            self.together[rank[i]] &= bool(best_with[i] > rank[i])
        # neighbours that some piece holds: nothing merges across any others
        inside = {ord(a) * _WIDE + ord(b) for p in ids for a, b in zip(p, p[1:], strict=False)}
        self.inside = np.array(sorted(inside), np.int64)
        surface = [b"" if silent[i] else bytes((spelled[i],)) if spelled[i] >= 0 else pieces[i].replace(BLANK, " ").encode() for i in range(self.n)]
        self.is_byte = np.array([b >= 0 for b in spelled])
        self.length = np.array(list(map(len, surface)), np.int64)
        self.place = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NEVER, merged piece) of each pair."""
        keys = left * _WIDE + right
        at = np.minimum(np.searchsorted(self.pair, keys), len(self.pair) - 1)
        known = self.pair[at] == keys
        return np.where(known, self.rank[at], NEVER), self.merged[at]

    def joined(self, codes: np.ndarray) -> np.ndarray:
        """Whether some piece holds the character and the next one, side by side."""
        keys = codes[:-1] * _WIDE + codes[1:]
        at = np.minimum(np.searchsorted(self.inside, keys), len(self.inside) - 1)
        return self.inside[at] == keys


def heap_merge(v: Vocabulary, symbols: list[int]) -> list[int]:
    """All merges of one segment, best rank and leftmost first, by a heap over a linked list."""
    own, n = list(symbols), len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(a: int, b: int) -> tuple[int, int]:
        found = known.get((own[a], own[b]))
        if found is None:
            rank, piece = v.look_up(np.array([own[a]]), np.array([own[b]]))
            found = known[own[a], own[b]] = (int(rank[0]), int(piece[0]))
        return found

    heap = [(pair(i, i + 1)[0], i, own[i], own[i + 1]) for i in range(n - 1)]
    heap = [x for x in heap if x[0] < NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or own[i] != a or own[j] != b:
            continue
        own[i], own[j] = pair(i, j)[1], -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (rank := pair(x, y)[0]) < NEVER:
                heapq.heappush(heap, (rank, x, own[x], own[y]))
    return [s for s in own if s >= 0]


def merge_rounds(v: Vocabulary, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """symbols and the segment of each, segments side by side in rising order -> the same, merged as far as pairs go."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    symbols = symbols.copy()
    waited = np.zeros(int(segment[-1]) + 1 if len(segment) else 0, np.int32)

    def ranks_at(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs that begin at these places."""
        last = where + 1 >= len(symbols)
        right = np.where(last, 0, where + 1)
        rank, piece = v.look_up(symbols[where], symbols[right])
        return np.where(last | (segment[where] != segment[right]), NEVER, rank), piece

    rank, piece = ranks_at(np.arange(len(symbols)))
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(first, len(symbols)))
        best = np.minimum.reduceat(rank, first)
        slow = waited[segment[first]] >= SINGLE
        for k in np.flatnonzero(slow & (best < NEVER)).tolist():
            found = heap_merge(v, symbols[first[k] : first[k] + size[k]].tolist())
            done.append((np.array(found, np.int64), np.full(len(found), segment[first[k]])))
        over = best == NEVER
        if (over | slow).any():
            leaves, goes = np.repeat(over, size), np.repeat(over | slow, size)
            done.append((symbols[leaves], segment[leaves]))
            symbols, segment, rank, piece = (x[~goes] for x in (symbols, segment, rank, piece))
            best, size = best[~(over | slow)], size[~(over | slow)]
        if not len(symbols):
            break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        opens = np.concatenate([[True], segment[hit[1:]] != segment[hit[:-1]]])
        all_at_once = v.together[rank[hit]]
        # occurrences that overlap (aaa) count from the left, every second one
        run = np.concatenate([[True], (hit[1:] != hit[:-1] + 1)]) | opens
        odd = (hit - hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]) % 2 == 1
        hit = hit[np.where(all_at_once, ~odd, opens)]
        waited[segment[hit[~v.together[rank[hit]]]]] += 1
        symbols[hit] = piece[hit]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        place = np.cumsum(keep) - 1
        symbols, segment, rank, piece = (x[keep] for x in (symbols, segment, rank, piece))
        fresh = place[hit]
        fresh = np.unique(np.concatenate([fresh, fresh[fresh > 0] - 1]))
        rank[fresh], piece[fresh] = ranks_at(fresh)
    if not done:
        return symbols, segment
    symbols, segment = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
    order = np.argsort(segment, kind="stable")
    return symbols[order], segment[order]


class Codec:
    """Whole texts to ids and back; ``most`` bounds the bytes of remembered words."""

    def __init__(self, vocabulary: Vocabulary, most: int = MEMORY):
        self.v, self.most = vocabulary, most
        self._clear()

    def _clear(self) -> None:
        #: Where each word's ids begin in the pool and how many they are; both and the pool grow.
        self.known: dict[bytes, int] = {}
        self.begin, self.size, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.used = self.held = 0

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these normalised words, one after the other, and how many each has."""
        v = self.v
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        cut = np.concatenate([[False], (word[1:] != word[:-1]) | ~v.joined(codes)])
        segment = np.cumsum(cut)
        word_of = word[np.flatnonzero(np.concatenate([[True], cut[1:]]))]
        symbols, segment = merge_rounds(v, v.char[codes], segment)
        word = word_of[segment]
        # characters that are no piece: their bytes
        strange = np.flatnonzero(symbols >= v.n)
        if len(strange):
            spelled = [chr(c - v.n).encode() for c in symbols[strange].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[strange] = list(map(len, spelled))
            word, symbols, at = np.repeat(word, times), np.repeat(symbols, times), np.repeat(symbols >= v.n, times)
            symbols[at] = v.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return symbols.astype(np.uint32), np.bincount(word, minlength=len(words))

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """The places of distinct words, encoded where they are new."""
        place = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        if len(new := np.flatnonzero(place < 0)):
            fresh = [words[i] for i in new.tolist()]
            ids, sizes = self.encode_words([w.decode() for w in fresh])
            at, last = len(self.known), self.used + len(ids)
            for name, need in (("begin", at + len(fresh)), ("size", at + len(fresh)), ("pool", last)):
                old = getattr(self, name)
                if need > len(old):
                    setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), old.dtype)]))
            self.pool[self.used : last] = ids
            self.size[at : at + len(fresh)] = sizes
            self.begin[at : at + len(fresh)] = self.used + np.cumsum(sizes) - sizes
            place[new] = np.arange(at, at + len(fresh))
            self.known.update(zip(fresh, range(at, at + len(fresh)), strict=True))
            self.used = last
            self.held += sum(map(len, fresh)) + 4 * len(ids) + 120 * len(fresh)
        return place

    def _many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with begin and end ids, one after the other, and how many each text has."""
        if self.held > self.most:
            self._clear()
        spelled = [(_BLANK + t.encode().replace(b" ", _BLANK)) if t else b"" for t in texts]
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        data = b"".join(spelled)
        del spelled
        text_at = np.cumsum(sizes) - sizes
        raw = np.frombuffer(data, np.uint8)
        blank = np.zeros(len(raw) + 3, bool)  # shifted by 3: blank[i + 3] tells of byte i
        if len(raw) > 2:
            blank[3:-2] = (raw[:-2] == _BLANK[0]) & (raw[1:-1] == _BLANK[1]) & (raw[2:] == _BLANK[2])
        opens = blank[3:] & ~blank[:-3]  # the first blank of a run; pieces never go on from other characters into one
        opens[text_at[sizes > 0]] = True
        begin = np.flatnonzero(opens)
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(raw)).astype(np.int64)), pa.py_buffer(data)).cast(pa.large_binary())
        numbered = words.dictionary_encode()
        place = self._learn(numbered.dictionary.to_pylist())[numbered.indices.to_numpy()] if len(begin) else np.zeros(0, np.int64)
        n = self.size[place]
        up_to = np.concatenate([[0], np.cumsum(n)])
        first = np.searchsorted(begin, text_at)  # of each text's words
        last = np.searchsorted(begin, text_at + sizes)
        own = up_to[last] - up_to[first]
        total = own + 2
        ends = np.cumsum(total)
        out = np.empty(int(ends[-1]) if len(texts) else 0, np.uint32)
        out[ends - total], out[ends - 1] = self.v.begin, self.v.end
        # every id's place: its place among all words' ids, moved by two for each text before and by one for the begin id
        shift = np.repeat(2 * np.arange(len(texts)) + 1, own)
        source = np.repeat(self.begin[place] - up_to[:-1], n) + np.arange(up_to[-1])
        out[np.arange(up_to[-1]) + shift] = self.pool[source]
        return out, total

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        begin = n = 0
        for k, t in enumerate(texts):
            n += len(t)
            if n >= CHUNK or k + 1 == len(texts):
                ids, sizes = self._many(texts[begin : k + 1])
                yield from np.split(ids, np.cumsum(sizes)[:-1])
                begin, n = k + 1, 0

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def _surface(self, ids: np.ndarray) -> bytes:
        n = self.v.length[ids]
        ends = np.cumsum(n)
        return self.v.bytes[np.repeat(self.v.place[ids] - (ends - n), n) + np.arange(ends[-1] if len(ids) else 0)].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes: pieces with blanks for U+2581, byte pieces as bytes (those that spell no character become U+FFFD),
        nothing for begin and end, and no first blank."""
        v, ids = self.v, np.asarray(ids, np.int64)
        n, is_byte = v.length[ids], v.is_byte[ids]
        if is_byte.any():  # a character's bytes stand side by side
            out = b"".join(_valid(self._surface(run)) if v.is_byte[run[0]] else self._surface(run) for run in np.split(ids, np.flatnonzero(is_byte[1:] != is_byte[:-1]) + 1))
        else:
            out = self._surface(ids)
        heard = ids[n > 0]
        return out[1:] if len(heard) and not v.is_byte[heard[0]] and out[:1] == b" " else out


def _valid(data: bytes) -> bytes:
    """``data`` with each byte that is no part of a character as U+FFFD."""
    out = []
    while True:
        try:
            data.decode()
            return b"".join([*out, data])
        except UnicodeDecodeError as e:
            out += [data[: e.start], "�".encode()]
            data = data[e.start + 1 :]


@lru_cache(maxsize=1)
def codec(path: str | None = None, most: int = MEMORY) -> Codec:
    """One per Python worker, from a vocabulary file that every machine has."""
    import public_tokenizers
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
    probe = "ﬁ  a "
    if own.normalize(probe) != BLANK + probe.replace(" ", BLANK) or not any(map(own.is_byte, range(own.vocab_size()))):
        raise ValueError("only models that keep texts as they are and spell unknown characters by bytes")
    ids = range(own.vocab_size())
    pieces = [own.id_to_piece(i) for i in ids]
    spelled = [int(pieces[i][3:5], 16) if own.is_byte(i) else -1 for i in ids]
    return Codec(Vocabulary(pieces, [own.get_score(i) for i in ids], spelled, [own.is_control(i) or own.is_unknown(i) for i in ids], own.bos_id(), own.eos_id()), most)


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False, most: int = MEMORY) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids (array of int)."""

    def make():
        own = codec(path, most)

        def rows(many: list[str]) -> Iterator[tuple]:
            for ids in own.encode_all(many):
                row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest())
                yield (*row, ids.astype("int32")) if keep_ids else row

        return rows

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_many(docs, make, columns, 1000 if keep_ids else 4000)
