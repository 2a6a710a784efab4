"""Media columns: progressive JPEG.

``encode`` writes a payload losslessly as the quantised coefficients of a progressive 4:2:0 image (one byte is one
coefficient; frequent bytes are small ones). ``write_media`` stores the images as a column of a table in the shared folder, and
``read_media`` reads that table with Spark. ``decode`` reads progressive images: spectral selection and successive approximation scans
are accumulated in coefficient arrays, which give back the payload, and pixels: inverse transform in numpy, chroma
upsampling, full-resolution RGB. Work goes over all images of a chunk at once: every restart interval of every image is
a lane, and one numpy step decodes one symbol in each lane.

Defined cases: null text is empty; an empty text is one unit of padding; very long texts make tall images; equal texts give equal
values; rows are independent, so ties, repeated rows and empty tables need no rule; columns besides doc_id and text
are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import settle, texts

UNIT, FILL = 576, 255
#: (components, first and last coefficient, high and low bit of the approximation)
SCANS = (
    ((0, 1, 2), 0, 0, 0, 1),
    *(((c,), 1, 2, 0, 1) for c in range(3)), *(((c,), 3, 63, 0, 0) for c in range(3)), *(((c,), 1, 2, 1, 0) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0),
)
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: Restart intervals: MCUs in interleaved scans, blocks in others.
MCUS, BLOCKS = 16, 8
CHUNK = 3 << 20

ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Code lengths: short ones for a small coefficient right after another, long ones for runs and ZRL.
AC_LENGTHS = {r << 4 | s: 12 for r in range(16) for s in range(1, 11)} | {r << 4: 12 for r in range(16)}
AC_LENGTHS |= {1: 2, 2: 2, 3: 2, 4: 4, 5: 6, 6: 6, 7: 6, 8: 6, 0: 5, 0x11: 7, 0x12: 7, 0x13: 7}
DC_LENGTHS = {s: 4 for s in range(12)}
#: Bytes from frequent to rare: blank and letters as common in Latin-script text, other visible ASCII, then the rest by number.
_FREQUENT = b" etaoinsrhldcumfpgwybvkxjqz"
_BITS = np.array([int(v).bit_length() for v in range(4096)])
_SCALE = 1 << 13


def _basis() -> np.ndarray:
    """Row k: what a unit of the k-th zigzag coefficient adds to the 64 pixels, in whole 1/8192ths: sums are exact."""
    u, x = np.mgrid[0:8, 0:8]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.rint(np.kron(one, one)[ZIGZAG] * _SCALE)


_BASIS = _basis()


def _coefficients() -> np.ndarray:
    """The coefficient of each byte: 0 for the filler, then 1, -1, 2, -2 and so on from frequent to rare."""
    order = dict.fromkeys([*_FREQUENT, *range(33, 127), *range(256)])
    del order[FILL]
    out = np.zeros(256, np.int64)
    for rank, byte in enumerate(order):
        out[byte] = (rank // 2 + 1) * (-1 if rank % 2 else 1)
    return out


_OF_BYTE = _coefficients()
_TO_BYTE = np.full(257, FILL, np.uint8)
_TO_BYTE[_OF_BYTE + 128] = np.arange(256)


class Codes:
    """Canonical codes from lengths by symbol."""

    def __init__(self, lengths: dict[int, int]):
        self.symbols = sorted(lengths, key=lambda s: (lengths[s], s))
        self.counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
        self.code, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.table = np.zeros(1 << 16, np.int64)  # next 16 bits -> symbol << 5 | code length; 0: no code
        code = at = 0
        for k, n in enumerate(self.counts, 1):
            for s in self.symbols[at : at + n]:
                self.code[s], self.size[s] = code, k
                self.table[code << (16 - k) : (code + 1) << (16 - k)] = s << 5 | k
                code += 1
            at += n
            code <<= 1

    def segment(self, kind: int) -> bytes:
        return _segment(0xC4, bytes([kind, *self.counts, *self.symbols]))

    @classmethod
    def read(cls, data: bytes) -> Codes:
        symbols, at, lengths = data[16:], 0, {}
        for k in range(16):
            for s in symbols[at : at + data[k]]:
                lengths[s] = k + 1
            at += data[k]
        own = cls(lengths)
        if own.symbols != list(symbols[:at]):  # same lengths in another order
            own = cls.__new__(cls)
            own._ordered(lengths, list(symbols[:at]))
        return own

    def _ordered(self, lengths: dict[int, int], symbols: list[int]) -> None:
        rank = {s: i for i, s in enumerate(symbols)}
        fresh = Codes({rank[s]: n for s, n in lengths.items()})
        self.symbols, self.counts = symbols, fresh.counts
        self.code, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for s, i in rank.items():
            self.code[s], self.size[s] = fresh.code[i], fresh.size[i]
        of = np.array([*symbols, *[0] * (256 - len(symbols))])
        self.table = np.where(fresh.table > 0, of[fresh.table >> 5] << 5 | fresh.table & 31, 0)


DC, AC = Codes(DC_LENGTHS), Codes(AC_LENGTHS)


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _packed(value: np.ndarray, length: np.ndarray, lane_bits: np.ndarray, lane_tokens: np.ndarray) -> list[bytes]:
    """Bit strings of tokens, each lane filled with ones to a whole byte."""
    pad = -lane_bits % 8
    at = np.cumsum(lane_tokens)
    value, length = np.insert(value, at, (1 << pad) - 1), np.insert(length, at, pad)
    end = np.cumsum(length)
    begin = end - length
    word = begin >> 5
    wide = value.astype(np.uint64) << (64 - (begin & 31) - length).astype(np.uint64)
    wide[length == 0] = 0
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros((int(end[-1]) >> 5) + 3 if len(end) else 1, np.uint64)
    if len(first):
        words[word[first]] |= np.bitwise_or.reduceat(wide >> np.uint64(32), first)
        words[word[first] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    raw = words.astype(">u4").tobytes()
    edges = np.concatenate([[0], np.cumsum((lane_bits + pad) // 8)]).tolist()
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category of each value and its extra bits."""
    size = _BITS[np.abs(v)]
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def _dc_lanes(values: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    """values: (MCUs, 6) of shifted DC terms in scan order; lanes: first MCU of each lane."""
    diff = values.copy()
    diff[:, 1:4] -= values[:, 0:3]
    fresh = np.zeros(len(values), bool)
    fresh[lanes] = True
    before = np.vstack([np.zeros((1, 6), values.dtype), values[:-1]])
    before[fresh] = 0
    diff[:, 0] -= before[:, 3]
    diff[:, 4:] -= before[:, 4:]
    size, bits = _magnitude(diff.ravel())
    value, length = DC.code[size] << size | bits, DC.size[size] + size
    at = lanes * 6
    return _packed(value, length, np.add.reduceat(length, at), np.diff(np.append(at, len(length))))


def _ac_lanes(band: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    """band: (blocks, coefficients) as the first pass sees them; lanes: first block of each lane."""
    n, width = band.shape
    block, k = np.nonzero(band)
    counts = np.bincount(block, minlength=n)
    after = np.cumsum(counts)
    gap = np.diff(k, prepend=-1) - 1
    head = np.concatenate([[0], after[:-1]])[counts > 0]
    gap[head] = k[head]
    size, bits = _magnitude(band[block, k])
    symbol = (gap & 15) << 4 | size
    value, length = AC.code[symbol] << size | bits, AC.size[symbol] + size
    last = np.full(n, -1)
    last[counts > 0] = k[after[counts > 0] - 1]
    ends = np.nonzero(last < width - 1)[0]
    far = np.nonzero(gap > 15)[0]
    zrl = np.repeat(far, gap[far] >> 4)
    at = np.concatenate([after[ends], zrl])
    extra = np.concatenate([np.full(len(ends), 0), np.full(len(zrl), 0xF0)])
    value, length = np.insert(value, at, AC.code[extra]), np.insert(length, at, AC.size[extra])
    tokens = counts + np.bincount(ends, minlength=n) + np.bincount(block[zrl], minlength=n)
    per_lane = np.add.reduceat(tokens, lanes)
    edges = np.concatenate([[0], np.cumsum(per_lane)[:-1]])
    return _packed(value, length, np.add.reduceat(length, edges), per_lane)


def _refine_lanes(band: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    """Correction bits of coefficients known by the first pass; those that appear now are coded by run."""
    code, size = AC.code.tolist(), AC.size.tolist()
    out, rows = [], band.tolist()
    edges = [*lanes.tolist(), len(rows)]
    for a, b in zip(edges, edges[1:], strict=False):
        bits: list[str] = []
        for row in rows[a:b]:
            fresh = [k for k, v in enumerate(row) if v in (1, -1)]
            held, run = "", 0
            for k, v in enumerate(row):
                if v in (1, -1):
                    bits.append(f"{code[run << 4 | 1]:0{size[run << 4 | 1]}b}{int(v > 0)}{held}")
                    held, run = "", 0
                elif v:
                    held += "01"[v & 1] if v > 0 else "01"[-v & 1]
                else:
                    run += 1
                    if run == 16 and fresh and k < fresh[-1]:
                        bits.append(f"{code[0xF0]:0{size[0xF0]}b}{held}")
                        held, run = "", 0
            if row and (not fresh or fresh[-1] < len(row) - 1):
                bits.append(f"{code[0]:0{size[0]}b}{held}")
        line = "".join(bits)
        line += "1" * (-len(line) % 8)
        out.append(int(line, 2).to_bytes(len(line) // 8, "big") if line else b"")
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive image for each payload. Each payload's length is a positive multiple of UNIT."""
    grids = []
    for p in payloads:
        mcus = -(-len(p) // 384)
        wide = int(np.ceil(np.sqrt(mcus)))
        high = -(-mcus // wide)
        units = np.zeros(wide * high * 384, np.int64)
        units[: len(p)] = _OF_BYTE[np.frombuffer(p, np.uint8)]
        grids.append((wide, high, units.reshape(high, wide, 6, 64)))
    luma = [g.reshape(h, w, 6, 64)[:, :, :4].reshape(h, w, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64) for w, h, g in grids]
    planes = [luma, *([g[:, :, 4 + c].reshape(-1, 64) for _, _, g in grids] for c in range(2))]
    dc = np.concatenate([g[..., 0].reshape(-1, 6) for _, _, g in grids])

    def starts(sizes: list[int], every: int) -> tuple[np.ndarray, np.ndarray]:
        """First unit of each lane over all images, lanes per image."""
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.concatenate([b + np.arange(0, n, every) for b, n in zip(base, sizes, strict=True)]), np.array([-(-n // every) for n in sizes])

    bodies: list[list[bytes]] = [[] for _ in payloads]
    joined = [np.concatenate(p) for p in planes]
    for comps, first, last, high, low in SCANS:
        if first == 0:
            lanes, per = starts([w * h for w, h, _ in grids], MCUS)
            if high:
                parts = [np.packbits((dc[a:b] & 1).astype(np.uint8).ravel()) for a, b in zip(lanes, [*lanes[1:], len(dc)], strict=True)]
                tails = [-(6 * (b - a)) % 8 for a, b in zip(lanes, [*lanes[1:], len(dc)], strict=True)]
                data = [(p[:-1].tobytes() + bytes([p[-1] | (1 << t) - 1])) for p, t in zip(parts, tails, strict=True)]
            else:
                data = _dc_lanes(dc >> low, lanes)
        else:
            band = joined[comps[0]][:, first : last + 1]
            lanes, per = starts([len(p) for p in planes[comps[0]]], BLOCKS)
            data = _refine_lanes(band, lanes) if high else _ac_lanes(np.sign(band) * (np.abs(band) >> low), lanes)
        every = BLOCKS if first else MCUS
        sos = _segment(0xDA, bytes([len(comps), *(x for c in comps for x in (c + 1, 0)), first, last, high << 4 | low]))
        at = 0
        for body, n in zip(bodies, per.tolist(), strict=True):
            body += [_segment(0xDD, struct.pack(">H", every)), sos, data[at].replace(b"\xff", b"\xff\0")]
            for i, lane in enumerate(data[at + 1 : at + n]):
                body += [bytes([0xFF, 0xD0 + i % 8]), lane.replace(b"\xff", b"\xff\0")]
            at += n
    out = []
    for p, (w, h, _), body in zip(payloads, grids, bodies, strict=True):
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"".join(bytes([c + 1, a << 4 | b, 0]) for c, (a, b) in enumerate(SAMPLING))
        head = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(p)), _segment(0xDB, bytes([0, *[1] * 64])), _segment(0xC2, frame), DC.segment(0), AC.segment(0x10)]
        out.append(b"".join([*head, *body, b"\xff\xd9"]))
    return out


@dataclass
class Image:
    width: int = 0
    height: int = 0
    note: bytes = b""
    sampling: list[tuple[int, int]] = field(default_factory=list)
    tables: list[int] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    #: components, first, last, high, low, restart interval, tables of codes, lanes
    scans: list[tuple] = field(default_factory=list)
    coefficients: list[np.ndarray] = field(default_factory=list)
    rows: list[tuple[int, int]] = field(default_factory=list)

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = (max(s[i] for s in self.sampling) for i in range(2))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_CODES: dict[bytes, Codes] = {}


def parse(data: bytes) -> Image:
    image, at, every = Image(), 2, 0
    codes: dict[int, Codes] = {}
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.note = body
        elif marker == 0xDB:
            image.quant[body[0]] = np.frombuffer(body, np.uint8, 64, 1).astype(np.int64)
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            for k in range(n):
                _, hv, table = body[6 + 3 * k : 9 + 3 * k]
                image.sampling.append((hv >> 4, hv & 15))
                image.tables.append(table)
            wide, high = image.mcus
            image.rows = [(high * v, wide * h) for h, v in image.sampling]
            image.coefficients = [np.zeros((a * b, 64), np.int64) for a, b in image.rows]
        elif marker == 0xC4:
            if body not in _CODES:
                _CODES[body] = Codes.read(body[1:])
            codes[body[0]] = _CODES[body]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            n = body[0]
            comps = tuple(body[1 + 2 * k] - 1 for k in range(n))
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            end = _SCAN_END.search(data, at).start()
            lanes = [x.replace(b"\xff\0", b"\xff") for x in _RESTART.split(data[at:end])]
            table = codes.get((0x10 if first else 0) | (body[2] >> 4 if not first else body[2] & 15))
            image.scans.append((comps, first, last, approx >> 4, approx & 15, every, table, lanes))
            at = end
    return image


def _windows(lanes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of all lanes the 32 bits from there on; the first bit of each lane."""
    data = np.frombuffer(b"".join(x + b"\xff\xff" for x in lanes) + b"\xff" * 8, np.uint8).astype(np.int64)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    size = np.array([len(x) + 2 for x in lanes])
    return window, 8 * np.concatenate([[0], np.cumsum(size)[:-1]])


def _read(window: np.ndarray, bit: np.ndarray, n) -> np.ndarray:
    at = np.minimum(bit >> 3, len(window) - 1)
    return window[at] >> (32 - (bit & 7) - n) & ((1 << n) - 1)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


def _dc_first(lanes: list[bytes], units: np.ndarray, table: np.ndarray, slots: int) -> np.ndarray:
    """Differences in scan order: (all MCUs, slots). units: MCUs of each lane."""
    window, bit = _windows(lanes)
    out = np.zeros((int(units.sum()), slots), np.int64)
    place, left = np.concatenate([[0], np.cumsum(units)[:-1]]) * slots, units * slots
    flat = out.reshape(-1)
    while len(bit):
        entry = table[_read(window, bit, 16)]
        size = entry >> 5
        bit = bit + (entry & 31)
        flat[place] = _signed(_read(window, bit, size), size)
        bit, place, left = bit + size, place + 1, left - 1
        if (left == 0).any():
            on = left > 0
            bit, place, left = bit[on], place[on], left[on]
    return out


def _ac_first(lanes: list[bytes], begin: np.ndarray, end: np.ndarray, table: np.ndarray, out: np.ndarray, first: int, last: int, low: int) -> None:
    """Fills ``out`` (blocks and one spare row at the end, 64); begin, end: blocks of each lane."""
    window, bit = _windows(lanes)
    block, k, spare = begin.copy(), np.full(len(begin), first), len(out) - 1
    flat, step = out.reshape(-1), 0
    while len(bit):
        entry = table[_read(window, bit, 16)]
        bit = bit + (entry & 31)
        run, size = entry >> 9, entry >> 5 & 15
        n = np.where((size == 0) & (run < 15), run, size)
        bits = _read(window, bit, n)
        bit = bit + n
        put = (size > 0) & (block < end)
        k = k + run
        flat[np.where(put, block * 64 + np.minimum(k, 63), spare * 64)] = _signed(bits, size) << low
        stop = (size == 0) & (run < 15)
        k = k + 1
        over = stop | (k > last)
        block = block + np.where(stop, (1 << run) + bits, over)
        k = np.where(over, first, k)
        step += 1
        if step % 8 == 0 or len(bit) < 64:
            on = block < end
            if not on.all():
                bit, block, k, end = bit[on], block[on], k[on], end[on]
    flat[spare * 64 :] = 0


def _ac_refine(lane: bytes, blocks: np.ndarray, table: np.ndarray, first: int, last: int, low: int) -> None:
    line = f"{int.from_bytes(lane, 'big'):0{8 * len(lane)}b}" + "1" * 16 if lane else "1" * 16
    at = skip = 0
    one = 1 << low
    rows = blocks[:, first : last + 1].tolist()
    for row in rows:
        k, n = 0, len(row)
        while not skip and k < n:
            entry = int(table[int(line[at : at + 16].ljust(16, "1"), 2)])
            at += entry & 31
            run, size, value = entry >> 9, entry >> 5 & 15, 0
            if size:
                value = one if line[at] == "1" else -one
                at += 1
            elif run < 15:
                skip = (1 << run) + (int(line[at : at + run], 2) if run else 0)
                at += run
                break
            while k < n:
                if row[k]:
                    if line[at] == "1":
                        row[k] += one if row[k] > 0 else -one
                    at += 1
                elif run == 0:
                    if value:
                        row[k] = value
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if skip:
            for k in range(k, n):
                if row[k]:
                    if line[at] == "1":
                        row[k] += one if row[k] > 0 else -one
                    at += 1
            skip -= 1
    blocks[:, first : last + 1] = rows


def decode(files: list[bytes]) -> list[Image]:
    """Images with all scans accumulated in ``coefficients`` (zigzag order). Scans of one kind go through together."""
    images = [parse(f) for f in files]
    for turn in range(max((len(i.scans) for i in images), default=0)):
        kinds: dict[tuple, list[Image]] = {}
        for image in images:
            if turn < len(image.scans):
                comps, first, last, high, low, every, table, _ = image.scans[turn]
                kinds.setdefault((comps, first, last, high, low, every, id(table), tuple(image.sampling)), []).append(image)
        for (comps, first, last, high, low, every, _, sampling), those in kinds.items():
            lanes = [x for i in those for x in i.scans[turn][7]]
            table = those[0].scans[turn][6]
            if first == 0:
                _dc_scan(those, lanes, comps, sampling, high, low, every, table)
                continue
            c = comps[0]
            sizes = [len(i.coefficients[c]) for i in those]
            base = np.concatenate([[0], np.cumsum(sizes)])
            begin = np.concatenate([b + np.arange(0, n, every or n) for b, n in zip(base, sizes, strict=False)])
            end = np.append(begin[1:], base[-1])
            whole = np.vstack([*(i.coefficients[c] for i in those), np.zeros((1, 64), np.int64)])
            if high:
                for lane, a, b in zip(lanes, begin.tolist(), end.tolist(), strict=True):
                    _ac_refine(lane, whole[a:b], table.table, first, last, low)
            else:
                _ac_first(lanes, begin, end, table.table, whole, first, last, low)
            for i, a, b in zip(those, base, base[1:], strict=False):
                i.coefficients[c] = whole[a:b]
    return images


def _dc_scan(those, lanes, comps, sampling, high, low, every, table) -> None:
    counts = [i.mcus[0] * i.mcus[1] for i in those]
    units = np.concatenate([np.minimum(every or n, n - np.arange(0, n, every or n)) for n in counts])
    slots = [c for c in comps for _ in range(sampling[c][0] * sampling[c][1])]
    if high:
        bits = [np.unpackbits(np.frombuffer(x, np.uint8))[: n * len(slots)] for x, n in zip(lanes, units.tolist(), strict=True)]
        values = np.concatenate(bits).reshape(-1, len(slots)).astype(np.int64) << low
    else:
        values = _dc_first(lanes, units, table.table, len(slots))
        edge = np.concatenate([[0], np.cumsum(units)[:-1]])
        for c in comps:
            own = [k for k, x in enumerate(slots) if x == c]
            run = np.cumsum(values[:, own].reshape(-1)).reshape(-1, len(own))
            before = np.where(edge > 0, run[edge - 1, -1], 0)
            values[:, own] = run - np.repeat(before, units)[:, None]
        values <<= low
    at = 0
    for image, n in zip(those, counts, strict=True):
        wide, tall = image.mcus
        k = 0
        for c in comps:
            h, v = sampling[c]
            part = values[at : at + n, k : k + h * v].reshape(tall, wide, v, h).transpose(0, 2, 1, 3).reshape(-1)
            image.coefficients[c][:, 0] |= part
            k += h * v
        at += n


def payload(image: Image) -> bytes:
    wide, tall = image.mcus
    luma = image.coefficients[0].reshape(tall, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(tall, wide, 4, 64)
    units = np.concatenate([luma, *(c.reshape(tall, wide, 1, 64) for c in image.coefficients[1:])], axis=2)
    return _TO_BYTE[units.reshape(-1)[: int(image.note.split()[1])] + 128].tobytes()


def pixels(images: list[Image]) -> list[np.ndarray]:
    """Full-resolution RGB tensors: inverse transform of all blocks together, chroma repeated to full size, colours in
    whole 1/65536ths."""
    if not images:
        return []
    blocks = np.concatenate([c * i.quant[t] for i in images for c, t in zip(i.coefficients, i.tables, strict=True)])
    flat = np.floor((blocks.astype(np.float64) @ _BASIS + _SCALE // 2) / _SCALE) + 128
    flat = np.clip(flat, 0, 255).astype(np.int32)
    out, at = [], 0
    for image in images:
        most = [max(s[k] for s in image.sampling) for k in range(2)]
        planes = []
        for (rows, cols), (h, v), c in zip(image.rows, image.sampling, image.coefficients, strict=True):
            plane = flat[at : at + len(c)].reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
            at += len(c)
            planes.append(plane.repeat(most[1] // v, axis=0).repeat(most[0] // h, axis=1)[: image.height, : image.width])
        y, cb, cr = (planes * 3)[:3] if len(planes) == 1 else planes
        if len(planes) == 1:
            out.append(np.dstack([y, y, y]).astype(np.uint8))
            continue
        y, cb, cr = (y << 16) + (1 << 15), cb - 128, cr - 128
        rgb = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], axis=-1) >> 16
        out.append(np.clip(rgb, 0, 255).astype(np.uint8))
    return out


def to_payload(text: str) -> bytes:
    data = text.encode("utf-8")
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data + bytes([FILL]) * (size - len(data))


def _by_chunk(make, sizes: str, columns: str):
    """For ``mapInPandas``: ``make`` takes the rows of a batch in chunks, by the length of their ``sizes``."""
    names = [c.strip().split()[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            begin = n = 0
            for k, value in enumerate(batch[sizes]):
                n += len(value)
                if n >= CHUNK or k + 1 == len(batch):
                    held = batch.iloc[begin : k + 1]
                    out = pd.DataFrame(make(held), columns=names)
                    out.insert(0, "doc_id", held["doc_id"].array)
                    yield out
                    begin, n = k + 1, 0

    return run


def write_media(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, media: the images, written to the shared folder and read from there."""

    def rows(held: pd.DataFrame) -> list[tuple]:
        many = held["text"].tolist()
        media = encode([to_payload(t) for t in many])
        return [(len(t.encode("utf-8")), m) for t, m in zip(many, media, strict=True)]

    columns, kind = "n_bytes long, media binary", docs.schema["doc_id"].dataType.simpleString()
    return settle(texts(docs).mapInPandas(_by_chunk(rows, "text", columns), f"doc_id {kind}, {columns}"), "media", compression="zstd")


def read_media(stored: DataFrame, keep: bool = False) -> DataFrame:
    """Stored images (doc_id, n_bytes, media) -> doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature; with ``keep`` also the image and the RGB tensor with its height and width."""

    def rows(held: pd.DataFrame) -> list[tuple]:
        files = [bytes(m) for m in held["media"]]
        images = decode(files)
        out = []
        for n, file, image, rgb in zip(held["n_bytes"], files, images, pixels(images), strict=True):
            back = payload(image)
            sums = ":".join(map(str, rgb.sum(axis=(0, 1), dtype=np.int64)))
            feature = f"{rgb.shape[0]}x{rgb.shape[1]}:{sums}:{zlib.crc32(rgb.tobytes())}"
            row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature)
            out.append((*row, file, rgb.tobytes(), rgb.shape[0], rgb.shape[1]) if keep else row)
        return out

    columns = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    columns += ", media binary, rgb binary, height int, width int" * keep
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInPandas(_by_chunk(rows, "media", columns), f"doc_id {kind}, {columns}")


def store(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Every text as an image, stored, and what is read back from it; columns as in ``read_media``."""
    return read_media(write_media(docs), keep)
