"""Media columns: lossless WebP (VP8L) written and read with numpy, pixel arrays and features."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row of the stored picture, four 8-bit samples a pixel; largest side of a picture.
ROW_BYTES, LARGEST = 576, 16384

# Fixed values of the format: order of code-length codes; offsets (x, y) of the short distance codes.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Reader of a byte string, least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("the picture's bits end early")
        value = int.from_bytes(self.data[a:b], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def array(self, n: int, width: int) -> np.ndarray:
        """The next n fields of ``width`` bits, as rows of bits."""
        a, skip = self.at >> 3, self.at & 7
        end = (self.at + n * width + 7) >> 3
        if end > len(self.data):
            raise ValueError("the picture's bits end early")
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, end - a, a), bitorder="little")
        self.at += n * width
        return bits[skip : skip + n * width].reshape(n, width)


class Code:
    """A canonical prefix code from the lengths of its symbols."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        order = used[np.argsort(lengths[used], kind="stable")]
        self.only = int(order[0]) if len(order) == 1 else None
        self.symbols, own = order, lengths[order]
        if self.only is None and int((1 << (15 - own)).sum()) != 1 << 15:
            raise ValueError("a prefix code that is not complete")
        self.uniform = 0 if self.only is not None else int(own[0]) if own[0] == own[-1] else None
        self.lengths, self.table = own, None

    def _codes(self) -> dict[tuple[int, int], int]:
        table, code, last = {}, 0, 0
        for symbol, n in zip(self.symbols.tolist(), self.lengths.tolist(), strict=True):
            code <<= n - last
            table[n, code] = symbol
            code, last = code + 1, n
        return table

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.table = self._codes()
        code = n = 0
        while True:
            code, n = code << 1 | bits.read(1), n + 1
            if (found := self.table.get((n, code))) is not None:
                return found


def _read_code(bits: Bits, symbols: int) -> Code:
    lengths = np.zeros(symbols, np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code, limit = Code(own), symbols
    if bits.read(1):
        limit = 2 + bits.read(2 + 2 * bits.read(3))
    if code.uniform and limit == symbols and code.symbols.max() < 16:  # no runs: all lengths at once
        return Code(code.symbols[_ranks(bits.array(symbols, code.uniform))])
    at, last = 0, 8
    while at < symbols and limit:
        limit -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at], at = n, at + 1
            last = n or last
        else:
            times = (3 + bits.read(2)) if n == 16 else (3 + bits.read(3)) if n == 17 else (11 + bits.read(7))
            lengths[at : at + times] = last if n == 16 else 0
            at += times
    return Code(lengths)


def _extra(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    n = (code - 2) >> 1
    return ((2 + (code & 1)) << n) + bits.read(n) + 1


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as unsigned 32-bit integers (alpha, red, green, blue from the top)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_at = block = None
    groups = 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        groups_at = (_read_pixels(bits, across, (height + (1 << block) - 1) >> block, False) >> np.uint32(8)) & np.uint32(0xFFFF)
        groups = int(groups_at.max()) + 1
    cached = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, n) for n in (280 + cached, 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    if groups == 1 and not cached and all(c.uniform is not None for c in codes[0]):
        return _stretches(bits, codes[0], n, width)
    out = np.zeros(n, np.uint32)
    cache = [0] * cached
    at = kept = 0
    while at < n:
        own = codes[int(groups_at[(at // width >> block) * across + (at % width >> block)]) if groups_at is not None else 0]
        green = own[0].read(bits)
        if green < 256:
            red, blue, alpha = own[1].read(bits), own[2].read(bits), own[3].read(bits)
            out[at] = alpha << 24 | red << 16 | green << 8 | blue
            at += 1
        elif green < 280:
            length = _extra(bits, green - 256)
            back = _back(_extra(bits, own[4].read(bits)), width)
            if back > at or at + length > n:
                raise ValueError("a back-reference that leaves the picture")
            for i in range(at, at + length):
                out[i] = out[i - back]
            at += length
        else:
            while kept < at:
                cache[(0x1E35A7BD * int(out[kept]) & 0xFFFFFFFF) >> (32 - cache_bits)] = int(out[kept])
                kept += 1
            out[at] = cache[green - 280]
            at += 1
    return out


def _back(code: int, width: int) -> int:
    """Pixels back that a distance code means."""
    return code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)


def _stretches(bits: Bits, codes: list[Code], n: int, width: int) -> np.ndarray:
    """Pixels of codes that have one length each: stretches of literals are read as fields of bits, all at once, up to the next copy."""
    lengths = [c.uniform for c in codes[:4]]
    total, green = sum(lengths), codes[0].symbols
    out, at, step = np.zeros(n, np.uint32), 0, 512
    copies = green.max() >= 256
    while at < n:
        m = min(n - at, step) if copies else n - at
        there = min(m, (8 * len(bits.data) - bits.at) // total) if total else m
        if there < m and not copies:
            raise ValueError("the picture's bits end early")
        start = bits.at
        fields = bits.array(there, total)
        symbol = green[_ranks(fields[:, : lengths[0]])]
        k = int(np.argmax(symbol >= 256)) if copies and (symbol >= 256).any() else len(symbol)
        pixels, place = symbol[:k].astype(np.uint32) << np.uint32(8), lengths[0]
        for code, length, shift in zip(codes[1:4], lengths[1:], (16, 0, 24), strict=True):
            pixels |= code.symbols.astype(np.uint32)[_ranks(fields[:k, place : place + length])] << np.uint32(shift)
            place += length
        out[at : at + k] = pixels
        at += k
        bits.at = start + k * total
        if k == m:
            step *= 2
        else:
            step = 512
            length = _extra(bits, codes[0].read(bits) - 256)
            back = _back(_extra(bits, codes[4].read(bits)), width)
            if back > at or at + length > n:
                raise ValueError("a back-reference that leaves the picture")
            out[at : at + length] = out[at - back : at - back + length] if back >= length else np.resize(out[at - back : at], length)
            at += length
    return out


def _ranks(fields: np.ndarray) -> np.ndarray:
    """Numbers of rows of bits, the first bit on top."""
    rank = np.zeros(len(fields), np.uint8 if fields.shape[1] <= 8 else np.uint16)
    for bit in range(fields.shape[1]):
        rank = rank << 1 | fields[:, bit]
    return rank


def _planes(pixels: np.ndarray) -> np.ndarray:
    """Bytes of pixels as an array with blue, green, red, alpha in its last axis."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)


def _joined(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.astype(np.uint8)).view("<u4")[..., 0].astype(np.uint32)


def _predict(mode: int, left, top, right, corner) -> list[int]:
    def mean(a, b):
        return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]

    clip = lambda x: min(max(x, 0), 255)
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clip(a + t - c) for a, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clip(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]
    choice = {0: [0, 0, 0, 255], 1: left, 2: top, 3: right, 4: corner}
    if mode in choice:
        return choice[mode]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    return mean(*{6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}[mode]) if mode < 10 else [0, 0, 0, 255]


def _add_prediction(pixels: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width = pixels.shape
    rest, out = _planes(pixels).tolist(), []
    for y in range(height):
        row: list[list[int]] = []
        above = out[-1] if out else None
        for x in range(width):
            if not above:
                guess = row[x - 1] if x else [0, 0, 0, 255]
            elif not x:
                guess = above[0]
            else:
                mode = int(modes[y >> block, x >> block])
                guess = _predict(mode, row[x - 1], above[x], above[x + 1] if x + 1 < width else row[0], above[x - 1])
            row.append([(a + b) & 255 for a, b in zip(rest[y][x], guess, strict=True)])
        out.append(row)
    return _joined(np.array(out, np.uint8))


def _add_cross_colour(pixels: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    height, width = pixels.shape
    rows, columns = np.arange(height)[:, None] >> block, np.arange(width)[None] >> block
    f = _planes(factors).view(np.int8).astype(np.int32)[rows, columns]
    p = _planes(pixels).astype(np.int32)
    signed = lambda x: (x & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(p[..., 1])
    p[..., 2] = (p[..., 2] + (f[..., 0] * green >> 5)) & 255
    p[..., 0] = (p[..., 0] + (f[..., 1] * green >> 5) + (f[..., 2] * signed(p[..., 2]) >> 5)) & 255
    return _joined(p)


def _add_palette(pixels: np.ndarray, palette: np.ndarray, width: int, packed: int) -> np.ndarray:
    index = (pixels >> np.uint32(8)) & np.uint32(255)
    if packed:
        each = 8 >> packed
        shifts = np.arange(1 << packed, dtype=np.uint32) * np.uint32(each)
        index = ((index[..., None] >> shifts) & np.uint32((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """Pixels (height x width, unsigned 32 bits, alpha on top) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless WebP picture")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            block = bits.read(3) + 2
            across, down = ((x + (1 << block) - 1) >> block for x in (coded, height))
            table = _read_pixels(bits, across, down, False).reshape(down, across)
            undo.append((_add_prediction, (table >> np.uint32(8)) & np.uint32(15), block) if kind == 0 else (_add_cross_colour, table, block))
        elif kind == 2:
            undo.append((_add_green,))
        else:
            size = bits.read(8) + 1
            steps = _planes(_read_pixels(bits, size, 1, False))
            palette = _joined(np.cumsum(steps, axis=0, dtype=np.uint8))
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((_add_palette, palette, coded, packed))
            coded = (coded + (1 << packed) - 1) >> packed
    pixels = _read_pixels(bits, coded, height, True).reshape(height, coded)
    for step, *args in reversed(undo):
        pixels = step(pixels, *args)
    return pixels


def _add_green(pixels: np.ndarray) -> np.ndarray:
    p = _planes(pixels)
    p[..., 0] += p[..., 1]
    p[..., 2] += p[..., 1]
    return _joined(p)


class BitWriter:
    """Fields appended least significant bit first."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append(np.array([value >> i & 1 for i in range(n)], np.uint8))

    def bits(self, rows: np.ndarray) -> None:
        self.parts.append(rows.astype(np.uint8).ravel())

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def riff(picture: bytes) -> bytes:
    """The file around a picture's bits."""
    pad = b"\0" * (len(picture) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(picture) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(picture)) + picture + pad


#: Pixels of the shortest copy, and of a copy at most.
LEAST_COPY, MOST_COPY = 3, 4096


def _prefixed(value: int) -> tuple[int, int, int]:
    """Symbol, number of extra bits and extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 2
    return 2 * (n + 1) + (value - 1 >> n & 1), n, value - 1 & (1 << n) - 1


def _copies(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """Copies (place, length, pixels back), disjoint and in order: each place looks at the last one where the same pixels begin."""
    n = len(flat) - LEAST_COPY + 1
    if n < 2:
        return []
    key = flat[:n].astype(np.uint64)
    for k in range(1, LEAST_COPY):
        key = key * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + n]
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    place = order[again + 1]
    by = np.argsort(place)
    place, before = place[by], order[again][by]
    out, at = [], 0
    for c, b in zip(place.tolist(), before.tolist(), strict=True):
        if c < at:
            continue
        length, size = 0, 64
        while c + length < len(flat) and length < MOST_COPY:
            stop = min(c + length + size, len(flat), c + MOST_COPY)
            differ = np.flatnonzero(flat[c + length : stop] != flat[b + length : b + stop - c])
            length += int(differ[0]) if len(differ) else stop - c - length
            if len(differ):
                break
            size *= 4
        if length >= LEAST_COPY:
            out.append((c, length, c - b))
            at = c + length
    return out


class Uniform:
    """A prefix code that gives the used symbols, and unused ones up to a power of two, equal lengths."""

    def __init__(self, used: np.ndarray):
        n = int(used.sum())
        self.length = max(1, (n - 1).bit_length())
        spare = np.flatnonzero(~used)[: (1 << self.length) - n]
        self.used = used.copy()
        self.used[spare] = True
        self.rank = np.cumsum(self.used) - 1

    def write(self, w: BitWriter) -> None:
        """Lengths of the symbols: a 0 bit for none, a 1 bit for ``length``."""
        w.put(0, 1)
        order = [CODE_LENGTH_ORDER.index(0), CODE_LENGTH_ORDER.index(self.length)]
        w.put(max(order) - 3, 4)
        for i in range(max(order) + 1):
            w.put(int(i in order), 3)
        w.put(0, 1)
        w.bits(self.used)

    def fields(self, symbols: np.ndarray) -> np.ndarray:
        rank = self.rank[symbols].astype(">u2")
        return np.unpackbits(rank.view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - self.length :]


def _write_pixels(w: BitWriter, pixels: np.ndarray, main: bool) -> None:
    """Entropy-coded pixels: literals, and copies of pixels that repeat earlier ones."""
    flat, width = pixels.ravel(), pixels.shape[1]
    w.put(0, 1)  # no colour cache
    if main:
        w.put(0, 1)  # one group of codes
    copies = []
    for c, length, back in _copies(flat):
        copies.append((c, length, _prefixed(length), _prefixed({1: 2, width: 1}.get(back, back + 120))))
    # codes of equal lengths have a power of two symbols: at most 32 of the 40 distances, and 256 of the 280 greens and lengths
    often = np.bincount([back[0] for *_, back in copies], minlength=40).argsort(kind="stable")[::-1][:32]
    copies = [c for c in copies if c[3][0] in often]
    greens = np.bincount(_planes(flat)[:, 1], minlength=256) > 0
    if greens.sum() + len({size[0] for _, _, size, _ in copies}) > 256:
        copies = []
    literal = np.ones(len(flat), bool)
    for c, length, *_ in copies:
        literal[c : c + length] = False
    planes = _planes(flat[literal]).reshape(-1, 4)
    codes = []
    for channel, symbols in ((1, 280), (2, 256), (0, 256), (3, 256)):
        used = np.bincount(planes[:, channel], minlength=symbols) > 0
        if channel == 1:
            used[[256 + size[0] for _, _, size, _ in copies]] = True
        codes.append(Uniform(used))
        codes[-1].write(w)
    far = np.zeros(40, bool)
    far[[back[0] for *_, back in copies]] = True
    if copies:
        distance = Uniform(far)
        distance.write(w)
    else:
        for value, n in ((1, 1), (0, 1), (0, 1), (0, 1)):  # distances: one symbol, never read
            w.put(value, n)
    rows = np.concatenate([c.fields(planes[:, k]) for c, k in zip(codes, (1, 2, 0, 3), strict=True)], axis=1)
    done = passed = 0
    for c, length, size, back in copies:
        literals = c - passed
        w.bits(rows[done : literals])
        done, passed = literals, passed + length
        for code, base, (symbol, n, extra) in ((codes[0], 256, size), (distance, 0, back)):
            w.bits(code.fields(np.array([base + symbol])))
            w.put(extra, n)
    w.bits(rows[done:])


def _width(values: np.ndarray) -> int:
    return max(1, (int((np.bincount(values, minlength=256) > 0).sum()) - 1).bit_length())


def encode(pixels: np.ndarray) -> bytes:
    """A lossless WebP file: by cost a palette, green subtracted from red and blue, or neither, then literals and copies under codes of equal lengths."""
    height, width = pixels.shape
    w = BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    planes = _planes(pixels).reshape(-1, 4)
    plain = sum(_width(planes[:, k]) for k in range(4))
    less = planes[:, (0, 2)] - planes[:, 1:2]
    turned = _width(planes[:, 1]) + _width(planes[:, 3]) + _width(less[:, 0]) + _width(less[:, 1])
    kinds = np.unique(pixels)
    packed = 3 if len(kinds) <= 2 else 2 if len(kinds) <= 4 else 1 if len(kinds) <= 16 else 0
    by_index = 3 + 32 * len(kinds) + 1100 + pixels.size * (max(1, (len(kinds) - 1).bit_length()) + 3)  # a code has a bit at least
    if len(kinds) <= 256 and by_index < pixels.size * min(plain, turned):
        w.put(1, 1)
        w.put(3, 2)
        w.put(len(kinds) - 1, 8)
        steps = _joined(np.diff(_planes(kinds), axis=0, prepend=np.zeros((1, 4), np.uint8)))
        _write_pixels(w, steps[None], False)
        index, across = np.searchsorted(kinds, pixels).astype(np.uint32), -(-width >> packed) if packed else width
        index = np.pad(index, ((0, 0), (0, (across << packed) - width))).reshape(height, across, 1 << packed)
        each = np.arange(1 << packed, dtype=np.uint32) * np.uint32(8 >> packed)
        pixels = np.uint32(0xFF000000) | (index << each).sum(2, dtype=np.uint32) << np.uint32(8)
    elif turned < plain:
        w.put(1, 1)
        w.put(2, 2)
        rest = planes.copy()
        rest[:, 0], rest[:, 2] = less[:, 0], less[:, 1]
        pixels = _joined(rest).reshape(height, width)
    w.put(0, 1)
    _write_pixels(w, pixels, True)
    return riff(w.bytes())


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES - len(data))


def store(payload: bytes) -> bytes:
    """A payload (a positive multiple of ROW_BYTES) as a picture, a row for ROW_BYTES bytes; wider beyond the largest height."""
    rows = len(payload) // ROW_BYTES
    wide = -(-rows // LARGEST)
    height = -(-rows // wide)
    filled = payload + b"\xff" * (height * wide * ROW_BYTES - len(payload))
    return encode(np.frombuffer(filled, "<u4").reshape(height, -1))


def restore(media: bytes, payload_bytes: int) -> bytes:
    return decode(media).astype("<u4").tobytes()[:payload_bytes]


def feature(payload: bytes) -> str:
    """64 bits as 16 hex digits: which of 64 equal stretches of the samples are brighter than the whole."""
    samples = np.frombuffer(payload, np.uint8)
    means = np.add.reduceat(samples.astype(np.int64), np.arange(64) * len(samples) // 64)
    sizes = np.diff(np.append(np.arange(64) * len(samples) // 64, len(samples)))
    return np.packbits(means * len(samples) > samples.sum(dtype=np.int64) * sizes).tobytes().hex()


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"


def store_texts(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Store each text of ``docs`` (doc_id, text) as a lossless WebP file, read it back and describe it (MEDIA).

    The payload is the UTF-8 text with bytes 255 up to a positive multiple of
    ROW_BYTES; null counts as empty. All digests and the feature come from the bytes
    that the decoder gives back. Rows are handled one by one: repeated rows give equal
    rows, an empty table an empty result, and other columns are ignored.
    """

    def stored(batches):
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = text.encode()
                payload = padded(data)
                media = store(payload)
                back = restore(media, len(payload))
                row = (doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back))
                rows.append((*row, media) if keep_media else row)
                if len(rows) == 256:
                    yield _batch(rows)
                    rows.clear()
        if rows:
            yield _batch(rows)

    schema = MEDIA if keep_media else MEDIA.rpartition(",")[0]

    def _batch(rows):
        fields = [x.split() for x in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(stored, schema)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document stored as a picture; contract of op9."""
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_media=False)
