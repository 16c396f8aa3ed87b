"""Lossless WebP (VP8L): decoder for the whole format and an encoder, in numpy.

The decoder reads prefix codes (simple, normal, and groups chosen by an entropy
image), back-references with the short-distance map, the colour cache, and the
predictor, cross-colour, subtract-green and palette transforms. Images are
arrays ``uint32[height, width]`` of ARGB.

Streams whose only varying channel is green, with one group and no cache, as
:func:`encode_samples` writes them, are decoded without a step per pixel and
channel: code lengths are looked up for every bit position at once, one
light walk, of four literals a step, finds the positions where codes start, and back-references are copied as wholes.
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

# Fixed values of the format.
SIGNATURE, MAX_SIDE = 0x2F, 1 << 14
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
CACHE_MULTIPLIER = 0x1E35A7BD
#: (x, y) of the 120 short distances.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)

_U32 = np.uint32


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Huffman lengths of at most ``longest`` bits; one used symbol has length 1."""
    used = np.flatnonzero(counts).tolist()
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    floor = 1
    while True:
        heap = [(max(int(counts[s]), floor), s) for s in used]
        parent: dict[int, int] = {}
        heapq.heapify(heap)
        node = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = node
            heapq.heappush(heap, (a[0] + b[0], node))
            node += 1
        level = {node - 1: 0}
        for x in range(node - 2, len(counts) - 1, -1):
            level[x] = level[parent[x]] + 1
        depth = {s: level[parent[s]] + 1 for s in used}
        if max(depth.values()) <= longest:
            out[used] = [depth[s] for s in used]
            return out
        floor = floor * 2 if floor > 1 else max(2, int(counts.sum()) >> longest)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes, first bit lowest, as the stream holds them."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), dtype=np.uint32)
    if len(order):
        longest = int(lengths[order[-1]])
        spans = 1 << (longest - lengths[order].astype(np.int64))
        codes[order] = _bit_reversal(longest)[np.cumsum(spans) - spans]  # what a code's span starts with, padded by zeros
    return codes


_reversed_bits: dict[int, np.ndarray] = {}


def _bit_reversal(bits: int) -> np.ndarray:
    if bits not in _reversed_bits:
        x, out = np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64)
        for k in range(bits):
            out |= ((x >> k) & 1) << (bits - 1 - k)
        _reversed_bits[bits] = out
    return _reversed_bits[bits]


_NO_BITS = np.zeros(1, np.uint8)


class PrefixCode:
    """Decoding table over ``bits`` bits: symbol and length of what starts there."""

    __slots__ = ("bits", "symbols", "lengths", "single")

    @classmethod
    def of_one(cls, symbol: int) -> PrefixCode:
        """The code of a symbol that takes no bits."""
        code = cls.__new__(cls)
        code.single, code.bits, code.symbols, code.lengths = symbol, 0, np.array([symbol]), _NO_BITS
        return code

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.single, self.bits = int(used[0]) if len(used) else 0, 0
            self.symbols, self.lengths = np.array([self.single]), np.zeros(1, np.uint8)
            return
        self.single = None
        self.bits = int(lengths.max())
        order = used[np.lexsort((used, lengths[used]))]
        spans = 1 << (self.bits - lengths[order].astype(np.int64))
        if int(spans.sum()) != 1 << self.bits:
            raise ValueError("prefix code is not complete")
        back = _bit_reversal(self.bits)
        self.symbols = np.repeat(order, spans)[back]
        self.lengths = np.repeat(lengths[order], spans)[back].astype(np.uint8)


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.value, self.have, self.next = 0, 0, 0

    def _fill(self, n: int) -> None:
        while self.have < n:
            chunk = self.data[self.next : self.next + 64] or b"\0" * 8
            self.value |= int.from_bytes(chunk, "little") << self.have
            self.have += 8 * len(chunk)
            self.next += len(chunk)
            if self.next > len(self.data) + 64:
                raise ValueError("stream ends early")

    def read(self, n: int) -> int:
        self._fill(n)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.have -= n
        self.at += n
        return out

    def symbol(self, code: PrefixCode) -> int:
        if code.single is not None:
            return code.single
        self._fill(code.bits)
        at = self.value & ((1 << code.bits) - 1)
        n = int(code.lengths[at])
        self.value >>= n
        self.have -= n
        self.at += n
        return int(code.symbols[at])

    def seek(self, bit: int) -> None:
        self.at, self.next = bit, bit >> 3
        self.value = self.have = 0
        self._fill(8)
        self.value >>= bit & 7
        self.have -= bit & 7


# ---------------------------------------------------------------- decoder


def _read_code(r: BitReader, size: int) -> PrefixCode:
    lengths = np.zeros(size, dtype=np.uint8)
    if r.read(1):
        n, wide = r.read(1) + 1, r.read(1)
        first = r.read(8 if wide else 1)
        if n == 1:
            return PrefixCode.of_one(first)
        symbols = [first] + ([r.read(8)] if n == 2 else [])
        lengths[symbols] = 1
        return PrefixCode(lengths)
    n = 4 + r.read(4)
    meta = np.zeros(19, dtype=np.uint8)
    for k in range(n):
        meta[CODE_LENGTH_ORDER[k]] = r.read(3)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    code, at, previous = PrefixCode(meta), 0, 8
    while at < size and left:
        left -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[at] = s
            at += 1
            previous = s or previous
            continue
        value, times = (previous, 3 + r.read(2)) if s == 16 else (0, 3 + r.read(3)) if s == 17 else (0, 11 + r.read(7))
        if at + times > size:
            raise ValueError("code lengths overrun")
        lengths[at : at + times] = value
        at += times
    return PrefixCode(lengths)


def _read_group(r: BitReader, cache_bits: int) -> list[PrefixCode]:
    green = 256 + 24 + ((1 << cache_bits) if cache_bits else 0)
    return [_read_code(r, n) for n in (green, 256, 256, 256, 40)]


def _prefix_value(r: BitReader, s: int) -> int:
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + r.read(extra) + 1


def _distance(d: int, width: int) -> int:
    """Pixels back, of a distance code."""
    if d > 120:
        return d - 120
    x, y = NEAR[d - 1]
    return max(1, x + y * width)


def _doubled(size: np.ndarray) -> np.ndarray:
    """Bits of twice as many literals from each position on, of those of some from each; 0 where another code comes first. The last 64 are 0."""
    after = size[np.minimum(np.arange(len(size)) + size, len(size) - 1)]
    return np.where((size > 0) & (after > 0), size + after, 0).astype(np.uint8)


def _green_stream(r: BitReader, code: PrefixCode, far: PrefixCode, n: int, width: int) -> np.ndarray:
    """``n`` values of the green channel, from literals and back-references of one code."""
    if code.single is not None and code.single < 256:
        return np.full(n, code.single)
    start = r.at
    raw = np.frombuffer(r.data + b"\0" * 8, np.uint8)[start >> 3 :].astype(np.uint32)
    word = raw[:-3] | (raw[1:-2] << _U32(8)) | (raw[2:-1] << _U32(16))
    mask = _U32((1 << code.bits) - 1)
    literal = np.where(code.symbols < 256, code.lengths, 0).astype(np.uint8)
    size = np.empty((len(word), 8), dtype=np.uint8)
    for k in range(8):
        size[:, k] = literal[(word >> _U32(k)) & mask]
    size = np.concatenate([size.reshape(-1), np.zeros(64, np.uint8)])
    sizes, four = size[:-64].tobytes(), _doubled(_doubled(size))[:-64].tobytes()
    at, p, count = [], start & 7, 0  # where four literals start, or ~ where one does
    put = at.append
    copies = []  # (literals before, length, pixels back)
    copied, most = 0, n - 3
    try:
        while count < n:
            size_here = four[p]
            if size_here and count < most:
                put(p)
                p += size_here
                count += 4
                continue
            size_here = sizes[p]
            if size_here:
                put(~p)
                p += size_here
                count += 1
                continue
            r.seek((start & ~7) + p)
            length = _prefix_value(r, r.symbol(code) - 256)
            d = _distance(_prefix_value(r, r.symbol(far)), width)
            if d > count or count + length > n:
                raise ValueError("back-reference outside the image")
            copies.append((count - copied, length, d))
            copied += length
            count += length
            p = r.at - (start & ~7)
    except IndexError:
        raise ValueError("stream ends early") from None
    first = np.array(at, dtype=np.int64)
    one = first < 0
    places = np.empty((len(first), 4), dtype=np.int64)
    places[:, 0] = np.where(one, ~first, first)
    for k in range(3):
        places[:, k + 1] = places[:, k] + size[np.minimum(places[:, k], len(size) - 1)]
    kept = np.ones(places.shape, dtype=bool)
    kept[one, 1:] = False
    places = places[kept]
    r.seek((start & ~7) + p)
    values = code.symbols[(word[places >> 3] >> (places & 7).astype(np.uint32)) & mask]
    if not copies:
        return values
    out, k, seen = np.empty(n, dtype=np.int64), 0, 0
    for before, length, d in copies:
        out[k : k + before - seen] = values[seen:before]
        k, seen = k + before - seen, before
        if d >= length:
            out[k : k + length] = out[k - d : k - d + length]
        else:
            out[k : k + length] = np.resize(out[k - d : k], length)
        k += length
    out[k:] = values[seen:]
    return out


def _read_pixels(r: BitReader, width: int, height: int, top: bool) -> np.ndarray:
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    meta_bits, meta, groups = 0, None, 1
    if top and r.read(1):
        meta_bits = r.read(3) + 2
        meta = (_read_pixels(r, -(-width // (1 << meta_bits)), -(-height // (1 << meta_bits)), False) >> _U32(8)) & _U32(0xFFFF)
        groups = int(meta.max()) + 1
    codes = [_read_group(r, cache_bits) for _ in range(groups)]
    n = width * height
    green, red, blue, alpha, far = codes[0]
    if groups == 1 and not cache_bits and None not in (red.single, blue.single, alpha.single) and (green.single or 0) < 256:
        rest = (alpha.single << 24) | (red.single << 16) | blue.single
        return ((_green_stream(r, green, far, n, width).astype(np.uint32) << _U32(8)) | _U32(rest)).reshape(height, width)
    out: list[int] = []
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift, cached = 32 - cache_bits, 0

    def catch_up():
        nonlocal cached
        for argb in out[cached:]:
            cache[((CACHE_MULTIPLIER * argb) & 0xFFFFFFFF) >> shift] = argb
        cached = len(out)

    while len(out) < n:
        k = len(out)
        group = codes[0] if meta is None else codes[int(meta[(k // width) >> meta_bits, (k % width) >> meta_bits])]
        s = r.symbol(group[0])
        if s < 256:
            red, blue, alpha = (r.symbol(c) for c in group[1:4])
            out.append((alpha << 24) | (red << 16) | (s << 8) | blue)
        elif s < 280:
            length = _prefix_value(r, s - 256)
            d = _distance(_prefix_value(r, r.symbol(group[4])), width)
            if d > k or k + length > n:
                raise ValueError("back-reference outside the image")
            for _ in range(length):
                out.append(out[-d])
        else:
            catch_up()
            out.append(cache[s - 280])
    return np.array(out, dtype=np.uint32).reshape(height, width)


def _channels(argb: np.ndarray) -> np.ndarray:
    """int16[..., 4] as alpha, red, green, blue."""
    return np.stack([(argb >> _U32(s)) & _U32(0xFF) for s in (24, 16, 8, 0)], axis=-1).astype(np.int16)


def _argb(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32) & _U32(0xFF)
    return (c[..., 0] << _U32(24)) | (c[..., 1] << _U32(16)) | (c[..., 2] << _U32(8)) | c[..., 3]


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _half(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _split(a: int) -> tuple[int, int, int, int]:
    return a >> 24, a >> 16 & 255, a >> 8 & 255, a & 255


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for a, b, c in zip(_split(left), _split(top), _split(corner)):
        to_left += abs(b - c)
        to_top += abs(a - c)
    return left if to_left < to_top else top


def _full(a: int, b: int, c: int) -> int:
    out = 0
    for x, y, z in zip(_split(a), _split(b), _split(c)):
        out = out << 8 | _clamp(x + y - z)
    return out


def _halfway(a: int, b: int) -> int:
    out = 0
    for x, y in zip(_split(a), _split(b)):
        out = out << 8 | _clamp(x + int((x - y) / 2))
    return out


#: Predictions from left, top, top right and top left.
MODES = (
    lambda l, t, r, c: 0xFF000000,
    lambda l, t, r, c: l,
    lambda l, t, r, c: t,
    lambda l, t, r, c: r,
    lambda l, t, r, c: c,
    lambda l, t, r, c: _half(_half(l, r), t),
    lambda l, t, r, c: _half(l, c),
    lambda l, t, r, c: _half(l, t),
    lambda l, t, r, c: _half(c, t),
    lambda l, t, r, c: _half(t, r),
    lambda l, t, r, c: _half(_half(l, c), _half(t, r)),
    lambda l, t, r, c: _select(l, t, c),
    lambda l, t, r, c: _full(l, t, c),
    lambda l, t, r, c: _halfway(_half(l, t), c),
)


def _prediction(flat: list[int], k: int, width: int, mode: int) -> int:
    x = k % width
    if k == 0:
        return 0xFF000000
    if k < width:
        return flat[k - 1]
    if x == 0:
        return flat[k - width]
    # in the last column the pixel after `top` is the first one of this row
    return MODES[mode if mode < 14 else 0](flat[k - 1], flat[k - width], flat[k - width + 1], flat[k - width - 1])


def unpredict(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    only = np.unique((modes >> _U32(8)) & _U32(15))
    if len(only) == 1 and only[0] in (1, 2):  # left or top everywhere: running sums
        c = _channels(argb).astype(np.int64)
        c[0, 0, 0] += 255
        if only[0] == 1:
            c[:, 0] = np.cumsum(c[:, 0], axis=0)
            return _argb(np.cumsum(c, axis=1) & 0xFF)
        c[0] = np.cumsum(c[0], axis=0)
        return _argb(np.cumsum(c, axis=0) & 0xFF)
    residual, flat = argb.reshape(-1).tolist(), []
    kinds = ((modes >> _U32(8)) & _U32(15)).tolist()
    for k, d in enumerate(residual):
        flat.append(_add(d, _prediction(flat, k, width, kinds[(k // width) >> bits][(k % width) >> bits])))
    return np.array(flat, dtype=np.uint32).reshape(height, width)


def predict(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """The residuals that :func:`unpredict` undoes."""
    height, width = argb.shape
    flat, out = argb.reshape(-1).tolist(), []
    kinds = ((modes >> _U32(8)) & _U32(15)).tolist()
    for k, v in enumerate(flat):
        p = _prediction(flat, k, width, kinds[(k // width) >> bits][(k % width) >> bits])
        out.append((((v | 0x00FF00FF) - (p & 0xFF00FF00)) & 0xFF00FF00) | (((v | 0xFF00FF00) - (p & 0x00FF00FF)) & 0x00FF00FF))
    return np.array(out, dtype=np.uint32).reshape(height, width)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def _spread(small: np.ndarray, bits: int, shape: tuple[int, int]) -> np.ndarray:
    return np.repeat(np.repeat(small, 1 << bits, axis=0), 1 << bits, axis=1)[: shape[0], : shape[1]]


def cross_colour(argb: np.ndarray, elements: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """Adds (undo) or subtracts what green tells of red and blue, and red of blue."""
    c = _channels(argb).astype(np.int32)
    e = _channels(_spread(elements, bits, argb.shape))
    red_to_blue, green_to_blue, green_to_red = e[..., 1], e[..., 2], e[..., 3]
    delta = lambda t, x: (_signed(t) * _signed(x)) >> 5
    sign = 1 if undo else -1
    red = (c[..., 1] + sign * delta(green_to_red, c[..., 2])) & 0xFF
    true_red = red if undo else c[..., 1]
    blue = (c[..., 3] + sign * (delta(green_to_blue, c[..., 2]) + delta(red_to_blue, true_red))) & 0xFF
    return _argb(np.stack([c[..., 0], red, c[..., 2], blue], axis=-1))


def subtract_green(argb: np.ndarray, undo: bool) -> np.ndarray:
    c = _channels(argb)
    sign = 1 if undo else -1
    return _argb(np.stack([c[..., 0], c[..., 1] + sign * c[..., 2], c[..., 2], c[..., 3] + sign * c[..., 2]], axis=-1))


def palette_bits(n: int) -> int:
    """Log2 of the pixels that share one green value."""
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def unpalette(argb: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    b = palette_bits(len(colours))
    green = ((argb >> _U32(8)) & _U32(0xFF)).astype(np.int64)
    if b:
        each = 8 >> b
        green = ((green[:, :, None] >> (each * np.arange(1 << b))) & ((1 << each) - 1)).reshape(len(green), -1)[:, :width]
    return np.concatenate([colours, np.zeros(256, np.uint32)])[green]


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels of a lossless WebP file, plain or in an extended container."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if len(data) < at + 8 or data[at : at + 4] == b"VP8 ":
            raise ValueError("not a lossless WebP file")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1) // 2 * 2
    size = struct.unpack_from("<I", data, at + 4)[0]
    r = BitReader(data[at + 8 : at + 8 + size])
    if r.read(8) != SIGNATURE:
        raise ValueError("wrong signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    now, steps = width, []
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            small = _read_pixels(r, -(-now // (1 << bits)), -(-height // (1 << bits)), False)
            steps.append((kind, now, bits, small))
        elif kind == PALETTE:
            n = r.read(8) + 1
            delta = _channels(_read_pixels(r, n, 1, False))
            colours = _argb(np.cumsum(delta, axis=1))[0]
            steps.append((kind, now, 0, colours))
            now = -(-now // (1 << palette_bits(n)))
        else:
            steps.append((kind, now, 0, None))
    argb = _read_pixels(r, now, height, True)
    for kind, wide, bits, extra in reversed(steps):
        if kind == PREDICTOR:
            argb = unpredict(argb, extra, bits)
        elif kind == CROSS_COLOUR:
            argb = cross_colour(argb, extra, bits, True)
        elif kind == SUBTRACT_GREEN:
            argb = subtract_green(argb, True)
        else:
            argb = unpalette(argb, extra, wide)
    return argb


# ---------------------------------------------------------------- encoder


class BitWriter:
    def __init__(self):
        self.value, self.n, self.done = 0, 0, []

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n > 4096:
            whole = self.n >> 3
            self.done.append((self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def many(self, codes: np.ndarray, lengths: np.ndarray) -> None:
        """Codes of at most 15 bits, four at a time in a word, and words at their bit offset."""
        pad = -len(codes) % 4
        c = np.concatenate([codes, np.zeros(pad, codes.dtype)]).astype(np.uint64).reshape(-1, 2)
        n = np.concatenate([lengths, np.zeros(pad, lengths.dtype)]).astype(np.uint64).reshape(-1, 2)
        for _ in range(2):
            c, n = c[:, 0] | (c[:, 1] << n[:, 0]), n[:, 0] + n[:, 1]
            if _ == 0:
                c, n = c.reshape(-1, 2), n.reshape(-1, 2)
        end = np.cumsum(n) + np.uint64(self.n)
        at = end - n
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        total = int(end[-1])
        out = np.zeros((total >> 6) + 2, dtype=np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(c << shift, first)
        high = np.where(shift > 0, c >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        out[word[first] + 1] |= np.bitwise_or.reduceat(high, first)
        raw = bytearray(out.tobytes())
        for k, b in enumerate(self.value.to_bytes((self.n + 7) // 8, "little")):
            raw[k] |= b
        whole = total >> 3
        self.done.append(bytes(raw[:whole]))
        self.value, self.n = raw[whole] & ((1 << (total & 7)) - 1), total & 7

    def bytes(self) -> bytes:
        return b"".join(self.done) + self.value.to_bytes((self.n + 7) // 8, "little")


def _write_code(w: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        w.write(1, 1)
        w.write(len(symbols) - 1, 1)
        w.write(1, 1)
        for s in symbols:
            w.write(s, 8)
        return
    items, k, size = [], 0, int(used[-1]) + 1
    values = lengths[:size].tolist()
    while k < size:
        run = 1
        while k + run < size and values[k + run] == values[k]:
            run += 1
        if values[k] == 0 and run >= 3:
            run = min(run, 138)
            items.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
        elif values[k] and k and values[k - 1] == values[k] and run >= 3:
            run = min(run, 6)
            items.append((16, run - 3, 2))
        else:
            items.append((values[k], 0, 0))
            run = 1
        k += run
    counts = np.bincount([s for s, _, _ in items], minlength=19)
    if (counts > 0).sum() < 2:  # a complete code has two symbols
        counts[[s for s in (0, 1) if not counts[s]][0]] += 1
    meta = code_lengths(counts, 7)
    w.write(0, 1)
    order = [int(meta[s]) for s in CODE_LENGTH_ORDER]
    n = max(4, max(k + 1 for k, x in enumerate(order) if x))
    w.write(n - 4, 4)
    for x in order[:n]:
        w.write(x, 3)
    if len(items) >= 2 and size < len(lengths):
        bits = max(2, (len(items) - 2).bit_length())
        bits += bits & 1
        w.write(1, 1)
        w.write((bits - 2) // 2, 3)
        w.write(len(items) - 2, bits)
    else:
        w.write(0, 1)
        if size < len(lengths):
            raise ValueError("code lengths end early")
    codes = canonical(meta)
    for s, extra, bits in items:
        w.write(int(codes[s]), int(meta[s]))
        if bits:
            w.write(extra, bits)


def _prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    extra = high - 1
    return 2 * high + second, v & ((1 << extra) - 1), extra


@functools.lru_cache(maxsize=64)
def _near(width: int) -> dict[int, int]:
    """Short codes of distances in pixels."""
    near: dict[int, int] = {}
    for code, (x, y) in enumerate(NEAR, 1):
        near.setdefault(max(1, x + y * width), code)
    return near


def _write_pixels(w: BitWriter, argb: np.ndarray, cache_bits: int = 0, references: bool = False, meta: tuple | None = None, top: bool = True) -> None:
    """An image; ``meta`` is (bits, group of each block) to use several prefix code groups."""
    height, width = argb.shape
    flat = argb.reshape(-1).tolist()
    tokens, k, recent = [], 0, {}
    cache = [0] * (1 << cache_bits) if cache_bits else None
    near = _near(width)

    def note(argb):
        if cache is not None:
            cache[((CACHE_MULTIPLIER * argb) & 0xFFFFFFFF) >> (32 - cache_bits)] = argb

    while k < len(flat):
        if references and k + 3 <= len(flat):
            key = tuple(flat[k : k + 3])
            before = recent.get(key)
            recent[key] = k
            if before is not None:
                n = 3
                while k + n < len(flat) and n < 4096 and flat[before + n] == flat[k + n]:
                    n += 1
                d = k - before
                tokens.append((k, "copy", n, near.get(d, d + 120)))
                for j in range(n):
                    note(flat[k + j])
                k += n
                continue
        v = flat[k]
        slot = ((CACHE_MULTIPLIER * v) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        tokens.append((k, "cached", slot, 0) if cache is not None and cache[slot] == v and k else (k, "pixel", v, 0))
        note(v)
        k += 1
    w.write(1 if cache_bits else 0, 1)
    if cache_bits:
        w.write(cache_bits, 4)
    if top:
        w.write(1 if meta else 0, 1)
    group_of = lambda k: 0
    groups = 1
    if meta:
        block_bits, blocks = meta
        w.write(block_bits - 2, 3)
        _write_pixels(w, blocks.astype(np.uint32) << _U32(8), top=False)
        groups = int(blocks.max()) + 1
        group_of = lambda k: int(blocks[(k // width) >> block_bits, (k % width) >> block_bits])
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(groups)]
    for k, kind, a, b in tokens:
        c = counts[group_of(k)]
        if kind == "pixel":
            for table, s in zip(c, (a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                table[s] += 1
        elif kind == "copy":
            c[0][256 + _prefix_of(a)[0]] += 1
            c[4][_prefix_of(b)[0]] += 1
        else:
            c[0][280 + a] += 1
    lengths = [[code_lengths(t, 15) for t in c] for c in counts]
    codes = []
    for group in lengths:
        for x in group:
            _write_code(w, x)
        codes.append([canonical(x) for x in group])
    for k, kind, a, b in tokens:
        g = group_of(k)

        def put(channel, s, g=g):
            if (lengths[g][channel] > 0).sum() > 1:
                w.write(int(codes[g][channel][s]), int(lengths[g][channel][s]))

        if kind == "pixel":
            for channel, s in enumerate((a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                put(channel, s)
        elif kind == "copy":
            for channel, base, value in ((0, 256, a), (4, 0, b)):
                s, extra, bits = _prefix_of(value)
                put(channel, base + s)
                w.write(extra, bits)
        else:
            put(0, 280 + a)


def _file(w: BitWriter) -> bytes:
    body = w.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(chunk) + 4) + b"WEBP" + chunk


def _start(width: int, height: int, alpha: int) -> BitWriter:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("image too large")
    w = BitWriter()
    w.write(SIGNATURE, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(alpha, 1)
    w.write(0, 3)
    return w


def encode(argb: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = False, meta: tuple | None = None) -> bytes:
    """A file of any pixels. Transforms, in order: ('predictor', bits, modes), ('cross', bits, elements), ('green',), ('palette',)."""
    height, width = argb.shape
    w = _start(width, height, 1)
    for name, *more in transforms:
        w.write(1, 1)
        if name in ("predictor", "cross"):
            bits, small = more
            w.write(PREDICTOR if name == "predictor" else CROSS_COLOUR, 2)
            w.write(bits - 2, 3)
            _write_pixels(w, small, top=False)
            argb = predict(argb, small, bits) if name == "predictor" else cross_colour(argb, small, bits, False)
        elif name == "green":
            w.write(SUBTRACT_GREEN, 2)
            argb = subtract_green(argb, False)
        else:
            colours = np.unique(argb)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            w.write(PALETTE, 2)
            w.write(len(colours) - 1, 8)
            c = _channels(colours[None])
            _write_pixels(w, _argb(np.diff(c, axis=1, prepend=0)), top=False)
            index, b = np.searchsorted(colours, argb), palette_bits(len(colours))
            if b:
                each, per = 8 >> b, 1 << b
                index = np.pad(index, ((0, 0), (0, -argb.shape[1] % per))).reshape(height, -1, per)
                index = (index << (each * np.arange(per))).sum(axis=2)
            argb = (index.astype(np.uint32) << _U32(8)) | _U32(0xFF000000)
    w.write(0, 1)
    _write_pixels(w, argb, cache_bits, references, meta)
    return _file(w)


#: Fewest samples of a back-reference of :func:`encode_samples`, and most of any.
LEAST_COPY, MOST_COPY = 12, 4096


def _copies(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, samples back) of repeats, from left to right: each where the last eight equal samples are."""
    n = len(flat) - 7
    if n < LEAST_COPY:
        return []
    raw = flat.tobytes()
    eight = np.ndarray((n,), "<u8", buffer=raw, strides=(1,))
    # sixteen bits of a hash are sorted in linear time; equal neighbours of one hash are compared as they are
    order = np.argsort(((eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16), kind="stable")
    sorted_eight = eight[order]
    same = sorted_eight[1:] == sorted_eight[:-1]
    if not same.any():
        return []
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:][same]] = order[:-1][same]
    out, end = [], 0
    at = np.flatnonzero(before[: n - LEAST_COPY + 8] >= 0)
    at = at[eight[at + LEAST_COPY - 8] == eight[before[at] + LEAST_COPY - 8]]  # of LEAST_COPY samples, which are at most sixteen
    for k in at.tolist():
        if k < end:
            continue
        j, length, most = int(before[k]), LEAST_COPY, min(MOST_COPY, len(flat) - k)
        while length < most:
            step = min(256, most - length)
            a, b = flat[k + length : k + length + step], flat[j + length : j + length + step]
            differ = a != b
            at = int(differ.argmax())
            if differ[at]:
                length += at
                break
            length += step
        out.append((k, length, k - j))
        end = k + length
    return out


def _bits_of(counts: np.ndarray) -> float:
    """Bits that symbols of these counts take at least."""
    c = counts[counts > 0].astype(float)
    return float((c * (np.log2(c.sum()) - np.log2(c))).sum())


def _write_green(w: BitWriter, flat: np.ndarray, width: int, alpha: int = 255) -> None:
    """The pixels of an image in which green alone varies: literals, and back-references where these take less."""
    w.write(0, 2)  # no colour cache, one group
    counts = np.bincount(flat, minlength=280)
    plain = _bits_of(counts)
    copies = _copies(flat)
    if copies:
        inside = np.zeros(len(flat), dtype=bool)
        for k, length, _ in copies:
            inside[k : k + length] = True
        near = _near(width)
        heads = [(_prefix_of(length), _prefix_of(near.get(d, d + 120))) for _, length, d in copies]
        with_copies = np.bincount(flat[~inside], minlength=280) + np.bincount([256 + a[0] for a, _ in heads], minlength=280)
        far = np.bincount([b[0] for _, b in heads], minlength=40)
        if _bits_of(with_copies) + _bits_of(far) + sum(a[2] + b[2] for a, b in heads) + 4 * (far > 0).sum() + 40 >= plain:
            copies = []
    if not copies:
        lengths = code_lengths(counts, 12)
        _write_code(w, lengths)
        _write_rest(w, alpha, None)
        if (lengths > 0).sum() > 1:
            w.many(canonical(lengths)[flat], lengths[flat])
        return
    lengths, far_lengths = code_lengths(with_copies, 12), code_lengths(far, 12)
    _write_code(w, lengths)
    _write_rest(w, alpha, far_lengths)
    codes, far_codes = canonical(lengths), canonical(far_lengths)
    one_far = (far_lengths > 0).sum() == 1
    # literals, and five entries for a back-reference: length, its extra bits, distance, its extra bits in two
    literal = flat[~inside]
    (s, extra, bits), (t, more, far_bits) = (np.array(x, dtype=np.int64).T for x in zip(*heads))
    values = np.stack([codes[256 + s], extra, 0 * t if one_far else far_codes[t], more & 0x7FF, more >> 11], axis=1)
    sizes = np.stack([lengths[256 + s], bits, 0 * t if one_far else far_lengths[t], np.minimum(far_bits, 11), np.maximum(0, far_bits - 11)], axis=1)
    starts, long = np.array([(k, length) for k, length, _ in copies], dtype=np.int64).T
    at = starts - (np.cumsum(long) - long)  # literals before
    at = (at + 5 * np.arange(len(copies)))[:, None] + np.arange(5)
    single = np.ones(len(literal) + at.size, dtype=bool)
    single[at] = False
    all_values, all_sizes = np.empty(len(single), np.uint32), np.empty(len(single), np.uint8)
    all_values[single], all_sizes[single] = codes[literal], lengths[literal]
    all_values[at], all_sizes[at] = values, sizes
    w.many(all_values, all_sizes)


def _write_rest(w: BitWriter, alpha: int, far: np.ndarray | None) -> None:
    """Codes of the channels that do not vary, and of distances."""
    for s in (0, 0, alpha):
        w.write(5 | s << 3, 11)  # a simple code of one symbol of eight bits
    if far is None:
        far = np.zeros(40, np.uint8)
        far[0] = 1
    _write_code(w, far)


def encode_samples(samples: np.ndarray) -> bytes:
    """A file of 8-bit samples ``uint8[height, width]`` in the green channel.

    Samples of at most 16 values go through a palette, several to a pixel; others are predicted from their left or
    upper neighbour where the differences take fewer bits than the samples.
    """
    height, width = samples.shape
    w = _start(width, height, 0)
    counts = np.bincount(samples.reshape(-1), minlength=256)
    values = np.flatnonzero(counts)
    if len(values) <= 16:
        w.write(1, 1)
        w.write(PALETTE, 2)
        w.write(len(values) - 1, 8)
        colours = (values.astype(np.uint32) << _U32(8)) | _U32(0xFF000000)
        _write_pixels(w, _argb(np.diff(_channels(colours[None]), axis=1, prepend=0)), top=False)
        b = palette_bits(len(values))
        each, per = 8 >> b, 1 << b
        index = np.searchsorted(values, np.pad(samples, ((0, 0), (0, -width % per)), constant_values=values[0])).reshape(height, -1, per)
        samples = (index << (each * np.arange(per))).sum(axis=2).astype(np.uint8)
    else:
        left, top = samples.copy(), samples.copy()
        left[:, 1:] -= samples[:, :-1]
        top[1:] -= samples[:-1]
        left[1:, 0], top[0] = top[1:, 0], left[0]
        bits = [_bits_of(np.bincount(x.reshape(-1), minlength=256)) for x in (left, top)]
        if min(bits) < 0.97 * _bits_of(counts) - 100:
            mode = 1 + int(bits[1] < bits[0])
            w.write(1, 1)
            w.write(PREDICTOR, 2)
            w.write(7, 3)  # blocks of the largest size, all of one mode
            _write_pixels(w, np.full((-(-height // 512), -(-width // 512)), mode << 8, dtype=np.uint32), top=False)
            w.write(0, 1)
            # the first pixel is predicted to be opaque, so alpha leaves 0
            _write_green(w, (left, top)[mode - 1].reshape(-1), width, 0)
            return _file(w)
    w.write(0, 1)
    _write_green(w, np.ascontiguousarray(samples).reshape(-1), samples.shape[1])
    return _file(w)


def decode_samples(data: bytes) -> np.ndarray:
    return ((decode(data) >> _U32(8)) & _U32(0xFF)).astype(np.uint8)
