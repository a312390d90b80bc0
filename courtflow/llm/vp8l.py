"""Lossless WebP (VP8L) codec on numpy arrays, by the published format (RFC 9649).

Decoding reads prefix codes, back-references and colour cache, and undoes the predictor, cross-colour,
subtract-green and palette transforms. Images of one group of prefix codes are decoded many pixels at a time: for every
bit it is worked out where a pixel's codes that begin there would end, jumps of 16 pixels are composed from those, and the
places between follow; back-references and cache entries are then pointers to pixels before, resolved by doubling. Images
with meta prefix codes take the loop over pixels. `encode_best` chooses transforms, cache and references for each
image by size; `encode` writes any image with given ones.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Distance codes 1 to 120: (x, y) of the pixel meant, y rows up and x to the left.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_ORDER = np.array(CODE_LENGTH_ORDER)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LARGEST_SIDE = 1 << 14
ALPHABETS = (256 + 24, 256, 256, 256, 40)
#: The farthest back-reference: the last of the 40 prefix codes of distances ends at 2**20, and 120 numbers are those of near pixels.
FARTHEST = (1 << 20) - len(NEAR)


# ---- bits


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        a, self.at = self.at, self.at + n
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)


class Writer:
    """Bits from the lowest on; parts are kept as (value, bits) and joined at the end."""

    def __init__(self):
        self.value, self.bits = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.bits
        self.bits += n

    def append(self, words: np.ndarray, n: int) -> None:
        """n bits of little-endian bytes."""
        self.value |= int.from_bytes(words.tobytes(), "little") << self.bits
        self.bits += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.bits + 7) >> 3, "little")


# ---- prefix codes


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of a complete prefix code of at most `longest` bits; a single symbol gets 1.

    Each symbol gets its bits rounded up, and then the room that is left goes to those that gain most from a bit less.
    """
    used = counts.nonzero()[0]
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    own = counts[used]
    ideal = np.log2(int(own.sum()) / own)
    n = np.minimum(np.maximum(np.ceil(ideal), 1), longest).astype(np.int64)
    room = (1 << longest) - int((1 << (longest - n)).sum())
    while room < 0:  # rare symbols were cut to the longest code: all others give a bit, until there is room
        n = np.minimum(n + 1, longest)
        room = (1 << longest) - int((1 << (longest - n)).sum())
    # who lost most by rounding up, for the room it takes, comes first
    order = (ideal - n).argsort(kind="stable").tolist()
    sizes = n.tolist()
    while room:
        for i in order:
            if sizes[i] > 1 and (need := 1 << (longest - sizes[i])) <= room:
                sizes[i] -= 1
                room -= need
                if not room:
                    break
    lengths[used] = sizes
    return lengths


def _reversed_bits(bits: int) -> np.ndarray:
    """0..2**bits-1 with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


_REVERSED = [_reversed_bits(n) for n in range(16)]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol, bit-reversed, as the stream has them."""
    codes, used = np.zeros(len(lengths), np.int64), lengths.nonzero()[0]
    n = lengths[used]
    order = n.argsort(kind="stable")
    spans = np.int64(1) << (15 - n[order])  # of 15-bit numbers that begin with the code
    codes[used[order]] = _REVERSED[15].take(spans.cumsum() - spans)
    return codes


class Code:
    """Decoding table: 16 * symbol + length by the next `bits` bits. A code of one symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        self.only = int(used[0]) if len(used) == 1 else None
        if len(used) == 1:
            self.bits, self.table = 0, used << 4
            return
        n = lengths[used]
        spans = np.int64(1) << (15 - n)
        if int(spans.sum()) != 1 << 15:
            raise ValueError("not a complete prefix code")
        self.bits = int(n.max())
        order = n.argsort(kind="stable")
        self.table = (used << 4 | n)[order].repeat(spans[order] >> (15 - self.bits)).take(_REVERSED[self.bits])

    def read(self, r: Reader) -> int:
        if self.only is not None:
            return self.only
        a = r.at
        i = int.from_bytes(r.data[a >> 3 : (a >> 3) + 3], "little") >> (a & 7) & ((1 << self.bits) - 1)
        found = int(self.table[i])
        r.at = a + (found & 15)
        return found >> 4


@lru_cache(maxsize=512)
def _only(symbol: int) -> Code:
    """The code of one symbol."""
    return Code(np.bincount([symbol]))


#: Of the symbols of code lengths: the length meant, the least times it is repeated, and the extra bits that say how many more.
_MEANT, _LEAST, _MORE = (np.array(x) for x in ([*range(16), 0, 0, 0], [1] * 16 + [3, 3, 11], [0] * 16 + [2, 3, 7]))


@lru_cache(maxsize=64)
def _length_code(packed: int, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The code of code lengths: symbols, their bits and those with the extra ones, by the next bits; whether one repeats the last length."""
    lengths = np.zeros(19, np.int64)
    lengths[_ORDER[:many]] = [packed >> 3 * k & 7 for k in range(many)]
    table = Code(lengths).table
    return table >> 4, table & 15, (table & 15) + _MORE[table >> 4], bool(lengths[16])


def read_code(r: Reader, alphabet: int) -> Code:
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        symbol = r.read(8 if wide else 1)
        if not two:
            return _only(symbol)
        lengths = np.zeros(alphabet, np.int64)
        lengths[[symbol, r.read(8)]] = 1
        return Code(lengths)
    many = 4 + r.read(4)
    symbols, sizes, hops, repeats = _length_code(r.read(3 * many), many)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    data, end = np.frombuffer(r.data + bytes(4), np.uint8), len(r.data) * 8 - r.at
    for most in (160 if alphabet < 256 else 460 if alphabet == 256 else 1000, 16 * alphabet + 64):  # few codes are longer than the first
        count = max(0, min(most, end))
        ahead = _window(data, r.at, count, 14)
        at = ahead & (len(symbols) - 1)
        to, path, p = (hops.take(at) + _PLACES[:count]).tolist(), [], 0
        for _ in range(left):
            if p >= count:
                break
            path.append(p)
            p = to[p]
        if not path:
            break
        at = at.take(path)
        symbol = symbols.take(at)
        again = _LEAST.take(symbol) + (ahead.take(path + sizes.take(at), mode="clip") & ((1 << _MORE.take(symbol)) - 1))
        ends = again.cumsum()
        n = int(ends.searchsorted(alphabet)) + 1  # symbols up to the alphabet's end
        if n < len(path):
            p = path[n]
        if p > count or n > len(path) and len(path) < left:
            continue
        symbol, again = symbol[:n], again[:n]
        value = _MEANT.take(symbol)
        if repeats:  # the last length that wasn't 0, or 8
            last = np.maximum.accumulate(np.where((symbol > 0) & (symbol < 16), np.arange(len(symbol)), -1))
            value = np.where(symbol == 16, np.where(last < 0, 8, value[last]), value)
        total = int(ends[len(symbol) - 1])
        if total > alphabet:
            raise ValueError("code lengths beyond the alphabet")
        r.at += p
        lengths = np.zeros(alphabet, np.int64)
        lengths[:total] = value.repeat(again)
        return Code(lengths)
    raise ValueError("the stream ends early")


#: The code that this encoder writes code lengths with: 4 bits, but 5 for lengths 1, 13, 14 and 15; runs of lengths (16) aren't used.
_LENGTH_SIZES = np.array([5 if n in (1, 13, 14, 15) else 0 if n == 16 else 4 for n in range(19)])
_LENGTH_CODES = canonical(_LENGTH_SIZES)
_LENGTH_HEAD = sum(int(_LENGTH_SIZES[n]) << 5 + 3 * k for k, n in enumerate(CODE_LENGTH_ORDER)) | 15 << 1


def _read_group(r: Reader, sizes: tuple[int, ...]) -> list[Code]:
    """The five codes of a group. Blue's, where it is written in the same bits as red's, is red's."""
    green, start = read_code(r, sizes[0]), r.at
    red = read_code(r, sizes[1])
    n, at = r.at - start, r.at
    if sizes[2] == sizes[1] and n > 64 and Reader(r.data, start).read(n) == r.read(n):
        blue = red
    else:
        r.at = at
        blue = read_code(r, sizes[2])
    return [green, red, blue, read_code(r, sizes[3]), read_code(r, sizes[4])]


def write_code(w: Writer, lengths: np.ndarray) -> None:
    used = lengths.nonzero()[0]
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        w.write(1 | int(len(used) == 2) << 1 | 1 << 2, 3)
        for s in used.tolist() or [0]:
            w.write(s, 8)
        return
    kept = lengths[: used[-1] + 1]
    ends = np.append((kept[1:] != kept[:-1]).nonzero()[0], len(kept) - 1)
    digits, many = map(list, zip(*map(_run, kept.take(ends).tolist(), np.diff(ends, prepend=-1).tolist())))
    n = sum(many)
    if n < 2:
        digits.append(_run(0, 1)[0])
    w.write(_LENGTH_HEAD | 1 << 62, 63)
    bits = max(2, (n - 2).bit_length() + 1 & ~1) if n > 2 else 2
    w.write((bits - 2) // 2 | max(0, n - 2) << 3, 3 + bits)
    text = "".join(digits[::-1])
    w.write(int(text, 2), len(text))


@lru_cache(maxsize=4096)
def _run(value: int, times: int) -> tuple[str, int]:
    """How equal lengths in a row are written: binary digits, the first bit last, and symbols. Runs of three zeros or more are packed."""
    out = Writer()
    many = 0
    while times:
        k = min(times, 138) if value == 0 else 1
        k = 1 if k < 3 else k
        symbol = value if k == 1 else 17 if k < 11 else 18
        out.write(int(_LENGTH_CODES[symbol]), int(_LENGTH_SIZES[symbol]))
        if k > 1:
            out.write(k - int(_LEAST[symbol]), int(_MORE[symbol]))
        times -= k
        many += 1
    return f"{out.value:0{out.bits}b}", many


def prefix(value: int) -> tuple[int, int, int]:
    """(prefix code, extra bits, their number) of a length or distance from 1."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    return 2 * top + (v >> (top - 1) & 1), v & ((1 << (top - 1)) - 1), top - 1


def read_prefixed(r: Reader, code: int) -> int:
    if code < 4:
        return code + 1
    n = (code - 2) >> 1
    return ((2 + (code & 1)) << n) + r.read(n) + 1


def near_distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# ---- decoding


def _window(data: np.ndarray, start: int, count: int, bits: int) -> np.ndarray:
    """The next `bits` bits (up to 15) at each of `count` bits from bit `start` on; data has 3 bytes to spare."""
    a, b = start >> 3, ((start + count) >> 3) + 1
    d = data[a : b + 2].astype(np.int64)
    at = (d[:-2] | d[1:-1] << 8 | d[2:] << 16).repeat(8)
    at >>= _SHIFTS[: len(at)]
    at &= (1 << bits) - 1
    return at[start & 7 : (start & 7) + count]


_NEAR_X, _NEAR_Y = (np.array([xy[k] for xy in NEAR], np.int64) for k in (0, 1))
_STEP = 1 << 16
_PLACES = np.arange(_STEP + 128)
_SHIFTS = _PLACES & 7


def _followed(to: np.ndarray, count: int) -> np.ndarray:
    """All places below count that jumps from place 0 on come to; to[i] > i, and places from count on lead to themselves."""
    jumps = [to]
    for _ in range(4):
        jumps.append(jumps[-1].take(jumps[-1], mode="clip"))
    far, anchors, p = jumps[4], [], 0
    while p < count:
        anchors.append(p)
        p = int(far[p])
    path = np.array(anchors)[:, None]
    for jump in reversed(jumps[:4]):  # 8, 4, 2 and 1 on
        path = np.concatenate([path[:, :, None], jump.take(path, mode="clip")[:, :, None]], 2).reshape(len(anchors), -1)
    path = path.ravel()
    return path[path < count]


#: Of prefix codes: the extra bits behind them, the values that these take, and the least value.
_EXTRA_BITS = np.array([max(c - 2, 0) >> 1 for c in range(40)])
_EXTRA_MASK = (1 << _EXTRA_BITS) - 1
_LEAST_OF = np.array([c + 1 if c < 4 else ((2 + (c & 1)) << (c - 2 >> 1)) + 1 for c in range(40)])


def _items(r: Reader, codes: list[Code], width: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stream of one image, as (length, distance, value, slot) of literals (1, 0, argb, -1), references (length,
    distance, 0, -1) and cache entries (1, 0, 0, slot)."""
    green, red, blue, alpha, far = codes
    data, end, parts, n, mask = np.frombuffer(r.data + bytes(64), np.uint8), len(r.data) * 8, [], 0, (1 << green.bits) - 1
    while n < total:
        count = min(_STEP, end - r.at, (total - n) * 60)
        if count <= 0:
            raise ValueError("the stream ends early")
        stop = count + 96  # an item is at most 59 bits long
        ahead = _window(data, r.at, stop, 15)
        at = ahead & mask
        found = green.table.take(at, mode="clip")
        after = found & 15
        after += _PLACES[:stop]
        first = to = after[:count]
        hop = None
        for c in (red, blue, alpha):
            if c.bits:
                hop = hop if hop is not None and blue is red and c is blue else (c.table & 15).take(ahead & ((1 << c.bits) - 1), mode="clip")
                to = to + hop.take(to, mode="clip")
        where = (found[:count] >= 256 << 4).nonzero()[0]
        if len(where):
            to = to.copy() if to is first else to
            to[where] = first.take(where)
            code = (found.take(where) >> 4) - 256
            copied = (code < 24).nonzero()[0]
            where = where.take(copied)
            p = first.take(where) + _EXTRA_BITS.take(code.take(copied))
            d = far.table.take(ahead.take(p) & ((1 << far.bits) - 1))
            to[where] = p + (d & 15 if far.bits else 0) + _EXTRA_BITS.take(d >> 4)
        lead = _PLACES[: stop + 1].copy()
        np.minimum(to, stop, out=lead[:count])
        path = _followed(lead, count)
        what, q = found.take(path) >> 4, after.take(path)
        values, fields = [], q
        for c in (red, blue, alpha):
            if not c.bits:
                values.append(c.only)
                continue
            k = c.table.take(ahead.take(fields, mode="clip") & ((1 << c.bits) - 1))
            values.append(k >> 4)
            fields = fields + (k & 15)
        length, distance, argb, slot = np.ones(len(path), np.int64), np.zeros(len(path), np.int64), values[0] << 16 | what << 8 | values[1] | values[2] << 24, np.full(len(path), -1, np.int64)
        where = (what >= 256).nonzero()[0]
        if len(where):
            code = what.take(where) - 256
            argb[where] = 0
            cached = (code >= 24).nonzero()[0]
            slot[where.take(cached)] = code.take(cached) - 24
            copied = (code < 24).nonzero()[0]
            where, code = where.take(copied), code.take(copied)
        if len(where):
            p = q.take(where)
            length[where] = _LEAST_OF.take(code) + (ahead.take(p) & _EXTRA_MASK.take(code))
            p = p + _EXTRA_BITS.take(code)
            d = far.table.take(ahead.take(p) & ((1 << far.bits) - 1))
            p, d = p + (d & 15 if far.bits else 0), d >> 4
            v = _LEAST_OF.take(d) + ((ahead.take(p) | ahead.take(np.minimum(p + 15, stop - 1)) << 15) & _EXTRA_MASK.take(d))
            near = np.minimum(v, len(NEAR)) - 1
            distance[where] = np.where(v > len(NEAR), v - len(NEAR), np.maximum(1, _NEAR_X.take(near) + _NEAR_Y.take(near) * width))
        ends = length.cumsum() + n
        keep = int(ends.searchsorted(total)) + 1
        if keep <= len(path):
            length[keep - 1] -= ends[keep - 1] - total
            n = total
        else:
            keep, n = len(path), int(ends[-1])
        r.at += int(lead[path[keep - 1]])
        if r.at > end:
            raise ValueError("the stream ends early")
        parts.append([x[:keep] for x in (length, distance, argb, slot)])
    return tuple(parts[0]) if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


def _resolved(source: np.ndarray) -> np.ndarray:
    """Where pointers to earlier places lead in the end."""
    while True:
        further = source.take(source, mode="clip")
        if (further == source).all():
            return source
        source = further


def _fast_pixels(r: Reader, codes: list[Code], cache_bits: int, width: int, total: int) -> np.ndarray:
    """An image of one group of prefix codes."""
    length, distance, argb, slot = _items(r, codes, width, total)
    place = length.cumsum() - length
    if (distance > place).any():
        raise ValueError("a back-reference before the first pixel")
    value = np.zeros(total + 1, np.int64)  # the last is the colour of an empty cache entry
    value[place] = argb
    source = np.arange(total + 1)
    if (distance > 0).any():
        source[:total] -= distance.repeat(length)
        source = _resolved(source)
    cached = (slot >= 0).nonzero()[0]
    if len(cached):
        key = (CACHE_FACTOR * value & 0xFFFFFFFF) >> (32 - cache_bits)
        key[place[cached]] = slot[cached]
        key = key.astype(np.uint16).take(source[:total])
        order = key.argsort(kind="stable")  # at most 11 bits, sorted by radix
        before = np.full(total, total)
        ordered = key.take(order)
        same = (ordered[1:] == ordered[:-1]).nonzero()[0]
        before[order.take(same + 1)] = order.take(same)
        source[place[cached]] = before[place[cached]]
        source = _resolved(source[source])
    return value[source[:total]].astype(np.uint32)


def _pixels(r: Reader, groups: list[list[Code]], meta: np.ndarray | None, meta_bits: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    """Any image, pixel by pixel."""
    total, out, n = width * height, [], 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    codes, shift = groups[0], 32 - cache_bits
    while n < total:
        if meta is not None:
            y, x = divmod(n, width)
            codes = groups[meta[y >> meta_bits, x >> meta_bits]]
        green = codes[0].read(r)
        if green < 256:
            red, blue, alpha = codes[1].read(r), codes[2].read(r), codes[3].read(r)
            new = [alpha << 24 | red << 16 | green << 8 | blue]
        elif green < 256 + 24:
            length = read_prefixed(r, green - 256)
            back = near_distance(read_prefixed(r, codes[4].read(r)), width)
            if back > n:
                raise ValueError("a back-reference before the first pixel")
            new = []
            for i in range(n, min(total, n + length)):
                new.append(out[i - back] if i - back < n else new[i - back - n])
        else:
            new = [cache[green - 280]]
        out += new
        n += len(new)
        if cache_bits:
            for argb in new:
                cache[(CACHE_FACTOR * argb & 0xFFFFFFFF) >> shift] = argb
    return np.array(out, np.uint32).reshape(height, width)


def _image(r: Reader, width: int, height: int, main: bool = False) -> np.ndarray:
    cache_bits = r.read(4) if r.read(1) else 0
    meta, meta_bits, many = None, 0, 1
    if main and r.read(1):
        meta_bits = r.read(3) + 2
        side = lambda n: -(-n // (1 << meta_bits))
        meta = _image(r, side(width), side(height)) >> np.uint32(8) & np.uint32(0xFFFF)
        many = int(meta.max()) + 1
    sizes = (ALPHABETS[0] + ((1 << cache_bits) if cache_bits else 0), *ALPHABETS[1:])
    groups = [_read_group(r, sizes) for _ in range(many)]
    codes = groups[0]
    if many == 1 and width * height > 16 and codes[0].only is None:
        return _fast_pixels(r, codes, cache_bits, width, width * height).reshape(height, width)
    if all(c.only is not None for c in codes[:4]) and codes[0].only < 256 and many == 1:
        green, red, blue, alpha = (c.only for c in codes[:4])
        return np.full((height, width), alpha << 24 | red << 16 | green << 8 | blue, np.uint32)
    return _pixels(r, groups, meta, meta_bits, cache_bits, width, height)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) uint8: blue, green, red, alpha."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _packed(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels).view("<u4").reshape(channels.shape[:-1])


def _average(a, b):
    return ((a.astype(np.int32) + b) >> 1).astype(np.uint8)


def _select(left, top, corner):
    a, b, c = (x.astype(np.int32) for x in (left, top, corner))
    return np.where((np.abs(b - c).sum(-1) < np.abs(a - c).sum(-1))[..., None], left, top)


def _clamped(v):
    return np.clip(v, 0, 255).astype(np.uint8)


def predict(mode: int, left, top, corner, right) -> np.ndarray:
    """Prediction from the pixels left, above, above left and above right (uint8 channels)."""
    if mode in (0, 14, 15):
        return np.broadcast_to(np.array([0, 0, 0, 255], np.uint8), top.shape)
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _clamped(left.astype(np.int32) + top - corner)
    if mode == 13:
        mean = _average(left, top).astype(np.int32)
        difference = mean - corner
        return _clamped(mean + (np.sign(difference) * (np.abs(difference) >> 1)))
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: _average(_average(left, right), top), 6: lambda: _average(left, corner),
        7: lambda: _average(left, top), 8: lambda: _average(corner, top), 9: lambda: _average(top, right), 10: lambda: _average(_average(left, corner), _average(top, right)),
    }[mode]()


def undo_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    rest = _channels(argb)
    height, width = argb.shape
    out = np.empty_like(rest)
    out[0] = np.cumsum(rest[0], 0, dtype=np.uint8)
    out[0, :, 3] += 255
    for y in range(1, height):
        above = out[y - 1]
        out[y, 0] = rest[y, 0] + above[0]
        for a in range(0, width, 1 << bits):
            a, b = max(a, 1), min(width, (a >> bits << bits) + (1 << bits))
            if a >= b:
                continue
            mode = int(modes[y >> bits, a >> bits])
            top, corner = above[a:b], above[a - 1 : b - 1]
            right = above[a + 1 : b + 1]
            if len(right) < b - a:  # right of the last column comes this row's first pixel
                right = np.concatenate([right, out[y, :1]])
            if mode in (0, 2, 3, 4, 8, 9, 14, 15):
                out[y, a:b] = rest[y, a:b] + predict(mode, top, top, corner, right)
            elif mode == 1:
                out[y, a:b] = np.cumsum(np.concatenate([out[y, a - 1 : a], rest[y, a:b]]), 0, dtype=np.uint8)[1:]
            else:
                for x in range(a, b):
                    out[y, x] = rest[y, x] + predict(mode, out[y, x - 1], top[x - a], corner[x - a], right[x - a])
    return _packed(out)


def _spread(blocks: np.ndarray, bits: int, shape: tuple[int, int]) -> np.ndarray:
    return blocks.repeat(1 << bits, 0)[: shape[0]].repeat(1 << bits, 1)[:, : shape[1]]


def _delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (factor.view(np.int8).astype(np.int32) * colour.view(np.int8)) >> 5


def cross_colour(argb: np.ndarray, factors: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """factors: an image whose blue, green and red are green-to-red, green-to-blue and red-to-blue."""
    c = _channels(argb).copy()
    f = np.ascontiguousarray(_channels(_spread(factors, bits, argb.shape)))
    blue, green, red = (c[..., i].copy() for i in range(3))
    to_red, to_blue, red_to_blue = (f[..., i].copy() for i in range(3))
    sign = 1 if undo else -1
    new_red = (red.astype(np.int32) + sign * _delta(to_red, green)).astype(np.uint8)
    true_red = new_red if undo else red
    c[..., 2] = new_red
    c[..., 0] = (blue.astype(np.int32) + sign * (_delta(to_blue, green) + _delta(red_to_blue, true_red))).astype(np.uint8)
    return _packed(c)


def _add_green(argb: np.ndarray) -> np.ndarray:
    green = argb >> np.uint32(8) & np.uint32(0xFF)
    return (argb & np.uint32(0xFF00FF00)) | ((argb & np.uint32(0x00FF00FF)) + green * np.uint32(0x00010001) & np.uint32(0x00FF00FF))


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(argb: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    bits = _bundle_bits(len(table))
    index = argb >> np.uint32(8) & np.uint32(0xFF)
    if bits:
        size = 8 >> bits
        parts = index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(size)) & np.uint32((1 << size) - 1)
        index = parts.reshape(len(argb), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """One WebP file with a VP8L chunk to its pixels: uint32 ARGB, (height, width)."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    r = Reader(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    todo, inner = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            todo.append((kind, _image(r, -(-inner // (1 << bits)), -(-height // (1 << bits))), bits))
        elif kind == PALETTE:
            table = _packed(np.cumsum(_channels(_image(r, r.read(8) + 1, 1)), 1, dtype=np.uint8))[0]
            todo.append((kind, table, inner))
            inner = -(-inner // (1 << _bundle_bits(len(table))))
        else:
            todo.append((kind, None, 0))
    argb = _image(r, inner, height, main=True)
    for kind, given, number in reversed(todo):
        if kind == PREDICTOR:
            argb = undo_predictor(argb, given >> np.uint32(8) & np.uint32(15), number)
        elif kind == CROSS_COLOUR:
            argb = cross_colour(argb, given, number, undo=True)
        elif kind == SUBTRACT_GREEN:
            argb = _add_green(argb)
        else:
            argb = undo_palette(argb, given, number)
    return argb


# ---- encoding


def _file(w: Writer) -> bytes:
    body = b"\x2f" + w.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + bytes(len(body) & 1)
    return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


def _head(w: Writer, width: int, height: int, alpha: bool) -> None:
    if not (0 < width <= LARGEST_SIDE and 0 < height <= LARGEST_SIDE):
        raise ValueError("too large an image")
    w.write(width - 1, 14), w.write(height - 1, 14), w.write(int(alpha), 1), w.write(0, 3)


def _joined(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """Values of given bit sizes (1 to 32 each) one after another, as uint32 words."""
    ends = sizes.cumsum()
    total = int(ends[-1]) if len(ends) else 0
    out = np.zeros(total // 32 + 2, np.int64)
    if total:
        at = ends - sizes
        word = at >> 5  # none is left out, as no value is longer than one
        sums = np.add.reduceat(values << (at & 31), word.searchsorted(np.arange(int(word[-1]) + 1)))
        out[: len(sums)] = sums & 0xFFFFFFFF
        out[1 : len(sums) + 1] += sums >> 32
    return out.astype("<u4"), total


def _copies(flat: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Back-references (place, length, distance as rows) to the last place with the same `least` pixels: runs of places that
    all have theirs at one distance, the first come first."""
    n = len(flat) - least + 1
    if n < 2:
        return np.empty((0, 3), np.int64)
    key = flat[:n].astype(np.uint64)
    for k in range(1, least):
        key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ flat[k : k + n]
    if n < 1 << 14:  # short keys are sorted by radix; of those that meet by chance some references go unseen
        key = (key >> np.uint64(48)).astype(np.uint16)
    order = key.argsort(kind="stable")
    distance = np.zeros(n, np.int64)
    key = key.take(order)
    same = (key[1:] == key[:-1]).nonzero()[0]
    if not len(same):
        return np.empty((0, 3), np.int64)
    later, before = order.take(same + 1), order.take(same)
    far = later - before
    right = far <= FARTHEST
    right &= flat.take(later) == flat.take(before)
    for k in range(1, least):  # else equal keys of other pixels
        right &= flat[k:].take(later) == flat[k:].take(before)
    distance[later[right]] = far[right]
    changes = np.concatenate([[0], (distance[1:] != distance[:-1]).nonzero()[0] + 1, [n]])
    starts, ends = changes[:-1], changes[1:] + (least - 1)
    held = distance[starts] > 0
    starts, ends = starts[held], ends[held]
    out, at = [], 0
    for a, b, d in zip(starts.tolist(), ends.tolist(), distance[starts].tolist()):
        a = max(a, at)
        while b - a >= least:
            k = min(b - a, 4096)
            out.append((a, k, d))
            a = at = a + k
    return np.array(out, np.int64).reshape(-1, 3)


def _prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix code, extra bits, their number) of values from 1."""
    v = value - 1
    if not len(v) or int(v.max()) < len(_CODE_OF):
        code = _CODE_OF.take(v)
        many = _EXTRA_BITS.take(code)
    else:
        top = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1, 1)
        many = np.where(v < 4, 0, top - 1)
        code = np.where(v < 4, v, 2 * top + (v >> (top - 1) & 1))
    return code, np.where(v < 4, 0, v & ((1 << many) - 1)), many


#: The prefix codes of values from 1 on.
_CODE_OF = np.arange(26).repeat(1 << _EXTRA_BITS[:26])


_SPREAD = np.log2(np.maximum(np.arange(1 << 16), 1)) * np.arange(1 << 16)


def _bits(counts: np.ndarray) -> np.ndarray:
    """Bits of the optimal code of symbols with these counts, each row for itself."""
    total = counts.sum(-1)
    if int(total.max()) < len(_SPREAD):
        return _SPREAD[total] - _SPREAD[counts].sum(-1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(-1)


class _Stream:
    """An image's pixels as literals, references and cache entries. A cache of cache_bits is used if it holds an eighth of the literals."""

    def __init__(self, flat: np.ndarray, width: int, copies: np.ndarray, cache_bits: int):
        at = None
        if len(copies):
            covered = np.zeros(len(flat) + 1, np.int64)
            covered[copies[:, 0]] = 1
            covered -= np.bincount(copies[:, 0] + copies[:, 1], minlength=len(flat) + 1)
            lead = covered.cumsum() == 0
            lead[copies[:, 0]] = True
            at = lead[:-1].nonzero()[0]
        kept = (flat if at is None else flat.take(at)).astype("<u4")
        self.many = len(kept)
        channels = kept.view(np.uint8).reshape(-1, 4)
        green, is_literal = channels[:, 1].astype(np.int64), np.ones(len(kept), bool)
        if cache_bits:
            slot = (flat.astype(np.uint32) * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
            order = slot.astype(np.uint16).argsort(kind="stable")  # short keys are sorted by radix
            hit = np.zeros(len(flat), bool)
            by_slot = flat.take(order)  # the same colour as the last of its slot; another colour of the slot would come between
            hit[order[1:]] = by_slot[1:] == by_slot[:-1]
            where = (hit if at is None else hit.take(at)).nonzero()[0]
            if 8 * len(where) >= len(kept):
                green[where], is_literal[where] = slot.take(where if at is None else at.take(where)).astype(np.int64) + 280, False
            else:
                cache_bits = 0
        self.cache_bits = cache_bits
        self.far = self.extra = self.where = None
        far_counts = np.zeros(ALPHABETS[4], np.int64)
        if len(copies):
            where = at.searchsorted(copies[:, 0])
            code, extra, many = _prefix_of(copies[:, 1])
            is_literal[where], green[where] = False, code + 256
            self.far = _prefix_of(_distance_codes(copies[:, 2], width))
            self.extra, self.where = (extra, many), where
            far_counts = np.bincount(self.far[0], minlength=ALPHABETS[4])
        self.literal = is_literal.nonzero()[0]
        # green of all; red, blue and alpha of the literals
        self.fields = [green, *(channels[:, c].take(self.literal).astype(np.int64) for c in _FIELDS[1:])]
        sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:4])
        self.counts = [*(np.bincount(f, minlength=n) for f, n in zip(self.fields, sizes)), far_counts]

    def write(self, w: Writer, main: bool = True) -> None:
        w.write(int(self.cache_bits > 0), 1)
        if self.cache_bits:
            w.write(self.cache_bits, 4)
        if main:
            w.write(0, 1)  # no meta prefix codes
        values, sizes = np.zeros((2, self.many, 6), np.int64)
        for k, counts in enumerate(self.counts):
            if k != 2:  # blue is written by red's code: in text they have the same symbols, and one code is worked out and read for both
                lengths, start = code_lengths(counts + self.counts[2] if k == 1 else counts, 15), Writer()
                write_code(start, lengths)
                codes = canonical(lengths) if np.count_nonzero(lengths) > 1 else None
            w.write(start.value, start.bits)
            if codes is None:
                continue
            if k == 0:
                values[:, 0], sizes[:, 0] = codes.take(self.fields[0]), lengths.take(self.fields[0])
            elif k < 4:
                values[self.literal, k], sizes[self.literal, k] = codes.take(self.fields[k]), lengths.take(self.fields[k])
            else:
                values[self.where, 4], sizes[self.where, 4] = codes.take(self.far[0]), lengths.take(self.far[0])
        if self.where is not None:  # the length's extra bits come before the distance's code, where literals have red
            values[self.where, 1], sizes[self.where, 1] = self.extra
            values[self.where, 5], sizes[self.where, 5] = self.far[1:]
        takes = sizes.ravel().nonzero()[0]
        w.append(*_joined(values.ravel().take(takes), sizes.ravel().take(takes)))


@lru_cache(maxsize=64)
def _near_codes(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of near pixels, ascending, and their numbers."""
    table = {}
    for code in range(len(NEAR), 0, -1):
        table[near_distance(code, width)] = code
    known = sorted(table)
    return np.array(known), np.array([table[d] for d in known])


def _distance_codes(distance: np.ndarray, width: int) -> np.ndarray:
    """Codes of distances: of a near pixel its number, else the distance after those."""
    known, codes = _near_codes(width)
    at = np.minimum(known.searchsorted(distance), len(known) - 1)
    return np.where(known.take(at) == distance, codes.take(at), distance + len(NEAR))


def _counts_of(channels: np.ndarray) -> np.ndarray:
    """Counts by channel of (pixels, 4) uint8."""
    flat = channels.reshape(-1, channels.shape[-1]).astype(np.int64)
    k = flat.shape[1]
    return np.bincount((flat + np.arange(k) * 256).ravel(), minlength=k * 256).reshape(k, 256)


def _is_smooth(argb: np.ndarray, mode: int) -> bool:
    """Whether three tenths of all pixels have a green within 3 of the pixel's to the left or above."""
    green = (argb >> np.uint32(8)).astype(np.uint8)
    step = green[:, 1:] - green[:, :-1] if mode == 1 else green[1:] - green[:-1]
    return 10 * int(np.count_nonzero(step + np.uint8(3) <= 6)) > 3 * step.size


def _are_alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether three tenths of all samples of two channels are within 3 of one another."""
    return 10 * int(np.count_nonzero(a - b + np.uint8(3) <= 6)) > 3 * a.size


def _left_or_top(argb: np.ndarray, mode: int) -> np.ndarray:
    """Residuals where all blocks have predictor 1 (left) or 2 (top)."""
    c = _channels(argb)
    guess = np.empty_like(c)
    guess[0, 0], guess[0, 1:], guess[1:, 0] = (0, 0, 0, 255), c[0, :-1], c[:-1, 0]
    guess[1:, 1:] = c[1:, :-1] if mode == 1 else c[:-1, 1:]
    return _packed(c - guess)


_FIELDS = [1, 2, 0, 3]  # green, red, blue, alpha of a pixel's bytes
_CACHE_BITS = 7


def encode_best(argb: np.ndarray) -> bytes:
    """Any image: uint32 ARGB (height, width), lossless, by what takes least of these.

    Predictor none, left or top for the image; cross-colour factors 0 or 32 of green on red, green on blue and red on
    blue; for up to 256 colours a palette instead; then back-references and, without a palette, a colour cache.
    """
    height, width = argb.shape
    w = Writer()
    _head(w, width, height, bool((argb >> np.uint32(24) != 255).any()))
    block = 9
    blocks = (-(-height >> block) or 1, -(-width >> block) or 1)
    best, (mode, factors), table = np.inf, (0, None), None
    c = _channels(argb).reshape(-1, 4)
    smooth = [m for m in (1, 2) if _is_smooth(argb, m)]
    # in text neither pixels nor channels follow one another, and none of this is tried
    if smooth or _are_alike(c[:, 2], c[:, 1]) or _are_alike(c[:, 0], c[:, 1]) or _are_alike(c[:, 0], c[:, 2]):
        for m in (0, *smooth):
            c = _channels(_left_or_top(argb, m) if m else argb).reshape(-1, 4)
            blue, green, red = c[:, 0], c[:, 1], c[:, 2]
            less = blue - green
            # the three factors of 32 take green's or red's signed value off
            each = _bits(_counts_of(np.stack([blue, green, red, red - green, less, blue - red, less - red], 1))).tolist()
            red_of, blue_of = min(((each[2], 0), (each[3], 32))), min((each[0], 0, 0), (each[4], 32, 0), (each[5], 0, 32), (each[6], 32, 32))
            cost, plain = each[1] + red_of[0] + blue_of[0] + 64, each[0] + each[1] + each[2]
            for bits, f in ((plain, None), (cost, (red_of[1], *blue_of[1:]))):
                if bits + (64 if m else 0) < best and (f is None or any(f)):
                    best, mode, factors = bits + (64 if m else 0), m, f
    if argb.size <= 1 << 16:
        ordered = np.sort(argb, axis=None)
        first = np.concatenate([[0], (ordered[1:] != ordered[:-1]).nonzero()[0] + 1])
        if len(first) <= 256:
            if best == np.inf:
                best = float(_bits(_counts_of(c[:, :3])).sum())
            # a colour of the palette takes about as many bits as three of its bytes
            if float(_bits(np.concatenate([first[1:], [argb.size]]) - first)) + 18 * len(first) < best:
                mode, factors, table = 0, None, ordered[first]
    now = argb
    if table is not None:
        now = _with_palette(w, argb, table)
    if mode:
        w.write(1, 1), w.write(PREDICTOR, 2), w.write(block - 2, 3)
        _write_image(w, np.full(blocks, mode << 8 | 0xFF000000, np.uint32))
        now = _left_or_top(now, mode)
    if factors:
        w.write(1, 1), w.write(CROSS_COLOUR, 2), w.write(block - 2, 3)
        to_red, to_blue, red_to_blue = factors
        image = np.full(blocks, 0xFF000000 | red_to_blue << 16 | to_blue << 8 | to_red, np.uint32)
        _write_image(w, image)
        now = cross_colour(now, image, block, undo=False)
    w.write(0, 1)
    flat = np.ascontiguousarray(now).ravel()
    _Stream(flat, now.shape[1], _copies(flat), _CACHE_BITS if table is None else 0).write(w)
    return _file(w)


def _with_palette(w: Writer, argb: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Write the palette; the image of indices, bundled where a byte holds several."""
    height, width = argb.shape
    steps = _channels(table).copy()
    steps[1:] -= _channels(table)[:-1]
    w.write(1, 1), w.write(PALETTE, 2), w.write(len(table) - 1, 8)
    _Stream(_packed(steps), len(table), np.empty((0, 3), np.int64), 0).write(w, main=False)
    shift = _bundle_bits(len(table))
    index = np.searchsorted(table, argb).astype(np.uint32)
    index = np.pad(index, ((0, 0), (0, -width % (1 << shift)))).reshape(height, -1, 1 << shift)
    packed = (index << (np.arange(1 << shift, dtype=np.uint32) * np.uint32(8 >> shift))).sum(2).astype(np.uint32)
    return packed << np.uint32(8) | np.uint32(0xFF000000)


def _references(flat: list[int], width: int) -> list[tuple]:
    """Greedy back-references: pixels (argb,) and (length, distance)."""
    out, seen, i = [], {}, 0
    while i < len(flat):
        key, best = tuple(flat[i : i + 3]), (0, 0)
        if len(key) == 3:
            j = seen.get(key)
            if j is not None and i - j <= FARTHEST:
                n = 0
                while i + n < len(flat) and n < 4096 and flat[j + n] == flat[i + n]:
                    n += 1
                best = (n, i - j)
        step = best[0] if best[0] >= 3 else 1
        out.append(best if step > 1 else (flat[i],))
        for k in range(i, i + step):
            seen[tuple(flat[k : k + 3])] = k
        i += step
    return out


def _write_image(w: Writer, argb: np.ndarray, cache_bits: int = 0, references: bool = False, main: bool = False, meta_bits: int = 0) -> None:
    height, width = argb.shape
    flat = argb.ravel().tolist()
    w.write(int(cache_bits > 0), 1)
    if cache_bits:
        w.write(cache_bits, 4)
    groups = 1
    if main:
        w.write(int(meta_bits > 0), 1)
        if meta_bits:  # two groups, dealt like a chess board
            w.write(meta_bits - 2, 3)
            shape = [-(-n // (1 << meta_bits)) for n in argb.shape]
            board = np.indices(shape).sum(0) % 2
            _write_image(w, (board.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000))
            groups = 2 if board.any() else 1
    items = _references(flat, width) if references else [(x,) for x in flat]
    cache, tokens, at = [0] * (1 << cache_bits) if cache_bits else [], [], 0
    code_of = {}
    for code in range(len(NEAR), 0, -1):
        code_of[near_distance(code, width)] = code
    for item in items:
        y, x = divmod(at, width)
        group = int(board[y >> meta_bits, x >> meta_bits]) if main and meta_bits else 0
        n = 1 if len(item) == 1 else item[0]
        if len(item) == 2:
            length, distance = prefix(item[0]), prefix(code_of.get(item[1], item[1] + len(NEAR)))
            tokens.append((group, [(0, 256 + length[0], *length[1:]), (4, *distance)]))
        else:
            slot = (CACHE_FACTOR * item[0] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache_bits and cache[slot] == item[0]:
                tokens.append((group, [(0, 280 + slot, 0, 0)]))
            else:
                v = item[0]
                tokens.append((group, [(0, v >> 8 & 255, 0, 0), (1, v >> 16 & 255, 0, 0), (2, v & 255, 0, 0), (3, v >> 24, 0, 0)]))
        if cache_bits:
            for v in flat[at : at + n]:
                cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        at += n
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(groups)]
    for group, parts in tokens:
        for kind, symbol, _, _ in parts:
            counts[group][kind][symbol] += 1
    tables = []
    for own in counts:
        lengths = [code_lengths(c, 15) for c in own]
        for n in lengths:
            write_code(w, n)
        tables.append([(canonical(n).tolist(), n.tolist() if (n > 0).sum() > 1 else [0] * len(n)) for n in lengths])
    for group, parts in tokens:
        for kind, symbol, extra, n in parts:
            codes, bits = tables[group][kind]
            if bits[symbol]:
                w.write(codes[symbol], bits[symbol])
            w.write(extra, n)


def encode(argb: np.ndarray, modes: np.ndarray | None = None, factors: np.ndarray | None = None, bits: int = 2, green: bool = False, palette: bool = False, cache_bits: int = 0, references: bool = False, meta_bits: int = 0) -> bytes:
    """Any image: uint32 ARGB (height, width), with the given transforms. modes, factors: the blocks' predictors and cross-colour factors."""
    w = Writer()
    height, width = argb.shape
    _head(w, width, height, bool((argb >> np.uint32(24) != 255).any()))
    now = argb
    if palette:
        table = np.unique(argb)
        if len(table) > 256:
            raise ValueError("too many colours for a palette")
        now = _with_palette(w, argb, table)
    if modes is not None:
        w.write(1, 1), w.write(PREDICTOR, 2), w.write(bits - 2, 3)
        _write_image(w, (modes.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000))
        now = _residuals(now, modes, bits)
    if factors is not None:
        w.write(1, 1), w.write(CROSS_COLOUR, 2), w.write(bits - 2, 3)
        _write_image(w, factors)
        now = cross_colour(now, factors, bits, undo=False)
    if green:
        w.write(1, 1), w.write(SUBTRACT_GREEN, 2)
        g = now >> np.uint32(8) & np.uint32(0xFF)
        c = _channels(now).copy()
        c[..., 0] -= g.astype(np.uint8)
        c[..., 2] -= g.astype(np.uint8)
        now = _packed(c)
    w.write(0, 1)
    _write_image(w, now, cache_bits, references, True, meta_bits)
    return _file(w)


def _residuals(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    c = _channels(argb)
    out = np.empty_like(c)
    height, width = argb.shape
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = c[0, x - 1] if x else np.array([0, 0, 0, 255], np.uint8)
            elif x == 0:
                guess = c[y - 1, 0]
            else:
                right = c[y - 1, x + 1] if x + 1 < width else c[y, 0]
                guess = predict(int(modes[y >> bits, x >> bits]), c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], right)
            out[y, x] = c[y, x] - guess
    return _packed(out)
