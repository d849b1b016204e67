"""Lossless WebP as a store of 8-bit samples.

The decoder reads prefix codes, back-references, the colour cache and meta prefix codes, and inverts the predictor,
cross-colour, subtract-green and palette transforms, to an array of pixels. Where an image has one group of codes and no
cache, tokens are found without touching single bits: for every bit position the length of a token that would start there
is looked up at once, and a walk from token to token then visits only real starts; copies are resolved by following
all sources together. The encoder finds matches by sorting windows of four pixels, walks from match to match, and puts the
bits of a token into one number before it packs them.

A payload becomes a grey picture, coded by its palette where at most 16 byte values occur, several samples to a pixel
then, and by its green channel otherwise; the picture's lines are 64 samples
long, or longer where the format's height would not do. A chunk of its own holds the payload's length then.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PAD = 64
FURTHEST = (1 << 20) - 120  # pixels that a reference reaches back
LONGEST = 4096  # pixels of a copy
MOST = 1 << 14  # samples of a side at most
_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)  # fixed: order of the code length codes
#: Neighbours that short distance codes name: nearest first, then the higher row, then the right one.
_NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], p[0] < 0))
_PREDICTOR, _CROSS, _GREEN, _PALETTE = range(4)
_PREFIX_BITS = np.array([0 if k < 4 else (k - 2) >> 1 for k in range(40)])
_PREFIX_BASE = np.array([k if k < 4 else (2 + (k & 1)) << ((k - 2) >> 1) for k in range(40)])
_PREFIX_OF = np.repeat(np.arange(40, dtype=np.uint8), np.diff(np.append(_PREFIX_BASE, 1 << 20)))  # of values from 0
_CACHE_FACTOR = 0x1E35A7BD  # fixed: hash factor of the colour cache


# ---- bits ----


class Reader:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def bits(self, n: int) -> int:
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        if not code.depth:
            return code.only
        byte = self.at >> 3
        window = (int.from_bytes(self.data[byte : byte + 4], "little") >> (self.at & 7)) & ((1 << code.depth) - 1)
        self.at += int(code.length[window])
        return int(code.symbol[window])

    def value(self, prefix: int) -> int:
        return int(_PREFIX_BASE[prefix]) + self.bits(int(_PREFIX_BITS[prefix])) + 1


class Writer:
    """Fields of (value, bits), of less than 64 bits each, packed at the end."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.short: tuple[list[int], list[int]] = ([], [])  # put one by one since the last array

    def put(self, *fields: tuple[int, int]) -> None:
        for value, size in fields:
            self.short[0].append(value)
            self.short[1].append(size)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values += [np.array(self.short[0], np.int64), values]
        self.sizes += [np.array(self.short[1], np.int64), sizes]
        self.short = ([], [])

    def bytes(self) -> bytes:
        self.many(np.empty(0, np.int64), np.empty(0, np.int64))
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        some = np.flatnonzero(sizes)
        values, end = values[some].view(np.uint64), np.cumsum(sizes[some])
        start = end - sizes[some]
        word, shift = start >> 6, (start & 63).view(np.uint64)
        first = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)  # fields that begin in each word of 64 bits
        last = np.append(first[1:], len(word)) - 1
        out = np.zeros(len(first) + 1, "<u8")
        out[:-1] = np.bitwise_or.reduceat(values << shift, first)
        out[1:] |= values[last] >> (np.uint64(63) - shift[last]) >> np.uint64(1)
        return out.tobytes()[: (int(end[-1]) + 7) >> 3]


# ---- prefix codes ----


_MIRROR = np.zeros(1 << 15, np.int64)  # 15 bits in the other order
for _i in range(15):
    _MIRROR |= (np.arange(1 << 15) >> _i & 1) << (14 - _i)
_MIRROR_7 = (_MIRROR[: 1 << 7] >> 8).tolist()
_HEAVIEST = 1 << 80
_NONE = np.zeros(1, np.int64)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the lengths, with the bits in the order of reading."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[used]
    deepest = int(sizes[-1]) if len(sizes) else 0
    step = 1 << (deepest - sizes)
    codes = np.zeros(len(lengths), np.int64)
    codes[used] = _MIRROR[(np.cumsum(step) - step) >> (deepest - sizes)] >> (15 - sizes)
    return codes


class Code:
    """A decoding table: symbol and length for each window of ``depth`` bits; one symbol alone takes none."""

    def __init__(self, symbols: list[int], sizes: list[int]):
        """``symbols`` ascend; ``sizes`` are the lengths of their codes."""
        self.only = symbols[0] if symbols else 0
        self.depth = max(sizes) if len(symbols) > 1 else 0
        if not self.depth:
            self.used, self.sizes, self.entry = np.array([self.only]), _NONE, _NONE
        else:
            sizes = np.array(sizes)
            order = sizes.argsort(kind="stable")
            self.used, self.sizes = np.array(symbols)[order], sizes[order]
            step = 1 << (self.depth - self.sizes)
            if int(step.sum()) != 1 << self.depth:
                raise ValueError("prefix code is not complete")
            self.entry = np.arange(len(order)).repeat(step).take(_MIRROR[: 1 << self.depth] >> (15 - self.depth))
        self.symbol, self.length = self.used.take(self.entry), self.sizes.take(self.entry)


@lru_cache(maxsize=256)
def _alone(symbol: int) -> Code:
    return Code([symbol], [1])


def _depths(weights: list[int], most: int) -> list[int]:
    """Huffman code lengths of two symbols or more, at most ``most`` bits; lighter ones first, then earlier ones."""
    n = len(weights)
    while True:
        # leaves in order, and joined nodes, whose weights rise as they are made: the lightest is at the head of one
        leaves = sorted([w << 20 | i for i, w in enumerate(weights)])
        leaves.append(_HEAVIEST)
        joined, parent, i, j = [_HEAVIEST] * n, [0] * (2 * n - 1), 0, 0
        for node in range(n, 2 * n - 1):
            if leaves[i] < joined[j]:
                a, i = leaves[i], i + 1
            else:
                a, j = joined[j], j + 1
            if leaves[i] < joined[j]:
                b, i = leaves[i], i + 1
            else:
                b, j = joined[j], j + 1
            parent[a & 0xFFFFF] = parent[b & 0xFFFFF] = node
            joined[node - n] = (a >> 20) + (b >> 20) << 20 | node
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= most:
            return depth[:n]
        weights = [max(1, w >> 2) for w in weights]


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits; one used symbol has length 1."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    out[used] = _depths(counts[used].tolist(), most) if len(used) > 1 else 1
    return out


def _short_codes(sizes: list[int]) -> list[int]:
    """``canonical`` of few symbols with at most 7 bits."""
    codes, code, before = [0] * len(sizes), 0, 0
    for size, s in sorted([(size, s) for s, size in enumerate(sizes) if size]):
        code <<= size - before
        codes[s], code, before = _MIRROR_7[code] >> (7 - size), code + 1, size
    return codes


def _read_code(r: Reader, size: int) -> Code:
    if r.bits(1):
        two, wide = r.bits(1), r.bits(1)
        first = r.bits(8 if wide else 1)
        second = r.bits(8) if two else first
        return _alone(first) if first == second else Code(sorted((first, second)), [1, 1])
    inner, given = [0] * 19, 4 + r.bits(4)
    three = r.bits(3 * given)
    for i in _ORDER[:given]:
        inner[i] = three & 7
        three >>= 3
    several = sum(s > 0 for s in inner) > 1
    depth = max(inner) if several else 0
    if several and sum(1 << (depth - s) for s in inner if s) != 1 << depth:
        raise ValueError("prefix code is not complete")
    table = [0] * (1 << depth)  # symbol and length of each window
    for s, (code, n) in enumerate(zip(_short_codes(inner), inner, strict=True)):
        if n:
            n = n if several else 0
            table[code :: 1 << n] = [s << 3 | n] * (1 << (depth - n))
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else size
    begin, mask = r.at >> 3, (1 << depth) - 1
    window = int.from_bytes(r.data[begin : begin + 2 * size + 8], "little") >> (r.at & 7)  # 14 bits a symbol at most
    symbols, sizes, at, before, bits = [], [], 0, 8, 0
    while at < size and left:
        left -= 1
        entry = table[window & mask]
        s, n = entry >> 3, entry & 7
        window >>= n
        if s < 16:
            if s:
                symbols.append(at)
                sizes.append(s)
                before = s
            at += 1
        else:
            more = (2, 3, 7)[s - 16]
            run = (11 if s == 18 else 3) + (window & ((1 << more) - 1))
            window >>= more
            n += more
            if s == 16:
                run = min(run, size - at)
                symbols += range(at, at + run)
                sizes += [before] * run
            at += run
        bits += n
    r.at += bits
    return Code(symbols, sizes)


def _write_code(w: Writer, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a code's lengths; returns the codes and their sizes in use (none for a symbol alone)."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        w.put((1, 1), (0, 1), (1, 1), (int(used[0]) if len(used) else 0, 8))
        return np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fields: list[tuple[int, int, int]] = []
    at = 0
    for symbol, size in zip([*used.tolist(), len(lengths)], [*lengths[used].tolist(), 0], strict=True):
        gap = symbol - at
        while gap >= 3:
            n = min(gap, 138)
            fields.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
            gap -= n
        fields += [(0, 0, 0)] * gap
        if size:
            fields.append((size, 0, 0))
        at = symbol + 1
    inner = [0] * 19
    for s, _, _ in fields:
        inner[s] += 1
    some = [s for s, n in enumerate(inner) if n]
    for s, n in zip(some, _depths([inner[s] for s in some], 7) if len(some) > 1 else [1], strict=True):
        inner[s] = n
    codes = _short_codes(inner)
    n = max(4, 1 + max(k for k in range(19) if inner[_ORDER[k]]))
    w.put((0, 1), (n - 4, 4), *[(inner[_ORDER[k]], 3) for k in range(n)], (0, 1))
    sizes = inner if len(some) > 1 else [0] * 19
    w.put(*[(codes[s] | extra << sizes[s], sizes[s] + bits) for s, extra, bits in fields])
    return canonical(lengths), lengths if len(used) > 1 else np.zeros(len(lengths), np.int64)


# ---- images of entropy-coded pixels ----


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra value and extra bits of values from 1."""
    v = values - 1
    prefix = _PREFIX_OF[v].astype(np.int64)
    return prefix, v - _PREFIX_BASE[prefix], _PREFIX_BITS[prefix]


def matches(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths (1: a literal) of the tokens of a greedy parse, and how far back those that are copied lie: at the
    nearest earlier place with the same four pixels; a match goes on as long as the distance stays."""
    n = len(pixels)
    if n < 8:
        return np.arange(n), np.ones(n, np.int64), np.zeros(n, np.int64)
    if pixels.dtype == np.uint8:  # value and place in one number sort faster than by reference
        key = np.ndarray((n - 3,), "<u4", np.ascontiguousarray(pixels), strides=(1,)).astype(np.uint64)
        key <<= np.uint64(32)
        key |= np.arange(n - 3, dtype=np.uint64)
        key.sort()
        order, window = (key & np.uint64(0xFFFFFFFF)).view(np.int64), key >> np.uint64(32)
    else:
        p = pixels.astype(np.uint64)
        window = ((p[:-3] * np.uint64(0x9E3779B97F4A7C15) + p[1:-2]) * np.uint64(0xC2B2AE3D27D4EB4F) + p[2:-1]) * np.uint64(0x165667B19E3779F9) + p[3:]
        order = np.argsort(window, kind="stable")
        window = window[order]
    same = np.flatnonzero(window[1:] == window[:-1])
    later = order[same + 1]
    distance = np.zeros(n, np.int64)
    distance[later] = later - order[same]
    if n > FURTHEST:
        distance[distance > FURTHEST] = 0
    if pixels.dtype != np.uint8:  # windows were hashed
        at = np.flatnonzero(distance)
        for k in range(4):
            bad = pixels[at + k] != pixels[at - distance[at] + k]
            distance[at[bad]] = 0
            at = at[~bad]
    # stretches of one distance: where the next match from one of their places on begins at the earliest, and where it ends
    first = np.append(0, np.flatnonzero(distance[1:] != distance[:-1]) + 1)
    end = np.append(first[1:], n)
    none = distance[first] == 0
    begin, stop = np.where(none, end, first), np.where(none, np.append(end[1:], n), end) + 3
    stop[-1] = n  # the last three places begin no match
    size = end - first
    begin, stop, places = np.repeat(begin, size), np.repeat(stop, size), np.arange(n)
    if int(size.max()) > LONGEST - 4:
        stop = np.minimum(stop, np.maximum(begin, places) + LONGEST)
    step = stop - places
    step[step > 255] = 0  # looked up among the ends
    step, far_end, ends, at = step.astype(np.uint8).tobytes(), memoryview(stop), [0], 0
    add = ends.append
    while at < n:
        at = at + step[at] if step[at] else far_end[at]
        add(at)
    ends = np.array(ends)
    place = np.maximum(begin[ends[:-1]], ends[:-1])
    single = place - ends[:-1]  # literals before each match
    real = len(place) - int(place[-1] == n)  # only literals may be left at the end
    length, far = np.ones(int(single.sum()) + real, np.int64), np.zeros(int(single.sum()) + real, np.int64)
    token, place = (np.cumsum(single) + np.arange(len(single)))[:real], place[:real]
    length[token], far[token] = ends[1 : real + 1] - place, distance[place]
    return np.cumsum(length) - length, length, far


def _write_image(w: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, groups: tuple[int, np.ndarray] | None = None) -> None:
    """Write ``pixels`` (flat ARGB, or bytes for the green channel of opaque black) with one group of codes, or with the
    ``groups`` (bits, flat group of each tile)."""
    green_only = pixels.dtype == np.uint8
    starts, length, distance = matches(pixels)
    literal = length == 1
    copies = np.flatnonzero(~literal)
    argb = pixels[starts].astype(np.int64)
    symbol = argb if green_only else argb >> 8 & 255
    if cache_bits:
        w.put((1, 1), (cache_bits, 4))
        cache, flat, upto = [None] * (1 << cache_bits), pixels.tolist(), 0
        for i, (start, n) in enumerate(zip(starts.tolist(), length.tolist(), strict=True)):
            for p in flat[upto:start]:
                cache[((_CACHE_FACTOR * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            upto = start
            slot = ((_CACHE_FACTOR * flat[start]) & 0xFFFFFFFF) >> (32 - cache_bits)
            if n == 1 and cache[slot] == flat[start]:
                symbol[i], literal[i] = 280 + slot, False
    else:
        w.put((0, 1))
    prefix, extra, bits = _prefix(length[copies])
    symbol[copies] = 256 + prefix
    # a distance code of 121 on is a plain distance; the pixel above and to the left have short ones
    distance = distance[copies]
    far = np.where(distance == width, 1, np.where(distance == 1, 2, distance + 120)) if width > 1 else distance + 120
    d_prefix, d_extra, d_bits = _prefix(far)
    group = None
    if main:
        w.put((int(groups is not None), 1))
        if groups is not None:
            g_bits, tiles = groups
            w.put((g_bits - 2, 3))
            across = (width + (1 << g_bits) - 1) >> g_bits
            _write_image(w, (tiles.astype(np.uint32) << 8) | np.uint32(0xFF000000), across, False)
            group = tiles[(starts // width >> g_bits) * across + (starts % width >> g_bits)].astype(np.int64)
    # the bits of a token make one number: 60 at most
    value, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)

    def add(at: np.ndarray | slice, values: np.ndarray, sizes: np.ndarray) -> None:
        value[at] |= values << size[at]
        size[at] += sizes

    def coded(at: np.ndarray | slice, symbols: np.ndarray, alphabet: int) -> None:
        codes, used = _write_code(w, code_lengths(np.bincount(symbols, minlength=alphabet)))
        add(at, codes.take(symbols), used.take(symbols))

    for g in range(1 if groups is None else int(groups[1].max()) + 1):
        of = slice(None) if group is None else np.flatnonzero(group == g)
        far_of = slice(None) if group is None else np.flatnonzero(group[copies] == g)
        coded(of, symbol[of], 280 + (1 << cache_bits if cache_bits else 0))
        add(copies[far_of], extra[far_of], bits[far_of])
        if green_only:  # one value of the others: no bits
            w.put(*((1, 1), (0, 1), (1, 1), (0, 8)) * 2, (1, 1), (0, 1), (1, 1), (255, 8))
        else:
            plain = np.flatnonzero(literal if group is None else literal & (group == g))
            for shift in (16, 0, 24):
                coded(plain, argb[plain] >> shift & 255, 256)
        coded(copies[far_of], d_prefix[far_of], 40)
        add(copies[far_of], d_extra[far_of], d_bits[far_of])
    w.many(value, size)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = _NEAR[code - 1]
    return max(1, x + y * width)


_NEAR_X, _NEAR_Y = np.array([p[0] for p in _NEAR]), np.array([p[1] for p in _NEAR])


def _read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """Flat ARGB pixels of an entropy-coded image."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    g_bits, tiles = 0, None
    if main and r.bits(1):
        g_bits = 2 + r.bits(3)
        tiles = (_read_image(r, (width + (1 << g_bits) - 1) >> g_bits, (height + (1 << g_bits) - 1) >> g_bits, False) >> 8 & 0xFFFF).tolist()
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_read_code(r, n) for n in sizes] for _ in range(max(tiles) + 1 if tiles else 1)]
    if cache_bits or tiles:
        return _walk_pixels(r, width, height, cache_bits, g_bits, tiles, groups)
    return _read_pixels(r, width, width * height, groups[0])


def _walk_pixels(r: Reader, width: int, height: int, cache_bits: int, g_bits: int, tiles: list[int] | None, groups: list[list[Code]]) -> np.ndarray:
    """Pixel by pixel, for images with a colour cache or several groups of codes."""
    out: list[int] = []
    n, across = width * height, (width + (1 << g_bits) - 1) >> g_bits
    cache, cached = [0] * (1 << cache_bits), 0
    while len(out) < n:
        y, x = divmod(len(out), width)
        green, red, blue, alpha, far = groups[tiles[(y >> g_bits) * across + (x >> g_bits)] if tiles else 0]
        s = r.symbol(green)
        if s < 256:
            a = r.symbol(red) << 16 | s << 8
            a |= r.symbol(blue)
            out.append(r.symbol(alpha) << 24 | a)
        elif s < 280:
            length = r.value(s - 256)
            distance = _distance(r.value(r.symbol(far)), width)
            for _ in range(length):
                out.append(out[-distance])
        else:
            for p in out[cached:]:
                cache[((_CACHE_FACTOR * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached = len(out)
            out.append(cache[s - 280])
    return np.array(out[:n], np.uint32)


def _read_pixels(r: Reader, width: int, n: int, codes: list[Code]) -> np.ndarray:
    """All tokens of an image with one group of codes and no cache, looked up for every bit position at once."""
    green, red, blue, alpha, far = codes
    if not green.depth and green.only < 256 and not (red.depth or blue.depth or alpha.depth):
        return np.full(n, alpha.only << 24 | red.only << 16 | green.only << 8 | blue.only, np.uint32)
    low = r.at >> 3
    most = n * (green.depth + max(red.depth + blue.depth + alpha.depth, far.depth + 30)) // 8 + 16
    data = r.data[low : low + most]
    end = 8 * len(data)
    word = np.ndarray((len(data) + 9,), "<i8", data + bytes(16), strides=(1,)).astype(np.int64)  # 56 bits or more from each bit on

    def ahead(at: np.ndarray) -> np.ndarray:
        return word.take(at >> 3) >> (at & 7)

    window = word[: len(data), None] >> np.arange(8)
    window &= (1 << green.depth) - 1
    window = window.ravel()
    of_copy = green.used >= 256
    # bits of a token that each green symbol gives, and a mark of copies; then the bits of all
    known = green.sizes + of_copy * (128 + _PREFIX_BITS[np.maximum(green.used, 256) - 256])
    jump = known.astype(np.uint8).take(green.entry).take(window)
    literals = red.depth + blue.depth + alpha.depth > 0
    if of_copy.any():
        copies = np.flatnonzero(jump > 127)
        known = jump.take(copies) & 127
        after = (far.sizes + _PREFIX_BITS[far.used]).astype(np.uint8).take(far.entry)
        jump[copies] = known + after.take(ahead(copies + known) & ((1 << far.depth) - 1))
    if literals:
        at = plain = np.flatnonzero(green.symbol[window] < 256)
        at = at + jump[plain]
        for code in (red, blue, alpha):
            at = at + code.length[ahead(at) & ((1 << code.depth) - 1)]
        jump[plain] = at - plain
    if not green.depth:  # a token without bits ends the walk
        jump[jump == 0] = 255
    steps, at, starts = jump.tobytes(), r.at - 8 * low, []
    add = starts.append
    while at < end:
        add(at)
        at += steps[at]
    del starts[n:]  # a token is a pixel at least
    starts = np.array(starts, np.int64)
    symbol = window.take(starts)
    symbol, size = green.symbol.take(symbol), green.length.take(symbol)
    copied = np.flatnonzero(symbol >= 256)
    prefix = symbol[copied] - 256
    bits = ahead(starts[copied] + size[copied])
    length = np.ones(len(starts), np.int64)
    length[copied] = _PREFIX_BASE[prefix] + (bits & ((1 << _PREFIX_BITS[prefix]) - 1)) + 1
    stop = np.cumsum(length)
    real = int(np.searchsorted(stop, n)) + 1
    if real > len(starts):
        raise ValueError("image data ends early")
    bits >>= _PREFIX_BITS[prefix]
    d = bits & ((1 << far.depth) - 1)
    d, d_size = far.symbol[d], far.length[d]
    code = _PREFIX_BASE[d] + (bits >> d_size & ((1 << _PREFIX_BITS[d]) - 1)) + 1
    near = np.minimum(code, 120) - 1
    distance = np.zeros(len(starts), np.int64)
    distance[copied] = np.where(code > 120, code - 120, np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * width))
    argb = symbol << 8
    if literals:
        at = starts + size
        for c, shift in ((red, 16), (blue, 0), (alpha, 24)):
            s = ahead(at) & ((1 << c.depth) - 1)
            argb, at = argb | c.symbol[s] << shift, at + c.length[s]
    else:
        argb |= red.only << 16 | blue.only | alpha.only << 24
    r.at = 8 * low + int(starts[real - 1]) + steps[int(starts[real - 1])]
    source = np.arange(n) - distance[:real].repeat(length[:real])[:n]
    if int(source.min()) < 0:
        raise ValueError("reference before the first pixel")
    while True:
        source = source.take(source)
        further = source.take(source)
        if (further == source).all():
            return argb[:real].astype(np.uint32).repeat(length[:real])[:n].take(source)
        source = further


# ---- transforms ----


def _channels(p: np.ndarray) -> np.ndarray:
    return np.stack([p >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _packed(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 0xFF
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(mode: int, left, top, corner, right) -> list[int]:
    """A predictor's value of four channels from the neighbours' channels: left, above, above left and above right."""
    average = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode <= 4:
        return list((left, top, right, corner)[mode - 1])
    if mode == 5:
        return average(average(left, right), top)
    if mode <= 9:
        return average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return average(average(left, corner), average(top, right))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        by_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return list(left if by_left < by_top else top)
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    half = average(left, top)
    return [clamp(h + int((h - c) / 2)) for h, c in zip(half, corner, strict=True)]


def _predicted(done: list[list[int]], i: int, width: int, mode: int) -> list[int]:
    y, x = divmod(i, width)
    if not y:
        return [255, 0, 0, 0] if not x else done[i - 1]
    if not x:
        return done[i - width]
    # right of the last column stands the first pixel of this line, as in memory
    return predict(mode, done[i - 1], done[i - width], done[i - width - 1], done[i - width + 1])


def _predictor(pixels: np.ndarray, width: int, bits: int, modes: np.ndarray, forward: bool) -> np.ndarray:
    c = _channels(pixels).tolist()
    across, modes = (width + (1 << bits) - 1) >> bits, modes.tolist()
    done, out = c if forward else [], []
    for i, own in enumerate(c):
        y, x = divmod(i, width)
        p = _predicted(done, i, width, modes[(y >> bits) * across + (x >> bits)])
        value = [(a - b if forward else a + b) & 255 for a, b in zip(own, p, strict=True)]
        out.append(value)
        if not forward:
            done.append(value)
    return _packed(np.array(out).reshape(-1, 4))


def _cross(pixels: np.ndarray, width: int, bits: int, elements: np.ndarray, forward: bool) -> np.ndarray:
    """Elements hold red-to-blue, green-to-blue and green-to-red in red, green and blue, as signed bytes of 1/32."""
    c, sign = _channels(pixels), -1 if forward else 1
    i, across = np.arange(len(pixels)), (width + (1 << bits) - 1) >> bits
    e = _channels(elements)[(i // width >> bits) * across + (i % width >> bits)]
    signed = lambda v: (v & 255) - ((v & 128) << 1)
    delta = lambda t, v: (signed(t) * signed(v)) >> 5
    red, green, blue = c[:, 1], c[:, 2], c[:, 3]
    new_red = (red + sign * delta(e[:, 3], green)) & 255
    plain_red = red if forward else new_red
    new_blue = (blue + sign * (delta(e[:, 2], green) + delta(e[:, 1], plain_red))) & 255
    return _packed(np.stack([c[:, 0], new_red, green, new_blue], axis=-1))


def _subtract_green(pixels: np.ndarray, forward: bool) -> np.ndarray:
    if not forward and not (pixels & np.uint32(0x00FF00FF)).any():  # grey
        green = pixels >> np.uint32(8) & np.uint32(0xFF)
        return pixels | green << np.uint32(16) | green
    c, sign = _channels(pixels), -1 if forward else 1
    c[:, 1], c[:, 3] = c[:, 1] + sign * c[:, 2], c[:, 3] + sign * c[:, 2]
    return _packed(c)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _bundled(index: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Palette indices of several neighbours in one byte."""
    if not bits:
        return index.astype(np.uint8)
    rows = index.reshape(-1, width).astype(np.int64)
    rows = np.pad(rows, ((0, 0), (0, -width % (1 << bits))))
    parts = rows.reshape(len(rows), -1, 1 << bits) << (np.arange(1 << bits) * (8 >> bits))
    return parts.sum(axis=2).astype(np.uint8).ravel()


def _palette_deltas(colours: np.ndarray) -> np.ndarray:
    c = _channels(colours)
    c[1:] -= _channels(colours)[:-1]
    return _packed(c)


def _wide(flat: np.ndarray) -> np.ndarray:
    """Opaque pixels of a green channel; pixels as they are."""
    return flat.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000) if flat.dtype == np.uint8 else flat


# ---- files ----


def _opened(width: int, height: int, alpha: bool) -> Writer:
    w = Writer()
    w.put((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3))
    return w


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, groups: tuple[int, np.ndarray] | None = None, extra: bytes = b"") -> bytes:
    """A WebP file of (height, width) ARGB pixels. Transforms, in their order: ("green",), ("palette",), ("predictor", bits,
    modes), ("cross", bits, elements), the last two with a flat array of one entry a tile."""
    height, width = pixels.shape
    w = _opened(width, height, bool((pixels >> 24 != 255).any()))
    flat = pixels.ravel().astype(np.uint32)
    for name, *parts in transforms:
        if name == "green":
            w.put((1, 1), (_GREEN, 2))
            flat = _subtract_green(_wide(flat), True)
            if not (flat & np.uint32(0xFFFF00FF) ^ np.uint32(0xFF000000)).any():
                flat = (flat >> np.uint32(8)).astype(np.uint8)
        elif name == "palette":
            colours, index = np.unique(flat, return_inverse=True)
            bits = _bundle_bits(len(colours))
            w.put((1, 1), (_PALETTE, 2), (len(colours) - 1, 8))
            _write_image(w, _palette_deltas(colours), len(colours), False)
            flat = _bundled(index, width, bits)
            width = (width + (1 << bits) - 1) >> bits
        else:
            bits, tiles = parts
            tiles = tiles.astype(np.uint32)
            w.put((1, 1), (_PREDICTOR if name == "predictor" else _CROSS, 2), (bits - 2, 3))
            coded = (tiles << 8 if name == "predictor" else tiles) | np.uint32(0xFF000000)
            _write_image(w, coded, (width + (1 << bits) - 1) >> bits, False)
            flat = (_predictor if name == "predictor" else _cross)(_wide(flat), width, bits, tiles, True)
    w.put((0, 1))
    if cache_bits:
        flat = _wide(flat)
    _write_image(w, flat, width, True, cache_bits, groups)
    return _container(w.bytes(), extra)


def _container(image: bytes, extra: bytes = b"") -> bytes:
    chunk = lambda name, data: name + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    body = chunk(b"VP8L", image) + (chunk(b"PLEN", extra) if extra else b"")
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body


def _parts(data: bytes) -> dict[bytes, bytes]:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, at = {}, 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        out[data[at : at + 4]] = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return out


def decode(data: bytes, green_only: bool = False) -> np.ndarray:
    """(height, width) ARGB pixels of a lossless WebP file, or their green channel as bytes."""
    r = Reader(_parts(data)[b"VP8L"])
    if r.bits(8) != 0x2F:
        raise ValueError("not a lossless image")
    full_width, height = r.bits(14) + 1, r.bits(14) + 1
    if r.bits(4) >> 1:
        raise ValueError("unknown version")
    width, undo = full_width, []
    while r.bits(1):
        kind = r.bits(2)
        if kind in (_PREDICTOR, _CROSS):
            bits = r.bits(3) + 2
            tiles = _read_image(r, (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False)
            undo.append((kind, width, bits, tiles))
        elif kind == _PALETTE:
            n = r.bits(8) + 1
            colours = _packed(np.cumsum(_channels(_read_image(r, n, 1, False)), axis=0))
            undo.append((kind, width, _bundle_bits(n), colours))
            width = (width + (1 << _bundle_bits(n)) - 1) >> _bundle_bits(n)
        else:
            undo.append((kind, width, 0, None))
    flat = _read_image(r, width, height, True)
    if green_only and all(kind == _GREEN for kind, *_ in undo):  # that channel is stored as it is
        undo = []
    for kind, width, bits, tiles in reversed(undo):
        if kind == _PREDICTOR:
            flat = _predictor(flat, width, bits, tiles >> 8 & 0xFF, False)
        elif kind == _CROSS:
            flat = _cross(flat, width, bits, tiles, False)
        elif kind == _GREEN:
            flat = _subtract_green(flat, False)
        else:
            index = (flat >> 8 & 0xFF).astype(np.int64)
            if bits:
                per = 8 >> bits
                rows = (index.reshape(height, -1, 1) >> (np.arange(1 << bits) * per)) & ((1 << per) - 1)
                index = rows.reshape(height, -1)[:, :width].ravel()
            colours = np.concatenate([tiles, np.zeros(max(0, 256 - len(tiles)), np.uint32)])  # beyond the table: transparent
            flat = colours[index]
    if green_only:
        flat = (flat >> np.uint32(8)).astype(np.uint8)
    return flat.reshape(height, full_width)


# ---- payloads ----


def padded(data: bytes) -> bytes:
    """Zeros up to a positive multiple of ``PAD``."""
    return data + b"\0" * (-len(data) % PAD if data else PAD)


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of ``PAD`` bytes as a grey picture."""
    width, extra = PAD, b""
    while len(payload) > width * MOST and width < MOST:
        width *= 2
        extra = len(payload).to_bytes(8, "little")
    if len(payload) > width * MOST:
        raise ValueError("payload is too long for one picture")
    samples = np.frombuffer(payload + b"\0" * (-len(payload) % width), np.uint8)
    if np.count_nonzero(np.bincount(samples, minlength=256)) <= 16:
        grey = samples.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)
        return encode(grey.reshape(-1, width), (("palette",),), extra=extra)
    w = _opened(width, len(samples) // width, False)  # as ``encode`` with ("green",), which leaves the samples as they are
    w.put((1, 1), (_GREEN, 2), (0, 1))
    _write_image(w, samples, width, True)
    return _container(w.bytes(), extra)


def load(media: bytes) -> np.ndarray:
    """The samples of a stored payload, as (lines, samples) of bytes."""
    samples = decode(media, green_only=True)
    length = _parts(media).get(b"PLEN")
    return samples if length is None else samples.ravel()[: int.from_bytes(length, "little")].reshape(-1, PAD)


def _media(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out, held = [], 0
        for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            out.append((doc_id, len(raw), store(padded(raw))))
            held += len(out[-1][2])
            if held > 16_000_000:
                yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "media"]).astype({"doc_id": "Int64"})
                out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "media"]).astype({"doc_id": "Int64"})


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the file) of each row of ``docs`` (doc_id, text); a null text counts as empty. Repeated
    rows come back once each, equal texts give equal files, and other columns are ignored."""
    return docs.select("doc_id", "text").mapInPandas(_media, "doc_id long, n_bytes long, media binary")


def _loaded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, n, media in zip(batch["doc_id"].astype("Int64"), batch["n_bytes"], batch["media"], strict=True):
            samples = load(media)
            payload = samples.tobytes()
            counts = np.bincount(samples.ravel(), minlength=256)
            p = counts[counts > 0] / samples.size
            feature = f"{samples.shape[1]}x{samples.shape[0]} mean={samples.mean():.4f} entropy={-(p * np.log2(p)).sum():.4f} values={len(p)}"
            out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({"doc_id": "Int64"})


def features(media: DataFrame) -> DataFrame:
    """Digests of the payloads that are read back from ``to_media``'s rows, and a feature of their samples."""
    return media.mapInPandas(_loaded, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pixels = [decode(m) for m in batch["media"]]
        yield pd.DataFrame({"height": [p.shape[0] for p in pixels], "width": [p.shape[1] for p in pixels], "argb": [p.astype("<u4").tobytes() for p in pixels]}).assign(id=batch["id"].to_numpy())[["id", "height", "width", "argb"]]


def pixel_arrays(files: DataFrame) -> DataFrame:
    """id, height, width and argb (little-endian 32-bit pixels, line by line) of lossless WebP files (id, media)."""
    return files.select("id", "media").where("media IS NOT NULL").mapInPandas(_arrays, "id long, height int, width int, argb binary")
