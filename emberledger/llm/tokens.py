"""Words, lines and their fingerprints over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

_FACTOR = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that separate words, by class; those of other letters than A-Z never do.
BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALPHANUMERIC = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values; a bijection."""
    return _by_blocks(_mixed, np.asarray(x).astype(np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Items that an expression of many steps works on at once, so that what is in between stays in
#: the cache and its memory is used again.
_AT_ONCE = 8192


def _by_blocks(f: Callable[..., np.ndarray], *arrays: np.ndarray) -> np.ndarray:
    n = arrays[0].size
    if arrays[0].ndim != 1 or n <= _AT_ONCE:
        return f(*arrays)
    out = np.empty(n, np.uint64)
    for i in range(0, n, _AT_ONCE):
        out[i:i + _AT_ONCE] = f(*(x[i:i + _AT_ONCE] for x in arrays))
    return out


#: Fingerprints are polynomials modulo this prime. Sums modulo a power of two would not do: texts
#: that follow the Thue-Morse sequence have equal ones, whatever the base and the byte values.
_PRIME = (1 << 61) - 1
#: Bytes whose powers are tabulated; prefix sums begin anew at each block.
_SHIFT = 12
_BLOCK = 1 << _SHIFT
#: Bytes of which prefix sums are held at once for pieces that do not overlap.
_CHUNK = 256 << 10
_P, _LOW29, _LOW30, _LOW31, _LOW32 = (
    np.uint64(x) for x in (_PRIME, (1 << 29) - 1, (1 << 30) - 1, (1 << 31) - 1, (1 << 32) - 1))
_1, _29, _30, _31, _32, _61 = (np.uint64(x) for x in (1, 29, 30, 31, 32, 61))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.minimum(x, x - _P)  # which wraps below zero


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of factors below it."""
    a_high, a_low, b_high, b_low = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a_high * b_low + a_low * b_high
    return _reduced(((a_high * b_high) << _1) + (middle >> _30)
                    + ((middle & _LOW30) << _31) + a_low * b_low)


@lru_cache(maxsize=None)
def _base(salt: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The base of the polynomials, its powers below a block, and their inverses."""
    base = int(mix(np.array([1 + salt]))[0]) % _PRIME
    inverse = pow(base, -1, _PRIME)
    up, down = [1], [1]
    for _ in range(_BLOCK - 1):
        up.append(up[-1] * base % _PRIME)
        down.append(down[-1] * inverse % _PRIME)
    return base, np.array(up, np.uint64), np.array(down, np.uint64)


@lru_cache(maxsize=None)
def _byte_values(lower: bool) -> np.ndarray:
    """A small number for each byte; ``lower`` gives A-Z those of a-z."""
    of = np.arange(1, 257, dtype=np.uint64)
    if lower:
        of[0x41:0x5B] += np.uint64(32)
    return of


class Sums:
    """Prefix sums of bytes, block by block, from which the fingerprint of any substring comes."""

    def __init__(self, data: np.ndarray, lower: bool = False, salt: int = 0) -> None:
        self.base, up, self.down = _base(salt)
        values, blocks = _byte_values(lower), -(-len(data) // _BLOCK)
        self.local = np.zeros(blocks * _BLOCK + 1, np.uint64)
        self.totals = np.zeros(blocks, np.uint64)
        rows = _AT_ONCE // _BLOCK
        for first in range(0, blocks, rows):
            part = data[first * _BLOCK:(first + rows) * _BLOCK]
            padded = np.zeros((min(rows, blocks - first), _BLOCK), np.uint64)
            padded.ravel()[:len(part)] = values[part]
            low = np.cumsum(padded * (up & _LOW32), axis=1)
            high = np.cumsum(padded * (up >> _32), axis=1)
            low += (high >> _29) + ((high & _LOW29) << _32)
            low = _reduced(low)
            self.totals[first:first + rows] = low[:, -1]
            low[:, -1] = 0  # the next block begins here
            self.local[1 + first * _BLOCK:1 + first * _BLOCK + low.size] = low.ravel()

    @cached_property
    def _whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each block: the sum before it, its power and the inverse of that."""
        step = pow(self.base, _BLOCK, _PRIME)
        back, before, power, inverse = pow(step, -1, _PRIME), [0], [1], [1]
        for total in self.totals.tolist():
            before.append((before[-1] + total * power[-1]) % _PRIME)
            power.append(power[-1] * step % _PRIME)
            inverse.append(inverse[-1] * back % _PRIME)
        return tuple(np.array(x, np.uint64) for x in (before, power, inverse))

    def between(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The polynomials of substrings: of equal bytes they are equal, wherever they stand."""
        return _by_blocks(self._between, begins, ends)

    def _between(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        block, stop = begins >> _SHIFT, ends >> _SHIFT
        difference = self.local[ends] + _P - self.local[begins]
        across = np.flatnonzero(block != stop)
        if len(across):
            before, power, inverse = self._whole
            b, e = (_reduced(before[k] + _times(self.local[at], power[k])) for k, at in (
                (block[across], begins[across]), (stop[across], ends[across])))
            difference[across] = _times(_reduced(e + _P - b), inverse[block[across]])
        return _times(_reduced(difference), self.down[begins & (_BLOCK - 1)])


@dataclass
class Texts:
    """Texts laid end to end: ``data`` holds their bytes, ``offsets`` where each begins."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = column.fill_null("")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        kind = np.int64 if wide else np.int32
        _nulls, places, data = column.buffers()
        offsets = np.frombuffer(places, kind, len(column) + 1 + column.offset)[column.offset:]
        begin, end = int(offsets[0]), int(offsets[-1])
        if data is None or begin == end:
            return cls(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
        return cls(np.frombuffer(data, np.uint8, end)[begin:], offsets.astype(np.int64) - begin)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def pieces(self, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each maximal run of bytes that are not ``apart`` (by byte value);
        no run crosses texts."""
        return self.stretches(~apart[self.data])

    def stretches(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each maximal run of bytes marked as inside; none crosses texts."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[starts] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[starts[1:] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def ranges(self, begins: np.ndarray) -> np.ndarray:
        """Of sorted positions, the number that lie before each text, and in all texts."""
        return np.searchsorted(begins, self.offsets)

    def sums(self, lower: bool = False, salt: int = 0) -> Sums:
        """Prefix sums from which ``fingerprints`` takes any substring's."""
        return Sums(self.data, lower, salt)

    def prints(self, begins: np.ndarray, ends: np.ndarray, lower: bool = False,
               salt: int = 0) -> np.ndarray:
        """Fingerprints of sorted pieces that do not overlap, a stretch of bytes at a time."""
        out, i = np.empty(len(begins), np.uint64), 0
        while i < len(begins):
            at = int(begins[i])
            j = max(i + 1, int(np.searchsorted(ends, at + _CHUNK, "right")))
            sums = Sums(self.data[at:int(ends[j - 1])], lower, salt)
            out[i:j] = fingerprints(sums, begins[i:j] - at, ends[i:j] - at)
            i = j
        return out


def fingerprints(sums: Sums, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of substrings: equal bytes have equal ones, wherever they stand."""
    return _by_blocks(
        lambda b, e: _mixed(sums.between(b, e) + ((e - b).astype(np.uint64) << _32)), begins, ends)


class Words:
    """The words of the texts: their places, fingerprints and the range of each text."""

    def __init__(self, texts: Texts, apart: np.ndarray = BLANKS, lower: bool = False,
                 salt: int = 0) -> None:
        self.texts, self.lower, self.salt = texts, lower, salt
        self.begins, self.ends = texts.pieces(apart)
        self.ranges = texts.ranges(self.begins)

    @cached_property
    def keys(self) -> np.ndarray:
        return self.texts.prints(self.begins, self.ends, self.lower, self.salt)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.ranges)

    @cached_property
    def owners(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.texts)), self.counts)


def windows(keys: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Fingerprints of ``size`` consecutive keys from each place that has as many; windows that
    cross texts are among them."""
    n = max(0, len(keys) - size + 1)

    def some(at: np.ndarray) -> np.ndarray:
        low, high = int(at[0]), int(at[-1]) + 1
        out = np.full(high - low, 1 + salt, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size):
                out = out * _FACTOR + keys[low + i:high + i]
                out = out ^ (out >> np.uint64(29))
        return _mixed(out)

    return _by_blocks(some, np.arange(n)) if n else np.zeros(0, np.uint64)


def within(ranges: np.ndarray, size: int) -> np.ndarray:
    """Places of windows of ``size`` words that lie in one text, given the texts' word ranges."""
    counts = np.maximum(np.diff(ranges) - size + 1, 0)
    first = np.repeat(ranges[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return first + np.arange(int(counts.sum()))


def covered(n: int, places: np.ndarray, size: int) -> np.ndarray:
    """Of ``n`` items, those that lie in a window of ``size`` from one of the places."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, np.minimum(places + size, n), -1)
    return np.cumsum(change[:-1]) > 0
