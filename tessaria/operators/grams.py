"""A text's character windows as whole arrays: sorted 60-bit keys, their numbers, minima and counts.

Five characters of the scripts that are met most (code points below 0x800, and 0x2000 to 0x27FF with the signs of print) are one key of 60 bits,
and the keys of a text are exact. Texts with other characters, or windows of another length, take the way over strings with the same results.
What a worker has met lies in tables of a fixed size, where a newer gram takes the place of an older one.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .dedup import PRIME, permutations

#: Places for grams that a worker has met, with their numbers, 16 bytes each.
KNOWN = 1 << 20
_U = np.uint64
_FREE = _U(2**64 - 1)
_A, _B = (np.array(x, np.uint64)[None, :] for x in zip(*permutations(64), strict=True))
_P, _P32, _BITS = _U(PRIME), np.uint32(PRIME), _U(31)
_TABLES: dict[str, np.ndarray] = {}


def _table(name: str, make) -> np.ndarray:
    if name not in _TABLES:
        _TABLES[name] = make()
    return _TABLES[name]


def windows(text: str, n: int = 5) -> set[str]:
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))}


def digests(grams) -> np.ndarray:
    """The first 64 bits of each gram's SHA-256."""
    return np.frombuffer(b"".join([hashlib.sha256(g.encode()).digest()[:8] for g in grams]), ">i8").astype(np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """x sorted in place, each value once."""
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def keys(text: str, n: int = 5) -> np.ndarray | None:
    """A text's windows as keys, one for each place; None if they have none."""
    if n != 5 or len(text) < n:
        return None
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if p.max() >= 0x800:
        far = p >= 0x800
        q = p[far] - np.uint32(0x1800)
        if q.min() < 0x800 or q.max() >= 0x1000:
            return None
        p = p.copy()
        p[far] = q
    # A character 0 would be lost at the end of a window.
    if not p.min():
        return None
    p = p.astype(np.uint64)
    two = (p[:-1] << _U(12)) | p[1:]
    return (two[:-3] << _U(36)) | (two[2:-1] << _U(12)) | p[4:]


def _strings(k: np.ndarray) -> list[str]:
    points = np.empty((len(k), 5), np.uint32)
    for j in range(5):
        points[:, j] = (k >> _U(12 * (4 - j))) & _U(0xFFF)
    points[points >= 0x800] += np.uint32(0x1800)
    return points.view("<U5")[:, 0].tolist()


def numbers(k: np.ndarray, keep: bool = True) -> np.ndarray:
    """The numbers of keys, in their order; with `keep` those that are new are remembered."""
    held, out = _table("keys", lambda: np.full(KNOWN, _FREE)), _table("numbers", lambda: np.zeros(KNOWN, np.int64))
    at = ((k * _U(0x9E3779B97F4A7C15)) >> _U(64 - KNOWN.bit_length() + 1)).astype(np.int64)
    got, new = out[at], np.flatnonzero(held[at] != k)
    if len(new):
        got[new] = digests(_strings(k[new]))
        if keep:
            # Of keys with one place the last stays, for both tables alike.
            held[at[new]] = k[new]
            out[at[new]] = got[new]
    return got


def ids(text: str, n: int = 5) -> np.ndarray:
    """The distinct windows of a text as sorted numbers; a shorter text is one window."""
    k = keys(text, n)
    return distinct(digests(windows(text, n)) if k is None else numbers(distinct(k)))


def window_set(text: str, n: int = 5) -> np.ndarray | set[str]:
    """A text's distinct windows: sorted keys, or strings where it has none."""
    k = keys(text, n)
    return windows(text, n) if k is None else distinct(k)


def _alike(x, y):
    """Two window sets in one form, as strings if one of them is."""
    as_strings = lambda s: s if isinstance(s, set) else set(_strings(s))
    return (as_strings(x), as_strings(y)) if isinstance(x, set) or isinstance(y, set) else (x, y)


def shared(x, y) -> int:
    """How many windows two window sets share."""
    x, y = _alike(x, y)
    return len(x & y) if isinstance(x, set) else int(np.count_nonzero(among(x, y)))


def part_numbers(x, y, common: bool) -> np.ndarray:
    """The sorted numbers of the windows of x that y has too, or of those that it hasn't."""
    x, y = _alike(x, y)
    if isinstance(x, set):
        return np.sort(digests(x & y if common else x - y))
    there = among(x, y)
    return np.sort(numbers(x[there if common else ~there]))


def _remainders(v: np.ndarray) -> np.ndarray:
    """(a v + b) mod p for the 64 permutations, a row for each v (below 2^32)."""
    # The modulus is 2^31 - 1, so its multiples are folded in by shifts; below p, x - p wraps around and is the larger.
    x = ((v & _P) + (v >> _BITS))[:, None] * _A
    x += _B
    y = x >> _BITS
    x &= _P
    x += y
    z = x.astype(np.uint32)
    return np.minimum(z, z - _P32, out=z)


def minima(grams: np.ndarray) -> np.ndarray:
    """The 64 minima of (a v + b) mod p over the upper 32 bits v of the grams; p itself for no grams."""
    v, out = (np.asarray(grams, np.int64) >> 32).astype(np.uint64) & _U(0xFFFFFFFF), np.full(64, PRIME, np.uint32)
    for k in range(0, len(v), 256):
        np.minimum(out, _remainders(v[k : k + 256]).min(axis=0), out=out)
    return out.astype(np.int64)


def among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x stand in y; both are sorted."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return y[at] == x if len(y) else np.zeros(len(x), bool)


class Counts:
    """How many texts hold each key, for texts that come one by one."""

    def __init__(self, room: int = 1 << 21) -> None:
        self.room = room
        self.clear()

    def clear(self) -> None:
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.waiting = 0

    def add(self, k: np.ndarray) -> None:
        self.new.append(k)
        self.waiting += len(k)
        if self.waiting >= self.room:
            self.settle()

    def settle(self) -> None:
        """Counts what waits."""
        x = np.concatenate([np.zeros(0, np.uint64), *self.new])
        self.new, self.waiting = [], 0
        if not len(x):
            return
        x.sort()
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        x, n = x[first], np.diff(np.append(first, len(x)))
        at = np.searchsorted(self.keys, x)
        here = np.zeros(len(x), bool)
        inside = at < len(self.keys)
        here[inside] = self.keys[at[inside]] == x[inside]
        self.n[at[here]] += n[here]
        self.keys, self.n = (np.insert(a, at[~here], b[~here]) for a, b in ((self.keys, x), (self.n, n)))
