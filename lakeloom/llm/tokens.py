"""Words of many texts as arrays of 64-bit hashes, computed by whole-buffer array operations.

A word is a longest run of letters and digits of the lower-cased text (every non-ASCII character counts as a letter).
"""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at a time; a longer word makes the piece longer.
_PIECE = 1 << 18
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a piece of usual length are kept."""
    size = max(_PIECE + 1024, n)
    if size in _powers:
        return _powers[size]
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    if size == _PIECE + 1024:
        _powers[size] = up, down
    return up, down


def _piece_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one piece, which neither starts nor ends within a word."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _IS_WORD[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _power_tables(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and at last the number of words)."""
    encoded = [t.lower().encode("utf-8", "replace") for t in texts]
    buffer = b"\n".join(encoded) + b"\n"
    raw = np.frombuffer(buffer, np.uint8)
    hashes, places, at = [], [], 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        while end < len(raw) and _IS_WORD[raw[end - 1]]:
            end += 1
        h, s = _piece_words(raw[at:end])
        hashes.append(h)
        places.append(s + at)
        at = end
    found, where = (np.concatenate(x) for x in (hashes, places))
    lengths = np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    return found, np.searchsorted(where, begins)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a text, in text order; a text of 1 to k-1 words has one run of all its words."""
    counts = np.diff(first)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(per)])
    n = len(hashes)
    out = np.zeros(out_first[-1], np.uint64)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            rolled += hashes[j : n - k + 1 + j] * np.uint64(2 * (j * 0x51ED27 + 0x2545F491) + 1)
        rolled = mix(rolled)
        long = counts >= k
        at = np.repeat(first[:-1][long] - out_first[:-1][long], per[long])
        to = np.flatnonzero(np.repeat(long, per))
        out[to] = rolled[to + at]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = hashlib.blake2b(hashes[first[i] : first[i + 1]].tobytes(), digest_size=8).digest()
        out[out_first[i]] = np.frombuffer(own, np.uint64)[0]
    return out, out_first


def labelled(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each value mixed with the number of its occurrences before it in the same text, so a text's values are distinct."""
    if not len(values):
        return values
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    both = values + text * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(both)
    same = np.flatnonzero(both[order[1:]] == both[order[:-1]]) + 1
    out = values.copy()
    if len(same):
        new = np.ones(len(values), bool)
        new[same] = False
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        member = size[run] > 1
        places, runs = order[member], run[member]
        places = places[np.lexsort((places, runs))]
        begin = np.concatenate([[0], np.cumsum(size[size > 1])])[:-1]
        nth = np.arange(len(places)) - np.repeat(begin, size[size > 1])
        # the first occurrence keeps the value, as it does in a text that has no other
        later = places[nth > 0]
        out[later] = mix(values[later] + nth[nth > 0].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return out
