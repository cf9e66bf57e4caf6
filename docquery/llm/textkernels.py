"""Numpy kernels over whole texts: word boundaries and 64-bit hashes of words and word sequences."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters to lower case, all other bytes as they are.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bytes hashed at once; the cut is at white space, so that no word is split.
SEGMENT = 1 << 21

#: Bytes of a word up to which its hash is a polynomial.
SHORT = 32

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[0] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]), dtype=np.uint64)
        _powers[1] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE)]), dtype=np.uint64)
    return _powers[0], _powers[1]


def span_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; equal bytes give equal hashes wherever they are.

    Spans of up to SHORT bytes go by a polynomial modulo 2**64, which long ones can be made to fool (the Thue-Morse word of
    1,024 bytes and its complement come out equal for any base); those go by a cryptographic hash.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _up_to(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    found = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > SHORT).tolist():
        found[i] = int.from_bytes(blake2b(a[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return found


@dataclass
class Words:
    """The words of several texts: hashes, spans in the joined bytes, and for each text the range of its words."""

    bytes: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of text i: words first[i] up to first[i + 1]
    text_at: np.ndarray  # of text i: bytes text_at[i] up to text_at[i + 1] - 1

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: list[bytes | None], lower: bool = False, hashes: bool = True) -> Words:
    """Runs of bytes other than ASCII white space; a null text has none."""
    joined = b"\n".join([t or b"" for t in texts]) + b"\n"
    if lower:
        joined = joined.translate(LOWER)
    a = np.frombuffer(joined, np.uint8)
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    text_at = np.concatenate([[0], np.cumsum(lengths)])
    space = SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    found = np.zeros(len(start), np.uint64)
    at = done = 0
    while hashes and done < len(start):
        upto = len(start) if len(a) - at <= SEGMENT else max(done + 1, int(np.searchsorted(end, at + SEGMENT, "right")))
        stop = int(end[upto - 1])
        found[done:upto] = span_hashes(a[at:stop], start[done:upto] - at, end[done:upto] - at)
        at, done = stop, upto
    return Words(a, found, start, end, np.searchsorted(start, text_at), text_at)


def sequences(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values; fewer than k give none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += h[j : j + n] * _PLACE[j]
    return mix(total + np.uint64(k))


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; of fewer words the whole sequence is the one shingle."""
    runs, out = sequences(w.hash, k), []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(sequences(w.hash[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
