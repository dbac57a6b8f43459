"""Vectorised tokenising: 64-bit hashes of the words of many texts at once, in numpy.

A word's identity is a 64-bit hash; among n distinct words two collide with a chance of about n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes that separate words: 0x20 and 0x09-0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text handled at a time; a longer text is handled alone, so many bytes after another.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs."""
    return mix(mix(a + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) + b)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SPACES)] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, CHUNK) + 65536, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
        del _powers[:-2]
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """H with H[e] - H[s], times the returned inverse power at s, a hash of values[s:e]."""
    forward, back = powers(len(values) + 1)
    h = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * forward[:-1], out=h[1:])
    return h, back


def _spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes: where words start and end, and their hashes before the last mixing."""
    low = _LOWER[raw]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = _IN_WORD[low]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    h, back = prefix_hashes(_VALUE[low])
    return starts, ends, (h[ends] - h[starts]) * back[starts]


def _long_words(text: bytes) -> np.ndarray:
    """The words of one long text. A word that goes on in the next piece is summed over both."""
    out, open_, length = [], 0, 0
    for at in range(0, len(text), CHUNK):
        raw = np.frombuffer(text, np.uint8, min(CHUNK, len(text) - at), at)
        starts, ends, sums = _spans(raw)
        if length:
            if len(starts) and starts[0] == 0:
                sums[0] = (int(sums[0]) * pow(int(_BASE), length, 1 << 64) + open_) % (1 << 64)
            else:
                out.append(np.array([open_], np.uint64))
                length = 0
        if len(ends) and ends[-1] == len(raw):
            length = len(raw) - int(starts[-1]) + (length if len(starts) == 1 and starts[0] == 0 else 0)
            open_, sums = int(sums[-1]), sums[:-1]
        else:
            length = 0
        out.append(sums)
    return mix(np.concatenate([*out, np.array([open_] * bool(length), np.uint64)]))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts in order, and for each text how many words it has."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(texts) == 1 and len(texts[0]) > CHUNK:
        hashes = _long_words(texts[0])
        return hashes, np.array([len(hashes)])
    starts, _, sums = _spans(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return mix(sums), np.diff(np.searchsorted(starts, bounds))


def chunks(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """Whole texts as UTF-8, grouped to about CHUNK bytes; null is the empty text."""
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > CHUNK:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield held


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The set of width-word shingles of one text as sorted hashes; a shorter text is one shingle; no word, no shingle."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    out = hashes[: len(hashes) - width + 1]
    for i in range(1, width):
        out = pair(out, hashes[i : len(hashes) - width + 1 + i])
    return np.unique(out)
