"""Character n-grams of many texts at once as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .tokens import mix

#: Characters handled at a time; a longer text is handled alone, so many characters after another.
CHUNK = 1 << 17
_GAP, _EDGE = np.uint32(32), np.uint32(0)
_letters: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(1 << 16)]))
    out = _letters[0][np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        names, at = np.unique(points[far], return_inverse=True)
        out[far] = np.array([chr(c).isalpha() for c in names.tolist()])[at]
    return out


def _hashes(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each n-gram and whether it lies within one text."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    values, edge = mix(points.astype(np.uint64) + np.uint64(1)), points == _EDGE
    h, ok = np.full(m, np.uint64(n * 0x1F3D5B79)), np.ones(m, bool)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + values[i : m + i]
        ok &= ~edge[i : m + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, ok


def _many(texts: list[str], orders: tuple[int, ...]):
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    edge = np.array([_GAP, _EDGE, _GAP], np.uint32)  # the gap after an edge opens the next text
    points = np.concatenate([edge[2:], *(x for p in parts for x in (p, edge))])
    ends = np.cumsum([len(p) + 3 for p in parts])
    letter = is_letter(points)
    points = np.where(letter, points, _GAP)
    points[ends - 1] = _EDGE
    keep = letter | np.roll(letter, 1)
    keep[0] = True
    keep[ends - 1] = True
    keep[ends] = True
    number = np.repeat(np.arange(len(texts) + 1), np.diff([0, *ends, ends[-1] + 1]))
    with_letter = np.bincount(number[letter], minlength=len(texts)) > 0
    points, number = points[keep], number[keep]
    found = []
    for n in orders:
        h, ok = _hashes(points[:-1], n)
        found.append((h[ok], number[: len(h)][ok]))
    return found, with_letter


def _long(text: str, orders: tuple[int, ...]):
    """The n-grams of one long text, piece after piece."""
    text, before, held, any_letter = text.lower(), False, np.array([_GAP], np.uint32), False
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = is_letter(points)
        keep = letter | np.concatenate([[before], letter[:-1]])
        before, any_letter = bool(letter[-1]), any_letter or bool(letter.any())
        new = np.where(letter, points, _GAP)[keep]
        if at + CHUNK >= len(text) and before:
            new = np.append(new, _GAP)
        found = []
        for n in orders:  # what ends in this piece
            h, _ = _hashes(np.concatenate([held[max(0, len(held) - n + 1) :] if at else held, new]), n)
            found.append((h, np.zeros(len(h), np.int64)))
        held = np.concatenate([held, new])[-max(orders) :]
        yield found, np.array([any_letter])


def grams(texts: Iterable[str | None], orders: tuple[int, ...]) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """(first, count, found, with_letter) for texts first to first + count: for each order, the hashes of all n-grams and
    the number of the text of each, from 0; and which texts have a letter so far. A long text comes in several pieces.

    Texts are lowered, each run of other characters than letters becomes one gap, and each text is put between gaps.
    """
    first = 0
    for some in batches(texts):
        for found, lettered in _long(some[0], orders) if len(some) == 1 and len(some[0]) > CHUNK else [_many(some, orders)]:
            yield first, len(some), found, lettered
        first += len(some)


def batches(texts: Iterable[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 2
    if held:
        yield held
