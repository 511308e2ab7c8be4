"""Whole batches of texts as code point arrays, and hashes of their words and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MIX1, MIX2, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15 | 1)
SPACES = np.zeros(0x110000, bool)
for _c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
    SPACES[_c] = True
_POWERS = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.full(size, BASE, np.uint64)) if size else _POWERS
    return _POWERS[:n]


def chunks(texts: list[str], most_chars: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most_chars together; a longer text is a range of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most_chars:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, each text followed by a line feed, and the start of each text (one more than there are texts)."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])


def word_hashes(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of every run between white space, where each text's words start, and the words' lengths."""
    space = SPACES[points]
    inside = ~space
    begin = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    n = end - begin
    # The polynomial of a word relative to its own start: each code point times the power of its place in its word.
    place = np.zeros(len(points), np.int64)
    which = np.repeat(np.arange(len(begin)), n)
    at = np.flatnonzero(inside)
    place = at - begin[which]
    terms = mixed(points[at].astype(np.uint64) + np.uint64(1)) * powers(int(n.max()) if len(n) else 0)[place] if len(at) else np.zeros(0, np.uint64)
    sums = np.add.reduceat(terms, np.concatenate([[0], np.cumsum(n)[:-1]])) if len(n) else np.zeros(0, np.uint64)
    return mixed(sums + n.astype(np.uint64)), np.searchsorted(begin, starts), n


def shingle_hashes(words: np.ndarray, word_starts: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Distinct hashes, sorted, of each text's runs of ``size`` words, or of all its words where it has fewer."""
    total = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for j in range(size):
        if len(total):
            total = mixed(total + words[j : j + len(total)] + np.uint64(j + 1))
    out = []
    for a, b in zip(word_starts[:-1], word_starts[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(total[a : b - size + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for j in range(a, b):
                h = mixed(h + words[j : j + 1] + np.uint64(j - a + 1))
            out.append(mixed(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
