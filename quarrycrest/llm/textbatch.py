"""Vectorised view of a batch of texts.

Every operator here that has to look at single characters works on one
``TextBatch`` per Arrow batch: the texts are joined into one array of code
points and words, lines and their hashes are found with a fixed number of numpy
passes, never with a Python loop over characters or words.

Hashes depend on the content alone (no seed per process), so values computed by
different executors, or again after an executor is lost, can be joined.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_TABLE = 0x32000  # beyond: no letters or digits that lower-case
_B = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BINV = pow(_B, -1, 1 << 64)


@lru_cache(1)
def _tables():
    chars = [chr(i) for i in range(_TABLE)]
    alnum = np.fromiter((c.isalnum() for c in chars), bool, _TABLE)
    lower = np.arange(_TABLE, dtype=np.uint64)
    for i, c in enumerate(chars):
        low = c.lower()
        if low != c and len(low) == 1:
            lower[i] = ord(low)
    return alnum, lower


@lru_cache(4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, factor = 1, base
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(factor)
        done += step
        factor = factor * factor & (1 << 64) - 1
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(texts, budget: int = 2_000_000):
    """Index ranges of neighbouring texts with about ``budget`` characters, so
    that a batch of very long texts doesn't need memory for all at once."""
    at = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > budget:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)


class TextBatch:
    """Code points, words and lines of a list of texts; null counts as empty."""

    def __init__(self, texts):
        self.texts = [t if isinstance(t, str) else "" for t in texts]
        joined = "\n".join(self.texts) + "\n"
        self.code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.fromiter((len(t) + 1 for t in self.texts), np.int64, len(self.texts))
        self.start = np.concatenate(([0], np.cumsum(n)))  # of each text; the last is the end
        alnum, lower = _tables()
        small = np.minimum(self.code, _TABLE - 1)
        self.alnum = alnum[small] & (self.code < _TABLE)
        self.low = np.where(self.code < _TABLE, lower[small], self.code.astype(np.uint64))

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, positions, "right") - 1

    def span_hash(self, values: np.ndarray):
        """Function (starts, ends) -> hash of values[start:end], in one pass."""
        n = 1 << max(10, int(len(values)).bit_length())
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((values + np.uint64(1)) * _powers(n, _B)[: len(values)], dtype=np.uint64)))
        inverse = _powers(n, _BINV)

        def of(starts, ends):
            length = (ends - starts).astype(np.uint64)
            return mix((sums[ends] - sums[starts]) * inverse[starts] + length * np.uint64(0xD6E8FEB86659FD93))

        return of

    def words(self):
        """(starts, ends, hashes, text numbers) of the longest runs of letters
        and digits, case ignored."""
        if not hasattr(self, "_words"):
            edge = np.diff(np.concatenate(([False], self.alnum, [False])).astype(np.int8))
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            self._words = s, e, self.span_hash(self.low)(s, e), self.doc_of(s)
        return self._words

    def lines(self):
        """(starts, ends, text numbers, line numbers from 1), cut at every \\n."""
        ends = np.flatnonzero(self.code == 10)
        starts = np.concatenate(([0], ends[:-1] + 1))
        docs = self.doc_of(starts)
        first = np.searchsorted(docs, np.arange(len(self.texts)))
        return starts, ends, docs, np.arange(len(starts)) - first[docs] + 1


_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_STOPS = np.array([ord(c) for c in ".!?\u2026\u3002\uff01\uff1f"], np.uint32)
_WIDE = np.array([ord(c) for c in "\u3002\uff01\uff1f"], np.uint32)  # no space follows these


def is_one_of(code: np.ndarray, which: np.ndarray) -> np.ndarray:
    table = np.zeros(0x10000, bool)
    table[which] = True
    return table[np.minimum(code, 0xFFFF)]


def white_space(b: TextBatch) -> np.ndarray:
    return is_one_of(b.code, _SPACES)


def sentence_ends(code: np.ndarray) -> np.ndarray:
    return is_one_of(code, _STOPS)


def unit_starts(b: TextBatch, space: np.ndarray | None = None):
    """(places, line ends before each): where sentences and lines start, at their
    first character that is not white space; a text's own first one is included,
    with 0 line ends."""
    space = white_space(b) if space is None else space
    solid = np.flatnonzero(~space)
    if not len(solid):
        return solid, solid
    before, at = solid[:-1], solid[1:]
    ends = np.concatenate(([0], np.cumsum(b.code == 10)))
    lines = ends[at] - ends[before]
    cut = (lines > 0) | ((at - before > 1) & is_one_of(b.code[before], _STOPS)) | is_one_of(b.code[before], _WIDE)
    first = np.searchsorted(solid, b.start[:-1])
    first = np.unique(solid[first[first < len(solid)]])
    units = np.unique(np.concatenate((at[cut], first)))
    count = np.zeros(len(units), np.int64)
    count[np.searchsorted(units, at[cut])] = lines[cut]
    count[np.searchsorted(units, first)] = 0
    return units, count


def shingles(batch: TextBatch, k: int):
    """(hashes, text numbers) of every k neighbouring words, repeats included."""
    _, _, w, d = batch.words()
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = w[:n].copy()
    for j in range(1, k):
        h = mix(h * np.uint64(3) + w[j : n + j])
    keep = d[:n] == d[k - 1 :]
    return h[keep], d[:n][keep]
