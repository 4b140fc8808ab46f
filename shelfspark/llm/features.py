"""Hashed features of whole texts for the classifiers, computed with numpy in Arrow batches."""

from __future__ import annotations

import numpy as np

from .common import _POW, _SPACE, mix64, word_hashes, word_spans

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.int64)  # 0 symbol, 1 lower case or beyond ASCII, 2 upper case, 3 digit, 4 sentence end, 5 comma and the like
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in ".?"]] = 4
_KIND[[ord(c) for c in ",;:'\"()-"]] = 5


def word_bins(text: str | None, bins: int) -> np.ndarray:
    """The bin of every lower-cased word without its punctuation and symbols; a word of these alone has the bin of nothing."""
    b, s, e = word_spans((text or "").encode("utf-8", "surrogatepass"))
    if not len(s):
        return np.zeros(0, np.int64)
    v = _LOWER[b]
    v = np.where((_KIND[b] != 1) & (_KIND[b] != 2) & (_KIND[b] != 3) & ~_SPACE[b], np.uint8(255), v)  # 255 is in no UTF-8 text
    # punctuation is left out of the hash, wherever it stands
    keep = v != 255
    length = np.add.reduceat((keep & ~_SPACE[b]).astype(np.int64), s)
    pos = np.cumsum(keep) - 1
    first = pos[s] + (~keep[s])
    at = np.clip(pos - np.repeat(first, np.diff(np.concatenate([s, [len(b)]]))) if s[0] == 0 else np.concatenate([np.zeros(s[0], np.int64), pos[s[0] :] - np.repeat(first, np.diff(np.concatenate([s, [len(b)]])))]), 0, None)
    h = (v.astype(np.uint64) + np.uint64(1)) * _POW[at & 4095]
    h[~keep | _SPACE[b]] = 0
    return (mix64(np.add.reduceat(h, s) + length.astype(np.uint64)) % np.uint64(bins)).astype(np.int64)


#: For each byte a 1 in the tenth of a word that belongs to its kind, so that one sum counts all kinds.
_COUNT = np.left_shift(np.uint64(1), (10 * _KIND).astype(np.uint64))


def _kinds_in(b: np.ndarray, s: np.ndarray, solid: np.ndarray) -> list[np.ndarray]:
    """Of every word its bytes of each kind."""
    if np.diff(np.append(s, len(b))).max() < 1024:
        one = np.add.reduceat(np.where(solid, _COUNT[b], np.uint64(0)), s)
        return [(one >> np.uint64(10 * k) & np.uint64(1023)).astype(np.int64) for k in range(6)]
    kind = np.where(solid, _KIND[b], -1)
    return [np.add.reduceat((kind == k).astype(np.int64), s) for k in range(6)]


def shape_bins(text: str | None, bins: int) -> np.ndarray:
    """Bins of surface terms, one and more for each word: its shape, the shapes of it and the next, whether it or the line
    repeats, and how the line is built. Words themselves are no terms, so the language plays no part."""
    b, s, e = word_spans((text or "").encode("utf-8", "surrogatepass"))
    if not len(s):
        return np.zeros(0, np.int64)
    n = e - s
    count = _kinds_in(b, s, ~_SPACE[b])
    level = lambda x, of: np.minimum(3, -(-3 * x // np.maximum(of, 1)))  # noqa: E731  none, up to a third, up to two, more
    last = _KIND[b[e - 1]]
    shape = np.minimum(n // 4, 3)
    for x in (level(count[0], n), level(count[2], n), level(count[3], n), last):
        shape = shape * 7 + x
    words = word_hashes(b, s, e)
    same = np.zeros(len(s), np.int64)
    same[1:] = words[1:] == words[:-1]
    five = words.copy()
    for i in range(1, 5):
        if len(words) > i:
            five[:-i] = mix64(five[:-i] + words[i:])
    _, inv, cnt = np.unique(five[: max(1, len(words) - 4)], return_inverse=True, return_counts=True)
    again = cnt[inv] > 1
    terms = [shape, shape[:-1] * 100_003 + shape[1:] + 10**9, same[same > 0] + 2 * 10**9, again[again].astype(np.int64) + 3 * 10**9]
    # lines: words in a line, by steps of doubling
    newline = np.cumsum(b == 10)[s]
    in_line = np.bincount(newline - newline[0])
    in_line = in_line[in_line > 0]
    terms.append(np.minimum(np.log2(in_line).astype(np.int64), 8) + 4 * 10**9)
    return (mix64(np.concatenate(terms).astype(np.uint64)) % np.uint64(bins)).astype(np.int64)
