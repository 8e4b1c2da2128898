"""Word shingles as sets of 64-bit hashes, computed for many documents at once in NumPy.

Words are the runs of bytes outside x20 and x09-x0D, with A-Z lower-cased. A document's set holds the hashes of
its distinct shingles; with fewer words than a shingle has, the whole sequence is its one shingle; without
words the set is empty.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Bytes of text whose words are hashed at a time; a longer text is hashed by itself.
PIECE = 1 << 20
_rng = np.random.default_rng(20240229)
_CASED = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE = _CASED.copy()
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _upto(n: int) -> None:
    """Powers of _BASE and of its inverse modulo 2 ** 64."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 20)
        step = np.full(n, _BASE, np.uint64)
        step[0] = 1
        _powers = np.cumprod(step, dtype=np.uint64)
        step[1:] = np.uint64(pow(int(_BASE), -1, 2**64))
        _inverse = np.cumprod(step, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[bytes], cased: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and how many words each text has; PIECE bytes at a time, as each takes some 50 bytes of memory, a third of which the worker keeps."""
    cut, size = [0], 0
    for i, text in enumerate(texts):
        if size and size + len(text) > PIECE:
            cut.append(i)
            size = 0
        size += len(text)
    found = [_word_hashes(texts[i:j], cased) for i, j in zip(cut, [*cut[1:], len(texts)], strict=True)]
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _word_hashes(texts: list[bytes], cased: bool) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)  # behind each text and its space
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    counts = np.diff(np.searchsorted(starts, ends_of), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    _upto(len(data) + 1)
    values = (_CASED if cased else _BYTE)[data]
    values[space] = 0
    values *= _powers[: len(data)]
    sums = np.add.reduceat(values, starts)
    return mixed(sums * _inverse[starts] + (ends - starts).astype(np.uint64)), counts


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after the other, and their number in each."""
    words, counts = word_hashes(texts)
    total, first = len(words), np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    if not total:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    weights = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 2**64) | 1) for i in range(width)]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    h = np.zeros(total, np.uint64)
    for i, w in enumerate(weights):
        h += padded[i : i + total] * w
    left = first[doc + 1] - np.arange(total)  # words from here to the text's end
    whole = left >= width
    h = mixed(h)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        for d in short:
            own = words[first[d] : first[d + 1]]
            h[first[d]] = mixed(np.array([sum(int(x) * int(w) for x, w in zip(own, weights)) + len(own) & 2**64 - 1], np.uint64))[0]
            whole[first[d]] = True
    h, doc = h[whole], doc[whole]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(texts))
