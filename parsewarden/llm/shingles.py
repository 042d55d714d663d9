"""Words and word shingles of whole texts as 64-bit hashes, a batch of texts at a time.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), A-Z lower-cased. The hash of a word is
a polynomial of random byte values modulo 2^64, taken from prefix sums over the whole batch and mixed; that of a shingle
combines those of its words by random odd factors and is mixed again.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
BYTE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 5) & ~np.uint64(2)
FACTORS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes that are hashed at once.
SLICE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUE = BYTE_VALUE[LOWER]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, n at least."""
    if len(_tables.get("p", ())) < n:
        n = max(n, SLICE) + 65_536
        _tables["p"], _tables["i"] = _powers(BASE, n), _powers(INVERSE, n)
    return _tables["p"], _tables["i"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], A-Z as a-z."""
    p, inverse = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[data] * p[: len(data)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * FACTORS[60])


def _hashes_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data and where they start."""
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate([edge if space[0] else np.concatenate([[0], edge]), [] if space[-1] else [len(data)]]).astype(np.int64)
    starts, ends = edge[0::2], edge[1::2]
    return span_hashes(data, starts, ends), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and offsets of the texts among them.

    Long texts are taken in slices that end at white space: memory is bounded by SLICE, or by the longest word.
    """
    whole = b" ".join([*texts, b""])
    data = np.frombuffer(whole, np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        h, s = _hashes_of(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), np.cumsum([0, *[len(t) + 1 for t in texts]]))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row; of all words if they are fewer than n; none of none."""
    if not len(words):
        return words
    if len(words) < n:
        return mix(((words * FACTORS[: len(words)]).sum(dtype=np.uint64, keepdims=True)) + FACTORS[61] * np.uint64(len(words)))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h += words[k : k + len(h)] * FACTORS[k]
    return mix(h)


def batches_of(texts: list[str | None], most: int = SLICE):
    """Indexes and bytes of the texts that are not empty, in batches of about ``most`` bytes."""
    at: list[int] = []
    own: list[bytes] = []
    total = 0
    for i, t in enumerate(texts):
        if t:
            at.append(i)
            own.append(t.encode())
            total += len(own[-1]) + 1
            if total >= most:
                yield at, own
                at, own, total = [], [], 0
    if own:
        yield at, own


def shingle_sets(texts: list[str | None], n: int = 5):
    """For each text that is not empty its index and the sorted distinct shingle hashes."""
    for at, own in batches_of(texts):
        words, offsets = word_hashes(own)
        bounds = offsets.tolist()
        for i, s, e in zip(at, bounds[:-1], bounds[1:], strict=True):
            yield i, np.unique(shingle_hashes(words[s:e], n))
