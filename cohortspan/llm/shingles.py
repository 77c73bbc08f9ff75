"""Word shingles of a slice of texts as arrays."""

from __future__ import annotations

from itertools import chain

import numpy as np

from cohortspan.llm.common import WordHashes, mixed, starts_of

#: Words in a shingle.
WORDS = 5
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_rows(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingles of all texts in order, and how many each text has.

    Words are what lies between 0x20 and 0x09-0x0D. A text of one to four words has one shingle, of all its words.
    """
    words = [t.encode().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = hashes.of(list(chain.from_iterable(words)))
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    place = np.arange(len(h)) - np.repeat(starts_of(sizes), sizes)  # position in its text
    size = np.repeat(sizes, sizes)
    total = np.zeros(len(h), np.uint64)
    for k in range(WORDS):
        total += np.where(place + k < size, padded[k : k + len(h)] * _WEIGHTS[k], np.uint64(0))
    first = np.maximum(sizes - WORDS + 1, np.minimum(sizes, 1))
    return mixed(total[place < np.repeat(first, sizes)]), first


def shingle_sets(texts: list[str], hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    rows, counts = shingle_rows(texts, hashes)
    return [np.unique(x) for x in np.split(rows, np.cumsum(counts)[:-1])] if len(texts) else []
