"""Word shingle sets as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words a worker remembers the hash of before it starts anew.
REMEMBERED = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _WordHashes()


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes (uint64) of all runs of ``words`` words of the whole text.

    A-Z are lowered; words end at blanks, tabs and line ends. A shorter text is one shingle, a text
    without words, or null, has none.
    """
    if not text:
        return np.zeros(0, dtype=np.uint64)
    # bytes methods lower only A-Z and split only at ASCII white space
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(_WORDS) > REMEMBERED:
        _WORDS.clear()
    hashes = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    run = min(words, len(found))
    n = len(found) - run + 1
    mixed = np.full(n, run, dtype=np.uint64)
    for j in range(run):
        mixed = mixed * _ODD + hashes[j: j + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)
