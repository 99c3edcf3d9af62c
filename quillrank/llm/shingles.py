"""Sets of five-word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from quillrank.llm.common import U64, mix, word_hashes

WORDS = 5
_ODD = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], U64)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Each row's distinct shingles; with fewer than five words, the whole sequence as one; none without words."""
    hashes, begin = word_hashes(data, at, fold=True)
    n = len(hashes)
    if n >= WORDS:
        every = np.zeros(n - WORDS + 1, U64)
        for k in range(WORDS):
            every += hashes[k : n - WORDS + 1 + k] * _ODD[k]
        every = mix(every)
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(every[a : b - WORDS + 1]))
        elif b > a:
            short = (hashes[a:b] * _ODD[: b - a]).sum(dtype=U64) + U64(b - a)
            out.append(mix(np.array([short], U64) ^ U64(0x5BD1E9955BD1E995)))
        else:
            out.append(np.zeros(0, U64))
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
