"""Words and 64-bit hashes of words, shingles and character k-mers, over whole Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
#: The same words in Java's regular expressions.
JAVA_WORD = r"[\p{L}\p{Nl}\p{No}]+(?:'[\p{L}\p{Nl}\p{No}]+)*"
_MEMO_LIMIT = 500_000
_memo: dict[str, int] = {}

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + _A
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    """Hash of the lower-cased word; the memo only saves time and is emptied when it has grown."""
    h = _memo.get(word)
    if h is None:
        if len(_memo) >= _MEMO_LIMIT:
            _memo.clear()
        h = _memo[word] = xxhash.xxh3_64_intdigest(word.lower())
    return h


def word_hashes(text: str) -> np.ndarray:
    found = WORD.findall(text)
    return np.fromiter(map(word_hash, found), np.uint64, len(found))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted set of hashes of ``size`` words in a row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for k in range(1, size):
            out = mix(out) + hashes[k : k + n]
    return np.unique(mix(out))
