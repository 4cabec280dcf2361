"""Hashes of word shingles, for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a whole text, in chunks of bounded size.

    A-Z are lower-cased and words are what lies between the bytes 09-0D and 20. Repeated shingles stay; a
    text with fewer words is one shingle; a text without words has none.
    """
    from xxhash import xxh64_intdigest as digest

    found = (text or "").encode().lower().split()
    if not found:
        return
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(words, len(found)) - 1:]
    for i in range(0, n, _CHUNK):
        pairs = zip(starts[i:min(n, i + _CHUNK)].tolist(), last[i:i + _CHUNK].tolist(), strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in pairs], dtype=np.uint64)


def bits(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones per hash, highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)


def packed(flags: np.ndarray) -> int:
    """The signed 64-bit number with these bits, highest first."""
    return int(np.packbits(flags).view(">i8")[0])
