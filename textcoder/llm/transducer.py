"""A table-driven byte transducer over blocks of UTF-8 texts, and a verified hash table of word spans.

The machine has two states, in a gap and in a word. For a state and a byte, ``EMIT`` holds what is output (a word
starts, a word ended, a capital, a code point, a symbol) and ``NEXT`` the state after the byte. As ``NEXT`` depends on the
byte alone, the states of a whole block are one table look-up shifted by one byte, so a block takes one pass
of array look-ups, not a loop over bytes.

The word spans that the pass outputs are inserted in an open-addressing hash table, all spans of a block at once:
spans that find an empty slot claim it, a span that finds an equal one there (same text, same length, same bytes)
is a repeat, and the rest go on to the next slot. Hashes only say where to look; equality is decided on bytes.

White space is the bytes 09 to 0D and 20, as in all contracts here.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

GAP, IN_WORD = 0, 1
START, ENDED, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#$%&*|"
_LONG = 64
_BLOCK = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    after = np.full(256, IN_WORD, np.uint8)
    after[list(SPACES)] = GAP
    emit = np.zeros((2, 256), np.uint8)
    for byte in range(256):
        own = (CAPITAL if 65 <= byte <= 90 else 0) | (POINT if byte & 0xC0 != 0x80 else 0) | (SYMBOL if byte in SYMBOLS else 0)
        emit[GAP, byte] = own | (START if after[byte] == IN_WORD else 0)
        emit[IN_WORD, byte] = own | (ENDED if after[byte] == GAP else 0)
    return emit, after


EMIT, NEXT = _tables()


def blocks(texts: Iterable[str | None], most: int = _BLOCK) -> Iterator[list[bytes]]:
    """Consecutive texts as UTF-8, up to about ``most`` bytes a block (a longer text is a block of its own)."""
    block, size = [], 0
    for t in texts:
        b = (t or "").encode()
        if block and size + len(b) > most:
            yield block
            block, size = [], 0
        block.append(b)
        size += len(b) + 1
    if block:
        yield block


class Pass:
    """One pass over a block: counts by text, and the spans of all words."""

    def __init__(self, block: list[bytes]):
        # A space ends each text, so that no word reaches into the next one; it is not counted.
        self.raw = b" ".join(block) + b" "
        self.n = len(block)
        data = np.frombuffer(self.raw, np.uint8)
        lens = np.fromiter(map(len, block), np.int64, self.n) + 1
        self.first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        after = NEXT[data]
        state = np.empty_like(after)
        state[0], state[1:] = GAP, after[:-1]
        out = np.where(state == GAP, EMIT[GAP][data], EMIT[IN_WORD][data])
        self.starts = np.flatnonzero(out & START)
        self.ends = np.flatnonzero(out & ENDED)
        bounds = np.searchsorted(self.starts, np.concatenate([self.first, [len(data)]]))
        self.words = np.diff(bounds)
        self.owner = np.repeat(np.arange(self.n), self.words)
        self.capitals = self._count(out, CAPITAL)
        self.points = self._count(out, POINT) - 1
        self.symbols = self._count(out, SYMBOL)

    def _count(self, out: np.ndarray, flag: int) -> np.ndarray:
        return np.add.reduceat((out & flag) != 0, self.first, dtype=np.int64)

    def distinct_words(self) -> np.ndarray:
        """Number of different words of each text."""
        fresh = first_spans(self.raw, self.starts, self.ends, self.owner)
        return np.bincount(self.owner[fresh], minlength=self.n)


def first_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Indices of one span of each different (owner, bytes), by a verified hash table."""
    if not len(starts):
        return np.zeros(0, np.int64)
    lens = ends - starts
    padded = np.frombuffer(raw + b"\0" * 8, np.uint8)
    eights = np.ndarray((len(raw),), "<u8", padded, strides=(1,))
    keep = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)

    def part(which: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of the spans as a number, without what follows a span."""
        return eights[starts[which] + 8 * k] & keep[np.minimum(lens[which] - 8 * k, 8)]

    everything = np.arange(len(starts))
    head = part(everything, 0)
    digest = head ^ (lens.astype(np.uint64) << np.uint64(56)) ^ (owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    digest = (digest ^ (digest >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    rest = np.flatnonzero(lens > 8)
    for k in range(1, _LONG // 8):
        if not len(rest):
            break
        digest[rest] = (digest[rest] ^ part(rest, k) ^ (digest[rest] >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        rest = rest[lens[rest] > 8 * (k + 1)]
    long = rest if len(rest) else None

    def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = (lens[a] == lens[b]) & (owner[a] == owner[b]) & (head[a] == head[b])
        todo = np.flatnonzero(same & (lens[a] > 8) & (a != b))
        for k in range(1, _LONG // 8):
            if not len(todo):
                break
            differ = part(a[todo], k) != part(b[todo], k)
            same[todo[differ]] = False
            todo = todo[~differ]
            todo = todo[lens[a[todo]] > 8 * (k + 1)]
        for i in todo:
            x, y = a[i], b[i]
            same[i] = raw[starts[x] + _LONG:ends[x]] == raw[starts[y] + _LONG:ends[y]]
        return same

    if long is not None:                # the bytes after the first 64 of a long span, by one hash of all
        tails = [hash(raw[starts[i] + _LONG:ends[i]]) & 0xFFFFFFFFFFFFFFFF for i in long]
        digest[long] ^= np.array(tails, np.uint64)
    bits = int(2 * len(starts) - 1).bit_length()
    slot = (digest >> np.uint64(64 - bits)).astype(np.int64)
    table = np.full(1 << bits, -1, np.int64)
    pending, found = everything, []
    while len(pending):
        at = slot[pending]
        free = table[at] < 0
        table[at[free]] = pending[free]           # of several claims one stays
        holder = table[at]
        found.append(pending[holder == pending])
        pending = pending[~equal(pending, holder)]
        slot[pending] = (slot[pending] + 1) & ((1 << bits) - 1)
    return np.concatenate(found)
