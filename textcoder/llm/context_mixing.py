"""Bits of a text by online logistic mixing of hashed-context predictors.

A text is its UTF-8 bytes with A-Z lower-cased, and one end. A symbol is coded by yes / no decisions along the path of a
Huffman tree (about 4.5 decisions a byte), and each decision is predicted:

* Predictors: for each of ``ORDERS`` bytes of context, and for the current word's last bytes, the hash of the
  context plus the number of the node in the tree picks a slot of a table. The slot holds how often the decision was yes and no in the training
  texts, as log odds (``STEP`` to a unit); a slot that training never reached says 0, that is nothing.
* Gated weights: the log odds are added up with weights of the text's own, of which there is a set for each combination of
  predictors that have something to say. Weights start from ``start_weights`` and move after every piece of the text (128 symbols at first, four
  times as many each time, up to 8192) by a diagonal Newton step on what the piece cost, so they are always those of the past.
* Refinement: the mixed odds, in ``BUCKETS`` steps, are looked up in what became of such odds earlier in the text; the
  probability is the mean of the mixed and the refined one.

Every decision's probability is fixed before the decision is seen, so the costs add up to the bits of a code, and the probabilities of all
texts to at most 1. All texts of a block move through their pieces together, as arrays.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

END = 256
#: Context bytes of the predictors before the word predictor, shortest first, and after it.
ORDERS = (3, 5)
K = len(ORDERS) + 1
#: The word predictor, and the others.
WORD = K - 2
BY_ORDER = tuple(k for k in range(K) if k != WORD)
STEP = 16.0
FIRST_PIECE, GROWTH, LAST_PIECE = 128, 4, 8192
BUCKETS = 32
#: A confident error moves weights as if its slope were this; weights stay below MOST_WEIGHT, so odds stay finite.
LEAST_SLOPE, MOST_WEIGHT = 1 / 32, 2.0
#: Mixed log odds are rounded to steps, ``ODDS`` of them; the bucket of each, a half unit wide.
ODDS = 1024
_LOGIT = (np.arange(ODDS) - ODDS / 2) / STEP
_SQUASH = (1 / (1 + np.exp(-_LOGIT))).astype(np.float32)
_SLOPE = np.maximum(_SQUASH * (1 - _SQUASH), LEAST_SLOPE).astype(np.float32)
_BUCKET = np.clip(2 * _LOGIT + BUCKETS / 2, 0, BUCKETS - 1).astype(np.int64)
_PAD = 8
_BLOCK = 1 << 17
_COUNT_BLOCK = 1 << 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def symbols_of(text: str | None) -> bytes:
    return (text or "").encode().lower()


def symbols_of_value(text: pa.StringScalar) -> bytes:
    """The same of an Arrow value, whose bytes are taken as they are."""
    raw = text.as_buffer()
    return b"" if raw is None else raw.to_pybytes().lower()


class Code:
    """A Huffman tree over 256 bytes and the end; ``counts`` may be all zero."""

    def __init__(self, counts: Iterable[int]):
        heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        while len(heap) > 1:
            (a, ta, left), (b, tb, right) = heapq.heappop(heap), heapq.heappop(heap)
            children.append((left, right))
            heapq.heappush(heap, (a + b, max(ta, tb), END + len(children)))
        paths: dict[int, list[tuple[int, int]]] = {END + len(children): []}
        for node in range(len(children) - 1, -1, -1):
            path = paths.pop(END + 1 + node)
            for bit, child in enumerate(children[node]):
                paths[child] = [*path, (node, bit)]
        self.length = np.array([len(paths[s]) for s in range(END + 1)], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        steps = [x for s in range(END + 1) for x in paths[s]]
        self.bit = np.array([b for _, b in steps], np.int8)
        # Nodes are numbered from the root on, so the decisions of a symbol lie side by side in a table.
        self.node = (len(children) - 1 - np.array([n for n, _ in steps])).astype(np.uint32)
        self.step = 2 * self.node + self.bit.astype(np.uint32)

    def decisions(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length of each symbol's path, the symbols' decisions in order: twice the node, and the bit)."""
        n = self.length[symbol]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offset[symbol] - (ends - n), n)
        return n, self.step[at]


def _word_part(past: np.ndarray) -> np.ndarray:
    """The bytes of the current word among the last eight (the latest is the highest byte); a byte up to a space ends a word."""
    ones = np.uint64(0x0101010101010101)
    # The top bit of each byte of ``ends`` is set if that byte or a later one ends a word.
    ends = ~(((past & (ones * np.uint64(0x7F))) + ones * np.uint64(0x5F)) | past) & (ones * np.uint64(0x80))
    for shift in (8, 16, 32):
        ends |= ends >> np.uint64(shift)
    return past & ~((ends >> np.uint64(7)) * np.uint64(255))


def contexts(padded: list[bytes], counts: np.ndarray, which: Iterable[int] = range(K)) -> tuple[np.ndarray, list[np.ndarray]]:
    """(bytes, a hash of the context for each predictor asked for) at the positions of pieces that begin after ``_PAD`` bytes of past."""
    data = np.frombuffer(b"".join(padded) + b"\0" * _PAD, np.uint8)
    at = np.arange(counts.sum()) + np.repeat(_PAD * np.arange(1, len(counts) + 1), counts)
    past = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[at - _PAD]
    hashes = []
    for i in which:
        c = _word_part(past) if i == WORD else past >> np.uint64(64 - 8 * ORDERS[BY_ORDER.index(i)])
        h = (c + np.uint64(i + 1)) * _MIX[0]
        h = (h ^ (h >> np.uint64(32))) * _MIX[1]
        hashes.append((h >> np.uint64(32)).astype(np.uint32))
    return data[at], hashes


class Counter:
    """Counts of the decisions of training texts, a table of ``2 << bits`` numbers (no and yes of a slot) per predictor."""

    def __init__(self, code: Code, bits: int, which: Iterable[int] = BY_ORDER):
        self.code, self.bits = code, bits
        self.tables = {k: np.zeros(2 << bits, np.int64 if k == WORD else np.uint32) for k in which}

    def add(self, block: list[bytes]) -> None:
        """Texts of a block; long ones are taken in pieces."""
        pieces, size = [], 0
        for text in block:
            whole, n = b"\0" * _PAD + text + b"\0", len(text) + 1
            for a in range(0, n, _COUNT_BLOCK):
                m = min(_COUNT_BLOCK, n - a)
                pieces.append((whole[a:a + m + _PAD], m, a + m == n))
                size += m
                if size >= _COUNT_BLOCK:
                    self._add(pieces)
                    pieces, size = [], 0
        if pieces:
            self._add(pieces)

    def add_words(self, words: list[bytes], times: list[int]) -> None:
        """Words and the space after them, as often as ``times`` says: what the word predictor learns depends on the word alone."""
        per = max(1, _COUNT_BLOCK // 8)
        for i in range(0, len(words), per):
            pieces = [(b"\0" * _PAD + w + b" ", len(w) + 1, False) for w in words[i:i + per]]
            self._add(pieces, np.array(times[i:i + per], np.int64))

    def _add(self, pieces: list[tuple[bytes, int, bool]], times: np.ndarray | None = None) -> None:
        counts = np.array([m for _, m, _ in pieces])
        symbol, hashes = contexts([p for p, _, _ in pieces], counts, self.tables)
        symbol = symbol.astype(np.int64)
        symbol[(np.cumsum(counts) - 1)[[last for _, _, last in pieces]]] = END
        n, step = self.code.decisions(symbol)
        mask = np.uint32((2 << self.bits) - 1)
        for table, h in zip(self.tables.values(), hashes, strict=True):
            at = ((np.repeat(2 * h, n) + step) & mask).astype(np.int64)
            np.add.at(table, at, table.dtype.type(1) if times is None else np.repeat(np.repeat(times, counts), n))


def log_odds(no: np.ndarray, yes: np.ndarray) -> np.ndarray:
    """Log odds of a slot's counts in steps of 1 / STEP, as int8; 0 for a slot without counts."""
    return np.clip(np.round(STEP * np.log((yes + 0.3) / (no + 0.3))), -127, 127).astype(np.int8)


def start_weights() -> np.ndarray:
    """(predictor, gate): a gate is the set of predictors that speak, as bits; the longest context among them weighs most."""
    w = np.full((K, 1 << K), 0.3, np.float32)
    for gate in range(1, 1 << K):
        w[gate.bit_length() - 1, gate] = 0.5
    return w


class Model:
    """The code and a table of log odds per predictor; ``cost`` gives the bits of texts."""

    def __init__(self, code: Code, tables: list[np.ndarray], bits: int):
        self.code, self.tables, self.bits = code, tables, bits

    def cost(self, block: list[bytes]) -> np.ndarray:
        """Bits of each text."""
        # Longest first: the texts that go on after a piece are then the first ones, and their decisions the first decisions.
        order = sorted(range(len(block)), key=lambda i: -len(block[i]))
        texts, lanes = [block[i] for i in order], len(block)
        sizes, total = np.array([len(t) + 1 for t in texts]), np.zeros(lanes)
        weights = np.repeat(start_weights()[:, None, :], lanes, axis=1).reshape(K, -1)
        centre = 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS / 2 + 0.5) / 2))
        seen = np.tile(8 * np.stack([1 - centre, centre], axis=1), (lanes, 1))
        done, piece, live = 0, FIRST_PIECE, lanes
        while live:
            step = np.minimum(sizes[:live] - done, piece)
            parts = [text[max(0, done - _PAD):done].rjust(_PAD, b"\0") + text[done:done + piece] for text in texts[:live]]
            done += piece
            on = int(np.searchsorted(-sizes[:live], -done))             # texts that go on
            parts[on:live] = [p + b"\0" for p in parts[on:live]]
            symbol, hashes = contexts(parts, step)
            symbol = symbol.astype(np.int64)
            symbol[(np.cumsum(step) - 1)[on:]] = END
            n, decision = self.code.decisions(symbol)
            bit = (decision & np.uint32(1)).astype(np.int8)
            spoken = self._spoken(hashes, n, decision >> np.uint32(1))
            each = np.add.reduceat(n, np.cumsum(step) - step)           # decisions of each text
            owner = np.repeat(np.arange(live), each)
            sets = owner << K
            for k, q in enumerate(spoken):
                sets += (q != 0).view(np.uint8) << k
            x = [q.astype(np.float32) for q in spoken]
            dot = weights[0][sets] * x[0]
            for w, q in zip(weights[1:], x[1:], strict=True):
                dot += w[sets] * q
            odds = np.clip(dot + np.float32(ODDS / 2 + 0.5), 0, ODDS - 1).astype(np.int64)
            p = _SQUASH[odds]
            bucket = owner * BUCKETS
            bucket += _BUCKET[odds]
            fine = (p + (seen[:, 1] / seen.sum(axis=1)).astype(np.float32)[bucket]) / 2
            right = np.clip(1 - np.abs(bit - fine), 1 / 4096, 1 - 1 / 4096)
            total[:live] -= np.add.reduceat(np.log2(right), np.cumsum(each) - each, dtype=np.float64)
            if on:                      # texts that end here have nothing left to learn for
                m = int(each[:on].sum())
                self._learn(weights, seen, [q[:m] for q in x], bit[:m] - p[:m], _SLOPE[odds[:m]], sets[:m], 2 * bucket[:m] + bit[:m])
            live, piece = on, min(GROWTH * piece, LAST_PIECE)
        out = np.empty(lanes)
        out[order] = total
        return out

    def _spoken(self, hashes: list[np.ndarray], n: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        """Log odds of each predictor for the decisions."""
        mask = np.uint32((1 << self.bits) - 1)
        return [t[((np.repeat(h, n) + node) & mask).astype(np.int64)] for t, h in zip(self.tables, hashes, strict=True)]

    @staticmethod
    def _learn(weights, seen, x, wrong, slope, sets, outcome) -> None:
        size = weights.shape[1]
        # Log odds are in steps here: both a push and the bend have STEP to the second power too much.
        bend = np.bincount(sets, slope * sum(q * q for q in x), size) / K + 20 * STEP * STEP
        for w, q in zip(weights, x, strict=True):
            w += (np.bincount(sets, wrong * q, size) * STEP / bend / K).astype(np.float32)
            np.clip(w, -MOST_WEIGHT, MOST_WEIGHT, out=w)
        seen += np.bincount(outcome, minlength=seen.size).reshape(seen.shape)


def lane_blocks(texts: Iterable[bytes], most: int = _BLOCK) -> Iterator[list[bytes]]:
    """Consecutive texts of up to about ``most`` bytes together."""
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > most:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t) + 1
    if block:
        yield block
