"""BPE encoding and decoding with word ends, by a backtracking encoder.

For a word, one Aho-Corasick pass gives the longest token at every position. The encoder goes through
the word, takes the longest token that is compatible with the token before it, falls back to shorter
prefixes and, when none fits, marks the position as a dead end and takes the last token back. Two adjacent
tokens are compatible if byte-pair merging would keep them apart: undoing their merges along the
common edge, latest first, no pair on the edge may have merged earlier than its parts were used up.
Compatibilities are kept in a table. Each position dies at most once, so work is linear in the word.
Decoding cuts the token strings out of one buffer with a table of offsets.

The vocabulary file (its path is a parameter) is read on the driver and broadcast: a few MB, bounded by
the vocabulary. Words are encoded once per worker while they stay in a cache of bounded size.

Defined cases: null text counts as empty and gives no ids; special tokens spelled out in a
text become their ids; a very long text or word is encoded whole; columns named like the
outputs are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textcoder.llm.util import bounded_batches

#: Stands for the end of a word in the automaton; no byte is written so.
_END = "\x00"
_CACHED_WORDS, _CACHED_LENGTH, _CACHED_PAIRS = 30_000, 64, 100_000
#: Bytes of text or ids of a slice of a batch, and bytes of a batch.
_SLICE, _BATCH = 1 << 19, 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


def load_spec(path: str) -> dict:
    """What the encoder needs of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        return parse_spec(f.read())


def parse_spec(text: str) -> dict:
    """The same of a file's content; refuses kinds whose rules differ."""
    d = json.loads(text)
    model, split = d["model"], d["pre_tokenizer"]["pretokenizers"]
    kinds = [n["type"] for n in d["normalizer"]["normalizers"]]
    if (model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"]
            or [s["type"] for s in split] != ["Split", "ByteLevel"] or split[0]["behavior"] != "Removed"
            or not split[0]["invert"] or d["decoder"] is not None):
        raise ValueError("not a BPE file with word ends, NFC, lower case and a dropped remainder")
    return {"vocab": model["vocab"], "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
            "end": model["end_of_word_suffix"], "pattern": split[0]["pattern"]["Regex"],
            "special": {t["content"]: t["id"] for t in d["added_tokens"]},
            "splitter": json.dumps({**d, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})}


def _unsettled() -> str:
    """Pattern of the characters whose class or case may differ between Unicode versions.

    Settled are those assigned in Unicode 3.2 with today's category; library and pattern agree on them.
    """
    old, new, runs, start = unicodedata.ucd_3_2_0.category, unicodedata.category, [], None
    for cp in range(128, 0x110001):
        odd = cp < 0x110000 and not 0xD800 <= cp < 0xE000 and (old(chr(cp)) == "Cn" or old(chr(cp)) != new(chr(cp)))
        if odd and start is None:
            start = cp
        elif not odd and start is not None:
            runs.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return f"[{''.join(runs)}]"


def _common(pattern: str):
    """(search for a character outside the settled ones below U+0220, the split of texts without any).

    Such texts are most of a corpus in Latin script; their classes are spelled out for the faster standard module. No
    alternative but the run of letters starts with a letter, so that one may go first.
    """
    odd = re.compile(_unsettled())
    chars = [chr(c) for c in range(0x220) if not odd.match(chr(c))]
    kinds = {"L": "", "N": ""}
    for c in chars:
        kinds[unicodedata.category(c)[0]] = kinds.get(unicodedata.category(c)[0], "") + c
    spelled = pattern.replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"]).replace(r"\s", r"\t-\r\x20\x85\xa0")
    return re.compile(f"[^{re.escape(''.join(chars))}]").search, re.compile(f"[{kinds['L']}]+|{spelled}").findall


class Pieces:
    """The token strings of one vocabulary, for decoding; built once per Python worker."""

    def __init__(self, spec: dict):
        names = {i: t for t, i in [*spec["vocab"].items(), *spec["special"].items()]}
        pieces = [f"{names.get(i, '')} ".encode() for i in range(1 + max(names))]
        self.buffer = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.piece = np.array([len(p) for p in pieces], dtype=np.int64)
        self.offset = np.cumsum(self.piece) - self.piece

    def decode(self, ids: pa.Array) -> pa.Array:
        counts = np.array([len(x) if x.is_valid else 0 for x in ids], dtype=np.int64)
        return self._decode(ids, counts)

    def _decode(self, ids: pa.Array, counts: np.ndarray) -> pa.Array:
        tokens = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lens = self.piece[tokens]
        ends = np.cumsum(counts)
        lens[ends[counts > 0] - 1] -= 1  # no space after the last token of a text
        total = np.concatenate([[0], np.cumsum(lens)])
        take = np.arange(total[-1]) + np.repeat(self.offset[tokens] - total[:-1], lens)
        bounds = total[np.concatenate([[0], ends])].astype(np.int32)
        return pa.StringArray.from_buffers(len(counts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(self.buffer[take].tobytes()))


class Codec(Pieces):
    """Tables of one vocabulary and the word encoder; built once per Python worker that encodes."""

    def __init__(self, spec: dict):
        import ahocorasick
        import regex

        super().__init__(spec)
        vocab, end = spec["vocab"], spec["end"]
        form = {t: t[: -len(end)] + _END if t.endswith(end) and t != end else t for t in vocab}
        size = 1 + max([*vocab.values(), *spec["special"].values()])
        self.length, self.rank = [0] * size, [-1] * size
        self.left, self.right = [-1] * size, [-1] * size
        for t, i in vocab.items():
            self.length[i] = len(form[t])
        self.merge_rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(spec["merges"]):
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            self.merge_rank[x, y] = r
            if self.rank[i] < 0:
                self.rank[i], self.left[i], self.right[i] = r, x, y
        self.pairs: dict[int, bool] = {}
        # Tokens that merging their own text would not give are left out of the automaton.
        made = [False] * size
        for t, i in sorted(vocab.items(), key=lambda x: self.rank[x[1]]):
            made[i] = self.rank[i] < 0 or (made[self.left[i]] and made[self.right[i]]
                                           and self._apart(self.left[i], self.right[i], self.rank[i]))
        strings = {form[t]: i for t, i in vocab.items() if made[i]}
        self.shorter = [-1] * size
        for t, i in strings.items():
            self.shorter[i] = next((strings[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in strings), -1)
        self.automaton = ahocorasick.Automaton()
        for t, i in strings.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.alphabet = byte_alphabet()
        self.table = {b: c for b, c in enumerate(self.alphabet)}
        self.unsettled, self.splitter, self.splitter_spec = None, None, spec["splitter"]
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        pattern = spec["pattern"].replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(pattern).findall
        self.common, self.split_common = _common(spec["pattern"])
        self.special = {t.encode(): i for t, i in spec["special"].items()}
        self.by_special = regex.compile("(" + "|".join(map(regex.escape, sorted(spec["special"], key=len, reverse=True))) + ")"
                                        ) if spec["special"] else None
        self.special_ids = {t: np.array([i], dtype="<i4").tobytes() for t, i in spec["special"].items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _apart(self, x: int, y: int, limit: float) -> bool:
        """Whether merging keeps x and y apart, looking at merges before ``limit``."""
        rank, merge_rank = self.rank, self.merge_rank
        while True:
            if merge_rank.get((x, y), limit) < limit:
                return False
            if rank[x] > rank[y]:
                limit, x = rank[x], self.right[x]
            elif rank[y] >= 0:
                limit, y = rank[y] + 1, self.left[y]
            else:
                return True

    def _compatible(self, x: int, y: int) -> bool:
        known = self.pairs.get(x << 24 | y)
        if known is None:
            if len(self.pairs) >= _CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[x << 24 | y] = self._apart(x, y, float("inf"))
        return known

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word (of the split, as characters)."""
        s = word.encode().decode("latin-1").translate(self.table) + _END
        n, length, shorter, compatible = len(s), self.length, self.shorter, self._compatible
        longest = [-1] * (n + 1)
        for last, token in self.automaton.iter(s):
            longest[last + 1 - length[token]] = token  # longer ones come later
        path: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and not (alive[at + length[token]] and (not path or compatible(path[-1], token))):
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += length[token]
                token = longest[at]
            else:
                alive[at] = 0
                token = path.pop()
                at -= length[token]
                token = shorter[token]
        return path

    def _word(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = array("i", self.word_ids(word)).tobytes()
        if len(word) <= _CACHED_LENGTH:
            if len(self.young) >= _CACHED_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def _plain(self, text: str) -> Iterable[bytes]:
        # Lower case is taken letter by letter, so a final sigma is like any other.
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if low.isascii() or not (self.common(low) or self.common(text)):
            words = self.split_common(low)
        else:
            words = self.split(low) if self._settled(text) else self._library_split(text)
        get, word = self.young.get, self._word
        return [get(w) or word(w) for w in words]

    def _settled(self, text: str) -> bool:
        if self.unsettled is None:
            self.unsettled = re.compile(_unsettled())
        return not self.unsettled.search(text)

    def _library_split(self, text: str) -> list[str]:
        """Words as the vocabulary file's own normaliser and splitter give them (texts with newer characters)."""
        if self.splitter is None:
            from tokenizers import Tokenizer
            self.splitter = Tokenizer.from_str(self.splitter_spec)
        words = self.splitter.pre_tokenizer.pre_tokenize_str(self.splitter.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in words]

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit integers."""
        if self.by_special is None or not self.by_special.search(text):
            return b"".join(self._plain(text))
        return b"".join(self.special_ids[p] if k % 2 else b"".join(self._plain(p))
                        for k, p in enumerate(self.by_special.split(text)))

    def encode(self, texts: pa.Array) -> pa.Array:
        parts = [self.ids(t.as_py() or "") for t in texts]
        ends = np.cumsum([0, *[len(p) // 4 for p in parts]])
        values = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


_CODECS: dict[str, Pieces] = {}


def _codec(tables, kind: type[Pieces] = Codec) -> Pieces:
    """The worker's codec of a broadcast specification; one that only decodes has no tables of the encoder."""
    if not isinstance(_CODECS.get(tables.id), kind):
        _CODECS.clear()
        _CODECS[tables.id] = kind(parse_spec(tables.value))
    return _CODECS[tables.id]


class _Tables:
    """A broadcast with an id that stays the same in every worker."""

    def __init__(self, spark: SparkSession, path: str):
        import uuid
        load_spec(path)  # an unsuitable file fails here, not in a task
        with open(path, encoding="utf-8") as f:
            self.id, self._shared = uuid.uuid4().hex, spark.sparkContext.broadcast(f.read())

    @property
    def value(self) -> str:
        return self._shared.value


_SHARED: dict[tuple[str, str], _Tables] = {}


def shared_tables(spark: SparkSession, path: str) -> _Tables:
    """One broadcast per application and file."""
    at = (spark.sparkContext.applicationId, path)
    if at not in _SHARED:
        _SHARED[at] = _Tables(spark, path)
    return _SHARED[at]


def _slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about _SLICE units each (a larger row stands alone), so that results stay small."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + _SLICE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _with_column(df: DataFrame, source: str, out: str, kind: T.DataType, lengths, make) -> DataFrame:
    """``df`` with ``out`` = make(column ``source``), computed slice by slice."""
    rest = [c for c in df.columns if c != out]
    rows = df.select(*rest, F.col(source).alias("__source"))
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for part in _slices(batch, lengths(batch.column(last)).fill_null(0).to_numpy(zero_copy_only=False)):
                yield pa.RecordBatch.from_arrays([*part.columns[:last], make(part.column(last))], names=schema.names)

    return rows.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the token ids of each text (array<int>, empty for null)."""
    bounded_batches(df.sparkSession, _BATCH)
    tables = shared_tables(df.sparkSession, path)
    return _with_column(df, text_col, out, T.ArrayType(T.IntegerType()), pc.binary_length, lambda x: _codec(tables).encode(x))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the token strings of each id list, joined by one space (empty for null)."""
    bounded_batches(df.sparkSession, _BATCH)
    tables = shared_tables(df.sparkSession, path)
    return _with_column(df, ids_col, out, T.StringType(), pc.list_value_length, lambda x: _codec(tables, Pieces).decode(x))
