"""Personal data by patterns and information-theoretic sanitisation.

Patterns give the protected entities of a text: e-mail addresses, IP addresses, card and phone numbers. The rest
of the text may still reveal an entity, through words that occur with it and hardly elsewhere. For an entity
c and a term t, the corpus gives ``PMI(c; t) = ln(N n(c, t) / (n(c) n(t)))``, how much t tells about c, out of
``IC(c) = ln(N / n(c))``, all there is to tell. A term is disclosing if ``PMI >= ALPHA * IC``.

Most entities occur in one text only, where nothing can be counted. So c is the entity or a part that it shares with
others: local part and domain of a mail address, the first two and three bytes of an IP address, issuer digits of a card,
country and area digits of a phone number. (The kind is no part: the sanitised text names it.) The share
``n(c, t) / n(t)`` of a term's documents that hold c is smoothed towards ``n(c) / N``, which weighs ``PRIOR`` texts against the
texts that hold both but one: a text, however often copied, is no evidence for itself, and a few are a little.
In every document that holds c, its disclosing terms are spans of kind ``term``. Sanitising generalises entities to their
kind, and terms below ``REMOVE * IC`` to ``[TERM]``; terms that tell more are removed.

All counts are over all documents. Terms are counted per task first and added up by hash, so a frequent word
is no hot key. Where c has one text, the smoothed PMI is 0 for every term, so co-occurrence is counted for the others only.

Defined cases: null text counts as empty and has no spans; matches that fail their check are dropped and not tried
again; kinds may overlap each other, terms never overlap an entity; repeated rows count as documents but
not as different texts; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcoder.llm.util import bounded_batches, cut, lookup

KINDS = ("email", "ip", "card", "phone")
ALPHA = 0.8
REMOVE = 0.9
PRIOR = 1.0
#: Counts of terms in more than one of so many documents are looked up before pairs are made.
COMMON = 1000
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A word of letters; runs that hold digits, such as keys, have no terms.
_TERM = re.compile(r"(?<!\w)[^\W\d_]{3,}(?!\w)")


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield "email", start, free
        at = text.find("@", max(at + 1, free))


def _ips(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
                    yield "ip", m.start(), m.end()


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield "phone", m.start(), m.end()


def entities(text: str | None) -> list[Span]:
    """(kind, start, end) in code points by start, then by kind in the order of KINDS."""
    if not text:
        return []
    found = [*_emails(text), *_ips(text), *_cards(text), *(_phones(text) if "+" in text else ())]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _value(kind: str, text: str) -> str:
    """What makes two spellings one entity."""
    return f"{kind}:{''.join(c for c in text if c.isdigit())}" if kind in ("card", "phone") else f"{kind}:{text.lower()}"


def _parts(kind: str, text: str) -> list[str]:
    """The entity and what it shares with others of its kind."""
    name = _value(kind, text)
    body = name[len(kind) + 1:]
    if kind == "email":
        local, _, domain = body.partition("@")
        return [name, f"email-local:{local}", f"email-domain:{domain}"]
    if kind == "ip":
        numbers = [str(int(x)) for x in body.split(".")]
        return [name, *[f"ip-{n}:{'.'.join(numbers[:n])}" for n in (2, 3)]]
    return [name, f"{kind}-head:{body[:6 if kind == 'card' else 4]}"]


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest
    x = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def term_spans(text: str, disclosing: set[int], base: list[Span]) -> list[Span]:
    """Occurrences of disclosing terms (by hash) that overlap no entity."""
    found, k = [], 0
    for m in _TERM.finditer(text):
        while k < len(base) and base[k][2] <= m.start():
            k += 1
        if not any(s[1] < m.end() and m.start() < s[2] for s in base[k:k + len(KINDS) + 1]) and _hash(m.group().lower()) in disclosing:
            found.append(("term", m.start(), m.end()))
    return found


def sanitised(text: str, spans: list[Span], mild: frozenset[int] = frozenset()) -> str:
    """``text`` with entities and ``mild`` terms (hashes) generalised and other terms removed; overlapping spans are one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            gone = kind == "term" and _hash(text[start:end].lower()) not in mild
            out += [text[at:start], "" if gone else f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_FOUND = f"base {_SPANS}, entities array<long>"
_DONE = f"all_spans {_SPANS}, clean string"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _as_spans(lists: list[list[Span]]) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in lists], _SPAN_TYPE)


def _find(texts: pa.Array) -> pa.Array:
    values = [t.as_py() or "" for t in texts]
    spans = [entities(t) for t in values]
    keys = [sorted({_hash(x) for k, a, b in s for x in _parts(k, t[a:b])}) for t, s in zip(values, spans, strict=True)]
    return pa.StructArray.from_arrays([_as_spans(spans), pa.array(keys, pa.list_(pa.int64()))], names=["base", "entities"])


def _terms(texts: pa.Array) -> pa.Array:
    return pa.array([[_hash(w) for w in sorted({m.lower() for m in _TERM.findall(t.as_py() or "")})] for t in texts],
                    pa.list_(pa.int64()))


def _sanitise(texts: pa.Array, bases: pa.Array, disclosing: pa.Array, mild: pa.Array) -> pa.Array:
    spans, clean = [], []
    for t, b, d, m in zip(texts, bases, disclosing, mild, strict=True):
        text, base = t.as_py() or "", [(s["kind"], s["start"], s["end"]) for s in b.as_py() or []]
        every = sorted(base + (term_spans(text, set(d.as_py()), base) if d.as_py() else []),
                       key=lambda s: (s[1], (*KINDS, "term").index(s[0])))
        spans.append(every)
        clean.append(sanitised(text, every, frozenset(m.as_py() or ())))
    return pa.StructArray.from_arrays([_as_spans(spans), pa.array(clean, pa.string())], names=["all_spans", "clean"])


def term_counts(texts: DataFrame, text: str) -> DataFrame:
    """(term, n): number of rows of ``texts`` that hold each term, by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            names = np.fromiter(map(_hash, seen), np.int64, len(seen))
            counts = np.fromiter(seen.values(), np.int64, len(seen))
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts)], names=["term", "n"])

        for batch in batches:
            for t in batch.column(0):
                seen.update(set(_TERM.findall((t.as_py() or "").lower())))
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    return texts.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(found: DataFrame, corpus: DataFrame, text: str, alpha: float = ALPHA, prior: float = PRIOR,
                     remove: float = REMOVE) -> DataFrame:
    """(of, terms, mild): the terms of each text, by its digest, that reveal an entity or part of one that it holds, and those of
    them that reveal less than ``remove``. ``found``: rows with entities, as of ``scan``, and the digest of their text."""
    texts = cut(found.groupBy("of").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("__text").alias("__text")))
    held = texts.select("of", "copies", F.explode("entities").alias("entity"))
    total = float(corpus.agg(F.count(F.lit(1)).alias("rows")).first()["rows"])
    base = F.col("n_entity") / F.lit(total)
    # As n(c, t) <= n(c), a term of more than ``most`` documents can't reach alpha.
    known = lookup(held.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count(F.lit(1)).alias("texts"))
                   .filter(F.col("texts") > 1).select("entity", "n_entity", (F.col("n_entity") / F.pow(base, F.lit(1 - alpha))).alias("most")))
    counts = cut(term_counts(corpus, text).filter(F.col("n") > 1))
    common = lookup(counts.filter(F.col("n") > total / COMMON).select(F.col("term").alias("common"), F.col("n").alias("n_common")))
    wanted = held.join(known, "entity").groupBy("of").agg(F.collect_list(F.struct("entity", "most")).alias("held"))
    words = cut(texts.join(wanted, "of").select("of", "copies", "held", F.arrow_udf(_terms, "array<long>")(F.col("__text")).alias("terms")))
    pairs = (words.select("of", "copies", "held", F.explode("terms").alias("term"))
             .join(common, F.col("term") == F.col("common"), "left")
             .withColumn("held", F.filter("held", lambda h: F.col("n_common").isNull() | (F.col("n_common") <= h["most"] + 1)))
             .select("of", "copies", "term", F.explode("held.entity").alias("entity")))
    joint = cut(pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_joint"), F.count(F.lit(1)).alias("texts"))
                .filter(F.col("texts") > 1))
    at = joint.join(known, "entity").join(counts, "term")
    others = F.col("texts") - 1
    share = (others * F.col("n_joint") / F.col("n") + prior * base) / (others + prior)
    pmi, ic = F.log(share / base), -F.log(base)
    reveal = lookup(at.filter((pmi >= alpha * ic) & (ic > 0)).select("entity", "term", (pmi < remove * ic).alias("little")))
    told = pairs.join(reveal, ["entity", "term"]).groupBy("of", "term").agg(F.min("little").alias("little"))
    return told.groupBy("of").agg(F.collect_list("term").alias("terms"),
                                  F.collect_list(F.when(F.col("little"), F.col("term"))).alias("mild"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, prior: float = PRIOR) -> DataFrame:
    """One row per row of ``df``: id, base (spans of entities), all_spans (with terms), and, where there is any
    span, the sanitised text (``clean``; null: the text stays as it is)."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    seen = cut(rows.withColumn("found", F.arrow_udf(_find, _FOUND)(F.col("__text")))
               .select(F.col("__id").alias("id"), "found.base",
                       "found.entities", F.when(F.size("found.base") > 0, F.col("__text")).alias("__text")))
    held = seen.filter(F.size("base") > 0).withColumn("of", F.sha2("__text", 256))
    reveal = lookup(disclosing_terms(held, rows, "__text", alpha, prior))
    spans = (held.join(reveal, "of", "left")
             .withColumn("done", F.arrow_udf(_sanitise, _DONE)("__text", "base", "terms", "mild")).select("id", "base", "done.all_spans", "done.clean"))
    plain = seen.filter(F.size("base") == 0).select("id", "base", F.col("base").alias("all_spans"), F.lit(None).cast("string").alias("clean"))
    return spans.unionByName(plain)
