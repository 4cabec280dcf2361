"""Source divergence, filter audit and language-model scores against brute force on small tables."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from textcoder.llm import context_mixing, divergence, filter_audit, lm_scoring, transducer
from textcoder.llm.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NASTY = ["", " ", "a", "A A a", "\t\n\x0b\x0c\r x", "é É ée", "x" * 70 + " " + "x" * 69 + "y " + "x" * 70, "\x00 \x00\x00 \x1c", "#$", "日本 語 日本",
         "ab " * 300, " a b", "one two three " * 5 + "ONE"]


# ------------------------------------------------------------------ transducer and filters

def _measured(text):
    words = WORDS.findall(text)
    return (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text)))


def test_transducer_measures_any_text():
    rng = random.Random(3)
    texts = NASTY + ["".join(rng.choice("ab \nÄB#x　") for _ in range(rng.randrange(200))) for _ in range(300)]
    for most in (1 << 20, 50):
        got = []
        for block in transducer.blocks([*texts, None], most):
            p = transducer.Pass(block)
            got += zip(p.words, p.distinct_words(), p.capitals, p.points, p.symbols, strict=True)
        assert [tuple(map(int, g)) for g in got] == [_measured(t) for t in [*texts, ""]]


def test_span_table_tells_equal_hashes_apart():
    """Spans that meet in one slot are told apart by their bytes: long words that differ in one byte at any place."""
    base = b"q" * 100
    words = [base[:i] + b"z" + base[i + 1:] for i in range(100)] * 2
    raw = b" ".join(words) + b" "
    starts = np.arange(0, len(raw), 101)
    assert len(transducer.first_spans(raw, starts, starts + 100, np.zeros(200, np.int64))) == 100
    assert len(transducer.first_spans(raw, starts, starts + 100, np.arange(200) % 3)) == 200


DOCS = "doc_id long, text string, lang string, source string, mask int, part string, good int, n long, term string, total int, rid int"


def _rows(rows):
    return [(i, t, lang, s, 1, "p", 2, 3, "x", 4, 5) for i, t, lang, s in rows]


ODD = [(1, "a b", "en", "s"), (2, "a b", "en", "s"), (2, "a b", "en", "s"), (None, "a b", None, "s"), (None, "only null id", "en", None), (3, None, "", "t"),
       (4, "", None, "t"), (5, "A b#", "fr", "t"), (6, "w " * 400 + "W", "fr", "u"), (7, " ".join(f"w{i}" for i in range(250)), "fr", "u"),
       (7, "a b", "de", None), (8, "x y " * 30_000, "de", "v")]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (None, 1, 1), (6, 1, 1), (99, 1, 1)]


def _audit(rows, labels):
    """Every order by removing documents one filter after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    by_text = collections.defaultdict(set)
    for i, t, *_ in rows:
        by_text[t or ""].add(i)

    def fails(i, text):
        words, distinct, capitals, points, symbols = _measured(text)
        smaller = [j for j in by_text[text] if j is not None and (i is None or j < i)]
        return "".join(x for x, f in zip("ABCDE", (words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * points, symbols, smaller),
                                         strict=True) if f)
    parts = collections.defaultdict(list)
    for i, t, lang, _ in rows:
        parts[lang or ""].append((i, fails(i, t or "")))
    out = {}
    for part, docs in parts.items():
        sums = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                before = [d for d in docs if d not in left]
                redundant = sum(x in f for _, f in docs) - len(gone)
                assert redundant == sum(x in d[1] for d in before) or any(docs.count(d) > 1 for d in docs)
                left = [d for d in left if x not in d[1]]
                sums[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(f == x for _, f in docs), sum(i in good for i, _ in gone),
                                          sum(i in toxic for i, _ in gone), x]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = sums[row[6]] if isinstance(row[6], str) else row[6]
    return {k: tuple(v) for k, v in out.items()}


def _found(df):
    cols = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in cols) for r in df.collect()}


def test_filter_audit_against_brute_force(spark):
    docs, labels = spark.createDataFrame(_rows(ODD), DOCS), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = _found(filter_audit.audit(docs, labels))
    assert got == _audit(ODD, LABELS)
    assert len(got) == 4 * 600
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    assert _found(filter_audit.audit(docs, labels.limit(0))) == _audit(ODD, [])
    with pytest.raises(AssertionError):         # the comparison can fail
        assert got == _audit(ODD[:-1], LABELS)


# ------------------------------------------------------------------ divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _divergence(rows, min_docs=3, top=200):
    docs = [(lang or "", s or "", collections.Counter(TERM.findall((t or "").translate(_LOWER)))) for _, t, lang, s in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        held = collections.Counter(t for x, _, c in docs if x == lang for t in c)
        kept = [t for t, n in held.items() if n >= min_docs]
        sources = {s: sum((c for x, y, c in docs if (x, y) == (lang, s)), collections.Counter()) for s in {d[1] for d in docs if d[0] == lang}}
        whole = sum(sources.values(), collections.Counter())

        def prices(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}
        p, q = {s: prices(c) for s, c in sources.items()}, prices(whole)
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or i <= top:
                        out.add((lang, s, part, item, v, i))
    return out


def test_divergence_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the", "The", "zoé", "Ééé", "x-y", "日本", "q2w", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = [(i, " ".join(rng.choices(words, [60] * 3 + [2] * 24, k=rng.randrange(0, 40))), rng.choice(["en", "en", "fr", None]), rng.choice("abcde"))
            for i in range(120)]
    rows += [*ODD, (1, "lone terms here", "xx", "a"), (2, "none", "xx", "b"), (3, "1 2 3", "en", "digits"), (4, "e" * 3000 + " the" * 5000, "en", None)]
    docs = spark.createDataFrame(_rows(rows), DOCS)
    got = {tuple(r) for r in divergence.audit(docs).collect()}
    assert got == _divergence(rows)
    assert {r[3] for r in got if r[0] == "xx"} == {"a", "b"} and all(r[4] == 0 for r in got if r[0] == "xx")
    monkeypatch.setattr(divergence, "FREQUENT_BLOCK", 2)        # many blocks, the same sums
    monkeypatch.setattr(divergence, "RARE_BLOCK", 3)
    assert {tuple(r) for r in divergence.audit(docs, top_terms=2).collect()} == _divergence(rows, top=2)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_level_products_do_not_depend_on_tiles():
    rng = np.random.default_rng(1)
    level = rng.integers(0, 6, (40, 7)) * rng.integers(0, 3, (40, 1))
    totals = [int(level[:, g].sum()) + 40 for g in range(7)]
    price = [[1 + 10**9 * (int(c) + 1) // t for c in level[:, g]] for g, t in enumerate(totals)]
    plain = [[sum((a - b) ** 2 // b for a, b in zip(price[g], price[h], strict=True)) for h in range(7)] for g in range(7)]
    for tile in (1, 8, 1000):
        assert divergence.block_divergence(level, totals, tile).tolist() == plain
    # Every pair's joint table holds all terms.
    cells = collections.Counter()
    for g, _, h, _, n, _ in divergence.joint_tables(level, 8):
        for pair, k in zip(zip(g, h, strict=True), n, strict=True):
            cells[pair] += k
    assert all(cells[g, h] == 40 for g in range(7) for h in range(g, 7))


def test_terms_of_long_texts_are_cut_between_terms(monkeypatch):
    text = "Ab1é" * 50 + " " + "x" * 100
    whole = [t for part in divergence.terms(text) for t in part]
    monkeypatch.setattr(divergence, "_PIECE", 10)
    assert [t for part in divergence.terms(text) for t in part] == whole == [t.encode() for t in TERM.findall(text.translate(_LOWER))]


# ------------------------------------------------------------------ language model

def _plain_cost(model, text):
    """The model's bits of a text, decision by decision in plain Python."""
    cm, data = context_mixing, context_mixing.symbols_of(text)
    weights, hits = context_mixing.start_weights().astype(float), [8 / (1 + math.exp(-(b - cm.BUCKETS / 2 + 0.5) / 2)) for b in range(cm.BUCKETS)]
    seen, bits, at, piece = [8.0] * cm.BUCKETS, 0.0, 0, cm.FIRST_PIECE
    mask64 = (1 << 64) - 1
    while at <= len(data):
        end = min(len(data) + 1, at + piece)
        learnt = []
        for i in range(at, end):
            past = (b"\0" * 8 + data[:i])[-8:]
            own = re.split(rb"[\x00-\x20]", past)[-1]
            own = b"\0" * (8 - len(own)) + own
            raw = [past[-3:], own, past[-5:]]
            hashes = []
            for k, c in enumerate(raw):
                h = ((int.from_bytes(c, "little") + k + 1) * int(cm._MIX[0])) & mask64
                h = ((h ^ h >> 32) * int(cm._MIX[1])) & mask64
                hashes.append(h >> 32)
            s = data[i] if i < len(data) else cm.END
            o = int(model.code.offset[s])
            for node, bit in zip(model.code.node[o:o + int(model.code.length[s])].tolist(), model.code.bit[o:o + int(model.code.length[s])].tolist(),
                                 strict=True):
                x = [int(t[(h + node) & ((1 << model.bits) - 1)]) / cm.STEP for t, h in zip(model.tables, hashes, strict=True)]
                gate = sum((v != 0) << k for k, v in enumerate(x))
                dot = sum(weights[k, gate] * v for k, v in enumerate(x))
                logit = min(max(math.floor(cm.STEP * dot + 0.5), -cm.ODDS // 2), cm.ODDS // 2 - 1) / cm.STEP
                p = 1 / (1 + math.exp(-logit))
                b = int(min(max(2 * logit + cm.BUCKETS / 2, 0), cm.BUCKETS - 1))
                fine = min(max((p + hits[b] / seen[b]) / 2, 1 / 4096), 1 - 1 / 4096)
                bits -= math.log2(fine if bit else 1 - fine)
                learnt.append((x, gate, p, b, bit))
        push, bend = np.zeros_like(weights), np.zeros(weights.shape[1])
        for x, gate, p, b, bit in learnt:
            push[:, gate] += [(bit - p) * v for v in x]
            bend[gate] += max(p * (1 - p), cm.LEAST_SLOPE) * sum(v * v for v in x)
            hits[b] += bit
            seen[b] += 1
        weights = np.clip(weights + push / (bend / cm.K + 20) / cm.K, -cm.MOST_WEIGHT, cm.MOST_WEIGHT)
        at, piece = end, min(cm.GROWTH * piece, cm.LAST_PIECE)
    return bits


@pytest.fixture(scope="module")
def small_model():
    rng = random.Random(7)
    train = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "été", "x"], k=rng.randrange(60))) for _ in range(200)]
    seen = np.bincount(np.frombuffer("".join(train).encode(), np.uint8), minlength=257)
    seen[256] = len(train)
    counter = context_mixing.Counter(context_mixing.Code(seen), 16)
    counter.add([context_mixing.symbols_of(t) for t in train])
    words = context_mixing.Counter(counter.code, 16, [context_mixing.WORD])
    times = collections.Counter(w for t in train for w in context_mixing.symbols_of(t).split())
    words.add_words(list(times), list(times.values()))
    tables = counter.tables | words.tables
    return context_mixing.Model(counter.code, [context_mixing.log_odds(tables[k][0::2].astype(float), tables[k][1::2].astype(float))
                                               for k in range(context_mixing.K)], 16)


def test_word_counts_teach_what_the_texts_do():
    """The word predictor's counts inside words are the same from counted words and from words one by one."""
    code, times = context_mixing.Code(range(257)), {b"ab": 3, b"abc": 1, b"x" * 20: 2, "é".encode(): 5}
    counted, single = (context_mixing.Counter(code, 14, [context_mixing.WORD]) for _ in range(2))
    counted.add_words(list(times), list(times.values()))
    for w, n in times.items():
        for _ in range(n):
            single.add_words([w], [1])
    assert (counted.tables[context_mixing.WORD] == single.tables[context_mixing.WORD]).all()
    text = context_mixing.Counter(code, 14, [context_mixing.WORD])
    text.add([b" ".join(w for w, n in times.items() for _ in range(n)) + b" "])
    # A text has its end besides, and no other decision.
    assert 0 <= text.tables[context_mixing.WORD].sum() - counted.tables[context_mixing.WORD].sum() <= code.length[256]


def test_blocks_of_texts_cost_what_each_costs_alone(small_model):
    texts = ["", "x", "ALPHA beta gamma " * 30, "qqq ÿ\x00 unknown", "beta\n" * 700, "  ", "日本"]
    together = small_model.cost([context_mixing.symbols_of(t) for t in texts])
    plain = [_plain_cost(small_model, t) for t in texts]
    assert together == pytest.approx(plain, rel=1e-2)       # odds are rounded to steps, in single precision there
    assert together[2] / len(texts[2]) < 1 < 3 < together[3] / len(texts[3].encode())


def test_probabilities_of_all_next_symbols_add_up_to_one(small_model):
    """Texts of one symbol and the first decisions of longer ones: the code's paths share the probability of each node."""
    code = small_model.code
    assert sum(2.0 ** -n for n in code.length.tolist()) == pytest.approx(1)
    one = small_model.cost([b""])[0]
    others = []
    for s in range(256):
        a, b = small_model.cost([bytes([s]), bytes([s, 32])])
        assert 0 < a and 0 < b
        # What the first byte costs is what both have in common; with END last, a text's cost is more than its first byte's.
        others.append(2.0 ** -a)
    assert 2.0 ** -one + sum(others) < 1


def test_long_texts_are_counted_in_pieces(monkeypatch):
    code, text = context_mixing.Code(range(257)), b"some words here " * 50
    whole, cut = context_mixing.Counter(code, 12), context_mixing.Counter(code, 12)
    whole.add([text, b"", b"x"])
    monkeypatch.setattr(context_mixing, "_COUNT_BLOCK", 37)
    cut.add([text, b"", b"x"])
    assert all((whole.tables[k] == cut.tables[k]).all() for k in context_mixing.BY_ORDER)


def test_words_of_texts():
    texts = [b"", b" a  bc\n", b"x" * 300, b"\t", "\u00a0 é\x1c q".encode(), b"last"]
    words, bounds = lm_scoring.words_of(texts)
    assert words.to_pylist() == [w for t in texts for w in t.split()]
    assert np.diff(bounds).tolist() == [len(t.split()) for t in texts]


def _base(rows):
    def tokens(t):
        return [*WORDS.findall((t or "").translate(_LOWER)), None]

    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(x for i, t in rows if not out(i) for x in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    return [(i, out(i), len(tokens(t)), sum(x in counts for x in tokens(t)), total,
             round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in tokens(t)), 6)) for i, t in rows]


@pytest.mark.parametrize("frequent", [1 << 16, 8])
def test_base_score_against_brute_force(spark, frequent):
    rows = [(i, t) for i, t, *_ in ODD] + [(i, "some Words " * (i % 5) + f"rare{i % 30}   é") for i in range(100, 160)]
    docs = spark.createDataFrame(_rows([(i, t, "en", "s") for i, t in rows]), DOCS).withColumn("held_out", lm_scoring.held_out())
    scored = lm_scoring.score(docs, lm_scoring.fit(docs.filter("not held_out"), bits=12, frequent=frequent))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, _base(rows)))
    assert set(docs.columns) - {"text"} <= set(scored.columns)
    assert all(r.score < 0 and math.isfinite(r.score) for r in scored.collect())


def test_lm_on_nothing(spark):
    docs = spark.createDataFrame(_rows([(1, "a b", "en", "s"), (2, None, "en", "s")]), DOCS)
    fitted = lm_scoring.fit(docs.limit(0), bits=10)
    rows = lm_scoring.score(docs, fitted).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert lm_scoring.score(docs.limit(0), fitted).collect() == []


def test_held_out_texts_are_predicted(spark):
    """Bits a byte of held-out texts are far below those of shuffled ones, and no worse than a third more than of training texts."""
    rows = REGISTRY["op13_lm_scoring"](spark, SMALL).collect()
    plain = {r.doc_id: r for r in rows}
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    out = [r.bits_per_byte for r in rows if r.held_out and r.bits_per_byte]
    own = [r.bits_per_byte for r in rows if not r.held_out and r.bits_per_byte]
    assert 1 < np.mean(own) < np.mean(out) < 4
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").withColumn("held_out", lm_scoring.held_out())
    rng = random.Random(1)
    mixed = [(r.doc_id, "".join(rng.sample(r.text, len(r.text)))) for r in docs.filter("held_out").collect()]
    fitted = lm_scoring.fit(docs.filter("not held_out"))
    worse = lm_scoring.score(spark.createDataFrame(mixed, "doc_id long, text string"), fitted).collect()
    assert all(r.score < plain[r.doc_id].score for r in worse if len(dict(mixed)[r.doc_id]) > 50)
