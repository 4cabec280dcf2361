"""BPE, language identification, licences and personal data against libraries, brute force and held-out rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textcoder.llm import bpe, language_id, licenses, pii
from textcoder.llm.queries import REGISTRY, tokenizer_path

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_spec(tokenizer_path()))


def _ids(codec, text):
    return np.frombuffer(codec.ids(text), "<i4").tolist()


ODD = ["", " ", "a" * 5000, "<|endoftext|>x<|startoftext|>", "ΑΣ ΣΑΣ", "I'LL it's 'Ve", "éé", "\x1c\x85\xa0​", "١٢३ ½²",
       "՘ Ɤ \U0001fae8", "İstanbul ßẞ ǅ", "'" * 50, "日本語 テキスト"]


@pytest.mark.parametrize("text", ODD)
def test_bpe_equals_library_on_odd_texts(codec, library, text):
    assert _ids(codec, text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_library_on_any_text(text):
    codec, library = test_bpe_equals_library_on_any_text.both
    assert _ids(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_equals_library_on_joined_tokens(codec, library):
    test_bpe_equals_library_on_any_text.both = codec, library
    names, rng = sorted(library.get_vocab()), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(names).replace("</w>", rng.choice(["", " "])) for _ in range(rng.randint(1, 6)))
        assert _ids(codec, text) == library.encode(text, add_special_tokens=False).ids


test_bpe_equals_library_on_any_text.both = (bpe.Codec(bpe.load_spec(tokenizer_path())), __import__("tokenizers").Tokenizer.from_file(tokenizer_path()))


def test_bpe_decode_is_the_librarys(codec, library):
    lists = [_ids(codec, t) for t in ODD]
    got = codec.decode(pa.array([*lists, None], pa.list_(pa.int32()))).to_pylist()
    assert got == [library.decode(x, skip_special_tokens=False) for x in lists] + [""]


def test_a_worker_that_only_decodes_has_no_encoder():
    class Tables:
        id = "decoding"
        value = open(tokenizer_path(), encoding="utf-8").read()  # noqa: SIM115

    pieces = bpe._codec(Tables, bpe.Pieces)
    assert not hasattr(pieces, "automaton") and bpe._codec(Tables, bpe.Pieces) is pieces
    assert bpe._codec(Tables).word_ids("word") and bpe._codec(Tables, bpe.Pieces) is bpe._codec(Tables)


def test_bpe_frames(spark, library):
    df = spark.createDataFrame([(1, "Hello", "x"), (2, None, None), (2, "", "y")], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, tokenizer_path()), tokenizer_path()).collect()
    assert sorted((r.doc_id, list(r.ids), r.decoded) for r in rows) == sorted(
        [(1, library.encode("Hello", add_special_tokens=False).ids, "hello</w>"), (2, [], ""), (2, [], "")])
    assert bpe.encode(df.limit(0), tokenizer_path()).collect() == []


def test_batches_of_the_codec_are_small(spark):
    df = spark.createDataFrame([(i, "Some words " * 400) for i in range(1000)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    rows = bpe.encode(df, tokenizer_path()).select("ids")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 20

    def largest(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)])], names=["n"])

    assert df.mapInArrow(largest, "n long").first().n < 2 << 20
    assert rows.distinct().count() == 1


def test_pipeline_decodes_after_encoding(spark, library):
    """One Python step at a time: encoding and decoding workers don't stand side by side."""
    import corpus_pipeline

    df = spark.createDataFrame([(1, "Hello you", "en", "x", 9), (2, None, None, None, 0), (2, "", "en", "y", 0)], SCHEMA)
    out = corpus_pipeline.tokenize(spark, df, SMALL)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    ids = library.encode("Hello you", add_special_tokens=False).ids
    assert out.columns == [*df.columns, "token_ids", "decoded", "n_tokens"]
    assert sorted((r.doc_id, list(r.token_ids), r.decoded, r.n_tokens) for r in out.collect()) == sorted(
        [(1, ids, "hello</w> you</w>", len(ids)), (2, [], "", 0), (2, [], "", 0)])


def test_op2_against_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in REGISTRY["op2_bpe"](spark, SMALL).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op1_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = REGISTRY["op1_language_id"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and 0.15 < len(held) / len(rows) < 0.35
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) >= 0.97


def test_language_mixtures_and_odd_rows(spark):
    en, fr = "the cat sat on the mat and the dog ran away ", "le chat est sur la table et le chien court vite "
    train = spark.createDataFrame([(en * 5, "en"), (fr * 5, "fr"), ("zzz", None), (None, "fr")], "text string, lang string")
    model = language_id.fit(train)
    names, scores, shares = model.predict([en * 9, fr * 9, en * 6 + fr * 6, None, "", "123 !!", en * 30000])
    assert names[0] == "en" and names[1] == "fr" and names[3:6] == ["und"] * 3 and names[6] == "en"
    assert scores[0] == 1 and list(scores[3:6]) == [0, 0, 0] and 0.3 < min(shares[2]) < 0.7
    df = spark.createDataFrame([(en, 7), (None, None)], "text string, language int")
    assert [r.language.lang for r in language_id.identify(df, model).orderBy("text").collect()] == ["und", "en"]
    assert [r.language.lang for r in language_id.identify(df, language_id.fit(train.limit(0))).collect()] == ["und", "und"]


NOTICES = [
    ("GPL-3.0", "This work is licensed under the GNU General\nPublic License, version 3."),
    ("MIT", "This code is free. Released under the MIT License. See the file for details."),
    ("GPL-2.0", "/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
                " * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n */"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the\n"
            "\"Software\"), to deal in the Software without restriction, including without\nlimitation the rights to use, copy, modify, merge, publish, "
            "distribute,\nsublicense, and/or sell copies of the Software, and to permit persons to whom\nthe Software is furnished to do so, subject to "
            "the following conditions:"),
    ("MIT", "// SPDX-License-Identifier: MIT"), ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later"), ("MIT", "MIT License"), ("GPL-2.0", "GPL v2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991"), ("AFL-3.0", "Licensed under the Academic Free License version 3.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003")]


def _names(spark, texts):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id int, text string, licences string")
    return {r.doc_id: [x.licence for x in r.licences] for r in licenses.scan(df).collect()}


def test_licences(spark):
    texts = ["Prose of no kind.\nreleased under the  MIT license\nmore", None, "", "MIT", "x " * 50000,
             "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0 now",
             "the licence of a poet under the public eye, version by version"]
    assert _names(spark, texts) == {0: ["MIT"], 1: [], 2: [], 3: [], 4: [], 5: ["Apache-2.0", "CC-BY-NC-4.0"], 6: ["CC-BY-4.0"], 7: []}
    assert licenses.scan(spark.createDataFrame([], "text string")).collect() == []


def test_notices_as_files_carry_them(spark):
    assert _names(spark, [t for _, t in NOTICES]) == {i: [name] for i, (name, _) in enumerate(NOTICES)}
    inside = [f"Some words before, {t} And some words after it." for _, t in NOTICES]
    assert _names(spark, inside) == {i: [name] for i, (name, _) in enumerate(NOTICES)}


def test_licence_wordings(spark):
    lines = [("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("MIT", "This work is licensed under the MIT License."),
             ("ISC", "Licensed under the ISC License."), ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
             ("BSD-2-Clause", "Released under the BSD 2-Clause License."), ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."),
             *licenses.TEMPLATES]
    got = _names(spark, [t for _, t in lines])
    assert {i: v[:1] for i, v in got.items()} == {i: [name] for i, (name, _) in enumerate(lines)}


def test_wrapped_and_damaged_notices(spark):
    """Notices broken anywhere are found all; with one word of at least twelve replaced, nine of ten."""
    rng = random.Random(8)
    some = rng.sample([x for x in licenses.TEMPLATES if len(x[1].split()) >= 12], 40)
    wrapped = ["".join("\n  " if c == " " and rng.random() < 0.2 else c for c in t) for _, t in some]
    assert {i: set(v) for i, v in _names(spark, wrapped).items()} == {i: {name} for i, (name, _) in enumerate(some)}
    damaged = []
    for _, t in some:
        w = t.split()
        w[rng.randrange(len(w))] = "qqq"
        damaged.append(" ".join(w))
    found = _names(spark, damaged)
    assert sum(name in found[i] for i, (name, _) in enumerate(some)) >= 36


def test_licence_anchors_lose_nothing():
    sets = [licenses.template_bigrams(t) for _, t in licenses.TEMPLATES]
    some = set(licenses.anchors(sets, licenses.THRESHOLD))
    for b in sets:
        free = [g for g in b if g not in some]
        assert 2 * len(free) / (len(free) + len(b)) < licenses.THRESHOLD


@given(st.integers(1, 60), st.integers(1, 90))
def test_licence_size_bounds_lose_nothing(n, m):
    low, high = licenses.size_bounds(n, licenses.THRESHOLD)
    assert (2 * min(n, m) / (n + m) >= licenses.THRESHOLD) == (low <= m <= high)


def _brute(text):
    def luhn(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab@.+-_ 0123456789()é", max_size=60))
def test_pii_patterns(text):
    assert pii.entities(text) == _brute(text)


def test_pii_known_values():
    text = "4111 1111 1111 1111 a.b@c.de@f.gh 1.2.3.4.5 300.1.1.1 007.1.1.1 +1 (555) 123-4567 " + "9" * 5000
    assert pii.entities(text) == _brute(text)
    assert pii.sanitised("x a@b.c y", [("email", 2, 7), ("term", 8, 9)]) == "x [EMAIL] "


def test_pii_disclosing_terms(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]} common filler line") for i in range(60)]
    rows += [(100 + i, f"common {'klmnopq'[i] * 4} zanzibar ann@mail.org filler") for i in range(4)]
    rows += [(200 + i, "solitary quixotic bob@mail.org") for i in range(5)]  # one text, copied
    rows += [(300, None), (None, ""), (300, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "2 AS file")
    found = pii.scan(df).collect()
    assert len(found) == len(rows)
    for r in found:
        terms = [s for s in r.all_spans if s.kind == "term"]
        text = dict(rows).get(r.id) or ""
        if r.id is not None and 100 <= r.id < 104:
            assert [text[s.start:s.end] for s in terms] == ["zanzibar"]
            assert "ann@" not in r.clean and "[EMAIL]" in r.clean and "zanzibar" not in r.clean
        else:
            assert terms == []
    assert pii.scan(df.limit(0)).collect() == []


def test_pii_terms_of_entities_in_one_text_each(spark):
    rows = [(i, f"common filler {'abcdefghij'[i % 10] * 3}{'abcdefghij'[i // 10 % 10] * 3} line") for i in range(100)]
    rows += [(200 + i, f"common {'klm'[i] * 5} wombat {'xyz'[i]}{i}@rare.org filler") for i in range(3)]
    rows += [(300 + i, f"common {'nop'[i] * 5} numbat +49 (301) 555-123{i} filler") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.scan(df).collect():
        text = dict(rows)[r.id]
        terms = [text[s.start:s.end] for s in r.all_spans if s.kind == "term"]
        assert terms == (["wombat"] if 200 <= r.id < 300 else ["numbat"] if r.id >= 300 else []), text


def test_op10_finds_terms_in_real_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    rows = REGISTRY["op10_pii"](spark, "/root/testdata/sf0.1").collect()
    terms = [(r.doc_id, s.split(":")) for r in rows for s in r.spans.split(",") if s.startswith("term:")]
    assert terms and all(pii._TERM.fullmatch(docs[i][int(a):int(b)]) for i, (_, a, b) in terms)
    assert all(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows if "term:" in r.spans)


def test_op10_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in REGISTRY["op10_pii"](spark, SMALL).collect():
        base = [":".join(map(str, s)) for s in _brute(docs[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) and r.n_email == sum(b.startswith("email") for b in base)
