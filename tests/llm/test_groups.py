"""Dedup, fingerprints, sharding, mixing and the pipeline against brute force on small tables."""

import collections
import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from textcoder.llm import exact_dedup, fingerprints, graph, line_dedup, mixing, sharding, simhash_dedup
from textcoder.llm.queries import REGISTRY
from textcoder.llm.util import documents, lookup

SMALL = "/root/testdata/sf0.001"
TEXTS = [(1, "a b c", "s"), (2, "abc", "s"), (3, " a bc ", None), (4, None, "t"), (5, "", "t"), (6, "\n", "t"), (7, "x", "u"), (7, "x", "u"),
         (None, "x", "u"), (8, "long " * 60_000, "u"), (9, "ab", "v"), (9, "a c", "v")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated rows, a long text, and columns named like internal and output ones."""
    return spark.createDataFrame(TEXTS, SCHEMA).selectExpr("*", "1 AS shard", "2 AS kept", "3 AS size", "4 AS digest", "5 AS slot", "6 AS file",
                                                           "7 AS target", "8 AS fp", "9 AS key", "10 AS __file", "11 AS __source",
                                                           "12 AS whole", "13 AS scale", "14 AS remaining", "15 AS last", "16 AS cut_bin",
                                                           "17 AS closing", "18 AS q_source", "19 AS m_source", "20 AS in_0", "21 AS __row")


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("key_chars", [64, 1])
def test_exact_dedup_odd_rows(spark, odd, key_chars):
    rows = exact_dedup.exact_dedup(odd, key_chars=key_chars, batch_bytes=1000).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in TEXTS:
        groups[_norm(t)].append((-len(t or ""), i is None, i or 0, i))
    expected = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}
    assert len(rows) == len(TEXTS)
    assert all((r.keep_id, r.group_size) == expected[r.text_sha256] for r in rows)
    assert collections.Counter(r.text_sha256 for r in rows if r.kept) == collections.Counter(expected.keys())
    kept = exact_dedup.deduplicated(odd, key_chars=key_chars)
    assert kept.columns == odd.columns and kept.count() == len(expected)
    assert exact_dedup.exact_dedup(odd.limit(0)).collect() == []


def test_rows_of_multiplied_frames_are_copies(spark):
    """A frame that holds rows of a file several times, or not at all, is no scan: its rows are told apart all the same."""
    docs = documents(spark, SMALL)
    exact = len({_norm(r.text) for r in docs.collect()})
    near = len({root for _, root in _brute_groups([(r.doc_id, r.text) for r in docs.collect()]).values()})
    twice = docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    assert exact_dedup.deduplicated(twice).count() == exact_dedup.deduplicated(docs.union(docs)).count() == exact
    assert simhash_dedup.deduplicated(twice).count() == near
    drawn = docs.sample(True, 2.0, seed=1)
    left = exact_dedup.deduplicated(drawn)
    assert left.count() == len({_norm(r.text) for r in drawn.collect()}) and left.columns == docs.columns
    copies = exact_dedup.deduplicated(mixing.mixed(docs))
    assert copies.count() == len({_norm(r.text) for r in mixing.mixed(docs).collect()})
    assert exact_dedup.deduplicated(docs.filter("doc_id % 2 = 0").select("text", "doc_id")).columns == ["text", "doc_id"]


@pytest.mark.parametrize("key_chars", [64, 1])
def test_state_goes_on_from_call_to_call(spark, tmp_path, key_chars):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcd", k=rng.randrange(1, 4))) for _ in range(90)]
    feeds = []
    for n in range(3):
        path = str(tmp_path / f"feed{n}")
        spark.createDataFrame([(i, texts[i]) for i in range(30 * n, 30 * n + 30)], "doc_id long, text string").coalesce(2).write.parquet(path)
        feeds.append(spark.read.parquet(path))
    seen = {}
    for feed in feeds:
        for _ in range(2):                  # the second time is a repeated call, which feeds nothing
            got = exact_dedup.exact_dedup(feed, state=str(tmp_path / "state"), key_chars=key_chars).collect()
        rows = {r.doc_id: r.text for r in feed.collect()}
        seen |= rows
        groups = collections.defaultdict(list)
        for i, t in seen.items():
            groups[_norm(t)].append((-len(t), i))
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == {
            i: (min(groups[_norm(t)])[1], len(groups[_norm(t)]), min(groups[_norm(t)])[1] == i) for i, t in rows.items()}
    with pytest.raises(ValueError, match="earlier feed"):
        exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "feed0"), str(tmp_path / "feed1")), state=str(tmp_path / "state"))


def test_small_tables_are_few_files(spark):
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    most = spark.sparkContext.defaultParallelism
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert lookup(spark.range(90).groupBy("id").count(), few=True).rdd.getNumPartitions() <= most
        chain = spark.range(1, 9).selectExpr("id AS a", "id + 1 AS b")
        found = graph.components(chain)
        assert {(r.node, r.root) for r in found.collect()} == {(i, 1) for i in range(1, 10)}
        assert found.filter("node <> root").rdd.getNumPartitions() <= most + 16   # the links' files, and one shuffle for the roots
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(6000, 6100)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("tight", [2, 3])
def test_links_find_every_pair(spark, tight):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(fps)[:6]:
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))) for _ in range(60)}
    fps = sorted(_signed(x) for x in fps)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in simhash_dedup.links(spark.createDataFrame([(x,) for x in fps], "fp long"), tight=tight).collect()}
    assert {x: got.get(x, x) for x in fps} == {x: find(x) for x in fps}


def _brute_fp(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _brute_groups(docs):
    """{id: (fingerprint, smallest id reachable)}"""
    fp = {i: _brute_fp(t) for i, t in docs}
    parent = {i: i for i in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(fp)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (fp[i], find(i)) for i in ids}


def test_op3_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark, SMALL).collect()]
    expected = _brute_groups(docs)
    rows = REGISTRY["op3_simhash_dedup"](spark, SMALL).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows} == expected and len(rows) == len(docs)


def test_simhash_odd_rows(spark, odd):
    rows = simhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(TEXTS)
    assert {r.fingerprint for r in rows if r.doc_id in (4, 5, 6)} == {"0" * 16}
    assert sum(r.kept for r in rows) == 8  # equal ids do not join the two texts of document 9
    kept = simhash_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert simhash_dedup.near_duplicates(odd.limit(0)).collect() == []


def test_line_dedup(spark):
    page = "<html><script>var p='</p>'</script><nav><li>Home</li><li>About us</li></nav><p>Story <b>{}</b></p>{}</html>"
    rows = [(i, "https://User@A.example:80/x", page.format(i, "<p>Home</p>" if i == 3 else "")) for i in range(6)]
    rows += [(10, "http://b.example", page.format(10, "")), (11, None, "plain\ntext"), (11, None, "plain\ntext"), (12, "nonsense", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS marks")
    for few in (5000, 0):
        got = sorted((r.page_id, r.host, r.kept) for r in line_dedup.cleaned(df, few_hosts=few).collect())
        assert got == sorted([(i, "a.example", [f"Story {i}"]) for i in range(6)] + [(10, "b.example", ["Home", "About us", "Story 10"])]
                             + [(11, "", [])] * 2 + [(12, "", [])])
    assert line_dedup.cleaned(df.limit(0)).collect() == []


def test_lines_of_small_hosts_and_tags_that_only_begin_like_scripts(spark):
    rows = [(n, f"http://h{h}.example/{n}", f"<li>Menu</li><p>Page {n} of {h}</p>") for h in range(1, 5) for n in range(10 * h, 11 * h)]
    rows += [(90, "http://x.example", "<scripture>verse</scripture><p>keep</p><script>gone()</script><styled>s</styled><STYLE type=a>gone</STYLE >"),
             (91, "http://x.example", "<script src='a'>gone</script>&amp; <script>open")]
    got = {r.page_id: r.kept for r in line_dedup.cleaned(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[10] == ["Menu", "Page 10 of 1"]          # the only page of its host
    assert all(got[n] == [f"Page {n} of {h}"] for h in range(2, 5) for n in range(10 * h, 11 * h))
    assert got[90] == ["verse", "keep", "s"] or got[90] == ["versekeep", "s"], got[90]
    assert got[91] == ["&amp; open"]


def test_fingerprints_and_next(spark, odd):
    df = odd.selectExpr("doc_id", "coalesce(text, '') AS text", "source")
    rows = fingerprints.with_next(df, "doc_id", ["text"]).collect()
    order = sorted(((i is None, -(i or 0), t or "") for i, t, _ in TEXTS))
    expected = collections.Counter((x, order[(k + 1) % len(order)][2]) for k, x in enumerate(order))
    assert collections.Counter(((r.doc_id is None, -(r.doc_id or 0), r.text), r.next_text) for r in rows) == expected
    assert fingerprints.with_next(df.limit(0), "doc_id", ["text"]).collect() == []
    one = fingerprints.with_next(df.filter("doc_id = 1"), "doc_id", ["text"]).collect()
    assert [(r.text, r.next_text) for r in one] == [("a b c", "a b c")]
    assert fingerprints.text_simhash(None) == fingerprints.text_simhash(" ") == 0
    assert fingerprints.text_simhash("A b c") == fingerprints.text_simhash("a  b\nc")


@pytest.mark.parametrize("tight", [1, 2])
def test_block_tables_find_all(spark, tight):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = [_signed(x) for x in base + [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for x in base]]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    queries = fps[::7]
    got = {(r.query, r.found): (r.distance, r.copies) for r in fingerprints.within_radius(
        spark.createDataFrame([(x,) for x in queries], "fp long"), df, tight=tight).collect()}
    counts = collections.Counter(fps)
    expected = {(q, x): (d, counts[x]) for q in set(queries) for x in counts if (d := ((q ^ x) & (1 << 64) - 1).bit_count()) <= 3}
    assert got == expected


def test_op6_edits(spark):
    docs = sorted(((r.doc_id, r.text) for r in documents(spark, SMALL).collect()), reverse=True)
    rows = {r.doc_id: r for r in REGISTRY["op6_fingerprints"](spark, SMALL).collect()}
    assert len(rows) == len(docs)
    for k, (i, t) in enumerate(docs):
        n = len(t) // 3
        edited = t[:len(t) - n] + docs[(k + 1) % len(docs)][1][:n]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
        assert int(rows[i].edited_fingerprint, 16) == fingerprints.text_simhash(edited) % (1 << 64)
    assert sum(r.near_edited > r.near_next for r in rows.values()) / len(rows) > 0.95


def test_sharding(spark, odd):
    rows = sharding.shard_documents(odd, 40).collect()
    assert len(rows) == len(TEXTS) and all(r.grown_shard in (r.shard, 40) for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    by = collections.defaultdict(list)
    for r in REGISTRY["op7_sharding"](spark, "/root/testdata/sf0.01").collect():
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(40))
    ids = spark.range(20000)
    share = {r.s: r["count"] for r in ids.select(sharding.rendezvous(ids.id, [1.0, 3.0]).alias("s")).groupBy("s").count().collect()}
    assert abs(share[1] / 20000 - 0.75) < 0.02
    assert sharding.shard_documents(odd.limit(0)).collect() == []
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in rows}
    assert {(4, 16, 0), (2, 19, 0x352441C2)} <= sizes


def _own_shard(key, weights):
    """The shard with the least exponential draw, from XXH64 over seed, shard and key one after the other."""
    def draw(i, w):
        h = 42
        for value, size in ((sharding.SEED, 4), (i, 4), (key, 8)):
            h = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), h)
        return -math.log(((h >> 11) + 0.5) / 2**53) / w, i
    return min(draw(i, w) for i, w in enumerate(weights))[1]


@pytest.mark.parametrize("weights", [[1.0] * 40, [1.0, 3.0, 0.5, 2.0]])
def test_shards_against_an_own_argmin(spark, weights):
    docs = spark.range(-20, 480).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    rows = sharding.shard_documents(docs, weights).collect()
    assert all(r.shard == _own_shard(r.doc_id, weights) and r.grown_shard == _own_shard(r.doc_id, [*weights, 1.0]) for r in rows)


def _own_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    terms = collections.Counter(" ".join(words[i:i + 2]) for i in range(max(1, len(words) - 1))) if words else {}
    votes = [0.0] * 64
    for term, tf in terms.items():
        h = xxhash.xxh64_intdigest(term, 42)
        for b in range(64):
            votes[b] += (1 + math.log(tf)) * (1 if h >> b & 1 else -1)
    return sum(1 << b for b in range(64) if votes[b] > 1e-9 * sum(1 + math.log(n) for n in terms.values()))


def test_op6_against_an_own_simhash(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in documents(spark, SMALL).collect()), reverse=True)
    fp = [_own_simhash(t) for _, t in docs]
    rows = {r.doc_id: r for r in REGISTRY["op6_fingerprints"](spark, SMALL).collect()}
    for k, (i, t) in enumerate(docs):
        nxt, n = (k + 1) % len(docs), len(t) // 3
        edited = _own_simhash(t[:len(t) - n] + docs[nxt][1][:n])
        r = rows[i]
        assert (int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) == (fp[k], edited)
        assert r.near_edited == 1 - (fp[k] ^ edited).bit_count() / 64 and r.near_next == 1 - (fp[k] ^ fp[nxt]).bit_count() / 64
        assert r.n_within == (sum((fp[k] ^ x).bit_count() <= 3 for x in fp) if i % 50 == 0 else None)


def test_mixing_targets_and_reruns(spark, odd):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7)).collect()}
    assert {r.doc_id: r.copies for r in rows} == again
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.size * r.copies
        assert 0 <= r.copies <= 3
    for source, target, size in {(r.source, r.target, r.source_size) for r in rows}:
        assert abs(taken[source] - target) <= 0.05 * target and target <= 3 * size
    total = sum(r.size for r in rows)
    assert abs(sum(t for _, t in {(r.source, r.target) for r in rows}) - total) < 1e-6 * total
    got = mixing.mix(odd)
    assert got.count() == len(TEXTS) and got.columns == [*[c for c in odd.columns if c not in ("size", "target")], "size", "source_size", "target", "copies"]
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).collect() == []


def test_mixing_comes_near_small_targets_and_takes_longer_documents_more_often(spark):
    rows = mixing.mix(documents(spark, SMALL)).select("source", "size", "source_size", "target", "copies").collect()
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - t) <= 0.07 * t for s, t in {(r.source, r.target) for r in rows})
    big = spark.createDataFrame([(i, "a" if i < 3000 else "b", "w " * (2 if i % 2 else 60)) for i in range(3300)], "doc_id long, source string, text string")
    got = [r for r in mixing.mix(big, weights=(1, 30)).collect() if r.source == "a"]
    long, short = ([r.copies for r in got if r.size == n] for n in (60, 2))
    ratio = (sum(long) / len(long)) / (sum(short) / len(short))
    odds = math.log(61) / math.log(3)
    assert got[0].target < got[0].source_size and 0.75 * odds < ratio < 1.3 * odds


def test_mixing_document_weights(spark):
    rows = [(i, "a", "w " * (1 + i % 5), 10.0 if i < 20 else 1.0) for i in range(400)] + [(1000 + i, "b", "w " * 30, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, weight double")
    got = [r for r in mixing.mix(df, weights=(1, 9), doc_weight="weight").collect() if r.source == "a"]
    target = got[0].target
    assert 0 < target < got[0].source_size and abs(sum(r.size * r.copies for r in got) - target) <= 5
    heavy = sum(r.copies for r in got if r.doc_id < 20) / 20
    assert heavy > 2 * sum(r.copies for r in got if r.doc_id >= 20) / 380


def test_targets_share_what_a_cap_leaves(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 990), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 0
    assert abs(got["b"] - 1970 * 2 / 3) < 1e-6 and abs(got["c"] - 1970 / 3) < 1e-6


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = documents(spark, SMALL)
    rows = {r.doc_id: r for r in docs.collect()}
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns[:5] == docs.columns
    got = out.collect()
    groups = collections.defaultdict(list)
    for i, r in rows.items():
        if re.search(r"[^\W\d_]", r.text or ""):
            groups[_norm(r.text)].append((-len(r.text), i))
    exact = [min(v)[1] for v in groups.values()]
    near = _brute_groups([(i, rows[i].text) for i in exact])
    left = {i for i, (_, root) in near.items() if i == root}
    sizes = collections.Counter()
    for i in left:
        sizes[rows[i].source] += len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text))
    targets = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    taken, copies = collections.Counter(), collections.Counter(r.doc_id for r in got)
    assert set(copies) <= left and max(copies.values()) <= 3
    from tokenizers import Tokenizer

    from textcoder.llm.queries import tokenizer_path
    library = Tokenizer.from_file(tokenizer_path())
    for r in got:
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.text == rows[r.doc_id].text and list(r.token_ids) == library.encode(r.text, add_special_tokens=False).ids
    for s, t in targets.items():
        largest = max(len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text)) for i in left if rows[i].source == s)
        assert abs(taken[s] - t) <= largest / 2


def test_pipeline_stages_on_odd_and_empty_tables(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int"
    rows = [(i, t, "en" if i != 3 else None, s, 0, 1) for i, t, s in TEXTS]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SMALL)
            assert out.columns[:6] == df.columns, name
            assert out.count() >= 0
