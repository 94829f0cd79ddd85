"""Corpus operators against brute force, exact round trips and hostile tables."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from chronoweave.llm import cotrain, itq, line_dedup, lm_score, minhash, mixing, packing, site_tree, token_files, winnow
from chronoweave.llm.common import fresh_path, ship, table
from chronoweave.llm.components import components
from chronoweave.llm.encoding import Encoder
from chronoweave.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int"
#: Nulls in any column, empty and white texts, ties, repeated rows, one word, odd characters, a very long text.
HOSTILE = [
    (None, "alpha beta gamma", "en", "src1", 16),
    (1, None, None, None, None),
    (2, "", "en", "src1", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "word", None, "src2", 4),
    (5, "alpha beta gamma delta", "en", "src1", 22),
    (5, "alpha beta gamma delta", "en", "src1", 22),
    (6, "ALPHA beta  gamma\ndelta", "en", "src1", 23),
    (7, "é ß 漢字 <|endoftext|> \x00 don't 12 ½", "xx", "src3", 30),
    (8, "long line of many words " * 6000, "en", "src1", 144000),
]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def hostile(spark):
    return spark.createDataFrame(HOSTILE, DOCS).withColumn("digest", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n", F.lit(2))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def least(up, links):
    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in up}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)] + [(None, 1)]
    want = least({x: x for p in pairs for x in p if x is not None}, [p for p in pairs if None not in p])
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: c for x, c in want.items() if x in got} and all(want[x] == x for x in want if x not in got)


# Encoding and token files.
@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path(), kept=200)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.sampled_from(list("ab zÀé'.,!*$\n\t\r  \xa0 \x01ćß中😀012½<|>")), max_size=40), st.text(max_size=30), st.just("x<|endoftext|> y")), max_size=6))
def test_encoder_is_the_library(encoder, texts):
    assert [list(x) for x in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def small_encoder():
    return Encoder(tokenizer_path(), kept=3, at_once=7)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abz Àɏɐé'.,*$\n\t\x1c \xa0\u2003\u3000ß中😀5½\u0301б")), max_size=60), max_size=8))
def test_encoder_cuts_long_texts_and_empties_its_store(small_encoder, texts):
    enc = small_encoder
    texts = [*texts, "a b " * 30, "x" * 200, None, "word " + "y" * 90 + " z"]
    ids, sizes = enc.flat(pa.array(texts, pa.string()))
    want = [e.ids for e in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_token_files_round_trip(spark, hostile, none, encoder):
    folder = fresh_path(spark, "t")
    token_files.write_token_files(hostile, folder, tokenizer_path(), 2, partitions=3)
    got = token_files.read_token_files(spark, folder).orderBy("position").collect()
    want = sorted(((-1 if i is None else i, t or "") for i, t, *_ in HOSTILE), key=lambda x: x[0])
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == [i for i, _ in want]
    at = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        assert token_files.token_ids(folder, r["position"]).tolist() == ids
        at += len(ids)
    folder = fresh_path(spark, "t")
    assert token_files.write_token_files(none, folder, tokenizer_path(), 2)["n_docs"] == 0
    assert token_files.read_token_files(spark, folder).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 30), max_size=30))
def test_shortest_pack_first_places_every_length(counts):
    placed = defaultdict(int)
    for n, pattern in packing.shortest_pack_first(counts, 64):
        assert n > 0 and sum(pattern) <= 64 and list(pattern) == sorted(pattern, reverse=True)
        for x in pattern:
            placed[x] += n
    assert placed == counts


def test_packing(spark, hostile, none, encoder, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 3)
    docs = hostile.unionByName(table(spark, SF, "documents").withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True)
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    assert sum(r["length"] for r in got) == sum(len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts)
    seq, pieces = defaultdict(list), defaultdict(set)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].add((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for rows in seq.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    for i, t in texts:
        ids = [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want = {(k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()), len(ids)) for k in range(0, len(ids), 2048)}
        assert want <= pieces[i]
    assert packing.pack_documents(none, tokenizer_path()).count() == 0
    p = packing.padding(packing.pack_documents(table(spark, "/root/testdata/sf0.01", "documents"), tokenizer_path())).first()
    assert p["pad"] < 0.02 * p["ids"]


# Near duplicates.
def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_brute(texts, k):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    some = [i for i in sorted(sets) if sets[i]]
    links = [(a, b) for n, a in enumerate(some) for b in some[:n] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, least({i: i for i in sets}, links)


def variants(seed, groups, size):
    """Groups of near copies in which some link only through others."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{g}x{rng.randint(0, 400)}" for _ in range(60)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = f"v{rng.randint(0, 10**6)}"
            out.append(" ".join(t))
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("paired", [0, 6])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(minhash, "PAIRED", paired)
    texts = variants(3, 4, 40) | {1000: "", 1001: None, 1002: "one", 1003: "ONE", 1004: "one\ttwo", 1005: "a " * 30000}
    sets, want = near_brute(texts, 2)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, size=2).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


@pytest.mark.parametrize("paired", [0, 6])
def test_near_duplicates_when_star_rounds_are_used_up(spark, monkeypatch, paired):
    monkeypatch.setattr(minhash, "PAIRED", paired)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)  # the first round never breaks off while pairs are open
    texts = variants(3, 4, 40)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, size=2).collect()}
    assert got == near_brute(texts, 2)[1]


def test_near_duplicates_with_ids_of_several_texts(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(f"{n}{rng.randint(0, 999)}" for _ in range(40)) for n in "abc")
    rows = [(1, a), (1, b), (2, b + " word"), (3, c), (3, a), (7, c + " more"), (7, c + " more"), (9, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, size=2).collect())
    n = len(shingles(c + " more", 2))
    assert got == sorted([(i, len(shingles(t, 2)), 1 if t[0] != "c" else 3) for i, t in rows]) and (7, n, 3) in got
    left = sorted((r["doc_id"], r["text"]) for r in minhash.without_near_duplicates(docs, size=2).collect())
    assert left == sorted([(1, a), (1, b), (3, c)])
    few = spark.createDataFrame([(1, a), (5, a), (5, b), (6, a), (None, a), (8, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in minhash.without_near_duplicates(few).collect() if r["text"]) == [(0, a), (1, a), (5, b)]


def test_signature_estimates_similarity():
    c, rng = minhash.Circulant(2000), np.random.default_rng(0)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    y = np.concatenate([x[:250], rng.integers(0, 2**63, 50, dtype=np.uint64)])
    assert abs((c.signature(x) == c.signature(y)).mean() - 250 / 350) < 0.05


def test_near_duplicates_hostile(spark, hostile, none):
    got = minhash.near_duplicates(hostile, size=2).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(HOSTILE) and by[5]["component_id"] == by[6]["component_id"] == 5 and by[None]["component_id"] is None
    assert by[1]["kept"] and by[2]["kept"] and by[3]["n_shingles"] == 0
    assert minhash.near_duplicates(none).count() == 0


def test_near_vectors_with_ids_of_several_vectors_and_lengths(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, x), (1, y), (2, y), (4, [0.0, 1.0, 0.1]), (10, [1.0, 0.0]), (11, [1.0, 0.01]), (12, [0.0, 1.0]), (13, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("of", F.lit(1))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in itq.near_vectors(df).collect())
    assert got == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (4, 2, 1), (10, 1, 10), (11, 1, 10), (12, 0, 12), (13, 0, 13)]


@pytest.mark.parametrize("bits", [None, 24])
def test_near_vectors_equal_brute_force(spark, bits):
    rng = np.random.default_rng(5)

    def near(v, c):
        u = rng.normal(size=32)
        u -= u @ v * v
        u /= np.linalg.norm(u)
        return c * v + np.sqrt(1 - c * c) * u

    base = rng.normal(size=(60, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [*base, *(near(base[k], rng.uniform(0.86, 1)) for k in range(60) for _ in range(3)), *(near(base[0], rng.uniform(0.93, 0.999)) for _ in range(150)), *[base[1]] * 20]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.permutation(np.array(rows)))]
    odd = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, []), (9004, [None, *[1.0] * 31]), (9005, [1.0, 2.0]), (9006, [float("inf"), *[1.0] * 31])]
    df = spark.createDataFrame([*data, *odd, (None, data[0][1])], "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("w", F.lit("x"))
    got = {r["vec_id"]: r for r in itq.near_vectors(df, key_bits=bits).collect()}
    x = np.array([v for _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    want = least({i: i for i, _ in data}, [(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True)])
    links = {i: int(hit[i].sum()) - 1 for i, _ in data}
    found = {i: got[i]["n_links"] for i, _ in data}
    assert all(found[i] <= links[i] for i in links) and sum(found.values()) >= 0.99 * sum(links.values())
    assert sum(got[i]["component_id"] != want[i] for i in want) <= 0.01 * len(want)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in odd)
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert itq.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert itq.near_vectors(spark.createDataFrame(odd[:4], "vec_id long, embedding array<double>")).count() == 4


# Lines.
@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=20), st.lists(st.integers(0, 6), max_size=20))
def test_patience_matches_are_common_and_increasing(a, b):
    pairs = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_identical_sequences_align_whole():
    assert line_dedup.patience([1, 1, 2, 1], [1, 1, 2, 1]) == [(k, k) for k in range(4)]


def every_block(texts, least_chars):
    """Lines of each text that lie in a stretch of consecutive lines, long enough, which any earlier text has."""
    lines = {i: [x.strip(" ") for x in t.split("\n")] for i, t in texts.items()}
    gone = {i: set() for i in texts}
    for b in texts:
        for a in (x for x in texts if x < b):
            for j in range(len(lines[b])):
                for i in range(len(lines[a])):
                    n = 0
                    while i + n < len(lines[a]) and j + n < len(lines[b]) and lines[a][i + n] == lines[b][j + n]:
                        n += 1
                    if sum(map(len, lines[b][j : j + n])) >= least_chars:
                        gone[b] |= set(range(j, j + n))
    return gone


def without(texts, gone):
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in texts.items()}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(7)
    pool = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, 30))) for _ in range(60)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts = {}
    for i in range(80):
        body = rng.sample(pool, rng.randint(1, 5)) + [f"own {i} {rng.random()} and more text to fill"]
        if rng.random() < 0.4:
            body.insert(rng.randrange(len(body)), passage)
        if i > 10 and rng.random() < 0.3:
            body = texts[rng.randrange(10)].split("\n") + body
        texts[i] = "\n".join(body)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_blocks(df).collect()}
    want = without(texts, every_block(texts, line_dedup.BLOCK_CHARS))
    assert {i: r["text"] for i, r in got.items()} == want
    holders = [i for i in texts if passage in want[i]]
    assert holders == [min(i for i in texts if passage in texts[i])]
    assert all(r["n_lines"] == len(texts[i].split("\n")) for i, r in got.items())


def test_line_dedup_compares_passages_of_short_common_lines(spark):
    one, two = ("x" * 52).join("ab"), "y" * 70
    texts = {k: f"{one}\nown {k}" for k in range(8)} | {k: f"own {k}\n{two}" for k in range(8, 16)}
    texts |= {k: f"start {k}\n{one}\n{two}\nend {k}" for k in range(16, 20)}
    rng = random.Random(11)
    pool = ["", "", *("".join(rng.choice("abcdef ") for _ in range(rng.choice([3, 15, 40, 60]))).strip() + "." for _ in range(7))]
    texts |= {k: "\n".join([f"first {k}", *(rng.choice(pool) for _ in range(rng.randint(1, 12)))]) for k in range(20, 90)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_blocks(df).collect()}
    assert got[16] == texts[16] and got[17] == "start 17\nend 17"
    assert got == without(texts, every_block(texts, line_dedup.BLOCK_CHARS))


@pytest.mark.parametrize("small", [False, True])
def test_line_dedup_of_lines_with_other_first_holders(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(line_dedup, "BROADCAST_DOCS", 0)
    three = [c * 52 for c in "abc"]
    texts = {k: f"{x}\nown {k}" for k, x in enumerate(three)} | {k: "\n".join([f"own {k}", *three]) for k in range(10, 18)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_blocks(df).collect()}
    assert got == {k: t if k <= 10 else f"own {k}" for k, t in texts.items()}


@pytest.mark.parametrize("lines", [[1], [1, 2], [1, 2, 3, 1]])
def test_repeated_lines_take_linear_time(lines):
    rng = random.Random(3)
    b = lines * (40_000 // len(lines))
    began = time.perf_counter()
    found = line_dedup.common_blocks([9, *lines[:1]], b, [200] * len(b), 120)
    assert [p for s, e in found for p in range(s, e)] == [p for p, x in enumerate(b) if x == lines[0]]
    mixed = [rng.choice(lines) for _ in range(40_000)]
    assert line_dedup.common_blocks(mixed[::-1], mixed, [200] * len(mixed), 120) == [(0, len(mixed))]
    assert time.perf_counter() - began < 4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25), st.integers(1, 12))
def test_common_blocks_are_all_common_stretches(a, b, least):
    sizes = [x + 1 for x in b]
    want = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            want |= set(range(j, j + n)) if sum(sizes[j : j + n]) >= least else set()
    assert {p for s, e in line_dedup.common_blocks(a, b, sizes, least) for p in range(s, e)} == want


def test_line_dedup_keeps_columns_named_as_its_own(spark):
    text = "\n".join("line %d of a passage that several documents share in full" % k for k in range(4))
    df = spark.createDataFrame([(k, text, f"x{k}", "y", "z", 7) for k in range(3)], "doc_id long, text string, __doc string, __th string, gone string, TH int")
    got = sorted(line_dedup.drop_repeated_blocks(df).collect(), key=lambda r: r["doc_id"])
    assert [(r["__doc"], r["__th"], r["gone"], r["TH"]) for r in got] == [(f"x{k}", "y", "z", 7) for k in range(3)]
    assert [r["text"] for r in got] == [text, "", ""]


def test_line_dedup_hostile(spark, hostile, none):
    got = line_dedup.drop_repeated_blocks(hostile.withColumn("gone", F.lit(1)))
    assert got.columns[-3:] == ["gone", "n_lines", "n_removed"] and got.count() == len(HOSTILE)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: t for i, t, *_ in HOSTILE}
    assert line_dedup.drop_repeated_blocks(none).count() == 0


# Mixing.
def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "d string, l string, tokens long")
    got = {(r["d"], r["l"]): r["alloc"] for r in mixing.budgets(leaves, ["d", "l"], {}, 40, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 392, ("b", "z"): 402}
    tight = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "z", 1000)], "d string, l string, tokens long")
    assert {(r["d"], r["l"]): r["alloc"] for r in mixing.budgets(tight, ["d", "l"], {}, 50, 1).collect()} == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 485}


def test_mix_takes_seeded_prefixes(spark, hostile, none):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 9)), rng.choice("ab"), rng.choice("xy")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, l string")
    got = mixing.mixed(df, ["d", "l"], {"d": {"a": 3}}, percent=120, epochs=3, seed=5).collect()
    size = {i: len(t.split()) for i, t, *_ in rows}
    total = sum(size[r["doc_id"]] for r in got)
    assert 0.97 * 1.2 * sum(size.values()) <= total <= 1.2 * sum(size.values())
    for d in "ab":
        for leaf in "xy":
            mine = [r for r in got if (r["d"], r["l"]) == (d, leaf)]
            full = max(r["epoch"] for r in mine)
            order = sorted((hashlib.md5(f"5-{full}-{i}".encode()).hexdigest(), i) for i, _, x, y in rows if (x, y) == (d, leaf))
            took = {r["doc_id"] for r in mine if r["epoch"] == full}
            assert [i in took for _, i in order] == sorted((i in took for _, i in order), reverse=True)
    clash = hostile.withColumns({c: F.lit(7) for c in ("full", "cut", "rest", "alloc", "tokens", "n_tokens", "head", "draw", "w", "cap", "__lang", "before", "through")})
    assert mixing.mixed(clash, ["lang", "source"], {}, percent=100, epochs=1).columns == [*clash.columns, "epoch"]
    assert mixing.mixed(clash, ["lang", "source"], {}, percent=100, epochs=1).count() == mixing.mixed(hostile, ["lang", "source"], {}, percent=100, epochs=1).count()
    h = mixing.mixed(hostile, ["lang", "source"], {}, percent=100, epochs=1)
    assert h.columns == [*hostile.columns, "epoch"] and h.filter("doc_id = 8").count() == 1
    assert mixing.mixed(none, ["lang", "source"], {}).count() == 0


# Quality.
def test_cotraining_held_out_accuracy_and_hostile(spark, hostile, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = cotrain.train(docs, labels)
    assert model.held_out_accuracy >= 0.97
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = {r["doc_id"]: r["good"] for r in cotrain.score(docs, model).select("doc_id", "good").collect()}
    assert len(good) == docs.count() and np.mean([good[i] == (q == 1) for i, q in truth.items()]) >= 0.98
    odd = cotrain.score(hostile.withColumn("score", F.lit("old")), model)
    assert odd.count() == len(HOSTILE) and odd.filter("score is null").count() == 0
    assert cotrain.score(none, model).count() == 0
    assert cotrain.train(docs, labels.filter("quality = 1")) is None and cotrain.train(none, labels.limit(0)) is None
    assert cotrain.score(hostile, None).filter("good").count() == len(HOSTILE)


def test_cotraining_equals_rounds_in_memory(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(400):
        good = rng.random() < 0.6
        words = [rng.choice(["alpha beta", "gamma", "delta epsilon"] if good == (rng.random() < 0.9) else ["!!", "buy now", "$$$ 99"]) for _ in range(rng.randint(2, 30))]
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), f"src{rng.randint(0, 2) + (3 if good == (rng.random() < 0.9) else 0)}", rng.randint(1, 5000)))
        if i % 4 == 0:
            labels.append((i, int(good)))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    model = cotrain.train(docs, known, rounds=2, take=10, sure=0.8)

    label = dict(labels)
    f4 = lambda v: v.astype("<f4").astype(float)
    view = {"text": {r[0]: f4(cotrain.text_view(r[1])) for r in rows}, "meta": {r[0]: f4(cotrain.meta_view(*r[2:])) for r in rows}}
    mine = {k: [(i, label[i]) for n, i in enumerate(sorted(label)) if n % 4 != 3] for k in view}
    rate = {c: np.mean([y == c for _, y in mine["text"]]) for c in (0, 1)}
    fit = lambda: {k: cotrain.fit_logistic(np.array([view[k][i] for i, _ in v]), np.array([y for _, y in v])) for k, v in mine.items()}
    for _ in range(2):
        w, add = fit(), {"text": [], "meta": []}
        for giver, taker in (("text", "meta"), ("meta", "text")):
            m = {i: float(view[giver][i] @ w[giver][:-1] + w[giver][-1]) for i in view[giver] if i not in label and i not in dict(mine[taker])}
            for c in (0, 1):
                order = sorted((-(x if c else -x), i) for i, x in m.items() if (x if c else -x) >= np.log(4))
                add[taker] += [(i, c) for _, i in order[: int(np.ceil(20 * rate[c]))]]
        assert add["text"] and add["meta"]
        mine = {k: mine[k] + add[k] for k in mine}
    w = fit()
    assert np.allclose(model.text, w["text"], atol=1e-4) and np.allclose(model.meta, w["meta"], atol=1e-4)


# Pages.
def test_main_text_equals_simple_reading(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in site_tree.extract(pages).collect():
        body = re.search(r"<article>(.*?)</article>", raw[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", p))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_page_parts():
    page = """<html><head><title>T</title></head><body><header>Top</header><nav><a>Menu</a></nav><article><header><h1>A &amp; B</h1></header><p>one<br>two <i>three</i>
      <p>four<script>var x = "</p>";</script><div class="comments"><p>reader</div><ul><li>x<li>y</ul></article><aside>side</aside><div id="cookie-notice">c</div><footer>f"""
    assert site_tree.main_text(page) == "A & B\n\none two three\n\nfour\n\nx\n\ny"
    assert site_tree.main_text("a &lt; b") == "a < b" and site_tree.main_text(None) == "" and site_tree.main_text("<p>") == ""
    assert site_tree.main_text("<div>" * 3000 + "deep") == "deep"


def test_attributes_are_read_by_position():
    text = site_tree.main_text
    for attrs in ("class='entry-header'", "data-role='navigation'", "title='the hidden valley'", 'data-x="class=ad role=search"', "class='side-effects'", "title=\"a > b class='ad'\""):
        assert text(f"<article><section {attrs}>Kept</section><p>Body</p></article>") == "Kept\n\nBody", attrs
    assert text("<article><p hidden>x</p><p role=search>y</p><p CLASS=ad>z</p><p>Body</p></article>") == "Body"
    assert text("<p>1 < 2 and <b>so on") == "1 < 2 and so on" and text("one <b two") == "one <b two"


@pytest.mark.parametrize("part", ["<a x ", "<div>x", '<a x="', "<a x='", "<a x=\"'>", "<b>x</i>", "<span><hr>", "<p><div><i>", "</p", "<!-", "<script>", "<a \"b'>c", "<li><ul>"])
def test_hostile_pages_take_linear_time(part):
    began = time.perf_counter()
    site_tree.main_text(part * (1_000_000 // len(part)), frozenset([1]), frozenset([1]))
    assert time.perf_counter() - began < 8


def test_words_in_classes_take_no_article():
    text = site_tree.main_text
    assert text("<div class='page has-sidebar'><article>Body</article><div class='sidebar'>x</div></div>") == "Body"
    assert text("<article><div class='entry-header'><h1>Head</h1></div><div class='header'>by A</div><p>Body</p><div class='ad'>x</div></article>") == "Head\n\nby A\n\nBody"
    for name in ("social-sciences", "search-results", "legal-news", "share-price", "left-side"):
        assert text(f"<div class='{name}'><p>Long words of the page itself</p></div><div class='ad'>x</div>") == "Long words of the page itself"
        assert text(f"<article><p>Body of the article</p><div id='{name}'>part</div></article>") == "Body of the article\n\npart"
    assert text("<article>A long body of an article</article><div id='comments'><article>Nice</article></div>") == "A long body of an article"
    assert text("<div class='promo'>one</div><div class='share'>two</div>") == "one\n\ntwo"


def test_no_enclosing_element_takes_the_article():
    text = site_tree.main_text
    for around in ("form id='aspnetForm'", "div aria-hidden='true'", "div hidden", "div style='display: none'", "div role='form'", "div role='dialog'"):
        end = around.split()[0]
        assert text(f"<{around}><nav>{'Menu ' * 40}</nav><article><p>Body of the text</p></article><footer>f</footer></{end}>") == "Body of the text", around
        assert text(f"<{around}><nav>{'Menu ' * 40}</nav><div><p>Body of the text</p></div><footer>f</footer></{end}>") == "Body of the text", around
        assert text(f"<article><p>Body</p></article><{around}><p>A text that is longer than the article</p></{end}>") == "Body", around
    assert text("<aside><article><p>The body of the only article here</p></article></aside><p>x</p>") == "The body of the only article here"
    assert text("<form>Name <input></form>") == "Name" and text("<article hidden>x</article><article>Body</article>") == "Body"


def test_topics_in_articles_stay_and_teasers_are_no_article():
    text = site_tree.main_text
    assert text("<article><p>Body</p><p class='legal'>Law</p><section id='social'>Life</section><section id='search'>Quest</section><div class='ad'>x</div></article>") == "Body\n\nLaw\n\nLife\n\nQuest"
    assert text(f"<div class='content'><p>{'Long text of the page ' * 5}</p><article class='teaser'>Read on</article></div>") == ("Long text of the page " * 5).strip() + "\n\nRead on"
    assert text(f"<p>{'Words beside the main element ' * 5}</p><main><p>Body</p></main>") == "Body"


def test_importance_decides_beside_short_articles(spark):
    rows = [(i, "http://h.example/x", f"<div class='top'>{'The same words on each page ' * 5}</div><article><p>Own words {i}</p></article>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own words {i}" for i in range(20)}


def test_low_importance_branches_go_where_no_article_is(spark):
    rows = [(i, "http://h.example/x", f"<div class='top'>Same words</div><div class='c'><p>Own words {i}</p></div>") for i in range(20)]
    rows += [(90, "http://one.example/", "<div class='top'>Same words</div>"), (91, None, None), (92, "no url", ""), (93, "http://h.example/", "<<<>>&#xzz;<b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit(1))
    got = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    assert got[3] == "Own words 3" and got[90] == "Same words" and got[91] == got[92] == ""
    assert site_tree.extract(df.limit(0)).count() == 0


def test_low_importance_branches_go_inside_articles(spark):
    rows = [(i, "http://h.example/x", f"<main><h1>Head {i}</h1><div class='c'><p>Own words {i} <b>same</b> and on</p></div><div class='box'><p>About the author</p></div></main>") for i in range(20)]
    rows += [(k, "http://copies.example/", "<article><h1>Head</h1><p>Body</p></article>") for k in range(30, 40)]
    rows += [(k, "http://few.example/", f"<main><p>Own {k}</p><div class='box'>Same</div></main>") for k in range(50, 50 + site_tree.LEAST_PAGES - 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    assert got[3] == "Head 3\n\nOwn words 3 same and on" and got[30] == "Head\n\nBody" and got[50] == "Own 50\n\nSame"


# Language models.
def direct_losses(texts, target, least_words):
    """Both losses of each text by plain counting, its own counts left out."""
    words = {k: (t or "").lower().split() for k, t in texts.items()}
    counts = defaultdict(int)
    for w in words.values():
        for x in w:
            counts[x] += 1
    vocabulary = {x for x, n in counts.items() if n >= least_words}
    words = {k: [x if x in vocabulary else None for x in w] for k, w in words.items()}

    def model(keys):
        uni, bi = defaultdict(int), defaultdict(int)
        for k in keys:
            for x in words[k]:
                uni[x] += 1
            for pair in zip(words[k], words[k][1:], strict=False):
                bi[pair] += 1
        return uni, bi

    sides = [[k for k in texts if k in target], [k for k in texts if k not in target]]
    size = [sum(len(words[k]) for k in side) for side in sides]
    scale = [1, size[0] / size[1]]
    out = {}
    for k, w in words.items():
        losses = []
        for s in (0, 1):
            uni, bi = model([x for x in sides[s] if x != k])
            total, e = sum(uni.values()) * scale[s], 0.0
            for p, x in zip([0, *w], w, strict=False):
                share = (uni[x] * scale[s] + 1 / (len(vocabulary) + 1)) / (total + 1)
                joint, seen = (0, 0) if p == 0 else (bi[p, x] * scale[s], uni[p] * scale[s])
                e -= np.log((joint + lm_score.BACKED * share) / (max(seen, joint) + lm_score.BACKED))
            losses.append(e / len(w) if w else None)
        out[k] = losses
    return out


@pytest.mark.parametrize("hot_pairs", [1, 40, 10**6])
def test_losses_equal_direct_counts(spark, hot_pairs):
    rng = random.Random(2)
    texts = dict(enumerate(["a b a b c", "a b", "c c d", "", None, "d a", "A  b\nz", "a b a b c"]))
    texts |= {k: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(1, 40))) for k in range(10, 60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    target = {0, 5, 11, 13, 14, 20}
    ids = spark.createDataFrame([*((i,) for i in target), (None,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(df, ids, hot_pairs=hot_pairs).collect()}
    want = direct_losses(texts, target, 2)
    assert got.keys() == want.keys()
    for i, (t, b) in want.items():
        assert got[i]["n_words"] == len((texts[i] or "").split())
        if t is None:
            assert got[i]["difference"] is None
        else:
            assert abs(got[i]["target_loss"] - t) < 1e-6 and abs(got[i]["background_loss"] - b) < 1e-6 and abs(got[i]["difference"] - (t - b)) < 1e-6


def test_losses_tell_repeated_texts_apart_among_many_words(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(80)) for _ in range(400)]
    texts += texts[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(100, 200)], "doc_id long")
    got = {r["doc_id"]: r["difference"] for r in lm_score.cross_entropy_difference(df, ids).collect()}
    assert min(got[i] for i in [*range(20), *range(400, 420)]) > max(got[i] for i in range(200, 400))


def test_texts_without_id_are_told_apart(spark):
    texts = ["alpha beta w370398", "alpha beta w376180", "alpha beta", "alpha alpha beta"]  # the first two have one 32-bit hash
    want = {r["doc_id"]: (r["target_loss"], r["background_loss"]) for r in lm_score.cross_entropy_difference(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(9,)], "doc_id long")).collect()}
    got = lm_score.cross_entropy_difference(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string"), spark.createDataFrame([(9,)], "doc_id long")).collect()
    rounded = lambda rows: sorted((round(t, 9), round(b, 9)) for t, b in rows)
    assert rounded((r["target_loss"], r["background_loss"]) for r in got) == rounded(want.values()) and sorted(r["n_words"] for r in got) == [2, 3, 3, 3]


def test_lm_hostile(spark, hostile, none):
    clash = hostile.withColumn("th", F.lit(1)).withColumn("is_target", F.lit("x"))
    got = lm_score.cross_entropy_difference(clash, none.select("doc_id")).collect()
    assert len(got) == len(HOSTILE) and len({r["difference"] for r in got if r["doc_id"] == 5}) == 1
    assert lm_score.cross_entropy_difference(none, hostile.select("doc_id")).count() == 0


def test_words_are_hashed_in_bulk(monkeypatch):
    alone = []
    real = lm_score.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(lm_score.xxhash, "xxh3_64_intdigest", lambda w: alone.append(w) or real(w))
    words = ["a" * k for k in range(1, 300)] + ["é" * k for k in range(1, 200)] + ["a\0", "a\0\0", "\0", "漢字", "abcdefgh\0", "abcdefghi"]
    texts = [" ".join(words), None, "", " \n ", "\u2003".join(w.upper() for w in reversed(words[:200]))]
    sizes, hashes = lm_score.word_hashes(texts)
    every = [w for t in texts for w in lm_score.words_of(t)]
    assert sizes.tolist() == [len(words), 0, 0, 0, 200] and len(hashes) == len(every)
    assert len(set(hashes.tolist())) == len(set(every)) == len(set(zip(hashes.tolist(), every, strict=True)))
    assert min(map(len, alone)) > lm_score.LONG_WORD  # no other word is met by itself


# Fingerprints.
@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 12))
def test_winnowing_picks_rightmost_least(hashes, window):
    h, w = np.array(hashes, np.uint64), min(window, len(hashes))
    want = sorted({max(range(a, a + w), key=lambda j: (-hashes[j], j)) for a in range(len(hashes) - w + 1)})
    assert winnow.winnow(h, window).tolist() == want


def test_match_guarantee():
    rng = random.Random(0)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(winnow.GRAM + winnow.WINDOW - 1))
    a, b = (("".join(rng.choice("stuvwxyz ") for _ in range(n)) + shared + "".join(rng.choice("stuvwxyz ") for _ in range(n))) for n in (50, 83))
    assert set(winnow.fingerprint(a)[0].tolist()) & set(winnow.fingerprint(b)[0].tolist())


def test_winnowing_edit_and_next(spark, hostile, none):
    rows = [(i, t) for i, t, *_ in HOSTILE] + [(10 + k, f"text number {k} " * (k % 7)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash"))
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in winnow.compared_with_edit_and_next(df).collect())
    order = sorted(((-1 if i is None else i), t or "") for i, t in rows)
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert got == sorted(want)
    one = winnow.compared_with_edit_and_next(spark.createDataFrame([(1, "x" * 100)], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 100
    assert winnow.compared_with_edit_and_next(none).count() == 0


# Pipeline and queries.
def test_pipeline_stages(spark, hostile, none):
    docs = table(spark, SF, "documents")
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.count() <= before or k == len(corpus_pipeline.STAGES) - 1
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert stage(spark, hostile, SF).count() >= 1
        assert stage(spark, none, SF).count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_registered(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_minhash_reads_no_column_named_as_its_own(spark):
    words = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, words), (2, words), (3, words + " more")], "doc_id long, text string")
    for name in ("least", "digest", "id", "n", "key", "component"):
        docs = docs.withColumn(name, F.lit("x"))
    got = minhash.near_duplicates(docs, size=2, percent=80).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1)]
