"""Substring dedup against a plain count of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave.llm import substrings
from chronoweave.llm.common import table
from chronoweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    windows = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - width + 1) if windows[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def check(spark, rows, width, anchor):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.remove_repeated_spans(docs, width=width, anchor=anchor).collect()
    assert order([tuple(r)[:4] for r in got]) == order(brute(rows, width))
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 and (r.n_paths > 0) == (r.n_removed > 0) for r in got)


def test_equals_counting_on_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = QUERIES["op12_debruijn_spans"](spark, SF)
    assert got.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    got = got.collect()
    assert order([tuple(r)[:4] for r in got]) == order(brute(rows, 35))
    assert sum(r.n_removed for r in got) > 0


def test_branches_rings_overlaps_and_odd_texts(spark):
    draw = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, " ".join(passage)), (2, "x y " + "\t".join(passage[5:40])), (3, " ".join(passage[20:]) + " z"), (None, None), (None, ""), (4, "  \n "), (5, "a b c d e f g " * 9), (6, "c d e f g a b " * 4), (7, "o " * 200), (8, "short"), (8, "short"), (9, "é ß 漢字  " * 8), (9, "one\x0btwo\x0cthree " * 5), (10, "w" * 70000 + " " + " ".join(passage[:30]))]
    rows += [(20 + k, " ".join(draw.choice("abc") for _ in range(80))) for k in range(12)]
    check(spark, rows, 7, 3)
    check(spark, rows, 5, 5)


@given(st.lists(st.text("ab  \n", max_size=40), max_size=6), st.integers(1, 5))
@settings(max_examples=8, deadline=None)
def test_any_small_corpus(spark, texts, width):
    check(spark, list(enumerate(texts)), width, max(1, width - 2))


@given(st.text("ab ", max_size=300), st.integers(1, 9), st.data())
@settings(max_examples=200, deadline=None)
def test_runs_cover_each_window_once_and_depend_on_the_window_alone(text, width, data):
    anchor = data.draw(st.integers(1, width))
    words = b" ".join(text.encode().split())
    n, first, size, digests = substrings.window_runs(words, width, anchor)
    assert n == len(words.split()) and size.sum() == max(0, n - width + 1) and len(digests) == len(first)
    assert (first == size.cumsum() - size).all()
    anchors = {}
    for f, s, a in zip(first.tolist(), size.tolist(), (d[:8] for d in digests), strict=True):
        for k in range(f, f + s):
            assert anchors.setdefault(tuple(words.split()[k : k + width]), a) == a


def test_paths_are_compacted(spark):
    shared = " ".join(f"s{i}" for i in range(300))
    rows = [(k, f"left{k} {shared} right{k}") for k in range(4)]
    _, spans = substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [r.edges for r in spans.collect()]
    assert len(got) == 4
    for edges in got:
        # The inner runs lie on one path, in order and without gaps.
        path = Counter(e.path for e in edges).most_common(1)[0][0]
        inner = [e for e in edges if e.path == path]
        assert sum(e.size for e in inner) >= 200 and all(a.offset + a.size == b.offset for a, b in zip(inner, inner[1:]))


@pytest.mark.parametrize("every", [1, 2, 3, 1 << 40])
def test_chains_branches_and_rings(spark, every):
    draw = random.Random(every)
    names = draw.sample(range(1000), 80)
    line, ring, loop = names[:50], names[50:73], names[73]
    rows = [(a, b, a % 5 + 1) for a, b in zip(line, line[1:])] + [(a, b, 2) for a, b in zip(ring, ring[1:] + ring[:1])] + [(loop, loop, 1)]
    rows += [(names[74], names[75], 1), (names[74], names[76], 1)]  # a branch
    got = {r.edge: (r.path, r.offset) for r in substrings.compact(spark.createDataFrame(rows, "a long, b long, size int"), every).collect()}
    assert {k: got[k] for k in line} == {k: (line[0], sum(x % 5 + 1 for x in line[:i])) for i, k in enumerate(line)}
    cut = ring.index(got[ring[0]][0])
    assert {k: got[k] for k in ring} == {k: (ring[cut], 2 * i) for i, k in enumerate(ring[cut:] + ring[:cut])}
    assert got[loop] == (loop, 0) and set(got) == {*line, *ring, loop}


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeated_spans(docs).collect() == []
    docs = spark.createDataFrame([(1, "a " * 90), (2, "b")], "doc_id long, text string")
    for name in ("row", "words", "edge", "run", "anchor", "first", "size", "n", "path", "place", "edges"):
        docs = docs.withColumn(name, F.lit("x"))
    assert [r.n_removed for r in substrings.remove_repeated_spans(docs).orderBy("doc_id").collect()] == [90, 0]


def test_anchor_must_fit(spark):
    with pytest.raises(ValueError):
        substrings.remove_repeated_spans(spark.createDataFrame([], "doc_id long, text string"), width=3, anchor=4)


def written(monkeypatch):
    """Rows that each kind of staged table gets from now on."""
    rows, staged = Counter(), substrings.staged

    def counted(df, kind="stage", *rest):
        out = staged(df, kind, *rest)
        rows[kind] += out.count()
        return out

    monkeypatch.setattr(substrings, "staged", counted)
    return rows


def test_runs_with_an_anchor_of_their_own_are_not_written_again(spark, monkeypatch):
    rows = written(monkeypatch)
    docs = [(k, " ".join(f"w{k}x{i}" for i in range(200))) for k in range(20)]
    got = substrings.remove_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 20 and not any(r.n_removed for r in got)
    assert rows["windows"] == 20 and sum(rows.values()) == 20


def test_pointers_that_have_ended_are_written_once_and_rings_are_soon_found(spark, monkeypatch):
    rows = written(monkeypatch)
    line = [(i, i + 1, 1) for i in range(600)]
    ring = [(10_000 + i, 10_000 + (i + 1) % 3, 1) for i in range(3)]
    got = {r.edge: (r.path, r.offset) for r in substrings.compact(spark.createDataFrame(line + ring, "a long, b long, size int")).collect()}
    assert {k: got[k] for k in range(601)} == {k: (0, k) for k in range(601)} and len(got) == 604
    assert rows["jumps"] < 6 * 603


def test_more_rows_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SENT_ROWS", 1)
    shared = [f"s{i}" for i in range(40)]
    check(spark, [(k, " ".join([f"a{k}", *shared[k:], f"b{k}"])) for k in range(6)] + [(9, "alone " * 3), (None, None)], 7, 3)
