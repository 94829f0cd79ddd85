"""Cross-tokenizer alignment against a plain reading of its rules."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave.llm import align
from chronoweave.llm.common import table
from chronoweave.llm.queries import QUERIES, tokenizer_path

SF, PIECES = "/root/testdata/sf0.001", public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a  b ", "x<|endoftext|> y <s> <unk> </s>", "▁ a▁b", "é ß 漢字 \x00 don't 12 ½ 😀", "a\n\nb\tc \r\n d", "word", "word", "a b " * 3000, "   x", "ﬁ é …"]


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECES)


def tokens(models, text):
    a, b = models
    if not text:
        return None
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    byte = {(chr(k) if k in plain else chr(next(spare))): k for k in range(256)}
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
    tb = [bytes([int(p[3:5], 16)]) if (p := b.id_to_piece(i)).startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for i in ib]
    want = (" " + text).encode()
    return (ia, ta, ib, tb) if b"".join(ta) == want == b"".join(tb) else None


def brute(models, texts):
    """Overlaps of all pairs of byte ranges, groups at common ends."""
    docs, counts = [], Counter()
    for text in texts:
        if not (t := tokens(models, text)):
            docs.append(None)
            continue
        ia, ta, ib, tb = t
        ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        links, lo = [], 0
        for i, e in enumerate(ea):
            s = e - len(ta[i])
            while eb[lo] <= s:
                lo += 1
            j = lo
            while j < len(eb) and eb[j] - len(tb[j]) < e:
                links.append((ia[i], ib[j]))
                j += 1
        groups, x, y = [], 0, 0
        for c in sorted(set(ea) & set(eb)):
            nx, ny = ea.index(c, x) + 1, eb.index(c, y) + 1
            groups.append(",".join(map(str, ia[x:nx])) + "|" + ",".join(map(str, ib[y:ny])))
            x, y = nx, ny
        counts.update(links)
        docs.append((len(ia), len(ib), groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None else
        (d[0], d[1], len(d[2]), len(d[3]), sum(counts[p] == best[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest())
        for d in docs
    ]


def rows_of(df):
    return sorted(((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@pytest.fixture(scope="module")
def both():
    return align.Aligner(tokenizer_path(), PIECES)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=st.sampled_from(list("ab ,.<|s>é\n\t▁漢😀5'")), max_size=60)))
def test_pieces_are_the_library(both, models, text):
    if text and "▁" not in text:
        assert both.b.encode(" " + text).tolist() == models[1].encode(text)
        ids, _ = both.a.flat(pa.array([" " + text]))
        assert ids.tolist() == models[0].encode(" " + text, add_special_tokens=False).ids


def test_store_of_units_starts_anew(models):
    few = align.Pieces(PIECES, kept=2)
    for text in ("a b c d", "d e f", "a b g  ", " "):
        assert few.encode(" " + text).tolist() == models[1].encode(text)


@pytest.mark.parametrize("lane", [1, 3, 1000])
def test_lanes_do_not_matter(lane):
    rng = np.random.default_rng(5)
    total = [40, 1, 300, 7]
    ends = lambda p: np.flatnonzero((rng.random(sum(total)) < p) | np.isin(np.arange(1, sum(total) + 1), np.cumsum(total))) + 1
    a, b = ends(0.4), ends(0.6)
    starts = np.searchsorted(a, np.cumsum([0, *total[:-1]]), "right")
    i, j, ca, cb = align.merge(a, b, starts, lane)
    want = [(x, y) for x in range(len(a)) for y in range(len(b)) if max(a[x - 1] if x else 0, b[y - 1] if y else 0) < min(a[x], b[y])]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert set(a[ca]) == set(b[cb]) == set(a) & set(b)


@pytest.mark.parametrize(("frequent", "at_once"), [(align.FREQUENT, align.AT_ONCE), (0, 300), (60, 40)])
def test_alignment(spark, models, frequent, at_once):
    docs = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(ODD)], "doc_id long, text string").withColumns({c: F.lit(7) for c in ("row", "pair", "links", "n", "b", "rare")})
    want = sorted(((k if k else -1, *w) for k, w in enumerate(brute(models, ODD))), key=str)
    assert rows_of(align.align_tokens(docs, tokenizer_path(), PIECES, frequent=frequent, at_once=at_once)) == want
    assert align.align_tokens(docs.limit(0), tokenizer_path(), PIECES).count() == 0


def test_query(spark, models):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    want = sorted(((i, *w) for (i, _), w in zip(docs, brute(models, [t for _, t in docs]), strict=True)), key=str)
    assert rows_of(QUERIES["op13_token_alignment"](spark, SF)) == want
