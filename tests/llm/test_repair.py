"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave.llm import repair
from chronoweave.llm.common import table
from chronoweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")
GOAL = re.compile(r"(s?(ua)+)?")
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def harm(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        yield conv, turn, "user" if c == 4 else role, text, 0 if c == 0 else 2 if c == 3 else 1


def search(rows):
    """Cheapest audit by states of the texts so far: (last initial or none) -> least (cost, audit)."""
    best = {"": (0, "", ())}

    def put(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way

    def inserts(ways):
        for _ in range(3):
            for state, (c, a, out) in list(ways.items()):
                new = "a" if state == "u" else "u"
                put(ways, new, (c + 2, a + "I", (*out, ("assistant" if new == "a" else "user", ""))))
        return ways

    for role, text, fault in rows:
        new = {}
        for state, (c, a, out) in inserts(best).items():
            put(new, state, (c + 3, a + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            to = "a" if state == "u" else "u"
            put(new, to, (c + 2 + more, a + "R", (*out, ("assistant" if to == "a" else "user", text))))
            if (i := role[:1]) and (state, i) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                put(new, i, (c + more, a + "K", (*out, (role, text))))
        best = new
    inserts(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])


def brute(rows):
    out, by = [], defaultdict(list)
    for conv, turn, role, text, n in rows:
        by[conv] += [(turn, role, text)] * n
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in own:
            words = WORD.findall(text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, *_ in own if t is not None]
        cost, audit, kept = search(marked)
        count = [sum(f == x for *_, f in marked) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        assert GOAL.fullmatch("".join(r[0] for r, _ in kept))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit, digest))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def odd_rows(seed=3):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "usher"], ["Yes.", "No", "", " \x0b\n", "Why?  ", None, "é! ", "a.b"]
    out = [(c, rng.choice([None, 1, 2, 3, 5, 9]), rng.choice(roles[: 3 + c % 5]), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 9))]
    return [*out, (None, None, None, None), (None, 1, "user", "x"), (10**12, 7, "user", "Hm."), *[(77, 4, "user", "Again.")] * 30, *[(78, t, "user", "Again.") for t in range(40)]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=7))
def test_matrices_find_the_least_audit(symbols):
    names = {0: ("user", "blank")} | {1 + 2 * k + c: (r, "truncated" if c else "") for k, r in enumerate(("user", "assistant", "system", "tool")) for c in (0, 1)}
    want = search([(names[x][0], str(k), names[x][1]) for k, x in enumerate(symbols)])
    start = [(0, repair.Rope()), None, None, None]
    settled, ways = repair.fold(start, symbols, repair.matrices([]))
    cost, rope = repair._closed(ways)
    assert (cost, settled + str(rope)) == want[:2]
    whole = repair.times([start], repair.of_chunk(symbols, repair.matrices([])))[0]
    cost, rope = repair._closed(whole)
    assert (cost, str(rope)) == want[:2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=9), min_size=1, max_size=5), st.lists(st.sampled_from([(0, 1), (2, 2), (0, 2), (1, 1)]), max_size=1))
def test_rules_give_back_what_they_replace(sequences, of_round):
    flat = repair.rewrite(repair._flat([bytes(s) for s in sequences]), [of_round])
    back = [y for x in flat.tolist() for y in ((of_round[x - repair.TERMINALS]) if x >= repair.TERMINALS else (x,))]
    assert back == repair._flat([bytes(s) for s in sequences]).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="DIK", max_size=3), min_size=2, max_size=6), st.lists(st.text(alphabet="DIK", max_size=3), min_size=2, max_size=6))
def test_ropes_compare_like_texts(a, b):
    def rope(parts):
        leaves = [repair.Rope(p) for p in parts]
        while len(leaves) > 1:
            leaves = [leaves[k] + leaves[k + 1] if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        return leaves[0]

    x, y, shared = rope(a), rope(b), rope(["K", "D"])
    assert (x < y, y < x, x < x) == ("".join(a) < "".join(b), "".join(b) < "".join(a), False)
    assert (shared + x < shared + y) == ("".join(a) < "".join(b)) and str(x) == "".join(a)


@pytest.mark.parametrize("chunk", [4096, 3])
def test_repair(spark, monkeypatch, chunk):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ROWS).repartition(3).withColumns({c: F.lit(7) for c in ("n", "h", "k", "part", "open", "symbols", "c", "first", "kind")})
    harmed = repair.damaged(docs)
    assert sorted((tuple(r) for r in harmed.collect()), key=str) == sorted(harm(rows), key=str)
    if chunk == 4096:
        assert rows_of(repair.repair_conversations(harmed)) == brute(harm(rows))
        assert repair.repair_conversations(repair.damaged(docs.limit(0))).count() == 0
    else:  # a conversation in many chunks and tasks
        long = [(5, t, ("user", "assistant")[t % 3 % 2], f"t{t % 7}" + ".!"[: t % 2]) for t in range(900)] + rows
        monkeypatch.setattr(repair, "CHUNK", chunk)
        assert rows_of(repair.repair_conversations(repair.damaged(spark.createDataFrame(long, ROWS)))) == brute(harm(long))


def test_grammar_is_learned_and_shared(spark):
    shapes = spark.createDataFrame([(bytearray([1, 3] * 8), 5), (bytearray([5, 1, 3]), 2), (bytearray([2] * 7), 1)], "symbols binary, n long")
    rules = repair.learn_rules(shapes)
    assert rules[0][0] == (1, 3) and (2, 2) in rules[0]
    assert len(repair.rewrite(repair._flat([bytes([1, 3] * 8)]), rules)) == 1


def test_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op11_conversation_repair"](spark, SF)) == brute(harm(rows))
