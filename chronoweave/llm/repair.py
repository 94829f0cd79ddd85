"""Conversation structure repair: least edits by dynamic programming over a Re-Pair grammar of role and fault sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

#: Rows of a conversation that one chunk holds.
CHUNK = 4096
#: Rounds of Re-Pair and rules that one round adds at most; what no rule covers is read symbol by symbol, with the same result.
ROUNDS, RULES_A_ROUND = 10, 32
#: Sequences whose repair a worker keeps.
KEPT_SEQUENCES = 1 << 14

#: States of a repaired conversation: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Symbols of rows: one that must go, then user, assistant, system and others, each whole or truncated.
GONE = 0
INITIALS = "uas"
TERMINALS = 9
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"


class Rope:
    """An audit as a tree over shared parts."""

    __slots__ = ("left", "leaf", "right")

    def __init__(self, leaf: str = "", left: Rope | None = None, right: Rope | None = None):
        self.leaf, self.left, self.right = leaf, left, right

    def __add__(self, other: Rope) -> Rope:
        if self.left is None and not self.leaf:
            return other
        if other.left is None and not other.leaf:
            return self
        return Rope("", self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.left is None:
                out.append(x.leaf)
            else:
                todo += (x.right, x.left)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """By characters; parts that both ropes share at the same place are passed over."""
        mine, theirs, a, b = [self], [other], "", ""
        while True:
            if not a and not b:
                while mine and theirs and mine[-1] is theirs[-1]:
                    mine.pop()
                    theirs.pop()
            for text, todo in ((a, mine), (b, theirs)):
                if not text and todo and (x := todo.pop()):
                    if x.left is not None:
                        todo += (x.right, x.left)
                    elif todo is mine:
                        a = x.leaf
                    else:
                        b = x.leaf
            n = min(len(a), len(b))
            if a[:n] != b[:n]:
                return a < b
            a, b = a[n:], b[n:]
            if not a and not mine:
                return bool(b or any(str(x) for x in theirs))
            if not b and not theirs:
                return False


#: Cost and audit by state before and after; None where there is no way.
Matrix = list[list[tuple[int, Rope] | None]]


def _least(ways: Iterable[tuple[int, Rope]]) -> tuple[int, Rope] | None:
    best = None
    for w in ways:
        if best is None or w[0] < best[0] or (w[0] == best[0] and w[1] < best[1]):
            best = w
    return best


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; of equal costs the least audit. Of two audits of one cost none begins with the other, so least parts make least wholes."""
    return [[_least((x[0] + y[0], x[1] + y[1]) for x, y in ((row[k], b[k][t]) for k in range(4)) if x and y) for t in range(4)] for row in a]


def _then(state: int, letter: str) -> int | None:
    """The state after a row of this initial."""
    if letter == "s":
        return SYSTEM if state == NOTHING else None
    if letter == "u":
        return None if state == USER else USER
    return ASSISTANT if state == USER else None


def _inserts() -> Matrix:
    """No, one or two inserted rows; more never pay."""
    nothing = Rope()
    out: Matrix = [[(0, nothing) if s == t else None for t in range(4)] for s in range(4)]
    for s in range(4):
        one = ASSISTANT if s == USER else USER
        out[s][one] = (INSERT, Rope("I"))
        two = ASSISTANT if one == USER else USER
        if two != s:
            out[s][two] = (2 * INSERT, Rope("II"))
    return out


INSERTS = _inserts()


def terminal(symbol: int) -> Matrix:
    """Insertions before a row, then the row's own edit."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    letter, cut = ("uas?"[(symbol - 1) // 2], (symbol - 1) % 2) if symbol else ("", 0)
    for s in range(4):
        out[s][s] = (DELETE, Rope("D"))
        if symbol == GONE:
            continue
        t = ASSISTANT if s == USER else USER
        out[s][t] = (REROLE + cut * CUT, Rope("R"))
        if letter in INITIALS and (t := _then(s, letter)) is not None:
            out[s][t] = (KEEP + cut * CUT, Rope("K"))
    return times(INSERTS, out)


def matrices(rules: list[tuple[int, int]]) -> list[Matrix]:
    """A matrix for each terminal and rule, from the bottom up."""
    out = [terminal(k) for k in range(TERMINALS)]
    for a, b in rules:
        out.append(times(out[a], out[b]))
    return out


def _pairs(flat: np.ndarray) -> np.ndarray:
    """Where a pair starts in sequences with -1 between them; of a run of one symbol every second place."""
    same = flat[1:] == flat[:-1]
    at = np.arange(len(same))
    run = at - np.maximum.accumulate(np.where(same, -1, at))
    return (flat[1:] >= 0) & (flat[:-1] >= 0) & ~(same & (run % 2 == 0))


def rewrite(flat: np.ndarray, rules: list[list[tuple[int, int]]]) -> np.ndarray:
    """Sequences (-1 between them) with each round's pairs replaced by the rules' symbols."""
    base = TERMINALS
    for of_round in rules:
        if len(flat) > 1 and of_round:
            codes = np.array([(a << 20) + b for a, b in of_round])
            order = np.argsort(codes)
            mine = (flat[:-1].astype(np.int64) << 20) + flat[1:]
            k = np.minimum(np.searchsorted(codes[order], mine), len(codes) - 1)
            hit = (codes[order][k] == mine) & _pairs(flat)
            flat = flat.copy()
            flat[:-1][hit] = base + order[k[hit]]
            stay = np.ones(len(flat), bool)
            stay[1:][hit] = False
            flat = flat[stay]
        base += len(of_round)
    return flat


def _flat(sequences: list[bytes]) -> np.ndarray:
    return np.array(bytearray(b"\xff".join(sequences)), np.uint8).view(np.int8).astype(np.int64)


def learn_rules(shapes: DataFrame, rounds: int = ROUNDS, a_round: int = RULES_A_ROUND) -> list[list[tuple[int, int]]]:
    """Re-Pair over all ``symbols`` (with ``n`` occurrences each), a batch of rules in each round.

    A round counts the adjacent pairs of all sequences in Spark and replaces the most frequent ones that cannot overlap each other (no symbol is the
    first of one and the second of another), each occurring at least twice. At most 9 + rounds * a_round symbols come to the driver's table.
    """
    rules: list[list[tuple[int, int]]] = []
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], rules=rules) -> Iterator[pa.RecordBatch]:
            total: dict[int, int] = {}
            for batch in slices(batches, 4096):
                sequences, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                flat = rewrite(_flat(sequences), rules)
                at = np.flatnonzero(_pairs(flat))
                keys, back = np.unique((flat[at] << 20) + flat[at + 1], return_inverse=True)
                weight = np.zeros(len(keys), np.int64)
                np.add.at(weight, back, n[np.cumsum(flat < 0)[at]])
                for k, w in zip(keys.tolist(), weight.tolist(), strict=True):
                    total[k] = total.get(k, 0) + w
            yield pa.RecordBatch.from_pydict({"pair": pa.array(total.keys(), pa.int64()), "n": pa.array(total.values(), pa.int64())})

        found = shapes.select("symbols", "n").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")
        chosen: list[tuple[int, int]] = []
        first: set[int] = set()
        second: set[int] = set()
        for pair, _ in found.orderBy(F.desc("n"), "pair").limit(4096).collect():
            a, b = pair >> 20, pair & 0xFFFFF
            if len(chosen) < a_round and a not in second and b not in first and (a != b or a not in first):
                chosen.append((a, b))
                first.add(a)
                second.add(b)
        if not chosen:
            break
        rules = [*rules, chosen]
    return rules


Ways = list[tuple[int, Rope] | None]


def advance(ways: Ways, matrix: Matrix, settled: list[str]) -> Ways:
    """The least ways after ``matrix``. Where all go on from one state, the audit up to there is settled, and the new ones begin after it."""
    best: Ways = [None] * 4
    came: list[int | None] = [None] * 4
    for t in range(4):
        for k in range(4):
            if ways[k] and matrix[k][t]:
                w = (ways[k][0] + matrix[k][t][0], ways[k][1] + matrix[k][t][1])
                if best[t] is None or w[0] < best[t][0] or (w[0] == best[t][0] and w[1] < best[t][1]):
                    best[t], came[t] = w, k
    if len(one := {k for k in came if k is not None}) == 1:
        k = one.pop()
        settled.append(str(ways[k][1]))
        best = [m and (ways[k][0] + m[0], m[1]) for m in matrix[k]]
    return best


def fold(ways: Ways, symbols: list[int], table: list[Matrix]) -> tuple[str, Ways]:
    """What is settled of the audit, and the ways after all symbols."""
    settled: list[str] = []
    for x in symbols:
        ways = advance(ways, table[x], settled)
    return "".join(settled), ways


def of_chunk(symbols: list[int], table: list[Matrix]) -> Matrix:
    """The matrix of a whole chunk."""
    out = []
    for s in range(4):
        settled, ways = fold([(0, Rope()) if t == s else None for t in range(4)], symbols, table)
        out.append([w and (w[0], Rope(settled) + w[1]) for w in ways])
    return out


def _closed(ways: Ways) -> tuple[int, Rope]:
    """The least way to an end: nothing, or after an assistant."""
    return _least(w for w in (times([ways], INSERTS)[0][s] for s in (NOTHING, ASSISTANT)) if w)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, n`` after the damage: ``n`` adjacent rows of each, 0 where the row is dropped. Null roles and texts are one space."""
    rows = rows.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("c", F.crc32(F.encode(name, "utf-8")) % 20)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("c") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("c") == 0, 0).when(F.col("c") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _chunks(skeleton: DataFrame) -> DataFrame:
    """Conversations in order of their rows, cut into chunks; a chunk is ``open`` where others may belong to its conversation."""
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "h"]
    parts = int(skeleton.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = skeleton.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "kind", "first", "n")
    names = ["conv_id", "part", "k", "open", "symbols", "turn_min", "turn_max", "turn_first", "turn_last", "turns", "blank", "duplicate", "truncated", "illegal", "initial_first", "initial_last"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), *[pa.int64()] * 9, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, begun, out = TaskContext.get().partitionId(), 0, False, []
        chunk: dict = {}
        none = object()
        conv = none

        def fresh() -> dict:
            return dict.fromkeys(names, 0) | {"symbols": bytearray(), "initial_first": None, "initial_last": None, "turn_min": None, "turn_max": None, "turn_first": None, "turn_last": None}

        def close(opened: bool) -> None:
            nonlocal k, chunk
            out.append(chunk | {"conv_id": conv, "part": part, "k": k, "open": opened, "symbols": bytes(chunk["symbols"])})
            k, chunk = k + 1, fresh()

        def flushed() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in zip(names, kinds, strict=True)], names=names)
            out.clear()
            return done

        for batch in slices(batches, 4096):
            for c, turn, initial, kind, first, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv or conv is none:
                    if conv is not none:
                        close(begun or k == 0)
                        begun = False
                    conv, chunk = c, fresh()
                at = 0
                while at < n:
                    if len(chunk["symbols"]) >= CHUNK:
                        close(True)
                        begun = True
                    more = min(n - at, CHUNK - len(chunk["symbols"]))
                    if kind == 2:
                        chunk["blank"] += more
                        chunk["symbols"] += bytes(more)
                    elif first and at == 0:
                        more = 1
                        chunk["truncated"] += kind
                        chunk["symbols"].append(1 + 2 * ("uas".index(initial) if initial and initial in "uas" else 3) + kind)
                    else:
                        chunk["duplicate"] += more
                        chunk["symbols"] += bytes(more)
                    if chunk["initial_last"] is not None:
                        chunk["illegal"] += chunk["initial_last"] + initial not in LEGAL
                    else:
                        chunk["initial_first"] = initial
                        chunk["turn_first"] = turn
                    chunk["illegal"] += (more - 1) * (initial + initial not in LEGAL)
                    chunk["initial_last"] = initial
                    if turn is not None and (chunk["turn_last"] != turn or chunk["turns"] == 0):
                        chunk["turns"] += 1
                        chunk["turn_min"] = turn if chunk["turn_min"] is None else chunk["turn_min"]
                        chunk["turn_max"] = turn
                    chunk["turn_last"] = turn
                    at += more
            if len(out) >= 1024:
                yield flushed()
        if conv is not none:
            close(True)
        yield flushed()

    schema = "conv_id long, part long, k long, open boolean, symbols binary, turn_min long, turn_max long, turn_first long, turn_last long, turns long, blank long, duplicate long, truncated long, illegal long, initial_first string, initial_last string"
    return rows.mapInArrow(run, schema)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _result(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[c] for r in rows], pa.int64()) for c in ("conv_id", *_COUNTS)] + [pa.array([r["audit"] for r in rows], pa.string())], names=["conv_id", *_COUNTS, "audit"]
    )


def _solved(chunks: DataFrame, rules: list[list[tuple[int, int]]]) -> DataFrame:
    """Least edits of every conversation."""
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast((rules, matrices([r for of_round in rules for r in of_round])))  # bounded by the number of rules
    start = [(0, Rope()), None, None, None]

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, table = sent.value
        known: dict[bytes, tuple[int, str]] = {}
        for batch in slices(batches, 4096):
            rows = batch.to_pylist()
            if len(known) > KEPT_SEQUENCES:
                known.clear()
            if new := list({r["symbols"] for r in rows} - known.keys()):
                flat = rewrite(_flat(new), rules)
                for s, symbols in zip(new, np.split(flat, np.flatnonzero(flat < 0)), strict=True):
                    settled, ways = fold(start, symbols[symbols >= 0].tolist(), table)
                    cost, rope = _closed(ways)
                    known[s] = (cost, settled + str(rope))
            for r in rows:
                r["cost"], r["audit"] = known[r["symbols"]]
                r["gaps"] = r["turn_max"] - r["turn_min"] + 1 - r["turns"] if r["turns"] else 0
            yield _result(rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, table = sent.value
        last, ways, prefix = None, start, []

        def ended() -> pa.RecordBatch:
            cost, rope = _closed(ways)
            gaps = last["turn_max"] - last["turn_min"] + 1 - last["turns"] if last["turns"] else 0
            return _result([last | {"gaps": gaps, "cost": cost, "audit": "".join([*prefix, str(rope)])}])

        for batch in slices(batches, 256):
            for r in batch.to_pylist():
                if last is not None and last["conv_id"] != r["conv_id"]:
                    yield ended()
                    last, ways, prefix = None, start, []
                ways = advance(ways, of_chunk(rewrite(_flat([r["symbols"]]), rules).tolist(), table), prefix)
                if last is not None:
                    for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                        r[c] += last[c]
                    if last["initial_last"] is not None and r["initial_first"] is not None:
                        r["illegal"] += last["initial_last"] + r["initial_first"] not in LEGAL
                    if last["turn_last"] is not None and last["turn_last"] == r["turn_first"]:
                        r["turns"] -= 1
                    if r["initial_first"] is None:
                        r |= {c: last[c] for c in ("initial_last", "turn_last")}
                    low, high = (last["turn_min"], r["turn_min"]), (last["turn_max"], r["turn_max"])
                    r["turn_min"] = min((x for x in low if x is not None), default=None)
                    r["turn_max"] = max((x for x in high if x is not None), default=None)
                last = r
        if last is not None:
            yield ended()

    whole = chunks.filter(~F.col("open")).mapInArrow(closed, _RESULT)
    pieces = chunks.filter("open").repartition("conv_id").sortWithinPartitions("conv_id", "part", "k").mapInArrow(joined, _RESULT)
    return whole.unionByName(pieces)


def _hashed(rows: DataFrame, results: DataFrame) -> DataFrame:
    """``repaired_sha256`` beside the results: a conversation's rows pass by in order, none is held."""
    names = ["conv_id", *_COUNTS, "audit", "role", "text", "n"]
    heads = results.select(*names[:8], F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("n"), F.unhex(F.lit("")).alias("h"))
    body = rows.filter("n > 0").select("conv_id", *(F.lit(None).cast("long").alias(c) for c in _COUNTS), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "n", _digest("text").alias("h"))
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", F.col("n").isNotNull(), F.asc_nulls_first("turn"), "role", "h").select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        head: dict | None = None
        at, before, sha, empty = 0, "", hashlib.sha256(), True

        def put(role: str, text: str) -> None:
            nonlocal before, empty
            sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            before, empty = role[0], False

        def inserts() -> None:
            nonlocal at
            while at < len(head["audit"]) and head["audit"][at] == "I":
                put("assistant" if before == "u" else "user", "")
                at += 1

        def end() -> None:
            inserts()
            done.append(head | {"repaired_sha256": sha.hexdigest()})

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([*_result(done).columns, pa.array([r["repaired_sha256"] for r in done], pa.string())], names=[*names[:8], "repaired_sha256"])
            done.clear()
            return out

        for batch in slices(batches, 1024):
            for r in batch.to_pylist():
                if r["n"] is None:
                    if head is not None:
                        end()
                    head, at, before, sha, empty = r, 0, "", hashlib.sha256(), True
                    continue
                for _ in range(r["n"]):
                    inserts()
                    edit = head["audit"][at]
                    at += 1
                    if edit == "K":
                        put(r["role"], r["text"])
                    elif edit == "R":
                        put("assistant" if before == "u" else "user", r["text"])
            if len(done) >= 1024:
                yield flushed()
        if head is not None:
            end()
        yield flushed()

    return both.mapInArrow(run, f"{_RESULT}, repaired_sha256 string")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of every conversation of ``conv_id, turn, role, text, n`` (see ``damaged``; ``n`` adjacent rows of each, 0 for none).

    Rows stand by turn, nulls first; those of one turn by role, then by the SHA-256 of their text. Returns ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``.

    Rows of a conversation are ordered by a range partitioning, so a long one lies in several tasks: chunks of at most ``CHUNK`` symbols, of which each
    gives a matrix and only these meet. Rules of the grammar are learned on all distinct chunks and evaluated once. Only the digest of the repaired text,
    which SHA-256 makes from the first byte to the last, reads one conversation in one task, row by row.

    A null conv_id is a conversation of its own. Identical rows are summed before they move; all but the first count as duplicates. Conversations without rows:
    zeros, an empty audit, the digest of the empty string. Other columns are not read. An empty table gives no rows.
    """
    rest = F.rtrim(F.col("text"), F.lit(WHITE))
    d = rows.select(
        "conv_id", F.when(F.col("n") > 0, F.col("turn")).alias("turn"), F.when(F.col("n") > 0, F.col("role")).otherwise("").alias("role"),
        F.when(F.col("n") > 0, _digest("text")).otherwise(F.unhex(F.lit(""))).alias("h"),
        F.when(rest == "", 2).when(F.substring(rest, -1, 1).isin(".", "!", "?"), 0).otherwise(1).alias("kind"), "n",
    )
    firsts = d.filter("n > 0").groupBy("conv_id", "role", "h").agg(F.min("turn").alias("t"), F.max(F.col("turn").isNull().cast("int")).alias("none"))
    firsts = firsts.select("conv_id", F.when(F.col("none") == 0, F.col("t")).alias("turn"), "role", "h", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("first"))
    skeleton = d.withColumn("first", F.lit(0)).unionByName(firsts).groupBy("conv_id", "turn", "role", "h").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"), F.max("first").alias("first"))
    chunks = staged(_chunks(staged(skeleton, "skeleton")), "chunks")
    shapes = staged(chunks.groupBy("symbols").agg(F.count("*").alias("n")), "shapes")
    return _hashed(rows, _solved(chunks, learn_rules(shapes)))
