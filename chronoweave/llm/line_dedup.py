"""Line dedup by pairwise patience diff: aligned common blocks go from the later document."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_least, join_counted, slices, staged

#: Characters that an aligned block must have to go.
BLOCK_CHARS = 120
#: Changed documents and lines of theirs up to which what goes is broadcast.
BROADCAST_DOCS, BROADCAST_LINES = 100_000, 2_000_000
#: Items that an alignment reads for each line of both documents; what it has not matched by then is found by runs.
WORK = 16
# Runs of lines are named by a polynomial of their lines' hashes.
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)


def patience(a: Sequence[int], b: Sequence[int], work: int | None = None) -> list[tuple[int, int]]:
    """Matched positions of two sequences, increasing in both.

    In each range: the common head and tail match; items that are unique in both ranges match
    along their longest increasing run of positions; the gaps between are ranges again. A range without such items
    is left unmatched, as are those that stand open when ``work`` items (by default a multiple of both lengths) were read.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    left = WORK * (len(a) + len(b)) if work is None else work
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i >= j or k >= m or left <= 0:
            continue
        left -= j - i + m - k
        once = Counter(a[i:j])
        there = Counter(b[k:m])
        at = {x: p for p, x in enumerate(b[k:m], k) if there[x] == 1 and once.get(x) == 1}
        pairs = [(p, at[x]) for p, x in enumerate(a[i:j], i) if x in at]
        if not pairs:
            continue
        tails: list[int] = []
        last: list[int] = []
        back = [-1] * len(pairs)
        for n, (_, q) in enumerate(pairs):
            t = bisect_left(tails, q)
            if t == len(tails):
                tails.append(q)
                last.append(n)
            else:
                tails[t], last[t] = q, n
            back[n] = last[t - 1] if t else -1
        run, n = [], last[-1]
        while n >= 0:
            run.append(pairs[n])
            n = back[n]
        for p, q in reversed(run):
            todo.append((i, p, k, q))
            found.append((p, q))
            i, k = p + 1, q + 1
        todo.append((i, j, k, m))
    return sorted(found)


def least_runs(hashes: Sequence[int], sizes: Sequence[int], least: int) -> list[tuple[int, int, int]]:
    """``from, to, key`` of every shortest run of consecutive items that reaches ``least`` in size, from each start and to each end.

    Each item of a stretch of at least that size lies in such a run that the stretch contains, so two sequences have a
    stretch in common where, and only where, they have runs of equal keys.
    """
    n = len(hashes)
    sums, power, through = [0], [1], [0]
    for h, size in zip(hashes, sizes, strict=True):
        through.append(through[-1] + size)
        sums.append((sums[-1] * _BASE + h % _PRIME + 1) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    runs, e, s = set(), 0, 0
    for k in range(n):
        while e < n and through[e] - through[k] < least:
            e += 1
        if through[e] - through[k] >= least:
            runs.add((k, e))
        while through[k + 1] - through[s + 1] >= least:
            s += 1
        if through[k + 1] - through[s] >= least:
            runs.add((s, k + 1))
    return [(s, e, (sums[e] - sums[s] * power[e - s]) % _PRIME) for s, e in sorted(runs)]


def common_blocks(a: Sequence[int], b: Sequence[int], sizes: Sequence[int], least: int) -> list[tuple[int, int]]:
    """Ranges ``[from, to)`` of ``b``, in order and apart, that stand as consecutive items in ``a``, each in stretches of at least ``least`` in size.

    The sequences are aligned once. A block that moved, stands several times or was matched at different places of ``a``
    is found by its runs, which are looked up among those of ``a``; so the time is that of the alignment and linear beyond.
    """
    there, out = set(a), []
    start = end = 0
    before = -1
    for p, q in [*patience(a, b), (-1, -1)]:
        if p != before + 1 or q != end:
            if end > start and sum(sizes[start:end]) >= least:
                out.append((start, end))
            start = q
        before, end = p, q + 1
    covered = bytearray(len(b))
    for s, e in out:
        covered[s:e] = b"\1" * (e - s)
    rest = [0, *accumulate(x in there and not c for x, c in zip(b, covered, strict=True))]
    shared = [0, *accumulate(x in there for x in b)]
    if rest[-1] and (left := [(s, e, k) for s, e, k in least_runs(b, sizes, least) if shared[e] - shared[s] == e - s and rest[e] > rest[s]]):
        size_of = dict(zip(b, sizes, strict=True))
        known = {k for _, _, k in least_runs(a, [size_of.get(x, least) for x in a], least)}
        out += [(s, e) for s, e, k in left if k in known]
    apart: list[tuple[int, int]] = []
    for s, e in sorted(out):
        if apart and s <= apart[-1][1]:
            apart[-1] = (apart[-1][0], max(e, apart[-1][1]))
        else:
            apart.append((s, e))
    return apart


def aligned(pairs: DataFrame, least: int) -> DataFrame:
    """``doc, th, gone``: lines of the later document that lie in aligned blocks, per pair."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            gone = []
            for a, b, sizes in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                gone.append([p for s, e in common_blocks(a, b, sizes, least) for p in range(s, e)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["doc", "th", "gone"])

    return pairs.mapInArrow(align, "doc long, th long, gone array<int>").filter("size(gone) > 0")


def _runs(lines: DataFrame, least: int) -> DataFrame:
    """``who, h``: the distinct keys of each document's least runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [list({k for _, _, k in least_runs(hs, ls, least)}) for hs, ls in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["doc", "th", "keys"])

    each = lines.select("doc", "th", "hs", "ls").mapInArrow(run, "doc long, th long, keys array<long>")
    return each.select(F.struct("doc", "th").alias("who"), F.explode("keys").alias("h"))


def _paired(each: DataFrame) -> DataFrame:
    """``a, b``: each holder of a run beside the run's first holder."""
    known = staged(each.groupBy("h").agg(F.min("who").alias("a"), F.count("*").alias("df")).filter("df > 1"), "firsts")
    met = join_counted(each, known, "h", "df", each.count())
    return met.filter("who <> a").select("a", F.col("who").alias("b")).distinct()


def _free(name: str, taken: Sequence[str]) -> str:
    """A name like ``name`` that no column of ``taken`` has, whatever its case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def drop_repeated_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated blocks cut from ``text_col``, plus ``n_lines`` and ``n_removed`` (ints).

    Documents are ordered by (id, hash of the text). Lines are compared trimmed. A single line may be common; what is rare
    is a run of consecutive lines that just reaches ``block_chars`` characters, short lines included, which is
    named by a hash of its lines' hashes. Each holder of such a run is aligned with the run's first holder, so that every
    line of a block which any earlier document holds is in a run whose first holder is met, for at most two pairs
    a line; a passage copied everywhere makes as many pairs as it has copies. Aligned blocks of
    at least ``block_chars`` characters go from the later document, judged on original texts; so a block of that size
    stays in the first document that has it alone.

    Null texts stay null with 0 lines; an empty text has one line and loses none. Null ids
    are neither compared nor changed. Equal rows (same id and text) count as one document and
    change alike. Existing ``n_lines``/``n_removed`` columns are replaced.
    """
    own_doc, own_th, own_gone = (_free(c, docs.columns) for c in ("doc", "th", "gone"))
    keyed = docs.withColumn(own_th, F.xxhash64(text_col)).withColumn(own_doc, F.col(id_col).cast("long"))
    trimmed = F.transform(F.split(F.col(text_col), "\n", -1), lambda line: F.trim(line))
    lines = staged(
        keyed.filter(F.col(own_doc).isNotNull() & (F.length(text_col) >= block_chars))
        .select(F.col(own_doc).alias("doc"), F.col(own_th).alias("th"), trimmed.alias("l"))
        .select("doc", "th", F.transform("l", lambda x: F.xxhash64(x)).alias("hs"), F.transform("l", lambda x: F.length(x)).alias("ls"))
        .dropDuplicates(["doc", "th"]),
        "lines",
    )
    pairs = staged(_paired(staged(_runs(lines, block_chars), "runs")), "pairs")

    # The lines of a document that very many meet are dealt to several tasks.
    often = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > hot_least(pairs.count()))
    hot = F.broadcast(often.select("a", F.ceil(F.col("n") / 1000).cast("int").alias("parts")))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    first = lines.select(F.struct("doc", "th").alias("a"), F.col("hs").alias("ahs")).join(hot, "a", "left")
    first = first.select("a", "ahs", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    later = lines.select(F.struct("doc", "th").alias("b"), "hs", "ls")
    both = dealt.join(first, ["a", "part"]).join(later, "b").select("b.doc", "b.th", "ahs", "hs", "ls")
    found = aligned(both, block_chars).select("doc", "th", F.explode("gone").alias("at"))
    gone = staged(found.groupBy("doc", "th").agg(F.collect_set("at").alias("gone")), "gone")

    size = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    gone = gone.select(F.col("doc").alias(own_doc), F.col("th").alias(own_th), F.col("gone").alias(own_gone))
    if size[0] <= BROADCAST_DOCS and size[1] <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    split = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(split, lambda line, at: ~F.array_contains(F.col(own_gone), at)), "\n")
    return (
        keyed.join(gone, [own_doc, own_th], "left")
        .withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)))
        .withColumn("n_removed", F.when(F.col(own_gone).isNull(), 0).otherwise(F.size(own_gone)))
        .withColumn(text_col, F.when(F.col(own_gone).isNull(), F.col(text_col)).otherwise(left))
        .select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
    )
