"""Document fingerprints by winnowing."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices

#: Characters in a gram, and grams in a window: any match of GRAM + WINDOW - 1 characters shares a fingerprint.
GRAM, WINDOW = 20, 40

_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and ``B**-i`` modulo 2**64 for i < n (B is odd)."""
    up, down = np.full(n, _B, np.uint64), np.full(n, pow(_B, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def rolling_hashes(text: str, gram: int = GRAM) -> np.ndarray:
    """One 64-bit hash per run of ``gram`` code points; one for the whole of a shorter text, none for an empty one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return points
    size = 1 << max(12, int(len(points)).bit_length())
    up, down = _powers(size)
    k = min(gram, len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * up[: len(points)], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * down[: len(points) - k + 1])


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions chosen: the least hash of each window, the rightmost of equals; all grams are one window if fewer."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    w = min(window, n)
    at, width = np.arange(n), 1
    while width < w:
        step = min(width, w - width)
        left, right = at[:-step], at[step:]
        at = np.where(hashes[right] <= hashes[left], right, left)
        width += step
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def fingerprint(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, in page order."""
    hashes = rolling_hashes(text, gram)
    chosen = winnow(hashes, window)
    return hashes[chosen], chosen


def written(prints: tuple[np.ndarray, np.ndarray]) -> str:
    """``hash@position`` for each chosen gram (16 hex digits, decimal position), by spaces; empty for an empty text."""
    return " ".join(f"{h:016x}@{p}" for h, p in zip(prints[0].tolist(), prints[1].tolist(), strict=True))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Shared distinct hashes over those of the larger set; 1 for two empty sets, 0 for one."""
    x, y = np.unique(x), np.unique(y)
    most = max(len(x), len(y))
    return len(np.intersect1d(x, y, assume_unique=True)) / most if most else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_chars, hashes, positions`` for every row; null texts count as empty and have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = [fingerprint(t, gram, window) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([h.view(np.int64) for h, _ in prints], pa.list_(pa.int64())),
                    pa.array([p for _, p in prints], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_chars", "hashes", "positions"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_chars long, hashes array<long>, positions array<long>")


def compared_with_edit_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document.

    The edit replaces the last quarter (rounded down, in code points) by the first as many, or all, of the next
    document by (id, text), the first one after the last. Documents are dealt into many
    ranges of ids; each range also gets the first document of the next one, so the
    texts move once and no sort spans the table.

    Null texts are empty; null ids come first; repeated ids follow each other by text; a table
    of one row is its own next. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.filter("i is not null").approxQuantile("i", [k / ranges for k in range(1, ranges)], 0.25 / ranges)))
    # 0 for null ids and those below the first cut; a cut opens its range.
    rows = rows.withColumn("part", _part_of([int(c) for c in cuts]))

    # The least id of each range: as many rows as ranges.
    found = sorted((r["part"], r["i"], r["null"]) for r in rows.groupBy("part").agg(F.coalesce(F.min("i"), F.lit(0)).alias("i"), F.max(F.col("i").isNull()).alias("null")).collect())
    if not found:
        return spark.createDataFrame([], _SCHEMA)
    heads = [(q, none, i, p) for (p, _, _), (q, i, none) in zip(found, found[1:] + found[:1], strict=True)]
    heads = F.broadcast(spark.createDataFrame(heads, "part int, none boolean, i long, into int"))
    first = rows.alias("r").join(heads.alias("h"), (F.col("r.part") == F.col("h.part")) & F.when(F.col("h.none"), F.col("r.i").isNull()).otherwise(F.col("r.i") == F.col("h.i")))
    first = first.groupBy("h.into").agg(F.min("r.t").alias("t")).select(F.lit(None).cast("long").alias("i"), "t", F.col("into").alias("part"), F.lit(True).alias("head"))
    dealt = rows.withColumn("head", F.lit(False)).unionByName(first)
    dealt = dealt.repartition(ranges, "part").sortWithinPartitions("part", "head", F.asc_nulls_first("i"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (id, text, fingerprint) of the row that waits for the next text
        for batch in slices(batches):
            out = []
            for i, text, head in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                prints = fingerprint(text, gram, window)
                if held is not None:
                    out.append(_compare(*held, text, prints, gram, window))
                held = None if head else (i, text, prints)
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return dealt.select("i", "t", "part", "head").mapInArrow(run, _SCHEMA)


def _part_of(cuts: list[int]):
    """The number of cuts at or below the id, by a binary search written as nested conditions."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if(i < {cuts[mid]}L, {tree(lo, mid)}, {tree(mid + 1, hi)})"

    return F.expr(f"if(i is null, 0, {tree(0, len(cuts))})")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compare(i: int | None, text: str, prints: tuple, following: str, following_prints: tuple, gram: int, window: int) -> dict:
    cut = len(text) // 4
    edited = text[: len(text) - cut] + following[:cut]
    edited_prints = fingerprint(edited, gram, window)
    return {
        "doc_id": i,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": written(prints),
        "edited_fingerprint": written(edited_prints),
        "near_edited": likeness(prints[0], edited_prints[0]),
        "near_next": likeness(prints[0], following_prints[0]),
    }
