"""Packing into fixed-length sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import list_array, maybe_broadcast, slices, staged
from .encoding import encoder

#: Rows of one length (or of one group of long documents) ranked together in a task.
RANKED_TOGETHER = 512


def shortest_pack_first(counts: Mapping[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns and how many packs follow each: lengths longest first, each into the shortest packs it fits.

    Works on counts of lengths, never on documents: a group of equal packs that gets a length
    moves, as a whole or in part, to the group with that length added.
    """
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    free: list[int] = []  # ascending, the free spaces that have groups

    def put(space: int, n: int, pattern: tuple[int, ...]) -> None:
        if space not in groups:
            groups[space] = []
            bisect.insort(free, space)
        groups[space].append((n, pattern))

    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        left = counts[length]
        while left:
            if not free or free[-1] < length:
                put(capacity - length, left, (length,))
                break
            space = free[-1]
            n, pattern = groups[space].pop()
            if not groups[space]:
                del groups[space]
                free.pop()
            used = min(n, left)
            left -= used
            if n > used:
                put(space, n - used, pattern)
            put(space - length, used, (*pattern, length))
    return sorted(((n, p) for g in groups.values() for n, p in g), key=lambda x: (x[1], x[0]), reverse=True)


def token_lengths(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, doc_tokens, crcs``: ids of each whole text plus the end id, and a crc32 for each piece of ``capacity``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches):
            ids, sizes = enc.flat(batch.column(1))
            ends = np.cumsum(sizes)
            ids, sizes = np.insert(ids.astype("<u4"), ends, end_id), sizes + 1
            crcs = []
            for whole in np.split(ids, np.cumsum(sizes)[:-1]):
                crcs.append(np.array([zlib.crc32(whole[k : k + capacity].tobytes()) for k in range(0, len(whole), capacity)], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), list_array(crcs, pa.int64())], ["doc_id", "doc_tokens", "crcs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(count, "doc_id long, doc_tokens long, crcs array<long>")


def pack(lengths: DataFrame, capacity: int = 2048) -> DataFrame:
    """Place every document of ``lengths`` (``doc_id, doc_tokens``, more columns pass through) into sequences.

    A document longer than ``capacity`` is cut into full pieces, each a sequence of its own,
    and a rest. The rests' lengths are counted (at most ``capacity - 1`` rows reach the
    driver), packed as counts, and each rest finds its pack by its rank among rests of its
    length. Ranks come from a count for each (length, salt) group, a running sum over the
    groups and a window inside each, so no length's rows meet in one task.

    Returns the columns of ``lengths`` plus ``piece, start, length, sequence_id, offset``;
    documents of no tokens have no piece. Null or repeated ids are rows like any other.
    ``lengths`` is written to the shared folder once, as ranks must not change between jobs.
    """
    spark = lengths.sparkSession
    # Ids and lengths alone decide ranks; equal rows may swap places, which changes nothing.
    rows = staged(
        lengths.filter("doc_tokens > 0").withColumns(
            {"full": (F.col("doc_tokens") / capacity).cast("long"), "rest": (F.col("doc_tokens") % capacity).cast("int"), "h": F.xxhash64("doc_id", "doc_tokens")}
        ),
        "lengths",
    )
    histogram = {r["rest"]: r["n"] for r in rows.filter("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}
    patterns = shortest_pack_first(histogram, capacity)
    slots, sequence, seen = [], 0, dict.fromkeys(histogram, 0)
    for n, pattern in patterns:
        offset = 0
        for length in pattern:
            slots.append((length, seen[length], seen[length] + n, sequence - seen[length], offset))
            seen[length] += n
            offset += length
        sequence += n

    base = [c for c in rows.columns if c not in ("full", "rest", "h")]
    salts = max(1, max(histogram.values(), default=0) // RANKED_TOGETHER)
    rests = rows.filter("rest > 0").withColumn("salt", F.pmod("h", F.lit(salts)).cast("int"))
    before = _running(rests.groupBy("rest", "salt").agg(F.count("*").alias("n")), Window.partitionBy("rest").orderBy("salt"))
    inside = Window.partitionBy("rest", "salt").orderBy("h", "doc_id")
    ranked = rests.withColumn("k", F.row_number().over(inside) - 1).join(maybe_broadcast(before, 20_000), ["rest", "salt"]).withColumn("k", F.col("k") + F.col("before"))
    # As many slots as patterns have lengths: a bound set by the capacity, not by the documents.
    places = F.broadcast(spark.createDataFrame(slots, "rest int, lo long, hi long, shift long, offset long"))
    placed = ranked.join(places, (ranked["rest"] == places["rest"]) & (ranked["k"] >= places["lo"]) & (ranked["k"] < places["hi"])).select(
        *base,
        F.col("full").cast("int").alias("piece"),
        (F.col("full") * capacity).alias("start"),
        ranked["rest"].cast("long").alias("length"),
        (F.col("k") + F.col("shift")).alias("sequence_id"),
        "offset",
    )

    long = rows.filter("full > 0")
    groups = max(1, long.count() // RANKED_TOGETHER)
    long = long.withColumn("salt", F.pmod("h", F.lit(groups)).cast("int"))
    # Running sums over groups, in two levels: groups of groups first, so that no task sees them all.
    sums = long.groupBy("salt").agg(F.sum("full").alias("n")).withColumn("thousand", F.expr("salt div 1000"))
    tops = _running(sums.groupBy("thousand").agg(F.sum("n").alias("n")), Window.partitionBy(F.lit(0)).orderBy("thousand"))
    sums = _running(sums, Window.partitionBy("thousand").orderBy("salt")).join(tops.withColumnRenamed("before", "above"), "thousand")
    sums = sums.select("salt", (F.col("before") + F.col("above")).alias("before"))
    within = Window.partitionBy("salt").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = (
        long.withColumn("k", F.sum("full").over(within) - F.col("full"))
        .join(maybe_broadcast(sums, 20_000), "salt")
        .select(*base, (F.col("k") + F.col("before") + sequence).alias("first"), F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"))
        .select(*base, "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (F.col("first") + F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    return placed.unionByName(whole)


def _running(groups: DataFrame, order) -> DataFrame:
    """Rows of ``n`` with the sum of ``n`` before each."""
    total = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return groups.withColumn("before", total - F.col("n")).drop("n")


def padding(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: sequences, ids in them, and pad ids (a sequence that ends at a power of two needs none)."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    even = F.expr("bit_count(filled) = 1")
    return filled.agg(F.count("*").alias("sequences"), F.sum("filled").alias("ids"), F.sum(F.when(even, 0).otherwise(capacity - F.col("filled"))).alias("pad"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Encode and pack documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null text is empty and yields the end id alone, so every row of ``docs`` has a piece;
    an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    pieces = pack(token_lengths(docs, tokenizer, end_id, capacity), capacity)
    return pieces.select("doc_id", "start", "length", F.element_at("crcs", F.col("piece") + 1).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
