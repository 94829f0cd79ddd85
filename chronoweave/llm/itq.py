"""Embedding near duplicates: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, list_array, ship, slices, staged
from .components import components

#: Rows on which rotations are learned, and numbers they may hold together.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 4_000_000
TABLES = 8
#: Bits of a key at most; beyond 24 each further bit adds a table.
MOST_KEY_BITS = 30
#: Members of a ball compared as one block.
BLOCK = 256
#: Rounds of taking a bucket's least vector as centre of those close to it.
BALL_ROUNDS = 3


@dataclass(frozen=True)
class Codes:
    """Centre and rotations; ``bits`` code bits in ``tables`` keys of ``bits // tables`` each."""

    mean: np.ndarray
    rotation: np.ndarray
    tables: int
    bits: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.rotation

    def keys(self, m: np.ndarray) -> np.ndarray:
        s = self.bits // self.tables
        return (m > 0).reshape(len(m), self.tables, s) @ (1 << np.arange(s))

    def packed(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first 128 bits as two integers."""
        bits = np.zeros((len(m), 128), np.uint8)
        bits[:, : min(128, self.bits)] = m[:, :128] > 0
        words = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
        return words[:, 0], words[:, 1]

    def probes(self, m: np.ndarray, count: int, low: int = 8) -> np.ndarray:
        """For each table the ``count`` keys nearest to the vector: the own one, then with its least certain bits turned."""
        s = self.bits // self.tables
        low = min(low, s)
        subsets = np.array(list(itertools.product([0, 1], repeat=low)))
        count = min(count, len(subsets))
        own = self.keys(m)
        out = np.empty((len(m), self.tables, count), np.int64)
        for t in range(self.tables):
            part = m[:, t * s : (t + 1) * s]
            order = np.argsort(np.abs(part), axis=1, kind="stable")[:, :low]
            cost = np.take_along_axis(part**2, order, 1) @ subsets.T
            best = np.argsort(cost, axis=1, kind="stable")[:, :count]
            out[:, t] = own[:, t, None] ^ np.take_along_axis((1 << order) @ subsets.T, best, 1)
        return out


def learn(sample: np.ndarray, tables: int, key_bits: int, rounds: int = 40, seed: int = 3) -> Codes:
    """Rotations by iterative quantisation of unit vectors.

    The sample is centred and turned to its principal axes; then signs and the rotation that
    best maps the axes to the signs (a Procrustes step) alternate. A code longer
    than the dimension takes several rotations from different random starts.
    """
    dim, bits = sample.shape[1], tables * key_bits
    mean = sample.mean(axis=0)
    centred = sample - mean
    values, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, np.argsort(-values, kind="stable")]
    found, rng = [], np.random.default_rng(seed)
    while sum(r.shape[1] for r in found) < bits:
        width = min(dim, bits)
        v = centred @ axes[:, :width]
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds):
            signs = np.where(v @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(v.T @ signs)
            turn = left @ right
        found.append(axes[:, :width] @ turn)
    return Codes(mean, np.hstack(found)[:, :bits], tables, bits)


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs_of(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(unit([np.frombuffer(b, "<f8") for b in batch.column(c).to_pylist()]) for c in (k, k + 1))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, key_bits: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    1. Equal vectors become one with a weight. 2. Rotations are learned on at most ``SAMPLE_ROWS`` of them (least hash of
    the id); a key has about log2 of the number of vectors as bits, so buckets stay small at any
    size. 3. Vectors within half the link angle of a bucket's least vector form a
    ball around it: any two in a ball are links, without a comparison. 4. Balls
    (most of one vector) meet where one's key is among the probes of the other, if their centres'
    codes are near enough; then the centres' cosine in double precision decides: all their members
    are links, none are, or blocks of members are multiplied and each pair judged.
    So a group of near copies costs work by its size, not by its pairs, and every pair found
    is counted exactly.

    Only vectors of one length are compared; each length has tables of its own (one pass over steps 2 to 4 a length).
    Null, empty, zero and non-finite vectors, vectors with null components, and rows without id link with nothing
    (``n_links`` 0, own component; a null id has none and isn't kept). Vectors, not ids, are compared: rows of one id
    with several vectors each have their own links and may have different components.
    An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.expr("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("digest", F.struct(F.xxhash64("v"), F.hash("v")))
    members = staged(rows.select("vec_id", "fine", "digest"), "members")
    reps = rows.filter("fine").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"), F.first("v").alias("v"))
    # A vector's number is fixed by being written; several vectors may share an id.
    reps = staged(reps.withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")

    found = reps.select("id", (F.col("w") - 1).alias("n_links"), F.col("id").alias("of")).limit(0)
    for dim, n in sorted(tuple(r) for r in reps.groupBy("dim").count().filter("count > 1").collect()):
        found = found.unionByName(_linked(reps.filter(F.col("dim") == dim).select("id", "w", "v"), n, dim, cosine, tables, key_bits))
    linked = reps.select("id", "digest", "least", "w").join(staged(found, "found"), "id", "left")
    linked = linked.select("digest", "least", F.coalesce("n_links", F.col("w") - 1).alias("n_links"), F.coalesce("of", "id").alias("of"))
    heads = linked.groupBy("of").agg(F.min("least").alias("component_id"))
    by_digest = linked.join(heads, "of").drop("of", "least")
    out = members.withColumn("digest", F.when(F.col("fine"), F.col("digest"))).join(by_digest, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(reps: DataFrame, n: int, dim: int, cosine: float, tables: int, key_bits: int | None) -> DataFrame:
    """``id, n_links, of`` (least number reachable) of the ``n`` distinct vectors ``id, w, v`` of length ``dim``."""
    spark = reps.sparkSession
    link, half = math.acos(cosine), math.acos(cosine) / 2 - 1e-9
    s = key_bits or min(MOST_KEY_BITS, max(8, math.ceil(math.log2(n + 1))))
    tables += max(0, s - 24)
    some = reps.select("id").orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim)))
    sample = reps.join(F.broadcast(some), "id").select("id", "v").collect()
    codes = learn(unit([r["v"] for r in sorted(sample)]), tables, s)
    probes = max(8, 2 * s - 16)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            if batch.num_rows:
                m = codes.margins(unit(batch.column(1).to_pylist()))
                raw = [np.array(v, "<f8").tobytes() for v in batch.column(1).to_pylist()]
                one, two = codes.packed(m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(one), pa.array(two), list_array(list(codes.keys(m)), pa.int32()), list_array(list(codes.probes(m, probes).reshape(len(m), -1)), pa.int32()), batch.column(2), pa.array(raw, pa.binary())],
                    ["id", "c1", "c2", "keys", "probes", "w", "x"],
                )

    coded = staged(reps.select("id", "v", "w").mapInArrow(encode, "id long, c1 long, c2 long, keys array<int>, probes array<int>, w long, x binary"), "codes")
    bits = min(128, codes.bits)
    away = "bit_count(c1 ^ d1) + bit_count(c2 ^ d2)"

    def limit(angle: str) -> str:
        p = f"least(0.5, ({angle}) / {math.pi})"
        return f"{bits} * {p} + 4.5 * sqrt({bits} * {p} * (1 - {p}))"

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            if batch.num_rows:
                x, y = _pairs_of(batch, 2)
                cos = np.einsum("ij,ij->i", x, y)
                # The angle from the chord is exact for near vectors too; the cosine decides single pairs.
                angle = 2 * np.arcsin(np.minimum(1, np.linalg.norm(x - y, axis=1) / 2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cos), pa.array(angle)], ["a", "b", "cosine", "angle"])

    def measured(pairs: DataFrame) -> DataFrame:
        x = coded.select(F.col("id").alias("a"), F.col("x"))
        y = coded.select(F.col("id").alias("b"), F.col("x").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(angles, "a long, b long, cosine double, angle double")

    # Balls.
    balls, left = None, coded.select("id", "c1", "c2", "keys")
    for _ in range(BALL_ROUNDS):
        entry = left.select("id", "c1", "c2", F.posexplode("keys").alias("t", "k"))
        least = entry.groupBy("t", "k").agg(F.min(F.struct("id", "c1", "c2")).alias("l"), F.count("*").alias("n")).filter("n > 1")
        least = least.select("t", "k", F.col("l.id").alias("b"), F.col("l.c1").alias("d1"), F.col("l.c2").alias("d2"))
        close = entry.join(least, ["t", "k"]).filter(f"id <> b and {away} <= {limit(str(half))}").select(F.col("id").alias("a"), "b").distinct()
        near = staged(measured(close).filter(F.col("angle") <= half), "near")
        inner = near.select(F.col("a").alias("b")).distinct()
        got = near.join(inner, "b", "left_anti").groupBy("a").agg(F.min(F.struct("b", "angle")).alias("m")).select(F.col("a").alias("id"), F.col("m.b").alias("ball"), F.col("m.angle").alias("angle"))
        got = staged(got, "balls")
        if got.isEmpty():
            break
        balls = got if balls is None else balls.unionByName(got)
        taken = got.select("id").union(got.select("ball")).distinct()
        left = staged(left.join(taken, "id", "left_anti"), "left")
    balls = balls if balls is not None else spark.createDataFrame([], "id long, ball long, angle double")
    placed = coded.join(balls, "id", "left").select("*", F.coalesce("ball", "id").alias("of"), F.coalesce("angle", F.lit(0.0)).alias("off")).drop("ball", "angle")
    placed = staged(placed, "placed")
    # The radius is rounded up, so that rounding never takes a pair for decided that is not.
    stats = staged(placed.groupBy("of").agg(F.sum("w").alias("weight"), (F.max("off") + F.when(F.count("*") > 1, 1e-9).otherwise(0)).alias("r"), F.count("*").alias("n")), "stats")
    # A ball may hold a third of all vectors: its members stay where they are.
    balls = staged(stats.join(coded.select(F.col("id").alias("of"), F.col("c1").alias("o1"), F.col("c2").alias("o2")), "of"), "stats")
    named = join_counted(placed, balls, "of", "n", n)

    # Balls that meet in a table.
    def entries(keys: str, per: int) -> DataFrame:
        each = named.select("of", "r", F.col("o1").alias("c1"), F.col("o2").alias("c2"), "n", F.posexplode(keys).alias("at", "k"))
        each = each.select("of", "r", "c1", "c2", (F.col("at") / per).cast("int").alias("t"), "k", "n")
        return each.filter("n = 1").drop("n").unionByName(each.filter("n > 1").drop("n").distinct())

    held = entries("keys", 1).select("t", "k", F.col("of").alias("b"), F.col("r").alias("q"), F.col("c1").alias("d1"), F.col("c2").alias("d2"))
    per = min(probes, 1 << min(8, s))
    met = entries("probes", per).join(held, ["t", "k"]).filter(f"of <> b and {away} <= {limit(f'{link} + r + q')}")
    pairs = staged(met.select(F.least("of", "b").alias("a"), F.greatest("of", "b").alias("b")).distinct(), "pairs")
    judged = measured(pairs)
    for side in ("a", "b"):
        judged = judged.join(stats.select(F.col("of").alias(side), F.col("r").alias(f"r_{side}"), F.col("n").alias(f"n_{side}"), F.col("weight").alias(f"w_{side}")), side)
    verdict = F.expr(f"case when n_a = 1 and n_b = 1 then if(cosine >= {cosine}, 'all', 'none') when angle + r_a + r_b < {link} - 1e-9 then 'all' when angle - r_a - r_b > {link} + 1e-9 then 'none' else 'some' end")
    judged = staged(judged.withColumn("verdict", verdict).filter("verdict <> 'none'"), "judged")
    whole = judged.filter("verdict = 'all'")
    ball_adds = whole.select(F.col("a").alias("of"), F.col("w_b").alias("add")).union(whole.select("b", "w_a")).groupBy("of").agg(F.sum("add").alias("ball_add"))

    # Balls of which some members are links: blocks against blocks.
    part = judged.filter("verdict = 'some'").select("a", "b")
    needed = part.select(F.col("a").alias("of")).union(part.select("b")).distinct()
    inside = placed.join(needed, "of", "left_semi").join(stats.select("of", "n"), "of")
    inside = inside.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("long"))
    blocks = staged(inside.groupBy("of", "block").agg(F.collect_list(F.struct("id", "w", "x")).alias("m")), "blocks")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            for a, b, m, k in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                x, y = (unit([np.frombuffer(r["x"], "<f8") for r in side]) for side in (m, k))
                wx, wy = (np.array([r["w"] for r in side], np.int64) for side in (m, k))
                hit = x @ y.T >= cosine
                if hit.any():
                    ids = [r["id"] for r in m] + [r["id"] for r in k]
                    add = np.concatenate([hit @ wy, hit.T @ wx])
                    yield pa.RecordBatch.from_arrays([pa.array([a] * len(ids), pa.int64()), pa.array([b] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(add, pa.int64())], ["a", "b", "id", "add"])

    both = part.join(blocks.select(F.col("of").alias("a"), "m"), "a").join(blocks.select(F.col("of").alias("b"), F.col("m").alias("k")), "b").select("a", "b", "m", "k")
    some = staged(both.mapInArrow(multiply, "a long, b long, id long, add long"), "some")
    own_adds = some.groupBy("id").agg(F.sum("add").alias("own_add"))
    joined = components(whole.select("a", "b").unionByName(some.select("a", "b").distinct())).withColumnRenamed("id", "of")

    zero = F.lit(0).cast("long")
    sides = balls.select("of", "n", "weight").join(ball_adds, "of", "left").join(joined, "of", "left")
    found = join_counted(placed.select("id", "of"), staged(sides, "sides"), "of", "n", n).join(own_adds, "id", "left")
    return found.select("id", (F.col("weight") - 1 + F.coalesce("ball_add", zero) + F.coalesce("own_add", zero)).alias("n_links"), F.coalesce("component_id", "of").alias("of"))
