"""Near duplicates by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, maybe_broadcast, mix64, slices, staged
from .components import components

#: 40 bands of 6: a pair at similarity 0.8 shares no band with probability (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
#: At most so many rounds of comparing bucket members with one of them, before all that are left are compared.
STAR_ROUNDS = 4
#: Members up to which a bucket's pairs are rows; larger buckets are compared in blocks of BLOCK members.
PAIRED, BLOCK = 6, 128
#: Distinct shingles counted at a time when two blocks are compared.
COLUMNS = 8192
#: Distinct words whose hash a task keeps (memory only).
KEPT_WORDS = 120_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, size: int, words: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A-Z are lower-cased; words are maximal runs without U+0009-U+000D and U+0020. Fewer words than
    ``size`` make one shingle; no word makes none.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    used = min(size, len(h))
    n = len(h) - used + 1
    out = np.full(n, used, np.uint64)
    for k in range(used):
        out = mix64(out) + h[k : k + n]
    return np.unique(mix64(out))


class Circulant:
    """MinHash signatures from two permutations of a 32-bit universe.

    The first permutation places a shingle; coordinate ``k`` is the least value of the second
    one shifted circularly by ``k``, over all shingles. The second is a fixed
    multiply-and-xor-shift bijection, so that no table is held.
    """

    def __init__(self, coordinates: int, seed: int = 1):
        self.shift = np.arange(1, coordinates + 1, dtype=np.uint32)
        self.seed = np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        self.block = 512
        self.a = np.empty((self.block, coordinates), np.uint32)
        self.b = np.empty_like(self.a)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        placed = (mix64(hashes ^ self.seed) >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.shift), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(placed), self.block):
            x = placed[at : at + self.block]
            a, b = self.a[: len(x)], self.b[: len(x)]
            np.add(x[:, None], self.shift, out=a)
            np.right_shift(a, 16, out=b)
            np.bitwise_xor(a, b, out=a)
            np.multiply(a, np.uint32(0x7FEB352D), out=a)
            np.right_shift(a, 15, out=b)
            np.bitwise_xor(a, b, out=a)
            np.multiply(a, np.uint32(0x846CA68B), out=a)
            np.right_shift(a, 16, out=b)
            np.bitwise_xor(a, b, out=a)
            np.minimum(least, a.min(axis=0), out=least)
        return least


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; bands differ in their salt."""
    bands = signature.astype(np.uint64).reshape(-1, rows)
    out = mix64(np.arange(1, len(bands) + 1, dtype=np.uint64))
    for k in range(rows):
        out = mix64(out + bands[:, k])
    return out


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, n_shingles, digest, bands``: a hash of the text, the set's size, 128-bit digest and band keys (none for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, circulant = _WordHash(), Circulant(bands * rows)
        for batch in slices(batches):
            sets = [shingle_hashes(t, size, words) for t in batch.column(1).to_pylist()]
            none = np.zeros(0, np.int64)
            keys = [band_keys(circulant.signature(s), rows).view(np.int64) if len(s) else none for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    list_array(keys, pa.int64()),
                ],
                ["doc_id", "th", "n_shingles", "digest", "bands"],
            )

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    return rows_in.mapInArrow(sign, "doc_id long, th long, n_shingles long, digest binary, bands array<long>")


def _sets(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``least, digest, shingles``: whole shingle sets as sorted 64-bit hashes."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHash()
        for batch in slices(batches):
            sets = [shingle_hashes(t, size, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["least", "digest", "shingles"]
            )

    return docs.select(F.col(id_col).cast("long").alias("least"), text_col).mapInArrow(shingle, "least long, digest binary, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets have ``100 * intersection >= percent * union``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
    )
    return joined.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _block_links(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` across the components of each bucket, one for each two components that a pair of blocks joins.

    ``held``: bucket ``key``, ``id``, ``component`` and the bucket's size ``c``. Members are dealt into blocks by
    hash; a row is two blocks with their sets, and counts of common shingles come from
    products of their incidence matrices, so no pair is ever a row.
    """
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / BLOCK)).cast("int")
    dealt = held.select("key", block.alias("block"), "id", "component").join(sets.select("id", "shingles"), "id")
    blocks = staged(dealt.groupBy("key", "block").agg(F.collect_list(F.struct("id", "component", "shingles")).alias("x")), "blocks")
    two = blocks.join(blocks.select("key", F.col("block").alias("other"), F.col("x").alias("y")), "key").filter("block <= other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (a, ca, sa), (b, cb, sb) = (([r["id"] for r in z], np.array([r["component"] for r in z]), [np.frombuffer(r["shingles"], np.uint64) for r in z]) for z in (x, y))
                na, nb = (np.array([len(s) for s in z]) for z in (sa, sb))
                names, at = np.unique(np.concatenate([*sa, *sb]), return_inverse=True)
                row = np.repeat(np.arange(len(sa) + len(sb)), np.concatenate([na, nb]))
                order = np.argsort(at, kind="stable")
                at, row = at[order], row[order]
                both = np.zeros((len(sa), len(sb)), np.float32)
                for lo in range(0, len(names), COLUMNS):
                    i, j = np.searchsorted(at, (lo, lo + COLUMNS))
                    has = np.zeros((len(sa) + len(sb), COLUMNS), np.float32)
                    has[row[i:j], at[i:j] - lo] = 1
                    both += has[: len(sa)] @ has[len(sa) :].T
                link = (100 * both.astype(np.int64) >= percent * (na[:, None] + nb[None, :] - both.astype(np.int64))) & (ca[:, None] != cb[None, :])
                found = {(min(ca[i], cb[j]), max(ca[i], cb[j])): (a[i], b[j]) for i, j in zip(*np.nonzero(link), strict=True)}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found.values()], pa.int64()), pa.array([q for _, q in found.values()], pa.int64())], ["a", "b"])

    return two.select("x", "y").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Rows with equal shingle sets form a class, which has a number of its own in all
    later steps, whatever ids its rows have. Classes that share a band key are candidates. In each round one member of a
    bucket, drawn by a hash, is compared with all members that are in other components, and
    components are joined; a bucket of one component needs no more. What rounds no longer join
    is compared across components, small buckets by pairs, large ones by blocks of members, so
    no candidate pair is left undecided and no pair of a large group becomes a row. Links are confirmed on
    whole sets; ``component_id`` is the least id reachable by links.

    Null and empty texts have no shingle and link with nothing. A null id has a null
    ``component_id`` and is not kept unless its text has no shingle. Repeated ids: each row by its own text. An
    empty table gives no rows. Other columns are not read.
    """
    found = _members(docs, size, percent, bands, rows, id_col, text_col)
    return found.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("n_shingles") == 0))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` but those of a component's other documents: the document of least id (of several texts with it, one) stays.

    A document is an id with a text: rows equal in both stay or go together, and an id that has several texts loses only
    those that have another document in their component. Texts without words and rows without id stay.
    """
    found = _members(docs, size, percent, BANDS, ROWS, id_col, text_col)
    gone = staged(found.filter("doc_id is not null and n_shingles > 0 and not (doc_id = component_id and leads)").select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th")).distinct(), "copies")
    keyed = docs.withColumns({"__doc": F.col(id_col).cast("long"), "__th": F.xxhash64(text_col)})
    return keyed.join(maybe_broadcast(gone), ["__doc", "__th"], "left_anti").select(*docs.columns)


def _members(docs: DataFrame, size: int, percent: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, th, n_shingles, component_id, leads`` of every row; ``leads`` marks rows of the class that holds the component's least id."""
    signed = staged(signatures(docs, size, bands, rows, id_col, text_col), "minhash")
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("digest")
    reps = classes.agg(F.min("doc_id").alias("least"), F.first(F.struct("n_shingles", "bands")).alias("r")).select("digest", "least", F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands"))
    # The number is fixed by being written: a class is never known by an id that another class may have too.
    reps = staged(reps.withColumn("id", F.monotonically_increasing_id()), "reps")

    members = reps.select("id", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    held = staged(members.join(buckets, "key"), "shared")

    ids = staged(held.select("id").distinct(), "ids")
    wanted = staged(ids.join(reps.select("id", "least", "digest"), "id"), "wanted")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    some = own.join(maybe_broadcast(wanted.select("least")), F.col("doc_id").cast("long") == F.col("least"), "left_semi")
    sets = _sets(some, size, "doc_id", "text").join(maybe_broadcast(wanted), ["least", "digest"])
    sets = staged(sets.select("id", "shingles").dropDuplicates(["id"]), "sets")

    alike = f"component <> other and 100 * least(n, m) >= {percent} * greatest(n, m)"
    links, joined, before = None, None, float("inf")
    held = held.withColumn("component", F.col("id"))
    for turn in range(STAR_ROUNDS):
        # One member of each bucket, the same one in all buckets where it can be, stands against those of other components.
        lead = held.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "component")).alias("l"))
        lead = lead.select("key", F.col("l.id").alias("b"), F.col("l.n").alias("m"), F.col("l.component").alias("other"))
        stars = held.join(lead, "key").filter(alike).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
        found = verified(stars, sets, percent)
        links = staged(found if links is None else links.unionByName(found), "links")
        joined = components(links)
        held = held.drop("component", "c", "pairs").join(joined, "id", "left").withColumn("component", F.coalesce("component_id", "id")).drop("component_id")
        per = held.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.count("*").alias("parts"))
        per = per.filter("parts > 1").select("key", "c", ((F.col("c") * F.col("c") - F.col("cc")) / 2).alias("pairs"))
        held = staged(held.join(per, "key"), "open")
        now = held.groupBy("key").agg(F.first("pairs").alias("pairs")).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).first()["pairs"]
        if not now or now > 0.5 * before:
            break
        before = now

    few = held.filter(F.col("c") <= PAIRED)
    other = few.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"))
    across = few.join(other, "key").filter("id < b and " + alike).select(F.col("id").alias("a"), "b").distinct()
    more = verified(across, sets, percent).unionByName(_block_links(held.filter(F.col("c") > PAIRED), sets, percent))
    more = staged(more, "links")
    if not more.isEmpty():
        joined = components(links.unionByName(more))

    # From class numbers to the least document id of each component.
    found = reps.select("digest", "id", "least").join(joined, "id", "left").withColumn("of", F.coalesce("component_id", "id")).drop("component_id")
    found = staged(found, "found")
    heads = found.join(joined.select(F.col("component_id").alias("of")).distinct(), "of", "left_semi").groupBy("of").agg(F.min(F.struct("least", "id")).alias("head"))
    found = found.join(heads, "of", "left").select("digest", F.coalesce("head.least", "least").alias("of_class"), (F.coalesce("head.id", "id") == F.col("id")).alias("leads"))
    component = F.expr("case when doc_id is null then null when n_shingles = 0 then doc_id else of_class end")
    return signed.join(found, "digest", "left").select("doc_id", "th", "n_shingles", component.alias("component_id"), "leads")
