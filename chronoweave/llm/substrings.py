"""Substring dedup: a De Bruijn graph of token windows, compacted in documents and by joins, names long repeated spans.

A window of ``width`` words is an edge. Each window has an anchor, the least hash of the word groups inside it, so equal windows have
equal anchors at equal places. Consecutive windows of one anchor are compacted where they stand into a run, named by a digest of its words.
Equal runs are repeated edges. Runs that share an anchor but differ may share some windows: these, and no others, are read at their
source coordinates and compared window by window. Repeated edges that follow each other without branching are compacted into paths by joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, list_array, mix64, slices, staged
from .components import components

#: Words of a window.
WIDTH = 35
#: Words whose hash may be an anchor: long enough that chance seldom shares one, short enough that a run holds several windows.
ANCHOR = 12
#: Rows (a long each) up to which the rows that are wanted are sent to the documents, so that no other text moves.
SENT_ROWS = 1 << 22
#: Words hashed at a time.
_AT_ONCE = 1 << 18
_B, _C = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def _digest(words: bytes, size: int = 12) -> bytes:
    return hashlib.blake2b(words, digest_size=size).digest()


def _places(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of words that one space separates."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(words)]])


def _word_hashes(words: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out, data = np.empty(len(begin), np.uint64), np.frombuffer(words, np.uint8)
    for lo in range(0, len(begin), _AT_ONCE):
        b = begin[lo : lo + _AT_ONCE]
        part = data[b[0] : end[min(lo + _AT_ONCE, len(end)) - 1]].astype(np.uint64)
        size = np.diff(np.append(b - b[0], len(part)))  # a word with the space after it
        power = np.cumprod(np.full(int(size.max()), _B, np.uint64))
        part *= power[np.arange(len(part)) - np.repeat(b - b[0], size)]
        if len(b) > 1:
            part[b[1:] - b[0] - 1] = 0  # the spaces
        out[lo : lo + len(b)] = np.add.reduceat(part, b - b[0])
    return mix64(out)


def _spread(x: np.ndarray, n: int, join) -> np.ndarray:
    """``join`` over every ``n`` neighbours, by doubling; ``join(left, right, distance)``."""
    done, have, parts = 1, x, []
    while n:
        if n & 1:
            parts.append((done, have))
        n >>= 1
        if n:
            have, done = join(have[..., :-done], have[..., done:], done), done * 2
    size, out = parts[0]
    for step, more in parts[1:]:
        m = min(out.shape[-1], more.shape[-1] - size)
        out, size = join(out[..., :m], more[..., size : size + m], step), size + step
    return out


def window_runs(words: bytes, width: int, anchor: int) -> tuple[int, np.ndarray, np.ndarray, list[bytes]]:
    """Words, then first window, number of windows and name of each run of windows with one anchor place.

    A name is the anchor's hash and 64 bits of a digest of the run's words, so only runs that share an anchor could be taken for one another.
    """
    begin, end = _places(words)
    if len(begin) < width:
        none = np.zeros(0, np.int64)
        return len(begin), none, none, []
    power = [pow(_C, k, 1 << 64) for k in range(anchor + 1)]
    group = mix64(_spread(_word_hashes(words, begin, end), anchor, lambda a, b, d: a * np.uint64(power[d]) + b))
    place = np.arange(len(group))

    def later_least(a: np.ndarray, b: np.ndarray, _: int) -> np.ndarray:
        return np.where(group[b] <= group[a], b, a)

    at = _spread(place, width - anchor + 1, later_least)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    size = np.diff(np.append(first, len(at)))
    lo, hi = begin[first].tolist(), end[first + size + width - 2].tolist()
    anchors = group[at[first]].tolist()
    return len(begin), first, size, [h.to_bytes(8, "big") + _digest(words[a:b], 8) for h, a, b in zip(anchors, lo, hi, strict=True)]


def _documents(docs: DataFrame, id_col: str, text_col: str, width: int, anchor: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            words = [b" ".join((t.as_py() or "").encode().split()) for t in batch.column(1)]
            got = [window_runs(w, width, anchor) for w in words]
            names = [np.frombuffer(b"".join(g[3]), ">i8").reshape(-1, 2).astype(np.int64) for g in got]
            columns = [batch.column(0), pa.array(words, pa.binary()), pa.array([g[0] for g in got], pa.int64())]
            columns += [list_array([g[c].astype(np.int32) for g in got], pa.int32()) for c in (1, 2)]
            columns += [list_array([x[:, c] for x in names], pa.int64()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "words", "n_words", "first", "size", "anchor", "digest"])

    shape = f"doc_id {kind}, words binary, n_words long, first array<int>, size array<int>, anchor array<long>, digest array<long>"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "windows", "zstd")


def _split(rows: DataFrame, wanted: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` whose ``row`` is one of the ``n`` in ``wanted``, and the others, both where they stand; beyond a bound all, and nothing, and the join that follows sorts them out."""
    if n > SENT_ROWS:
        return rows, None
    wanted = F.broadcast(wanted.select("row"))
    return rows.join(wanted, "row", "left_semi"), rows.join(wanted, "row", "left_anti")


def _read_windows(runs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``row, place, n, edge``: the windows of ``runs`` (``row, first, size, n``), read in their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for row, words, which in zip(*(batch.column(c) for c in range(3)), strict=True):
                words = words.as_py()
                begin, end = _places(words)
                which = which.values.flatten()
                first, size, n = (x.to_numpy(zero_copy_only=False) for x in which)
                for lo in range(0, len(first), 4096):
                    s = size[lo : lo + 4096]
                    place = np.repeat(first[lo : lo + 4096] - (np.cumsum(s) - s), s) + np.arange(s.sum())
                    edge = [_digest(words[a:b]) for a, b in zip(begin[place].tolist(), end[place + width - 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(place), pa.int64()), pa.array(place, pa.int32()), pa.array(np.repeat(n[lo : lo + 4096], s), pa.int64()), pa.array(edge, pa.binary())], names=["row", "place", "n", "edge"])

    held = runs.groupBy("row").agg(F.collect_list(F.struct("first", "size", "n")).alias("which"))
    near, _ = _split(rows.select("row", "words"), held, held.count())
    return near.join(held, "row").mapInArrow(run, "row long, place int, n long, edge binary")


def _repeated_edges(rows: DataFrame, width: int) -> DataFrame:
    """``row, place, size, edge`` of every repeated edge where it stands: a run that stands elsewhere too, or one such window of another run.

    Runs whose anchor stands nowhere else move once and go. If all runs of an anchor are equal they are repeated as they are; only those of
    other anchors are grouped by what they are.
    """
    runs = rows.select("row", F.explode(F.arrays_zip("first", "size", "anchor", "digest")).alias("r")).select("row", "r.*")
    total = int(rows.agg(F.sum(F.size("first"))).first()[0] or 0)
    counted = runs.groupBy("anchor").agg(F.count("*").alias("held"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("held > 1")
    anchors = staged(counted.select("anchor", "held", (F.col("lo") != F.col("hi")).alias("several")), "anchors", "zstd")
    met = staged(join_counted(runs, anchors, "anchor", "held", total).select("row", "first", "size", F.struct("anchor", "digest").alias("run"), "several"), "met", "zstd")
    name = F.xxhash64("edge")
    place = [F.col("first").alias("place"), "size", F.xxhash64("run.anchor", "run.digest").alias("edge")]
    mixed = met.filter("several").drop("several")
    kinds = staged(mixed.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "size")).alias("at")), "runs", "zstd")
    windows = staged(_read_windows(kinds.select("at.*", "n"), rows, width), "edges", "zstd")
    counts = windows.groupBy("edge").agg(F.sum("n").alias("n"), F.count("*").alias("held"), F.max((F.col("n") == 1).cast("int")).alias("single"))
    shared = staged(counts.filter("n > 1 and single = 1").select("edge", "held"), "shared", "zstd")
    alone = windows.filter("n = 1").select("row", "place", "edge")
    one = join_counted(alone, shared, "edge", "held", windows.count()).select("row", "place", F.lit(1).alias("size"), name.alias("edge"))
    again = kinds.filter("n > 1").select("run", F.col("n").alias("held"))
    whole = join_counted(mixed, again, "run", "held", mixed.count()).select("row", *place)
    return met.filter("not several").select("row", *place).unionByName(whole).unionByName(one)


def _ranked(chain: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``edge, to, offset`` of every ``edge`` with ``to`` moved to the end of its pointers, and those that go round, if any.

    ``chain`` holds one pointer an edge; an end is what has none itself. Rounds of joins double the pointers.
    """
    ends = chain.join(chain.select(F.col("edge").alias("to")), "to", "left_anti").select("edge", F.lit(True).alias("ended"))
    now = staged(chain.join(ends, "edge", "left").select("edge", "to", "offset", F.coalesce("ended", F.lit(False)).alias("ended")), "jumps", "zstd")
    done, going = now.filter("ended"), now.filter("not ended")  # what has ended is written once
    left, before = going.count(), None
    while left:
        if left == before:  # a doubling ends some pointers of every path, so only rings are left
            return done.drop("ended"), going.select("edge")
        there = done.unionByName(going).select(F.col("edge").alias("to"), F.col("to").alias("to2"), F.col("offset").alias("offset2"), F.col("ended").alias("ended2"))
        moved = going.join(there, "to").select("edge", F.col("to2").alias("to"), (F.col("offset") + F.col("offset2")).alias("offset"), F.col("ended2").alias("ended"))
        now = staged(moved, "jumps", "zstd")
        done, going = done.unionByName(now.filter("ended")), now.filter("not ended")
        left, before = going.count(), left
    return done.drop("ended"), None


def _cut(chain: DataFrame, rings: DataFrame) -> DataFrame:
    """``edge, to, offset`` of the rings' edges, each cut before its least edge."""
    around = chain.join(rings, "edge", "left_semi")
    least = components(around.filter("edge <> to").select(F.col("edge").alias("a"), F.col("to").alias("b"))).select(F.col("id").alias("edge"), "component_id")
    ringed = around.join(least.unionByName(around.filter("edge = to").select("edge", F.col("edge").alias("component_id"))), "edge")
    zero = ringed.filter("edge = component_id").select("edge", F.col("edge").alias("to"), F.lit(0).cast("long").alias("offset"))
    return _ranked(ringed.filter("edge <> component_id").select("edge", "to", "offset"))[0].unionByName(zero)


def compact(links: DataFrame, every: int = 8) -> DataFrame:
    """``edge, path, offset`` from ``a, b, size``: edge ``b`` follows edge ``a``, which has ``size`` windows. Edges in no nonbranching chain are left out.

    A chain holds links whose first edge has no other follower and whose second follows no other. Each edge points to the one before
    it. Pointers first run to the next stop, one edge in ``every`` by its number or a path's first edge, then those of the stops alone run to the
    path's first edge, its name. A ring is cut before its least stop, or its least edge if it has no stop.
    """
    after = links.groupBy("a").agg(F.count("*").alias("n_after"), F.min("b").alias("b"), F.min("size").alias("size")).filter("n_after = 1")
    before = links.groupBy("b").agg(F.count("*").alias("n_before")).filter("n_before = 1")
    chain = staged(after.join(before, "b").select(F.col("b").alias("edge"), F.col("a").alias("to"), F.col("size").cast("long").alias("offset")), "chain", "zstd")
    heads = chain.select(F.col("to").alias("edge")).join(chain.select("edge"), "edge", "left_anti")
    first = heads.select("edge", F.col("edge").alias("path"), F.lit(0).cast("long").alias("offset"))
    if chain.isEmpty():
        return first
    stop = F.abs(F.xxhash64("edge")) % every == 0
    short, rings = _ranked(chain.filter(~stop))  # a stop has no pointer here: pointers end there
    lone = None if rings is None else _cut(chain, rings)  # rings without a stop
    # A stop points to the stop or first edge that the edge before it reached.
    via = short.select(F.col("edge").alias("to"), F.col("to").alias("to2"), F.col("offset").alias("offset2"))
    stops = staged(chain.filter(stop).join(via, "to", "left").select("edge", F.coalesce("to2", "to").alias("to"), (F.col("offset") + F.coalesce("offset2", F.lit(0))).alias("offset")), "stops", "zstd")
    far, rings = _ranked(stops)
    if rings is not None:
        far = far.unionByName(_cut(stops, rings))
    far = staged(far.select("edge", F.col("to").alias("path"), "offset"), "stops", "zstd")
    up = far.select(F.col("edge").alias("to"), F.col("path").alias("path"), F.col("offset").alias("offset2"))
    rest = short.join(up, "to", "left").select("edge", F.coalesce("path", "to").alias("path"), (F.col("offset") + F.coalesce("offset2", F.lit(0))).alias("offset"))
    out = first.unionByName(far).unionByName(rest)
    return out if lone is None else out.unionByName(lone.withColumnRenamed("to", "path"))


def _spans(docs: DataFrame, id_col: str, text_col: str, width: int, anchor: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``repeated_spans`` returns, and the rows (``row``) that have edges, which are written."""
    if not 0 < anchor <= width:
        raise ValueError("an anchor has at least one word and no more than a window")
    rows = _documents(docs, id_col, text_col, width, anchor)
    seen = staged(_repeated_edges(rows, width).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "size", "edge"))).alias("edges")), "seen", "zstd")
    pairs = F.expr("filter(transform(sequence(1, size(edges) - 1), i -> struct(edges[i - 1].edge as a, edges[i].edge as b, edges[i - 1].size as size, edges[i - 1].place + edges[i - 1].size = edges[i].place as beside)), x -> x.beside)")
    links = staged(seen.filter("size(edges) > 1").select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.min("p.size").alias("size")), "links", "zstd")
    paths = staged(compact(links).withColumnRenamed("edge", "__edge"), "paths", "zstd")
    times = seen.select(F.explode("edges").alias("e")).groupBy(F.col("e.edge").alias("edge")).agg(F.count("*").alias("held"))
    named = staged(times.join(paths, F.col("edge") == F.col("__edge"), "left").select("edge", "held", F.coalesce("path", "edge").alias("path"), F.coalesce("offset", F.lit(0)).alias("offset")), "named", "zstd")
    each = seen.select("row", F.explode("edges").alias("e")).select("row", "e.*")
    total = int(named.agg(F.sum("held")).first()[0] or 0)
    placed = join_counted(each, named, "edge", "held", total)
    spans = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "size", "path", "offset"))).alias("edges"))
    return rows.select("row", "doc_id", "words", "n_words"), spans, seen.select("row")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """Documents as read (``row, doc_id, words, n_words``, words with one space between) and their repeated edges (``row, edges``: ``place, size, path, offset`` in order of place).

    ``place`` is the edge's first word, ``size`` its windows, ``path`` the compacted path it lies on and ``offset`` its first window there. Edges that
    are alone on their path are its first. Names of paths are a 64-bit hash of their first edge's digest; they decide nothing about what is repeated.
    """
    return _spans(docs, id_col, text_col, width, anchor)[:2]


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """Documents without the words of windows that stand elsewhere too, in another document or the same.

    Returns ``doc_id, n_words, n_removed, kept_sha256, n_paths, text``: ``text`` is the kept words with one space between, ``n_paths`` the compacted paths on
    which the removed words lie. Windows are judged on the input; every copy goes, the first one too.

    Words are what the six ASCII white-space characters leave; null and empty texts have none and keep the empty text. Texts under ``width`` words stay.
    Repeated rows and ids each have a row and count as copies of each other; null ids stay. Other columns are not read. An empty table gives no rows.
    """
    rows, spans, spanned = _spans(docs, id_col, text_col, width, anchor)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            gone, digest, paths, texts = [], [], [], []
            for words, n, edges in zip(batch.column("words"), batch.column("n_words").to_pylist(), batch.column("edges"), strict=True):
                words = words.as_py()
                if not edges.is_valid:
                    gone.append(0)
                    paths.append(0)
                    kept = words
                else:
                    place, size, path, _ = (x.to_numpy(zero_copy_only=False) for x in edges.values.flatten())
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, place, 1)
                    np.add.at(step, place + size + width - 1, -1)
                    stays = np.concatenate([[False], np.cumsum(step[:-1]) == 0, [False]])
                    edge = np.flatnonzero(stays[1:] != stays[:-1]).reshape(-1, 2)
                    begin, end = _places(words)
                    kept = b" ".join([words[begin[a] : end[b - 1]] for a, b in edge.tolist()])
                    gone.append(int(n - (edge[:, 1] - edge[:, 0]).sum()))
                    paths.append(len(np.unique(path)))
                digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(paths, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_paths", "text"])

    moved, apart = _split(rows, spanned, spanned.count())
    if apart is None:
        each = rows.join(spans, "row", "left")
    else:
        each = moved.join(spans, "row").unionByName(apart.withColumn("edges", F.lit(None).cast(spans.schema["edges"].dataType)))
    return each.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, n_paths long, text string")
