"""Cross-tokenizer alignment: tokens of two vocabularies linked by the bytes they share, merged in lockstep."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged
from .encoding import Encoder

#: Bytes of text merged at a time; a longer text is cut where a space stands between ASCII letters or digits, a place where both files cut.
AT_ONCE = 1 << 20
#: A-tokens of a lane: longer documents are merged in several lanes, which begin where both files' tokens end.
LANE = 256
#: Units (a word with the spaces before it) whose ids a worker keeps.
KEPT_UNITS = 1 << 17
#: Id pairs that are broadcast with their counts, the most frequent ones; links of others meet their counts in a join.
FREQUENT = 1 << 21

_CUT = re.compile(rb"[A-Za-z0-9](?= [A-Za-z0-9])")
_UNIT = re.compile(" +[^ ]*")


def gathered(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The pieces ``flat[begin : begin + count]``, one after the other."""
    through = np.cumsum(count)
    return flat[np.repeat(begin - through + count, count) + np.arange(through[-1] if len(through) else 0)]


class Pieces:
    """Ids of texts by a sentencepiece file, unit by unit where no piece has a space after another character."""

    def __init__(self, path: str, kept: int = KEPT_UNITS):
        from sentencepiece import SentencePieceProcessor

        self.model, self.kept = SentencePieceProcessor(model_file=path), kept
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        spelled = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(x)) else x.replace("▁", " ").encode() for x in names]
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.begin, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(spelled), np.uint8)
        self.by_unit = not any("▁" in x.lstrip("▁") for x in names)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text``, which begins with the space that the library itself would put before it."""
        if not self.by_unit:
            return np.array(self.model.encode(text[1:], num_threads=1), np.int32)
        units = _UNIT.findall(text)
        if len(self.number) > self.kept:
            self.clear()
        if new := list(dict.fromkeys(u for u in units if u not in self.number)):
            ids = self.model.encode([u[1:] for u in new], num_threads=1)
            ids = [i if len(u) > 1 else [self.model.piece_to_id("▁")] for u, i in zip(new, ids, strict=True)]
            self.number.update(zip(new, range(len(self.ends) - 1, len(self.ends) + len(new) - 1), strict=True))
            self.flat = np.concatenate([self.flat, np.array([x for i in ids for x in i], np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(i) for i in ids])])
        at = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        return gathered(self.flat, self.ends[at], self.ends[at + 1] - self.ends[at])


def _lanes(a_end: np.ndarray, b_end: np.ndarray, starts: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of the lanes: those of documents, and about each ``lane``-th A-token after which both tokens end."""
    n = len(a_end)
    probe = np.arange(lane, n, lane)
    probe = np.minimum(probe[:, None] + np.arange(8), n - 1)
    at = np.searchsorted(b_end, a_end[probe - 1])
    both = b_end[np.minimum(at, len(b_end) - 1)] == a_end[probe - 1]
    some = both.any(1)
    first = both.argmax(1)
    more = probe[np.arange(len(probe)), first][some]
    i = np.unique(np.concatenate([starts, more]))
    j = np.searchsorted(b_end, np.where(i > 0, a_end[i - 1], 0), "right")
    return i, np.where(i > 0, j, 0)


def merge(a_end: np.ndarray, b_end: np.ndarray, starts: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and cuts of documents that stand one after the other.

    ``a_end``, ``b_end``: byte offsets at which tokens end, none empty, counted through all documents; ``starts``: the first A-token of each (none empty).
    All lanes go forward together: in a step each emits the link of its two tokens and a cut where both end, and passes the one that ends first, or both.
    Lanes that are through leave the state. Returns A- and B-tokens of the links in order of the text, and flags of the tokens before a cut.
    """
    i, j = _lanes(a_end, b_end, starts, lane)
    stop = np.append(i[1:], len(a_end))
    cut_a, cut_b = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    link_a, linked = np.zeros(len(a_end) + len(b_end), np.int32), np.zeros(len(a_end) + len(b_end), bool)
    while len(i):
        at = i + j  # no other link has this sum
        link_a[at], linked[at] = i, True
        ea, eb = a_end[i], b_end[j]
        cut = ea == eb
        cut_a[i[cut]], cut_b[j[cut]] = True, True
        i, j = i + (ea <= eb), j + (eb <= ea)
        on = i < stop
        if not on.all():
            i, j, stop = i[on], j[on], stop[on]
    at = np.flatnonzero(linked)
    a = link_a[at].astype(np.int64)
    return a, at - a, cut_a, cut_b


class Aligner:
    """Both files and what is derived from them; one per worker."""

    def __init__(self, a_path: str, b_path: str, at_once: int = AT_ONCE):
        self.at_once = at_once
        self.a, self.b = Encoder(a_path, added_as_text=True), Pieces(b_path)
        names = self.a.tokenizer.get_vocab(with_added_tokens=True)
        of = {c: b for b, c in self.a.letters.items()}
        spelled = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            spelled[k] = bytes(of[c] for c in name) if all(c in of for c in name) else name.encode()
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.begin, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(spelled), np.uint8)
        self.a_names = [np.array([f"{k}{end}" for k in range(len(spelled))], object) for end in (",", "|")]
        self.b_names = [np.array([f"{k}{end}" for k in range(len(self.b.size))], object) for end in (",", ";")]
        self.width = len(self.b.size)
        self.dtype = np.dtype("<u4" if len(spelled) * self.width <= 1 << 32 else "<u8")

    def pieces(self, text: str | None) -> list[bytes]:
        """Space and text, cut into pieces that begin with a space."""
        if not text:
            return []
        raw, out, lo = b" " + text.encode(), [], 0
        while len(raw) - lo > self.at_once and (m := _CUT.search(raw, lo + self.at_once)):
            out.append(raw[lo : m.end()])
            lo = m.end()
        return [*out, raw[lo:]]

    def align(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, bytes, np.ndarray] | None]:
        """For each piece: its A-tokens, B-tokens, groups, links, the groups' spelling with ``;`` at its end, and the links' pair numbers.

        None where the joined bytes of either side are not the piece's.
        """
        spelled = [t.decode() for t in texts]
        a_ids, n_a = self.a.flat(pa.array(spelled, pa.string()))
        a_ids = a_ids.astype(np.int64)
        b_parts = [self.b.encode(t) for t in spelled]
        a_parts = np.split(a_ids, np.cumsum(n_a)[:-1])
        good = [
            gathered(self.bytes, self.begin[a], self.size[a]).tobytes() == t and gathered(self.b.bytes, self.b.begin[b], self.b.size[b]).tobytes() == t
            for a, b, t in zip(a_parts, b_parts, texts, strict=True)
        ]
        a_parts, b_parts = [a for a, g in zip(a_parts, good, strict=True) if g], [b for b, g in zip(b_parts, good, strict=True) if g]
        if not a_parts:
            yield from (None for _ in texts)
            return
        a_ids, b_ids = np.concatenate(a_parts), np.concatenate(b_parts).astype(np.int64)
        a_at, b_at = np.cumsum([0, *map(len, a_parts)]), np.cumsum([0, *map(len, b_parts)])
        link_a, link_b, cut_a, cut_b = merge(np.cumsum(self.size[a_ids]), np.cumsum(self.b.size[b_ids]), a_at[:-1])
        pair = (a_ids[link_a] * self.width + b_ids[link_b]).astype(self.dtype)
        links_at = np.searchsorted(link_a, a_at)
        # In the spelling an A-token stands after the B-tokens of earlier groups, a B-token after the A-tokens up to its own.
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        ends_a, ends_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        words = np.empty(len(a_ids) + len(b_ids), object)
        words[np.arange(len(a_ids)) + np.append(0, ends_b)[group_a]] = np.where(cut_a, self.a_names[1][a_ids], self.a_names[0][a_ids])
        words[np.arange(len(b_ids)) + ends_a[group_b]] = np.where(cut_b, self.b_names[1][b_ids], self.b_names[0][b_ids])
        cuts = np.append(0, np.cumsum(cut_a))[a_at]
        k = 0
        for g in good:
            if not g:
                yield None
                continue
            text = "".join(words[a_at[k] + b_at[k] : a_at[k + 1] + b_at[k + 1]].tolist())
            yield len(a_parts[k]), len(b_parts[k]), int(cuts[k + 1] - cuts[k]), int(links_at[k + 1] - links_at[k]), text.encode(), pair[links_at[k] : links_at[k + 1]]
            k += 1


@functools.cache
def aligner(a_path: str, b_path: str, at_once: int) -> Aligner:
    return Aligner(a_path, b_path, at_once)


def _aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, at_once: int) -> DataFrame:
    """One row per document: its counts, the digest of its groups, and its links' pair numbers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path, at_once)
        for batch in slices(batches, 128):
            texts = batch.column(1)
            n = np.zeros((batch.num_rows, 4), np.int64)
            digest, links, bad = [hashlib.sha256() for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)], np.zeros(batch.num_rows, bool)
            todo: list[tuple[int, bytes, bool]] = []

            def work(todo=todo, n=n, digest=digest, links=links, bad=bad):
                for (k, _, last), got in zip(todo, both.align([t for _, t, _ in todo]), strict=True):
                    if got is None:
                        bad[k] = True
                    else:
                        n[k] += got[:4]
                        digest[k].update(got[4][:-1] if last else got[4])
                        links[k].append(got[5].tobytes())
                todo.clear()

            held = 0
            for k in range(batch.num_rows):
                parts = both.pieces(texts[k].as_py())
                for p, part in enumerate(parts):
                    if todo and held + len(part) > at_once:
                        work()
                        held = 0
                    todo.append((k, part, p == len(parts) - 1))
                    held += len(part)
            if todo:
                work()
            n[bad] = 0
            none = bad | (n[:, 0] == 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(n[:, c]) for c in range(4)),
                    pa.array(["" if x else d.hexdigest() for x, d in zip(none.tolist(), digest, strict=True)]),
                    pa.array([b"" if x else b"".join(p) for x, p in zip(none.tolist(), links, strict=True)], pa.binary()),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
            )

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")


def _pair_counts(links: DataFrame, dtype: str) -> DataFrame:
    """``pair, n``: links corpus-wide of each id pair, summed in the tasks before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, held, waiting = np.zeros(0, dtype), np.zeros(0, np.int64), [], 0

        def fold():
            keys, back = np.unique(np.concatenate([seen, *(k for k, _ in held)]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, back, np.concatenate([n, *(c for _, c in held)]))
            return keys, total

        for batch in slices(batches):
            for raw in batch.column(0):
                if data := raw.as_buffer():
                    held.append(np.unique(np.frombuffer(data, dtype), return_counts=True))
                    waiting += len(held[-1][0])
                if waiting > 1 << 20:
                    (seen, n), held, waiting = fold(), [], 0
        seen, n = fold()
        for lo in range(0, len(seen), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(seen[lo : lo + (1 << 16)].astype(np.int64)), pa.array(n[lo : lo + (1 << 16)])], names=["pair", "n"])

    return links.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, at_once: int = AT_ONCE) -> DataFrame:
    """Alignment of each document's tokens by a byte-level file (A) and a sentencepiece file (B).

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. A link is a pair of an A- and a B-token whose bytes overlap, a
    group what lies between two offsets at which both end. A pair's count is its links in all documents; ``n_best`` are the document's links whose count is
    the highest of their B id, ``count_sum`` the sum of its links' counts.

    Documents are encoded and merged once; their links are written and read back. Counts of the ``frequent`` most frequent pairs go to all
    tasks, bounded whatever the corpus; links of rarer pairs, each with fewer links than any of those, are joined to their counts.

    Null or empty texts, and those whose tokens' bytes are not their own, have no tokens: zeros and an empty digest; they add no links. Repeated ids and rows
    each have a row; null ids stay. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    both = aligner(a_path, b_path, at_once)
    width, dtype = both.width, both.dtype.str
    rows = staged(_aligned(docs, a_path, b_path, id_col, text_col, at_once).withColumn("row", F.monotonically_increasing_id()), "links")
    counts = staged(_pair_counts(rows.select("links"), dtype), "pairs").withColumn("b", F.col("pair") % width)
    best = np.zeros(width, np.int64)
    for b, n in counts.groupBy("b").agg(F.max("n")).collect():  # at most as many rows as B has ids
        best[b] = n
    # The least power of two that no more than `frequent` pairs reach.
    bits = dict(counts.groupBy(F.length(F.bin("n")).alias("bits")).count().collect())
    least, held = 64, 0
    while least > 1 and held + bits.get(least - 1, 0) <= frequent:
        least -= 1
        held += bits.get(least, 0)
    often = counts.filter(F.length(F.bin("n")) >= least).select("pair", "n").toArrow()
    order = np.argsort(often["pair"].to_numpy())
    sent = spark.sparkContext.broadcast((often["pair"].to_numpy()[order].astype(dtype), often["n"].to_numpy()[order], best))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in slices(batches):
            data = [np.frombuffer(x.as_buffer(), dtype) for x in batch.column("links")]
            found, total, rare = [], [], []
            for links in data:
                mine, times = np.unique(links, return_counts=True)
                at = np.minimum(np.searchsorted(pairs, mine), max(len(pairs) - 1, 0))
                hit = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
                count = n[at[hit]]
                found.append(int(times[hit][count == best[(mine[hit] % width).astype(np.int64)]].sum()))
                total.append(int((count * times[hit]).sum()))
                rare.append([{"pair": int(p), "times": int(t)} for p, t in zip(mine[~hit], times[~hit], strict=True)])
            kind = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.int64()), pa.array(total, pa.int64()), pa.array(rare, kind)], names=[*kept, "n_best", "count_sum", "rare"])

    kept = [c for c in rows.columns if c != "links"]
    judged = rows.mapInArrow(judge, f"{', '.join(f'{c} {rows.schema[c].dataType.simpleString()}' for c in kept)}, n_best long, count_sum long, rare array<struct<pair: long, times: long>>")
    if least > 1:
        judged = staged(judged, "judged")
        seldom = counts.filter(F.length(F.bin("n")) < least)
        lookup = spark.createDataFrame([(k, int(n)) for k, n in enumerate(best.tolist()) if n], "b long, most long")
        more = (
            judged.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.times").join(seldom, "pair").join(F.broadcast(lookup), "b")
            .groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
        )
        judged = judged.join(more, "row", "left")
        judged = judged.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return judged.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
