"""Cross-entropy difference of matched target and background bigram models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, mix64, ship, slices, staged

#: A word is in the vocabulary if it is at least one in so many words (and occurs twice); so are at most so many words.
VOCABULARY = 1 << 18
#: A pair that is at least one in so many is looked up where the text is; so are at most so many pairs.
HOT_PAIRS = 200_000
#: Pseudo-count with which a word's own share backs up its share after the word before.
BACKED = 8.0
#: Words counted at a time in a task.
AT_ONCE = 500_000
#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 256


def words_of(text: str | None) -> list[str]:
    """Lower-cased, between white space."""
    return (text or "").lower().split()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and a 64-bit hash of each of all their words' UTF-8 bytes.

    Eight bytes at a time are mixed in, for all words at once, after the length; so words of up to eight bytes and one length never share a hash.
    """
    each = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in each], np.int64)
    joined = " ".join(" ".join(w) for w in each if w).encode("utf-8", "surrogatepass")
    if not joined:
        return sizes, np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
    size = end - begin
    eight = np.ndarray(len(joined) + 1, "<u8", joined + bytes(8), strides=(1,))  # the eight bytes from each byte on
    out = mix64(size)
    which = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        which = which[size[which] > at]
        if not len(which):
            break
        left = np.minimum(size[which] - at, 8)
        chunk = eight[begin[which] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - left)).astype(np.uint64))
        out[which] = mix64(out[which] ^ chunk) + np.uint64(at + 1)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(joined[begin[i] : end[i]])
    return sizes, out.view(np.int64)


def portions(texts: list[str | None], most: int = 1 << 22) -> Iterator[list[str | None]]:
    """Neighbouring texts of at most so many characters together, or one text."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


@dataclass(frozen=True)
class Vocabulary:
    """Hashes in order, and both models' counts, by word number; number 0 is every other word."""

    names: np.ndarray
    counts: np.ndarray  # two rows: target, background

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        return np.where(self.names[at] == hashes, at + 1, 0)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """``ids`` where words repeat: each distinct one is looked up once."""
        distinct, which = np.unique(hashes, return_inverse=True)
        return self.ids(distinct)[which]

    def pair(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        return before * (len(self.names) + 1) + words

    @property
    def totals(self) -> np.ndarray:
        return self.counts.sum(axis=1)

    @property
    def scale(self) -> np.ndarray:
        """Matched: the background's counts are scaled to the target's size, so that both back off alike."""
        target, background = self.totals
        return np.array([1.0, target / background if target and background else 1.0])

    def loss(self, side: int, words: np.ndarray, before: np.ndarray, joint: np.ndarray, own: np.ndarray, own_word: np.ndarray, own_before: np.ndarray) -> np.ndarray:
        """Negative natural log of the words' probabilities after the words before (-1: none).

        ``joint`` is how often the pairs occur; ``own``, ``own_word`` and ``own_before`` are the counts of all words, of the word
        and of the word before in the text itself, left out of what the model knows (as they are of ``joint``).
        """
        scale, count = self.scale[side], self.counts[side]
        share = (np.maximum(count[words] - own_word, 0) * scale + 1 / (len(self.names) + 1)) / (np.maximum(self.totals[side] - own, 0) * scale + 1)
        seen = np.where(before < 0, 0, np.maximum(count[np.maximum(before, 0)] - own_before, 0)) * scale
        joint = joint * scale
        return -np.log((joint + BACKED * share) / (np.maximum(seen, joint) + BACKED))


def _counted(keys: list[np.ndarray], sides: list[bool]) -> pa.RecordBatch:
    """``key, target, background`` of the distinct keys of texts that are of the target or not."""
    both = [np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, s in zip(keys, sides, strict=True) if s == side)]), return_counts=True) for side in (True, False)]
    names = np.concatenate([k for k, _ in both])
    none = [np.zeros(len(n), np.int64) for _, n in both]
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([both[0][1], none[1]])), pa.array(np.concatenate([none[0], both[1][1]]))], ["key", "target", "background"])


def _counts(docs: DataFrame, keys_of) -> DataFrame:
    """``key, target, background``: how often each key of ``keys_of()(texts)``, an array a text, occurs over all rows of ``docs`` (``text, is_target``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, keys, sides, held = keys_of(), [], [], 0
        for batch in slices(batches):
            sided = iter(batch.column(1).to_pylist())
            for texts in portions(batch.column(0).to_pylist()):
                got = of(texts)
                keys += got
                sides += [bool(next(sided)) for _ in texts]
                held += sum(map(len, got))
                if held >= AT_ONCE:
                    yield _counted(keys, sides)
                    keys, sides, held = [], [], 0
        if held:
            yield _counted(keys, sides)

    each = docs.select("text", "is_target").mapInArrow(run, "key long, target long, background long")
    return each.groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def vocabulary(docs: DataFrame, most: int = VOCABULARY) -> Vocabulary:
    """The words of ``docs`` (``text, is_target``) that are at least one in ``most`` and occur twice, with exact counts."""

    def hashes():
        def of(texts: list[str | None]) -> list[np.ndarray]:
            sizes, words = word_hashes(texts)
            return np.split(words, np.cumsum(sizes)[:-1])

        return of

    counted = staged(_counts(docs, hashes), "words")
    total = np.array([int(x or 0) for x in counted.agg(F.sum("target"), F.sum("background")).first()], float)
    least = max(2, -(-int(total.sum()) // most))
    kept = counted.filter(F.col("target") + F.col("background") >= least).toArrow().sort_by("key")  # at most ``most`` rows
    names, *sides = (kept.column(k).to_numpy() for k in range(3))
    known = np.stack([s.astype(float) for s in sides])
    return Vocabulary(names, np.hstack([(total - known.sum(axis=1))[:, None], known]))


def pair_counts(docs: DataFrame, shared) -> DataFrame:
    """``key, target, background``: how often each pair of words in a row occurs (the vocabulary is broadcast in ``shared``)."""

    def pairs():
        words = shared.value

        def of(texts: list[str | None]) -> list[np.ndarray]:
            sizes, hashes = word_hashes(texts)
            each = np.split(words.numbers(hashes), np.cumsum(sizes)[:-1])
            return [words.pair(w[:-1], w[1:]) for w in each]

        return of

    return _counts(docs, pairs)


def _own(groups: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the distinct (group, key), which of them each entry is, and their counts."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = keys.min()
    _, place, which, n = np.unique(groups * (keys.max() - least + 1) + (keys - least), return_index=True, return_inverse=True, return_counts=True)
    return place, which, n


_ROWS = "doc_id long, th long, key long, side int, n int, own long, own_word int, own_before int, losses_t double, losses_b double"


def _text_rows(docs: DataFrame, shared, hot) -> DataFrame:
    """One row for each text, with its losses as if no pair but the hot ones were known, and one for each other distinct pair.

    A text's row has a key below 0, by its hash, so that it goes along with the pairs and matches none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (hot_keys, hot_counts) = shared.value, hot.value
        for batch in slices(batches):
            ids, th = batch.column(0), batch.column(1)
            sides = np.array([0 if x else 1 for x in batch.column(3).to_pylist()], np.int64)
            sizes, hashes = word_hashes(batch.column(2).to_pylist())
            each = range(len(sizes))
            doc = np.repeat(np.arange(len(each)), sizes)
            w = words.numbers(hashes)
            before = np.concatenate([[-1], w[:-1]])[: len(w)]
            starts = (np.cumsum(sizes) - sizes)[sizes > 0]
            before[starts] = -1
            # How often a text itself has a word, the word before, and the pair.
            _, which, n = _own(doc, w)
            own_word = n[which]
            own_before = np.where(before < 0, 0, np.concatenate([[0], own_word[:-1]])[: len(w)])
            key = np.where(before < 0, -1, words.pair(before, w))
            place, which, n = _own(doc, key)
            own_pair = n[which]
            at = np.minimum(np.searchsorted(hot_keys, key), max(0, len(hot_keys) - 1))
            is_hot = (hot_keys[at] == key) if len(hot_keys) else np.zeros(len(key), bool)
            sums = []
            for side in range(2):
                mine = sides[doc] == side
                joint = np.zeros(len(key))
                joint[is_hot] = np.maximum(hot_counts[side][at[is_hot]] - np.where(mine, own_pair, 0)[is_hot], 0)
                loss = words.loss(side, w, before, joint, *(np.where(mine, x, 0) for x in (sizes[doc], own_word, own_before)))
                sums.append(np.bincount(doc, weights=loss, minlength=len(each)).astype(float))
            spread = -1 - (th.to_numpy(zero_copy_only=False) & np.int64(0x7FFFFFFFFFFFFFFF))
            yield pa.RecordBatch.from_arrays(
                [ids, th, pa.array(spread), *(pa.array(np.zeros(len(each), np.int64), pa.int32()) for _ in range(2)), pa.array(sizes), *(pa.array(np.zeros(len(each), np.int64), pa.int32()) for _ in range(2)), pa.array(sums[0]), pa.array(sums[1])],
                [x.split()[0] for x in _ROWS.split(", ")],
            )
            place = place[(key[place] >= 0) & ~is_hot[place]]
            d, zero = doc[place], np.zeros(len(place))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(d)),
                    th.take(pa.array(d)),
                    pa.array(key[place]),
                    pa.array(sides[d], pa.int32()),
                    pa.array(own_pair[place], pa.int32()),
                    pa.array(sizes[d]),
                    *(pa.array(x[place], pa.int32()) for x in (own_word, own_before)),
                    pa.array(zero),
                    pa.array(zero),
                ],
                [x.split()[0] for x in _ROWS.split(", ")],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text", "is_target").mapInArrow(run, _ROWS)


def _corrected(rows: DataFrame, shared) -> DataFrame:
    """``doc_id, th, own, texts, losses_t, losses_b``: rows of texts as they are, those of pairs as what their counts change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            key, side, n, own, own_word, own_before, *losses, target, background = (c.to_numpy(zero_copy_only=False) for c in batch.columns[2:])
            text = key < 0
            before, w = np.divmod(np.where(text, 0, key), len(words.names) + 1)
            out = []
            for s, counted in enumerate((target, background)):
                mine = side == s
                joint = np.maximum(counted - np.where(mine, n, 0), 0)
                left = [np.where(mine, x, 0) for x in (own, own_word, own_before)]
                change = words.loss(s, w, before, joint, *left) - words.loss(s, w, before, np.zeros(len(w)), *left)
                out.append(np.where(text, losses[s], change * n))
            keep = np.flatnonzero(text | (out[0] != 0) | (out[1] != 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), *(pa.array(x[keep]) for x in (own, text.astype(np.int64), *out))],
                ["doc_id", "th", "own", "texts", "losses_t", "losses_b"],
            )

    return rows.mapInArrow(run, "doc_id long, th long, own long, texts long, losses_t double, losses_b double")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, words: int = VOCABULARY, hot_pairs: int = HOT_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mean loss per word of every document under a target and a background bigram model, and target minus background.

    The target model counts all documents whose id is in ``target_ids`` (one column, the same
    name as ``id_col``), the background model all others; both have the same vocabulary,
    order and smoothing, and the background's counts are scaled to the target's size. A lower
    difference is nearer to the target. A text's own counts are left out of the model that counted it.

    The vocabulary holds the words that are at least one in ``words``, so it has a bound; all others count as one word.
    Pairs of words are counted exactly over whole texts of all documents, a table that grows with them. A pair
    that is at least one in ``hot_pairs`` (a bounded list) is looked up beside the text; all others are
    joined to the texts' distinct pairs, and what they change in a text's losses is summed.

    Rows of one id, or without id, are told apart by a 64-bit hash of the text and its number of words.
    Texts without words (null, empty, white space) have 0 words and null losses. Null ids are background. Each row of a
    repeated id is scored by its own text. An empty table gives no rows; with no target document all words are new to the
    target model alike.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wanted = target_ids.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("is_target", F.lit(True))
    rows = rows.join(maybe_broadcast(staged(wanted, "target")), "doc_id", "left")
    known = vocabulary(rows, words)
    shared = spark.sparkContext.broadcast(known)
    # A pair that one text has once is left out where it is scored, so it changes nothing.
    pairs = staged(pair_counts(rows, shared).filter("target + background > 1"), "pairs")
    least = max(2, -(-int(known.totals.sum()) // hot_pairs))
    often = pairs.filter(F.col("target") + F.col("background") >= least).toArrow().sort_by("key")  # at most ``hot_pairs`` rows
    hot = spark.sparkContext.broadcast((often.column(0).to_numpy(), [often.column(k).to_numpy() for k in (1, 2)]))
    seldom = pairs.filter(F.col("target") + F.col("background") < least)
    met = _text_rows(rows, shared, hot).join(seldom, "key", "left").select(*[x.split()[0] for x in _ROWS.split(", ")], *(F.coalesce(c, F.lit(0)).alias(c) for c in ("target", "background")))
    sums = _corrected(met, shared).groupBy("doc_id", "th", F.col("own").alias("n_words")).agg(*(F.sum(c).alias(c) for c in ("texts", "losses_t", "losses_b")))
    # Rows of one id and text were summed together; each has the same result.
    mean = lambda c: F.when(F.col("n_words") > 0, F.col(c) / (F.col("n_words") * F.col("texts")))
    each = sums.select("doc_id", "n_words", mean("losses_t").alias("target_loss"), mean("losses_b").alias("background_loss"), F.explode(F.expr("sequence(1, texts)")).alias("one"))
    return each.select("doc_id", "n_words", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("difference"))
