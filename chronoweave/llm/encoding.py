"""Token ids of many texts through a tokenizers file, with the ids of their runs kept for reuse."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa

from .common import mix64

#: Runs whose ids a worker keeps; beyond it the store starts anew (memory only, never results).
KEPT_RUNS = 1 << 18
#: Longer runs (bytes) are encoded where they stand and not kept.
LONGEST_KEPT = 64
#: Bytes of text cut into runs at a time.
AT_ONCE = 1 << 20

OTHER, LETTER, DIGIT, MARK, SPACE, LINE_END = range(6)
_SAFE = re.compile(rb"[A-Za-z0-9] (?=[A-Za-z0-9])")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and whether it is white space of one byte."""
    kind = np.full(256, OTHER, np.uint8)
    for b in range(0x21, 0x7F):
        kind[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK
    kind[ord("'")] = OTHER  # it opens contractions
    kind[0x20], kind[0x0A] = SPACE, LINE_END
    kind[0xC3:0xCA] = LETTER  # first bytes of U+00C0 to U+024F
    white = np.zeros(256, bool)
    white[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
    return kind, white


_KIND, _WHITE = _classes()
_WIDE_WHITE = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from U+0100 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


def cut_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs start in UTF-8 bytes, and whether each is a plain one.

    ``starts``: ascending, distinct offsets at which texts (none empty) start. Texts are cut into pieces before each space
    that follows no white space. In a piece of letters, ASCII digits and marks, its first space and single line ends only,
    every change between these starts a run (a space goes with what follows); any other piece is one run. Byte-level
    files split texts at all these places, whatever stands around.
    """
    n = len(data)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[starts] = True
    last[starts[1:] - 1] = True
    last[-1] = True
    kind, white = _KIND[data], _WHITE[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    if len(lead):
        after = data[lead + 1]
        fine = ~(((data[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((data[lead] == 0xC9) & (after > 0x8F)))
        kind[lead[~fine]] = OTHER
        kind[lead[fine] + 1] = LETTER
    if len(lead) < np.count_nonzero(data > 0xBF):
        raw = data.tobytes()
        for c in _WIDE_WHITE:
            at = raw.find(c)
            while at >= 0:
                white[at : at + len(c)] = True
                at = raw.find(c, at + 1)
    white_before, white_after = np.empty(n, bool), np.empty(n, bool)
    white_before[1:], white_after[:-1] = white[:-1], white[1:]
    white_before[first] = True
    white_after[last] = True
    space, line_end = kind == SPACE, kind == LINE_END
    cut = first | (space & ~white_before)
    odd = (kind == OTHER) | (space & (~cut | white_after)) | (line_end & (white_before | white_after))
    pieces = np.flatnonzero(cut)
    plain = ~np.logical_or.reduceat(odd, pieces)
    inside = np.zeros(n, bool)
    inside[1:] = (kind[1:] != kind[:-1]) & ~space[:-1]
    inside &= np.repeat(plain, np.diff(pieces, append=n))
    inside |= cut
    at = np.flatnonzero(inside)
    return at, np.repeat(plain, np.diff(np.searchsorted(at, pieces), append=len(at)))


class Store:
    """Ids of runs by a 64-bit hash of their bytes: open addressing over numpy arrays, so that a run costs few bytes."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.count, self.flat, self.ends = 0, np.zeros(0, self.dtype), np.zeros(1, np.int64)
        self._slots(1 << 12)

    def _slots(self, slots: int) -> None:
        self.mask, self.names, self.number = np.uint64(slots - 1), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)

    def find(self, names: np.ndarray) -> np.ndarray:
        """Each name's number, -1 where it is not known."""
        out = np.full(len(names), -1, np.int64)
        left, slot = np.arange(len(names)), names & self.mask
        while len(left):
            held = self.names[slot]
            hit = held == names[left]
            out[left[hit]] = self.number[slot[hit]]
            on = ~hit & (held != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def add(self, names: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct unknown names with their ids, one name's after the other's."""
        if 2 * (self.count + len(names)) > len(self.names):
            held = self.names != 0
            old, numbers = self.names[held], self.number[held]
            self._slots(1 << (4 * (self.count + len(names))).bit_length())
            self._place(old, numbers)
        self._place(names, np.arange(self.count, self.count + len(names)))
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.count += len(names)

    def _place(self, names: np.ndarray, numbers: np.ndarray) -> None:
        left, slot = np.arange(len(names)), names & self.mask
        while len(left):
            free = self.names[slot] == 0
            self.names[slot[free]] = names[left[free]]  # of several names for a slot the last one stays
            got = free & (self.names[slot] == names[left])
            self.number[slot[got]] = numbers[left[got]]
            left, slot = left[~got], (slot[~got] + np.uint64(1)) & self.mask


class Encoder:
    """Gives for each text what the library's own ``encode`` gives.

    Where the file is byte-level BPE without normalizer, a text's ids are those of its runs (see ``cut_runs``), each
    encoded by the library once and kept. Other files, and texts with an added token's string, go through the library whole
    (with ``added_as_text`` such a string is no token but text like any other).
    """

    def __init__(self, path: str, kept: int = KEPT_RUNS, at_once: int = AT_ONCE, added_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 0xFFFF else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.by_run = bool(
            spec["model"]["type"] == "BPE"
            and not spec.get("normalizer")
            and split.get("type") == "ByteLevel"
            and split.get("use_regex")
            and not split.get("add_prefix_space")
            and not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        self.added = [x["content"].encode() for x in spec.get("added_tokens") or []]
        if added_as_text:  # an added token's string in a text is then ordinary text
            self.tokenizer.encode_special_tokens, self.added = True, []
        self.kept, self.at_once = kept, at_once
        self.letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.by_run = self.by_run and vocabulary.keys() >= set(self.letters.values())
        if self.by_run:
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.bytes_of[list(vocabulary.values())] = [len(x) for x in vocabulary]
            self.words = Tokenizer(self.tokenizer.model)
            self.words.model._resize_cache(0)  # what it would keep is kept here
            self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(self.letters[0x0A])
            self.store = Store(self.dtype)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([x for i in ids for x in i], self.dtype), np.array([len(i) for i in ids], np.int64)

    def _spelled(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_whole`` for plain runs, many in one call: spelled as the vocabulary has them, with a line end between."""
        ids, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(runs), 2000):
            part = runs[at : at + 2000]
            text = b"\n".join(part).decode("latin-1").translate(self.letters)
            ids.append(np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype))
            # A token has as many letters as bytes, so sizes tell where runs end.
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids[-1]]), np.cumsum([len(r) for r in part])) + 1
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, names: np.ndarray, runs: list[bytes], plain: np.ndarray) -> None:
        plain = plain & np.array([r != b"\n" for r in runs])
        self.store.add(names[plain], *self._spelled([r for r, p in zip(runs, plain.tolist(), strict=True) if p]))
        self.store.add(names[~plain], *self._whole([r.decode() for r, p in zip(runs, plain.tolist(), strict=True) if not p]))

    @staticmethod
    def _names(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A 64-bit hash, never 0, of each run's bytes."""
        out, left = sizes.astype(np.uint64), np.arange(len(at))
        for k in range(int(sizes.max(initial=0))):
            left = left[sizes[left] > k]
            h = (out[left] ^ data[at[left] + k]) * _BASE
            out[left] = h ^ (h >> np.uint64(32))
        return mix64(out) | np.uint64(1)

    def _by_runs(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (none empty) that start in ``raw`` at ``starts``, and how many each has."""
        if self.store.count > self.kept:
            self.store.clear()
        data = np.frombuffer(raw, np.uint8)
        at, plain = cut_runs(data, starts)
        sizes = np.diff(at, append=len(data))
        short = sizes <= LONGEST_KEPT
        names = self._names(data, at[short], sizes[short])
        number = self.store.find(names)
        if (missed := np.flatnonzero(number < 0)).size:
            new, example = np.unique(names[missed], return_index=True)
            where = np.flatnonzero(short)[missed[example]]
            self._learn(new, [raw[a : a + n] for a, n in zip(at[where].tolist(), sizes[where].tolist(), strict=True)], plain[where])
            number[missed] = self.store.find(names[missed])
        flat, ends = self.store.flat, self.store.ends
        begin, count = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        begin[short], count[short] = ends[number], ends[number + 1] - ends[number]
        if not short.all():
            own, n = self._whole([raw[a : a + k].decode() for a, k in zip(at[~short].tolist(), sizes[~short].tolist(), strict=True)])
            begin[~short], count[~short] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate([flat, own])
        through = np.cumsum(count)
        ids = flat[np.repeat(begin - through + count, count) + np.arange(through[-1])]
        return ids, np.add.reduceat(count, np.searchsorted(at, starts))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column's texts (null: none), one after the other, and how many each has."""
        sizes = np.zeros(len(texts), np.int64)
        if not self.by_run:
            ids, sizes[:] = self._whole([t or "" for t in texts.to_pylist()])
            return ids, sizes
        texts = texts.fill_null("").cast(pa.large_string())
        begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = memoryview(texts.buffers()[2] or b"")
        out: list[np.ndarray] = []
        k = 0
        while k < len(texts):
            # As many texts as fit; a longer one is cut where a space stands between letters or digits.
            m = max(k + 1, int(np.searchsorted(begin, begin[k] + self.at_once, "right")) - 1)
            raw = bytes(data[begin[k] : begin[m]])
            at = begin[k:m] - begin[k]
            if any(x in raw for x in self.added):
                if m == k + 1:
                    ids, sizes[k:m] = self._whole([raw.decode()])
                    out.append(ids)
                    k = m
                else:  # one at a time from here
                    for one in range(k, m):
                        ids, sizes[one : one + 1] = self.flat(texts.slice(one, 1))
                        out.append(ids)
                    k = m
                continue
            lo = 0
            while len(raw) - lo > self.at_once and (cut := _SAFE.search(raw, lo + self.at_once)):
                ids, n = self._by_runs(raw[lo : cut.start() + 1], np.zeros(1, np.int64))
                out.append(ids)
                sizes[k] += n[0]
                lo = cut.start() + 1
            some = np.flatnonzero(begin[k + 1 : m + 1] - begin[k:m] > 0)
            if len(some):
                ids, n = self._by_runs(raw[lo:], np.maximum(at[some] - lo, 0))
                out.append(ids)
                sizes[k + some] += n
            k = m
        return np.concatenate(out) if out else np.zeros(0, self.dtype), sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, sizes = self.flat(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(texts) else []


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process and file, so that its runs stay known from task to task."""
    return Encoder(path)
