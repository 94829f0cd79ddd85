"""Quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import maybe_broadcast, ship, slices, staged

#: Byte pairs are hashed into so many features of the text view.
PAIR_BITS = 9
LANGS, SOURCES, SIZES = 16, 64, 24


def text_view(text: str | None) -> np.ndarray:
    """Root shares of hashed byte pairs, then word and character shares of the whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros((1 << PAIR_BITS) + 8)
    if len(raw) > 1:
        code = (raw[:-1].astype(np.uint32) << np.uint32(8) | raw[1:]) * np.uint32(2654435761) >> np.uint32(32 - PAIR_BITS)
        out[: 1 << PAIR_BITS] = np.sqrt(np.bincount(code, minlength=1 << PAIR_BITS) / len(code))
    words = text.split()
    if words:
        seen = np.bincount(raw, minlength=256) / len(raw)
        letters = seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum()
        out[1 << PAIR_BITS :] = (
            np.log1p(len(words)) / 10,
            len(set(words)) / len(words),
            sum(map(operator.eq, words, words[1:])) / len(words),
            seen[65:91].sum() / max(letters, 1e-9),
            seen[48:58].sum(),
            1 - letters - seen[48:58].sum() - seen[9:14].sum() - seen[32],
            seen[128:].sum(),
            len(raw) / len(words) / 20,
        )
    return out


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Language and source by hashed place, the size by its power of two, and what is missing: nothing is read from the text."""
    out = np.zeros(LANGS + SOURCES + SIZES + 4)
    if lang is not None:
        out[xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")) % LANGS] = 1
    if source is not None:
        out[LANGS + xxhash.xxh3_64_intdigest(source.encode("utf-8", "surrogatepass")) % SOURCES] = 1
    size = max(n_chars or 0, 0)
    out[LANGS + SOURCES + min(size.bit_length(), SIZES - 1)] = 1
    out[-4:] = np.log1p(size) / 10, lang is None, source is None, n_chars is None
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, bias last, by Newton steps on the ridge-penalised log-likelihood."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def prob(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


@dataclass(frozen=True)
class Views:
    """Weights of both views, their calibrations (slope, bias) and the weights that join the calibrated margins."""

    text: np.ndarray
    meta: np.ndarray
    text_fit: np.ndarray
    meta_fit: np.ndarray
    joint: np.ndarray
    held_out_accuracy: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good: by text, by metadata, joint."""
        a = margin(margin(text, self.text)[:, None], self.text_fit)
        b = margin(margin(meta, self.meta)[:, None], self.meta_fit)
        return prob(a), prob(b), prob(margin(np.column_stack([a, b]), self.joint))


def combine(weights: dict[str, np.ndarray], text: np.ndarray, meta: np.ndarray, y: np.ndarray) -> Views:
    """Both views with their calibrations and joint weights, fitted on rows that neither was trained on."""
    m = {k: margin(x, weights[k])[:, None] for k, x in (("text", text), ("meta", meta))}
    fits = {k: fit_logistic(m[k], y, ridge=0.1) for k in m}
    both = np.column_stack([margin(m[k], fits[k]) for k in ("text", "meta")])
    joint = fit_logistic(both, y, ridge=0.1)
    right = ((prob(margin(both, joint)) >= 0.5) == y).mean()
    return Views(weights["text"], weights["meta"], fits["text"], fits["meta"], joint, float(right))


def _view_rows(docs: DataFrame, ids: list[tuple[int, int | None]]) -> list[tuple[int, int | None, np.ndarray, np.ndarray]]:
    """``id, label, text view, metadata view`` of the (bounded) ``ids``, by id; of several rows of an id the least by views."""
    if not ids:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            i, text, lang, source, size = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_pydict(
                {
                    "i": pa.array(i, pa.int64()),
                    "t": pa.array([text_view(t).astype("<f4").tobytes() for t in text], pa.binary()),
                    "m": pa.array([meta_view(*r).astype("<f4").tobytes() for r in zip(lang, source, size, strict=True)], pa.binary()),
                }
            )

    wanted = docs.sparkSession.createDataFrame([(i,) for i, _ in ids], "i long")
    rows = docs.join(F.broadcast(wanted), "i").select("i", "text", "lang", "source", "n_chars").mapInArrow(run, "i long, t binary, m binary")
    label, view = dict(ids), lambda b: np.frombuffer(b, "<f4").astype(float)
    return [(r["i"], label[r["i"]], view(r["v"]["t"]), view(r["v"]["m"])) for r in sorted(rows.groupBy("i").agg(F.min(F.struct("t", "m")).alias("v")).collect())]


def _margins(pool: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """``i, text, meta``: both views' margins of every row of the pool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                i, text, lang, source, size = (c.to_pylist() for c in batch.columns)
                t = np.array([text_view(x) for x in text], np.float32)
                m = np.array([meta_view(*r) for r in zip(lang, source, size, strict=True)], np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(margin(t.astype(float), weights["text"])), pa.array(margin(m.astype(float), weights["meta"]))], ["i", "text", "meta"])

    return pool.mapInArrow(run, "i long, text double, meta double")


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    named = {c: F.col(c) if c in docs.columns else F.lit(None) for c in ("lang", "source", "n_chars")}
    return docs.select(
        F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("text"), named["lang"].cast("string").alias("lang"), named["source"].cast("string").alias("source"), named["n_chars"].cast("long").alias("n_chars")
    )


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, rounds: int = 3, take: int = 200, sure: float = 0.95, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> Views | None:
    """Train both views in rounds; None where the labels that have a document are of one class.

    The first fit is on at most ``sample`` labelled documents (least hash of the id), of which every fourth is held out. In each of ``rounds`` both
    views judge every document with an id but no label; each hands the other one its surest ones (probability at least ``sure``), about ``take``
    for a class in the labels' proportion, as pseudo-labels. The held-out documents then calibrate each view by a logistic fit of its
    margin, and weigh the two calibrated margins.

    Rows without id or label don't count; of an id with several labels the least one holds; an id with several texts counts once. Null
    texts are empty ones.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("long").alias("y")).filter("i is not null and y is not null").groupBy("i").agg(F.min("y").alias("y"))
    base = _columns(docs, id_col, text_col).filter("i is not null")
    # At most `sample` rows; Spark takes them as a top-k, not by a full sort.
    some = known.join(base.select("i").distinct(), "i", "left_semi").orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(sample)
    rows = _view_rows(base, [tuple(r) for r in some.collect()])
    y = np.array([r[1] for r in rows])
    held = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        return None
    view = {"text": np.array([r[2] for r in rows]), "meta": np.array([r[3] for r in rows])}
    sets = {k: (x[~held], y[~held]) for k, x in view.items()}
    given: dict[str, set[int]] = {"text": set(), "meta": set()}
    pool = base.join(maybe_broadcast(staged(known.select("i"), "labelled")), "i", "left_anti")
    least = float(np.log(sure / (1 - sure)))
    for turn in range(rounds + 1):
        weights = {k: fit_logistic(*sets[k]) for k in sets}
        if turn == rounds:
            break
        judged = staged(_margins(pool, weights).groupBy("i").agg(F.max("text").alias("text"), F.max("meta").alias("meta")), "margins")
        more = {}
        for giver, taker in (("text", "meta"), ("meta", "text")):
            new = judged.join(F.broadcast(spark.createDataFrame([(i,) for i in given[taker]], "i long")), "i", "left_anti")
            for label in (0, 1):
                certain = F.col(giver) if label else -F.col(giver)
                most = int(np.ceil(2 * take * (y[~held] == label).mean()))
                chosen = new.select("i", certain.alias("c")).filter(F.col("c") >= least).orderBy(F.desc("c"), "i").limit(most)
                more[taker] = more.get(taker, []) + [(r["i"], label) for r in chosen.collect()]
        if not any(more.values()):
            break
        found = {r[0]: r for r in _view_rows(base, sorted({(i, None) for ids in more.values() for i, _ in ids}))}
        for taker, ids in more.items():
            if ids:
                x, t = sets[taker]
                sets[taker] = np.vstack([x, *(found[i][2 if taker == "text" else 3][None] for i, _ in ids)]), np.concatenate([t, [label for _, label in ids]])
                given[taker] |= {i for i, _ in ids}
    return combine(weights, view["text"][held], view["meta"][held], y[held])


def score(docs: DataFrame, model: Views | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus ``p_text, p_meta, score`` (doubles) and ``good`` (score at least ``threshold``).

    Without a model every score is null and every row good. Null text counts as empty; missing
    metadata columns as null. Existing columns of these names are replaced.
    """
    ship(docs.sparkSession)
    added = ("p_text", "p_meta", "score", "good")
    docs = docs.drop(*added)
    if model is None:
        return docs.select("*", *[F.lit(None).cast("double").alias(c) for c in added[:3]], F.lit(True).alias("good"))
    # Texts go to Python once: a view's columns are taken from the row where it has them, else added as nulls.
    wanted = {text_col: "string", "lang": "string", "source": "string", "n_chars": "long"}
    view = docs.select("*", *[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(f"__{c}") for c, k in wanted.items() if c != text_col])
    width, at = len(docs.columns), [docs.columns.index(text_col), *range(len(docs.columns), len(docs.columns) + 3)]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added[:3]], T.StructField("good", T.BooleanType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            text, lang, source, size = (batch.column(k).to_pylist() for k in at)
            p = model.score(np.array([text_view(t) for t in text]), np.array([meta_view(*r) for r in zip(lang, source, size, strict=True)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(x, pa.float64()) for x in p), pa.array(p[2] >= threshold)], names)

    return view.mapInArrow(run, schema)
