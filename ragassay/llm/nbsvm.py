"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams, hashed to SIZE places: words and word pairs, and the
1- to 3-grams of word shapes (runs of one kind of character: "Aa", "A!", or "the same word
again"). Each indicator is scaled by the log-ratio of its smoothed shares in the two
classes, rows are brought to unit length, and a linear model with hinge loss is fitted to
them by dual coordinate descent. A logistic curve over the margins gives the score.

The fit takes a bounded sample: the rows of each class with the smallest hashes of their
ids, at most PER_CLASS each. It reaches the driver as bit sets, PER_CLASS * 2 * SIZE / 8
bytes at most (48 MB).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragassay.llm.common import gram_hashes, map_rows, mix, span_hashes, texts_of, words

SIZE = 1 << 16
PER_CLASS = 3000
PENALTY, SWEEPS = 1.0, 20

# kinds of bytes: others by their own value, letters as one, capitals as one, digits as one
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = ord("a")
_KIND[65:91] = ord("A")
_KIND[48:58] = ord("0")


def _shapes(text: str, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    kind = _KIND[data]
    # the capitals of two-byte Latin letters
    accented = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3))
    kind[accented] = kind[accented + 1] = ord("A")
    turn = np.ones(len(kind), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[starts] = True
    at = np.flatnonzero(turn)
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(starts), 100_000):
        part = slice(low, low + 100_000)
        a, b = first[part][0], last[part][-1]
        out[part] = span_hashes(kind[at[a:b]].astype(np.uint64), first[part] - a, last[part] - a)
    out[1:][hashes[1:] == hashes[:-1]] = 7
    return out


def features(text: str) -> np.ndarray:
    """Sorted places of the n-grams that occur in a text."""
    starts, ends, hashes = words(text)
    if not len(starts):
        return np.empty(0, np.int64)
    shapes = _shapes(text, hashes, starts, ends)
    there = np.zeros(SIZE, bool)
    kinds = [(hashes, 1), (hashes, 2), (shapes, 1), (shapes, 2), (shapes, 3)]
    for salt, (sequence, n) in enumerate(kinds, 1):
        grams = gram_hashes(sequence, n) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        there[(mix(grams) >> np.uint64(48)).astype(np.int64)] = True
    return np.flatnonzero(there)


@dataclass
class Model:
    """weight and square: coefficient and squared scale of each place."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, places: np.ndarray) -> float:
        norm = float(self.square[places].sum()) ** 0.5
        return self.bias + (float(self.weight[places].sum()) / norm if norm else 0.0)

    def score(self, places: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(places) + self.shift, -30, 30))))


def constant(score: float) -> Model:
    """The model where no two classes can be told apart."""
    none = np.zeros(SIZE, np.float32)
    odds = np.clip(np.log((score + 1e-9) / (1 - score + 1e-9)), -30, 30)
    return Model(none, none, 0.0, 1.0, float(odds))


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> Model:
    """rows: places of each text; labels: 1 or -1; weights: documents a row stands for."""
    if not len(rows) or abs(labels.sum()) == len(labels):
        return constant(0.5 if not len(rows) else float(labels[0] > 0))
    counts = {}
    for label in (1, -1):
        seen = np.ones(SIZE)
        for places in (r for r, y in zip(rows, labels, strict=True) if y == label):
            seen[places] += 1
        counts[label] = seen / seen.sum()
    ratio = np.log(counts[1] / counts[-1])
    square = ratio**2
    norms = np.array([max(square[r].sum(), 1e-12) ** 0.5 for r in rows])
    # dual coordinate descent; the bias is a further feature that is always 1
    weight, bias = np.zeros(SIZE), 0.0
    dual = np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(SWEEPS):
        worst = 0.0
        for i in order.permutation(len(rows)):
            places, y = rows[i], labels[i]
            scaled = ratio[places] / norms[i]
            gradient = y * (weight[places] @ scaled + bias) - 1
            new = min(max(dual[i] - gradient / 2, 0.0), PENALTY)  # the row's norm is 1 + 1
            if step := new - dual[i]:
                dual[i] = new
                weight[places] += step * y * scaled
                bias += step * y
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    model = Model((weight * ratio).astype(np.float32), square.astype(np.float32), float(bias), 1, 0)
    margins = np.array([model.margin(r) for r in rows])
    model.slope, model.shift = _logistic(margins, (labels + 1) / 2, weights)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Newton steps for a logistic curve, slightly ridged; targets drawn in a little."""
    y = 0.01 + 0.98 * y
    weights = weights / weights.mean()
    design = np.stack([x, np.ones_like(x)])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -30, 30)))
        slope = design @ (weights * (p - y)) + 1e-3 * beta
        curve = (design * (weights * np.maximum(p * (1 - p), 1e-6))) @ design.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def held_out(doc_id: Column | str) -> Column:
    """Documents never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit to labelled documents outside the held-out third.

    Labels that are null, neither 0 nor 1, or differ between rows of one id are left out.
    Without labels all scores are 0.5, with one class alone they are that class.
    """
    known = (
        labels.filter("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .filter((F.col("quality") == F.col("other")) & ~held_out("doc_id"))
        .select("doc_id", "quality")
    )
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = None
    for quality in (0, 1):
        part = known.filter(F.col("quality") == quality)
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # at most two times per_class ids
    rows = texts_of(docs).join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def of_row(quality: int, text: str) -> Iterator[tuple]:
        bits = np.zeros(SIZE, bool)
        bits[features(text)] = True
        yield quality, np.packbits(bits).tobytes()

    sample = map_rows(rows, "quality int, bits binary", of_row).collect()
    sample.sort(key=lambda r: (r["quality"], bytes(r["bits"])))  # rows come in any order
    places = [np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))) for r in sample]
    truth = np.array([r["quality"] for r in sample])
    drawn = {q: max(1, int((truth == q).sum())) for q in (0, 1)}
    weights = np.array([sizes[q] / drawn[q] for q in truth.tolist()])
    return fit(places, 2.0 * truth - 1, weights)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, from the whole text.

    Null and empty texts get the score of a text without features. A null doc_id is not
    held out. Repeated rows get equal scores; an empty table gives an empty result;
    further columns are not read.
    """

    def of_row(doc_id: int | None, out: bool, text: str) -> Iterator[tuple]:
        score = model.score(features(text))
        yield doc_id, out, score, int(score >= 0.5)

    rows = texts_of(docs).select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return map_rows(rows, "doc_id bigint, held_out boolean, score double, predicted int", of_row)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject, columns unchanged.

    Null and empty texts have the score of a text without features; a score of one half
    stays; repeated rows stay or go alike. An empty table gives an empty result.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([model.score(features(t or "")) >= 0.5 for t in texts]))

    return docs.mapInArrow(run, docs.schema)
