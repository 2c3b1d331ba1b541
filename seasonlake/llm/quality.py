"""Document quality as an ordinal regression on graded ratings.

Cumulative links share one weight vector: with score e(x) and ordered thresholds,
P(grade <= k) = sigmoid(threshold_k - e(x)). The score is a sum of hashed weights over what
occurs in a text: its words, their first four and last three bytes, and the class of a few
shares (capitals, digits, signs, repeated words, length). From the tail probabilities come
the expected grade and the probability of at least a wanted grade, by which rows are kept.

Fitting uses at most ``train_rows`` rated documents, the first by a hash of their id.
Scoring reads every document whole, in one pass and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonlake.llm.common import batches
from seasonlake.llm.words import BASE, BYTE, SPACE, mix, utf8

BITS = 20
BATCH_BYTES = 1 << 19
U64 = np.uint64
_SALTS = mix(np.arange(1, 16, dtype=U64))
SHARES = 6
STEPS = 12


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bins, offsets): the distinct feature bins of each text, one run after another."""
    data, offsets = utf8(column)
    rows = len(offsets) - 1
    seen = ~SPACE[data]
    begins = seen.copy()
    begins[1:] &= ~seen[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = seen[inner]
    starts = np.flatnonzero(begins)
    found = [np.zeros(0, np.int64)]
    word_row = np.searchsorted(offsets, starts, side="right") - 1
    words_of = np.bincount(word_row, minlength=rows)
    distinct_of = np.zeros(rows)
    if len(starts):
        kept = data[seen]
        begin = np.flatnonzero(begins[seen])
        sizes = np.diff(np.append(begin, len(kept)))
        place = np.arange(len(kept)) - np.repeat(begin, sizes)
        power = np.ones(int(sizes.max()), dtype=U64)
        power[1:] = BASE
        power = np.cumprod(power, dtype=U64)
        letters = BYTE[kept]
        parts = letters * power[place]
        tail = np.repeat(sizes, sizes) - 1 - place
        last = np.where(tail < 3, letters * power[np.minimum(tail, 2)], U64(0)) if len(power) > 2 else parts
        for salt, values in ((0, parts), (1, np.where(place < 4, parts, U64(0))), (2, last)):
            hashes = mix(np.add.reduceat(values, begin) ^ _SALTS[salt])
            found.append((word_row << BITS) | (hashes >> U64(64 - BITS)).astype(np.int64))
            if salt == 0:
                distinct_of = np.bincount(np.unique(found[-1]) >> BITS, minlength=rows)
    sums = np.zeros((5, len(data) + 1), dtype=np.int64)
    for i, mask in enumerate((
        (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), seen & (data < 128) & ~_ALNUM[data], seen, data == 10,
    )):
        np.cumsum(mask, out=sums[i, 1:])
    counts = sums[:, offsets[1:]] - sums[:, offsets[:-1]]
    visible = np.maximum(counts[3], 1)
    shares = [
        counts[0] / visible, counts[1] / visible, counts[2] / visible,
        1 - distinct_of / np.maximum(words_of, 1), counts[4] / np.maximum(words_of, 1),
    ]
    classes = [np.ceil(np.sqrt(s) * STEPS).astype(np.int64) for s in shares]
    classes.append(np.log2(words_of + 1).astype(np.int64))
    for i, c in enumerate(classes):
        hashes = mix(c.astype(U64) ^ _SALTS[4 + i])
        found.append((np.arange(rows) << BITS) | (hashes >> U64(64 - BITS)).astype(np.int64))
    every = np.unique(np.concatenate(found))
    return (every & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(every, np.arange(rows + 1) << BITS)


_ALNUM = np.zeros(256, dtype=bool)
for _a, _b in ((48, 57), (65, 90), (97, 122)):
    _ALNUM[_a : _b + 1] = True


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, bins: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Every text has some feature, so no run is empty."""
        return np.add.reduceat(self.weights[bins], offsets[:-1]) if len(offsets) > 1 else np.zeros(0)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -50, 50)))


def fit(
    bins: list[np.ndarray], grades: np.ndarray, levels: int, steps: int = 4000, batch: int = 128,
    rate: float = 0.5, shrink: float = 5e-4, start: float = 0.1, least_documents: int = 20, seed: int = 5,
) -> OrdinalModel:
    """Maximum likelihood by AdaGrad with soft-thresholded weights.

    The number of steps is the same for every sample size. A feature of fewer than
    ``least_documents`` rated documents teaches nothing general and keeps the weight 0.
    Thresholds are kept in order as a first one and positive gaps. With one grade or no
    rows at all the model is that of the counts alone.
    """
    counts = np.bincount(grades, minlength=levels) + 0.5
    above = counts[::-1].cumsum()[::-1][1:] / counts.sum()
    thresholds = np.log((1 - above) / above)
    weights = np.zeros(1 << BITS)
    squares = np.full(1 << BITS, start)
    if not len(grades):
        return OrdinalModel(weights, thresholds)
    common = np.bincount(np.concatenate(bins), minlength=1 << BITS) >= least_documents
    bins = [b[common[b]] for b in bins]
    rng = np.random.default_rng(seed)
    free = np.append(thresholds[0], np.log(np.maximum(np.diff(thresholds), 1e-3)))
    free_squares = np.full(len(free), 1e-3)
    for _ in range(-(-steps * batch // len(grades))):
        order = rng.permutation(len(grades))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            sizes = [len(bins[i]) for i in some]
            flat = np.concatenate([bins[i] for i in some])
            owner = np.repeat(np.arange(len(some)), sizes)
            gaps = np.exp(free[1:])
            edge = free[0] + np.append(0, np.cumsum(gaps))
            score = np.bincount(owner, weights[flat], len(some))
            y = grades[some]
            # P(y) = upper - lower with the outer edges at 1 and 0
            upper = 1 / (1 + np.exp(-np.clip(np.append(edge, np.inf)[y] - score, -40, 40)))
            lower = np.where(y > 0, 1 / (1 + np.exp(-np.clip(edge[np.maximum(y - 1, 0)] - score, -40, 40))), 0)
            chance = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
            grad = du - dl  # of the loss by the score
            touched, at_touched = np.unique(flat, return_inverse=True)
            step = np.bincount(at_touched, grad[owner]) / len(some)
            squares[touched] += step**2
            pace = rate / np.sqrt(squares[touched])
            moved = weights[touched] - pace * step
            weights[touched] = np.sign(moved) * np.maximum(np.abs(moved) - pace * shrink, 0)
            edge_grad = np.zeros(levels)
            np.add.at(edge_grad, y, -du * (y < levels - 1))
            np.add.at(edge_grad, y[y > 0] - 1, dl[y > 0])
            edge_grad = edge_grad[:-1] / len(some)
            free_grad = edge_grad[::-1].cumsum()[::-1]
            free_grad[1:] *= gaps
            free_squares += free_grad**2
            free -= 0.1 * free_grad / np.sqrt(free_squares)
    return OrdinalModel(weights, free[0] + np.append(0, np.cumsum(np.exp(free[1:]))))


def rated_sample(
    documents: DataFrame, ratings: DataFrame, train_rows: int
) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature bins and grades of at most ``train_rows`` rated documents."""
    chosen = (
        ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole, BATCH_BYTES, "text"):
                bins, offsets = features(part.column("text"))
                packed = [bins[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("grade"), pa.array(packed, pa.binary())],
                    ["doc_id", "grade", "bins"],
                )

    # the sample is bounded by train_rows, so it may go to every task
    rows = documents.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")
    found = rows.mapInArrow(run, "doc_id long, grade int, bins binary").dropDuplicates(["doc_id"]).collect()
    found.sort(key=lambda r: r["doc_id"])
    grades = np.array([r["grade"] for r in found], dtype=np.int64)
    return [np.frombuffer(r["bins"], np.int32) for r in found], grades


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 poor, 1 good but toxic, 2 good and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), 2
    )
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade"))


def score_documents(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    levels: int = 3, wanted: int = 2, least: float = 0.5, train_rows: int = 8000,
) -> DataFrame:
    """(row, expected_grade, tail, keep): every document with its columns in ``row``.

    ``tail`` is P(grade >= wanted) and a document is kept when it reaches ``least``. Null
    and empty texts have no words and are rated by their shape alone; a label with a null,
    and labels without a document, teach nothing; of repeated labels of a document one
    counts; with no labels every document has the even odds of its grades. Repeated
    documents get equal scores; no column name clashes, as the columns stay in ``row``.
    """
    narrow = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bins, grades = rated_sample(narrow, grades_of(labels), train_rows)
    model = fit(bins, grades, levels)
    sent = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        fitted = OrdinalModel(weights.astype(np.float64), thresholds)
        for whole in parts:
            for part in batches(whole, BATCH_BYTES, "text"):
                tails = fitted.tails(fitted.scores(*features(part.column("text"))))
                chosen = tails[:, wanted - 1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(tails.sum(axis=1)), pa.array(chosen), pa.array(chosen >= least)],
                    ["row", "expected_grade", "tail", "keep"],
                )

    shaped = documents.select(F.struct(*documents.columns).alias("row"), F.col(text).alias("text"))
    kind = shaped.schema["row"].dataType.simpleString()
    return shaped.mapInArrow(run, f"row {kind}, expected_grade double, tail double, keep boolean")
