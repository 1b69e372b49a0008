"""Quality by ordinal regression on graded ratings.

A cumulative-link model: P(grade <= k) = sigmoid(threshold_k - w.x) with ordered
thresholds and one weight per hashed feature, shared by all grades. It gives the
expected grade of a document and the probability of reaching a grade, by which
documents are selected. Features are the words of the text and their shapes (kinds of
characters, runs joined), hashed, with damped counts scaled to a fixed length.

The model is fitted on at most ``sample_rows`` rated documents, the first by a hash of
their ids; this bounds what the driver holds. Scoring reads every text in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.near_dedup import text_chunks, word_hashes


@dataclass(frozen=True)
class OrdinalSettings:
    """``sample_rows`` bounds the rated documents that the model is fitted on."""

    bits: int = 14
    sample_rows: int = 8192
    rounds: int = 250
    step: float = 0.1
    ridge: float = 2e-4


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def reach(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) per text, for k = 1 up to the highest grade."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - score[:, None]))


# The length of a text's features: longer ones are learned in fewer rounds.
_LENGTH = 6.0
# Kinds of characters: capitals, digits, other letters; signs stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[np.arange(ord("a"), ord("z") + 1)] = ord("a")
_KIND[np.arange(ord("A"), ord("Z") + 1)] = 1
_KIND[np.arange(ord("0"), ord("9") + 1)] = ord("0")
_KIND[128:] = ord("a")


def _shape(text: bytes) -> bytes:
    kinds = _KIND[np.frombuffer(text, np.uint8)]
    if not len(kinds):
        return b""
    return kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])].tobytes()


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per feature of a text: the text's number, the feature's number, its value."""
    keys = []
    for salt, own in enumerate((texts, [_shape(t) for t in texts])):
        hashes, ends = word_hashes(own)
        text_of = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))
        with np.errstate(over="ignore"):
            mixed = (hashes + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        keys.append((text_of.astype(np.int64) << bits) | (mixed >> np.uint64(64 - bits)).astype(np.int64))
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    text_of, number = found >> bits, found & ((1 << bits) - 1)
    value = np.log1p(counts)
    length = np.sqrt(np.bincount(text_of, value * value, len(texts)))
    return text_of, number, _LENGTH * value / length[text_of]


def fit(
    text_of: np.ndarray, number: np.ndarray, value: np.ndarray, grades: np.ndarray, settings: OrdinalSettings
) -> OrdinalModel:
    """Weights and thresholds by Adam on the likelihood of the grades 0..K."""
    top = max(int(grades.max(initial=0)), 1)
    n = max(len(grades), 1)
    # Thresholds are the first one and the logarithms of the steps to the next.
    start = np.array([(grades < k).mean() if len(grades) else 0.5 for k in range(1, top + 1)]).clip(0.01, 0.99)
    logits = np.log(start / (1 - start))
    steps = np.log(np.maximum(np.diff(logits), 0.05))
    params = np.concatenate([np.zeros(1 << settings.bits), logits[:1], steps])
    first, second = np.zeros_like(params), np.zeros_like(params)
    size = 1 << settings.bits
    for t in range(1, settings.rounds + 1):
        w, widths = params[:size], np.exp(params[size + 1 :])
        thresholds = params[size] + np.concatenate([[0.0], np.cumsum(widths)])
        score = np.bincount(text_of, w[number] * value, len(grades))
        below = 1 / (1 + np.exp(score[:, None] - thresholds[None, :]))  # P(grade <= k - 1)
        padded = np.concatenate([np.zeros((len(grades), 1)), below, np.ones((len(grades), 1))], axis=1)
        rows = np.arange(len(grades))
        low, high = padded[rows, grades], padded[rows, grades + 1]
        chance = np.maximum(high - low, 1e-9)
        slope_high, slope_low = high * (1 - high) / chance, low * (1 - low) / chance
        by_score = (slope_high - slope_low) / n
        by_threshold = np.zeros(top)
        np.add.at(by_threshold, np.minimum(grades, top - 1), np.where(grades < top, -slope_high / n, 0.0))
        np.add.at(by_threshold, np.maximum(grades - 1, 0), np.where(grades > 0, slope_low / n, 0.0))
        tail = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate(
            [np.bincount(number, by_score[text_of] * value, size) + settings.ridge * w, tail[:1], tail[1:] * widths]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params = params - settings.step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    widths = np.exp(params[size + 1 :])
    return OrdinalModel(params[:size], params[size] + np.concatenate([[0.0], np.cumsum(widths)]), settings.bits)


def train(
    docs: DataFrame,
    ratings: DataFrame,
    grade: Column,
    settings: OrdinalSettings = OrdinalSettings(),
    doc_id: str = "doc_id",
    text: str = "text",
) -> OrdinalModel:
    """Fit on rated documents: ``grade`` is a whole number from 0, null where unrated.

    Of several ratings of a document the lowest counts; without any rated document
    all grades are equally likely.
    """
    rated = ratings.select(F.col(f"`{doc_id}`").alias("_rated_id"), grade.cast("int").alias("_grade"))
    rated = rated.where(F.col("_grade").isNotNull() & F.col("_rated_id").isNotNull())
    rated = rated.groupBy("_rated_id").agg(F.min("_grade").alias("_grade"))
    # At most sample_rows rows: a proven bound for the broadcast and for the driver.
    sample = rated.orderBy(F.xxhash64("_rated_id"), "_rated_id").limit(settings.sample_rows)
    named = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    joined = named.join(F.broadcast(sample), F.col("_id") == F.col("_rated_id"))
    # An id that repeats in the documents is fitted on one of its texts.
    joined = joined.groupBy("_id", "_grade").agg(F.min("_text").alias("_text")).select("_grade", "_text")
    rows = joined.mapInArrow(_featured(settings.bits), "grade int, numbers binary, weights binary").collect()
    grades = np.array([r.grade for r in rows], np.int64)
    numbers = [np.frombuffer(r.numbers, "<u4") for r in rows]
    values = [np.frombuffer(r.weights, "<f4") for r in rows]
    text_of = np.repeat(np.arange(len(rows)), [len(x) for x in numbers])
    empty = np.zeros(0)
    return fit(
        text_of.astype(np.int64),
        np.concatenate([*numbers, empty]).astype(np.int64),
        np.concatenate([*values, empty]).astype(float),
        grades,
        settings,
    )


def _featured(bits: int):
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches, 1):
            text_of, number, value = features(texts, bits)
            bounds = np.searchsorted(text_of, np.arange(len(texts) + 1))
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([number[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
                    pa.array([value[a:b].astype("<f4").tobytes() for a, b in spans], pa.binary()),
                ],
                names=["grade", "numbers", "weights"],
            )

    return featured


def score(
    docs: DataFrame,
    model: OrdinalModel,
    select_from: float = 0.6,
    grade: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, tail_probability, kept.

    The tail is the probability of ``grade`` (by default the highest) or better;
    documents are kept from ``select_from``. A null or blank text has no features and
    is given what the thresholds alone say, but is never kept. Repeated rows are
    scored alike; null ids stay; an empty table gives an empty one; other columns
    are not read.
    """
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    place = (len(model.thresholds) if grade is None else grade) - 1
    kind = named.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches, 1):
            text_of, number, value = features(texts, model.bits)
            reach = model.reach(np.bincount(text_of, model.weights[number] * value, len(texts)))
            tail = reach[:, place]
            worded = np.bincount(text_of, minlength=len(texts)) > 0
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(reach.sum(axis=1)), pa.array(tail), pa.array((tail >= select_from) & worded)],
                names=["doc_id", "expected_grade", "tail_probability", "kept"],
            )

    return named.mapInArrow(scored, f"doc_id {kind}, expected_grade double, tail_probability double, kept boolean")
