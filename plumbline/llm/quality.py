"""Quality classifier: naive Bayes support vectors on n-gram indicators.

A text is the set of its byte 2-grams and 4-grams and of its word-shape unigrams and bigrams (case, length, final
marks and whether a word repeats the one before), each hashed to one of ``DIMENSIONS`` places. Indicators are scaled
by the log ratio of their rates in the two classes and brought to unit length; a linear hinge-loss model with
balanced classes is fitted on them by dual coordinate descent. A score is the logistic function of the margin.

Labels come only from rows whose crc32(doc_id as text) mod 3 is not 1. The model is fitted on at most ``MAX_TRAIN``
of these, the smallest by a hash of doc_id and then by doc_id, and as many of them in this order as hold at most
``MAX_PLACES`` places together (one at least), which bounds the rows and the bytes that the driver gathers; every document
is scored on its whole text, in one pass without a shuffle.

Defined results: null text counts as empty; empty texts get the score of an empty set (the bias); without labels of
both classes every score is 0.5; a doc_id with several labels counts as its smallest; null doc_ids are scored and
held out or not as the text ``null`` is; repeated rows are kept; empty tables give no rows; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.codec import release, text_blocks
from plumbline.llm.common import small_batches, table, written

MAX_TRAIN, MAX_PLACES = 4_000, 16_000_000
DIMENSIONS = 1 << 18
HALF = DIMENSIONS >> 1
GRAMS = (2, 4)
EPOCHS, COST, SMOOTHING, SLOPE = 8, 1.0, 1.0, 3.0
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return (h ^ (h >> np.uint64(32))) & np.uint64(HALF - 1)


def shape(word: str) -> str:
    case = "A" if word.isupper() and len(word) > 1 else "T" if word[:1].isupper() else "a" if word[:1].isalpha() else "0" if word[:1].isdigit() else word[:1]
    return case + ("z" if word[-1:].isalpha() else word[-2:]) + str(min(3, len(word) // 4))


class Features:
    """Sorted distinct places of each text of an Arrow array."""

    def __init__(self, limit: int = 200_000):
        release()
        self.shapes: dict[str, int] = {}
        self.limit = limit
        self.seen = np.zeros(DIMENSIONS, bool)

    def _shape(self, word: str) -> int:
        if (h := self.shapes.get(word)) is None:
            h = zlib.crc32(shape(word).encode())
            if len(self.shapes) < self.limit:
                self.shapes[word] = h
        return h

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for _, block in text_blocks(texts):
            words = pc.split_pattern(pc.replace_substring(pc.replace_substring(block, "\n", " "), "\t", " "), " ")
            codes = words.flatten().dictionary_encode()
            shapes = np.fromiter(map(self._shape, codes.dictionary.to_pylist()), np.uint64, len(codes.dictionary))
            code = codes.indices.to_numpy(zero_copy_only=False)
            offsets = words.offsets.to_numpy()
            empty = pc.equal(codes.dictionary, "").to_numpy(zero_copy_only=False)
            for i, text in enumerate(block):
                yield self.one(text.as_py().encode(), code[offsets[i] : offsets[i + 1]], shapes, empty)

    def one(self, data: bytes, code: np.ndarray, shapes: np.ndarray, empty: np.ndarray) -> np.ndarray:
        seen = self.seen
        b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint64)
        if data:
            for n in GRAMS:
                if len(b) >= n:
                    h = np.full(len(b) - n + 1, n, np.uint64)
                    for i in range(n):
                        h = (h << np.uint64(8)) | b[i : len(b) - n + 1 + i]
                    seen[_mix(h * _MIX)] = True
        code = code[~empty[code]] if len(code) else code
        if len(code):
            s = shapes[code]
            s = s + (np.concatenate([[False], code[1:] == code[:-1]]).astype(np.uint64) << np.uint64(33))
            before = np.concatenate([np.array([7], np.uint64), s[:-1]])
            seen[HALF + _mix(s * _MIX).astype(np.int64)] = True
            seen[HALF + _mix((s + before * np.uint64(0x100000001B3)) * _MIX).astype(np.int64)] = True
        out = np.flatnonzero(seen)
        seen[out] = False
        return out


@dataclass
class Model:
    """Margin of a set of places: bias + sum of weight * ratio over the length of the ratios."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    fitted: bool = True

    def score(self, places: np.ndarray) -> float:
        if not self.fitted:
            return 0.5
        v = self.ratio[places]
        m = self.bias + float(self.weight[places] @ v) / max(1e-9, float(np.sqrt(v @ v)))
        return float(1 / (1 + np.exp(-np.clip(SLOPE * m, -30, 30))))


def fit(sets: list[np.ndarray], labels: list[int]) -> Model:
    y = np.array(labels) * 2.0 - 1
    positive, negative = int((y > 0).sum()), int((y < 0).sum())
    if not positive or not negative:
        return Model(np.zeros(0, np.float32), np.zeros(0, np.float32), 0.0, False)
    rates = {s: np.full(DIMENSIONS, SMOOTHING) for s in (1.0, -1.0)}
    for x, s in zip(sets, y, strict=True):
        rates[s][x] += 1
    ratio = np.log(rates[1.0] / (positive + 2 * SMOOTHING)) - np.log(rates[-1.0] / (negative + 2 * SMOOTHING))
    values = [ratio[x] / max(1e-9, float(np.linalg.norm(ratio[x]))) for x in sets]
    most = np.where(y > 0, COST * len(y) / (2 * positive), COST * len(y) / (2 * negative))
    weight, bias, alpha, rng = np.zeros(DIMENSIONS), 0.0, np.zeros(len(y)), np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            x, v = sets[i], values[i]
            gradient = y[i] * (weight[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1), 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weight[x] += step * v
                bias, alpha[i] = bias + step, new
    return Model(ratio.astype(np.float32), weight.astype(np.float32), float(bias))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, most_places: int = MAX_PLACES) -> Model:
    """Fits on at most ``most`` labelled rows of ``most_places`` places that are not held out."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out())
    # Only ids that are there; a doc_id that stands in several rows counts once.
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for b in batches:
            sets = [x.astype("<u4").tobytes() for x in made.batch(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sets, pa.binary())], ["doc_id", "quality", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {kind}, quality {labels.schema['quality'].dataType.simpleString()}, places binary")
    got = written(got, "labelled-places")
    held, cut = 0, None
    for r in sorted(got.select(F.xxhash64("doc_id").alias("at"), "doc_id", F.octet_length("places").alias("size")).collect()):
        held += r["size"] // 4
        if cut is not None and held > most_places:
            break
        cut = r["at"]
    got = (got.where(F.xxhash64("doc_id") <= F.lit(cut)) if cut is not None else got).toArrow()
    once = {}
    for doc, quality, places in zip(*(c.to_pylist() for c in got.columns), strict=True):
        once[doc] = min(once.get(doc, (places, quality)), (places, quality))
    order = sorted(once)
    return fit([np.frombuffer(once[d][0], "<u4").astype(np.int64) for d in order], [int(once[d][1] > 0) for d in order])


def score_documents(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with a score and a prediction, in place of columns of these names."""
    docs = small_batches(docs.drop(score, predicted))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for b in batches:
            scores = [model.score(x) for x in made.batch(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*names, score, predicted])

    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    return docs.mapInArrow(run, schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
