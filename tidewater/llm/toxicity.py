"""Toxicity by logistic regression with FTRL-proximal over hashed word n-grams and skip-grams.

Features are words, pairs of neighbours and pairs with one word between, each present or not, so
that a text's length doesn't matter. Each coordinate has a rate of its own, and the L1 penalty
leaves few weights other than zero: what is sent to the tasks is at most 2**bits numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_rows, remainder

#: ASCII letters in lower case, digits, and all bytes above; everything else parts words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
#: Odd 64-bit multipliers that spread the hashes.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def features(text: str | None, bits: int) -> np.ndarray:
    """Hashed coordinates, repeats included; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    h = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words)) + np.uint64(1)
    shift, (a, b, c) = np.uint64(64 - bits), _MIX
    near = (h[:-1] * b ^ h[1:]) * a
    skip = (h[:-2] * c ^ h[2:]) * a
    return np.concatenate([h * a, near, skip]) >> shift


@dataclass(frozen=True)
class Weights:
    bits: int
    bias: float
    at: np.ndarray
    value: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, dtype=np.float64)
        w[self.at] = self.value
        return w


def ftrl(rows, bits: int, alpha: float, beta: float, l1: float, l2: float):
    """Weights after one pass over (coordinates, label); coordinate 2**bits is the bias, without penalty."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weight(at):
        pull = np.where(at == bias, 0.0, l1)
        over = np.maximum(np.abs(z[at]) - pull, 0.0)
        return -np.sign(z[at]) * over / ((beta + np.sqrt(n[at])) / alpha + l2)

    for at, label in rows:
        at = np.append(at, bias)
        w = weight(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
        n[at] += g * g
    used = np.flatnonzero(z)
    return used, weight(used)


def train(
    docs: DataFrame, labels: DataFrame, bits: int = 20, sample: int = 16384, passes: int = 6,
    alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0, fold: int = 5,
) -> Weights:
    """Fit on labelled documents whose crc32(doc_id as text) mod fold is not 0.

    sample: at most so many of them, those of the smallest hash, enter; their features are made
    where the texts are, and one task passes over them. Of several labels for a document the
    largest counts; null ids and labels are ignored. Without rows every score is 0.
    """
    chosen = (
        labels.select("doc_id", F.col("toxic").cast("double").alias("label"))
        .where(F.col("label").isNotNull() & (remainder("doc_id", fold) != 0))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .withColumn("place", F.xxhash64("doc_id"))
        .orderBy("place", "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    made = map_rows(
        rows.select("place", "label", "text"),
        lambda: lambda place, label, texts: (place, label, [np.unique(features(t, bits)).astype(np.int32) for t in texts]),
        "place long, label double, at array<int>",
    ).repartition(1).sortWithinPartitions("place", "label")

    def fit(batches):
        kept = [
            (at.values.to_numpy().copy(), label)
            for b in batches
            for label, at in zip(b.column("label").to_pylist(), b.column("at"))
        ]
        at, w = ftrl((r for _ in range(passes) for r in kept), bits, alpha, beta, l1, l2)
        keep = w != 0
        yield pa.RecordBatch.from_arrays([pa.array(at[keep]), pa.array(w[keep])], names=["at", "w"])

    got = made.mapInArrow(fit, "at long, w double").toArrow()
    at, w = got.column("at").to_numpy(), got.column("w").to_numpy()
    bias = w[at == 1 << bits]
    return Weights(bits, float(bias[0]) if len(bias) else -40.0, at[at < 1 << bits], w[at < 1 << bits])


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, score): the probability of label 1 for every whole text; an empty or null one has the bias alone."""
    box = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w, bits, bias = box.value.dense(), box.value.bits, box.value.bias

        def work(keys, texts):
            out = []
            for t in texts:
                at = features(t, bits)
                at = at[w[at] != 0]
                z = bias + float(w[np.unique(at)].sum()) if len(at) else bias
                out.append(float(1 / (1 + np.exp(-np.clip(z, -700, 700)))))
            return keys, out

        return work

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, score double")


def keep_below(docs: DataFrame, weights: Weights, limit: float) -> DataFrame:
    """The rows, all columns as they are, whose score is below the limit; one pass."""
    box = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w, bits, bias = box.value.dense(), box.value.bits, box.value.bias
        most = np.log(limit / (1 - limit))
        for batch in batches:
            keep = []
            for t in batch.column("text").to_pylist():
                at = features(t, bits)
                keep.append(bias + float(w[np.unique(at[w[at] != 0])].sum()) < most)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
