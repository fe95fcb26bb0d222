"""Quality by hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Tokens are runs of letters and digits and runs of other signs; n-grams are single tokens and pairs, where a pair of equal
tokens is one feature of its own, whatever the token. A text's vector has its n-gram counts over the square root of
their number; a score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import textops as T
from .common import held_out, table
from .labelled import SAMPLE, labelled_sample

#: Weights, and the parameters of the updates: learning rate, its smoothing, L1 and L2.
DIMENSIONS = 1 << 18
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.5, 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each n-gram of the texts, by row."""
    kind = np.ones(256, dtype=np.uint8)
    kind[48:58] = kind[65:91] = kind[97:123] = kind[128:] = 2
    kind[[9, 10, 11, 12, 13, 32]] = 0
    k = kind[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    change = np.r_[True, k[1:] != k[:-1]] | edge[:-1] if len(data) else np.zeros(0, dtype=bool)
    cuts = np.r_[np.flatnonzero(change), len(data)]
    starts, ends = cuts[:-1], cuts[1:]
    solid = k[starts] > 0
    starts, ends = starts[solid], ends[solid]
    row = np.searchsorted(offsets, starts, side="right") - 1
    tokens = T.spans_hash(data, starts, ends)
    with np.errstate(over="ignore"):
        pair = T.mix(tokens[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[1:])
        pair[tokens[:-1] == tokens[1:]] = 7
    together = row[:-1] == row[1:]
    row, at = np.r_[row, row[:-1][together]], np.r_[tokens, pair[together]]
    order = np.argsort(row, kind="stable")
    return row[order], (at[order] >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int32)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = T.text_bytes(batch.column("text"))
        for a, b in T.slices(offsets):
            row, at = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            pair, count = np.unique(row.astype(np.int64) << 32 | at, return_counts=True)
            cut = pa.array(np.searchsorted(pair >> 32, np.arange(b - a + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (pair & 0xFFFFFFFF, count)]
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), *lists], names=["doc_id", "label", "at", "count"])


def train(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes over the bounded sample, in an order that its ids fix."""
    rows = sorted(sample.mapInArrow(_featurise, "doc_id bigint, label int, at array<int>, count array<int>").collect(), key=lambda r: r.doc_id)
    examples = []
    for r in rows:
        at, count = np.array(r["at"], dtype=np.int64), np.array(r["count"], dtype=np.int64)
        examples.append((at, count / np.sqrt(max(1, count.sum())), r.label))
    mean = (sum(e[2] for e in examples) + 1) / (len(examples) + 2)
    bias = float(np.log(mean / (1 - mean)))
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            at, x, label = examples[i]
            zi, ni = z[at], n[at]
            w = _weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(bias + w @ x, -30, 30))) - label) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    return _weights(z, n).astype(np.float32), bias


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def score_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted (score >= 0.3).

    `docs` needs doc_id and text, `labels` doc_id and quality; other columns are not looked at. Labels are learnt from
    the rows that aren't held out alone, at most `most` of them. A null or empty text has no n-grams: its score is that of
    the bias, the smoothed rate of good examples. Rows keep their number.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, "quality", most)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            data, offsets = T.text_bytes(batch.column("text"))
            sums = []
            for a, b in T.slices(offsets):
                row, at = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.bincount(row, minlength=b - a)
                sums.append(np.bincount(row, weights=weights[at], minlength=b - a) / np.sqrt(np.maximum(n, 1)))
            score = 1 / (1 + np.exp(-np.clip(bias + np.concatenate(sums or [np.zeros(0)]), -30, 30)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(work, "doc_id bigint, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents: doc_id, held_out, score, predicted."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
