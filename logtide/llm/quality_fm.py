"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's own metadata.

A text's inputs are its words, hashed, each with its share of the words; and each statistic's bin (quantiles of the
sample), the binned length in characters among them. Its margin is w0 + sum w_i x_i + the sum over all pairs of
<v_i, v_j> x_i x_j, which takes linear time by half of |sum x_i v_i|^2 - sum x_i^2 |v_i|^2. Weights are trained by
stochastic gradient descent in numpy on a bounded sample; a logistic fit on rows put aside, weighted to the labels'
true shares, gives probabilities.

A null or empty text has no words and is scored by its statistics. All texts are read whole. Without rows of both
labels to learn from, the score is the share of good rows (0 without any). Repeated rows are each answered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm.common import fitted_in_task, flat, slices
from logtide.llm.structure import STATISTICS, Texts, labelled, statistics
from logtide.llm.toxicity import logistic, parts
from logtide.llm.words import mixed

FOLDS, LEFT_OUT, GOOD = 3, 1, 0.5
#: Rows learned from, of either label.
LEARNED_ROWS = 2000
WORD_BUCKETS, BINS, RANK = 1 << 15, 12, 6
EPOCHS, RATE, DECAY, STATISTIC_WEIGHT = 8, 0.15, 1e-5, 0.35


def measured(x: Texts) -> np.ndarray:
    """The statistics, and the length in characters: bytes that begin one."""
    return np.concatenate([statistics(x), np.log1p(x.per_text((x.data & 0xC0) != 0x80))[:, None]], axis=1)


INPUTS = WORD_BUCKETS + (len(STATISTICS) + 1) * BINS


def inputs(x: Texts, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input numbers and values of all texts, and where each text's begin; an input occurs once in a text."""
    rows = measured(x)
    owner = np.repeat(np.arange(x.rows), np.diff(x.words.first))
    key = owner * WORD_BUCKETS + (x.words.hash & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    key, many = np.unique(key, return_counts=True)
    word_owner = key // WORD_BUCKETS
    share = many / np.maximum(np.diff(x.words.first), 1)[word_owner]
    bins = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, rows.T)], axis=1)
    bins += WORD_BUCKETS + np.arange(rows.shape[1]) * BINS
    order = np.argsort(np.concatenate((word_owner, np.repeat(np.arange(x.rows), rows.shape[1]))), kind="stable")
    number = np.concatenate((key % WORD_BUCKETS, bins.ravel()))[order]
    value = np.concatenate((share, np.full(bins.size, STATISTIC_WEIGHT)))[order]
    first = np.concatenate(([0], np.cumsum(np.bincount(word_owner, minlength=x.rows) + rows.shape[1])))
    return number, value, first


@dataclass
class Model:
    base: float
    edges: np.ndarray | None = None
    linear: np.ndarray | None = None
    factors: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, x: Texts) -> np.ndarray:
        number, value, first = inputs(x, self.edges)
        weighted = self.factors[number] * value[:, None]
        total = np.add.reduceat(weighted, first[:-1], axis=0)
        squares = np.add.reduceat(weighted ** 2, first[:-1], axis=0)
        return self.base + np.add.reduceat(self.linear[number] * value, first[:-1]) + 0.5 * (total ** 2 - squares).sum(axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.linear is None:
            return np.full(len(offsets) - 1, self.base)
        return logistic(self.slope * self.margins(Texts(data, offsets)) + self.shift)


def fitted(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """A weighted logistic fit by Newton's steps, held to the line by a small penalty."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    at, ridge = np.array([1.0, 0.0]), np.diag([1e-2, 1e-3])
    scale = weight / weight.mean()
    for _ in range(30):
        p = logistic(x @ at)
        slope = x.T @ (scale * (p - label)) + ridge @ (at - (1.0, 0.0))
        bend = (x * (scale * p * (1 - p))[:, None]).T @ x + ridge
        at = at - np.clip(np.linalg.solve(bend, slope), -1, 1)
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def trained(texts: pa.Array, label: np.ndarray, weight: np.ndarray, seed: int = 5) -> Model:
    share = float((label * weight).sum() / weight.sum()) if len(label) else 0.0
    if len(np.unique(label)) < 2:
        return Model(share)
    rows = np.concatenate([measured(x) for _, x in parts(texts)])
    edges = np.quantile(rows, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    every = []
    for _, x in parts(texts):
        number, value, first = inputs(x, edges)
        every += [(number[a:b], value[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    aside = mixed(np.arange(len(label), dtype=np.uint64)) % np.uint64(5) == 0
    if len(np.unique(label[~aside])) < 2 or len(np.unique(label[aside])) < 2:
        aside[:] = False
    rng = np.random.default_rng(seed)
    linear, factors, base = np.zeros(INPUTS), rng.normal(0, 0.05, (INPUTS, RANK)), 0.0
    seen = np.full(INPUTS, 1e-2), np.full((INPUTS, RANK), 1e-2)  # of AdaGrad
    learned = np.flatnonzero(~aside)
    for _ in range(EPOCHS):
        for i in rng.permutation(learned).tolist():
            number, value = every[i]
            v = factors[number]
            total = value @ v
            margin = base + linear[number] @ value + 0.5 * float(total @ total - (value ** 2) @ (v ** 2).sum(axis=1))
            error = float(logistic(np.array(margin))) - label[i]
            base -= 0.01 * error
            step = error * value + DECAY * linear[number]
            seen[0][number] += step ** 2
            linear[number] -= RATE * step / np.sqrt(seen[0][number])
            step = error * value[:, None] * (total - v * value[:, None]) + DECAY * v
            seen[1][number] += step ** 2
            factors[number] -= RATE * 0.3 * step / np.sqrt(seen[1][number])
    model = Model(base, edges, linear, factors)
    use = aside if aside.any() else ~aside
    margin = np.concatenate([model.margins(x) for _, x in parts(texts)])
    model.slope, model.shift = fitted(margin[use], label[use].astype(float), weight[use])
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARNED_ROWS) -> Model:
    """From rows whose id's fold of three is not 1."""
    def fit(found: pa.Table) -> Model:
        return trained(found.column("text").combine_chunks(), found.column("label").to_numpy(), found.column("weight").to_numpy())
    return fitted_in_task(labelled(docs, labels, "quality", FOLDS, LEFT_OUT, rows), fit)


def scored(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score)."""
    shared = spark.sparkContext.broadcast(model)

    def function(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.scores(*flat(part.column("text"))))], ["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(function, "doc_id long, score double")
