"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are lexicon densities (what share of words, how many, how strong), the share of lexicon words near a second
person, capitals, punctuation, and signs of obfuscation: digits or stars inside words, stretched letters, symbols after
words. The lexicon is learned from labels: words and word beginnings (3 to 8 bytes) that occur in many toxic and hardly
any other texts of a bounded sample, near-copies counted once. Words are also read with digits taken for letters.

Trees are grown level by level on feature histograms in numpy; a part of the sample is put aside for the calibration,
which weights rows so that the labels are as frequent as among all. A hundredth of a score is the uncalibrated one, so
that scores within a calibration step still differ.

A null or empty text has no words and is scored by that. All texts are read whole. Without rows of both labels to learn
from, the score is the share of toxic rows (0 without any). Repeated rows are each answered; extra columns are ignored
or, by `clean`, kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm.common import fitted_in_task, flat, slices
from logtide.llm.structure import STATISTICS, Texts, labelled, statistics
from logtide.llm.words import LETTERS, mixed, runs, spans, sums

#: Rows learned from, of either label.
LEARNED_ROWS = 2000
FOLDS, LEFT_OUT, TOXIC = 4, 2, 0.3
PREFIXES = range(3, 9)
#: Of the lexicon: the most entries, the fewest toxic texts of an entry, how much more frequent it is in toxic texts, and
#: how far its log-likelihood ratio may be from that of the one unit of all tested that chance favours most.
ENTRIES, LEAST_TEXTS, LEAST_RATIO, SURPRISE = 4096, 3, 8.0, -3.0
#: The share of other texts that an entry may be in; log-odds from which one stands for itself; of others, the share of
#: toxic texts that hold none of those.
MOST_CLEAN, SURE, LEAST_UNEXPLAINED = 0.006, 4.6, 0.03
TREES, DEPTH, BINS, RATE, PENALTY = 80, 4, 64, 0.15, 1.0
#: Words of the second person, a fixed list.
SECOND_PERSON = "you your yours yourself u ur tu te toi vous votre vos ton du dich dir dein deine ihr euch sie usted ustedes tus vosotros"
NEAR = 3
_DIGITS_AS_LETTERS = np.arange(256, dtype=np.uint8)
_DIGITS_AS_LETTERS[[ord(c) for c in "013457"]] = [ord(c) for c in "oieast"]
_LETTER = LETTERS.copy()
_LETTER[48:58] = False


def units(x: Texts, running: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which words, hashes) of whole words, then of their beginnings by length."""
    start, end = x.words.start, x.words.end
    out = [(np.arange(len(start)), spans(running, start, end))]
    for n in PREFIXES:
        longer = np.flatnonzero(end - start > n)
        out.append((longer, spans(running, start[longer], start[longer] + n) ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return out


@dataclass
class Lexicon:
    """Hashes of entries, ascending, with their log-odds; `held` tells most others at once."""

    hashes: np.ndarray
    odds: np.ndarray
    held: np.ndarray

    def strengths(self, x: Texts, running: np.ndarray) -> np.ndarray:
        """Each word's strongest entry, 0 if none."""
        out = np.zeros(len(x.words.start))
        for which, hashes in units(x, running):
            maybe = np.flatnonzero(self.held[(hashes >> np.uint64(44)).astype(np.int64)])
            if len(maybe) and len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
                found = self.hashes[at] == hashes[maybe]
                np.maximum.at(out, which[maybe[found]], self.odds[at[found]])
        return out


def parts(texts: pa.Array):
    """(first row, the texts' counts), a bounded number of bytes at a time."""
    row = 0
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"])):
        yield row, Texts(*flat(part.column("text")))
        row += part.num_rows


def likeness(x: Texts) -> np.ndarray:
    """For each text the least hash of its runs of three words, which near-copies mostly share."""
    three = runs(x.words.hash, 3)
    return np.array([three[a:b - 2].min() if b - a > 2 else x.words.hash[a:b].sum() for a, b in zip(x.words.first[:-1].tolist(), x.words.first[1:].tolist())], np.uint64)


def owned(x: Texts, rows: np.ndarray):
    """The distinct unit hashes of those texts, one array for each."""
    owner = np.repeat(np.arange(x.rows), np.diff(x.words.first))
    found = [(owner[which], hashes) for which, hashes in units(x, x.running)]
    owner, hashes = (np.concatenate(column) for column in zip(*found))
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(x.rows + 1))
    every = [np.unique(hashes[order[a:b]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return [every[i] for i in np.flatnonzero(rows).tolist()]


def lexicon(texts: pa.Array, toxic: np.ndarray) -> Lexicon:
    """Entries that are far more frequent in toxic texts than chance has it, over all units; near-copies count once."""
    like = np.concatenate([likeness(x) for _, x in parts(texts)])
    once = np.zeros(len(like), bool)
    once[np.unique(np.stack([like, toxic.astype(np.uint64)]), axis=1, return_index=True)[1]] = True
    bad = [h for row, x in parts(texts) for h in owned(x, (once & (toxic == 1))[row:row + x.rows])]
    hashes, toxic_texts = np.unique(np.concatenate(bad), return_counts=True)
    tests = len(hashes)
    hashes, toxic_texts = hashes[toxic_texts >= LEAST_TEXTS], toxic_texts[toxic_texts >= LEAST_TEXTS]
    other_texts, clean = np.zeros(len(hashes), np.int64), 0
    for row, x in parts(texts):
        for h in owned(x, (once & (toxic == 0))[row:row + x.rows]):
            clean += 1
            other_texts += np.isin(hashes, h, assume_unique=True)
    usual = len(bad) / (len(bad) + clean)
    share = (toxic_texts + 0.5) / (toxic_texts + other_texts + 1)
    surprise = toxic_texts * np.log(share / usual) + other_texts * np.log((1 - share) / (1 - usual + 1e-9))
    ratio = (toxic_texts / len(bad)) / ((other_texts + 0.5) / (clean + 1))
    take = (surprise >= np.log(tests) + SURPRISE) & (ratio >= LEAST_RATIO) & (other_texts <= MOST_CLEAN * clean)
    hashes, odds, toxic_texts = hashes[take], np.log(ratio[take]), toxic_texts[take]
    # the beginning of a toxic word may be that of other words, too: a weak entry is in toxic texts without sure ones
    explained = np.zeros(len(hashes), np.int64)
    for h in bad:
        own = np.isin(hashes, h, assume_unique=True)
        explained += own & (own & (odds >= SURE)).any()
    keep = (odds >= SURE) | (toxic_texts - explained >= np.maximum(LEAST_UNEXPLAINED * toxic_texts, 1))
    hashes, odds = hashes[keep], odds[keep]
    strongest = np.argsort(-odds, kind="stable")[:ENTRIES]
    hashes, odds = hashes[strongest], odds[strongest]
    order = np.argsort(hashes)
    held = np.zeros(1 << 20, bool)
    held[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return Lexicon(hashes[order], odds[order], held)


def feature_table(texts: pa.Array, known: Lexicon) -> np.ndarray:
    return np.concatenate([features(x, known) for _, x in parts(texts)])


def _second_person() -> np.ndarray:
    data, offsets = flat(pa.array([SECOND_PERSON]))
    return np.sort(Texts(data, offsets).words.hash)


FEATURES = (*STATISTICS, "density", "density_read", "hits", "strong_hits", "strength", "strongest", "near_second_person", "second_person",
            "digit_inside", "star_inside", "stretched", "read_differs")


def features(x: Texts, known: Lexicon) -> np.ndarray:
    words = x.words
    n = np.maximum(np.diff(words.first), 1).astype(float)
    plain = known.strengths(x, x.running)
    digit = np.concatenate(([0], np.cumsum((x.low >= 48) & (x.low < 58))))
    letter = np.concatenate(([0], np.cumsum(_LETTER[x.low])))
    inside = (digit[words.end] > digit[words.start]) & (letter[words.end] > letter[words.start])
    read = known.strengths(x, sums(_DIGITS_AS_LETTERS[x.low])) * inside if inside.any() else np.zeros(len(plain))
    either = np.maximum(plain, read)
    people = _second_person()
    person = people[np.minimum(np.searchsorted(people, words.hash), len(people) - 1)] == words.hash
    place = np.arange(len(person))
    people_before = np.concatenate(([0], np.cumsum(person)))
    near = people_before[np.minimum(place + NEAR + 1, len(person))] > people_before[np.maximum(place - NEAR, 0)]
    strongest = np.zeros(x.rows)
    np.maximum.at(strongest, np.repeat(np.arange(x.rows), np.diff(words.first)), either)
    star = np.zeros(len(x.data), bool)
    star[1:-1] = np.isin(x.data[1:-1], (42, 46, 45, 95)) & _LETTER[x.low[:-2]] & _LETTER[x.low[2:]]
    stretched = np.zeros(len(x.data), bool)
    stretched[2:] = (x.low[2:] == x.low[1:-1]) & (x.low[2:] == x.low[:-2]) & _LETTER[x.low[2:]]
    hits, strong = x.per_words(either > 0), x.per_words(either > 4)
    return np.concatenate([statistics(x), np.stack([
        hits / n, x.per_words(read > 0) / n, np.log1p(hits), np.log1p(strong), x.per_words(either) / n, strongest, x.per_words((either > 0) & near) / n,
        x.per_words(person) / n, x.per_words(inside) / n, x.per_text(star) / n, x.per_text(stretched) / n, x.per_words(read > plain) / n], axis=1)], axis=1)


@dataclass
class Tree:
    """A full binary tree: a row goes right where its feature is over the value."""

    feature: np.ndarray
    value: np.ndarray
    leaf: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        at, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (rows[every, self.feature[at]] > self.value[at])
        return self.leaf[at - (1 << DEPTH) + 1]


def grown(binned: np.ndarray, edges: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> Tree:
    """Second-order boosting: each level's best splits from sums of slope and bend over (node, feature, bin)."""
    n, width = binned.shape
    feature, value = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, np.inf)
    at = np.zeros(n, np.int64)
    for level in range(DEPTH):
        nodes = 1 << level
        cell = ((at - (nodes - 1))[:, None] * width + np.arange(width)) * BINS + binned
        both = [np.bincount(cell.ravel(), np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2) for v in (slope, bend)]
        g, h = both
        all_g, all_h = g[:, :, -1:], h[:, :, -1:]
        gain = g ** 2 / (h + PENALTY) + (all_g - g) ** 2 / (all_h - h + PENALTY) - all_g ** 2 / (all_h + PENALTY)
        gain[(h < 1) | (all_h - h < 1)] = 0
        best = gain.reshape(nodes, -1).argmax(axis=1)
        good = gain.reshape(nodes, -1).max(axis=1) > 1e-6
        here = np.arange(nodes) + nodes - 1
        feature[here] = best // BINS
        cut = np.where(good, best % BINS, BINS)
        value[here] = np.where(good, edges[feature[here], np.minimum(cut, BINS - 2)], np.inf)
        own = at - (nodes - 1)
        at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut[own])
    leaves = at - (1 << DEPTH) + 1
    size = 1 << DEPTH
    return Tree(feature, value, -RATE * np.bincount(leaves, slope, size) / (np.bincount(leaves, bend, size) + PENALTY))


def isotonic(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points (raw, probability) to interpolate between."""
    blocks: list[list[float]] = []
    for i in np.argsort(raw, kind="stable").tolist():
        blocks.append([raw[i] * weight[i], label[i] * weight[i], weight[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    base: float
    lexicon: Lexicon | None = None
    trees: tuple = ()
    raw: np.ndarray | None = None
    probability: np.ndarray | None = None

    def margins(self, x: Texts) -> np.ndarray:
        rows = features(x, self.lexicon)
        return self.base + sum(tree.scores(rows) for tree in self.trees)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(offsets) - 1, self.base)
        margin = self.margins(Texts(data, offsets))
        return np.clip(0.99 * np.interp(margin, self.raw, self.probability) + 0.01 * logistic(margin), 0, 1)


def trained(texts: pa.Array, label: np.ndarray, weight: np.ndarray) -> Model:
    """Two thirds of the rows grow the trees; the lexicon of those is used for the rest, which calibrates."""
    share = float((label * weight).sum() / weight.sum()) if len(label) else 0.0
    if len(np.unique(label)) < 2:
        return Model(share)
    part = (mixed(np.arange(len(label), dtype=np.uint64)) % np.uint64(6)).astype(int)
    # an entry's own rows would make it look surer than it is: each third is read with the lexicon of the other two
    table = np.zeros((len(label), len(FEATURES)))
    for k in range(3):
        own = np.flatnonzero(part % 3 == k)
        if len(own) and len(np.unique(label[part % 3 != k])) == 2:
            table[own] = feature_table(texts.take(pa.array(own)), lexicon(texts.filter(pa.array(part % 3 != k)), label[part % 3 != k]))
    grow, aside = part < 4, part >= 4
    if len(np.unique(label[grow])) < 2 or len(np.unique(label[aside])) < 2:
        grow = aside = np.ones(len(label), bool)
    edges = np.quantile(table[grow], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, table.T)], axis=1)
    y = label[grow].astype(float)
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    margin, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = logistic(margin)
        tree = grown(binned[grow], edges, p - y, p * (1 - p))
        trees.append(tree)
        margin += tree.scores(table[grow])
    raw = base + sum(tree.scores(table[aside]) for tree in trees)
    return Model(base, lexicon(texts, label), tuple(trees), *isotonic(raw, label[aside].astype(float), weight[aside]))


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARNED_ROWS) -> Model:
    """From rows whose id's fold of four is not 2."""
    def fit(found: pa.Table) -> Model:
        return trained(found.column("text").combine_chunks(), found.column("label").to_numpy(), found.column("weight").to_numpy())
    return fitted_in_task(labelled(docs, labels, "toxic", FOLDS, LEFT_OUT, rows), fit)


def scored(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score)."""
    shared = spark.sparkContext.broadcast(model)

    def function(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.scores(*flat(part.column("text"))))], ["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(function, "doc_id long, score double")


def clean(spark: SparkSession, docs: DataFrame, model: Model, most: float = TOXIC) -> DataFrame:
    """The rows, with all their columns, whose score is under `most`."""
    shared = spark.sparkContext.broadcast(model)

    def function(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(shared.value.scores(*flat(part.column("text"))) < most))
    return docs.mapInArrow(function, docs.schema)
