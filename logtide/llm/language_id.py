"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's subwords are the byte 3- and 4-grams of its lower-cased letters, words set apart by one blank, and whole words,
each hashed to a bucket. Their embeddings are averaged; a linear softmax gives language probabilities. Both are trained
by stochastic gradient descent in numpy, in turn on a long and a short span of a text, from a sample of LEARNED_ROWS rows in the
MOST_LANGUAGES most frequent languages, and LEARNED_CHARS characters of each, from a place that a hash chooses. A temperature is fitted on rows put aside; so is the score below which a text is rejected: the one that
would lose `REJECTED` of the rows that the model gets right, and not over `MOST_REJECTING`.

A null text, or one without a letter, is `und` with score 0 and rejected. All texts are read whole. If there is no row
to learn from, every text is `und`. Repeated rows are each answered; extra columns are ignored or, by `accepted`, kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm.common import fitted_in_task, flat, fold, slices
from logtide.llm.structure import learned_span
from logtide.llm.words import LOWER, bounds, spans, sums

BUCKETS, DIMENSION = 1 << 17, 16
#: Rows learned from, about as many of each language; characters of such a text; and the most languages.
LEARNED_ROWS, LEARNED_CHARS, MOST_LANGUAGES = 4000, 1 << 13, 512
#: Words of a short and a long span.
EPOCHS, RATE, SPAN_WORDS, LONG_SPAN = 6, 0.5, 40, 400
REJECTED, MOST_REJECTING = 0.0005, 0.5
UNKNOWN = "und"

#: ASCII letters and all bytes of other characters.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(97, 123), *range(128, 256)]] = True


@dataclass
class Subwords:
    """Buckets of all texts, the grams in byte order, then the words; where each text's begin in either part."""

    grams: np.ndarray
    words: np.ndarray
    first_gram: np.ndarray
    first_word: np.ndarray
    word_gram: np.ndarray


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals in lower case."""
    low = LOWER[data]
    lead = np.zeros(len(low), bool)
    lead[1:] = low[:-1] == 0xC3
    low[lead & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)] += 0x20
    return low


def subwords(data: np.ndarray, offsets: np.ndarray) -> Subwords:
    low = lowered(data)
    start, end = bounds(low, offsets, _LETTERS)
    first_word = np.searchsorted(start, offsets)
    # the words again, a blank before and after each: blanks are shared, so text i's letters begin after one
    size = end - start + 1
    at = np.cumsum(size) - size + 1
    stream = np.full(int(size.sum()) + 1, 32, np.uint8)
    source = np.arange(int((size - 1).sum())) + np.repeat(start - (np.cumsum(size - 1) - (size - 1)), size - 1)
    place = np.arange(len(source)) + np.repeat(at - (np.cumsum(size - 1) - (size - 1)), size - 1)
    stream[place] = low[source]
    running = sums(stream)
    buckets = np.uint64(BUCKETS - 1)
    # gram pairs lie at every byte; a text's begin at the blank before its first word
    begin = np.arange(len(stream))
    three = (spans(running, begin, np.minimum(begin + 3, len(stream))) & buckets).astype(np.int32)
    four = (spans(running, begin, np.minimum(begin + 4, len(stream))) & buckets).astype(np.int32)
    whole = (spans(running, at, at + size - 1) * np.uint64(3) >> np.uint64(20) & buckets).astype(np.int32)
    starts = np.append(at - 1, max(len(stream) - 1, 0))
    return Subwords(np.stack([three, four], axis=1), whole, starts[first_word], first_word, starts)


def averages(found: Subwords, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the table's rows over each text's subwords, and how many those are."""
    total = np.zeros((len(found.first_word) - 1, table.shape[1]))
    parts = ((found.grams[:, 0], found.first_gram), (found.grams[:, 1], found.first_gram), (found.words, found.first_word))
    for buckets, first in parts:
        filled = np.flatnonzero(np.diff(first))
        if len(filled):
            rows = table[buckets[:first[-1]]]
            total[filled] += np.add.reduceat(rows, first[filled], axis=0)
    count = 2 * np.diff(found.first_gram) + np.diff(found.first_word)
    return total / np.maximum(count, 1)[:, None], count


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    weights: np.ndarray | None
    bias: np.ndarray
    temperature: float
    least: float

    def scores(self, found: Subwords) -> np.ndarray:
        mean, _ = averages(found, self.table)
        return softmax((mean @ self.weights if self.weights is not None else mean) + self.bias, self.temperature)


def softmax(logits: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    logits = logits / temperature
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def trained(texts: list[str], labels: list[str], seed: int = 1) -> Model:
    """A fifth of the rows, every fifth, is put aside for the temperature and the rejection."""
    languages = sorted(set(labels))
    target = np.searchsorted(languages, labels)
    rng = np.random.default_rng(seed)
    table = (rng.random((BUCKETS, DIMENSION), np.float32) - 0.5) / DIMENSION
    weights, bias = np.zeros((DIMENSION, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    parts = [subwords(*flat(part.column("text"))) for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), limit=1 << 19)]
    place = [(part, k) for part in parts for k in range(len(part.first_word) - 1)]
    worded = np.concatenate([np.diff(part.first_word) > 0 for part in parts])
    aside = np.arange(len(texts)) % 5 == 4
    learned = np.flatnonzero(~aside & worded)

    def buckets(found: Subwords, a: int, b: int) -> np.ndarray:
        low, high = found.word_gram[a], found.word_gram[b]
        return np.concatenate((found.grams[low:high].ravel(), found.words[a:b]))

    steps, done = max(1, EPOCHS * 2 * len(learned)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(np.repeat(learned, 2)).tolist():
            found, row = place[i]
            a, b = int(found.first_word[row]), int(found.first_word[row + 1])
            n = int(rng.integers(1, SPAN_WORDS)) if done % 2 else LONG_SPAN
            a = int(rng.integers(a, max(a + 1, b - n + 1)))
            b = min(b, a + n)
            ids, many = np.unique(buckets(found, a, b), return_counts=True)
            share = (many / many.sum()).astype(np.float32)
            mean = share @ table[ids]
            error = softmax(mean @ weights + bias)
            error[target[i]] -= 1
            rate = RATE * (1 - done / steps)
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            table[ids] -= (rate * len(ids) ** 0.5) * np.outer(share, back)
            done += 1
    model = Model(languages, table, weights, bias, 1.0, 0.0)
    if len(languages) <= DIMENSION:  # the product is narrower than the embeddings
        model = Model(languages, table @ weights, None, bias, 1.0, 0.0)
    check = np.flatnonzero(aside & worded)
    if len(check):
        mean = np.concatenate([averages(part, model.table)[0] for part in parts])
        logits = ((mean @ model.weights if model.weights is not None else mean) + model.bias)[check]
        heat = np.geomspace(0.05, 20, 60)
        model.temperature = float(heat[np.argmin([-np.log(softmax(logits, t)[np.arange(len(check)), target[check]] + 1e-12).mean() for t in heat])])
        p = softmax(logits, model.temperature)
        right = p.argmax(axis=1) == target[check]
        model.least = float(min(MOST_REJECTING, np.quantile(p.max(axis=1)[right], REJECTED, method="lower"))) if right.any() else 0.0
    return model


def learn(docs: DataFrame) -> Model | None:
    """Learns from the text and non-null lang of rows whose id's fold of three is not 1, a bounded number a language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return None
    # picked by a hash of the id
    parts = {row["lang"]: int(min(1.0, LEARNED_ROWS / len(counts) / row["count"]) * (1 << 30)) for row in counts}
    share = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[F.col("lang")]
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    text = learned_span(F.col("text"), F.col("doc_id"), LEARNED_CHARS).alias("text")
    picked = rows.where(slot < share).select("doc_id", text, "lang").orderBy("doc_id", "text").limit(2 * LEARNED_ROWS)
    return fitted_in_task(picked, lambda found: trained(found.column("text").to_pylist(), found.column("lang").to_pylist()))


def has_letter(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only those with none in ASCII but other characters are looked at one by one."""
    low = LOWER[data]
    plain = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
    other = np.concatenate(([0], np.cumsum(low >= 128)))
    found = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~found & (other[offsets[1:]] > other[offsets[:-1]])).tolist():
        found[i] = any(map(str.isalpha, part.column("text")[i].as_py()))
    return found


def judged(part: pa.RecordBatch, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    data, offsets = flat(part.column("text"))
    known = has_letter(part, data, offsets)
    if model is None:
        return [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
    p = model.scores(subwords(data, offsets))
    best, score = p.argmax(axis=1), np.where(known, p.max(axis=1), 0.0)
    return [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist())], score, known & (score >= model.least)


def identified(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, lang_pred, score, accepted)."""
    shared = spark.sparkContext.broadcast(model)

    def function(batches):
        for batch in batches:
            for part in slices(batch):
                language, score, ok = judged(part, shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(language, pa.string()), pa.array(score), pa.array(ok)],
                                                 ["doc_id", "lang_pred", "score", "accepted"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(function, "doc_id long, lang_pred string, score double, accepted boolean")


def accepted(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows, with all their columns, whose language is recognised."""
    shared = spark.sparkContext.broadcast(model)

    def function(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(judged(part, shared.value)[2]))
    return docs.mapInArrow(function, docs.schema)
