"""Statistics of whole texts for the classifiers, for many texts at once, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import fold
from logtide.llm.words import LETTERS, LOWER, NOT_SPACE, Words, bounds, spans, sums

#: Characters of a text that are learned from: all, or of a longer text a span.
LEARNED_CHARS = 1 << 15

_UPPER, _DIGIT, _ALPHA, _PUNCT, _SYMBOL = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PUNCT[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL[[ord(c) for c in "#$%&*|<>=+@^~_/\\{}[]`"]] = True


class Texts:
    """Bytes, words (letters and digits; tokens between white space) and counts of some texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        self.bytes = np.diff(offsets).astype(float)
        self.low = lowered(data)
        self.running = sums(self.low)
        start, end = bounds(self.low, offsets, LETTERS)
        self.words = Words(start, end, spans(self.running, start, end), np.searchsorted(start, offsets))
        self.token_start, self.token_end = bounds(data, offsets, NOT_SPACE)
        self.first_token = np.searchsorted(self.token_start, offsets)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[self.offsets[1:]] - total[self.offsets[:-1]]).astype(float)

    def per_words(self, values: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        first = self.words.first if first is None else first
        total = np.concatenate(([0.0], np.cumsum(values, dtype=float)))
        return total[first[1:]] - total[first[:-1]]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals in lower case."""
    low = LOWER[data]
    lead = np.zeros(len(low), bool)
    lead[1:] = low[:-1] == 0xC3
    low[lead & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)] += 0x20
    return low


STATISTICS = ("log_bytes", "log_words", "word_bytes", "token_bytes", "capitals", "all_capitals", "digits", "punctuation", "bangs", "questions",
              "symbols", "pipes", "repeated_bytes", "line_words", "distinct_words", "largest_share", "repeated_words", "non_ascii", "stops", "symbol_tokens")


def statistics(x: Texts) -> np.ndarray:
    """One row a text, in the order of STATISTICS."""
    data, words = x.data, x.words
    n_words, n_tokens = np.diff(words.first).astype(float), np.diff(x.first_token).astype(float)
    letters = np.maximum(x.per_text(_ALPHA[data]), 1)
    size, n, tokens = np.maximum(x.bytes, 1), np.maximum(n_words, 1), np.maximum(n_tokens, 1)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    alpha = np.concatenate(([0], np.cumsum(_ALPHA[data] & (data < 128))))
    word_upper, word_alpha = (c[words.end] - c[words.start] for c in (upper, alpha))
    same = np.zeros(len(data), bool)
    same[1:] = data[1:] == data[:-1]
    again = np.zeros(len(words.hash), bool)
    again[1:] = words.hash[1:] == words.hash[:-1]
    owner = np.repeat(np.arange(x.rows), np.diff(words.first))
    order = np.lexsort((words.hash, owner)) if len(owner) else np.zeros(0, int)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    begin = np.flatnonzero(new)
    runs = np.diff(np.append(begin, len(order)))
    largest = np.zeros(x.rows)
    np.maximum.at(largest, owner[order][begin], runs)
    ends_in_symbol = _SYMBOL[data[np.maximum(x.token_end - 1, 0)]] if len(x.token_end) else np.zeros(0, bool)
    return np.stack([
        np.log1p(x.bytes), np.log1p(n_words), x.per_words(words.end - words.start) / n, x.per_words(x.token_end - x.token_start, x.first_token) / tokens,
        x.per_text(_UPPER[data]) / letters, x.per_words((word_upper == word_alpha) & (word_upper > 1)) / n, x.per_text(_DIGIT[data]) / size,
        x.per_text(_PUNCT[data]) / size, x.per_text(data == 33) / n, x.per_text(data == 63) / n, x.per_text(_SYMBOL[data]) / size,
        x.per_text(data == 124) / n, x.per_text(same) / size, n_words / (x.per_text(data == 10) + 1), np.bincount(owner[order][begin], minlength=x.rows) / n,
        largest / n, x.per_words(again) / n, x.per_text(data >= 128) / size, x.per_text(data == 46) / n,
        x.per_words(ends_in_symbol, x.first_token) / tokens], axis=1)


def learned_span(text: Column, key: Column, length: int = LEARNED_CHARS) -> Column:
    """The text, or of one with more characters as many from a place that a hash of the key chooses."""
    room = F.length(text) - length
    start = F.pmod(F.xxhash64(key, F.lit(7)), F.greatest(room + 1, F.lit(1))) + 1
    return F.when(room <= 0, text).otherwise(F.substr(text, start.cast("int"), F.lit(length)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, left_out: int, most: int) -> DataFrame:
    """About `most` rows (doc_id, text, label, weight) of either label, picked by a hash of the id; weight: rows that one stands for.

    Rows in the fold `left_out`, without a label or with contradicting ones are left out. Of a long text a span is learned from.
    """
    sure = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != left_out)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("_other")).where("label = _other").drop("_other")
    slot, share, weight = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), F.lit(0), F.lit(1.0)
    for row in sure.groupBy("label").count().collect():
        part = min(1.0, most / row["count"])
        share = F.when(F.col("label") == row["label"], F.lit(int(part * (1 << 30)))).otherwise(share)
        weight = F.when(F.col("label") == row["label"], F.lit(1 / part)).otherwise(weight)
    picked = sure.where(slot < share).withColumn("weight", weight).orderBy("doc_id").limit(4 * most)
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), learned_span(F.col("text"), F.col("doc_id")).alias("text"))
    # at most 4 * most ids: bounded
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", F.col("label").cast("int"), "weight").orderBy("doc_id", "text").limit(4 * most)
