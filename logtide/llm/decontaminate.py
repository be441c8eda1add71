"""Benchmark decontamination: an FM-index of each training shard, searched backwards for all benchmark phrases at once.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case. A phrase is every run of ten
consecutive words of an item, or all of a shorter one. Within a task, texts make up shards of bounded size. A shard's
index is over word symbols: benchmark words have one each, any other word breaks the text, as no phrase can cover it,
and stretches shorter than the shortest phrase are left out. Suffixes are sorted by prefix doubling; the
Burrows-Wheeler transform is held as a wavelet matrix with ranks; occurrences are found by walking back to sampled
suffix positions (every 16th, and every start of a stretch). Their spans are merged for each text.

The benchmark reaches tasks in blocks of a bounded number of words, one pass over the documents for each; passes run
in one stage, without a shuffle.

A null text, or one without words, has no spans. Items without words have no phrases; an item without an id marks
words but is not listed. Repeated rows are each answered; an empty benchmark marks nothing; extra columns are kept by
`cleaned` and ignored by `marked`.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm.common import flat, slices
from logtide.llm.words import LETTERS, Words, distinct, runs, words

#: Words of a phrase; words of the benchmark in one block; words of texts in one shard.
WINDOW, BLOCK_WORDS, SHARD_WORDS = 10, 1 << 20, 1 << 20
SAMPLING = 16
#: Occurrences that are located at once.
LOCATED = 1 << 20


@dataclass
class Phrases:
    """Phrases as runs of word symbols (1 and up, by position in `vocabulary`), and the items that each comes from."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray
    item: np.ndarray


def phrases(ids: list, texts: list, window: int = WINDOW) -> Phrases:
    found = words(*flat(pa.array(texts, pa.string())), LETTERS)
    vocabulary = distinct(found.hash) if len(found.hash) else found.hash
    symbols = (np.searchsorted(vocabulary, found.hash) + 1).astype(np.int32)
    key, start, length, item = [], [], [], []
    full = runs(found.hash, window)
    for i, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist())):
        n = min(window, b - a)
        if n:
            begin = np.arange(a, b - n + 1)
            key.append(full[begin] if n == window else runs(found.hash[a:b], n))
            start.append(begin)
            length.append(np.full(len(begin), n))
            item.append(np.full(len(begin), i))
    if not key:
        return Phrases(vocabulary, symbols, *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(1, np.int64), np.zeros(0, np.int64))
    key, start, length, item = (np.concatenate(x) for x in (key, start, length, item))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    return Phrases(vocabulary, symbols, start[order][first], length[order][first], np.append(first, len(key)), item[order])


class ShardIndex:
    """An FM-index of symbols 1 and up; each 0 ends a stretch, and no phrase holds one."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        n, ends = len(symbols), symbols == 0
        order = suffix_order(symbols, ends)
        before = symbols[order - 1]  # of the first suffix: the last 0
        self.before = before
        many = np.bincount(symbols, minlength=alphabet + 1)
        self.smaller = np.concatenate(([0], np.cumsum(many)[:-1]))
        self.levels, column = [], before
        for bit in range(max(1, int(alphabet).bit_length()) - 1, -1, -1):
            ones = (column >> bit & 1).astype(bool)
            ranks = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=ranks[1:])
            self.levels.append((bit, ranks, n - int(ranks[-1])))
            column = np.concatenate((column[~ones], column[ones]))
        starts = np.concatenate(([True], ends[:-1]))
        held = (np.arange(n) % SAMPLING == 0) | starts
        self.sampled = held[order]
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol precedes the suffixes above the row."""
        at, base = row, np.zeros_like(row)
        for bit, ranks, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            at = np.where(one, zeros + ranks[at], at - ranks[at])
            base = np.where(one, zeros + ranks[base], base - ranks[base])
        return at - base

    def search(self, found: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, and the ranges of suffixes that begin with each."""
        which = np.arange(len(found.start))
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.before), np.int64)
        left = found.length.copy()
        done = [], [], []
        while len(which):
            symbol = found.symbols[found.start[which] + left - 1].astype(np.int64)
            low, high = (self.smaller[symbol] + self.rank(symbol, x) for x in (low, high))
            left = left - 1
            whole = (low < high) & (left == 0)
            for out, x in zip(done, (which, low, high)):
                out.append(x[whole])
            go = (low < high) & (left > 0)
            which, low, high, left = which[go], low[go], high[go], left[go]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in done)

    def positions(self, row: np.ndarray) -> np.ndarray:
        out, steps, open_ = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(open_):
            known = self.sampled[row]
            out[open_[known]] = self.samples[self.sample_rank[row[known]]] + steps
            open_, row = open_[~known], row[~known]
            symbol = self.before[row].astype(np.int64)
            row = self.smaller[symbol] + self.rank(symbol, row)
            steps += 1
        return out


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes in order; every 0 is smaller than all symbols and than the 0s after it, so no order reaches past one."""
    n = len(symbols)
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    reach = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-reach or None] = rank[reach:] + 1 if reach < n else 0
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        step = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(step)))
        if step.all():
            return order
        reach *= 2


def stretches(hashes: np.ndarray, first: np.ndarray, vocabulary: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the stretches of benchmark words, a 0 after each, and the word that each symbol stands for."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = vocabulary[at] == hashes
    begins, ends = known.copy(), known.copy()
    begins[1:] &= ~known[:-1]
    ends[:-1] &= ~known[1:]
    edges = first[(first > 0) & (first < len(hashes))]
    begins[edges] = known[edges]
    ends[edges - 1] = known[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = end - start >= least
    start, size = start[long], (end - start)[long] + 1
    offset = np.cumsum(size) - size
    word = np.arange(int(size.sum())) + np.repeat(start - offset, size)
    symbols = np.zeros(len(word), np.int32)
    inside = np.ones(len(word), bool)
    inside[offset + size - 1] = False
    symbols[inside] = at[word[inside]] + 1
    return symbols, word


def occurrences(hashes: np.ndarray, first: np.ndarray, found: Phrases) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words that lie in a phrase; for each text, the numbers of the items whose phrases occur."""
    edge = np.zeros(len(hashes) + 1, np.int64)
    texts, items = [], []
    if len(found.start) and len(hashes):
        symbols, word = stretches(hashes, first, found.vocabulary, int(found.length.min()))
        if len(symbols):
            index = ShardIndex(symbols, len(found.vocabulary))
            which, low, high = index.search(found)
            many = high - low
            cuts = np.searchsorted(np.cumsum(many), np.arange(LOCATED, int(many.sum()) + LOCATED, LOCATED)) + 1
            for part in np.split(np.arange(len(which)), cuts):
                n = many[part]
                rows = np.arange(int(n.sum())) + np.repeat(low[part] - (np.cumsum(n) - n), n)
                begin = word[index.positions(rows)]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + np.repeat(found.length[which[part]], n), -1)
                text = np.searchsorted(first, begin, "right") - 1
                pair = np.unique(np.stack([text, np.repeat(which[part], n)]), axis=1)
                each = (found.first[1:] - found.first[:-1])[pair[1]]
                at = np.arange(int(each.sum())) + np.repeat(found.first[pair[1]] - (np.cumsum(each) - each), each)
                texts.append(np.repeat(pair[0], each))
                items.append(found.item[at])
    hit = np.cumsum(edge)[:-1] > 0
    out = [np.zeros(0, np.int64)] * (len(first) - 1)
    if texts:
        pair = np.unique(np.stack([np.concatenate(texts), np.concatenate(items)]), axis=1)
        for text, a, b in zip(*np.unique(pair[0], return_index=True), [*np.unique(pair[0], return_index=True)[1][1:], pair.shape[1]]):
            out[text] = pair[1, a:b]
    return hit, out


def shards(batches, limit: int = SHARD_WORDS):
    """Rows of a task with their words, in shards of about `limit` words."""
    held, count = [], 0
    for batch in batches:
        for part in slices(batch):
            found = words(*flat(part.column("text")), LETTERS)
            held.append((part, found))
            count += len(found.hash)
            if count >= limit:
                yield held
                held, count = [], 0
    if held:
        yield held


def marks(held: list, found: Phrases):
    """For each part of a shard: its rows and words, which words are hit, and each text's items."""
    hashes = np.concatenate([w.hash for _, w in held])
    bases = np.cumsum([0] + [len(w.hash) for _, w in held])
    first = np.concatenate([w.first[:-1] + base for (_, w), base in zip(held, bases)] + [bases[-1:]])
    hit, items = occurrences(hashes, first, found)
    row = 0
    for (part, w), base in zip(held, bases.tolist()):
        yield part, w, hit[base:base + len(w.hash)], items[row:row + part.num_rows]
        row += part.num_rows


def hit_spans(found: Words, hit: np.ndarray, row: int) -> np.ndarray:
    """[from, to) of the runs of hit words of one text, in words of the text."""
    a, b = int(found.first[row]), int(found.first[row + 1])
    edge = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def benchmark_blocks(benchmark: DataFrame, most: int = BLOCK_WORDS):
    """The benchmark's ids and phrases, in blocks of about `most` words at most; an item is in one block."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // (4 * most)) or 1  # a word and the gap after it take some bytes
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = part.collect()
        yield [r.item_id for r in rows], phrases([r.item_id for r in rows], [r.text for r in rows])


def marked(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, spans, items): hit spans as [from, to) in words, and the ids of the items that occur."""
    out = docs.select(F.col("doc_id").cast("long"), "text", F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<array<long>>").alias("spans"), F.array().cast("array<long>").alias("items"))
    blocks = benchmark_blocks(benchmark, block_words)
    block = next(blocks)
    while block:
        shared, block = spark.sparkContext.broadcast(block), next(blocks, None)
        names = ["doc_id", *["text"] * (block is not None), "n_words", "spans", "items"]  # the last pass leaves the text out

        def function(batches, shared=shared, names=names):
            ids, found = shared.value
            for held in shards(batches, shard_words):
                for part, w, hit, items in marks(held, found):
                    spans, listed = [], []
                    for i, (old_spans, old_items) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist())):
                        new = hit_spans(w, hit, i).tolist()
                        spans.append(merged(old_spans + new) if old_spans else new)
                        listed.append(sorted({*old_items, *(ids[k] for k in items[i].tolist() if ids[k] is not None)}))
                    made = {"doc_id": part.column("doc_id"), "text": part.column("text"), "n_words": pa.array(np.diff(w.first)),
                            "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "items": pa.array(listed, pa.list_(pa.int64()))}
                    yield pa.RecordBatch.from_arrays([made[x] for x in names], names)
        kinds = {"doc_id": "long", "text": "string", "n_words": "long", "spans": "array<array<long>>", "items": "array<long>"}
        out = out.mapInArrow(function, ", ".join(f"{x} {kinds[x]}" for x in names))
    return out


def merged(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def cut(data: bytes, found: Words, offset: int, row: int, spans: np.ndarray) -> bytes:
    """One text without its hit words and what stands between them; one space for each span."""
    first, out, at = int(found.first[row]), [], 0
    for a, b in spans.tolist():
        begin, end = int(found.start[first + a]) - offset, int(found.end[first + b - 1]) - offset
        out.append(data[at:begin])
        at = end
    return b" ".join([*out, data[at:]])


def cleaned(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents with hit spans cut out of `text` (each leaves a space) and `n_chars`, where there is one, set anew.

    What a cut brings together is searched again, until nothing is hit.
    """
    for _, found in benchmark_blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(found)

        def function(batches, shared=shared):
            for held in shards(batches, shard_words):
                while held:
                    again = []
                    for part, w, hit, _ in marks(held, shared.value):
                        if not hit.any():
                            yield part
                            continue
                        rows = np.flatnonzero(np.add.reduceat(np.append(hit, False), w.first[:-1]) * (np.diff(w.first) > 0))
                        changed = np.zeros(part.num_rows, bool)
                        changed[rows] = True
                        yield part.filter(pa.array(~changed))
                        _, offsets = flat(part.column("text"))
                        new = [cut(part.column("text")[i].as_py().encode(), w, int(offsets[i]), i, hit_spans(w, hit, i)).decode() for i in rows.tolist()]
                        part = replaced(part.filter(pa.array(changed)), new)
                        again.append((part, words(*flat(part.column("text")), LETTERS)))
                    held = again
        docs = docs.mapInArrow(function, docs.schema)
    return docs


def replaced(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    columns = {name: part.column(i) for i, name in enumerate(part.schema.names)}
    text = columns["text"].type
    columns["text"] = pa.array(texts, text)
    if "n_chars" in columns:
        columns["n_chars"] = pc.cast(pc.utf8_length(columns["text"]), columns["n_chars"].type)
    return pa.RecordBatch.from_arrays(list(columns.values()), schema=part.schema)


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
