"""Phrases whose words belong together: exact counts by dynamic itemset counting, scores, and the best of each language.

The texts are dealt into shards, and a scan goes round them, one shard a step. Single words are counted in the first
cycle. A longer phrase is activated in the first step before which both its subphrases (all words but the last, all but
the first) reached the threshold; it is counted from there on for one full cycle, so each shard counts it once. Phrases of
different lengths are counted in one step, and the scan ends at the end of a cycle that activated nothing.

- What is active is told by bits of a table of fixed size (`FILTER_BITS`), broadcast: the bits of all phrases that reached
  the threshold before a step, and those of a cycle earlier, whose phrases are finished. A phrase that shares its bits
  with others is counted too early at most, over a whole cycle all the same: no count is ever wrong.
- A step's occurrences are added up in each task and written. A phrase that a task alone counts often enough has its bits
  from the next step on. At the end of a cycle all that was written is added up by phrase, once; what began within the cycle goes on
  into the next one, the others leave for good, with their count if it reaches the threshold.
- Words and phrases are 64-bit hashes of language and words until `described` reads the frequent ones' words from the texts:
  from a part of them, and from the others only what that part has not.
- Cuts, scores and the longer phrases that take a phrase's place are joins on those tables; a language's first rows are
  kept in each task before they are ranked.

Text null: empty; lang null: `und`. Documents without an id count like any other, repeated rows each time. Texts are cut
to words in pieces of `CUT_BYTES`; a longer text is a piece of its own, about 60 bytes of memory a byte of text. An empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.llm.common import dropped, empty_table, flat, has, kept, kept_by, slices, with_bits
from logtide.llm.words import LOWER, bounds, mixed, runs, runs_at, spans, sums

#: Shards of a cycle, and parts of a shard: the first part of all is described first.
SHARDS, PARTS = 2, 3
#: Bytes of texts that are cut to words at once.
CUT_BYTES = 1 << 20
LEAST, LONGEST = 30, 4
#: Bits of the table that tells which phrases reached the threshold: fixed, 8 MB.
FILTER_BITS = 26
#: Occurrences that a task holds before it adds them up, and the rows of a batch that leaves it.
HELD, OUT = 1 << 20, 1 << 16
#: Phrases that a task remembers to have described; more are described again, and leave in the join.
REMEMBERED = 1 << 20
UNKNOWN = "und"
RATIO, SHARE = 2_000_000, 80

ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~ENDS
_WORD[[0x20, 0x09]] = False


class Tokens:
    """The words of some texts: their bytes, hashes with the language, and where a piece goes on."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = flat(part.column("text"))
        self.low = LOWER[data]
        self.start, self.end = bounds(self.low, offsets, _WORD)
        langs = part.column("lang").dictionary_encode()
        names = [x or "" for x in langs.dictionary.to_pylist()]
        self.lang_names, self.lang = names, np.asarray(langs.indices)
        self.owner = np.searchsorted(offsets, self.start, "right") - 1
        salts = np.array([xxhash.xxh64_intdigest(x.encode(), 13) for x in names], np.uint64)
        self.hash = mixed(spans(sums(self.low), self.start, self.end) ^ salts[self.lang[self.owner]]) if len(self.start) else np.zeros(0, np.uint64)
        # The number of the piece each word lies in.
        breaks = np.cumsum(ENDS[self.low], dtype=np.int64)
        self.piece = breaks[self.start] + self.owner if len(self.start) else np.zeros(0, np.int64)

    def words(self, at: int, k: int) -> str:
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[at:at + k], self.end[at:at + k])).decode()


def active(tokens: Tokens, table: np.ndarray, longest: int, finished: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length above one: where phrases begin whose subphrases both have their bits, and the phrases' ids;
    without those whose subphrases both had them in `finished`."""
    at, ids = np.arange(len(tokens.hash)), tokens.hash
    for k in range(2, longest + 1):
        often = has(table, ids)
        at, ids = at[often], ids[often]
        pair = np.flatnonzero(at[1:] == at[:-1] + 1)  # both subphrases: the one from here, and the one from the next word
        pair = pair[tokens.piece[at[pair]] == tokens.piece[at[pair] + k - 1]]
        over = has(finished, ids) if finished is not None else None
        at = at[pair]
        ids = runs_at(tokens.hash, at, k)
        if over is None:
            yield k, at, ids
        else:
            new = ~(over[pair] & over[pair + 1])
            yield k, at[new], ids[new]


def occurrences(docs: DataFrame, now, before, words_too: bool, longest: int) -> DataFrame:
    """(id, n): how often the words and phrases that this step counts occur in what a task reads of a shard; with words, also (lang, n): all of a language."""
    most = HELD

    def function(batches):
        held, many, total = [], 0, Counter()
        table, finished = now.value, before.value if before else None
        for batch in batches:
            for part in slices(batch, limit=CUT_BYTES):
                tokens = Tokens(part)
                if words_too:
                    held.append(tokens.hash)
                    for lang, n in zip(tokens.lang_names, np.bincount(tokens.lang[tokens.owner], minlength=len(tokens.lang_names)).tolist()):
                        total[lang] += n
                    many += len(tokens.hash)
                for _, _, ids in active(tokens, table, longest, finished):
                    held.append(ids)
                    many += len(ids)
                if many >= most:
                    yield from counted(held)
                    held, many = [], 0
        yield from counted(held)
        if total:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(total), pa.int64()), pa.array(total.values(), pa.int64()), pa.array(total, pa.string())], ["id", "n", "lang"])
    return docs.select("text", "lang").mapInArrow(function, "id long, n long, lang string")


def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    ids, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
    for start in range(0, len(ids), OUT):
        part = ids[start:start + OUT].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[start:start + OUT]), pa.nulls(len(part), pa.string())], ["id", "n", "lang"])


def frequent_counts(spark: SparkSession, docs: DataFrame, least: int, longest: int, shards: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(id, n) of every phrase of `longest` words at most that occurs `least` times or more, (lang, n) of all words, and the table of the phrases' bits."""
    tables, step, cycle, open_, done, sent, totals = [empty_table(FILTER_BITS)], 0, [], None, [], [], []
    often = F.col("n") >= least
    # Only where a cycle ends is all added up: within one, a phrase may have reached the threshold in no task alone, but in all.
    while step % shards or step < shards or not np.array_equal(tables[step], tables[step - shards]):
        sent.append(spark.sparkContext.broadcast(tables[step]))
        before = sent[step - shards] if step >= shards else None
        here = kept(occurrences(docs.where(F.col("part") % shards == step % shards), sent[step], before, step < shards, longest))
        if step < shards:
            totals.append(kept(here.where("id is null").groupBy("lang").agg(F.sum("n").alias("n"))))
        cycle.append(here.where("id is not null").select("id", "n").withColumn("since", F.lit(step)))
        first = step - step % shards
        if (step + 1) % shards:
            tables.append(with_bits(tables[step], cycle[-1].where(often)))
        else:
            rows = reduce(DataFrame.union, cycle if open_ is None else [*cycle, open_])
            total = kept(rows.groupBy("id").agg(F.sum("n").alias("n"), F.min("since").alias("since")))
            tables.append(with_bits(tables[step], total.where(often)))
            done.append(kept(total.where(often & (F.col("since") <= first)).select("id", "n")))
            open_ = kept(total.where(F.col("since") > first))
            for table in [*cycle, total]:
                dropped(table)
            cycle = []
        if before:
            before.destroy()
        step += 1
    done.append(open_.where(often).select("id", "n"))  # all of these are counted over a whole cycle
    for each in sent[-shards:]:
        each.destroy()
    words = reduce(DataFrame.union, totals).groupBy("lang").agg(F.sum("n").alias("n"))
    return kept(reduce(DataFrame.union, done)), words, tables[-1]


def described(docs: DataFrame, table, longest: int) -> DataFrame:
    """(id, lang, phrase, words): once a task for each phrase of two words or more with its bits."""
    remembered = REMEMBERED

    def function(batches):
        seen = np.zeros(0, np.uint64)
        subs, bits = table.value
        for batch in batches:
            for part in slices(batch, limit=CUT_BYTES):
                tokens = Tokens(part)
                out, new = [], []
                for k, at, ids in active(tokens, subs, longest):
                    ok = has(bits, ids)
                    ids, first = np.unique(ids[ok], return_index=True)
                    fresh = ~np.isin(ids, seen, assume_unique=True)
                    new.append(ids[fresh])
                    for i, place in zip(ids[fresh].view(np.int64).tolist(), at[ok][first[fresh]].tolist()):
                        out.append((i, tokens.lang_names[tokens.lang[tokens.owner[place]]], tokens.words(place, k), tokens.hash[place:place + k].view(np.int64).tolist()))
                seen = np.concatenate([seen, *new])
                if len(seen) > remembered:
                    seen = seen[:0]
                if out:
                    types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["id", "lang", "phrase", "words"])
    return docs.select("text", "lang").mapInArrow(function, "id long, lang string, phrase string, words array<long>")


def phrases_of(spark: SparkSession, docs: DataFrame, counts: DataFrame, bits: np.ndarray, longest: int) -> DataFrame:
    """(id, a, lang, phrase, words) of the frequent phrases of two words or more.

    Most occur in the first part of the texts; of the other parts only phrases that it has not are described.
    """
    def of(rows, told):
        both = spark.sparkContext.broadcast((bits, told))
        once = described(rows, both, longest).groupBy("id").agg(F.first(F.struct("lang", "phrase", "words")).alias("x"))
        return kept(once.join(counts.withColumnRenamed("n", "a"), "id").select("id", "a", "x.*"))
    here = of(docs.where("part = 0"), bits)
    left = counts.join(here.select("id"), "id", "left_anti")
    return here.union(of(docs.where("part <> 0"), with_bits(empty_table(FILTER_BITS), left)).join(here.select("id"), "id", "left_anti"))


def parts_of(phrases: DataFrame) -> DataFrame:
    """Each phrase with the hashes of its cuts' two parts, and of the phrases of two words or more inside it."""
    def function(batches):
        for batch in batches:
            cuts, inside = [], []
            for words in batch.column("words").to_pylist():
                words = np.array(words, np.int64).view(np.uint64)
                ids = {k: (words if k == 1 else runs(words, k)).view(np.int64).tolist() for k in range(1, len(words))}
                cuts.append([{"k": k, "left": ids[k][0], "right": ids[len(words) - k][-1]} for k in range(1, len(words))])
                inside.append([i for k in range(2, len(words)) for i in ids[k]])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("id", "lang", "phrase", "a")),
                                              pa.array(cuts, pa.list_(pa.struct([("k", pa.int32()), ("left", pa.int64()), ("right", pa.int64())]))),
                                              pa.array(inside, pa.list_(pa.int64()))], ["id", "lang", "phrase", "a", "cuts", "inside"])
    return phrases.select("id", "lang", "phrase", "a", "words").mapInArrow(
        function, "id long, lang string, phrase string, a long, cuts array<struct<k:int,left:long,right:long>>, inside array<long>")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """The lowest score of each phrase's cuts; of equal ones the first."""
    cuts = phrases.select("id", "a", F.explode("cuts").alias("c")).select("id", "a", "c.*")
    n = lambda part, name: counts.select(F.col("id").alias(part), F.col("n").alias(name))
    both = cuts.join(n("left", "l"), "left").join(n("right", "r"), "right")
    # Products and sums in decimals of 38 digits: both may pass 64 bits.
    score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {RATIO}) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))").cast("long")
    return both.groupBy("id").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")).select("id", "s.score", "s.l", "s.r")


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = 2000, shards: int = SHARDS) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases."""
    texts = kept_by(docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"),
                                F.pmod(F.xxhash64("text", "doc_id"), F.lit(shards * PARTS)).cast("int").alias("part")), "part")
    counts, words, bits = frequent_counts(spark, texts, least, longest, shards)
    once = phrases_of(spark, texts, counts, bits, longest)
    phrases = kept(parts_of(once))
    inside = phrases.where(F.size("inside") > 0).select("a", F.explode("inside").alias("id")).groupBy("id").agg(F.max("a").alias("longer"))
    taken = 100 * F.col("longer").cast("decimal(20,0)") >= SHARE * F.col("a").cast("decimal(20,0)")
    rows = phrases.select("id", "lang", "phrase", "a").join(inside, "id", "left").where(~F.coalesce(taken, F.lit(False)))
    rows = rows.join(scored(phrases, counts), "id")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
