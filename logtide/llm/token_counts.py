"""Token counts as a byte-level BPE library gives them, without ids: pieces are counted once for each distinct pre-token.

1. `vocabulary`: every text's pre-tokens, counted within tasks and then over all; the library counts the pieces of each
   distinct one, once.
2. `profiles`: for each text, the sum over its pre-tokens that are among the most frequent ones of all texts (a bounded
   table that every task gets) and the others with their frequencies.
3. The others are joined to the vocabulary, and frequency times pieces is summed by row.

Texts are cut at single blanks first, so that pre-tokens are looked for once in each distinct chunk; a text where white
space meets at such a cut is cut whole. Chunks of Latin characters are matched by the pattern of byte-level BPE with its
character classes written out; all others go through the library's own pre-tokenizer. Special strings are looked for as
the library does by default, one token each.

A null or empty text has no bytes and no tokens. Rows are told apart by position, so repeated ids and rows are counted
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm.common import kept

#: The most frequent pre-tokens that every task gets, and the longest of them: at most 8 MB.
FREQUENT, LONGEST = 1 << 17, 64
#: Entries of a task's tables before they are handed on or begun anew.
ENTRIES = 300_000
#: Characters of texts whose chunks a task holds at most before it hands them on: chunks may be whole texts.
HELD_CHARS = 16 << 20
#: Tokens of a text beyond which it is over the limit.
LIMIT = 1024

# The pattern of byte-level BPE, its classes written out for characters below U+0250.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_LATIN = re.compile("[\x00-ɏ]*")
#: White space, or a text's edge, on both sides of a blank: cutting there would cut a run of white space. It begins with the blank, which is found fast.
_MEETING = re.compile(r" (?=\s|$)(?:(?<=\s )|(?<=^ ))")


@dataclass
class Cutter:
    """Pre-tokens of texts, as the library of the given tokenizer file cuts them."""

    definition: str
    seen: dict = field(default_factory=dict)

    def __post_init__(self):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_str(self.definition)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def cut(self, chunk: str) -> list[str]:
        if _LATIN.fullmatch(chunk):
            return PATTERN.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)]

    def chunks(self, text: str) -> tuple[list[str], int]:
        """Chunks whose pre-tokens are the text's, and the number of special tokens."""
        if self.special and (found := self.special.findall(text)):
            return [x for part in self.special.split(text) if part for x in self.chunks_of(part)], len(found)
        return self.chunks_of(text), 0

    @staticmethod
    def chunks_of(text: str) -> list[str]:
        if _MEETING.search(text):
            return [text]
        if "\0" in text:
            first, *rest = text.split(" ")
            return [*([first] if first else []), *map(" ".__add__, rest)]
        chunks = text.replace(" ", "\0 ").split("\0")
        return chunks if chunks[0] else chunks[1:]

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch(tokens, add_special_tokens=False)]


def vocabulary(docs: DataFrame, definition) -> DataFrame:
    """Every distinct pre-token: (token, times, pieces)."""
    most = HELD_CHARS

    def counted(batches):
        cutter, total = Cutter(definition.value), Counter()
        def out():
            tokens = Counter()
            for chunk, times in total.items():
                for token in cutter.cut(chunk):
                    tokens[token] += times
            return pa.RecordBatch.from_arrays([pa.array(tokens.keys(), pa.string()), pa.array(tokens.values(), pa.int64())], ["token", "times"])
        held = 0
        for batch in batches:
            for text in batch.column("text"):
                if text := text.as_py():
                    total.update(cutter.chunks(text)[0])
                    held += len(text)
                    if len(total) > ENTRIES or held > most:
                        yield out()
                        total.clear()
                        held = 0
        yield out()

    def measured(batches):
        cutter = Cutter(definition.value)
        for batch in batches:
            tokens = batch.column("token").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cutter.pieces(tokens), pa.int64())], ["token", "times", "pieces"])

    tokens = docs.select("text").mapInArrow(counted, "token string, times long").groupBy("token").agg(F.sum("times").alias("times"))
    return kept(tokens.mapInArrow(measured, "token string, times long, pieces long"))


def profiles(docs: DataFrame, definition, frequent) -> DataFrame:
    """A row a text: (row, doc_id, n_bytes, known: tokens counted already, tokens, times: the other pre-tokens)."""
    def function(batches):
        cutter, table, seen = Cutter(definition.value), frequent.value, {}
        def looked(chunk):
            known, rest = 0, []
            for token in cutter.cut(chunk):
                if (n := table.get(token)) is None:
                    rest.append(token)
                else:
                    known += n
            return known, rest
        for batch in batches:
            known, tokens, times = [], [], []
            for text in batch.column("text"):
                chunks, total = cutter.chunks(text.as_py() or "")
                others: Counter = Counter()
                for chunk, n in Counter(chunks).items():
                    if (found := seen.get(chunk)) is None:
                        found = looked(chunk)
                        if len(chunk) <= LONGEST:
                            if len(seen) > ENTRIES:
                                seen.clear()
                            seen[chunk] = found
                    total += n * found[0]
                    for token in found[1]:
                        others[token] += n
                known.append(total)
                tokens.append(list(others.keys()))
                times.append(list(others.values()))
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(known, pa.int64()), pa.array(tokens, pa.list_(pa.string())),
                                              pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "known", "tokens", "times"])
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        function, "doc_id long, n_bytes long, known long, tokens array<string>, times array<long>")
    return kept(made.withColumn("row", F.monotonically_increasing_id()))


def token_counts(spark: SparkSession, docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit); `path` is a tokenizer file of byte-level BPE."""
    with open(path, encoding="utf-8") as file:  # the tokenizer, of bounded size, not data
        definition = spark.sparkContext.broadcast(file.read())
    words = vocabulary(docs, definition)
    top = words.where(F.octet_length("token") <= LONGEST).orderBy(F.desc("times"), "token").limit(FREQUENT).select("token", "pieces").toArrow()
    frequent = spark.sparkContext.broadcast(dict(zip(top.column("token").to_pylist(), top.column("pieces").to_pylist())))
    rows = profiles(docs, definition, frequent)
    others = rows.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("x")).select("row", "x.tokens", "x.times")
    summed = others.join(words.select(F.col("token").alias("tokens"), "pieces"), "tokens").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("others"))
    n_tokens = F.col("known") + F.coalesce("others", F.lit(0))
    return rows.select("row", "doc_id", "n_bytes", "known").join(summed, "row", "left").select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
