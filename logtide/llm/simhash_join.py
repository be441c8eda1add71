"""Near-duplicates by SimHash: fingerprints of 64 bits, linked where few bits differ, compared bit plane by bit plane.

1. `fingerprints`: a text's words, A-Z in lower case, make shingles (repeats count; fewer words: the whole sequence as
   one). A bit of the fingerprint is 1 if it is set in over half of the shingles' XXH64. Hashing and counting go through
   blocks of words, so a text of any length needs the memory of one block and its own bytes.
2. Texts with one fingerprint are one class from there on; copies are never compared.
3. Of radius + 1 parts of the bits, two fingerprints within the radius agree in one at least. So each class goes, for
   each part, to the bucket of its bits there. A bucket of more than `BLOCK` classes is dealt again by radius + 1 parts
   of the bits that are still free, until no bucket is larger: a class of a hot bucket costs more rows, never more
   partners, and after a few rounds there are no more than `BLOCK` values of the free bits at all.
4. `linked`: a block of classes is stored as bit planes, one word for 64 classes. The distances of a class to all others
   grow by carry-save addition, plane by plane; words whose 64 lanes are all beyond the radius are abandoned. What leaves
   a task is a forest of links, fewer rows than classes.
5. The components of all links; the smallest id of each.

A null or empty text has fingerprint zero, which links like any other. A row without an id has a fingerprint, no component,
and is nobody's copy. Rows that share an id stay rows of their own, with the component of their own fingerprint. An empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm.common import kept
from logtide.llm.jaccard_join import components

SEED, BITS = 42, 64
#: Classes of a bucket that are compared with each other; of more, the bucket is dealt again.
BLOCK = 8192
#: Small buckets are compared together, up to so many classes.
TOGETHER = 512
#: Classes whose distances grow at once, and planes between two looks at which words to abandon.
TILE, STEP = 256, 8
#: Bytes of a text that are cut into words at once, and shingles whose bits are counted at once.
TEXT_BLOCK, COUNTED = 1 << 20, 1 << 16

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in blocks that end at white space."""
    start = 0
    while len(text) - start > TEXT_BLOCK:
        end = _SPACE.search(text, start + TEXT_BLOCK)
        if not end:
            break
        yield text[start:end.start()]
        start = end.end()
    yield text[start:]


def shingle_hashes(text: str | None, n: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, block by block."""
    held: list[bytes] = []
    many = 0
    for piece in pieces((text or "").encode()):
        words = held + piece.lower().split()  # bytes: A-Z alone, and the six white-space characters
        if len(words) >= n:
            count = len(words) - n + 1
            joined = map(b" ".join, zip(*(words[k:] for k in range(n))))
            yield np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, count)
            many += count
        held = words[-(n - 1):] if n > 1 else []
    if held and not many:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each bit is set, for every run of hashes; the lowest bit first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each of the table."""
    def counted(held):
        return bit_counts(np.concatenate([x for _, x in held]), np.cumsum([0] + [len(x) for _, x in held[:-1]]))

    def function(batches):
        for batch in batches:
            rows = batch.num_rows
            ones, total = np.zeros((rows, BITS), np.int64), np.zeros(rows, np.int64)
            held, many = [], 0
            for row, text in enumerate(batch.column("text")):
                for found in shingle_hashes(text.as_py(), n):
                    total[row] += len(found)
                    for part in np.array_split(found, -(-len(found) // COUNTED)):
                        held.append((row, part))
                        many += len(part)
                        if many >= COUNTED:
                            np.add.at(ones, [r for r, _ in held], counted(held))
                            held, many = [], 0
            if held:
                np.add.at(ones, [r for r, _ in held], counted(held))
            most = (2 * ones > total[:, None]).astype(np.uint8)
            prints = np.packbits(most, axis=1, bitorder="little").view(np.int64)[:, 0] if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(function, "doc_id long, fp long")


def parts(free: list[int], radius: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(free), radius + 1)]


def mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def close(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the least index of its component, by links among these within the radius."""
    count = len(prints)
    words = -(-count // 64)
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(count, 8), axis=1, bitorder="little")
    padded = np.zeros((BITS, words * 64), np.uint8)
    padded[:, :count] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    varied = np.flatnonzero((bits != bits[0]).any(axis=0))  # in the others all agree
    label = np.arange(count)
    for first in range(0, count, TILE):
        rows = np.arange(first, min(first + TILE, count))
        # Lanes up to the row's own, and those that stand for no class, are taken as beyond the radius.
        lane = np.arange(words * 64)
        beyond = np.packbits((lane[None, :] <= rows[:, None]) | (lane >= count), axis=1, bitorder="little").view(np.uint64)
        own = np.where(bits[rows] == 1, _ALL, np.uint64(0))
        row, word = np.nonzero(beyond != _ALL)
        over = beyond[row, word]
        sums = [np.zeros(len(row), np.uint64) for _ in range(radius.bit_length())]
        for turn in range(0, len(varied), STEP):
            for plane in varied[turn:turn + STEP].tolist():
                carry = planes[plane][word] ^ own[row, plane]
                for k in range(len(sums)):
                    sums[k], carry = sums[k] ^ carry, sums[k] & carry
                over |= carry | exceeds(sums, radius)
            alive = over != _ALL
            if not alive.all():
                row, word, over = row[alive], word[alive], over[alive]
                sums = [x[alive] for x in sums]
            if not len(row):
                break
        if len(row):
            near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, at = np.nonzero(near)
            merge(label, rows[row[which]], word[which] * 64 + at)
    return label


def exceeds(sums: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose number is over the radius, by comparing from the highest digit down."""
    larger, equal = np.uint64(0), _ALL
    for k in reversed(range(len(sums))):
        if radius >> k & 1:
            equal = equal & sums[k]
        else:
            larger = larger | (equal & sums[k])
            equal = equal & ~sums[k]
    return larger


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of each pair; a is sorted."""
    edges = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
        groups = np.unique(np.append(label[b[x:y]], label[a[x]]))
        if len(groups) > 1:
            label[np.isin(label, groups[1:])] = groups[0]


def linked(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) among the fingerprints of each bucket (mask, part, fp), as a forest."""
    def made(prints):
        label = close(prints, radius)
        ends = np.flatnonzero(label != np.arange(len(prints)))
        return pa.RecordBatch.from_arrays([pa.array(prints[label[ends]]), pa.array(prints[ends])], ["a", "b"])

    def function(batches):
        held: list[np.ndarray] = []  # whole buckets, compared together, and the one that may go on
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            masks, part, prints = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((masks[1:] != masks[:-1]) | (part[1:] != part[:-1])) + 1
            bounds = [0, *edges.tolist(), len(prints)]
            for start, end in zip(bounds[:-1], bounds[1:]):
                here = (int(masks[start]), int(part[start]))
                if here == last:
                    held[-1] = np.concatenate((held[-1], prints[start:end]))
                    continue
                if held and sum(map(len, held)) + end - start > TOGETHER:
                    yield made(np.unique(np.concatenate(held)))
                    held = []
                held.append(prints[start:end])
                last = here
        if held:
            yield made(np.unique(np.concatenate(held)))
    return rows.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp").mapInArrow(function, "a long, b long")


def links(classes: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """All components' links (a, b) of distinct fingerprints `fp`: buckets of parts, hot ones dealt again by their free bits."""
    bucket = F.col("fp").bitwiseAND(F.col("mask")).alias("part")
    freed = {mask(x): [b for b in range(BITS) if b not in x] for x in parts(list(range(BITS)), radius)}
    rows = classes.select("fp", F.explode(F.array(*map(F.lit, freed))).alias("mask")).select("mask", bucket, "fp")
    found = None
    while True:
        hot = kept(rows.groupBy("mask", "part").count().where(F.col("count") > block).select("mask", "part"))
        last = hot.isEmpty()
        cold = rows if last else rows.join(hot, ["mask", "part"], "left_anti")
        some = kept(linked(cold, radius))
        found = some if found is None else found.union(some)
        if last:
            return found
        finer = {m: {mask([b for b in range(BITS) if b not in free] + x): [b for b in free if b not in x] for x in parts(free, radius) if x}
                 for m, free in freed.items() if free}
        choices = F.create_map(*[x for m, children in finer.items() for x in (F.lit(m), F.array(*map(F.lit, children)))])
        rows = kept(rows.join(hot, ["mask", "part"], "left_semi").select("fp", F.explode(choices[F.col("mask")]).alias("mask"))
                    .distinct().select("mask", bucket, "fp"))
        freed = {m: free for children in finer.values() for m, free in children.items()}


def near_duplicates(spark: SparkSession, docs: DataFrame, n: int = 3, radius: int = 2) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of the table."""
    prints = kept(fingerprints(docs, n))
    classes = kept(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(classes, radius)).select(F.col("key").alias("fp"), "root")
    named = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    several = kept(named.where(F.col("copies") > 1).select("fp", "root").union(roots).distinct())
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    shared = kept(several.join(least, "root").select("fp", "component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return prints.join(shared, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
