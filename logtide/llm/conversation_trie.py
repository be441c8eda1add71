"""A trie of conversation prefixes: members, leaves and saved tokens of every distinct sequence of first turns.

1. `rebuilt`: a conversation's turns by (turn, role, digest), nulls first; its first turns are those of the conversation
   it shares them with. A turn is its 128-bit digest and its number of words; texts are not moved.
2. The sequences are dealt by range of (sequence, conv_id), so a task holds a range of the trie, and a sequence that very
   many conversations have is spread over tasks as well.
3. `shard_rows`: a task goes through its range in shards of bounded size. A shard's turns are encoded by a dictionary of
   its own, and its sequences put into ternary search trees, medians first, which balances them. An iterative traversal
   gives the nodes in order, and a stack (`Fold`) adds members, leaves and savings up as nodes end.
4. Only the prefixes of a task's first and last sequence may go on in other tasks. They leave it as boundary rows, as many
   as these two sequences are long, and one more `Fold` over those, in the order of tasks, merges them.
5. Ids that end at a node are hashed where the node ends; those of boundary nodes, and lists over `TEXT_KEPT`, leave as chunks of
   text, sorted and hashed in a stream. A node gets its parent's conv_id by a join.

A conversation is one value in a task, 48 bytes a turn. Null roles and texts are empty. Rows without a conv_id take no
part. Ties of turn are in the order of role, then of the turn's digest; a repeated row is a turn of its own. An empty
table has no rows, not even a root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.llm.common import kept

#: Turns and conversations of a shard.
SHARD = 1 << 16
#: Bytes of ids that a node holds before they leave as a chunk, and ids that are written at once.
TEXT_KEPT, IDS = 1 << 16, 1024
DIGEST = 16
ROOT = bytes(DIGEST)

NODE = "key binary, parent binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
ROWS = NODE + ", kind int, shard long, at long, words long, text string"


def rebuilt(rows: DataFrame, every: int = 20, shared: int = 4) -> DataFrame:
    """(conv_id, sequence, words): the turns' digests in one binary, and each turn's words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    conv_id = F.col("conv_id").cast("long")
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        conv_id.alias("conv_id"), (conv_id - conv_id % every).alias("base"), F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), words.alias("words")).alias("x"))
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("x")).alias("own"))
    own = own.select("base", "conv_id", F.transform("own", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("own"))
    # A base has `every` conversations at most.
    first = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, shared)), ignorenulls=True).over(Window.partitionBy("base"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)).cast("int")
    both = own.withColumn("first", first).withColumn("taken", taken)
    left = F.slice("own", F.col("taken") + 1, F.greatest(F.size("own") - F.col("taken"), F.lit(0)))
    turns = F.when(F.col("first").isNull(), left).otherwise(F.concat(F.slice("first", F.lit(1), F.col("taken")), left))
    return both.select("conv_id", turns.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("sequence"),
        F.transform("turns", lambda x: x["words"].cast("int")).alias("words"))


class Tree:
    """Ternary search trees, one below another: `low` and `high` are siblings, `next` is the tree of the turns that follow."""

    def __init__(self):
        self.code, self.low, self.high, self.next, self.ends = [-1], [-1], [-1], [-1], [-1]

    def insert(self, sequence: list[int], number: int) -> None:
        node = 0
        for code in sequence:
            here, link, parent = self.next[node], self.next, node
            while here >= 0 and self.code[here] != code:
                link, parent = (self.low, here) if code < self.code[here] else (self.high, here)
                here = link[here]
            if here < 0:
                here = link[parent] = len(self.code)
                self.code.append(code)
                for column in (self.low, self.high, self.next, self.ends):
                    column.append(-1)
            node = here
        self.ends[node] = number

    def nodes(self) -> Iterator[tuple[int, int, int]]:
        """(depth, code, number of the sequence that ends there or -1), each node before those below it, siblings ascending."""
        yield 0, -1, self.ends[0]
        open_ = [(self.next[0], 1, False)]
        while open_:
            node, depth, passed = open_.pop()
            if node < 0:
                continue
            if passed:
                yield depth, self.code[node], self.ends[node]
                open_.append((self.next[node], depth + 1, False))
            else:
                open_ += [(self.high[node], depth, False), (node, depth, True), (self.low[node], depth, False)]


def medians(count: int) -> Iterator[int]:
    """0 to count - 1, the middle of every stretch before its halves."""
    open_ = [(0, count)]
    while open_:
        start, end = open_.pop()
        if start < end:
            middle = (start + end) // 2
            yield middle
            open_ += [(middle + 1, end), (start, middle)]


class Node:
    """An open node. Its sums are of itself and of the children that have ended."""

    __slots__ = ("key", "parent", "words", "first", "conv", "members", "children", "leaves", "saved", "text", "length", "loose")

    def __init__(self, key, parent, words, first):
        self.key, self.parent, self.words, self.first = key, parent, words, first
        self.conv, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.text, self.length, self.loose = [], 0, first

    def add(self, conv, members, children, leaves, saved):
        if conv is not None:
            self.conv = conv if self.conv is None else min(self.conv, conv)
        self.members += members
        self.children += children
        self.leaves += leaves
        self.saved += saved


class Fold:
    """The open nodes, from the root down. Nodes come in the order of the trie; one that is open already goes on."""

    def __init__(self, shard: int, most: int):
        self.open: list[Node] = []
        self.shard, self.most, self.at, self.began = shard, most, 0, []
        self.out: list[tuple] = []

    def step(self, depth: int, key, parent, words: int, first: bool) -> Node:
        if depth < len(self.open) and self.open[depth].key == key:
            return self.open[depth]
        self.end(depth)
        self.open.append(Node(key, parent, words, first))
        if first:
            self.began.append(self.open[-1])
        return self.open[-1]

    def end(self, depth: int) -> None:
        """The nodes at this depth and below have all their members."""
        while len(self.open) > depth:
            node = self.open.pop()
            if node.first:
                continue  # others may hold more of it
            leaves, saved = node.leaves if node.children else 1, node.saved + (node.members - 1) * node.words
            if node.loose:
                self.chunk(node)
            ends = None if node.loose else hashlib.sha256(",".join(node.text).encode()).hexdigest()
            self.out.append((node.key, node.parent, node.conv, len(self.open), node.members, node.children, leaves, saved, ends, 0, None, None, None, None))
            if self.open:
                self.open[-1].add(node.conv, node.members, 1, leaves, saved)

    def ids(self, node: Node, convs: list[int]) -> None:
        """Conversations that end at the node, ascending."""
        node.add(convs[0], len(convs), 0, 0, 0)
        for start in range(0, len(convs), IDS):
            text = ",".join(map(str, convs[start:start + IDS]))
            node.text.append(text)
            node.length += len(text) + 1
            if node.length > self.most:
                node.loose = True
                self.chunk(node)

    def chunk(self, node: Node) -> None:
        if node.text:
            self.out.append((node.key, *[None] * 8, 2, self.shard, self.at, None, ",".join(node.text)))
            self.at += 1
            node.text, node.length = [], 0

    def boundary(self) -> None:
        """What may go on elsewhere: the nodes of the first sequence, then the others that are open."""
        began = {id(x) for x in self.began}
        for depth, node in [*enumerate(self.began), *[(d, x) for d, x in enumerate(self.open) if id(x) not in began]]:
            self.chunk(node)
            self.out.append((node.key, node.parent, node.conv, depth, node.members, node.children, node.leaves, node.saved, None, 1, self.shard, self.at, node.words, None))
            self.at += 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        types = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "int": pa.int32()}
        named = [x.strip().split() for x in ROWS.split(",")]
        if self.out:
            yield pa.RecordBatch.from_arrays([pa.array(x, types[t]) for x, (_, t) in zip(zip(*self.out), named)], [n for n, _ in named])
        self.out = []


def below(parent: bytes, digest: bytes) -> bytes:
    return hashlib.md5(parent + digest).digest()


def shard_rows(sequences: DataFrame) -> DataFrame:
    """Nodes that end within their task (kind 0), boundary nodes (1), chunks of ids (2); sequences come sorted."""
    shard, most = SHARD, TEXT_KEPT

    def planted(fold: Fold, rows: list[tuple], first_length: int | None) -> None:
        distinct: list[tuple[bytes, object, list[int]]] = []
        for sequence, words, conv in rows:
            if not distinct or distinct[-1][0] != sequence:
                distinct.append((sequence, words, []))
            distinct[-1][2].append(conv)
        turns = np.frombuffer(b"".join(x[0] for x in distinct), f"S{DIGEST}")
        names, place, codes = np.unique(turns, return_index=True, return_inverse=True)
        counts = np.concatenate([np.asarray(x[1], np.int64) for x in distinct])[place].tolist()
        digests = [turns[i:i + 1].tobytes() for i in place.tolist()]
        ends = np.cumsum([len(x[0]) // DIGEST for x in distinct]).tolist()
        codes, tree = codes.tolist(), Tree()
        for k in medians(len(distinct)):
            tree.insert(codes[ends[k] - len(distinct[k][0]) // DIGEST:ends[k]], k)
        path = [ROOT]
        for number, (depth, code, ending) in enumerate(tree.nodes()):
            parent = path[depth - 1] if depth else None
            key = below(parent, digests[code]) if depth else ROOT
            path[depth:] = [key]
            node = fold.step(depth, key, parent, counts[code] if depth else 0, first_length is not None and number <= first_length)
            if ending >= 0:
                fold.ids(node, distinct[ending][2])

    def function(batches):
        fold, rows, size, first_length = Fold(TaskContext.get().partitionId(), most), [], 0, None
        begun = False
        for batch in batches:
            for conv, sequence, words in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "sequence", "words"))):
                if not begun and not rows:
                    first_length = len(sequence) // DIGEST
                rows.append((sequence, words, conv))
                size += 1 + len(sequence) // DIGEST
                if size >= shard:
                    planted(fold, rows, None if begun else first_length)
                    begun, rows, size = True, [], 0
                    yield from fold.rows()
        if rows:
            planted(fold, rows, None if begun else first_length)
        fold.boundary()
        yield from fold.rows()
    dealt = sequences.repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    return dealt.mapInArrow(function, ROWS)


def merged(boundary: DataFrame) -> DataFrame:
    """The boundary nodes of all tasks, in their order: as many rows as tasks have first and last turns."""
    def function(batches):
        fold = Fold(0, TEXT_KEPT)
        for batch in batches:
            for row in batch.to_pylist():
                node = fold.step(row["depth"], row["key"], row["parent"], row["words"], False)
                node.loose = True
                node.add(row["conv_id"], row["n_convs"], row["n_children"], row["n_leaves"], row["saved_tokens"])
            yield from fold.rows()
        fold.end(0)
        yield from fold.rows()
    return boundary.repartition(1).sortWithinPartitions("shard", "at").mapInArrow(function, ROWS)


def hashed(chunks: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of each node's chunks, in their order."""
    def function(batches):
        here, state = None, None
        for batch in batches:
            out = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if key != here:
                    if state:
                        out.append((here, state.hexdigest()))
                    here, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["key", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([here], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])
    dealt = chunks.select("key", "shard", "at", "text").repartition("key").sortWithinPartitions("key", "shard", "at")
    return dealt.mapInArrow(function, "key binary, ends string")


def prefix_trie(spark: SparkSession, rows: DataFrame, every: int = 20, shared: int = 4) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = kept(shard_rows(rebuilt(rows, every, shared)))
    whole = merged(found.where("kind = 1")).select(*found.columns)
    nodes = kept(found.where("kind = 0").union(whole.where("kind = 0")).select("key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"))
    late = hashed(found.where("kind = 2")).withColumnRenamed("ends", "late")
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.where("ends is not null").withColumn("late", F.lit(None).cast("string"))
    open_ = nodes.where("ends is null").join(late, "key", "left").select(*told.columns)
    empty = hashlib.sha256(b"").hexdigest()
    return told.union(open_).join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", "late", F.lit(empty)).alias("ends_sha256"))
