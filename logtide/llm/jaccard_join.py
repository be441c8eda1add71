"""Groups of near-copies: an exact similarity join on word shingles by prefix filtering.

Two texts link when the Jaccard similarity of their sets of distinct shingles reaches a threshold; a component is what
links connect. Every set is put in one order for all texts, rare shingles first, and linked sets must share a shingle
within their prefixes, so the join is on prefix shingles.

1. `read`: each text's set size, a key of the whole set, its part sizes (see `far_apart`), and how often each of a fixed
   number of shingle slots occurs in all texts. Texts with one set are one class from there on; copies are never paired.
2. `prefixes`: (shingle, class, size, position), for the prefix alone.
3. `stars`: the rows of a shingle pass in a stream. Few classes are all paired; of more, each is paired with some of its
   length that lead them, so that pairs grow with the rows, whatever the size of the group. Verified pairs give first components.
4. `unjoined`: the rows of the other shingles that are in more than one component; of shingles with the same classes, one stands for all.
5. `suspects`: of these the rows that the length, positional and suffix filters admit with a row of another component, at the first
   shingle that both share. Pairs do not leave the task, only the rows; a large group is dealt over tasks by cells (`dealt`).
6. `joined`: these rows with their sets. A pair is verified where it is, and only if no link has joined its components before; what leaves is a
   forest of links.

Sets are made from texts in the scan: a table of bits of fixed size lets the few texts that are needed pass. Only their sets are
shuffled, as compressed texts where that is shorter (`packed`). Rows without an id take no part and have no component; a text without words is empty, with links to nothing.
Rows that share an id are told apart by their sets, and carry the id each. A text of any length is one row: its set takes
eight bytes a shingle. An empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.llm.common import CHUNK_BYTES, empty_table, flat, has, kept, slices, with_bits
from logtide.llm.words import NOT_SPACE, mixed, shingles, words

#: Slots of the shingle counts that give the order: fixed, so their size is bounded (8 MB).
SLOTS, SLOT_BLOCK = 1 << 21, 1 << 14
#: Higher counts of a slot, in a task and in all, are as one for the order.
MOST_IN_TASK, MOST_COUNTED = (1 << 16) - 1, (1 << 32) - 1
#: Parts that a set is cut to by fixed pivots, for the suffix filter.
PARTS = 256
#: Classes of a shingle that are all paired; of more, so many of a length that every other is compared with at first.
LEADERS = 4
#: Rows, and bytes of sets, of one shingle that are compared in one task; of more, the group is dealt over cells.
CELL_ROWS, CELL_BYTES = 1 << 14, 16 << 20
#: Shingles of a row's class just before its own that are remembered with it, to leave out pairs that were taken there.
REMEMBERED_BEFORE = 16
#: Partners of a set that are verified in one task.
PARTNERS = 1000
#: Set keys that a task remembers to leave out copies early; later ones leave in the join.
REMEMBERED = 200_000


def least_overlap(sizes, percent: int):
    """The smallest intersection of two linked sets, from the sum of their sizes: percent * (sum - i) <= 100 * i."""
    return -(-percent * sizes // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in slices(batch):
        yield part, shingles(words(*flat(part.column("text")), NOT_SPACE), n)


def set_key(values: np.ndarray) -> np.int64:
    """One number for a whole set, in any order."""
    return mixed(mixed(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(values))).view(np.int64)[0]


def part_sizes(found: list[np.ndarray]) -> np.ndarray:
    """A row of part sizes for each set, 255 at most."""
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    joined = np.concatenate(found) if found else np.zeros(0, np.uint64)
    cells = np.bincount(owner * PARTS + (joined >> np.uint64(56)).astype(np.int64), minlength=len(found) * PARTS)
    return np.minimum(cells, 255).astype(np.uint8).reshape(-1, PARTS)


def packed(text: bytes, values: np.ndarray) -> bytes:
    """What a set travels as: its text, compressed, after the text's length; or 0 and the set, where that is shorter."""
    short = pa.compress(text, codec="zstd", asbytes=True)
    return len(text).to_bytes(8, "little") + short if len(short) < values.nbytes else bytes(8) + values.tobytes()


def unpacked(column, n: int) -> Iterator[np.ndarray]:
    """The sets of a column of `packed` ones, in order; texts are cut to shingles some MB at a time."""
    held, size = [], 0

    def cut():
        texts = [x for x in held if isinstance(x, bytes)]
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in texts], dtype=np.int64)))
        found = iter(shingles(words(np.frombuffer(b"".join(texts), np.uint8), offsets, NOT_SPACE), n))
        for x in held:
            yield next(found) if isinstance(x, bytes) else x
    for value in column:
        value = value.as_py()
        length, rest = int.from_bytes(value[:8], "little"), value[8:]
        held.append(pa.decompress(rest, length, codec="zstd", asbytes=True) if length else np.frombuffer(rest, np.uint64))
        size += length
        if size > CHUNK_BYTES:
            yield from cut()
            held, size = [], 0
    yield from cut()


def read(docs: DataFrame, n: int) -> DataFrame:
    """A row for each text; for each task, its counts of shingle slots in blocks."""
    def function(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part, found in sets(batch, n):
                joined = np.concatenate(found) if found else np.zeros(0, np.uint64)
                np.add.at(counts, (joined & np.uint64(SLOTS - 1)).astype(np.int64), 1)
                rows = len(found)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array([set_key(x) for x in found], pa.int64()),
                    pa.array([x.tobytes() for x in part_sizes(found)], pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                    ["doc_id", "size", "key", "parts", "block", "counts"])
        blocks = SLOTS // SLOT_BLOCK
        yield pa.RecordBatch.from_arrays([
            pa.nulls(blocks, pa.int64()), pa.nulls(blocks, pa.int64()), pa.nulls(blocks, pa.int64()), pa.nulls(blocks, pa.binary()),
            pa.array(range(blocks), pa.int32()), pa.array([np.minimum(x, MOST_IN_TASK).astype(np.uint16).tobytes() for x in counts.reshape(blocks, -1)], pa.binary())],
            ["doc_id", "size", "key", "parts", "block", "counts"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        function, "doc_id long, size long, key long, parts binary, block int, counts binary")


def slot_counts(seen: DataFrame) -> np.ndarray:
    """The tasks' counts, added up block by block on the executors."""
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                total[block] = total.get(block, 0) + np.frombuffer(counts, np.uint16).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([np.minimum(x, MOST_COUNTED).astype(np.uint32).tobytes() for x in total.values()], pa.binary())],
                                         ["block", "counts"])
    blocks = seen.where("block is not null").select("block", "counts").repartition(SLOTS // SLOT_BLOCK, "block")
    counts = np.zeros((SLOTS // SLOT_BLOCK, SLOT_BLOCK), np.uint32)
    for row in blocks.mapInArrow(add, "block int, counts binary").toLocalIterator():
        counts[row.block] = np.frombuffer(row.counts, np.uint32)
    return counts.ravel()


def prefixes(docs: DataFrame, counts, n: int, percent: int) -> DataFrame:
    """The rarest shingles of every set, by (count of its slot, hash), as many as a link must share one of."""
    def function(batches):
        order, passed = counts.value, set()
        for batch in batches:
            for _, found in sets(batch, n):
                columns = [], [], [], []
                for values in found:
                    size = len(values)
                    if not size or (key := int(set_key(values))) in passed:
                        continue
                    if len(passed) < REMEMBERED:
                        passed.add(key)
                    length = prefix_length(size, percent)
                    rare = np.argsort(order[(values & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")[:length]
                    for column, x in zip(columns, (values[rare].view(np.int64), np.full(length, key), np.full(length, size), np.arange(length))):
                        column.append(x)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in columns], ["h", "key", "size", "pos"])
    return docs.where("doc_id is not null").select("text").mapInArrow(function, "h long, key long, size long, pos long")


def admitted(size_a, pos_a, size_b, pos_b, percent: int):
    """The length and the positional filter, for a shingle that both sets hold at these positions of the order."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    most = 1 + np.minimum(pos_a, pos_b) + np.minimum(size_a - pos_a, size_b - pos_b) - 1
    return (100 * small >= percent * large) & (most >= least_overlap(size_a + size_b, percent))


def stars(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) along each shingle; the rows (b null) of shingles of which not all pairs are among these.

    All pairs of a shingle of at most LEADERS classes are taken. Of others, the rows are grouped by size: within a
    length class the length filter admits every pair. Each row is paired with the LEADERS least keys of its length class,
    which are mostly the same along all shingles of a group of copies, and the least key of a length class with those of
    the class before it.
    """
    def function(batches):
        here, group, long, leaders, last, out, pairs = None, [], False, [], None, [], []

        def follow(row):
            nonlocal leaders
            out.append(row[:4])
            pairs.extend((*leader[1:4], *row[1:4]) for leader in leaders)
            if leaders and leaders[0][4] == row[4]:
                if len(leaders) < LEADERS:
                    leaders.append(row)
            else:
                leaders = [row]

        def made():
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] + [pa.nulls(len(out), pa.int64())] * 2,
                                                 ["h", "a", "size_a", "pos", "b", "size_b"])
            if pairs:
                a, size_a, pos_a, b, size_b, pos_b = np.array(pairs, np.int64).T
                ok = admitted(size_a, pos_a, size_b, pos_b, percent)
                turn = ((size_a > size_b) | ((size_a == size_b) & (a > b)))[ok]
                a, size_a, b, size_b = a[ok], size_a[ok], b[ok], size_b[ok]
                a, b, size_a, size_b = np.unique(np.stack([np.where(turn, b, a), np.where(turn, a, b), np.where(turn, size_b, size_a), np.where(turn, size_a, size_b)]), axis=1)
                nothing = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([nothing, pa.array(a), pa.array(size_a), nothing, pa.array(b), pa.array(size_b)],
                                                 ["h", "a", "size_a", "pos", "b", "size_b"])
            out.clear()
            pairs.clear()

        def close():
            if not long:
                pairs.extend((*x[1:4], *y[1:4]) for x, y in combinations(group, 2))

        for batch in batches:
            h, key, size, pos, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(h):
                continue
            same = h[1:] == h[:-1]
            several = np.ones(len(h), bool)  # the last row's shingle may go on
            several[:-1] = same
            several[1:] |= same
            several[0] |= h[0] == here
            pick = np.flatnonzero(several)
            for row in zip(h[pick].tolist(), key[pick].tolist(), size[pick].tolist(), pos[pick].tolist(), length[pick].tolist()):
                if row[0] != here:
                    close()
                    here, group, long, leaders, last = row[0], [row], False, [], row[1]
                elif row[1] != last:
                    last = row[1]
                    if long:
                        follow(row)
                        continue
                    group.append(row)
                    if len(group) > LEADERS:
                        long = True
                        for each in group:
                            follow(each)
            yield from made()
        close()
        yield from made()
    length = F.floor(F.log(100 / percent, F.col("size"))).alias("length")
    return rows.select("*", length).repartition("h").sortWithinPartitions("h", "length", "key").mapInArrow(
        function, "h long, a long, size_a long, pos long, b long, size_b long")


def far_apart(parts_a: np.ndarray, parts_b: np.ndarray) -> np.ndarray:
    """The suffix filter's bound: what two sets differ in is at least what the sizes of their parts differ by."""
    return np.abs(parts_a.astype(np.int16) - parts_b).sum(axis=-1, dtype=np.int64)


def pair_ids(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number for a row's id and its set."""
    return mixed(keys.view(np.uint64) ^ mixed(ids.view(np.uint64) + np.uint64(1)))


def id_bits(rows: DataFrame) -> np.ndarray:
    """A table with the bits of the ids, and of the ids with their sets, of rows (doc_id, key)."""
    def function(batches):
        for batch in batches:
            ids, keys = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "key"))
            both = np.concatenate((mixed(ids.view(np.uint64)), pair_ids(ids, keys)))
            yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64))], ["id"])
    return with_bits(empty_table(), rows.select("doc_id", "key").mapInArrow(function, "id long"))


def with_keys(part: pa.RecordBatch, table: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of rows whose id and set have their bits: their places, set keys and sets. Only texts whose id has its bits are cut to shingles."""
    ids = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
    place = np.flatnonzero(has(table, mixed(ids.view(np.uint64))) & part.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
    if not len(place):
        return place, np.zeros(0, np.int64), []
    found = shingles(words(*flat(part.column("text").take(pa.array(place))), NOT_SPACE), n)
    keys = np.array([set_key(x) for x in found], np.int64)
    ok = has(table, pair_ids(ids[place], keys))
    return place[ok], keys[ok], [x for x, yes in zip(found, ok.tolist()) if yes]


def sets_of(wanted: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(key, values): the sets of the wanted (doc_id, key), as `packed`. A few others may be among them."""
    table = docs.sparkSession.sparkContext.broadcast(id_bits(wanted))

    def function(batches):
        for batch in batches:
            for part in slices(batch):
                place, keys, found = with_keys(part, table.value, n)
                if len(keys):
                    texts = part.column("text").take(pa.array(place)).fill_null("").cast(pa.binary()).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([packed(*x) for x in zip(texts, found)], pa.binary())], ["key", "values"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(function, "key long, values binary").dropDuplicates(["key"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The linked ones among distinct pairs (a, size_a, b, size_b). Each b meets the set of its a in a stream; an a with many is dealt over tasks."""
    def near(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(-1, PARTS) for x in ("parts_a", "parts_b"))
                size = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
                ok = far_apart(a, b) <= size - 2 * least_overlap(size, percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    def met(batches):
        here, held = None, None
        for batch in batches:
            out = []
            for a, b, values in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), unpacked(batch.column("values"), n)):
                if b is None:
                    here, held = a, values
                elif a == here and linked(held, values, percent):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    side = lambda x: classes.select(F.col("key").alias(x), F.col("parts").alias(f"parts_{x}"))
    left = kept(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "size_a", "b", "size_b", "parts_a", "parts_b")
                .mapInArrow(near, "a long, b long"))
    wanted = left.select(F.col("a").alias("key")).union(left.select("b")).distinct().join(classes.select("key", "doc_id"), "key")
    deals = left.groupBy("a").agg(F.expr(f"count(*) div {PARTNERS} + 1").alias("deals"))
    leaders = deals.select(F.col("a").alias("key"), "a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    others = left.join(deals, "a").select(F.col("b").alias("key"), "a", "b", F.pmod(F.xxhash64("b"), "deals").alias("deal"))
    rows = leaders.union(others).join(sets_of(kept(wanted), docs, n), "key").repartition("a", "deal").sortWithinPartitions("a", "deal", F.asc_nulls_first("b"))
    return kept(rows.select("a", "b", "values").mapInArrow(met, "a long, b long"))


def dealt(rows: DataFrame, weight, limit: int, percent: int) -> DataFrame:
    """The rows with the `cell` of their shingle they are compared in, and their `side` there.

    A group within the limit is one cell. A larger one has blocks of rows by hash: two of one length class meet in the
    cell of their blocks, two of neighbouring classes in a cell of the lower one, where both have a side of their own.
    """
    blocks = rows.groupBy("h").agg(F.expr(f"cast(ceil(sum({weight}) / {limit}) as int)").alias("blocks"))
    length, block = F.floor(F.log(100 / percent, F.col("size"))).cast("string"), F.pmod(F.xxhash64("a"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)
    name = lambda kind, c, i, j: F.concat_ws(",", F.lit(kind), c, i, j)
    below = (length.cast("long") - 1).cast("string")
    cells = F.concat(
        F.transform(every, lambda j: F.struct(name("=", length, F.least(block, j), F.greatest(block, j)).alias("cell"), F.lit(0).alias("side"))),
        F.transform(every, lambda j: F.struct(name("<", length, block, j).alias("cell"), F.lit(1).alias("side"))),
        F.transform(every, lambda j: F.struct(name("<", below, j, block).alias("cell"), F.lit(2).alias("side"))))
    one = F.array(F.struct(F.lit("").alias("cell"), F.lit(0).alias("side")))
    return rows.join(blocks, "h").select(*rows.columns, F.explode(F.when(F.col("blocks") > 1, cells).otherwise(one)).alias("c")).select(*rows.columns, "c.cell", "c.side")


def in_cells(rows: DataFrame, columns: list[str], function, schema: str) -> DataFrame:
    """function(cell) for each cell's rows (a table of its columns), cells in a stream."""
    names = ["h", "cell", "side", *columns]

    def run(batches):
        held: list[pa.RecordBatch] = []  # of the cell that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            h, cell = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((h[1:] != h[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), len(h)]
            parts = [batch.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:])]
            if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) == (h[0], cell[0]):
                held.append(parts.pop(0))
            if parts:
                if held:
                    yield from function(pa.Table.from_batches(held))
                for part in parts[:-1]:
                    if part.num_rows > 1:
                        yield from function(pa.Table.from_batches([part]))
                held = parts[-1:]
        if held:
            yield from function(pa.Table.from_batches(held))
    return rows.select(*names).repartition("h", "cell").sortWithinPartitions("h", "cell", "size", "a").mapInArrow(run, schema)


def earlier(before: list[np.ndarray], i: int, j: np.ndarray) -> np.ndarray:
    """Which rows j share a shingle with row i already before the cell's own."""
    if not len(before[i]):
        return np.zeros(len(j), bool)
    sizes = np.array([len(before[k]) for k in j.tolist()])
    held = np.isin(np.concatenate([before[k] for k in j.tolist()]), before[i])
    total = np.concatenate(([0], np.cumsum(held)))
    ends = np.cumsum(sizes)
    return total[ends] > total[ends - sizes]


def partners(cell: pa.Table, percent: int, parts, same=None) -> Iterator[tuple[int, np.ndarray]]:
    """Each row outside the most frequent component with the later ones, or those of it, that all filters admit in another component,
    where neither remembers an earlier shingle that both share. `parts`() has the rows' part sizes."""
    side, size, key, pos, root = (cell.column(x).to_numpy() for x in ("side", "size", "a", "pos", "root"))
    roots, where, many = np.unique(root, return_inverse=True, return_counts=True)
    if len(roots) < 2:
        return
    parts, before = parts(), [np.array(x, np.int64) for x in cell.column("before").to_pylist()]
    outside = where != many.argmax()
    for i in np.flatnonzero(outside):
        ok = admitted(size[i], pos[i], size, pos, percent) & (root != root[i]) & ((side != side[i]) | (side[i] == 0))
        ok[:i] &= ~outside[:i]  # those pairs were taken already
        j = np.flatnonzero(ok)
        if same is not None:
            j = j[[not same(root[i], root[k]) for k in j.tolist()]] if len(j) else j
        total = size[i] + size[j]
        j = j[far_apart(parts[i], parts[j]) <= total - 2 * least_overlap(total, percent)]
        if j.size:
            j = j[~earlier(before, i, j)]
        if j.size:
            yield int(i), j


def unjoined(rows: DataFrame) -> DataFrame:
    """The rows (h, size, a, pos, root) of shingles in more than one component, with the shingles `before` their own in the class's prefix.

    What two sets share is bounded at any shingle of both, so of shingles with the same classes one stands for all. The others are in nobody's
    `before`, and neither are shingles of which all pairs were taken: a pair is taken at the first shingle of these rows that both share.
    Only the last ones are remembered, so rows stay small; a pair may be taken once more where more lie between.
    """
    shared = rows.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"),
                                   F.bit_xor(F.xxhash64("a")).alias("x"), F.bit_xor(F.xxhash64("a", F.lit(1))).alias("y")).where("low <> high")
    one = shared.groupBy("n", "x", "y").agg(F.min("h").alias("h")).select("h")
    last = Window.partitionBy("a").orderBy("pos").rowsBetween(-REMEMBERED_BEFORE, -1)
    return rows.join(one, "h", "left_semi").withColumn("before", F.collect_list("h").over(last))


def suspects(rows: DataFrame, told: DataFrame, percent: int) -> DataFrame:
    """(h, a): the rows of `unjoined` that are some row's partners; `told` has the parts of each a.

    Rows are dealt over cells before anything large is joined to them.
    """
    def function(cell):
        found = np.zeros(cell.num_rows, bool)
        for i, j in partners(cell, percent, lambda: np.frombuffer(b"".join(cell.column("parts").to_pylist()), np.uint8).reshape(-1, PARTS)):
            found[i] = found[j] = True
        if found.any():
            yield cell.select(["h", "a"]).filter(pa.array(found)).combine_chunks().to_batches()[0]
    return in_cells(dealt(rows, "1", CELL_ROWS, percent).join(told, "a"), ["size", "a", "pos", "root", "before", "parts"], function, "h long, a long")


def joined(rows: DataFrame, told: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) among rows of `unjoined`, as a forest for each cell; `told` has the set (`values`) of each a."""
    def function(cell):
        top: dict[int, int] = {}

        def find(x):
            while (up := top.get(x, x)) != x:
                top[x] = top.get(up, up)
                x = up
            return x
        keys, root = (cell.column(x).to_pylist() for x in ("a", "root"))
        values = list(unpacked(cell.column("values"), n))
        out = []
        for i, near in partners(cell, percent, lambda: part_sizes(values), lambda x, y: find(int(x)) == find(int(y))):
            for j in near.tolist():
                if find(root[i]) == find(root[j]):
                    continue  # joined meanwhile
                if linked(values[i], values[j], percent):
                    top[find(root[i])] = find(root[j])
                    out.append((keys[i], keys[j]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
    return in_cells(dealt(rows, "8 * size", CELL_BYTES, percent).join(told, "a"), ["size", "a", "pos", "root", "before", "values"], function, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(key, root) of all that links (a, b) name: each goes to its smallest neighbour, until no link is between two roots."""
    edges, roots = kept(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = kept(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("p")))
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
        for _ in range(2):
            parent = parent.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
        parent = kept(parent)
        up = parent.select(F.col("v").alias("root"), F.col("p").alias("q"))
        roots = kept(parent.select(F.col("v").alias("key"), F.col("p").alias("root")) if roots is None
                     else roots.join(up, "root", "left").select("key", F.coalesce("q", "root").alias("root")))
        for end in ("a", "b"):
            edges = edges.join(parent.select(F.col("v").alias(end), F.col("p").alias(f"to_{end}")), end)
        edges = kept(edges.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    return links.select(F.col("a").alias("key"), F.col("b").alias("root")).limit(0) if roots is None else roots


def groups(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Rows (doc_id, size, key, root, component_id), one for each of the table: rows of one root are one component. Null ids and empty sets have no root."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = kept(read(docs, n))
    counts = spark.sparkContext.broadcast(slot_counts(seen))
    every = seen.where("block is null").select("doc_id", "size", "key", "parts")
    # first(): texts with one set have equal parts
    classes = kept(every.where("doc_id is not null and size > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("parts").alias("parts")))
    found = kept(stars(prefixes(docs, counts, n, percent), percent))
    tried = found.where("b is not null").groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    links = verified(tried, classes, docs, n, percent)
    first = components(links)
    rows = found.where("b is null").select("h", F.col("size_a").alias("size"), "a", "pos")
    rows = rows.join(first.select(F.col("key").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    rows = kept(unjoined(rows))
    some = kept(rows.join(suspects(rows, classes.select(F.col("key").alias("a"), "parts"), percent).distinct(), ["h", "a"], "left_semi"))
    if not some.isEmpty():
        named = kept(some.select(F.col("a").alias("key")).distinct().join(classes.select("key", "doc_id"), "key"))
        links = links.union(kept(joined(some, sets_of(named, docs, n).withColumnRenamed("key", "a"), n, percent)))
        first = components(links)
    least = classes.join(first, "key").groupBy("root").agg(F.min("doc_id").alias("component"))
    named = kept(first.join(least, "root").select("key", "root", "component"))
    both = every.select("doc_id", "size", "key").join(classes.select("key", F.col("doc_id").alias("class_id")), "key", "left").join(named, "key", "left")
    part = F.col("doc_id").isNotNull() & (F.col("size") > 0)
    return both.select("doc_id", "size", "key", F.when(part, F.coalesce("root", "key")).alias("root"),
                       F.when(part, F.coalesce("component", "class_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_copies(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of (doc_id, text)."""
    return groups(spark, docs, n, percent).select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of a table, with all their columns, without near-copies: of a component the row with the smallest id stays.

    Of several rows of that id the one with the least set key stays, of several with one id and set any one. Rows without an id or words stay.
    Rows that no bit of the ones to leave out matches pass without a shuffle; the others are joined exactly.
    """
    found = kept(groups(spark, docs, n, percent).where("root is not null").groupBy("root", "doc_id", "key").agg(F.count("*").alias("rows")))
    stays = found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("x"))
    marked = found.join(stays, "root").withColumn("goes", F.struct("doc_id", "key") != F.col("x"))
    touched = kept(marked.where("goes or rows > 1").select("doc_id", "key", "goes"))
    table = spark.sparkContext.broadcast(id_bits(touched))
    columns = docs.columns
    key, own = "set_key", "set_id"
    while {key, own} & {c.lower() for c in columns}:
        key, own = key + "_", own + "_"
    keyed = docs.withColumns({key: F.lit(None).cast("long"), own: F.col("doc_id").cast("long")})

    def function(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names[columns.index("text")]):
                rows = pa.RecordBatch.from_arrays([part.column(part.num_columns - 1), part.column(columns.index("text"))], ["doc_id", "text"])
                place, keys, sets = with_keys(rows, table.value, n)
                column = np.zeros(part.num_rows, np.int64)
                column[place] = keys
                unsure = np.zeros(part.num_rows, bool)
                unsure[place] = [len(x) > 0 for x in sets]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(column, mask=~unsure), part.columns[-1]], names=part.schema.names)

    told = keyed.mapInArrow(function, keyed.schema)
    gone = touched.where("goes").select(F.col("doc_id").alias(own), F.col("key").alias(key))
    unsure = told.where(F.col(key).isNotNull()).join(gone, [own, key], "left_anti").dropDuplicates([own, key])
    return told.where(F.col(key).isNull()).select(*columns).unionByName(unsure.select(*columns))
