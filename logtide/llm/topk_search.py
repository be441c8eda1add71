"""Exact top-k search by inner product, a block of documents at a time, pruned by bounds.

A term is a component; a document's vector of integers is its row of the forward index. Documents are put in an order
that brings like vectors together and cut into ranges. Each block has the maximum and minimum of every term, and the
sum over terms of what a query can reach with them bounds the block's scores. A query takes the blocks by falling bound,
scores each through its forward rows, and stops where a bound is below its k-th score; an equal bound is still scored,
so ties are exact.

Queries are handed to tasks in sets of a bounded number, each against all documents, with first k-th scores from a
bounded sample of documents, which only prunes. Tasks hand on k rows a query and segment; those are ranked per query.

Vectors that are null, empty or hold null, NaN or infinite components take no part, nor do rows without an id; vectors
of different lengths have no score. Ties go to the smaller id. A query row finds all rows but those with its id; with
fewer than k, all. Repeated rows count each. Integers are held to 62 bits and a sign, scores to 63: what lies beyond counts
as the largest or smallest of them. An empty table, or one without queries, has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.llm.common import kept

#: Queries of one set, documents of the sample, of a block, and of a task's segment.
QUERIES, SAMPLE, BLOCK, SEGMENT = 2048, 2048, 128, 1 << 15
#: Below all scores; it can be negated.
LEAST = -(2 ** 63 - 1)
#: The largest component.
LARGEST = 2 ** 62


def valid(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v): integers floor(256 * x), x as double."""
    as_double = F.col(vector).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col(id).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(as_double, odd), F.lit(True))
    return vectors.where(sound).select(F.col(id).cast("long").alias("id"), F.transform(as_double, lambda x: F.floor(F.least(F.greatest(x * 256, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("long")).alias("v"))


def held(values: np.ndarray) -> np.ndarray:
    """Whole numbers of any size within the range of scores."""
    return np.clip(values, LEAST, -LEAST).astype(np.int64)


def reach(a: np.ndarray, b: np.ndarray) -> float:
    """What no partial sum of an inner product exceeds."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: by floating point where every partial sum is a whole number below 2^53, by whole numbers of
    any size where they may pass 63 bits."""
    most = reach(a, b)
    if most < 2 ** 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most >= 2 ** 62:
        return held(a.astype(object) @ b.T.astype(object))
    return a @ b.T


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What each query can reach with a block's maxima and minima."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    if max(reach(up, high), reach(down, low)) >= 2 ** 61:
        return held(up.astype(object) @ high.T.astype(object) + down.astype(object) @ low.T.astype(object))
    return products(up, high) + products(down, low)


def block_order(rows: np.ndarray) -> np.ndarray:
    """Like vectors near each other: by the signs of their widest components."""
    wide = np.argsort(-rows.var(axis=0), kind="stable")[:10]
    return np.lexsort((rows[:, wide] > 0).T[::-1])


def searched(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """Each query's k best (-score, id), best first, among those rows that can be among its k best of all."""
    order = block_order(rows)
    ids, rows = ids[order], rows[order]
    first = np.arange(0, len(rows), BLOCK)
    high, low = np.maximum.reduceat(rows, first, axis=0), np.minimum.reduceat(rows, first, axis=0)
    bound = bounds(queries, high, low)
    turns = np.argsort(-bound, axis=1, kind="stable")
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    least, on = least.copy(), np.arange(len(queries))
    for turn in range(len(first)):
        block = turns[on, turn]
        go = bound[on, block] >= least[on]  # bounds fall from turn to turn: who stops has ended
        on, block = on[go], block[go]
        if not len(on):
            break
        by_block = np.argsort(block, kind="stable")
        for same in np.split(by_block, np.flatnonzero(np.diff(block[by_block])) + 1):
            begin = first[block[same[0]]]
            forward, named = rows[begin:begin + BLOCK], ids[begin:begin + BLOCK]
            score = products(queries[on[same]], forward)
            score_ok = (score >= least[on[same]][:, None]) & (named[None, :] != query_ids[on[same]][:, None])
            for i in np.flatnonzero(score_ok.any(axis=1)).tolist():
                q, hit = int(on[same[i]]), np.flatnonzero(score_ok[i])
                best[q] = sorted(best[q] + list(zip((-score[i, hit]).tolist(), named[hit].tolist())))[:k]
                if len(best[q]) == k:
                    least[q] = max(least[q], -best[q][-1][0])
    return best


def kth_scores(sample_ids: np.ndarray, sample: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """A k-th score that every query reaches within the sample."""
    nothing = np.full(len(queries), LEAST)
    if len(sample) < k + 1:
        return nothing
    score = products(queries, sample)
    score[sample_ids[None, :] == query_ids[:, None]] = LEAST
    return -np.partition(-score, k - 1, axis=1)[:, k - 1] if (sample_ids[None, :] != query_ids[:, None]).sum(axis=1).min() >= k else nothing


def matrix(rows: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    own = [r for r in rows if len(r["v"]) == size]
    return np.array([r["id"] for r in own], np.int64), np.array([r["v"] for r in own], np.int64).reshape(-1, size)


def top_k(spark: SparkSession, vectors: DataFrame, every: int, k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): queries are the rows whose id is divisible by `every`."""
    documents = valid(vectors, id, vector)
    queries = documents.where(F.pmod("id", F.lit(every)) == 0)
    sample = documents.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sets = -(-queries.count() // QUERIES)
    found = None
    for number in range(sets):
        # about QUERIES of them, by a hash of the id
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(sets)) == number) if sets > 1 else queries
        groups = {}
        rows = sorted(own.collect(), key=lambda r: (r["id"], r["v"]))
        for size in sorted({len(r["v"]) for r in rows}):
            query_ids, q = matrix(rows, size)
            groups[size] = query_ids, q, kth_scores(*matrix(sample, size), query_ids, q, k)
        shared = spark.sparkContext.broadcast(groups)

        def function(batches, shared=shared, number=number):
            waiting: dict[int, list] = {}
            def out(size):
                query_ids, q, least = shared.value[size]
                ids, rows = (np.concatenate(x) for x in zip(*waiting.pop(size)))
                hits = [(number, i, size, int(query_ids[i]), -score, found) for i, best in enumerate(searched(ids, rows, query_ids, q, least, k)) for score, found in best]
                columns = list(zip(*hits)) or [()] * 6
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["set", "number", "size", "query_id", "score", "vec_id"])
            for batch in batches:
                v = batch.column("v")
                size = np.diff(np.frombuffer(v.buffers()[1], np.int32)[v.offset:v.offset + len(v) + 1])
                ids, flat = batch.column("id").to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
                start = np.cumsum(size) - size
                for n in np.unique(size).tolist():
                    if n in shared.value:
                        rows = np.flatnonzero(size == n)
                        waiting.setdefault(n, []).append((ids[rows], flat[(start[rows][:, None] + np.arange(n)).ravel()].reshape(-1, n)))
                        if sum(len(x) for x, _ in waiting[n]) >= SEGMENT:
                            yield out(n)
            for n in list(waiting):
                yield out(n)
        part = documents.mapInArrow(function, "set long, number long, size long, query_id long, score long, vec_id long")
        if sets > 1:  # a set's queries leave the driver before the next one's come
            part = kept(part)
            shared.destroy()
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("set", "size", "number").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
