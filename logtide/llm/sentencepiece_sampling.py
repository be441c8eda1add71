"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k search over the piece lattice.

Of all segmentations of a text into pieces, those with the k highest perturbed log-probabilities are a sample of k
without replacement. They are found best first, as in A-star sampling: a region of the lattice, given by a prefix and
what may not follow it, has as its bound a Gumbel variable at its log-mass, cut off at its parent's value. The best
region's winner is drawn exactly, edge by edge with backward sums, and splits what is left of the region at every place
where a segmentation can depart from it. The (k+1)-th value gives each sample's inclusion probability.

No piece holds a blank after another character, and some bytes are in no piece, so a text's lattice is a chain of small
ones; equal chunks of a batch share theirs. Blanks are marks as in the library's identity normalisation, with one put
before a text; a character without a piece is its bytes (so is the mark's own character, which is why decoding always
gives back the text). A unigram model's scores are log-probabilities; those of a merge model are ranks, and a piece of
rank r has log-probability -log(r + OFFSET), up to a constant. All randomness is a hash of seed, row key and place.

A null or empty text has no segmentation, and an empty list. Where a text has fewer than k segmentations, all are
listed. Repeated rows give the same samples; rows without an id are seeded by their text; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm.common import flat, slices
from logtide.llm.words import mixed, spans, sums

OFFSET = 2.7
#: Bytes of text whose lattices are built at once.
CHUNK_BYTES = 1 << 20
NORMAL, BYTE, UNIGRAM = (1, 4), 6, 1
BEGUN_BITS = 22
#: Random numbers that are drawn at once for a chunk that is drawn anew; longer ones draw further blocks of as many.
STEPS = 24


@dataclass
class Pieces:
    """A model's pieces by hash, their log-probabilities, and the bytes of every id; blanks stand for marks."""

    hashes: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    begun: np.ndarray
    at: np.ndarray
    longest: int
    of_byte: np.ndarray
    byte_weight: float
    alone: np.ndarray
    bytes_of: np.ndarray
    first_byte: np.ndarray


def pieces(path: str, smoothing: float = 1.0) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:  # the tokenizer, of bounded size, not data
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only models with the identity normalisation and a mark before the text")
    text = [p.piece.replace("▁", " ").encode() for p in model.pieces]
    normal = [i for i, p in enumerate(model.pieces) if p.type in NORMAL]
    scores = np.array([model.pieces[i].score for i in normal])
    if model.trainer_spec.model_type == UNIGRAM:
        weights = scores.astype(float)
    else:
        rank = np.empty(len(scores))
        rank[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
        weights = -np.log(rank + OFFSET)
        weights -= np.log(np.exp(weights).sum())
    weights *= smoothing
    data = np.frombuffer(b"".join(text[i] for i in normal), np.uint8)
    size = np.array([len(text[i]) for i in normal])
    ends = np.cumsum(size)
    running = sums(data)
    hashes = spans(running, ends - size, ends)
    order = np.argsort(hashes)
    begun = np.zeros(1 << BEGUN_BITS, bool)  # whether a span may begin a piece
    for n in range(1, int(size.max()) + 1):
        begin = (ends - size)[size >= n]
        begun[slots(spans(running, begin, begin + n))] = True
    at = np.full(1 << BEGUN_BITS, -1, np.int32)  # a slot's piece; the few that share one are searched for
    at[slots(hashes[order])] = np.arange(len(order))
    shared, many = np.unique(slots(hashes), return_counts=True)
    at[shared[many > 1]] = -2
    of_byte, decoded = np.full(256, -1, np.int32), list(text)
    for i, p in enumerate(model.pieces):
        if p.type == BYTE:
            of_byte[int(p.piece[3:-1], 16)] = i
            decoded[i] = bytes([int(p.piece[3:-1], 16)])
        elif p.type not in NORMAL:
            decoded[i] = b""
    if (of_byte < 0).any():
        raise ValueError("only models with a piece for every byte")
    alone = np.ones(256, bool)
    alone[data] = False
    return Pieces(hashes[order], np.array(normal, np.int32)[order], weights[order], begun, at, int(size.max()), of_byte, float(weights.min()) - 2 * smoothing,
                  alone & (np.arange(256) < 128), np.frombuffer(b"".join(decoded), np.uint8), np.cumsum([0] + [len(x) for x in decoded]))


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BEGUN_BITS)).astype(np.int32)


def found_in(known: Pieces, hashes: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The number of each hash's piece, -1 for none."""
    at = known.at[slot]
    search = np.flatnonzero(at == -2)
    if len(search):
        at[search] = np.minimum(np.searchsorted(known.hashes, hashes[search]), len(known.hashes) - 1)
    at[(at >= 0) & (known.hashes[at] != hashes)] = -1
    return at


def lengths_to(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [first, first + size), one range after the other."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def uniform(key: np.ndarray, place: np.ndarray, turn: int) -> np.ndarray:
    """A number between 0 and 1, both excluded, for each row key, place and turn."""
    h = mixed(key + mixed(np.asarray(place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)))
    return ((h >> np.uint64(12)).astype(float) + 0.5) * 2.0 ** -52


class Lattice:
    """The lattices of some distinct chunks: a state for each byte position and end, edges in the order of their states."""

    def __init__(self, stream: np.ndarray, running: np.ndarray, start: np.ndarray, end: np.ndarray, known: Pieces):
        size = end - start
        self.base = np.cumsum(size + 1) - (size + 1)
        self.last = self.base + size
        place = lengths_to(start, size)  # in the stream, of each byte
        state = lengths_to(self.base, size)
        left = np.repeat(size, size) - (place - np.repeat(start, size))
        begins = (stream[place] & 0xC0) != 0x80
        source, reach, piece, weight = [], [], [], []
        on = np.flatnonzero(begins)
        for n in range(1, known.longest + 1):
            on = on[left[on] >= n]
            if not len(on):
                break
            h = spans(running, place[on], place[on] + n)
            slot = slots(h)
            go = np.flatnonzero(known.begun[slot])
            on = on[go]
            at = found_in(known, h[go], slot[go])
            found = np.flatnonzero(at >= 0)
            at = at[found]
            source.append(on[found])
            reach.append(np.full(len(found), n, np.int32))
            piece.append(known.ids[at])
            weight.append(known.weights[at])
        source, reach, piece, weight = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (source, reach, piece, weight))
        lead = stream[place]
        char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        single = np.zeros(len(place), bool)
        single[source[reach == char[source]]] = True
        lone = np.flatnonzero(begins & ~single)
        n = np.minimum(char[lone], left[lone])
        source, reach = np.concatenate((source, lone)), np.concatenate((reach, n))
        piece = np.concatenate((piece, np.where(n == 1, known.of_byte[lead[lone]], -1).astype(np.int32)))
        weight = np.concatenate((weight, known.byte_weight * n))
        order = np.argsort(source, kind="stable")  # some sorted runs
        source, reach, piece, weight = source[order], reach[order], piece[order], weight[order]
        self.place, self.reach, self.piece, self.stream, self.of_byte = place[source], reach, piece, stream, known.of_byte
        origin = state[source]
        self.to = origin + reach
        self.first = np.concatenate(([0], np.cumsum(np.bincount(origin, minlength=int(self.last[-1]) + 1))))
        ahead = np.full(int(self.last[-1]) + 1, -np.inf)
        ahead[self.last] = 0.0
        lefts = left[source]
        if not len(lefts) or lefts.max() < 1 << 15:
            lefts = lefts.astype(np.int16)  # sorted by radix
        by_left = np.argsort(lefts, kind="stable")
        lefts = lefts[by_left]
        cuts = np.append(np.flatnonzero(np.concatenate(([True], lefts[1:] != lefts[:-1]))), len(lefts))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # nearest to the end first
            edges = by_left[a:b]
            value, at = weight[edges] + ahead[self.to[edges]], origin[edges]
            new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            top = np.maximum.reduceat(value, new)
            top = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                ahead[at[new]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(new, len(edges))))), new))
        with np.errstate(invalid="ignore"):
            self.log_p = weight + ahead[self.to] - ahead[origin]
        self.log_p[~np.isfinite(self.log_p)] = -np.inf
        total = np.concatenate(([0.0], np.cumsum(np.exp(self.log_p))))
        self.below = total[1:] - total[self.first[origin]]  # of its state's edges up to it
        final = self.first[1:][self.first[1:] > self.first[:-1]] - 1
        while len(final):  # the last edge that can be taken takes what rounding leaves
            dead = self.log_p[final] == -np.inf
            self.below[final] = 2.0
            final = final[dead] - 1

    def draw(self, chunk: np.ndarray, key: np.ndarray, place: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One segmentation of each chunk: edges in a row, how many are each chunk's, log-probabilities."""
        state, goal = self.base[chunk].copy(), self.last[chunk]
        log_p, many = np.zeros(len(chunk)), np.zeros(len(chunk), np.int64)
        on, steps = np.arange(len(chunk)), []
        while len(on):
            u = uniform(key[on], place[on], (turn << 32) + len(steps))
            edge = self.first[state[on]].copy()
            behind = np.flatnonzero(self.below[edge] <= u)
            while len(behind):
                edge[behind] += 1
                behind = behind[self.below[edge[behind]] <= u[behind]]
            steps.append((on, edge))
            state[on] = self.to[edge]
            log_p[on] += self.log_p[edge]
            many[on] += 1
            on = on[state[on] != goal[on]]
        begin = np.cumsum(many) - many
        edges = np.zeros(int(many.sum()), np.int64)
        for step, (which, edge) in enumerate(steps):
            edges[begin[which] + step] = edge
        return edges, many, log_p

    def draw_other(self, chunk: int, barred: list[tuple], random: list[float], key: np.ndarray, turn: int) -> tuple[list[int], float]:
        """A segmentation of one chunk that is not barred: each edge's mass less that of the barred ones through it.

        `random` has the numbers of the first steps by `key` (of one row) and `turn`; those of later steps are drawn when they are reached.
        """
        state, goal, out, total = int(self.base[chunk]), int(self.last[chunk]), [], 0.0
        while state != goal:
            a, b = int(self.first[state]), int(self.first[state + 1])
            log_p = self.log_p[a:b].tolist()
            mass = [math.exp(p) for p in log_p]
            for path in barred:
                mass[path[len(out)] - a] -= math.exp(sum(self.log_p[list(path[len(out):])].tolist()))
            if barred:  # rounding must not leave mass where every continuation is barred
                mass = [m if m > 1e-14 else 0.0 for m in mass]
            left = sum(mass)
            if not left:
                return [], -np.inf
            if len(out) == len(random):
                random = random + uniform(key, np.arange(len(random), len(random) + STEPS), turn).tolist()
            left *= random[len(out)]
            pick = max(i for i, m in enumerate(mass) if m)
            for i, m in enumerate(mass):
                left -= m
                if m and left < 0:
                    pick = i
                    break
            barred = [path for path in barred if path[len(out)] == a + pick]
            out.append(a + pick)
            total += log_p[pick]
            state = int(self.to[a + pick])
        return out, total

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, and how many are each edge's."""
        many = np.where(self.piece[edges] < 0, self.reach[edges], 1)
        if (many == 1).all():
            return self.piece[edges].astype(np.int32), many
        owner = np.repeat(edges, many)
        return np.where(self.piece[owner] < 0, self.of_byte[self.stream[lengths_to(self.place[edges], many)]], self.piece[owner]).astype(np.int32), many


@dataclass
class Winner:
    """One sample of each text that has it: edges by chunk, its value, and the chunk where its region begins to be free."""

    edges: np.ndarray
    many: np.ndarray
    log_p: np.ndarray
    value: np.ndarray
    free: np.ndarray
    barred: dict
    bounds: np.ndarray | None = None

    def __post_init__(self):
        self.begin = np.cumsum(self.many) - self.many

    def path(self, chunk: int) -> tuple:
        return tuple(self.edges[self.begin[chunk]:self.begin[chunk] + self.many[chunk]].tolist())


def samples(data: np.ndarray, offsets: np.ndarray, key: np.ndarray, known: Pieces, k: int):
    """For each of k turns: (texts, where their ids begin, ids, log-probability, value); and the (k+1)-th value of each text."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    filled = np.flatnonzero(size)
    start = offsets[:-1] + np.cumsum(size > 0) - (size > 0)  # a blank before every text
    stream = np.full(int(size.sum()) + len(filled), 32, np.uint8)
    stream[lengths_to(start[filled] + 1, size[filled])] = data
    if not len(filled):
        return [], np.full(rows, -np.inf), stream, start
    running = sums(stream)
    blank, alone = stream == 32, known.alone[stream]
    cut = np.zeros(len(stream), bool)
    cut[1:] = (blank[1:] & ~blank[:-1]) | alone[1:] | alone[:-1]
    cut[start[filled]] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(stream))
    _, one, chunk = np.unique(spans(running, begin, end), return_index=True, return_inverse=True)
    lattice = Lattice(stream, running, begin[one], end[one], known)
    first = np.searchsorted(begin, np.append(start[filled], len(stream)))
    text = np.repeat(np.arange(len(filled)), np.diff(first))
    keys, place = key[filled][text], np.arange(len(chunk)) - first[:-1][text]

    edges, many, log_p = lattice.draw(chunk, keys, place, 1)
    value = -np.log(-np.log(uniform(key[filled], np.zeros(len(filled)), 2)))
    winners = [Winner(edges, many, log_p, value, first[:-1].copy(), {})]
    for turn in range(1, k + 1):
        w = winners[-1]
        # the regions that leave this winner at each chunk: bounds cut off at its value
        lead = np.cumsum(w.log_p) - w.log_p
        lead = lead - lead[first[:-1]][text]
        lost = np.exp(w.log_p)
        for t, paths in w.barred.items():
            lost[w.free[t]] += sum(float(np.exp(lattice.log_p[list(p)].sum())) for p in paths)
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = 1 - lost
            mass = np.where(rest > 1e-12, lead + np.log(np.maximum(rest, 1e-300)), -np.inf)
            mass[(np.arange(len(chunk)) < w.free[text]) | ~np.isfinite(w.value)[text]] = -np.inf
            w.bounds = -np.logaddexp(-w.value[text], -mass + np.log(-np.log(uniform(keys, place, (turn << 8) + 3))))
        w.bounds[~np.isfinite(w.bounds)] = -np.inf
        best = np.full(len(filled), -np.inf)
        where, source = np.zeros(len(filled), np.int64), np.zeros(len(filled), np.int64)
        for s, other in enumerate(winners):
            top = np.maximum.reduceat(other.bounds, first[:-1])
            better = top > best
            hit = np.flatnonzero((other.bounds == top[text]) & better[text])
            at = np.full(len(filled), -1)
            at[text[hit[::-1]]] = hit[::-1]
            best[better], where[better], source[better] = top[better], at[better], s
        if turn == k:
            break
        new_edges, free, barred = {}, where.copy(), {}
        values = best.copy()
        log_p = np.zeros(len(chunk))
        going = np.flatnonzero(np.isfinite(best))
        numbers = uniform(np.repeat(key[filled][going], STEPS), np.tile(np.arange(STEPS), len(going)), (turn << 8) + 4).reshape(-1, STEPS)
        for t, random in zip(going.tolist(), numbers.tolist()):
            old, c = winners[source[t]], int(where[t])
            bars = [old.path(c), *(old.barred.get(t, []) if old.free[t] == c else [])]
            path, p = lattice.draw_other(int(chunk[c]), bars, random, key[filled[t:t + 1]], (turn << 8) + 4)
            old.bounds[c] = -np.inf
            if not path:
                values[t] = -np.inf
                continue
            new_edges[t], barred[t] = path, bars
            log_p[c] = p
        live = np.isfinite(values)
        spot = np.arange(len(chunk))
        after = np.flatnonzero((spot > free[text]) & live[text])
        fresh, fresh_many, fresh_p = lattice.draw(chunk[after], keys[after], place[after], turn + 1 << 4)
        many = np.zeros(len(chunk), np.int64)
        many[after], log_p[after] = fresh_many, fresh_p
        before = (spot < free[text]) & live[text]
        for s, old in enumerate(winners):
            own = np.flatnonzero(before & (source[text] == s))
            many[own], log_p[own] = old.many[own], old.log_p[own]
        for t, path in new_edges.items():
            many[free[t]] = len(path)
        begins = np.cumsum(many) - many
        edges = np.zeros(int(many.sum()), np.int64)
        edges[lengths_to(begins[after], many[after])] = fresh
        for s, old in enumerate(winners):
            own = np.flatnonzero(before & (source[text] == s))
            edges[lengths_to(begins[own], many[own])] = old.edges[lengths_to(old.begin[own], many[own])]
        for t, path in new_edges.items():
            edges[begins[free[t]]:begins[free[t]] + len(path)] = path
        winners.append(Winner(edges, many, log_p, values, free, barred))
    out = []
    for w in winners:
        live = np.isfinite(w.value)
        ids, many = lattice.ids(w.edges)
        of_chunk = np.add.reduceat(np.append(many, 0), np.minimum(w.begin, len(many))) * (w.many > 0) if len(many) else np.zeros(len(chunk), np.int64)
        of_text = np.add.reduceat(of_chunk, first[:-1])[live]
        total = np.add.reduceat(w.log_p, first[:-1])
        out.append((filled[live], np.append(0, np.cumsum(of_text)), ids, total[live], w.value[live]))
    beyond = np.full(rows, -np.inf)
    beyond[filled] = best
    return out, beyond, stream, start


def decode(ids: np.ndarray, known: Pieces) -> np.ndarray:
    """The bytes of piece ids, blanks for marks, the one before the text included."""
    first = known.first_byte[ids]
    return known.bytes_of[lengths_to(first, known.first_byte[ids + 1] - first)]


SCHEMA = "doc_id long, samples array<struct<ids: array<int>, log_prob: double, perturbed: double, inclusion: double>>, round_trip boolean"


def encoded(part: pa.RecordBatch, known: Pieces, k: int, seed: int) -> pa.RecordBatch:
    data, offsets = flat(part.column("text"))
    ids = part.column("doc_id")
    key = mixed(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + mixed(np.array([seed], np.uint64)))
    if ids.null_count:
        running = sums(data)
        key = np.where(ids.is_null().to_numpy(zero_copy_only=False), spans(running, offsets[:-1], offsets[1:]) ^ np.uint64(seed), key)
    turns, beyond, stream, start = samples(data, offsets, key, known, k)
    size = np.diff(offsets)
    right = np.ones(part.num_rows, bool)
    texts, lists, log_p, value = [], [], [], []
    for which, begin, pieces_of, p, v in turns:
        made = decode(pieces_of, known)
        want = lengths_to(start[which], size[which] + 1)
        if len(made) != len(want) or not np.array_equal(made, stream[want]):
            for t, a, b in zip(which.tolist(), begin[:-1].tolist(), begin[1:].tolist()):
                right[t] &= np.array_equal(decode(pieces_of[a:b], known), stream[start[t]:start[t] + size[t] + 1])
        texts.append(which)
        lists.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(pieces_of, pa.int32())))
        log_p.append(p)
        value.append(v)
    if turns:
        text = np.concatenate(texts)
        order = np.argsort(text, kind="stable")
        log_p, value = np.concatenate(log_p)[order], np.concatenate(value)[order]
        inclusion = -np.expm1(-np.exp(np.minimum(log_p - beyond[text[order]], 50)))
        held = pa.StructArray.from_arrays([pa.concat_arrays(lists).take(pa.array(order)), pa.array(log_p), pa.array(value), pa.array(inclusion)],
                                          ["ids", "log_prob", "perturbed", "inclusion"])
        many = np.bincount(text, minlength=part.num_rows)
    else:
        kind = pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())])
        held, many = pa.array([], kind), np.zeros(part.num_rows, np.int64)
    column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), held)
    return pa.RecordBatch.from_arrays([ids, column, pa.array(right)], ["doc_id", "samples", "round_trip"])


def sampled_segmentations(spark: SparkSession, docs: DataFrame, path: str, k: int = 2, seed: int = 17, smoothing: float = 1.0) -> DataFrame:
    """Rows (doc_id, samples, round_trip): up to k samples, best first, and whether all decode to the text."""
    shared = spark.sparkContext.broadcast(pieces(path, smoothing))

    def function(batches):
        for batch in batches:
            for part in slices(batch, limit=CHUNK_BYTES):
                yield encoded(part, shared.value, k, seed)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(function, SCHEMA)
