"""Approximate neighbours by hierarchical navigable small-world graphs (Malkov and Yashunin, 2018), one per shard of the vectors.

A shard holds a bounded number of vectors, so a graph is built and searched in one task whatever the table's size; every question goes to
all shards, and the best of each meet. The index is a table of vectors with their neighbours by layer, which can be kept.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lexical import top

# Neighbours of a vector (twice as many on the lowest layer), beam of building and of searching.
DEGREE, BUILD_BEAM, BEAM = 32, 200, 64
#: Vectors of a shard.
SHARD = 4096
#: Questions that a task takes to its shard at once.
ASKED = 4096
#: Rows whose products with a shard are made at once.
BLOCK = 256


class Graph:
    """Neighbours of the rows of a matrix of unit vectors, layer by layer; rows are inserted one after the other."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE) -> None:
        self.x, self.degree = vectors, degree
        self.links: list[list[np.ndarray]] = []
        self.entry = -1
        self._seen, self._stamp = np.zeros(len(vectors), np.int64), 0

    def beam(self, q: np.ndarray, entries: list[int], layer: int, width: int) -> list[tuple[float, int]]:
        """The rows nearest to q that a best-first walk over a layer finds, the nearest first."""
        self._stamp += 1
        self._seen[entries] = self._stamp
        scores = (self.x[entries] @ q).tolist()
        found = list(zip(scores, entries, strict=True))
        open_ = [(-s, i) for s, i in found]
        heapq.heapify(open_)
        heapq.heapify(found)
        while len(found) > width:
            heapq.heappop(found)
        while open_:
            s, i = heapq.heappop(open_)
            if len(found) >= width and -s < found[0][0]:
                break
            near = self.links[i][layer]
            near = near[self._seen[near] != self._stamp]
            if not len(near):
                continue
            self._seen[near] = self._stamp
            scores = self.x[near] @ q
            if len(found) >= width:
                good = scores > found[0][0]
                near, scores = near[good], scores[good]
            for t, j in zip(scores.tolist(), near.tolist(), strict=True):
                if len(found) < width:
                    heapq.heappush(found, (t, j))
                elif t > found[0][0]:
                    heapq.heapreplace(found, (t, j))
                else:
                    continue
                heapq.heappush(open_, (-t, j))
        return sorted(found, reverse=True)

    def spread(self, near: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
        """Neighbours out of candidates, the nearest first: those nearer to the row than to a neighbour taken before, then the nearest of the others."""
        x, taken, at = self.x[near], [], 0
        closest = np.full(len(near), -np.inf)  # of a candidate, to the neighbours taken so far
        while len(taken) < most and at < len(near):
            good = closest[at:] <= scores[at:]
            step = int(good.argmax())
            if not good[step]:
                break
            at += step
            taken.append(at)
            np.maximum(closest, x @ x[at], out=closest)
            at += 1
        spare = np.ones(len(near), bool)
        spare[taken] = False
        return near[np.concatenate([np.array(taken, np.int64), np.flatnonzero(spare)])[:most]]

    @classmethod
    def of(cls, vectors: np.ndarray, levels: list[int], degree: int = DEGREE) -> Graph:
        """The graph of all rows at once, as if inserted one after the other by beams that miss nothing.

        A row's candidates are the nearest of the rows before it, by products of blocks, as a shard is bounded; each row gets its
        neighbours once, and is cut back once when all rows that chose it are known.
        """
        graph, level = cls(vectors, degree), np.array(levels, np.int64)
        graph.links = [[np.zeros(0, np.int64)] * (n + 1) for n in levels]
        for layer in range(int(level.max(initial=-1)) + 1):
            rows = np.flatnonzero(level >= layer)
            x = vectors[rows]
            chosen = [np.zeros(0, np.int64)] * len(rows)
            for low in range(0, len(rows), BLOCK):
                high = min(low + BLOCK, len(rows))
                scores = x[low:high] @ x[:high].T
                scores[np.arange(high) >= np.arange(low, high)[:, None]] = -np.inf
                # of equal rows the later ones come first, so that none gathers all links
                order = high - 1 - np.argsort(-scores[:, ::-1], axis=1, kind="stable")[:, :BUILD_BEAM]
                for i in range(low, high):
                    near = order[i - low, : min(i, BUILD_BEAM)]
                    chosen[i] = graph.spread(rows[near], scores[i - low, near], degree)
            back: list[list[int]] = [[] for _ in levels]
            for i, own in zip(rows.tolist(), chosen, strict=True):
                for j in own.tolist():
                    back[j].append(i)
            most = degree * (1 if layer else 2)
            for i, own in zip(rows.tolist(), chosen, strict=True):
                links = np.concatenate([own, np.array(back[i], np.int64)])
                if len(links) > most:
                    scores = vectors[links] @ vectors[i]
                    order = np.lexsort((-links, -scores))
                    links = graph.spread(links[order], scores[order], most)
                graph.links[i][layer] = links
        if len(level):
            graph.entry = int(level.argmax())
        return graph

    def insert(self, row: int, level: int) -> None:
        self.links.append([np.zeros(0, np.int64) for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = row
            return
        q, entries = self.x[row], [self.entry]
        highest = len(self.links[self.entry]) - 1
        for layer in range(highest, level, -1):
            entries = [self.beam(q, entries, layer, 1)[0][1]]
        for layer in range(min(level, highest), -1, -1):
            found = self.beam(q, entries, layer, BUILD_BEAM)
            own = self.spread(np.array([i for _, i in found], np.int64), np.array([s for s, _ in found]), self.degree)
            self.links[row][layer] = own
            most = self.degree * (1 if layer else 2)
            for i in own.tolist():
                back = np.append(self.links[i][layer], row)
                if len(back) > most:
                    scores = self.x[back] @ self.x[i]
                    order = np.argsort(-scores, kind="stable")
                    back = self.spread(back[order], scores[order], most)
                self.links[i][layer] = back
            entries = [i for _, i in found]
        if level > highest:
            self.entry = row

    def search(self, q: np.ndarray, k: int, width: int = BEAM) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        entries = [self.entry]
        for layer in range(len(self.links[self.entry]) - 1, 0, -1):
            entries = [self.beam(q, entries, layer, 1)[0][1]]
        return self.beam(q, entries, 0, max(width, k))[:k]


def level_of(key: str, degree: int = DEGREE) -> int:
    """A row's highest layer, drawn by its id, so that an index is the same each time it is built."""
    draw = (zlib.crc32(key.encode()) + 1) / 2**32
    return int(-math.log(draw) / math.log(degree))


def _matrix(table: pa.Table) -> np.ndarray:
    x = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def dealt(rows: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Rows of a group together, in about as many partitions as there are groups: dealt by bytes alone, small groups of much work would share a task."""
    return rows.repartition(min(max(groups, 1), 4096), *keys)


def build(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """An index of vectors (vec_id, embedding): width, shard, place, vec_id, embedding, links (an array per layer).

    Null vectors are left out; vectors of another width are in graphs of their own. Equal and repeated vectors are all kept. An empty table
    gives an empty index.
    """
    kinds = dict(vectors.dtypes)
    rows = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding", F.size("embedding").alias("width"))
    # each width is dealt over as many shards as its rows need
    sizes = rows.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).alias("shards"))
    shards = sizes.agg(F.sum("shards")).first()[0] or 0
    rows = rows.join(F.broadcast(sizes), "width").select("width", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("shards")).alias("shard"), "vec_id", "embedding")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        graph = Graph.of(_matrix(table), [level_of(str(key)) for key in table["vec_id"].to_pylist()])
        links = pa.array([[x.tolist() for x in own] for own in graph.links], pa.list_(pa.list_(pa.int32())))
        return table.append_column("place", pa.array(range(table.num_rows), pa.int32())).append_column("links", links).select(["width", "shard", "place", "vec_id", "embedding", "links"])

    schema = f"width int, shard long, place int, vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, links array<array<int>>"
    return dealt(rows, 2 * shards, "width", "shard").groupBy("width", "shard").applyInArrow(one, schema)


def search(index: DataFrame, asked: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """qid, vec_id, score (cosine, 6 places), rank: the k nearest that the graphs find for each question (qid, embedding), without the question's own id.

    Ties go to the smaller id. A question finds fewer than k only if there are fewer vectors of its width, or its walk ends early.
    """
    ids = dict(index.dtypes)["vec_id"]
    shards = index.select("width", "shard").distinct()
    questions = asked.where("embedding IS NOT NULL").select(F.col("qid"), F.col("embedding"), F.size("embedding").alias("width"))
    # as many rows as questions times shards, dealt in batches, so that many questions don't crowd a task
    n = max(1, -(-questions.count() // ASKED))
    batch = F.pmod(F.xxhash64("qid"), F.lit(n)).cast("int").alias("batch")
    sent = questions.join(F.broadcast(shards), "width").select("width", "shard", batch, "qid", "embedding")
    held = index.select(*[F.col(c).alias(c) for c in index.columns], F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("batch"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            b = b.sort_by("place")
            graph = Graph(_matrix(b))
            graph.links = [[np.array(x, np.int64) for x in own] for own in b["links"].to_pylist()]
            highest = [len(own) for own in graph.links]
            graph.entry = highest.index(max(highest))
            keys = b["vec_id"].to_pylist()
            for qid, q in zip(a["qid"].to_pylist(), _matrix(a), strict=True):
                found = [(qid, keys[i], s) for s, i in graph.search(q, k + 1, beam) if keys[i] != qid]
                out += found[: k + 1]
        kinds = (a["qid"].type, b["vec_id"].type, pa.float64())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["qid", "vec_id", "score"])

    keys = ["width", "shard", "batch"]
    groups = 2 * n * shards.count()
    found = dealt(sent, groups, *keys).groupBy(*keys).cogroup(dealt(held, groups, *keys).groupBy(*keys)).applyInArrow(meet, f"qid {ids}, vec_id {ids}, score double")
    return top(found.withColumn("score", F.round("score", 6)), k, F.desc("score"), F.col("vec_id"))


def every(vectors: DataFrame, which: Column) -> DataFrame:
    """The vectors for which `which` holds, as questions."""
    return vectors.where(which).select(F.col("vec_id").alias("qid"), "embedding")
