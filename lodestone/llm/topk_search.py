"""Exact top-k search: bounds from segment means and deviations, coarse to fine, then exact scores for what is left.

With vectors cut into segments, a distance is at least that between the segments' means and deviations
(each weighted by the segment's length); for given norms this bounds the inner product from above.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import staged

#: Candidates in a group, queries in a block, rows and columns of pairs handled at once, and segments of each resolution.
GROUP, BLOCK, STEP, SEGMENTS = 20_000, 2048, 1024, (2, 8, 32)


def integer_vector(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as a double: whole numbers, so scores are exact below 2**53."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, times the root of the segment's length."""
    parts = [p for p in np.array_split(x, min(segments, max(1, x.shape[1])), axis=1) if p.shape[1]]
    cols = [f(p, axis=1) * math.sqrt(p.shape[1]) for p in parts for f in (np.mean, np.std)]
    return np.stack(cols, 1) if cols else np.zeros((len(x), 1))


def best_of(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, seen: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """Query number, vector id and score of each query's k highest inner products, ties to the smaller id.

    Each query starts from a floor: the k-th best of the exact products with its candidates of highest coarse bound. Pairs whose
    bound, coarse to fine, falls below the floor are dropped one by one; exact products are made for the rest. seen gets
    how many pairs were left before each resolution and before the exact products.
    """
    counts = [0] * (len(SEGMENTS) + 1)
    resolutions = [(segment_features(queries, s), segment_features(vectors, s)) for s in SEGMENTS]
    found: list[tuple[np.ndarray, ...]] = []
    for top in range(0, len(queries), STEP):
        rows = slice(top, top + STEP)
        mine, own = queries[rows], query_ids[rows]
        floor = np.full(len(mine), -np.inf)
        hits: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(vectors), STEP):
            cols = slice(at, at + STEP)
            other = own[:, None] != ids[None, cols]
            counts[0] += other.size
            bound = resolutions[0][0][rows] @ resolutions[0][1][cols].T
            slack = 1e-6 + 1e-9 * np.abs(bound)
            if other.shape[1] >= 2 * k:
                # candidates of highest coarse bound seed the floor
                likely = np.argpartition(np.where(other, bound, -np.inf), -2 * k, axis=1)[:, -2 * k :]
                sure = np.einsum("qd,qkd->qk", mine, vectors[cols][likely])
                sure = np.where(np.take_along_axis(other, likely, 1), sure, -np.inf)
                floor = np.maximum(floor, np.partition(sure, -k, axis=1)[:, -k])
            q, c = np.nonzero(other & (bound + slack >= floor[:, None]))
            for number, (fq, fx) in enumerate(resolutions[1:], 1):
                counts[number] += len(q)
                fine = _products(fq[rows], fx[cols], q, c)
                open_ = fine + 1e-6 + 1e-9 * np.abs(fine) >= floor[q]
                q, c = q[open_], c[open_]
            counts[-1] += len(q)
            exact = _products(mine, vectors[cols], q, c)
            good = exact >= floor[q]
            hits.append((q[good], ids[cols][c[good]], exact[good]))
            q, i, s = (np.concatenate(x) for x in zip(*hits))
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            start = np.flatnonzero(np.concatenate([np.ones(min(len(q), 1), bool), q[1:] != q[:-1]]))
            place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
            last = place == k - 1
            floor[q[last]] = np.maximum(floor[q[last]], s[last])
            hits = [(q[place < k], i[place < k], s[place < k])]
        found += [(q + top, i, s) for q, i, s in hits]
    if seen is not None:
        seen[:] = counts
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _products(left: np.ndarray, right: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the pairs: of the few that are left one by one, of a dense set as a matrix."""
    if 8 * len(q) > len(left) * len(right):
        return (left @ right.T)[q, c]
    parts = [np.einsum("nd,nd->n", left[q[a : a + 65536]], right[c[a : a + 65536]]) for a in range(0, len(q), 65536)]
    return np.concatenate(parts) if parts else np.zeros(0)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row, exactly.

    vectors has vec_id and embedding. Rows whose vec_id or embedding is null, or that hold a null or a
    non-finite component, take no part; a vector meets only those of its own length. Ties go to the smaller
    vec_id. Repeated candidates count as rows of their own; repeated queries once. An empty table, or one
    without queries, gives no rows. Blocks of queries meet groups of candidates; each pair of them is one task's
    work, of bounded size, and answers with k rows a query.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    rows = clean.select("vec_id", integer_vector(F.col("embedding"), scale).alias("v"), is_query.alias("asks"))
    rows = staged(rows, "vectors").withColumn("width", F.size("v"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    groups, sets = max(1, math.ceil(n / GROUP)), max(1, math.ceil((asked or 0) / BLOCK))
    groups = max(groups, min(16, math.ceil(n / 500) or 1))
    deal = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = rows.where("asks").dropDuplicates(["vec_id", "v"]).select("vec_id", "v", "width", deal(sets).alias("block"), every(groups).alias("part"))
    others = rows.select("vec_id", "v", "width", deal(groups).alias("part"), every(sets).alias("block"))
    keys = ["width", "block", "part"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        left, right = left.sort_values("vec_id"), right.sort_values("vec_id")
        qid, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        a, b = (np.stack(x["v"].to_list()).reshape(len(x), -1) for x in (left, right))
        q, i, s = best_of(a, qid, b, ids, k)
        return pd.DataFrame({"query_id": qid[q], "vec_id": i, "score": s.astype(np.int64)})

    found = queries.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
    in_order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
