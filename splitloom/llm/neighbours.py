"""Nearest neighbours by stable projections, a kd-tree, and a chi-square stopping test.

Vectors are lifted by one component so that the largest inner product is the least
Euclidean distance. A Gaussian projection to a few dimensions keeps distances up to a
chi-square factor. The tree over the projections gives points in ascending projected
distance, leaf by leaf; they are verified by their true inner product, until the test
says that a nearer point would by now have shown up with the wanted confidence.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Projected dimensions (even), and the confidence at which a search stops.
DIMENSIONS, CONFIDENCE = 8, 0.99
LEAF, SEED = 128, 11
#: Vectors of an index block, and queries that meet it at once.
BLOCK, QUERIES_AT_ONCE = 16_384, 8_192


def chi_square_cdf(x: np.ndarray, freedom: int) -> np.ndarray:
    """Closed form for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    terms = sum(half**n / math.factorial(n) for n in range(freedom // 2))
    return 1 - np.exp(-half) * terms


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of each leaf: halves along the widest side until they are small."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            done.append(rows)
            continue
        axis = int(np.argmax(np.ptp(points[rows], axis=0)))
        half = len(rows) // 2
        order = np.argpartition(points[rows, axis], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return done


class Index:
    """Distinct vectors of one block, projected and cut into leaves with their boxes."""

    def __init__(self, vectors: np.ndarray, dimensions: int = DIMENSIONS):
        self.vectors = vectors
        squares = (vectors**2).sum(axis=1)
        self.reach = float(squares.max())
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(0, self.reach - squares))])
        self.turn = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, dimensions))
        projected = lifted @ self.turn
        self.leaves = kd_leaves(projected)
        self.low = np.array([projected[rows].min(axis=0) for rows in self.leaves])
        self.high = np.array([projected[rows].max(axis=0) for rows in self.leaves])

    def search(self, queries: np.ndarray, k: int, confidence: float = CONFIDENCE) -> np.ndarray:
        """Numbers of up to k vectors for each query, by rounded products; -1 where there are fewer."""
        count, width = len(queries), min(k, len(self.vectors))
        spot = np.column_stack([queries, np.zeros(count)]) @ self.turn
        far = np.maximum(0, np.maximum(self.low[None] - spot[:, None], spot[:, None] - self.high[None]))
        far = (far**2).sum(axis=2)
        order = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, order, axis=1)
        base = (queries**2).sum(axis=1) + self.reach
        best = np.full((count, width), -np.inf)
        names = np.full((count, width), -1)
        active = np.arange(count)
        for step in range(len(self.leaves)):
            # The k-th distance so far bounds what a nearer point may be projected to.
            limit = base[active] - 2 * best[active, -1]
            ratio = far[active, step] / np.maximum(limit, 1e-300)
            going = ~np.isfinite(limit) | (chi_square_cdf(np.where(np.isfinite(limit), ratio, 0), self.turn.shape[1]) < confidence)
            active = active[going]
            if not len(active):
                break
            leaf_of = order[active, step]
            for leaf in np.unique(leaf_of):
                who = active[leaf_of == leaf]
                rows = self.leaves[leaf]
                scores = np.concatenate([best[who], queries[who] @ self.vectors[rows].T], axis=1)
                labels = np.concatenate([names[who], np.broadcast_to(rows, (len(who), len(rows)))], axis=1)
                top = np.argpartition(-scores, width - 1, axis=1)[:, :width]
                scores, labels = np.take_along_axis(scores, top, 1), np.take_along_axis(labels, top, 1)
                by = np.argsort(-scores, axis=1, kind="stable")
                best[who], names[who] = np.take_along_axis(scores, by, 1), np.take_along_axis(labels, by, 1)
        return names


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v, size): vectors of finite components, not all zero, in double precision."""
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_column}`").alias("vec_id"), vector.alias("v")).where("vec_id IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("size", F.size("v"))


def nearest(
    table: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found; ties go to the smaller vec_id.

    Vectors are dealt into blocks by their value, so that copies meet; of each value the
    k + 1 smallest ids are kept, which no answer needs more of. Every query meets
    every block, in chunks of bounded queries; each block is searched by its own tree.

    Vectors that are NULL, zero, or hold NULL or non-finite components take no part, nor
    do NULL ids. Only vectors of equal length compare. A repeated row is a candidate
    once per id; repeated query rows count once. Fewer candidates than k are all given.
    """
    vectors = usable(table, id_column, vector_column)
    same = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.distinct().withColumn("__copy", F.row_number().over(same)).where(F.col("__copy") <= k + 1).drop("__copy")
    blocks = max(1, math.ceil(few.count() / BLOCK))
    asked = usable(queries, id_column, vector_column).distinct()
    chunks = max(1, math.ceil(asked.count() / QUERIES_AT_ONCE))
    dealt = few.withColumn("block", F.pmod(F.hash("v"), F.lit(blocks)))
    spread = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    left = dealt.withColumn("chunk", spread)
    right = asked.withColumn("chunk", F.pmod(F.hash("vec_id"), F.lit(chunks))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )

    def meet(points: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if points.empty or wanted.empty:
            return empty
        ids = points["vec_id"].to_numpy(np.int64)
        matrix = np.array(points["v"].tolist(), float)
        order = np.lexsort((ids, *matrix.T))
        ids, matrix = ids[order], matrix[order]
        new = np.concatenate(([True], (matrix[1:] != matrix[:-1]).any(axis=1)))
        starts = np.append(np.flatnonzero(new), len(ids))
        index = Index(matrix[starts[:-1]])
        asking = wanted["vec_id"].to_numpy(np.int64)
        spots = np.array(wanted["v"].tolist(), float)
        found = index.search(spots, k + 1, confidence)
        out = []
        for query, spot, names in zip(asking, spots, found):
            names = names[names >= 0]
            scores = (index.vectors[names] * spot).sum(axis=1)  # one order of addition for all copies
            sizes = starts[names + 1] - starts[names]
            own = np.concatenate([ids[starts[n] : starts[n + 1]] for n in names])
            each = np.repeat(scores, sizes)
            keep = own != query
            own, each = own[keep], each[keep]
            best = np.lexsort((own, -each))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": own[best], "score": each[best]}))
        return pd.concat(out) if out else empty

    keys = ("size", "block", "chunk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
