"""Approximate nearest neighbours by collision counting.

Each of ``AXES`` random directions gives one sorted array of the rows' projections. A query looks at the windows
around its own projections; they are widened level by level (virtual rehashing: the arrays stay, only the window
grows) and each row counts in how many windows it lies. A row counted ``THRESHOLD`` times or more is verified by its
true distance. The projections of a difference are normal with the distance as deviation, so the count of a row at distance d
is binomial, whatever the data; the search stops when a row as near as the current k-th best would have reached
the threshold with probability ``phi(SURE)``, or when every row is verified. No data decide the parameters.

Rows are indexed in partitions of about ``ROWS``; every row is indexed. A partition gives its k best per query, and
the best of these are the result. Queries travel in blocks of bounded size. Equal vectors share one entry with
their ``k`` + 1 smallest ids, which is all that a result of ``k`` rows with ties by id can need.

Cases: vectors null, zero, empty or with null or non-finite components take no part; shorter vectors are filled with
zeros; a query's own rows are those with its id; a null id comes last among ties and is no query; a repeated id is
a query once per row; an empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

from math import ceil, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors

AXES, THRESHOLD, SURE, GROWTH, SEED = 96, 48, 1.75, 1.25, 12
ROWS = 32_768


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, AXES))


def enough() -> float:
    """Half-width, in units of a distance, at which a row at that distance is counted often enough almost surely."""
    p = THRESHOLD / AXES
    return NormalDist().inv_cdf((1 + p + SURE * sqrt(p * (1 - p) / AXES)) / 2)


class SortedArrays:
    """Index of one set of rows: distinct vectors, their ids, and a sorted array per direction."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int, axes: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        x, ids = np.ascontiguousarray(x[by_id]), ids[by_id]
        raw = x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
        _, first, same = np.unique(raw, return_index=True, return_inverse=True)
        order = np.argsort(same, kind="stable")
        start = np.searchsorted(same[order], np.arange(len(first)))
        nth = np.arange(len(order)) - start[same[order]]
        order = order[nth <= k]
        self.ids, self.start = ids[order], np.searchsorted(same[order], np.arange(len(first) + 1))
        self.x, self.k = x[first], k
        at = self.x @ axes
        self.order = np.ascontiguousarray(np.argsort(at, axis=0).T.astype(np.int32))
        self.values = np.ascontiguousarray(np.sort(at, axis=0).T)
        spread = np.quantile(self.values, 0.75, axis=1) - np.quantile(self.values, 0.25, axis=1)
        widest = float((self.values[:, -1] - self.values[:, 0]).max())
        self.level = float(np.median(spread)) / 64 or widest / 2**20 or 1.0

    def search(self, queries: np.ndarray, own: np.ndarray, axes: np.ndarray):
        """(query place, id, distance) of the nearest ``k`` found for each query."""
        n, k = len(self.x), self.k
        centre = queries @ axes
        active = np.arange(len(queries))
        counts = np.zeros((len(queries), n), np.uint8 if AXES < 256 else np.uint16)
        seen = np.zeros((len(queries), n), bool)
        low = np.stack([np.searchsorted(v, c) for v, c in zip(self.values, centre.T)], axis=1)
        high, left = low.copy(), np.full(len(queries), n)
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        half, reach = self.level, enough()
        while len(active):
            c = centre[active].T
            new_low = np.stack([np.searchsorted(v, q - half, "left") for v, q in zip(self.values, c)], axis=1)
            new_high = np.stack([np.searchsorted(v, q + half, "right") for v, q in zip(self.values, c)], axis=1)
            going = []
            for q, lows, highs in zip(active, new_low, new_high):
                pieces = [o[a:b] for o, a, b in zip(self.order, lows, low[q])]
                pieces += [o[a:b] for o, a, b in zip(self.order, high[q], highs)]
                counts[q] += np.bincount(np.concatenate(pieces), minlength=n).astype(counts.dtype)
                low[q], high[q] = lows, highs
                found = np.flatnonzero((counts[q] >= THRESHOLD) & ~seen[q])
                if len(found):
                    seen[q, found] = True
                    left[q] -= len(found)
                    best[q] = self._verified(queries[q], own[q], found, best[q])
                done = len(best[q][0]) == k and half >= reach * best[q][1][-1]
                if left[q] and not done:
                    going.append(q)
            active = np.array(going, dtype=np.int64)
            half *= GROWTH
        for q, (ids, far) in enumerate(best):
            yield q, ids, far

    def _verified(self, query, own, found, best):
        far = distances(self.x[found], query)
        if len(best[0]) == self.k:
            near = far <= best[1][-1]
            found, far = found[near], far[near]
        size = self.start[found + 1] - self.start[found]
        at = np.repeat(self.start[found], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids, far = self.ids[at], np.repeat(far, size)
        other = ids != own
        ids, far = np.concatenate([best[0], ids[other]]), np.concatenate([best[1], far[other]])
        order = np.lexsort((ids, far))[: self.k]
        return ids[order], far[order]


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in doubles; very large numbers are scaled by a power of two first."""
    diff = x - query
    most = np.abs(diff).max() if diff.size else 0.0
    scale = 2.0 ** int(np.frexp(most)[1]) if most > 1e150 else 1.0
    return np.sqrt(((diff / scale) ** 2).sum(axis=1)) * scale


FOUND = "slot long, id long, distance double"
TOGETHER = 64  # queries searched together: counts of 64 x ROWS bytes


def _run(batches, block: dict, k: int):
    for t in vectors.slices(batches, ROWS):
        x = vectors.matrix(vectors.column(t, "vector"))
        width = max(x.shape[1], block["rows"].shape[1])
        axes = directions(width)
        queries = vectors.as_wide(block["rows"], width)
        index = SortedArrays(vectors.as_wide(x, width), vectors.ids(vectors.column(t, "id")), k, axes)
        slots, ids, far = [], [], []
        for at in range(0, len(queries), TOGETHER):
            for q, found, d in index.search(queries[at : at + TOGETHER], block["ids"][at : at + TOGETHER], axes):
                slots.append(np.full(len(found), at + q))
                ids.append(found)
                far.append(d)
        slots, ids, far = (np.concatenate(v) for v in (slots, ids, far))
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(ids, mask=ids == vectors.NO_ID), pa.array(far)], ["slot", "id", "distance"])


def neighbours(df: DataFrame, is_query: Column, k: int = 10, block_rows: int = vectors.QUERY_BLOCK, rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id and score (the distance) of the ``k`` nearest rows found for each query row.

    ``df`` has vec_id and embedding.
    """
    spark = df.sparkSession
    use = vectors.finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    data = df.where(use).select(
        F.col("vec_id").cast("long").alias("id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    )
    # few large indexes; a common vector is spread by its ids
    parts = max(1, -(-data.count() // rows))
    indexed = data.select("id", "vector").repartition(parts, "id", "vector")

    def search(table: pa.Table) -> DataFrame:
        block = {"rows": vectors.matrix(vectors.column(table, "vector")), "ids": vectors.ids(vectors.column(table, "id"))}
        sent = spark.sparkContext.broadcast(block)
        found = indexed.mapInArrow(lambda batches: _run(batches, sent.value, k), FOUND)
        nearest = vectors.best(found, ["slot"], [F.asc("distance"), F.asc_nulls_last("id")], k)
        names = pa.table({"slot": np.arange(len(block["ids"])), "query_id": block["ids"]})
        return spark.createDataFrame(names).join(nearest, "slot").select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))

    found = vectors.in_blocks(data.where("query and id is not null").select("id", "vector"), search, "neighbours", block_rows)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found
