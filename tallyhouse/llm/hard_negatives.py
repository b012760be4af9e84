"""Hard negatives by Kronecker-packed products.

Vectors become integers. Components of several candidates, biased to be at least zero, lie in separate fields
of one wide integer; a product with the anchor's (also biased) component adds to all fields at once without
carries, and after the last component each field holds one exact sum, from which the biases are taken off.
The wide integer is a double where 53 bits hold the fields, so that one matrix product multiplies whole blocks,
else a Python integer of any width.

Two passes over the candidates: the first finds each anchor's nearest rows of its own label, the second, whose
bounds follow from their scores, the highest rows of other labels inside the bounds. Anchors travel in blocks
of bounded size; each task keeps a few rows per anchor.

Cases: rows with a null label or vector, or with null or non-finite components, take no part; empty vectors score 0;
shorter vectors are filled with zeros; a null id comes last among ties and is no anchor; an anchor's own rows
are those with its id; an id that is repeated is an anchor once per row, and its repeats are listed as often as
they occur; an empty table gives no row. Scores beyond 64 bits are ordered exactly and shown as the nearest
64-bit number. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors

#: Bits of a double that hold whole numbers, fields of a Python integer, and rows worked on at once.
EXACT_BITS, FIELDS_BEYOND = 53, 8
CANDIDATES, ANCHORS = 8_192, 256

LIMIT = np.iinfo(np.int64).max


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``, as Python integers where 64 bits do not hold it."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if not y.size or np.abs(y).max() < 2**53:
        return y.astype(np.int64)
    exact = [scale * int(v) if np.isinf(b) else int(b) for v, b in zip(x.ravel(), y.ravel())]
    return np.array(exact, dtype=object).reshape(y.shape)


class Packed:
    """Candidates of one slice, several to a wide integer."""

    def __init__(self, rows: np.ndarray, anchor_low: int, anchor_high: int):
        self.n, dim = rows.shape
        low = int(rows.min()) if rows.size else 0
        high = int(rows.max()) if rows.size else 0
        self.low, self.anchor_low, self.dim = low, anchor_low, dim
        self.width = max(1, (dim * (high - low) * (anchor_high - anchor_low)).bit_length())
        self.fields = EXACT_BITS // self.width or FIELDS_BEYOND
        self.kind = np.float64 if self.width <= EXACT_BITS else object
        biased = (rows if self.kind is np.float64 else rows.astype(object)) - low
        self.sums = biased.sum(axis=1)
        per = -(-self.n // self.fields)  # wide integers; field j of integer i is row j * per + i
        wide = np.zeros((per, dim), dtype=biased.dtype)
        for j in range(self.fields):
            part = biased[j * per : (j + 1) * per]
            wide[: len(part)] += part << (j * self.width) if biased.dtype != object else part * (1 << (j * self.width))
        self.wide = wide.astype(self.kind).T.copy()

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors x candidates."""
        biased = (anchors if self.kind is np.float64 else anchors.astype(object)) - self.anchor_low
        sums = biased.sum(axis=1)
        product = biased.astype(self.kind) @ self.wide
        if self.kind is np.float64:
            product = product.astype(np.int64)
        mask = (1 << self.width) - 1
        fields = np.concatenate([(product >> (j * self.width)) & mask for j in range(self.fields)], axis=1)[:, : self.n]
        # sum (a - la)(c - lc) = sum ac - la sum c - lc sum a + dim la lc, with sums of biased parts at hand
        a, c, dim = self.anchor_low, self.low, self.dim
        return fields + c * sums[:, None] + a * self.sums[None, :] + dim * a * c


def _keys(scores: np.ndarray) -> np.ndarray:
    """Whole numbers in the order score up, place down; candidates lie in the order of their ids."""
    n = scores.shape[1]
    if scores.dtype == object or (scores.size and np.abs(scores).max() >= 2**62 // max(n, 1)):
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
    return scores.astype(np.int64) * n + (n - 1 - np.arange(n))


def _highest(keys: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of the ``k`` highest allowed keys of each row."""
    keys = np.where(allowed, keys, np.iinfo(np.int64).min)
    if keys.shape[1] > k:
        at = np.argpartition(keys, keys.shape[1] - k, axis=1)[:, -k:]
    else:
        at = np.broadcast_to(np.arange(keys.shape[1]), keys.shape)
    row = np.broadcast_to(np.arange(len(keys))[:, None], at.shape)
    ok = np.take_along_axis(allowed, at, axis=1)
    return row[ok], at[ok]


class Kept:
    """The best ``k`` (score, id) of each slot, over all slices of a task."""

    def __init__(self, k: int):
        self.k, self.slot, self.id, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, slots, ids, scores) -> None:
        slots, ids = np.concatenate([self.slot, *slots]), np.concatenate([self.id, *ids])
        scores = np.concatenate([self.score, *scores])
        rank = np.unique(scores, return_inverse=True)[1] if scores.dtype == object else scores
        order = np.lexsort((ids, -rank, slots))
        first = np.searchsorted(slots[order], slots[order])
        order = order[np.arange(len(order)) - first < self.k]
        self.slot, self.id, self.score = slots[order], ids[order], scores[order]


def _run(batches, block: dict, pick, k: int, scale: int):
    """Best rows per slot of one task; ``pick(anchor rows, labels, ids, scores)`` gives (anchor, case, allowed) parts."""
    kept = Kept(k)
    for t in vectors.slices(batches, CANDIDATES):
        own = vectors.ids(vectors.column(t, "id"))
        order = np.argsort(own, kind="stable")
        own, labels = own[order], vectors.column(t, "label").to_numpy()[order]
        rows = vectors.matrix(vectors.column(t, "vector"))[order]
        width = max(rows.shape[1], block["rows"].shape[1])
        rows, anchors = integers(vectors.as_wide(rows, width), scale), vectors.as_wide(block["rows"], width)
        packed = Packed(rows, min(0, block["low"]), max(0, block["high"]))
        found = ([], [], [])
        for at in range(0, len(anchors), ANCHORS):
            span = slice(at, at + ANCHORS)
            scores = packed.scores(anchors[span])
            keys = _keys(scores)
            for case, allowed in pick(block, span, labels, own, scores):
                row, place = _highest(keys, allowed, k)
                for out, v in zip(found, ((row + at) * block["cases"] + case, own[place], scores[row, place])):
                    out.append(v)
        kept.add(*found)
    score = np.clip(kept.score, -LIMIT, LIMIT).astype(np.int64) if kept.score.dtype == object else kept.score
    exact = [str(s) for s in kept.score] if kept.score.dtype == object else [None] * len(score)
    ids = pa.array(kept.id, mask=kept.id == vectors.NO_ID)
    yield pa.RecordBatch.from_arrays([pa.array(kept.slot), ids, pa.array(score), pa.array(exact, pa.string())], ["slot", "id", "score", "exact"])


FOUND = "slot long, id long, score long, exact string"


def _same_label(block, span, labels, own, scores):
    yield 0, (block["labels"][span, None] == labels) & (block["ids"][span, None] != own)


def _other_label(block, span, labels, own, scores):
    other = block["labels"][span, None] != labels
    for case in range(block["cases"]):
        low, high = block["floor"][span, case, None], block["ceiling"][span, case, None]
        yield case, other & (scores >= low) & (scores <= high)


def _ordered(df: DataFrame, k: int) -> DataFrame:
    """Scores of more than 64 bits tie as clipped numbers, so their exact text decides, sign and length first."""
    size = F.coalesce(F.length("exact"), F.lit(0))
    signed = F.when(F.col("score") < 0, -size).otherwise(size)
    digits = F.coalesce(F.col("exact"), F.lit(""))
    order = [F.desc("score"), signed.desc(), F.when(F.col("score") >= 0, digits).desc(), digits.asc(), F.asc_nulls_last("id")]
    return vectors.best(df, ["slot"], order, k)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = 256,
    block_rows: int = vectors.QUERY_BLOCK,
) -> DataFrame:
    """For each anchor and positive the highest rows of other labels with a score between two shares of the positive's.

    ``df`` has vec_id, embedding and an integer label. Columns: anchor_id, positive_id, positive_rank, rank,
    negative_id, positive_score, negative_score.
    """
    spark = df.sparkSession
    rows = df.where(F.col("label").isNotNull() & vectors.finite(F.col("embedding")))
    rows = rows.select(
        F.col("vec_id").cast("long").alias("id"),
        F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    candidates = rows.drop("anchor")

    def search(table: pa.Table) -> DataFrame:
        ints = integers(vectors.matrix(vectors.column(table, "vector")), scale)
        block = {
            "rows": ints,
            "low": int(ints.min()) if ints.size else 0,
            "high": int(ints.max()) if ints.size else 0,
            "ids": vectors.ids(vectors.column(table, "id")),
            "labels": vectors.column(table, "label").to_numpy(),
            "cases": 1,
        }

        def scan(block, pick, k):
            sent = spark.sparkContext.broadcast(block)
            return candidates.mapInArrow(lambda batches: _run(batches, sent.value, pick, k, scale), FOUND)

        near = _ordered(scan(block, _same_label, positives), positives).toArrow().to_pylist()  # a few rows per anchor of the block
        n = len(block["ids"])
        floor = np.full((n, positives), 1, dtype=object)
        ceiling = np.zeros((n, positives), dtype=object)  # without a positive nothing is allowed
        for p in near:
            s = int(p["exact"] or p["score"])
            floor[p["slot"], p["rank"] - 1] = -(-low_percent * s // 100)
            ceiling[p["slot"], p["rank"] - 1] = high_percent * s // 100
        if max(map(abs, [*floor.ravel(), *ceiling.ravel()]), default=0) < LIMIT:
            floor, ceiling = floor.astype(np.int64), ceiling.astype(np.int64)
        block |= {"cases": positives, "floor": floor, "ceiling": ceiling}
        far = _ordered(scan(block, _other_label, negatives), negatives)
        places = [(p["slot"] * positives + p["rank"] - 1, int(block["ids"][p["slot"]]), p["id"], p["rank"], p["score"]) for p in near]
        known = pa.Table.from_pylist(
            [dict(zip(("slot", "anchor_id", "positive_id", "positive_rank", "positive_score"), p)) for p in places],
            schema=pa.schema([("slot", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_rank", pa.int32()), ("positive_score", pa.int64())]),
        )
        return (
            spark.createDataFrame(known)
            .join(far, "slot")
            .select("anchor_id", "positive_id", "positive_rank", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        )

    anchors = rows.where("anchor and id is not null").select("id", "label", "vector")
    found = vectors.in_blocks(anchors, search, "hard-negatives", block_rows)
    if found is None:
        empty = "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], empty)
    return found
