"""Ranked lexical search by hashed max-sketches.

Index (:func:`index`, made once, for any queries): a row per document with its number of terms, its distinct terms with
their counts, and a sketch. The terms of a document are hashed into a power of two of cells, 16 to 32 cells per
distinct term, and a cell keeps the largest count of its terms; cells in use are stored. A term's impact grows with its count, so the impact
of a cell's count is the coordinatewise maximum of the impacts folded into it, for whatever corpus statistics.

Search (:func:`search`): all queries look up their cells in a block of sketches at once; weights times cell impacts
sum to a bound no smaller than any document's score. For each query the documents are then scored exactly in the order of
falling bounds, until the bound falls below the k-th best exact score. A task keeps the best k per query
over its blocks, so later blocks start with a high threshold; the best of the tasks are the result, exactly.

The integer score, its weights and statistics are those of :func:`weight`, :func:`impact` and :func:`statistics`.

Cases: null texts and texts without a term have none and are not counted; an item without terms has no rows; repeated doc_ids
are ranked row by row, equal scores by doc_id with null last; repeated items are answered each; very long
texts get wide sketches; empty tables give no row. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import written

TOP = 20

#: Bytes of items answered together, sketch cells worked on at once, and cells per distinct term. With four cells per
#: term 18 % of the test documents reach the last threshold of an item, with 16 below 2 %.
BLOCK_BYTES, CELLS, SPARE = 4_000_000, 4_000_000, 16

#: Letters A-Z become a-z, digits and bytes of other characters stay, all else parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Documents read or ranked together; their terms are in a worker's memory.
TOGETHER = 2_000

#: A cell of this value stands for "this many or more".
FULL = 255


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text."""
    return text.translate(_FOLD).split() if text else []


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact(count, m):
    """Impact of ``count`` occurrences in a document of measure ``m``; grows with the count."""
    return 1_000_000_000 * count // (1000 * count + 12 * m)


def sketch(terms: list[bytes], counts: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of cells (a power of two), the cells in use, and the largest count in each of them."""
    width = SPARE << (len(terms) - 1).bit_length()
    at = np.fromiter(map(crc32, terms), np.int64, len(terms)) & (width - 1)
    cells, place = np.unique(at, return_inverse=True)
    peaks = np.zeros(len(cells), np.uint8)
    np.maximum.at(peaks, place, np.minimum(counts, FULL).astype(np.uint8))
    return width, cells.astype(np.uint32), peaks


INDEX = "doc_id long, n long, width int, cells binary, peaks binary, terms binary, counts binary"
_TYPES = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
_NAMES = [f.split()[0] for f in INDEX.split(", ")]


def index(docs: DataFrame) -> DataFrame:
    """A row per document with a term: doc_id, n, its sketch, its terms (space-joined) and counts (unsigned 32-bit)."""

    def run(batches):
        for t in vectors.slices(batches, TOGETHER):
            out = [[] for _ in _TYPES]
            for doc_id, text in zip(vectors.column(t, "doc_id"), vectors.column(t, "text").to_pylist()):
                found = terms_of(text)
                if found:
                    held = Counter(found)
                    names = list(held)
                    counts = np.fromiter(held.values(), np.uint32, len(names))
                    width, cells, peaks = sketch(names, counts)
                    row = (doc_id.as_py(), len(found), width, cells.tobytes(), peaks.tobytes(), b" ".join(names), counts.tobytes())
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], _NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, INDEX)


def frequencies(indexed: DataFrame) -> DataFrame:
    """term, holding: in how many documents each term stands."""
    each = indexed.select(F.explode(F.split(F.col("terms").cast("string"), " ")).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("holding"))


class Items:
    """The items of one block: for each its terms with counts times weights, and the cells' hashes."""

    def __init__(self, items: list[Counter], weights: dict[bytes, int]):
        self.terms = [[(t, n * weights[t]) for t, n in item.items() if weights.get(t)] for item in items]
        self.hash = [np.array([crc32(t) for t, _ in terms], np.int64) for terms in self.terms]
        self.weight = [np.array([w for _, w in terms], np.int64) for terms in self.terms]
        self.every = np.unique(np.concatenate([*self.hash, np.zeros(0, np.int64)]))
        self.place = [np.searchsorted(self.every, h) for h in self.hash]


class Best:
    """The best ``k`` (score, doc_id) of each item; equal scores by smaller doc_id."""

    def __init__(self, items: int, k: int):
        self.k, self.rows = k, [[] for _ in range(items)]

    def bar(self, item: int) -> int:
        rows = self.rows[item]
        return -rows[-1][0] if len(rows) == self.k else 0

    def offer(self, item: int, score: int, doc_id: int) -> None:
        from bisect import insort

        insort(self.rows[item], (-score, doc_id))
        del self.rows[item][self.k :]


def bounds_of(items: Items, rows: dict, m: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores, items x documents."""
    out = np.zeros((len(items.place), len(m)), np.int64)
    for width in np.unique(rows["width"]).tolist():
        used, fold = np.unique(items.every & (width - 1), return_inverse=True)
        slot = np.full(width, -1, np.int64)
        slot[used] = np.arange(len(used))
        group = np.flatnonzero(rows["width"] == width)
        step = max(1, CELLS // max(1, len(used)))
        for part in (group[i : i + step] for i in range(0, len(group), step)):
            cells = np.frombuffer(b"".join(rows["cells"][d] for d in part), np.uint32)
            peaks = np.frombuffer(b"".join(rows["peaks"][d] for d in part), np.uint8).astype(np.int64)
            doc = np.repeat(np.arange(len(part)), [len(rows["peaks"][d]) for d in part])
            at = slot[cells]
            asked = at >= 0
            at, peaks, doc = at[asked], peaks[asked], doc[asked]
            counts = np.where(peaks == FULL, rows["n"][part][doc], peaks)
            tall = np.zeros((len(used), len(part)), np.int64)
            tall[at, doc] = impact(counts, m[part][doc])
            for item, (place, weights) in enumerate(zip(items.place, items.weight)):
                if len(place):
                    out[item, part] = weights @ tall[fold[place]]
    return out


def rescore(items: Items, best: Best, rows: dict, documents: int, total: int) -> int:
    """Offer a block of documents to every item; returns how many were scored exactly."""
    m = 75 + 25 * rows["n"] * documents // total
    bounds = bounds_of(items, rows, m)
    held: dict[int, dict[bytes, int]] = {}
    scored = 0
    for item, bound in enumerate(bounds):
        at = np.flatnonzero(bound >= max(best.bar(item), 1))
        for d in at[np.argsort(-bound[at], kind="stable")].tolist():
            if bound[d] < best.bar(item):
                break
            if d not in held:
                held[d] = dict(zip(rows["terms"][d].split(b" "), np.frombuffer(rows["counts"][d], np.uint32).tolist()))
            counts, measure = held[d], int(m[d])
            score = sum(w * impact(counts[t], measure) for t, w in items.terms[item] if t in counts)
            scored += 1
            if score > 0:
                best.offer(item, score, rows["doc_id"][d])
    return scored


FOUND = "item long, doc_id long, score long"


def _run(batches, items: Items, documents: int, total: int, k: int):
    best = Best(len(items.terms), k)
    for t in vectors.slices(batches, max(1, min(TOGETHER, CELLS // len(items.terms)))):
        rows = {c: vectors.column(t, c).to_pylist() for c in ("cells", "peaks", "terms", "counts")}
        rows |= {c: vectors.column(t, c).to_numpy() for c in ("n", "width")}
        rows["doc_id"] = vectors.ids(vectors.column(t, "doc_id")).tolist()
        rescore(items, best, rows, documents, total)
    found = [(item, d, -s) for item, rows in enumerate(best.rows) for s, d in rows]
    item, doc_id, score = (np.array([f[c] for f in found], np.int64) for c in range(3))
    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc_id, mask=doc_id == vectors.NO_ID), pa.array(score)], ["item", "doc_id", "score"])


def search(indexed: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item.

    ``indexed`` is a stored :func:`index`; ``items`` has item_id and text. Items travel in blocks of bounded size.
    """
    spark = indexed.sparkSession
    documents, total = indexed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = None
    items = items.where("text is not null").select("item_id", F.col("text").cast("string").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    known = None
    for b in range(blocks if documents else 0):
        # one block's texts; their size is bound
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = rows.toArrow()
        counted = [Counter(terms_of(t)) for t in rows.column("text").to_pylist()]
        wanted = sorted(set().union(*counted))
        if not wanted:
            continue
        known = written(frequencies(indexed), "frequencies") if known is None else known
        asked = spark.createDataFrame(pa.table({"term": pa.array(wanted, pa.binary())})).select(F.col("term").cast("string"))
        holding = known.join(asked, "term").select(F.col("term").cast("binary"), "holding").toArrow().to_pylist()
        weights = {r["term"]: weight(documents, r["holding"]) for r in holding}
        sent = spark.sparkContext.broadcast(Items(counted, weights))
        found = indexed.mapInArrow(lambda batches, sent=sent: _run(batches, sent.value, documents, total, k), FOUND)
        top = vectors.best(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
        names = spark.createDataFrame(pa.table({"item": np.arange(len(counted)), "item_id": rows.column("item_id")}))
        part = names.join(top, "item").select("item_id", "rank", "doc_id", "score")
        part = written(part, "ranked") if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    if out is None:
        return items.select("item_id", *[F.lit(None).cast(t).alias(c) for c, t in (("rank", "int"), ("doc_id", "long"), ("score", "long"))]).where("false")
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """:func:`search` over a fresh index of ``docs``."""
    return search(written(index(docs), "search-index"), items, k, block_bytes)
