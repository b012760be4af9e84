"""Packing of tokenised documents into windows of fixed length by best-fit decreasing.

A document longer than a window is first cut into full windows and a rest. Pieces are dealt by
hash into groups of about ``PIECES`` pieces; in each, pieces go from long to short into the open
window with the tightest sufficient room. A segment tree over room sizes finds it in eleven
steps. A group leaves a few windows not full, so the padding is in proportion to the number of
groups, about one in ``PIECES`` pieces, and independent of hot documents: a long one is many
pieces, copies have ids of their own.

Tokenising happens once; its result, without texts, is written to the shared folder.

Defined cases. Null and empty texts are one closing token. Documents of equal id are packed
apart. Null ids are packed like others. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scanned, written
from .tokens import encoder

LENGTH = 2048
CLOSING_ID = 1
#: Pieces that one task packs together; bounds its memory and its running time.
PIECES = 20_000

PIECE = "start:long,length:long,ids_crc32:long,doc_tokens:long"


def cut(ids: bytes, length: int, keep_ids: bool) -> list[dict]:
    """Pieces of a document's ids: full windows and the rest."""
    n = len(ids) // 4
    out = []
    for start in range(0, n, length):
        part = ids[4 * start : 4 * (start + length)]
        piece = {"start": start, "length": len(part) // 4, "ids_crc32": zlib.crc32(part), "doc_tokens": n}
        out.append(piece | {"ids": part} if keep_ids else piece)
    return out


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids."""
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def make():
        ids = encoder(vocabulary).ids
        return lambda texts: [[cut(x + closing, length, keep_ids) for x in ids([t or "" for t in texts])]]

    kind = PIECE + (",ids:binary" if keep_ids else "")
    df = scanned(docs.select("doc_id", "text"), make, f"p array<struct<{kind}>>")
    return df.select("row.doc_id", F.explode("p").alias("p")).select("doc_id", "p.*")


class RoomTree:
    """Segment tree over room sizes 0..length; a node is set if a size below it has open windows."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.open = bytearray(2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        at = self.size + room
        while at and not self.open[at]:
            self.open[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) of the tightest window with at least ``need`` room."""
        at, tree = self.size + need, self.open
        if not tree[at]:
            # up until something is open to the right, then down its left-most open path
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.size
        window = self.windows[room].pop()
        if not self.windows[room]:
            tree[at] = 0
            at >>= 1
            while at and not (tree[2 * at] or tree[2 * at + 1]):
                tree[at] = 0
                at >>= 1
        return room, window


def best_fit(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece, for lengths in descending order."""
    window, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int(np.searchsorted(-lengths, -length, side="right"))  # these fill a window each
    window[:full] = np.arange(full)
    count, tree = full, RoomTree(length)
    for i in range(full, len(lengths)):
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            room, at = length, count
            count += 1
        else:
            room, at = found
        window[i], offset[i] = at, length - room
        if room > n:
            tree.add(room - n, at)
    return window, offset


def packed(parts: DataFrame, length: int = LENGTH, per_group: int = PIECES) -> DataFrame:
    """``parts`` (see :func:`pieces`) with sequence_id and offset."""
    groups = max(1, -(-parts.count() // per_group))
    hashed = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(groups))

    def pack(key, group):
        order = [("length", "descending"), *[(c, "ascending") for c in ("doc_id", "start", "ids_crc32")]]
        group = group.drop_columns(["pack_group"]).sort_by(order)
        window, offset = best_fit(group.column("length").to_numpy(), length)
        group = group.append_column("offset", pa.array(offset))
        return group.append_column("sequence_id", pa.array(window * groups + key[0].as_py()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return (
        parts.withColumn("pack_group", hashed)
        .groupBy("pack_group")
        .applyInArrow(pack, f"{schema}, offset long, sequence_id long")
    )


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    parts = written(pieces(docs, vocabulary, length, keep_ids), "token-pieces")
    return packed(parts, length)
