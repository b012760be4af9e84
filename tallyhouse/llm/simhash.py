"""Near-duplicates by 64-bit SimHash, linked by a self-join of binary tries.

Fingerprints are made in Arrow batches, one pass over the texts. Equal fingerprints become
one node at once, so a group of copies costs one node however large it is.

The self-join walks pairs of trie nodes together: a pair of nodes stands for all pairs of
fingerprints below them, carries the number of bits in which the paths differ, and is dropped
when that exceeds the budget. To spread the walk over tasks, the bits are turned so that each
third of them comes first once: with a budget of two, a linked pair agrees on one whole third,
so it meets in a subtree whose root is reached without spending anything. A task owns whole
subtrees. A subtree with more than ``split`` fingerprints is dealt out again as pairs of deeper
nodes, those whose next eight bits differ by no more than the budget.

A task keeps a spanning forest of the links it found, not the links: the rows that leave it are
fewer than the fingerprints that came in, and no link between components is lost. The forests
are joined by alternating large-star and small-star steps, each written to the shared folder.

Defined cases. Null and empty texts have fingerprint zero and are linked to each other and to
what is near zero. Repeated rows share their class. A class without any doc_id has a null
component_id. An empty table gives an empty result. Extra columns are ignored by the report and
pass through :func:`one_of_each`.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, scanned, written

SHINGLE = 3
SEED = 42
BITS = 64
ERRORS = 2
THIRDS = (21, 21, 22)
SPLIT = 50_000
DEEPER = 8
_CHUNK = 1 << 20
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None) -> int:
    """SimHash of the lower-cased word shingles of a text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        total, step = 1, 1
    else:
        total, step = len(words) - SHINGLE + 1, SHINGLE
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, _CHUNK):
        part = words[at : at + _CHUNK + step - 1]
        grams = part if step == 1 else map(b" ".join, zip(part, part[1:], part[2:]))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints():
    return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each row."""
    df = scanned(docs.select("doc_id", "text"), _fingerprints, "fp long")
    return df.select("row.doc_id", "fp")


# ---- the trie walk -------------------------------------------------------------------------
def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position of each component after adding the links i-j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def walk(x: np.ndarray, starts, budget: int = ERRORS, block: int = 1 << 20) -> np.ndarray:
    """Components of the sorted distinct values ``x`` that meet below the start pairs.

    ``starts`` is (a0, a1, b0, b1, spent, bit): ranges of positions of the two nodes, the bits
    they differ in, and the number of bits below them. A node is a range because values
    with one prefix stand side by side. Pairs are expanded a level at a time, in blocks, deepest
    first, so that memory stays near one block.
    """
    label = np.arange(len(x))
    ones: dict[int, np.ndarray] = {}

    def middle(bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if bit not in ones:
            set_ = ((x >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
            ones[bit] = np.concatenate(([0], np.cumsum(set_)))
        return hi - (ones[bit][hi] - ones[bit][lo])

    stack = [starts]
    while stack:
        a0, a1, b0, b1, spent, bit = stack.pop()
        if len(a0) > block:
            half = len(a0) // 2
            stack += [(a0[s], a1[s], b0[s], b1[s], spent[s], bit) for s in (slice(half), slice(half, None))]
            continue
        own = a0 == b0
        single = ~own & (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(x[i] ^ x[j]) <= budget
            label = _union(label, i[near], j[near])
        rest = ~single
        a0, a1, b0, b1, spent, own = (v[rest] for v in (a0, a1, b0, b1, spent, own))
        if not len(a0) or bit == 0:
            continue
        am, bm = middle(bit - 1, a0, a1), middle(bit - 1, b0, b1)
        pairs = [
            (a0, am, b0, bm, spent, slice(None)),
            (am, a1, bm, b1, spent, slice(None)),
            (a0, am, bm, b1, spent + 1, slice(None)),
            (am, a1, b0, bm, spent + 1, ~own),  # of a node with itself the mirror pair is left out
        ]
        c0, c1, d0, d1, e = (np.concatenate([p[k][p[5]] for p in pairs]) for k in range(5))
        live = (c1 > c0) & (d1 > d0) & (e <= budget) & ~((c0 == d0) & (c1 - c0 == 1))
        if live.any():
            stack.append((c0[live], c1[live], d0[live], d1[live], e[live], bit - 1))
    return label


def _starts(group: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, first_bits: np.ndarray):
    """Start pairs of the groups of equal ``group``: a node with itself, or its two deeper nodes."""
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    end = np.append(cut[1:], len(group))
    for bits in np.unique(first_bits[cut]):
        at = first_bits[cut] == bits
        c, e = cut[at], end[at]
        plain = lo[c] == hi[c]
        left = BITS - int(bits)
        if plain.any():
            many = plain & (e - c > 1)
            yield c[many], e[many], c[many], e[many], np.zeros(many.sum(), np.int64), left
        two = ~plain
        if two.any():
            c, e = c[two], e[two]
            # values of the lower node come first
            deep = (x >> np.uint64(left - DEEPER)) & np.uint64((1 << DEEPER) - 1)
            is_hi = np.concatenate(([0], np.cumsum(deep == hi.astype(np.uint64))))
            mid = e - (is_hi[e] - is_hi[c])
            spent = np.bitwise_count(lo[c] ^ hi[c]).astype(np.int64)
            both = (mid > c) & (mid < e)
            yield c[both], mid[both], mid[both], e[both], spent[both], left - DEEPER


def _forests(budget: int):
    """Arrow batches sorted by group and x -> spanning forests (u, v) of the links inside groups."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def joined(table: pa.Table):
            col = lambda n, t: table.column(n).to_numpy().astype(t)
            x, fp = table.column("x").to_numpy().view(np.uint64), table.column("fp").to_numpy()
            group, lo, hi, bits = col("g", np.int64), col("lo", np.int64), col("hi", np.int64), col("bits", np.int64)
            for start in _starts(group, x, lo, hi, bits):
                if len(start[0]):
                    label = walk(x, start, budget)
                    i = np.flatnonzero(label != np.arange(len(label)))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[label[i]])], schema=schema)

        for batch in batches:
            held.append(batch)
            g = batch.column("g").to_numpy()
            if len(g) and g[0] != g[-1] and sum(b.num_rows for b in held) >= 50_000:
                table = pa.Table.from_batches(held)
                whole = table.column("g").to_numpy()
                last = len(whole) - int(np.argmax(whole[::-1] != whole[-1]))  # start of the open group
                yield from joined(table.slice(0, last))
                held = table.slice(last).to_batches()
        if held:
            yield from joined(pa.Table.from_batches(held))

    return run


def links(nodes: DataFrame, budget: int = ERRORS, split: int = SPLIT) -> DataFrame:
    """Spanning forest (u, v) of the distinct fingerprints ``nodes.fp`` within the budget.

    The thirds cover every linked pair for a budget of two or less.
    """
    if not 0 <= budget < len(THIRDS):
        raise ValueError("the thirds of a fingerprint cover budgets of 0, 1 and 2")
    turned, skip = [], 0
    for k, width in enumerate(THIRDS):
        x = F.col("fp") if not skip else F.expr(f"shiftleft(fp, {skip}) | shiftrightunsigned(fp, {BITS - skip})")
        turned.append(F.struct(F.lit(k).alias("third"), F.lit(width).alias("bits"), x.alias("x"), F.expr(f"shiftrightunsigned({'fp' if not skip else f'shiftleft(fp, {skip})'}, {BITS - width})").alias("key")))
        skip += width
    rows = nodes.select("fp", F.explode(F.array(*turned)).alias("t")).select("fp", "t.*")
    counts = rows.groupBy("third", "key").agg(F.count("*").alias("n")).where("n > 1")
    counts = written(counts, "trie-subtrees")
    rows = rows.join(counts, ["third", "key"])
    # the next bits below the subtree's root, and the nodes there within the budget
    deep = F.expr(f"cast(shiftrightunsigned(x, {BITS - DEEPER} - bits) & {(1 << DEEPER) - 1} as int)")
    masks = [m for m in range(1 << DEEPER) if m.bit_count() <= budget]
    other = F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("deep").bitwiseXOR(m))
    pair = lambda o: F.struct(F.least("deep", o).alias("lo"), F.greatest("deep", o).alias("hi"))
    one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    rows = rows.withColumn("deep", deep)
    rows = rows.withColumn("p", F.explode(F.when(F.col("n") > split, F.transform(other, pair)).otherwise(one)))
    rows = rows.select("third", "key", "bits", "p.lo", "p.hi", "x", "fp")
    # groups get a number of their own within a task, so that equal keys never meet by chance of hashing
    rows = rows.repartition("third", "key", "lo", "hi").withColumn("unsigned", F.expr("x ^ (-9223372036854775807 - 1)"))
    rows = rows.sortWithinPartitions("third", "key", "lo", "hi", "unsigned")
    rows = rows.select(
        # third (2 bits), key (22), lo and hi (8 each): an exact number for each group
        F.expr("((cast(third as bigint) * 4194304 + key) * 256 + lo) * 256 + hi").alias("g"),
        F.col("lo").cast("long").alias("lo"),
        F.col("hi").cast("long").alias("hi"),
        F.col("bits").cast("long").alias("bits"),
        "x",
        "fp",
    )
    return rows.mapInArrow(_forests(budget), "u long, v long")


def stars(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(v, root) for every value in ``edges`` (u, v): root is the smallest value of the component.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until nothing changes.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    while True:
        # large-star: every larger neighbour is tied to the smallest of the neighbourhood
        near = both(edges)
        low = near.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = near.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: so is every smaller or equal one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        seen = now


def classes(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """doc_id, fp, root (a class key) and component_id (its smallest doc_id) of every row."""
    prints = written(fingerprinted(docs), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = stars(links(nodes, split=split))
    rooted = nodes.join(roots, nodes["fp"] == roots["v"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = written(rooted.join(ids, "root").select("fp", "root", "component_id"), "fingerprint-classes")
    return prints.join(known, "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each class of near-duplicates, with its own columns.

    Rows that share a doc_id are told apart by their fingerprints; of several in one class the
    smallest fingerprint stays. A class without any doc_id keeps one of its rows.
    """
    found = classes(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # one (doc_id, fp) of one row: the minimum of a pair, not a pair of minima
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("c"))
    chosen = written(first.select(F.col("c.doc_id").alias("chosen"), F.col("c.fp").alias("chosen_fp")), "chosen")
    ids = chosen.where("chosen is not null")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    # only rows with a chosen id are fingerprinted again
    near = rows.join(ids.select("chosen").distinct(), F.col("doc_id") == F.col("chosen"), "left_semi")
    near = scanned(near, _fingerprints, "fp long", with_text=True).select("row.row", "row.doc_id", "fp")
    near = near.join(ids, (F.col("doc_id") == F.col("chosen")) & (F.col("fp") == F.col("chosen_fp")), "left_semi")
    with_id = near.dropDuplicates(["doc_id", "fp"]).select("row.*")
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return with_id
    # rows without an id that are the only kind in their class: one per class
    prints = scanned(nameless, _fingerprints, "fp long", with_text=True)
    alone = chosen.where("chosen is null").select("chosen_fp")
    alone = prints.join(alone, F.col("fp") == F.col("chosen_fp")).dropDuplicates(["chosen_fp"])
    return with_id.unionByName(alone.select("row.*", "text").select(*docs.columns))
