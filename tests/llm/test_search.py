"""Operators 11 to 13 against brute force, with odd rows, ties, repeats and blocks of queries."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ODD_TEXTS
from pyspark.sql import functions as F

from tallyhouse.llm import hard_negatives, neighbours, ranked_search, vectors
from tallyhouse.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


# ---- ranked search -------------------------------------------------------------------------
def terms_by_hand(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def ranked_by_hand(docs, items, k=20):
    held = [(d, Counter(terms_by_hand(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    count, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 100 - 25 + (25 * n * count) // total
            s = 0
            for t in terms_by_hand(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    s += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def some_words(rng, n):
    return " ".join(f"t{min(int(rng.paretovariate(0.6)), 4000)}" for _ in range(n))


@pytest.mark.parametrize("block_bytes", [ranked_search.BLOCK_BYTES, 600])
def test_ranked_search_by_brute_force(spark, make_docs, block_bytes):
    rng = random.Random(11)
    docs = list(enumerate(some_words(rng, rng.choice([1, 5, 60, 400])) for _ in range(300)))
    docs += [(None, "t1 t2 t3"), (7, "t1 t2 t900"), (7, "t1 t2 t900")]  # null and repeated ids
    docs += [(1000 + k, "Tied TEXT with t5, t6!") for k in range(40)]
    docs += [(2000, "t1 " * 50_000 + "t77"), (2001, "t9 " * 300)]  # counts beyond a cell
    docs += [(3000 + k, t) for k, t in enumerate(ODD_TEXTS)]
    items = [(k, some_words(rng, 12)) for k in range(25)]
    items += [(90, None), (91, ""), (92, "unknown words only zz"), (93, "tied text"), (93, "tied text"), (94, "t1 t1 t1 t9"), (95, "É é same line")]
    frame = make_docs(docs, parts=5).withColumns({"n": F.lit("clash"), "terms": F.lit(1), "item": F.lit(2)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("clash"))
    got = ranked_search.ranked(frame, asked, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked_by_hand(docs, items)


def test_ranked_search_empty_tables(spark, make_docs):
    asked = spark.createDataFrame([("a", "word"), ("b", None)], "item_id string, text string")
    for docs in (make_docs([]), make_docs([None, "", "..."])):
        got = ranked_search.ranked(docs, asked)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []
    got = ranked_search.ranked(make_docs(["word"]), asked.where("false"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []


def test_bounds_hold_and_most_documents_are_not_scored():
    rng = random.Random(5)
    texts = [some_words(rng, rng.choice([3, 30, 300])).encode() for _ in range(2000)]
    rows = defaultdict(list)
    for d, text in enumerate(texts):
        held = Counter(ranked_search.terms_of(text))
        counts = np.array(list(held.values()), np.uint32)
        width, cells, peaks = ranked_search.sketch(list(held), counts)
        assert width >= 16 * len(held) and len(cells) <= len(held)
        for name, v in zip(("doc_id", "n", "width", "cells", "peaks", "terms", "counts"), (d, sum(held.values()), width, cells.tobytes(), peaks.tobytes(), b" ".join(held), counts.tobytes())):
            rows[name].append(v)
    rows |= {c: np.array(rows[c]) for c in ("n", "width")}
    total, df = int(rows["n"].sum()), Counter(t for x in rows["terms"] for t in x.split())
    weights = {t: ranked_search.weight(len(texts), n) for t, n in df.items()}
    items = ranked_search.Items([Counter(ranked_search.terms_of(some_words(rng, 10).encode())) for _ in range(20)], weights)
    m = 75 + 25 * rows["n"] * len(texts) // total
    bounds = ranked_search.bounds_of(items, rows, m)
    for item, terms in enumerate(items.terms):
        for d in range(0, len(texts), 7):
            held = Counter(ranked_search.terms_of(texts[d]))
            score = sum(w * ranked_search.impact(held[t], int(m[d])) for t, w in terms if held[t])
            assert score <= bounds[item, d]
    best = ranked_search.Best(20, 20)
    assert ranked_search.rescore(items, best, rows, len(texts), total) < 20 * len(texts) // 4


# ---- vectors -------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(dim):
    one = [0.25] * dim
    return [
        (None, one, 1),
        (400, None, 1),
        (500, one, None),
        (600, [None, *one[1:]], 2),
        (700, [NAN, *one[1:]], 2),
        (800, [INF, *one[1:]], 2),
        (900, [0.0] * dim, 3),
        (1000, [], 3),
        (1100, one[:2], 3),
        (1200, one, 3),
        (1300, one, 3),
        (1300, one, 3),  # a repeated row
        (1301, one, 4),
        (1302, [-x for x in one], 4),
    ]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def clustered(rng, n, dim):
    centres = rng.normal(size=(12, dim))
    return (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)


def padded(v, dim):
    return np.array([*map(float, v), *[0.0] * (dim - len(v))])


@pytest.mark.parametrize("block_rows", [vectors.QUERY_BLOCK, 3])
def test_neighbours_by_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    dim = 8
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(clustered(rng, 300, dim))] + odd_vectors(dim)
    frame = spark.createDataFrame(rows, VECTORS).repartition(4).withColumns({"id": F.lit("clash"), "slot": F.lit(1), "rank": F.lit(2)})
    got = neighbours.neighbours(frame, F.col("vec_id") % 100 == 0, block_rows=block_rows, rows=100)
    found = defaultdict(list)
    for r in got.collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    used = [(i, padded(v, dim)) for i, v, _ in rows if usable(v) and any(v)]
    queries = [(i, v) for i, v in used if i is not None and i % 100 == 0]
    assert set(found) == {i for i, _ in queries}
    hit = total = 0
    for q, v in queries:
        want = sorted((float(np.sqrt(((v - w) ** 2).sum())), i is None, i) for i, w in used if i != q)[:10]
        times = sum(i == q for i, _ in queries)
        mine = sorted(found[q], key=lambda r: r[0])[::times]
        assert [r[0] for r in mine] == list(range(1, 11))
        left = Counter((i, round(d, 9)) for d, _, i in want)
        hit += sum((Counter((i, round(d, 9)) for _, i, d in mine) & left).values())
        total += 10
        assert [(d, i is None, i) for _, i, d in mine] == sorted((d, i is None, i) for _, i, d in mine)
    assert hit >= 0.9 * total


def test_neighbours_few_rows_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1)], VECTORS)
    got = neighbours.neighbours(few, F.col("vec_id") == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, math.sqrt(2))]
    assert neighbours.neighbours(few.where("false"), F.lit(True)).collect() == []
    alone = neighbours.neighbours(few.where("vec_id = 0"), F.lit(True))
    assert alone.columns == ["query_id", "rank", "vec_id", "score"] and alone.collect() == []


def test_neighbours_huge_numbers(spark):
    big = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.neighbours(big, F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 1e300), (1, 2e300)]


def test_recall_on_the_test_table(spark, root):
    table = spark.read.parquet(f"{root}/embeddings.parquet").toArrow()
    x, ids = vectors.matrix(vectors.column(table, "embedding")), table.column("vec_id").to_numpy()
    found = defaultdict(dict)
    for r in QUERIES["op12_nearest_neighbours"](spark, root).collect():
        found[r["query_id"]][r["vec_id"]] = r["score"]
    hit = 0
    queries = np.flatnonzero(ids % 100 == 0)
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        near = [k for k in np.lexsort((ids, d)) if k != q][:10]
        hit += sum(int(ids[k]) in found[int(ids[q])] for k in near)
        for k in near:
            if int(ids[k]) in found[int(ids[q])]:
                assert found[int(ids[q])][int(ids[k])] == pytest.approx(d[k], rel=1e-12)
    assert hit >= 0.9 * 10 * len(queries)


def negatives_by_hand(rows, dim, scale=256):
    used = [(i, [math.floor(scale * float(x)) for x in padded(v, dim)], l) for i, v, l in rows if l is not None and usable(v)]
    out = []
    for a, va, la in used:
        if a is None or a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i is None, i, l) for i, v, l in used if i != a]
        for s, _, p, l in sorted(r for r in scored if r[3] == la)[:5]:
            ok = sorted(r for r in scored if r[3] != la and 50 * -s <= 100 * -r[0] <= 95 * -s)[:3]
            out += [(a, p, k + 1, r[2], -s, -r[0]) for k, r in enumerate(ok)]
    return sorted(out, key=repr)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("size,block_rows", [(1.0, vectors.QUERY_BLOCK), (1.0, 3), (3e5, 100), (1e18, 100)])
def test_hard_negatives_by_brute_force(spark, size, block_rows):
    """Two fields to a double, one, and Python integers; queries in one block and in several."""
    rng = np.random.default_rng(8)
    dim = 6
    rows = [(k, [float(np.float32(x * size)) for x in v], int(k % 4)) for k, v in enumerate(clustered(rng, 260, dim))]
    rows += [r for r in odd_vectors(dim)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({"id": F.lit("clash"), "score": F.lit(1)})
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0, block_rows=block_rows)
    mine = sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr)
    limit = hard_negatives.LIMIT
    want = [(*r[:4], *(max(-limit, min(limit, s)) for s in r[4:])) for r in negatives_by_hand(rows, dim)]
    assert mine == sorted(want, key=repr) and mine


def test_hard_negatives_empty(spark):
    frame = spark.createDataFrame([], VECTORS)
    got = hard_negatives.hard_negatives(frame, F.lit(True))
    assert got.collect() == [] and set(COLUMNS) <= set(got.columns)


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for bits in (4, 9, 20, 26, 40):
        rows = rng.integers(-(2**bits), 2**bits, (37, 16))
        anchors = rng.integers(-(2**bits), 2**bits, (5, 16))
        packed = hard_negatives.Packed(rows, int(anchors.min()), int(anchors.max()))
        want = [[sum(int(x) * int(y) for x, y in zip(a, r)) for r in rows] for a in anchors]
        assert packed.scores(anchors).tolist() == want
    assert hard_negatives.Packed(rng.integers(-256, 257, (10, 64)), -256, 256).fields == 2
