"""Hard negatives against brute force in Python's integers."""

from __future__ import annotations

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustframe.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row string, block string, q string"


def brute(rows, k=5, least=Fraction(4, 5)):
    kept = {(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab, *_ in rows
            if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)}
    kept = sorted(kept)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for a in kept:
        if a[0] % 100:
            continue
        scored = sorted((-dot(a[2], b[2]), b[0], b[1] == a[1]) for b in kept if b is not a)
        for s, p, alike in [x for x in scored if x[2]][:k]:
            window = [(n, t) for t, n, same in scored if not same and least * -s <= -t <= -s][:k]
            out.update((a[0], p, r + 1, n, -s, -t) for r, (n, t) in enumerate(window))
    return out


def rows_of(seed, n, dims):
    rng = random.Random(seed)
    base = [[rng.gauss(0.3, 0.2) for _ in range(dims)] for _ in range(3)]
    out = [(i * 20, [x + rng.gauss(0, 0.1) for x in rng.choice(base)], rng.randrange(3), "a", None, "c") for i in range(n)]
    out += [(i * 20 + 1, out[0][1], 1, None, "b", "c") for i in range(n // 3)]  # one vector: a third of the rows
    out += [out[3], out[3], (None, out[1][1], 1, "", "", ""), (7, None, 1, "", "", ""), (9, out[1][1], None, "", "", ""),
            (11, [None] * dims, 1, "", "", ""), (13, [float("nan")] * dims, 2, "", "", ""), (15, [float("inf")] + [0.0] * (dims - 1), 2, "", "", ""),
            (300, out[2][1], 2, "", "", ""), (300, out[2][1][:2], 1, "", "", ""), (301, [], 0, "", "", ""), (-100, out[5][1], 0, "", "", "")]
    return out


@pytest.mark.parametrize("anchors,group", [(1 << 15, 1 << 18), (2, 9)])
def test_brute_force(spark, monkeypatch, anchors, group):
    monkeypatch.setattr(H, "ANCHORS", anchors)
    monkeypatch.setattr(H, "ROWS", group)
    rows = rows_of(1, 60, 6)
    got = H.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert sum(want.values()) > 40 and Counter(map(tuple, got.collect())) == want


def test_no_rows_and_no_partner(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.mine(empty, F.col("id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1, "", "", ""), (1, [1.0], 2, "", "", "")], SCHEMA)
    assert H.mine(alone, F.col("id") % 100 == 0).count() == 0


def test_scores_out_of_range(spark):
    with pytest.raises(ValueError, match="exact range"):
        H.mine(spark.createDataFrame([(100, [1e9], 1, "", "", "")], SCHEMA), F.col("id") % 100 == 0)


@pytest.mark.parametrize("dims,size", [(1, 10**7), (64, 300), (64, 10**6), (5000, 50000)])
def test_residue_product_is_exact(dims, size):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-size, size, (7, dims)), rng.integers(-size, size, (9, dims))
    bound = int(max((a.astype(object) ** 2).sum(axis=1).max(), (b.astype(object) ** 2).sum(axis=1).max()))
    primes = H.primes_for(dims, bound)
    assert math.prod(primes) > 2 * bound and min(dims, H.DEPTH) * (max(primes) // 2) ** 2 <= H.EXACT
    assert (H.product(H.planes(a, primes), H.planes(b, primes), primes) == a.astype(object) @ b.astype(object).T).all()
