"""Hard negatives: packed products against plain ones, the search against brute force, odd rows."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import hard_negatives as hn, queries
from compare import connect, difference

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score double"


def brute(rows, positives=5, negatives=3):
    """Plain integer arithmetic over all pairs of rows (vec_id, vector, label)."""
    used = [(i, [int(np.floor(256 * x)) for x in v], c) for i, v, c in rows
            if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asks = {}
    for i, v, c in sorted(used, key=lambda r: (str(r[2]), len(r[1]), r[1])):
        if i % 50 == 0:
            asks.setdefault(i, (v, c))
    out = []
    for a, (v, c) in asks.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, d) for j, w, d in used
                        if j != a and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == c][:positives]:
            band = [s for s in scored if s[2] != c and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(a, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(band, 1)]
    return Counter(out)


def mined(spark, rows, **kw):
    frame = spark.createDataFrame([(i, v, c, 1, 2.0) for i, v, c in rows], SCHEMA)
    return Counter(map(tuple, hn.mine(frame, F.col("vec_id") % 50 == 0, **kw).collect()))


def random_rows(n=400, width=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width)) * 0.2 + 0.3
    return [(int(i), (centres[i % 4] + rng.normal(size=width) * 0.2).tolist(), int(i % 4)) for i in range(n)]


@pytest.mark.parametrize("top", [1, 300, 10**5, 10**9, 10**30])
def test_packed_products_are_exact(top):
    """Fields of every width, from several to a machine word to integers of any size."""
    rng = np.random.default_rng(1)
    rows, asks = (np.floor(rng.uniform(-top, top, (n, 7))) for n in (21, 5))
    block = hn.PackedBlock(rows, asks.max(), asks.min())
    want = [[sum(int(x) * int(y) for x, y in zip(a, r, strict=True)) for r in rows] for a in asks]
    clipped = [[min(max(x, -(1 << 63)), (1 << 63) - 1) for x in row] for row in want]
    assert block.products(asks).tolist() == clipped
    assert block.wide == (top >= 10**9) and (block.wide or block.fields * block.bits <= 53)


def test_fields_do_not_carry_at_their_limits():
    rows = np.array([[300.0] * 64, [-300.0] * 64, [0.0] * 64, [300.0] * 64])
    for a in (300.0, -300.0):
        assert hn.PackedBlock(rows, a, a).products(np.full((1, 64), a)).tolist() == [[a * 300 * 64, -a * 300 * 64, 0, a * 300 * 64]]
    one_sided = hn.PackedBlock(np.abs(rows), -5.0, -9.0).products(np.full((1, 64), -7.0))
    assert one_sided.tolist() == [[-7 * 300 * 64, -7 * 300 * 64, 0, -7 * 300 * 64]]


def test_search_against_brute_force(spark, monkeypatch):
    rows = random_rows()
    want = brute(rows)
    assert want and mined(spark, rows) == want
    monkeypatch.setattr(hn, "COMPONENTS_AT_ONCE", 24)  # many small blocks of both sides
    small = [r for r in rows if r[0] < 160]
    assert mined(spark, small) == brute(small)


def test_odd_rows(spark):
    rows = random_rows(150, 6)
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 1), (250, [0.3] * 6, None), (300, [0.1, nan, 0.1, 0.1, 0.1, 0.1], 1), (350, [inf] + [0.1] * 5, 1),
             (400, [None] + [0.2] * 5, 2), (None, [0.2] * 6, 2), (450, [], 2), (451, [], 2), (452, [], 3), (500, [0.4, 0.4], 1),
             (501, [0.4, 0.4], 1), (502, [0.3, 0.3], 2), (550, [0.0] * 6, 0), (601, [1e300] * 6, 1), (602, [1e308] * 6, 2)]
    rows += [(700 + i, [0.5, 0.2, 0.4, 0.1, 0.3, 0.6], i % 2) for i in range(60)]  # equal vectors: ties go to the smaller id
    rows += [(50, rows[50][1], rows[50][2]), (51, rows[51][1], 3), (700, [0.1] * 6, 1)]  # repeated ids
    assert mined(spark, [r for r in rows if r[0] not in (601, 602)]) == brute([r for r in rows if r[0] not in (601, 602)])
    beyond = mined(spark, rows)  # products of more than 64 bits: they end at the largest integer, and so do their bands
    assert beyond and all(-(1 << 63) <= x < 1 << 63 for r in beyond for x in r[4:])


def test_empty_tables(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(1, [0.5], 1), (2, [0.5], 2)])
    assert not mined(spark, [(50, [0.5], 1)])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_query_matches_sql(spark):
    name = "op13_hard_negatives"
    assert difference(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name]) == ""
