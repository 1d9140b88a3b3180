"""Hard-negative mining against brute force in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor):
    use = []
    for at, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((at, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for at, i, v, label in use:
        if i is None or not anchor(i):
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, other == label) for k, j, w, other in use if k != at]
        for p, pid, _ in sorted((s for s in score if s[2]), key=order)[:5]:
            fits = [s for s in score if not s[2] and 50 * p <= 100 * s[0] <= 95 * p]
            for rank, (n, nid, _) in enumerate(sorted(fits, key=order)[:3], 1):
                out.append((i, pid, rank, nid, p, n))
    return sorted(out, key=str)


def vectors(n, seed, d=12):
    """Groups of near vectors, many copies of one, loners; labels cut through the groups."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        c, noise = rng.choice(centres), rng.choice([0.05, 0.3, 2.0])
        rows.append((i, [x + rng.gauss(0, noise) for x in c], rng.choice([0, 1, 1, 1, 2, 7])))
    copy = rows[3][1]
    rows += [(n + i, copy, i % 3) for i in range(n // 3)]
    return rows


@pytest.mark.parametrize("shard, block", [(4096, 51200), (37, 90)])
def test_mined(spark, monkeypatch, shard, block):
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", block)
    rows = vectors(300, 4)
    rows += [(1000, None, 1), (1001, [1.0] * 12, None), (1002, [float("nan")] + [1.0] * 11, 1), (1003, [None] * 12, 1), (1004, [float("inf")] * 12, 2)]
    rows += [(None, rows[5][1], 1), (None, rows[6][1], 2), (1005, [0.5] * 3, 1), (1010, [], 1), (1011, [0.4] * 20, 7), rows[10], rows[20]]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "id", "block", "shard", "kind", "score", "n", "given", "lot", "way", "side")})
    got = hard_negatives.mine(df, lambda i: i % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, lambda i: i % 10 == 0)


def test_large_numbers_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1, 1]) * 2.0 ** rng.randint(14, 20) for _ in range(5)], i % 2) for i in range(60)]
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), lambda i: i % 6 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, lambda i: i % 6 == 0)


def test_nothing_to_mine(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(none, lambda i: i % 2 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0], 3)], SCHEMA)
    assert hard_negatives.mine(one, lambda i: i % 50 == 0).count() == 0
    assert hard_negatives.mine(one, lambda i: i == 7).count() == 0


def test_tree_covers_and_skips():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 500
    points = np.rint(np.repeat(centres, 100, 0) + rng.normal(size=(2000, 8)) * 5).astype(np.int64)
    points[7:400] = points[7]
    tree = hard_negatives.CoverTree(points)
    assert sorted(tree.order) == list(range(2000))
    x = points[tree.order].astype(float)
    full = np.column_stack([x, np.sqrt(tree.most - (x**2).sum(1))])
    for a, b, c, r, child, n in zip(tree.start, tree.end, tree.centre, tree.radius, tree.child, tree.children):
        away = np.sqrt(((full[a:b] - full[c]) ** 2).sum(1))
        assert away.max() <= r + 1e-6 and a <= c < b
        if n:  # children share out their node's run
            assert tree.start[child] == a and tree.end[child + n - 1] == b
            assert (tree.start[child + 1 : child + n] == tree.end[child : child + n - 1]).all()
    # a search touches a part of the candidates only
    import pyarrow as pa

    table = pa.table({"shard": [0] * 2000, "row": range(2000), "id": range(2000), "label": [1] * 2000, "vector": points.tolist()})
    planted = hard_negatives._plant(table).to_pylist()[0]
    look, seen = hard_negatives.Search(planted), []
    exact = look.scores
    look.scores = lambda v, q, at: (seen.append(len(at)), exact(v, q, at))[1]
    query = points[1500]
    scores = points @ query
    high = int(np.sort(scores)[-150])
    found = look(query, -1, 5, False, np.array([high - 10**7]), np.array([high]), 3, [(np.empty(0, np.int64),) * 3])
    fits = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s <= high)[:3]
    assert [(-s, i) for s, i in zip(found[0][0].tolist(), found[0][1].tolist())] == fits
    assert sum(seen) < 1500
