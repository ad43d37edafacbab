import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import rtree

SCHEMA = "vec_id long, label int, embedding array<float>, g string, share int"


def clean(rows):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and all(c is not None and np.isfinite(c) for c in r[2])]
    sizes = [len(r[2]) for r in ok]
    most = min(set(sizes), key=lambda s: (-sizes.count(s), s)) if ok else 0
    best = {}
    for r in ok:
        if len(r[2]) == most:
            v = np.floor(256 * np.array(r[2], np.float32).astype(np.float64)).astype(np.int64).tolist()
            best[r[0]] = min(best.get(r[0], (r[1], v)), (r[1], v))
    return best


def brute(rows, every=10, low=80, high=100):
    best, out = clean(rows), []
    if not best:
        return out
    ids = np.array(sorted(best))
    labels, x = np.array([best[i][0] for i in ids]), np.array([best[i][1] for i in ids]).reshape(len(ids), -1)
    for a in range(len(ids)):
        if ids[a] % every:
            continue
        scores = x @ x[a]
        order = np.lexsort((ids, -scores))
        for p in [i for i in order if labels[i] == labels[a] and i != a][:5]:
            fit = [i for i in order if labels[i] != labels[a] and low * scores[p] <= 100 * scores[i] <= high * scores[p]][:5]
            out += [(int(ids[a]), int(ids[p]), r + 1, int(ids[i]), int(scores[p]), int(scores[i])) for r, i in enumerate(fit)]
    return sorted(out)


def vectors(n, kind, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    if kind == "clustered":
        x = rng.normal(size=(12, 8))[rng.integers(0, 12, n)] + 0.05 * x
    if kind == "positive":
        x = np.abs(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "hot":
        x[rng.random(n) < 0.4] = x[0]
    return [(i, int(rng.integers(0, 4)), x[i].tolist(), "own", 1) for i in range(n)]


def awkward():
    rows = vectors(300, "positive")
    odd = [(None, 1, rows[0][2]), (400, None, rows[0][2]), (410, 1, None), (420, 1, []), (430, 1, [None] * 8), (440, 1, [float("nan")] * 8), (450, 1, [float("inf")] * 8)]
    odd += [(460, 1, [1.0, 2.0]), (470, 1, [0.0] * 8), (480, 9, rows[1][2]), (10, 3, rows[5][2]), (10, 0, rows[5][2]), (10, 0, rows[5][2])]
    return rows + [(*r, None, None) for r in odd] + [(500 + i, 2, rows[7][2], "copy", 0) for i in range(40)]


def found(spark, rows, monkeypatch=None):
    got = rtree.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("rows", [vectors(600, "even"), vectors(600, "clustered"), vectors(600, "hot"), awkward(), vectors(3, "positive"), []], ids=["even", "clustered", "hot", "awkward", "few", "empty"])
def test_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(rtree, "SHARE", 16)
    assert found(spark, rows) == brute(rows)


def test_boxes_hold_their_rows_and_prune_clusters():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(30, 8)) * 200)[rng.integers(0, 30, 4096)] + rng.normal(size=(4096, 8)) * 4
    x = x.astype(np.int64)
    order = rtree.packed_order(x, np.arange(len(x)), [0, 1, 2], rtree.LEAF)
    assert sorted(order.tolist()) == list(range(4096))
    labels = np.zeros(4096, np.int64)
    starts = rtree.leaf_starts(labels)
    own = x[order]
    boxes = np.stack([np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)])
    block = rtree.Block(order.astype(np.int64), labels, own, boxes)
    reached = 0
    for q in own[::97].astype(np.float64):
        low, high = block.reach(q)
        for i, (a, b) in enumerate(zip(block.starts, block.ends, strict=True)):
            s = own[a:b] @ q
            assert low[i] <= s.min() and s.max() <= high[i]
        kth = np.sort(own @ q)[-6]
        reached += (high >= kth).mean()
    assert reached / len(own[::97]) < 0.5


def test_huge_components_are_held(spark):
    rows = [(10 * i, i % 2, [1e30 * (i + 1), -1e30, 0.5, float(i)], None, None) for i in range(6)]
    assert all(abs(r[4]) < 2**53 and abs(r[5]) < 2**53 for r in found(spark, rows))
