"""The back-off model against a direct one over dictionaries, which shares no code with it."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import katz

TOP = 5  # largest count that is discounted


def good_turing(counts):
    """d[r] for r = 1..TOP: Katz's discounts; one half off each count where they are not all between 0 and 1."""
    n = Counter(counts)
    plain = {r: (r - 0.5) / r for r in range(1, TOP + 1)}
    if not all(n[r] for r in range(1, TOP + 2)):
        return plain
    tail = (TOP + 1) * n[TOP + 1] / n[1]
    if tail >= 1:
        return plain
    d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) for r in range(1, TOP + 1)}
    return d if all(0 < x < 1 for x in d.values()) else plain


def brute(data, order=3, hot=None):
    hot = max(1000, katz.TABLE_TOKENS // 10) if hot is None else hot
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    grams = lambda w, n: [tuple((["start"] * (n - 1) + w)[i : i + n]) for i in range(len(w))]
    counts = {n: Counter() for n in range(1, order + 1)}
    for d, t in data:
        if not held(d):
            for n in counts:
                counts[n].update(grams(tokens(t), n))
    total = sum(counts[1].values())
    ds = {n: good_turing(c.values()) for n, c in counts.items()}
    cut = lambda n, c: ds[n][c] * c if c <= TOP else c
    freed = sum(c - cut(1, c) for c in counts[1].values())

    def p1(w):
        if not total:
            return 1.0
        c = counts[1][(w,)]
        if freed:
            return cut(1, c) / total if c else freed / total
        return c / (total + 0.5) if c else 0.5 / (total + 0.5)

    after = {n: defaultdict(dict) for n in range(2, order + 1)}
    for n in after:
        for g, c in counts[n].items():
            after[n][g[:-1]][g[-1]] = c
    weights = {}

    def p(g):
        n = len(g)
        if n == 1:
            return p1(g[0])
        seen = after[n].get(g[:-1])
        if not seen:
            return p(g[1:])
        hc = sum(seen.values())
        extra = hc > hot or all(c > TOP for c in seen.values())
        if g[-1] in seen:
            return cut(n, seen[g[-1]]) / (hc + extra)
        if g[:-1] not in weights:
            lower = sum(p((*g[1:-1], w)) for w in seen)
            weights[g[:-1]] = (1 - sum(cut(n, c) for c in seen.values()) / (hc + extra)) / (1 - lower)
            kept = sum(cut(n, c) for c in seen.values()) / (hc + extra)
            assert abs(kept + weights[g[:-1]] * (1 - lower) - 1) < 1e-9
        return weights[g[:-1]] * p(g[1:])

    assert not total or abs(sum(p1(w) for (w,) in counts[1]) + p1("never seen") - 1) < 1e-9
    out = []
    for d, t in data:
        w = tokens(t)
        score = sum(math.log10(p(g)) for g in grams(w, order))
        base = sum(math.log10((counts[1][(x,)] + 0.5) / (total + 0.5 * (len(counts[1]) + 1))) for x in w)
        out.append((str(d), held(d), len(w), sum(counts[1][(x,)] > 0 for x in w), total, round(base, 6), round(score, 6)))
    return sorted(out)


def found(df, order=3):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in katz.score_documents(df, order).collect())


def same(a, b):
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert np.allclose([x[5:] for x in a], [x[5:] for x in b], rtol=1e-9, atol=2e-6)


def test_frozen_arrays_come_back():
    arrays = [np.array([], np.int64), np.array([0, 255, 3]), np.array([70000, 1]), np.array([2**63 + 5], np.uint64)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, katz.thaw(katz.freeze(*arrays)), strict=True))


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("small", [False, True])
def test_documents(spark, sf, monkeypatch, small, order):
    if small:  # many batches, tables and hot histories
        monkeypatch.setattr(katz, "BATCH_BYTES", 40_000)
        monkeypatch.setattr(katz, "TABLE_TOKENS", 12_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same(found(docs.repartition(3), order), brute([(r.doc_id, r.text) for r in docs.collect()], order))


def test_small_vocabulary_and_awkward_rows(spark):
    rng = random.Random(4)
    words = ["a", "B", "c", "d", "é", "rare"]
    data = [(i, " ".join(rng.choices(words, [400, 200, 100, 50, 20, 1], k=rng.randint(0, 30)))) for i in range(400)]
    data += [(None, "a b"), (None, None), (7, " a  B\tc "), (7, "a  B\tc"), (9000, "never seen words"), (9001, "x " * 5000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in data], "doc_id long, text string, batch int, kind string")
    same(found(df), brute(data))
    assert katz.score_documents(df.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = katz.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in only] == [(True, 3, 0, 0, 0.0, 0.0)]


def test_better_than_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in katz.score_documents(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_histories_of_a_table_or_more_are_spread(spark, monkeypatch):
    monkeypatch.setattr(katz, "TABLE_TOKENS", 12_000)
    monkeypatch.setattr(katz, "BATCH_BYTES", 60_000)
    rng = random.Random(6)
    data = [(i, " ".join(f"{rng.choice('abc')} w{rng.randrange(300)}" for _ in range(180))) for i in range(400)]
    got = found(spark.createDataFrame(data, "doc_id long, text string"))
    assert katz.TABLE_TOKENS // 10 < got[0][4] / 6  # each of three histories
    same(got, brute(data))
