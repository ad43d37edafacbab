"""The corpus pipeline: every stage's decisions against brute force on its own input, and awkward tables."""

import random
import sys
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from lectern.llm import mixture, qda, simhash
from lectern.llm._common import stage

STAGES = dict(corpus_pipeline.STAGES)
AWKWARD = [
    (1, "One two three. Four five six! Seven eight nine? Ten eleven twelve.", "en", "a", 66),
    (2, "one Two three. Four five six! Seven eight nine? Ten eleven twelve.", "en", "a", 66),
    (2, "one Two three. Four five six! Seven eight nine? Ten eleven twelve.", "en", "a", 66),
    (3, None, None, None, None),
    (4, "", "", "", 0),
    (None, "no id here", "en", "b", 10),
    (None, "no id here", "en", "b", 10),
    (None, None, None, None, None),
    (6, "long word " * 30_000, "en", "c", 300_000),
    (7, "other text with the same id", "en", "a", 27),
    (7, "and one more text with the same id", "en", "a", 27),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, h string, key int, __raw string, mix_size int"


@pytest.fixture(scope="module")
def kept(spark, sf):
    """Each stage's input and output on the documents."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = stage(function(spark, docs, sf), name)
        assert after.columns == docs.columns
        out[name], docs = (docs.collect(), after.collect()), after
    out["packing"] = (docs.collect(), STAGES["packing"](spark, docs, sf).collect())
    return out


def test_quality(kept, spark, sf):
    before, after = kept["quality"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    train = [(labels[r.doc_id], qda.measure((r.text or "").encode())) for r in before if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    y, x = np.array([t[0] for t in train]), np.array([t[1] for t in train])
    n = np.array([(y == c).mean() for c in (0, 1)])
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pool = n[0] * covs[0] + n[1] * covs[1]
    logs = []
    rows = np.array([qda.measure((r.text or "").encode()) for r in before])
    for c in (0, 1):
        s = 0.98 * (0.9 * covs[c] + 0.1 * pool) + 0.02 * np.trace(pool) / len(pool) * np.eye(len(pool))
        z = rows - x[y == c].mean(0)
        logs.append(np.log(n[c]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    sure = {r.doc_id: g >= 0.7 for r, g in zip(before, good, strict=True) if abs(g - 0.7) > 1e-6}
    ids = {r.doc_id for r in after}
    assert all((d in ids) == g for d, g in sure.items())
    assert len(ids) < docs.count()


def test_exact(kept):
    before, after = kept["exact"]
    low = lambda r: (r.text or "").encode().lower()
    want = {}
    for r in before:
        want[low(r)] = max(want.get(low(r), -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(want.values())


def test_near(kept):
    before, after = kept["near"]
    sets = {r.doc_id: set(simhash.shingles((r.text or "").encode(), 5)) for r in before}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if simhash.similar(sets[a], sets[b]) >= 0.8]
    at = {d: d for d in sets}
    find = lambda i: i if at[i] == i else find(at[i])
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    kept_ids, want = {r.doc_id for r in after}, {find(d) for d in sets}
    assert want <= kept_ids  # nothing goes that is not linked to a smaller id
    gone = set(sets) - want
    assert gone and len(kept_ids & gone) <= 0.1 * len(gone)


def test_mixing(kept, spark, sf):
    before, after = kept["mixing"]
    words = lambda rows, s: sum(len((r.text or "").encode().split()) for r in rows if r.source == s)
    sources = sorted({r.source for r in before})
    sizes, weights, target, free = {s: words(before, s) for s in sources}, {s: i % 3 + 1 for i, s in enumerate(sources)}, {}, set(sources)
    while free:
        left = sum(sizes.values()) - sum(target.get(s, 0) for s in set(sources) - free)
        share = {s: left * weights[s] / sum(weights[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in over} or share
        free = free - over if over else set()
    for s in sources:
        assert abs(words(after, s) - target[s]) <= 1
    times = {}
    for r in after:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3


def test_packing(kept, spark, sf):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    before, after = kept["packing"]
    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = {}
    for r in before:
        want[r.doc_id] = want.get(r.doc_id, 0) + len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_run_is_the_stages(kept, spark, sf):
    assert corpus_pipeline.run(spark, sf).count() == len(kept["packing"][1])


def test_awkward_tables(spark, sf):
    docs = spark.createDataFrame([(*r, 7, "h", 8, "r", 9) for r in AWKWARD], SCHEMA)
    for name, function in corpus_pipeline.STAGES[1:-1]:
        out = function(spark, docs, sf)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and {(r.row, r.h, r.key, r["__raw"], r.mix_size) for r in got} == {(7, "h", 8, "r", 9)}
        texts = [(r.text or "").lower() for r in got]
        if name == "exact":
            assert len(texts) == len(set(texts)) == len({(t or "").lower() for _, t, *_ in AWKWARD})
        if name == "near":
            assert len([t for t in texts if t.startswith("one")]) == 1
            assert sum("no id" in t for t in texts) == 1
    assert STAGES["quality"](spark, docs, sf).columns == docs.columns
    assert sum(r.start == 0 for r in STAGES["packing"](spark, docs, sf).collect()) == len(AWKWARD)


def test_empty_tables(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, sf).count() == 0


def test_rows_of_one_key(spark):
    rng = random.Random(1)
    data = [(None, "the same words in every row of this table")] * 300 + [(i, " ".join(rng.choices("abcdefgh", k=30))) for i in range(30)]
    df = spark.createDataFrame([(*r, None, "a", 1) for r in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert STAGES["exact"](spark, df, None).count() == STAGES["near"](spark, df, None).count() == 31
    assert sum(r.mix_taken for r in mixture.mix(df).collect()) == 300 * 9 + 30 * 30
