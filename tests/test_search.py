"""Stored indexes, the threshold search over lists, quotes by keys, and approximate vectors, against plain forms."""

import random
import re
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.udfs import best_window
from lectern.operators import index, reader, search
from lectern.operators.index import GramIndex, TextIndex
from lectern.operators.vectors import VectorIndex

WORDS = ["ab", "a", "the", "xyz", "café", "no", "rare1", "q", "и", "then"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i * 3, None if i % 17 == 0 else " ".join(rng.choices(WORDS, weights=[3, 5, 40, 1, 2, 9, 0.2, 1, 2, 4], k=rng.randint(0, 30)))) for i in range(n)]


def bm25(docs, query):
    words = {d: re.findall(r"\w+", (t or "").lower()) for d, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    out = Counter()
    for term in set(re.findall(r"\w+", query.lower())):
        tf = {d: w.count(term) for d, w in words.items() if term in w}
        idf = log(1 + (len(words) - len(tf) + 0.5) / (len(tf) + 0.5))
        for d, n in tf.items():
            out[d] += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words[d]) / mean))
    return {d: round(s, 6) for d, s in out.items()}


@pytest.fixture(scope="module")
def docs():
    return corpus(900)


def frame(spark, rows):
    return spark.createDataFrame(rows, "document_id long, text string")


def test_terms_in_segments_answer_as_one_scan(spark, tmp_path, docs):
    at = TextIndex(spark, f"file://{tmp_path}/t")
    for part in (docs[:500], docs[500:880], docs[880:]):
        at.append(frame(spark, part))
    asked = {1: "rare1 the ab", 2: "the", 3: "none here", 4: "", 5: "café и xyz q"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    reopened = TextIndex(spark, f"file://{tmp_path}/t")
    assert reopened.segments == 3
    for k in (5, 40):
        got = reopened.search(queries, k).collect()
        for q, text in asked.items():
            want = bm25(docs, text)
            own = [r for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
            assert [r.score for r in own] == pytest.approx(sorted(want.values(), reverse=True)[:k], abs=2e-6)
            assert {r.document_id: r.score for r in own} == pytest.approx({r.document_id: want[r.document_id] for r in own}, abs=2e-6)
    pairs = [(1, d) for d, _ in docs[::7]]
    got = {r.document_id: r.score for r in reopened.scores(queries, spark.createDataFrame(pairs, "query_id long, document_id long")).collect()}
    want = bm25(docs, asked[1])
    assert got == pytest.approx({d: want[d] for _, d in pairs if d in want}, abs=2e-6)
    df = {r.term: r.df for r in reopened.term_stats().collect()}
    assert df["the"] == sum("the" in (t or "").split() for _, t in docs)


def test_bounds_leave_chunks_unread(spark, tmp_path):
    rows = [(i, "common word") for i in range(3000)] + [(5000 + i, "common rare " * (1 + i)) for i in range(20)]
    at = TextIndex(spark, f"file://{tmp_path}/t").append(frame(spark, rows).coalesce(1))
    queries = spark.createDataFrame([(1, "common rare")], "query_id long, text string")
    assert at.chunks(queries, 1.2, 0.75).count() > 40
    scored, asked = at.scored, []
    at.scored = lambda rows, *a: asked.append(rows.count()) or scored(rows, *a)
    got = [r.document_id for r in at.search(queries, 10).orderBy("rank").collect()]
    assert len(got) == 10 and min(got) >= 5000 and sum(asked) < 12
    at.scored = scored
    plan = at.search(queries, 10)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_an_append_that_stopped_is_written_over(spark, tmp_path, docs):
    path = f"file://{tmp_path}/t"
    TextIndex(spark, path).append(frame(spark, docs[:100]))
    broken = TextIndex(spark, path)
    broken.write = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        broken.append(frame(spark, docs[100:200]))
    at = TextIndex(spark, path).append(frame(spark, docs[100:150]))
    assert at.segments == 2 and {r.term: r.df for r in at.term_stats().collect()}["the"] == sum("the" in (t or "").split() for _, t in docs[:150])


def test_quotes_of_any_length_inside_words(spark, tmp_path, docs, monkeypatch):
    at = GramIndex(spark, f"file://{tmp_path}/g")
    for part in (docs[:400], docs[400:]):
        at.append(frame(spark, part))
    quotes = {1: "e", 2: "th", 3: "fé и", 4: "he the the", 5: "zzz", 6: "", 7: "a", 8: next(t for _, t in docs if t and len(t) > 60)[7:55], 9: None}
    asked = spark.createDataFrame(list(quotes.items()), "query_id long, quote string")
    want = sorted((q, d, t.find(s) + 1) for q, s in quotes.items() if s for d, t in docs if t and s in t)
    for limit in (2000, 0):  # keys as constants, keys joined
        monkeypatch.setattr(index, "MAX_KEYS", limit)
        found = at.find(asked, frame(spark, docs))
        assert sorted(map(tuple, found.collect())) == want
        plan = found._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert GramIndex(spark, f"file://{tmp_path}/empty").append(frame(spark, [])).find(asked, frame(spark, [])).count() == 0


def test_quotes_of_a_document_by_keys(spark):
    rng = random.Random(3)
    texts = {(d, b): "".join(rng.choices("abcdé ", k=rng.randint(0, 120))) for d in range(8) for b in range(30)}
    blocks = spark.createDataFrame([(d, b // 5, b, t) for (d, b), t in texts.items()], "document_id long, page_index int, block_index int, text string")
    asked = []
    for d, b in rng.sample(sorted(texts), 120):
        t = texts[d, b]
        n = rng.choice([1, 2, 3, 12, 20, 21, 22, 40, 80])
        at = rng.randint(0, max(0, len(t) - n))
        asked.append((f"{d}-{b}", d, t[at : at + n]))
    got = reader.places_of_quotes(spark.createDataFrame([*asked, ("x", 1, None)], "anchor_id string, document_id long, quote string"), blocks)
    want = sorted((a, d, b) for a, d, q in asked if q for (e, b), t in texts.items() if e == d and q in t)
    assert sorted((r.anchor_id, r.document_id, r.block_index) for r in got.collect()) == want
    long = reader.places_of_quotes(spark.createDataFrame([a for a in asked if len(a[2]) >= 21], "anchor_id string, document_id long, quote string"), blocks)
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "key#" in plan and sorted((r.anchor_id, r.block_index) for r in long.collect()) == sorted((a, b) for a, d, q in asked if len(q) >= 21 for (e, b), t in texts.items() if e == d and q in t)


def nearest_by_table(text, quote):
    """Distances of all windows, by whole tables from each start."""
    best = {}
    for start in range(len(text)):
        col = list(range(len(quote) + 1))
        low = col[-1]
        for c in text[start:]:
            new = [col[0] + 1]
            for i, k in enumerate(quote):
                new.append(min(col[i] + (k != c), col[i + 1] + 1, new[i] + 1))
            col = new
            low = min(low, col[-1])
        best[start] = low
    d = min(best.values())
    starts = [s for s, x in best.items() if x == d]
    return d, starts[0] + 1, starts[-1] - starts[0] < len(quote)


def test_pieces_lose_no_window():
    rng = random.Random(9)
    for _ in range(400):
        text, quote = "".join(rng.choices("abc ", k=rng.randint(1, 40))), "".join(rng.choices("abc ", k=rng.randint(1, 12)))
        least = rng.choice([0.0, 0.5, 0.7, 0.8, 0.9, 1.0])
        d, pos, alone = nearest_by_table(text, quote)
        similarity = 1 - d / len(quote)
        want = {"pos": pos, "similarity": similarity, "is_unique": alone} if similarity >= least else {"pos": None, "similarity": None, "is_unique": False}
        assert best_window(text, quote, least) == want, (text, quote, least)
    long = "".join(rng.choices("abcdefgh ", k=300))
    assert best_window(long, long[100:170], 0.8)["pos"] == 101


@pytest.mark.parametrize("depth", [1, 3, 1000])
def test_threshold_search_equals_the_whole_table(spark, depth):
    rng = random.Random(depth)
    n, queries = 60, [1, 2, 3]
    text = {(q, d): rng.choice([1.0, 2.0, 3.5]) for q in queries for d in range(n) if rng.random() < 0.5}
    vector = {(q, d): round(rng.uniform(-1, -0.1 if q == 3 else 1), 3) for q in queries for d in range(5, n)}
    quote = {(q, d): 1.0 for q in queries for d in range(n) if rng.random() < 0.05}
    flags = {(q, d): (float(rng.random() < 0.3), float(rng.random() < 0.5)) for q in queries for d in range(n)}
    weights = {"text": 0.5, "quote": 0.3, "vector": 0.4, "listed": 0.1, "other": 0.1}
    rows = lambda part: spark.createDataFrame([(*k, s) for k, s in part.items()], "query_id long, document_id long, score double")
    listed = {k: 1.0 for k, v in flags.items() if v[0]}

    def lister(part):
        def first(left, depth):
            return search.top_k(rows(part).join(left, "query_id", "left_semi"), depth)

        return first

    known = lambda part: lambda pairs: rows(part).join(pairs, ["query_id", "document_id"], "left_semi")
    asked = []

    def context(pairs):
        asked.append(pairs.count())
        all_flags = spark.createDataFrame([(*k, *v) for k, v in flags.items()], "query_id long, document_id long, listed double, other double")
        return pairs.join(all_flags, ["query_id", "document_id"])

    parts = {"text": text, "quote": quote, "vector": vector}
    got = search.hybrid_search(spark.createDataFrame([(q,) for q in queries], "query_id long"), {**{n: lister(p) for n, p in parts.items()}, "listed": lister(listed)}, {n: known(p) for n, p in parts.items()}, context, weights, k=4, depth=depth)
    most = {(name, q): max((s for (p, _), s in part.items() if p == q), default=0) for name, part in parts.items() for q in queries}
    want = []
    for q in queries:
        scored = []
        for d in range(n):
            if any((q, d) in p for p in parts.values()):
                values = [text.get((q, d), 0) / most["text", q], quote.get((q, d), 0.0), vector.get((q, d), 0) / most["vector", q], *flags[q, d]]
                scored.append((-round(sum(v * w for v, w in zip(values, weights.values(), strict=True)), 6), d))
        want += [(q, d, -s, r + 1) for r, (s, d) in enumerate(sorted(scored)[:4])]
    assert [(r.query_id, r.document_id, r["rank"]) for r in got.orderBy("query_id", "rank").collect()] == [(q, d, r) for q, d, _, r in want]
    assert depth < 1000 or len(asked) == 1


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 5.0]), (3, [0.0, 1.0]), (4, None), (5, [])]
    e = spark.createDataFrame(rows, "document_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 0.0, 5.0])], "query_id long, embedding array<double>")
    assert [(r.query_id, r.document_id, r.score) for r in search.vector_search(e, q, 5).orderBy("rank").collect()] == [(7, 1, 1.0), (7, 3, 0.0)]


@pytest.mark.parametrize("n", [500, 4000])
def test_lists_find_nine_in_ten_and_measure_few(spark, tmp_path, n):
    x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [1.0])], "document_id long, embedding array<float>")
    q = e.where("document_id % 50 = 0").withColumnRenamed("document_id", "query_id")
    at = VectorIndex(spark, f"file://{tmp_path}/v", e).append(e.where("document_id % 2 = 0")).append(e.where("document_id % 2 = 1"))
    rerank = max(20, n // 40)
    assert at.candidates(q, rerank, 0.65).count() <= 0.1 * q.count() * n
    pairs = lambda df: {(r.query_id, r.document_id) for r in df.collect()}
    exact = pairs(search.vector_search(e, q, 10))
    assert len(exact & pairs(at.search(q, e, rerank=rerank))) >= 0.9 * len(exact)
    empty = e.limit(0)
    assert VectorIndex(spark, f"file://{tmp_path}/none", empty).append(empty).search(q, e).count() == 0


def test_gram_stats_read_back(spark, tmp_path):
    at = GramIndex(spark, f"file://{tmp_path}/g").append(frame(spark, [(1, "añ😀b"), (2, "añ")]))
    assert {r.gram: r.df for r in at.gram_stats(2).collect()} == {"añ": 2, "ñ😀": 1, "😀b": 1}
    assert {r.gram for r in at.gram_stats(3).collect()} == {"añ😀", "ñ😀b"} and at.gram_stats(1).where(F.col("df") == 2).count() == 2


def test_an_index_is_made_in_one_pass(spark, tmp_path):
    """A chunk is counted in the task that numbers it: nothing but the index's own tables is put aside, also where texts are empty, null or repeat an id."""
    docs = spark.createDataFrame([(i % 150, None if i % 7 == 0 else "" if i % 11 == 0 else f"a b b w{i % 30}") for i in range(200)], "document_id long, text string").repartition(3)
    for kind in (TextIndex, GramIndex):
        index = kind(spark, f"{tmp_path}/{kind.__name__}")
        index.put_aside = None
        index.append(docs).append(docs.limit(0)).append(docs.limit(5))
        assert index.read("docs").count() == 205 and index.read("docs").select("doc_no").distinct().count() == 205
    terms = TextIndex(spark, f"{tmp_path}/TextIndex").term_stats().where("term in ('a', 'b')").collect()
    five = sum(bool(r.text) for r in docs.limit(5).collect())
    full = docs.where("text <> ''").count()
    assert {(r.term, r.df, r.max_tf) for r in terms} == {("a", full + five, 1), ("b", full + five, 2)}
