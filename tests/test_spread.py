"""Operators that must not depend on how many rows share a tag, a page, a day or a first word."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import graph, process, reader
from lectern.operators.sketches import PoolReaders
from lectern.streaming import jobs

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def one_day():
    """2000 readings, most of one tag and day, many at one instant."""
    rng = random.Random(5)
    return [("hot" if rng.random() < 0.9 else "cold", START + dt.timedelta(seconds=rng.randrange(600)), float(rng.randrange(5)), i) for i in range(2000)]


def readings_of(spark, rows):
    return spark.createDataFrame(rows, "tag string, ts timestamp_ntz, value double, event_id long")


def test_slices_cut_a_tags_day_evenly(spark, one_day):
    parts = process.sliced(readings_of(spark, one_day), ["tag", "ts", "event_id"], 100).groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct("tag", "ts", "event_id")).alias("low"), F.max(F.struct("tag", "ts", "event_id")).alias("high")).orderBy("part").collect()
    assert len(parts) == 20 and max(p.n for p in parts) <= 300 and sum(p.n for p in parts) == 2000
    assert all(a.high < b.low for a, b in zip(parts, parts[1:], strict=False))


@pytest.mark.parametrize("slice_rows", [37, 5000])
def test_series_do_not_depend_on_slices(spark, one_day, slice_rows):
    df = readings_of(spark, one_day)
    state = F.when(F.col("value") >= 4, "alarm").when(F.col("value") >= 2, "warn").otherwise("normal")
    got = process.alarm_transitions(df.withColumn("state", state), slice_rows).collect()
    want, last, since = [], {}, {}
    for tag, ts, value, i in sorted(one_day, key=lambda r: (r[0], r[1], r[3])):
        now = "alarm" if value >= 4 else "warn" if value >= 2 else "normal"
        if tag not in last or last[tag] != now:
            if tag in last:
                want.append((tag, ts, last[tag], now, (ts - since[tag]).total_seconds(), i))
            last[tag], since[tag] = now, ts
    assert sorted(map(tuple, got)) == sorted(want)
    by_tag = {t: sorted((r for r in one_day if r[0] == t), key=lambda r: (r[1], r[3])) for t in ("hot", "cold")}
    got = {(r.tag, r.i): r.y for r in process.sparkline_points(df, slice_rows).collect()}
    assert got == {(t, i): round(36 - r[2] / 4 * 30, 6) for t, rows in by_tag.items() for i, r in enumerate(rows)}


@pytest.mark.parametrize("slice_rows", [53, 5000])
def test_asof_over_slices(spark, one_day, slice_rows):
    few = [r for r in one_day if r[3] % 40 == 0] + [(None, START, 1.0, -1), ("hot", None, 1.0, -2)]
    events = [(i, t, ts) for t, ts, _, i in one_day] + [(-1, None, START), (-2, "hot", None), (-3, "none", START), (-4, "hot", START - dt.timedelta(1)), (-5, "hot", START + dt.timedelta(1))]
    got = {r.event_id: r.value for r in process.asof_align(spark.createDataFrame(events, "event_id long, tag string, ts timestamp_ntz"), readings_of(spark, few), slice_rows=slice_rows).collect()}

    def newest(tag, ts):
        at = [(r[1], r[2]) for r in few if tag and ts and r[0] == tag and r[1] and r[1] <= ts]
        return max(at)[1] if at else None

    assert got == {i: newest(t, ts) for i, t, ts in events}
    late = {r.event_id: r.value for r in process.asof_align(spark.createDataFrame(events, "event_id long, tag string, ts timestamp_ntz"), readings_of(spark, few), "5 minutes", slice_rows).collect()}
    assert late[-5] is None and got[-5] is not None


def test_empty_series(spark):
    none = readings_of(spark, [])
    assert process.sparkline_points(none).count() == 0 and process.alarm_transitions(none.withColumn("state", F.lit("x"))).count() == 0
    assert process.asof_align(none.select("event_id", "tag", "ts"), none).count() == 0


RECT = "x double, y double, width double, height double"


def hits_by_hand(anchors, blocks):
    want = {}
    for name, doc, page, rects in anchors:
        for bdoc, bpage, n, *b in blocks:
            for r in rects:
                if (doc, page) == (bdoc, bpage) and None not in (*r, *b) and r[2] > 0 and r[3] > 0 and b[2] > 0 and b[3] > 0:
                    w, h = (min(r[i] + r[i + 2], b[i] + b[i + 2]) - max(r[i], b[i]) for i in (0, 1))
                    if w > 0 and h > 0:
                        want[name, n] = want.get((name, n), 0) + w * h
    return {k: int(v) for k, v in want.items()}


def test_grid_reports_each_overlap_once(spark):
    rng = random.Random(3)
    side = lambda: float(rng.choice([0, 1, 2, 5, 40, 300]))
    rect = lambda: (float(rng.randrange(-50, 400)), float(rng.randrange(-50, 400)), side(), side())
    anchors = [(f"a{i}", i % 2, i % 3, [rect() for _ in range(i % 4)]) for i in range(80)] + [("n", 0, 0, [(None, 1.0, 2.0, 3.0)])]
    blocks = [(i % 2, i % 3, i, *rect()) for i in range(150)] + [(0, 0, 999, None, 1.0, 2.0, 3.0), (0, None, 998, 1.0, 1.0, 2.0, 3.0)]
    a = spark.createDataFrame(anchors, f"anchor_id string, document_id int, page_index int, rects array<struct<{RECT.replace(' double', ':double')}>>")
    b = spark.createDataFrame(blocks, f"document_id int, page_index int, block_index int, {RECT}")
    assert {(r.anchor_id, r.block_index): r.area for r in reader.rect_hits(a, b).collect()} == hits_by_hand(anchors, blocks)
    assert reader.rect_hits(a.where("false"), b).count() == 0 and reader.rect_hits(a, b.where("false")).count() == 0


def test_a_full_page_makes_few_comparisons(spark):
    n, m = 100_000, 1000
    lines = spark.range(n).select(F.lit(1).alias("document_id"), F.lit(0).alias("page_index"), F.struct(F.lit(0.0).alias("x"), F.col("id").cast("double").alias("y"), F.lit(500.0).alias("width"), F.lit(0.9).alias("height")).alias("r"))
    marks = spark.range(m).select(F.lit(1).alias("document_id"), F.lit(0).alias("page_index"), F.struct(F.lit(20.0).alias("x"), (F.col("id") * 100.0).alias("y"), F.lit(60.0).alias("width"), F.lit(2.0).alias("height")).alias("r"))
    steps = reader.grid_steps(lines, marks)
    cells = [reader.in_cells(df, steps).select("document_id", "page_index", "cell_x", "cell_y") for df in (lines, marks)]
    assert cells[0].count() + cells[1].count() <= 4 * (n + m)
    assert cells[0].join(cells[1], ["document_id", "page_index", "cell_x", "cell_y"]).count() <= 50 * m


def test_many_terms_by_trie(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    terms = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(2, 6))) for _ in range(100_000)} | {"w1", "w1 w2 w3 w4 w5 w6 w7"})
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(80)] + [" ".join([t for t in terms[:40]]), "w1 w2 w3 w4 w5 w6 w7", "w1 w2 w3 w4 w5 w6", "", "W1, w2!"]
    blocks = [(d // 3, d, t) for d, t in enumerate(texts)]
    got = reader.spot_terms(spark.createDataFrame(blocks, "document_id long, block_index int, text string"), spark.createDataFrame([(t,) for t in terms] + [(None,), ("w1",)], "term string"))
    known, want = set(terms), []
    for doc, n, text in blocks:
        w = [t.lower().strip(",!") for t in text.split(" ")]
        for i in range(len(w)):
            best = max((k for k in range(1, 8) if i + k <= len(w) and " ".join(w[i : i + k]) in known), default=0)
            if best:
                want.append((doc, n, i, " ".join(w[i : i + best]), best))
    assert len(want) > 40 and sorted(map(tuple, got.collect())) == sorted(want)


def test_sketches_unite_days(spark, tmp_path):
    rng = random.Random(2)
    seen = [(rng.randrange(20), rng.randrange(30_000), START + dt.timedelta(days=rng.randrange(6), seconds=i)) for i in range(60_000)]
    rows = spark.createDataFrame(seen + [(1, None, START), (1, 5, None)], "document_id long, user_id long, ts timestamp_ntz")
    members = spark.createDataFrame([(d % 3, d) for d in range(20)] * 2 + [(None, 1)], "pool_id long, document_id long")
    stored = PoolReaders(spark, str(tmp_path / "readers"))
    assert stored.summary().count() == 0
    day = lambda n: rows.where(F.to_date("ts") == (START + dt.timedelta(days=n)).date())
    for n in range(5):
        stored.add(members, day(n))
    stored.add(members, day(2))  # again
    exact = lambda last: {p: len({u for d, u, t in seen if d % 3 == p and t < START + dt.timedelta(days=last)}) for p in range(3)}
    got = {r.pool_id: r.n_readers_approx for r in stored.summary().collect()}
    assert all(abs(got[p] - n) <= 0.05 * n for p, n in exact(5).items()) and len(got) == 3
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "readers").rglob("*.parquet")}
    stored.add(members, day(5))
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "readers").rglob("*.parquet")}
    assert before.items() <= after.items() and len(after) > len(before)
    got = {r.pool_id: r for r in stored.summary().collect()}
    assert all(abs(got[p].n_readers_approx - n) <= 0.05 * n and got[p].last_activity == max(t for d, _, t in seen if d % 3 == p) for p, n in exact(6).items())
    part = {r.pool_id: r.n_readers_approx for r in stored.summary(until="2024-01-03").collect()}
    assert all(abs(part[p] - n) <= 0.05 * n for p, n in exact(2).items())


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_is_reduced_to_its_sources_before_nodes_meet_it(spark):
    nodes = spark.createDataFrame([("a", "k"), ("b", "k"), (None, "k")], "id string, kind string")
    evidence = spark.createDataFrame([("a", "x")] * 50 + [(None, "x")], "source string, target string")
    for f, ids in ((graph.nodes_with_evidence, ["a"]), (graph.nodes_without_evidence, [None, "b"])):
        out = f(nodes, evidence)
        assert sorted((r.id for r in out.collect()), key=str) == ids and "Aggregate" in plan_of(out)


def test_graph_diff_reads_each_snapshot_once(spark):
    old = spark.createDataFrame([("a", "uses", "b")] * 3 + [("a", "uses", "c"), ("d", None, "e")], "source string, kind string, target string")
    new = spark.createDataFrame([("a", "uses", "b")] + [("x", "uses", None)] * 2 + [("d", None, "e")] * 2, "source string, kind string, target string")
    out = graph.graph_diff(old, new)
    want = [("a", "uses", "b", "removed")] * 2 + [("a", "uses", "b", "kept"), ("a", "uses", "c", "removed"), ("d", None, "e", "added"), ("d", None, "e", "kept")] + [("x", "uses", None, "added")] * 2
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert plan_of(out).count("LogicalRDD") + plan_of(out).count("Scan") + plan_of(out).count("LocalRelation") == 2


def test_held_readings_are_one_small_value():
    rng = np.random.default_rng(1)
    us, ids, codes = np.sort(rng.integers(0, 10**15, 50_000)), rng.integers(jobs.NO_ID, 10**9, 50_000), rng.integers(-1, 3, 50_000)
    value = jobs.packed(us, ids, codes)
    assert len(value) <= 20 * 50_000 and all((a == b).all() for a, b in zip(jobs.unpacked(value), (us, ids, codes), strict=True))
    assert all(len(c) == 0 for c in jobs.unpacked(None)) and "array<long>" not in jobs.HELD


def test_places_of_terms_never_meet_their_blocks_again(spark):
    """The places found are unions of what the walk has put aside: no join back to the blocks, no grouping."""
    blocks = spark.createDataFrame([(1, n, "the end of the line and of the " * 3) for n in range(20)], "document_id long, block_index int, text string")
    terms = spark.createDataFrame([(t,) for t in ("the", "of the", "and of the")], "term string")
    out = reader.spot_terms(blocks, terms, max_terms=0)
    assert "Aggregate" not in plan_of(out) and "Join" not in plan_of(out)
    got = {r.term: r["count"] for r in out.groupBy("term").count().collect()}
    assert got == {"the": 180, "of the": 120, "and of the": 60}


def test_weak_connections_group_their_pairs_once(spark):
    edges = spark.createDataFrame([("a", "k", "x"), ("a", "k", "y"), ("b", "l", "x"), ("b", "k", "y"), ("c", "k", "y")], "source string, kind string, target string")
    at = START
    evidence = spark.createDataFrame([("a", "x", 0.9, at), ("a", "x", 0.8, at), ("a", "y", 0.1, at), ("a", "y", 0.2, at), ("d", "z", 0.1, at)], "source string, target string, confidence double, created_at timestamp_ntz")
    out = graph.weak_connections(edges, evidence, 2, 0.6, 2)
    want = [("a", "y", 2, 0.15, "weak"), ("b", "x", 0, 0.0, "weak"), ("b", "y", 0, 0.0, "weak"), ("c", "y", 0, 0.0, "insufficient_data")]
    assert sorted(map(tuple, out.collect())) == want and "bool_or" not in plan_of(out) and "avg" not in plan_of(out)


def odd_anchors(spark):
    """Anchors and blocks of documents with repeated quotes, null sides, quotes of any length and blocks without a rect."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    blocks = [(d, n // 5, n, rng.choice([text(90), text(30), "", None]), 50, 72 + 100 * (n % 5), rng.choice([500, 0, None]), 90) for d in (1, 2, None) for n in range(30)]
    anchors = []
    for i in range(150):
        d, page, _, t, *box = rng.choice(blocks)
        at, n = rng.randrange(60), rng.choice([1, 2, 5, 20, 21, 40])
        quote = rng.choice([(t or "")[at : at + n], (t or "")[at : at + n][::-1], None])
        anchors.append((f"a{i}", d, rng.choice([page, page + 1, None]), quote, rng.choice([(t or "")[max(0, at - 4) : at], "zz", None]), rng.choice([(t or "")[at + n : at + n + 4], ""]), rng.choice([[], [tuple(box)], [(50, None, 5, 5), (60, 80, 10, 900)], None])))
    a = spark.createDataFrame(anchors, "anchor_id string, document_id long, page_index int, quote string, prefix string, suffix string, rects array<struct<x:int,y:int,width:int,height:int>>")
    return a, spark.createDataFrame(blocks, "document_id long, page_index int, block_index int, text string, x int, y int, width int, height int"), anchors, blocks


def exact_by_hand(anchors, blocks):
    count = lambda text, s: (len(text) - len(text.replace(s, ""))) // len(s)
    out = []
    for name, doc, page, quote, prefix, suffix, boxes in anchors:
        own = [b for b in blocks if doc is not None and b[0] == doc and quote and b[3] and quote in b[3]]
        sides = None not in (prefix, suffix, quote)
        nc = lambda t: count(t, prefix + quote) + count(t, quote + suffix) - count(t, prefix + quote + suffix) if sides else 0
        hit = lambda b: page == b[1] and any(None not in (*r, *b[4:]) and min(r[2], r[3], b[6], b[7]) > 0 and all(r[i] < b[4 + i] + b[6 + i] and b[4 + i] < r[i] + r[2 + i] for i in (0, 1)) for r in boxes or [])
        n, under, near = sum(count(b[3], quote) for b in own), [b for b in own if hit(b)], [b for b in own if nc(b[3]) > 0]
        if under:
            got = ("geometry", under[0][2], under[0][3].find(quote) + 1)
        elif n == 1:
            got = ("quote", own[0][2], own[0][3].find(quote) + 1)
        elif n > 1 and sum(nc(b[3]) for b in own) == 1:
            t = near[0][3]
            got = ("context", near[0][2], t.find(prefix + quote) + len(prefix) + 1 if prefix + quote in t else t.find(quote + suffix) + 1)
        else:
            got = ("unresolved", None, None)
        out.append((name, *got, got[0] in ("quote", "context") and page is not None and got[1] // 5 != page))
    return sorted(out)


def test_anchors_meet_blocks_in_documents_of_any_size(spark):
    a, b, anchors, blocks = odd_anchors(spark)
    want = exact_by_hand(anchors, blocks)
    assert {w[1] for w in want} == {"geometry", "quote", "context", "unresolved"}
    for limits in ({}, {"max_blocks": 0}, {"max_anchors": 60}):
        out = reader.recover_anchors(a, b, threshold=None, **limits)
        assert sorted(map(tuple, out.collect())) == want
    fuzzy = [sorted(map(tuple, reader.recover_anchors(a, b, max_blocks=n).collect())) for n in (0, 1024)]
    assert fuzzy[0] == fuzzy[1]


def test_exact_recovery_deals_anchors_and_blocks_once(spark):
    a, b, _, _ = odd_anchors(spark)
    plan = reader.recover_anchors(a, b, threshold=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "MapInArrow" not in plan and plan.count("Exchange") <= 2


def test_only_what_lies_around_pieces_is_measured():
    """Far places of pieces are measured apart from each other, and windows as near in several of them are told from one."""
    from lectern.functions import udfs

    quote, gap = "abcdefghijklmnopqrst", "-" * 500
    text = "abcdef" + gap + "abcdefghijXlmnopqrst" + gap + "opqrst"
    assert sum(b - a for a, b in udfs.stretches(text, quote, 2)) < 120
    assert udfs.best_window(text, quote, 0.8) == {"pos": 507, "similarity": 0.95, "is_unique": True}
    assert udfs.best_window(text + gap + "abcdefghijXlmnopqrst", quote, 0.8) == {"pos": 507, "similarity": 0.95, "is_unique": False}
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abc") for _ in range(rng.randrange(n)))
    texts, quotes, least = zip(*[(some(90), some(30), rng.choice([0.5, 0.7, 0.8, 1.0])) for _ in range(3000)], strict=True)
    for t, q, x, got in zip(texts, quotes, least, udfs.best_windows(list(texts), list(quotes), list(least)), strict=True):
        if t and q:
            d = udfs.end_distances(t[::-1], q[::-1])
            starts = [len(t) - i for i, v in enumerate(d) if v == min(d)]
            want = {"pos": min(starts), "similarity": 1 - min(d) / len(q), "is_unique": max(starts) - min(starts) < len(q)} if 1 - min(d) / len(q) >= x else {"pos": None, "similarity": None, "is_unique": False}
            assert got == want


def test_signals_shuffle_numbers_not_names(spark):
    """Targets are numbers in the lists that are shuffled, and edges are labelled by sparse ends put aside, not by a join with every degree."""
    uses = spark.createDataFrame([(p, m) for p, ms in {"a": "xyz", "b": "xyw", "c": "yx", "d": "w"}.items() for m in ms] + [("a", "x"), ("e", None), (None, "x")], "source string, target string")
    sets = graph.rare_first(uses, numbers=True)
    assert sets.schema["items"].dataType.elementType.typeName() == "long"
    want = [("a", "b", 2, 0.5), ("a", "c", 2, 0.666667), ("b", "c", 2, 0.666667)]
    assert sorted(map(tuple, graph.method_overlaps(uses).collect())) == want
    edges = spark.createDataFrame([("a", "increases", "x", None), ("a", "decreases", "x", "rejected"), ("b", "decreases", "x", None), ("b", "increases", "x", "proposed"), ("b", "contradicts", "y", None), (None, "k", "y", None), ("b", None, "z", None)], "source string, kind string, target string, status string")
    facts = {(r.source, r.target): (r.is_edge, r.is_contradicted, r.is_opposed) for r in graph.pair_facts(edges).collect()}
    assert facts == {("a", "x"): (True, False, False), ("b", "x"): (True, False, True), ("b", "y"): (True, True, False), (None, "y"): (True, False, False), ("b", "z"): (True, False, False)}
    evidence = spark.createDataFrame([("b", "x", 0.1, START)], "source string, target string, confidence double, created_at timestamp_ntz")
    out = graph.weak_connections(edges, evidence, 2, 0.6, 2)
    assert "Aggregate" not in plan_of(out) and plan_of(out).count("Join") == 2
    assert sorted((r.source, r.target, r.label) for r in out.collect()) == [("a", "x", "insufficient_data"), ("b", "x", "weak"), ("b", "y", "weak"), ("b", "z", "insufficient_data")]


def test_edges_stream_past_their_nodes(spark):
    """Where nodes are not sent everywhere, no task sorts edges or nodes to join them."""
    edges = spark.createDataFrame([("a", "k", "x"), ("a", "l", "none"), (None, "k", "x")], "source string, kind string, target string")
    nodes = spark.createDataFrame([("a", "V", "t", 1.0), ("x", "R", "u", None)], "id string, kind string, title string, strength double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (graph.edges_with_nodes(edges, nodes), graph.kind_counts(edges, nodes)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("ShuffledHashJoin") == 2 and "Sort" not in plan.replace("SortAggregate", "")
        got = {(r.source, r.kind, r.target, r.source_kind, r.target_title) for r in graph.edges_with_nodes(edges, nodes).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {("a", "k", "x", "V", "u"), ("a", "l", "none", "V", None), (None, "k", "x", None, "u")}
