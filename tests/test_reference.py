"""Every registered query against its SQL, golden cases, and properties."""

import os
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import columns as C
from lectern.functions.udfs import best_window, best_windows, end_distances
from lectern.operators import graph, library, process, reader, search
from lectern.plans import registry
from lectern.sources import tables
from lectern.streaming import jobs


def same(x):
    return repr(round(x, 6)) if isinstance(x, float) else repr(x)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_against_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    got = sorted(tuple(map(same, r)) for r in df.collect())
    if name in registry.ORACLE_SQL:
        r = duck.execute(registry.ORACLE_SQL[name])
        cols = [c[0] for c in r.description]
        assert sorted(cols) == sorted(df.columns)
        at = [cols.index(c) for c in df.columns]
        assert got == sorted(tuple(same(row[i]) for i in at) for row in r.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_clamp_and_labels(spark):
    df = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 49.5, 100.0, 140.0, None, float("nan"))], "v double")
    got = df.select(C.clamp_pct(F.col("v")), C.pct_label(F.col("v"))).collect()
    assert [r[0] for r in got] == [0, 0, 49.5, 100, 100, None, None]
    assert got[2][1] == 50
    df = spark.createDataFrame([(None, 3), ("", 4), ("i", 5)], "l string, p int")
    assert [r[0] for r in df.select(C.fallback_label(F.col("l"), F.col("p"))).collect()] == ["Page 3", "Page 4", "i"]


def test_quantities(spark):
    df = spark.createDataFrame([("HH 125 °C",), ("4.2 mm/s",), ("62 %",), ("1.225 t/h raw",), ("none",)], "t string")
    got = [r[0] and tuple(r[0]) for r in df.select(C.parse_quantity(F.col("t"))).collect()]
    assert got == [("HH", 125.0, "°C", None), (None, 4.2, "mm/s", None), (None, 62.0, "%", None), (None, 1.225, "t/h", "raw"), None]


def test_blank_messages_go(spark):
    df = spark.createDataFrame([(1, "  hi﻿ "), (2, " \n "), (3, None)], "id int, content string")
    assert [tuple(r) for r in library.clean_messages(df).collect()] == [(1, "hi")]


def test_process_line_and_series(spark):
    line = spark.createDataFrame([(1, 1, "1.225 t/h raw"), (1, 2, "1.05 t/h cake"), (1, 3, "0.655 t/h dry"), (1, 4, "0.625 t/h product")], "line int, seq int, throughput string")
    got = process.line_balance(line).orderBy("seq").collect()
    assert [r.step_yield for r in got] == [None, 0.857143, 0.62381, 0.954198] and got[3].overall_yield == 0.510204
    steam = [342.0, 350.0, 348.0, 359.0, 364.0, 360.0, 361.0]
    df = spark.createDataFrame([("flow", i, v, i) for i, v in enumerate(steam)] + [("flat", i, 5.0, i) for i in range(3)] + [("one", 0, 1.0, 0)], "tag string, ts long, value double, event_id long")
    p = {(r.tag, r.i): (r.x, r.y) for r in process.sparkline_points(df).collect()}
    assert p["flow", 0] == (0, 36) and p["flow", 4][1] == 6 and p["flow", 6][0] == 100 and p["flat", 1] == (50, 36) and p["one", 0] == (0, 36)


def test_yields_are_floating_point_quotients(spark):
    """As the query's SQL has them: infinite against a rate of zero, NaN for zero against zero, rounded by the value times 10^6."""
    rates = ["0.0", "5.0", "0.0", "-0.0", "6.4", "6.71", "1.0E-4", "1.0E7"]
    line = spark.createDataFrame([(1, i, f"{r} t/h raw") for i, r in enumerate(rates)] + [(2, 0, "6.4 t/h raw"), (2, 1, "6.71 t/h raw")], "line int, seq int, throughput string")
    got = process.line_balance(line).orderBy("line", "seq").collect()
    assert [r.rate for r in got[:8]] == [float(r) for r in rates]
    assert [str(r.step_yield) for r in got[:8]] == ["None", "inf", "0.0", "nan", "-inf", "1.048437", "1.5e-05", "100000000000.0"]
    assert str(got[0].overall_yield) == "nan" and got[1].overall_yield == float("inf") and got[9].overall_yield == 1.048437


def test_graph_case(spark):
    e = spark.createDataFrame([("a", "uses", "b"), ("a", "uses", "c"), ("b", "uses", "d"), ("c", "uses", "e")], "source string, kind string, target string")
    n = spark.createDataFrame([(x, "concept", x, 1.0) for x in "abcde"], "id string, kind string, title string, strength double")
    assert {r.id: r.degree for r in graph.node_degrees(e).collect()} == {"a": 2, "b": 2, "c": 2, "d": 1, "e": 1}
    assert {(r.neighbor, r.direction) for r in graph.neighbors(e).where("id = 'b'").collect()} == {("a", "in"), ("d", "out")}
    assert graph.validate_edges(e, n).count() == 0


def test_groups_and_backlinks(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", "File"), (3, "z", "")], "id int, label string, item_group string")
    assert [(r.group_name, r.n_items, r.label) for r in library.group_items(df).orderBy("first_pos", "id").collect()] == [("Commands", 2, "x"), ("Commands", 2, "z"), ("File", 1, "y")]
    links = spark.createDataFrame([("a", "t")] + [("b", "t")] * 2, "source_note string, target_note string")
    assert {r.text for r in library.backlinks(links).collect()} == {"Mentions this note in 1 linked context", "Mentions this note in 2 linked contexts"}


def test_best_window():
    assert best_window("the quick brown fox", "quick brown") == {"pos": 5, "similarity": 1.0, "is_unique": True}
    got = best_window("the quick brXwn fox", "quick brown")
    assert got["pos"] == 5 and abs(got["similarity"] - 10 / 11) < 1e-9
    assert not best_window("abc ..... abc", "abd")["is_unique"]
    assert best_window("the quick brXwn fox", "quick brown", 0.95)["pos"] is None
    assert best_window("", "abc")["similarity"] == 0.0


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=25), st.text("ab c", min_size=1, max_size=8))
def test_end_distances_match_the_full_table(text, quote):
    col = list(range(len(quote) + 1))
    want = []
    for c in text:
        new = [0]
        for i, k in enumerate(quote):
            new.append(min(col[i] + (k != c), col[i + 1] + 1, new[i] + 1))
        col = new
        want.append(col[-1])
    assert end_distances(text, quote) == want


def test_alarm_changes_across_slices(spark):
    rows = [("t", "2024-01-01 10:00:00", "normal"), ("t", "2024-01-02 10:00:00", "normal"), ("t", "2024-01-04 10:00:00", "alarm"), ("t", "2024-01-04 11:00:00", "normal"), ("u", "2024-01-04 10:00:00", "warn")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "tag string, at string, state string, event_id long").withColumn("ts", F.col("at").cast("timestamp_ntz"))
    got = process.alarm_transitions(df).orderBy("ts").collect()
    assert [(r.tag, r.from_state, r.to_state, r.seconds_before) for r in got] == [("t", "normal", "alarm", 259200.0), ("t", "alarm", "normal", 3600.0)]


def test_anchor_methods(spark):
    text = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    blocks = spark.createDataFrame([(1, 0, 0, text, 50, 72, 500, 90), (1, 0, 1, "pre one same words post", 50, 172, 500, 90), (1, 0, 2, "two same words end", 50, 272, 500, 90)], "document_id long, page_index int, block_index int, text string, x int, y int, width int, height int")
    box = [(50, 72, 500, 90)]
    a = [("g", 1, 0, "beta gamma", "", "", box), ("q", 1, 3, "delta epsilon", "", "", []), ("c", 1, 0, "same words", "two ", " none", []), ("f", 1, 0, "thetX iota kappa", "", "", []), ("u", 1, 0, "qqqqqqqqqqqq", "", "", []), ("m", 1, 0, "same words", "xx", "yy", [])]
    anchors = spark.createDataFrame(a, "anchor_id string, document_id long, page_index int, quote string, prefix string, suffix string, rects array<struct<x:int,y:int,width:int,height:int>>")
    got = {r.anchor_id: r for r in reader.recover_anchors(anchors, blocks).collect()}
    assert {k: r.method for k, r in got.items()} == {"g": "geometry", "q": "quote", "c": "context", "f": "fuzzy", "u": "unresolved", "m": "unresolved"}
    assert got["q"].moved and got["c"].block_index == 2 and got["f"].pos == 41


def test_every_anchor_once(spark, sf):
    got = registry.QUERIES["recover_anchors"](spark, sf)
    n = registry.view(spark, sf, "fx_anchor").count()
    assert got.count() == got.select("anchor_id").distinct().count() == n
    assert got.where("moved and method = 'geometry'").count() == 0
    by = {r.method: r["count"] for r in got.groupBy("method").count().collect()}
    assert by["fuzzy"] > 0 and by["unresolved"] > 0


def test_fuzzy_locate_tries_every_anchor_on_its_page(spark, sf):
    want = registry.view(spark, sf, "fx_anchor").join(registry.view(spark, sf, "fx_text_block"), ["document_id", "page_index"])
    want = want.select("anchor_id", F.col("block_index")).exceptAll(registry.QUERIES["fuzzy_locate"](spark, sf).select("anchor_id", "block_index"))
    assert want.count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o/a.pdf").write_bytes(b"one")
    (tmp_path / "o/b.pdf").write_bytes(b"one")
    found = tables.read_originals(spark, str(tmp_path / "o")).withColumn("document_id", F.monotonically_increasing_id())
    known = spark.createDataFrame([], "digest string")
    assert tables.register_originals(found, known).count() == 1
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    for _ in range(2):
        tables.write_partitioned(df, str(tmp_path / "w"), ["k"])
    assert spark.read.parquet(str(tmp_path / "w")).count() == 4
    assert tables.load_table(spark, "/root/testdata/sf0.001", "events").schema == schemas.TABLES["events"]


def in_files(e, folder, parts):
    """Files of events, to be read in this order."""
    (folder / "events.parquet").mkdir()
    for n, part in enumerate(parts):
        name = folder / "events.parquet" / f"part-{n:04d}.parquet"
        part.coalesce(1).toPandas().to_parquet(name, coerce_timestamps="us")
        os.utime(name, (1_000_000 + n * 100,) * 2)


def test_late_rows_are_counted(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    low, high = e.agg(F.expr("min(ts) + interval 1 day"), F.expr("max(ts) - interval 1 day")).first()
    in_files(e, tmp_path, [e.where(F.col("ts") >= high), e.where(F.col("ts") < low), e.where(F.col("ts") < low)])
    stream = jobs.read_stream(spark, str(tmp_path), "events", max_files=1).select(F.col("event_type").alias("tag"), "ts", "value", F.lit("u").alias("unit"))
    n = jobs.late_rows(spark, lambda: jobs.run_to_table(jobs.stream_tag_windows(stream), str(tmp_path / "t"), str(tmp_path / "c")))
    assert n > 0


def test_late_rows_of_more_than_a_hundred_batches(spark, tmp_path):
    rows = lambda ts: spark.createDataFrame([(1, ts, 1, "click", 1.0, "{}")], "event_id long, ts string, user_id long, event_type string, value double, payload string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    first, late = rows("2024-02-01 00:00:00").toPandas(), rows("2024-01-01 00:00:00").toPandas()
    (tmp_path / "events.parquet").mkdir()
    for n in range(108):
        name = tmp_path / "events.parquet" / f"part-{n:04d}.parquet"
        (late if n > 1 else first).to_parquet(name, coerce_timestamps="us")
        os.utime(name, (1_000_000 + n * 100,) * 2)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    stream = jobs.read_stream(spark, str(tmp_path), "events", max_files=1).select(F.col("event_type").alias("tag"), "ts", "value", F.lit("u").alias("unit"))
    n = jobs.late_rows(spark, lambda: jobs.run_to_table(jobs.stream_tag_windows(stream), str(tmp_path / "t"), str(tmp_path / "c")))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert n == 106


def test_streams_of_many_batches_equal_the_batch_jobs(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    a, b = (e.agg(F.expr(f"percentile_approx(ts, {x})")).first()[0] for x in (0.4, 0.7))
    # The second file holds rows of the half hour before its start too: they come late, within the delay.
    in_files(e, tmp_path, [e.where((F.col("ts") < a) & (F.col("event_id") % 3 != 0) | (F.col("ts") < F.lit(a) - F.expr("interval 30 minutes"))), e.where((F.col("ts") >= F.lit(a) - F.expr("interval 30 minutes")) & (F.col("ts") < b) & ((F.col("ts") >= a) | (F.col("event_id") % 3 == 0))), e.where(F.col("ts") >= b)])
    read = lambda: jobs.read_stream(spark, str(tmp_path), "events", max_files=1)
    state = F.when(F.col("value") >= 200, "alarm").when(F.col("value") >= 100, "warn").otherwise("normal")
    rows = read().select(F.col("event_type").alias("tag"), "ts", state.alias("state"), "event_id")
    want = process.alarm_transitions(e.select(F.col("event_type").alias("tag"), "ts", state.alias("state"), "event_id"))
    key = lambda df: sorted((r.tag, r.event_id, r.from_state, r.to_state) for r in df.collect())
    assert key(jobs.run_closed(jobs.stream_alarm_transitions, rows, str(tmp_path / "changes"))) == key(want)
    log = lambda df: df.select((F.col("user_id") * 10 + F.col("event_id") % 7).alias("annotation_id"), F.col("user_id").alias("document_id"), F.lit(1).alias("page_index"), F.when(F.col("event_type") == "error", "erase").otherwise("note").alias("tool"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    jobs.stream_annotation_state(log(read()), str(tmp_path / "notes"), str(tmp_path / "c2")).awaitTermination()
    got = jobs.live_annotations(spark, str(tmp_path / "notes"))
    want = jobs.newest_annotations(log(e)).where("tool <> 'erase'")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    got = jobs.run_closed(lambda r: jobs.stream_tag_windows(r, delay="40 minutes"), read().select(F.col("event_type").alias("tag"), "ts", "value", F.lit("u").alias("unit")), str(tmp_path / "windows"))
    assert got.agg(F.sum("n")).first()[0] == e.count()


READINGS = "tag string, ts timestamp, state string, event_id long"


def test_a_tag_goes_on_from_its_checkpoint(spark, tmp_path):
    """Runs of one query, each over what has come since: late rows within the delay are set in order, later ones dropped, a quiet tag is settled by the others' time."""
    at = lambda h, m=0: datetime(2024, 5, 1, h, m)
    files = [
        [("a", at(1), "normal", 1), ("a", at(3), "alarm", 3), ("b", at(1), "warn", 4), (None, at(1), "warn", 20)],
        [("a", at(2, 30), "warn", 2), ("a", at(9), "normal", 5), ("c", at(9), None, 6)],
        [("a", at(2), "normal", 7), ("b", at(12), "alarm", None), (None, at(12), "alarm", 21), ("a", at(12), "normal", 9)],
        [("b", at(12), "warn", 8), ("c", at(20), "warn", 10), ("c", at(20, 30), None, 11), ("c", at(21), "alarm", 12)],
    ]
    folder, base = str(tmp_path / "in"), tmp_path / "out"
    spark.createDataFrame([], READINGS).write.parquet(folder)
    make = lambda: jobs.stream_alarm_transitions(spark.readStream.schema(READINGS).parquet(folder))
    for rows in [*files, [("z", at(23), "x", 99)], [("z", at(23, 59), "x", 100)]]:
        spark.createDataFrame(rows, READINGS).coalesce(1).write.mode("append").parquet(folder)
        jobs.run_to_table(make(), f"{base}/table", f"{base}/checkpoint")
    got = sorted((str(r.tag), r.ts.hour, r.from_state, r.to_state, r.event_id) for r in spark.read.parquet(f"{base}/table").collect())
    assert got == [("None", 12, "warn", "alarm", 21), ("a", 2, "normal", "warn", 2), ("a", 3, "warn", "alarm", 3), ("a", 9, "alarm", "normal", 5), ("b", 12, "alarm", "warn", 8), ("b", 12, "warn", "alarm", None)]


def test_runs_of_annotations_are_merged(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "notes")
    spark.createDataFrame([], jobs.ANNOTATIONS).write.parquet(folder)
    stream = lambda: jobs.stream_annotation_state(spark.readStream.schema(jobs.ANNOTATIONS).parquet(folder), path, str(tmp_path / "c"))
    stream().awaitTermination()
    assert jobs.live_annotations(spark, path).count() == 0
    sent = []
    for n in range(18):
        rows = [(i, 1, 0, "erase" if (i + n) % 4 == 0 else f"t{n}", datetime(2024, 5, 1, n % 24, i), 100 * n + i) for i in range(n % 3, 12, 2)]
        rows += [rows[0], (50 + n, 1, 0, "erase", datetime(2024, 5, 1, n % 24, 1), 5000 + n)]
        sent += rows
        spark.createDataFrame(rows, jobs.ANNOTATIONS).coalesce(1).write.mode("append").parquet(folder)
        stream().awaitTermination()
    newest = {}
    for r in sorted(set(sent), key=lambda r: (r[4], r[5])):
        newest[r[0]] = r
    want = sorted(r for r in newest.values() if r[3] != "erase")
    live = lambda: sorted(map(tuple, jobs.live_annotations(spark, path).select("annotation_id", "document_id", "page_index", "tool", "ts", "event_id").collect()))
    assert live() == want
    last = jobs.manifest_before(spark, path, None)
    assert max(last["levels"]) >= 2 and len(last["runs"]) <= 9
    kept = {p.name for p in (tmp_path / "notes/runs").iterdir()}
    assert len(kept) <= 14 and set(last["runs"]) <= kept
    deep = [r for r, at in zip(last["runs"], last["levels"], strict=True) if at == max(last["levels"])]
    assert spark.read.parquet(*[f"{path}/runs/{r}" for r in deep]).where("annotation_id = 50").count() == 0  # its erasure has gone with it
    number = jobs.folder_numbers(spark, f"{path}/manifest")[-1]
    jobs.delete(spark, f"{path}/manifest/v={number}")
    jobs.delete(spark, f"{tmp_path}/c/commits/{number}")
    stream().awaitTermination()  # the last batch runs again
    assert live() == want


def test_streams_of_empty_tables(spark, tmp_path):
    schema = schemas.TABLES["events"]
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "events.parquet"))
    e = jobs.read_stream(spark, str(tmp_path), "events")
    rows = e.select(F.col("event_type").alias("tag"), "ts", "value", F.lit("u").alias("unit"), F.lit("normal").alias("state"), "event_id")
    for n, make in enumerate((jobs.stream_tag_windows, jobs.stream_tag_trend, jobs.stream_alarm_transitions)):
        assert jobs.run_closed(make, rows, str(tmp_path / f"run{n}")).count() == 0
    assert jobs.run_closed(jobs.stream_reading_sessions, e.select("user_id", "ts"), str(tmp_path / "sessions")).count() == 0
    log = e.select(F.col("event_id").alias("annotation_id"), F.col("user_id").alias("document_id"), F.lit(1).alias("page_index"), F.col("event_type").alias("tool"), "ts", "event_id")
    jobs.stream_annotation_state(log, str(tmp_path / "notes"), str(tmp_path / "c")).awaitTermination()
    assert jobs.live_annotations(spark, str(tmp_path / "notes")).count() == 0
    assert jobs.late_rows(spark, lambda: jobs.run_to_table(jobs.stream_tag_windows(rows), str(tmp_path / "t"), str(tmp_path / "c2"))) == 0


def test_a_key_with_most_rows_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    df = spark.range(60_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(0).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    tables.write_partitioned(df, str(tmp_path / "w"), ["k"])
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "w/k=0").glob("*.parquet"))) > 3 and spark.read.parquet(str(tmp_path / "w")).count() == 60_000


def test_rules_terms_and_hubs_have_no_cap(spark):
    log = spark.createDataFrame([(f"s{i}", "t", s, n, n) for i in range(1500) for n, s in enumerate((f"a{i}", f"b{i}"))], "source string, target string, status string, ts int, seq int")
    allowed = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(1499)], "from_status string, to_status string")
    assert [r.source for r in graph.illegal_transitions(log, allowed).collect()] == ["s1499"]
    blocks = spark.createDataFrame([(1, 0, "On the Method of least squares, and least  of all squares")], "document_id long, block_index int, text string")
    terms = [("method of least squares",), ("least",), ("squares",), ("of all squares",), ("least of all squares now",)]
    want = [(2, "method of least squares", 4), (4, "least", 1), (5, "squares", 1), (7, "least", 1), (8, "of all squares", 3), (10, "squares", 1)]
    for limit in (2000, 0):
        before, reader.MAX_TERMS = reader.MAX_TERMS, limit
        got = reader.spot_terms(blocks, spark.createDataFrame(terms, "term string")).orderBy("pos").collect()
        reader.MAX_TERMS = before
        assert [(r.pos, r.term, r.n_words) for r in got] == want
    assert reader.spot_terms(blocks, spark.createDataFrame([], "term string")).count() == 0
    uses = [(f"p{i:03d}", "hub") for i in range(300)] + [(f"p{i:03d}", f"m{i // 2}") for i in range(300)] + [("p000", "x"), ("p100", "x")]
    df = spark.createDataFrame(uses, "source string, target string")
    got = {(r.paper_a, r.paper_b): (r.shared, r.jaccard) for r in graph.method_overlaps(df).collect()}
    assert len(got) == 151 and got["p002", "p003"] == (2, 1.0) and got["p000", "p100"] == (2, 0.5)
    asked = spark.createDataFrame([("q1", "hub"), ("q2", "x")], "id string, about string")
    edges = spark.createDataFrame([("q2", "answered-by", "p", "proposed"), ("q3", "answered-by", "p", "confirmed")], "source string, kind string, target string, status string")
    read = spark.createDataFrame([("p000",)], "paper string")
    best = graph.recommend_papers(df, asked, edges, read, k=4).orderBy("rank").collect()
    assert [(r.related, r.n_shared, r.why, r.n_questions) for r in best] == [("p001", 2, "hub,m0", 1), ("p100", 2, "hub,x", 2), ("p002", 1, "hub", 1), ("p003", 1, "hub", 1)]


def test_short_quotes_are_found_by_what_is_inside(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "xalpha beta gammay"), (3, "beta")], "document_id long, text string")
    quotes = spark.createDataFrame([(1, "pha beta gam"), (2, "beta"), (3, "beta gamma"), (4, "")], "query_id long, quote string")
    assert sorted((r.query_id, r.document_id) for r in search.quote_search(docs, quotes).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ab cé", max_size=40), st.text("ab cé", min_size=1, max_size=63)), min_size=1, max_size=6))
def test_windows_of_many_pairs_equal_those_of_each(pairs):
    texts, quotes = [list(x) for x in zip(*pairs, strict=True)]
    assert best_windows(texts, quotes, [0.3] * len(pairs)) == [best_window(t, q, 0.3) for t, q in pairs]
