"""Structured Streaming forms of the console, reading and annotation jobs; results go to Parquet tables in the shared folder."""

from __future__ import annotations

import threading
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, table: str, max_files: int = 1000) -> DataFrame:
    """A stream of the rows of one table (a Parquet file or a folder of them), as they come; ``ts`` as a time stamp, which watermarks need."""
    from lectern.schemas import TABLES

    # A pattern, as a stream takes no path of a single file.
    rows = spark.readStream.schema(TABLES[table]).option("maxFilesPerTrigger", max_files).parquet(f"{folder}/{table}.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def measures(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.count("*").alias("n"))


def stream_tag_windows(readings: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """tag, unit, start_ts, mean, lowest, highest, n per tumbling window."""
    got = measures(readings.withWatermark("ts", delay).groupBy("tag", "unit", F.window("ts", size).alias("w")))
    return got.withColumn("start_ts", F.col("w.start")).drop("w")


def stream_tag_trend(readings: DataFrame, size: str = "1 hour", slide: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """The same on sliding windows."""
    got = measures(readings.withWatermark("ts", delay).groupBy("tag", "unit", F.window("ts", size, slide).alias("w")))
    return got.withColumn("start_ts", F.col("w.start")).drop("w")


def stream_reading_sessions(activity: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """user_id, start_ts, end_ts, n_events per session."""
    got = activity.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_events"))
    return got.drop("s")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what the stream has finished to the Parquet table at ``path`` over all input that is there, and give the query back."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_closed(make: Callable[[DataFrame], DataFrame], rows: DataFrame, base: str) -> DataFrame:
    """The table of ``make(rows)`` for a stream that has ended: windows and sessions still open are closed too.

    A second source is read beside the rows; once they are through, it gets one row of the year 2262 (the last that Pandas can hold), which moves the
    watermark past everything (its own window stays open). Windows leave the state as the watermark passes them.
    """
    spark, end = rows.sparkSession, f"{base}/end"
    empty = spark.createDataFrame([], rows.schema)
    empty.write.parquet(end)
    stream = make(rows.unionByName(spark.readStream.schema(rows.schema).parquet(end)))
    run_to_table(stream, f"{base}/table", f"{base}/checkpoint")
    last = spark.range(1).select(*[(F.lit("2262-01-01").cast("timestamp") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema])
    last.write.mode("append").parquet(end)
    run_to_table(stream, f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table")


NO_ID = -(1 << 63)
HELD = "last_us long, last_id long, last_state string, held binary, states array<string>"


def packed(us: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> bytes:
    """Held readings as one value: instants and ids column by column, and the places of their states in a list of distinct ones."""
    return zlib.compress(np.concatenate((np.diff(us, prepend=0), ids)).tobytes() + codes.astype(np.int32).tobytes(), 1)


def unpacked(held: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``packed`` was given."""
    every = zlib.decompress(bytes(held)) if held else b""
    n = len(every) // 20
    return np.cumsum(np.frombuffer(every, np.int64, n)), np.frombuffer(every, np.int64, n, 8 * n), np.frombuffer(every, np.int32, n, 16 * n)


def stream_alarm_transitions(classified: DataFrame, delay: str = "1 hour") -> DataFrame:
    """tag, ts, from_state, to_state, event_id: changes of a tag's state; rows may come out of order by ``delay``.

    The state store holds one row a tag: the last settled reading and those newer than the watermark, which may still get predecessors, packed into one value. An event-time timer of the oldest of them
    settles it as the watermark passes, with or without new rows of the tag. Readings at or before the last settled one are late and dropped; one without an id comes first at its instant, and one
    without a state is no change and hides what was before. A tag's readings are sorted and compared as columns, some 20 bytes each; no reading is a value of its own.
    """
    rows = classified.select("tag", "ts", F.unix_micros("ts").alias("us"), F.coalesce("event_id", F.lit(NO_ID)).alias("id"), "state").where("ts is not null")

    def settle(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_us, last_id, last_state, held, names = state.get if state.exists else (NO_ID, NO_ID, None, None, [])
        code = {name: i for i, name in enumerate(names)}
        if last_state is not None:
            code.setdefault(last_state, len(code))
        cols = [[c] for c in unpacked(held)]
        for part in parts:
            us, ids = part["us"].to_numpy(np.int64), part["id"].to_numpy(np.int64)
            at, distinct = pd.factorize(part["state"])  # -1: none
            known = np.array([code.setdefault(str(x), len(code)) for x in distinct] + [-1], np.int32)
            new = (us > last_us) | (us == last_us) & (ids > last_id)
            for col, more in zip(cols, (us, ids, known[at]), strict=True):
                col.append(more[new])
        us, ids, states = (np.concatenate(c) for c in cols)
        order = np.lexsort((ids, us))
        us, ids, states = us[order], ids[order], states[order]
        past = state.getCurrentWatermarkMs()
        n = int(np.searchsorted(us, past * 1000))  # settled: older than the watermark
        before = np.concatenate(([-1 if last_state is None else code[last_state]], states[:n]))[:n]
        change = np.flatnonzero((before >= 0) & (states[:n] >= 0) & (before != states[:n]))
        name = np.array([*code, None], object)
        if n:
            last_us, last_id, last_state = int(us[n - 1]), int(ids[n - 1]), name[states[n - 1]]
        left, places = np.unique(np.append(states[n:], -1), return_inverse=True)  # the first: no state
        state.update((last_us, last_id, last_state, packed(us[n:], ids[n:], places[:-1] - 1) if n < len(us) else None, name[left[1:]].tolist()))
        if n < len(us):
            state.setTimeoutTimestamp(max(int(us[n]) // 1000, past) + 1)
        for i in range(0, len(change), 1 << 16):
            at = change[i : i + (1 << 16)]
            yield pd.DataFrame({"tag": [key[0]] * len(at), "us": us[at], "from_state": name[before[at]], "to_state": name[states[at]], "id": ids[at]})

    found = rows.withWatermark("ts", delay).groupBy("tag").applyInPandasWithState(settle, "tag string, us long, from_state string, to_state string, id long", HELD, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("tag", F.timestamp_micros("us").alias("ts"), "from_state", "to_state", F.nullif("id", F.lit(NO_ID)).alias("event_id"))


def newest_annotations(log: DataFrame) -> DataFrame:
    """annotation_id, document_id, page_index, tool, ts, event_id: the newest event of each; an erased one goes."""
    cols = ["document_id", "page_index", "tool", "ts", "event_id"]
    got = log.groupBy("annotation_id").agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("r")).select("annotation_id", "r.*")
    return got


ANNOTATIONS = "annotation_id long, document_id long, page_index int, tool string, ts timestamp, event_id long"
FAN = 4  # runs of a level that are merged into one of the next


def folder_numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished folders v=... below ``path``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(int(s.getPath().getParent().getName()[2:]) for s in found)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


MANIFEST = "runs array<string>, levels array<int>, gone array<string>, newest timestamp"


def manifest_before(spark: SparkSession, path: str, number: int | None) -> Row:
    """What the table was made of before batch ``number`` (after all batches, if null): runs and their levels, runs that had just been merged away, the newest event's time."""
    known = [n for n in folder_numbers(spark, f"{path}/manifest") if number is None or n < number]
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v={known[-1]}").first() if known else Row(runs=[], levels=[], gone=[], newest=None)


def write_run(rows: DataFrame, path: str, name: str) -> None:
    """The newest event of each annotation, in ranges of the annotation."""
    newest_annotations(rows).repartitionByRange("annotation_id").sortWithinPartitions("annotation_id").write.mode("overwrite").parquet(f"{path}/runs/{name}")


def stream_annotation_state(log: DataFrame, path: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Start a query that adds the log to the annotation table below ``path``; give it back.

    Repeated events are dropped within the watermark. A batch writes one run, the newest event of each annotation it names, whatever the table's size. As soon as a level has ``FAN`` runs they become
    one of the next level; the newest event wins, and where nothing lies deeper an erasure goes with what it erased, once it is older than the watermark that holds for all later batches.
    A manifest per batch, written last, names the runs; a batch that runs again starts from the manifest before it and writes the same. Runs merged away are deleted one batch later.
    """
    fresh = log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = manifest_before(spark, path, number)
        read = lambda names: spark.read.schema(ANNOTATIONS).parquet(*[f"{path}/runs/{r}" for r in names])
        write_run(batch.select(*[f.split()[0] for f in ANNOTATIONS.split(", ")]), path, f"{number}-0")
        newest = read([f"{number}-0"]).agg(F.greatest(F.max("ts"), F.lit(old["newest"]).cast("timestamp"))).first()[0]
        runs, gone, level = dict(zip(old["runs"], old["levels"], strict=True)) | {f"{number}-0": 0}, [], 0
        while len(full := [r for r, at in runs.items() if at == level]) >= FAN:
            rows = newest_annotations(read(full))
            if max(runs.values()) == level and old["newest"] is not None:
                rows = rows.where(~F.col("tool").eqNullSafe("erase") | (F.col("ts") > F.lit(old["newest"]) - F.expr(f"interval {delay}")))
            level += 1
            write_run(rows, path, f"{number}-{level}")
            gone += full
            runs = {r: at for r, at in runs.items() if r not in full} | {f"{number}-{level}": level}
        made = spark.createDataFrame([(list(runs), list(runs.values()), gone, newest)], MANIFEST)
        made.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={number}")
        for name in old["gone"]:
            delete(spark, f"{path}/runs/{name}")

    return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_annotations(spark: SparkSession, path: str) -> DataFrame:
    """The annotations that are not erased; none where nothing was written yet."""
    runs = manifest_before(spark, path, None)["runs"]
    if not runs:
        return spark.createDataFrame([], ANNOTATIONS)
    return newest_annotations(spark.read.schema(ANNOTATIONS).parquet(*[f"{path}/runs/{r}" for r in runs])).where("tool is distinct from 'erase'")


class LateRows(StreamingQueryListener):
    """Adds up, over every batch, the rows that queries drop behind their watermarks."""

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        n = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        with self.news:
            run = str(event.progress.runId)
            self.dropped[run] = self.dropped.get(run, 0) + n

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def of(self, query: StreamingQuery, wait: float = 60) -> int:
        """Late rows of a query that has ended; its last report comes before its end does."""
        with self.news:
            if not self.news.wait_for(lambda: str(query.runId) in self.ended, wait):
                raise TimeoutError(f"the query's end was not reported within {wait} seconds, so its late rows are not known")
            return self.dropped.get(str(query.runId), 0)


def late_rows(spark: SparkSession, run: Callable[[], StreamingQuery]) -> int:
    """Rows that the query which ``run`` starts and waits for has dropped behind its watermark, over all its batches."""
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        return listener.of(run())
    finally:
        spark.streams.removeListener(listener)
