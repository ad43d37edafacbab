"""Process console: readings, limits, alarms, shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.columns import parse_quantity
from lectern.sources.scratch import put_aside

#: About this many rows of a series are one task's slice.
SLICE_ROWS = 1 << 22


def unit_guard(readings: DataFrame) -> DataFrame:
    """tag, n_units, units, is_safe: safe if a tag has one unit and no reading without."""
    u = F.nullif("unit", F.lit(""))
    got = readings.groupBy("tag").agg(F.countDistinct(u).alias("n_units"), F.array_join(F.sort_array(F.collect_set(u)), ",").alias("units"), F.count_if(u.isNull()).alias("bare"))
    return got.select("tag", "n_units", "units", ((F.col("n_units") == 1) & (F.col("bare") == 0)).alias("is_safe"))


def classify_readings(readings: DataFrame, limits: DataFrame) -> DataFrame:
    """Readings with state normal, warn or alarm; a tag without limits is normal."""
    state = F.when(F.col("value") >= F.col("alarm"), "alarm").when(F.col("value") >= F.col("warn"), "warn").otherwise("normal")
    return readings.join(limits.select("tag", "warn", "alarm"), "tag", "left").withColumn("state", state).drop("warn", "alarm")


def sliced(rows: DataFrame, keys: list[str], slice_rows: int | None = None) -> DataFrame:
    """``rows`` with ``part``, the number of their slice: runs of about ``slice_rows`` rows in the order of ``keys``, whatever the keys' values are.

    A series, or one hour of it, is cut into as many slices as its rows need; only rows equal in all keys stay together. What a slice needs from those before it comes from a
    scan over one row per series and slice. The slices are put aside: bounds found anew in a later step could lie elsewhere.
    """
    spark, n = rows.sparkSession, rows.count()
    if slice_rows is None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        count = max(-(-n // SLICE_ROWS), min(parts, -(-n // 4096)), 1)
    else:
        count = max(-(-n // slice_rows), 1)
    return put_aside(rows.repartitionByRange(count, *keys).withColumn("part", F.spark_partition_id()), "slices")


def with_slice(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``slices`` for their tag and part; null tags meet as well."""
    own = slices.withColumnsRenamed({"tag": "s_tag", "part": "s_part"})
    return rows.join(own, F.col("tag").eqNullSafe(F.col("s_tag")) & (F.col("part") == F.col("s_part")), "left").drop("s_tag", "s_part")


def asof_align(events: DataFrame, readings: DataFrame, tolerance: str | None = None, slice_rows: int | None = None) -> DataFrame:
    """event_id, tag, ts, value: events with the tag's newest reading at or before them; one older than ``tolerance`` gives null.

    Both are cut into slices of even size in time order; each slice is given the last reading before it. Readings of one instant: the largest value counts. An event without
    tag or time gets null; a reading without them takes no part.
    """
    r = readings.where("tag is not null and ts is not null").select("tag", "ts", F.lit(0).alias("side"), "value", F.lit(None).cast("long").alias("event_id"))
    e = events.select("tag", "ts", F.lit(1).alias("side"), F.lit(None).cast("double").alias("value"), "event_id")
    rows = sliced(r.unionByName(e), ["tag", "ts", "side", "value"], slice_rows)
    reading = F.when(F.col("side") == 0, F.struct("ts", "value"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("tag").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = rows.groupBy("tag", "part").agg(F.max(reading).alias("last")).select("tag", "part", before.alias("carried"))
    w = W.partitionBy("tag", "part").orderBy("ts", "side", "value").rowsBetween(W.unboundedPreceding, 0)
    rows = with_slice(rows.withColumn("own", F.last(reading, ignorenulls=True).over(w)).where("side = 1"), parts)
    rows = rows.withColumn("near", F.coalesce("own", "carried"))
    fresh = F.lit(True) if tolerance is None else F.col("near.ts") >= F.col("ts") - F.expr(f"interval {tolerance}")
    return rows.select("event_id", "tag", "ts", F.when(fresh, F.col("near.value")).alias("value"))


def events_in_shift(events: DataFrame, shifts: DataFrame) -> DataFrame:
    """Events in [start, end) of a shift, with whole minutes into it; both sides are dealt by the days a shift touches."""
    days = F.sequence(F.to_date("start_ts"), F.to_date("end_ts"))
    s = shifts.select("start_ts", "end_ts", F.explode(days).alias("day"))
    rows = events.withColumn("day", F.to_date("ts")).join(s, "day").where("ts >= start_ts and ts < end_ts")
    minutes = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 60_000_000)
    return rows.select("event_id", "tag", "ts", "start_ts", minutes.alias("minutes_in"))


def tag_summary(readings: DataFrame) -> DataFrame:
    """tag, unit, latest, lowest, highest, mean, n; of readings of one instant the largest is the latest."""
    return readings.groupBy("tag", "unit").agg(F.max_by("value", F.struct("ts", "value")).alias("latest"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


def metric_trend(readings: DataFrame, period: str = "day") -> DataFrame:
    """tag, period_start, total, change, direction (up, down or null) against the period before."""
    got = readings.groupBy("tag", F.date_trunc(period, "ts").cast("timestamp_ntz").alias("period_start")).agg(F.round(F.sum("value"), 4).alias("total"))
    change = F.round(F.col("total") - F.lag("total").over(W.partitionBy("tag").orderBy("period_start")), 4)
    return got.withColumn("change", change).withColumn("direction", F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down"))


def sparkline_points(readings: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """tag, i, x, y: points in a 100 by 36 box in time order; a flat series lies at 36, a single point at 0.

    Points are numbered within a slice of even size, after the number of the tag's points in the slices before it.
    """
    rows = sliced(readings.select("tag", "ts", "event_id", "value"), ["tag", "ts", "event_id"], slice_rows)
    w, of_tag = W.partitionBy("tag", "part"), W.partitionBy("tag")
    parts = rows.groupBy("tag", "part").agg(F.count("*").alias("k"), F.min("value").alias("low"), F.max("value").alias("high"))
    earlier = F.sum("k").over(of_tag.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("tag", "part", F.coalesce(earlier, F.lit(0)).alias("earlier"), F.sum("k").over(of_tag).alias("n"), F.min("low").over(of_tag).alias("low"), F.max("high").over(of_tag).alias("high"))
    rows = with_slice(rows.withColumn("i", F.row_number().over(w.orderBy("ts", "event_id")) - 1), parts).select("tag", (F.col("i") + F.col("earlier")).alias("i"), "value", "n", "low", "high")
    span = F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))
    x = F.when(F.col("n") == 1, 0.0).otherwise(F.try_divide(F.col("i"), F.col("n") - 1) * 100)
    return rows.select("tag", "i", F.round(x, 6).alias("x"), F.round(36 - (F.col("value") - F.col("low")) / span * 30, 6).alias("y"))


def last_n_readings(readings: DataFrame, n: int = 7) -> DataFrame:
    """tag, k (1 is the oldest), ts, value: the newest ``n`` of each tag."""
    back = F.row_number().over(W.partitionBy("tag").orderBy(F.desc("ts"), F.desc("event_id")))
    got = readings.withColumn("back", back).where(F.col("back") <= n)
    k = F.row_number().over(W.partitionBy("tag").orderBy(F.desc("back")))
    return got.select("tag", k.alias("k"), "ts", "value")


def alarm_transitions(classified: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """tag, ts, from_state, to_state, seconds_before: changes of a tag's state, and how long the state left had lasted.

    Rows are compared within a slice of even size; a tag's first one there is compared with the tag's last state, and last
    change, in the slices before, which are one row per tag and slice.
    """
    w, by_part = W.partitionBy("tag", "part").orderBy("ts", "event_id"), W.partitionBy("tag").orderBy("part")
    rows = sliced(classified.select("tag", "ts", "event_id", "state"), ["tag", "ts", "event_id"], slice_rows)
    ends = rows.groupBy("tag", "part").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    ends = ends.select("tag", "part", F.lag("state").over(by_part).alias("held"))
    changes = with_slice(rows.withColumn("lagged", F.lag("state").over(w)), ends)
    changes = changes.select("tag", "part", "ts", "event_id", "state", F.coalesce("lagged", "held").alias("from_state")).where("from_state is null or from_state <> state")
    latest = changes.groupBy("tag", "part").agg(F.max("ts").alias("ts"))
    latest = latest.select("tag", "part", F.lag("ts").over(by_part).alias("before"))
    both = with_slice(changes.withColumn("lagged", F.lag("ts").over(w)), latest)
    since = F.coalesce("lagged", "before")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1e6
    return both.where("from_state is not null").select("tag", "ts", "from_state", F.col("state").alias("to_state"), F.round(seconds, 3).alias("seconds_before"), "event_id")


def alarm_queue(classified: DataFrame) -> DataFrame:
    """tag, state, ts, value, rank: the current state of each tag, worst and then newest first."""
    got = classified.groupBy("tag").agg(F.max_by(F.struct("state", "ts", "value"), F.struct("ts", "event_id")).alias("c")).select("tag", "c.*")
    level = F.when(F.col("state") == "alarm", 0).when(F.col("state") == "warn", 1).otherwise(2)
    return got.withColumn("rank", F.dense_rank().over(W.orderBy(level, F.desc("ts"))))  # one row per tag


def line_balance(equipment: DataFrame) -> DataFrame:
    """line, seq, rate, step_yield, overall_yield: throughput against the step before and the first.

    A rate is the number that the text begins with, in any notation, else the quantity in it. Yields are floating-point quotients: against a rate of zero infinite, or NaN for zero
    itself; they are rounded as such, by the value times 10^6, not by its decimal digits.
    """
    number = F.split_part("throughput", F.lit(" "), F.lit(1)).try_cast("double")
    rows = equipment.select("line", "seq", F.coalesce(number, parse_quantity(F.col("throughput"))["value"]).alias("rate"))
    w = W.partitionBy("line").orderBy("seq")
    first = F.first("rate").over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.select("line", "seq", "rate", F.lag("rate").over(w).alias("before"), first.alias("first"))
    quotient = lambda by: F.when(F.col(by) == 0, F.col("rate") * F.pow(F.col(by), F.lit(-1.0))).otherwise(F.try_divide("rate", by))
    part = lambda by: F.round(quotient(by) * 1e6) / 1e6
    return rows.select("line", "seq", "rate", part("before").alias("step_yield"), part("first").alias("overall_yield"))
