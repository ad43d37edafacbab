"""Readers of pools from stored sketches, one per pool and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.index import exists

SCHEMA = "pool_id long, readers binary, last_ts timestamp_ntz, day date"


class PoolReaders:
    """A table of HyperLogLog sketches of user ids in ``path``, a folder per day.

    A day is added, or added again, as a whole and replaces that day alone; a summary unites sketches and reads no activity. The standard error of a count is 1.04 / sqrt(2 ** ``lg_k``),
    1.6 per cent by default, and the same for any number of days united. Activity without time, user or pool counts for nothing.
    """

    def __init__(self, spark: SparkSession, path: str, lg_k: int = 12):
        self.spark, self.path, self.lg_k = spark, path, lg_k

    def add(self, members: DataFrame, activity: DataFrame) -> PoolReaders:
        """Add the days of ``activity`` (document_id, user_id, ts); ``members`` (pool_id, document_id) says which pools a paper was in on them."""
        seen = activity.where("ts is not null and user_id is not null").select("document_id", F.to_date("ts").alias("day"), "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
        # A paper's readers of a day once each before they meet its pools.
        seen = seen.groupBy("document_id", "day", "user_id").agg(F.max("ts").alias("ts"))
        rows = members.where("pool_id is not null").select(F.col("pool_id").cast("long").alias("pool_id"), "document_id").distinct().join(seen, "document_id")
        rows = rows.groupBy("pool_id", "day").agg(F.hll_sketch_agg("user_id", self.lg_k).alias("readers"), F.max("ts").alias("last_ts"))
        rows.select("pool_id", "readers", "last_ts", "day").hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
        return self

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], SCHEMA)

    def summary(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """pool_id, n_readers_approx, last_activity over the days from ``since`` to before ``until``."""
        rows = self.table()
        rows = rows.where(F.col("day") >= since) if since else rows
        rows = rows.where(F.col("day") < until) if until else rows
        return rows.groupBy("pool_id").agg(F.hll_sketch_estimate(F.hll_union_agg("readers")).alias("n_readers_approx"), F.max("last_ts").alias("last_activity"))
