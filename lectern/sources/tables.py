"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.schemas import EXTERNAL_PAPER, READING, TABLES


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Table ``name`` with its fixed schema: from Parquet in folder ``path``, or over JDBC if ``path`` is a jdbc: address."""
    schema = TABLES[name]
    if path.startswith("jdbc:"):
        key = schema[0].name
        low, high = spark.read.format("jdbc").options(url=path, query=f"select min({key}), max({key}) from {name}").load().first()
        options = {"partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": 64} if low is not None else {}
        return spark.read.format("jdbc").options(url=path, dbtable=name, **options).load().select(*schema.names)
    return spark.read.schema(schema).parquet(f"{path}/{name}.parquet")


def read_originals(spark: SparkSession, path: str) -> DataFrame:
    """path, content: immutable originals as they are."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def register_originals(binaries: DataFrame, known: DataFrame) -> DataFrame:
    """digest, document_id of originals (document_id, content) whose digest is not in ``known`` (digest); copies go to the lowest id."""
    found = binaries.groupBy(F.sha2("content", 256).alias("digest")).agg(F.min("document_id").alias("document_id"))
    return found.join(known.select("digest"), "digest", "left_anti")


def read_external_metadata(spark: SparkSession, paths_by_provider: dict[str, str]) -> DataFrame:
    """Line-JSON dumps of several providers in one schema, with a ``provider`` column."""
    out = None
    for provider, path in sorted(paths_by_provider.items()):
        part = spark.read.schema(EXTERNAL_PAPER).json(path).withColumn("provider", F.lit(provider))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_result_files(spark: SparkSession, path: str, tags: dict[str, str], project: str) -> DataFrame:
    """Wide result files (ts and a column per tag) as readings; ``tags`` gives each tag's unit."""
    schema = "ts timestamp_ntz, " + ", ".join(f"`{t}` double" for t in tags)
    wide = spark.read.schema(schema).option("header", True).csv(path)
    long = wide.unpivot("ts", list(tags), "tag", "value").where("value is not null")
    units = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    return long.select("tag", "ts", "value", units[F.col("tag")].alias("unit"), F.lit(project).alias("project")).to(READING)


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append to a dataset of its own, one folder per key. Rows are dealt by key, small keys together, and Spark cuts a key's rows over tasks where they are more than one should write."""
    df.hint("rebalance", *keys).write.mode("append").partitionBy(*keys).parquet(path)
