"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources get weights 1, 2, 3, repeating, in code point order (null last), and share all words. A source stops at
``max_epochs`` times its own size and its excess goes to the others by weight, until none is above. That fixed point is
closed: in the order of cap over weight, the sources that stop are a prefix, so one window over the per-source totals
finds the level. A source is then repeated whole times, and the rest of its target is taken from its documents in the
order of a seeded hash, down to a cutoff hash. The cutoff is found from sums by the hash's first two digits, then by the
next two, then within one bucket of four, so a window sees at most 256 sums of a source, and never its documents. The document at the cutoff gives the words
still missing, so that a source meets its target to the word.

Defined results: a null text has no words; a null source is a source of its own, last in order; a source without words
has target 0; rows that repeat id and text at the cutoff share what is missing to the word, whatever the table's splits; without any
words all targets are 0; an empty table gives an empty result; columns of any name are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._common import WORD, stage

#: Above this many sources the plan is joined by shuffle, not broadcast.
MAX_BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, max_epochs: int = 3) -> DataFrame:
    """source, source_size, target for a table of (source, source_size) with one row per source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = (F.row_number().over(by_name) - 1) % 3 + 1
    cap = F.col("source_size") * max_epochs
    rows = totals.select("source", "source_size", weight.cast("double").alias("weight"), cap.cast("double").alias("cap"))
    by_level = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, W.unboundedFollowing)
    words = F.sum("source_size").over(W.partitionBy())
    level = (words - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    common = F.max(F.when(F.col("free"), F.col("level"))).over(W.partitionBy())
    # From the first free source on levels can only fall, so its level is the largest of the free ones.
    return rows.select("source", "source_size", F.coalesce(F.least(F.col("cap"), common * F.col("weight")), F.col("cap")).alias("target"))


def hash_order(doc_id: Column, text: Column, seed: int) -> Column:
    """Hash of id and text, so that only rows equal in both share it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def crossing(parts: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """source, bucket, missing: the bucket of (source, bucket, size) in which a source's running sum first exceeds ``wanted``'s missing."""
    run = F.sum("size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    rows = parts.withColumn("upto", run).join(wanted, F.col("source").eqNullSafe(F.col(key)))
    before = F.col("upto") - F.col("size")
    rows = rows.where((F.col("upto") > F.col("missing")) & (before <= F.col("missing")))
    return rows.select("source", "bucket", (F.col("missing") - before).alias("missing"))


def plan(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """One row per source from a table of (source, size, h): source_size, target, whole repetitions, cutoff hash, words missing and rows at the cutoff."""
    digits = F.substring("h", 1, 4)
    buckets = stage(sizes.groupBy("source", digits.alias("bucket")).agg(F.sum("size").alias("size")), "buckets")
    goals = targets(buckets.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs)
    words = F.round("target").cast("long")
    goals = goals.withColumn("whole", F.coalesce(F.expr("cast(round(target) as long) div nullif(source_size, 0)"), F.lit(0)))
    goals = goals.withColumn("extra", words - F.col("whole") * F.col("source_size"))
    goals = stage(goals, "goals")
    first = buckets.groupBy("source", F.substring("bucket", 1, 2).alias("bucket")).agg(F.sum("size").alias("size"))
    edge = crossing(first, goals.select(F.col("source").alias("g_source"), F.col("extra").alias("missing")), "g_source")
    within = buckets.join(
        edge.select(F.col("source").alias("f_source"), F.col("bucket").alias("f_bucket")),
        F.col("source").eqNullSafe(F.col("f_source")) & (F.substring("bucket", 1, 2) == F.col("f_bucket")),
    ).select("source", "bucket", "size")
    edge = crossing(within, edge.select(F.col("source").alias("g_source"), "missing"), "g_source")
    edge = edge.select(F.col("source").alias("e_source"), "bucket", "missing")
    inside = sizes.select("source", "h", "size", F.substring("h", 1, 4).alias("s_bucket"))
    inside = inside.join(edge, inside["source"].eqNullSafe(edge["e_source"]) & (inside["s_bucket"] == edge["bucket"]))
    inside = inside.groupBy("source", "h").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("missing").alias("missing"))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("h").rowsBetween(W.unboundedPreceding, 0))
    inside = inside.withColumn("upto", upto).where((F.col("upto") > F.col("missing")) & (F.col("upto") - F.col("size") <= F.col("missing")))
    cut = inside.select(F.col("source").alias("c_source"), F.col("h").alias("cutoff"), (F.col("missing") - F.col("upto") + F.col("size")).alias("rest"), F.col("n").alias("cut_rows"))
    return goals.join(cut, goals["source"].eqNullSafe(cut["c_source"]), "left").drop("c_source")


def shared_cutoff(rows: DataFrame) -> DataFrame:
    """``rows`` at their sources' cutoffs with ``extra``: equal parts of what is missing, and one word more for the first ones in the order of a hash of all columns.

    Rows are counted by source, hash and task, and numbered within these, after the rows of the groups before; so copies may be any part of the table and
    are never one group, and which of them a task holds does not matter, since rows of one hash are the same.
    """
    rows = stage(rows.withColumns({"rh": F.xxhash64(F.to_json("row")), "task": F.spark_partition_id()}), "cutoff")
    groups = rows.groupBy("p_source", "rh", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("p_source").orderBy("rh", "task").rowsBetween(W.unboundedPreceding, -1))
    groups = groups.select(F.col("p_source").alias("g_source"), F.col("rh").alias("g_rh"), F.col("task").alias("g_task"), F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("p_source", "rh", "task").orderBy("h"))
    same = F.col("p_source").eqNullSafe(F.col("g_source")) & (F.col("rh") == F.col("g_rh")) & (F.col("task") == F.col("g_task"))
    rows = rows.withColumn("nth", nth).join(groups, same)
    more = F.when(F.col("before") + F.col("nth") <= F.expr("rest % cut_rows"), 1).otherwise(0)
    return rows.withColumn("extra", F.expr("rest div cut_rows") + more).drop("rh", "task", "nth", "before", "g_source", "g_rh", "g_task")


def planned(docs: DataFrame, max_epochs: int, seed: int) -> DataFrame:
    """``row`` (all columns of ``docs``) with size, source_size, target, whole (repetitions), extra (words of one more, partial or whole) and taken.

    The plan has a row per source; it is broadcast if it has at most ``MAX_BROADCAST_SOURCES`` rows, and joined by shuffle (where
    Spark splits a hot source) beyond. Rows equal in id and text that share the cutoff share what is missing, see ``shared_cutoff``.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), "source", word_count(F.col("text")).alias("size"), hash_order(F.col("doc_id"), F.col("text"), seed).alias("h"))
    sizes = stage(own.select("source", "size", "h"), "sizes")
    p = stage(plan(sizes, max_epochs), "plan").withColumnRenamed("source", "p_source")
    if p.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        p = F.broadcast(p)
    rows = own.join(p.drop("extra"), F.col("source").eqNullSafe(F.col("p_source")))
    extra = F.when(F.col("h") < F.col("cutoff"), F.col("size")).when(F.col("h") == F.col("cutoff"), F.col("rest")).otherwise(0).cast("long")
    if p.where("cut_rows > 1").isEmpty():
        rows = rows.withColumn("extra", extra)
    else:
        tied = F.coalesce((F.col("h") == F.col("cutoff")) & (F.col("cut_rows") > 1), F.lit(False))
        rows = rows.where(~tied).withColumn("extra", extra).unionByName(shared_cutoff(rows.where(tied)))
    rows = rows.select("row", "size", "source_size", "target", "whole", "extra")
    return rows.withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` with mix_size, mix_source_size, mix_target, mix_whole, mix_extra and mix_taken, as ``planned`` has them.

    Columns of ``docs`` with these names give way.
    """
    added = ("size", "source_size", "target", "whole", "extra", "taken")
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in {f"mix_{a}" for a in added}]
    return planned(docs, max_epochs, seed).select(*own, *[F.col(a).alias(f"mix_{a}") for a in added])


def repeat_rows(docs: DataFrame, max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as the mix takes them; one at a source's cutoff
    holds its first words up to what is taken, space-joined. All columns of ``docs`` stay, whatever their names."""
    rows = planned(docs, max_epochs, seed)
    none = F.col("size") == 0
    full = F.col("whole") + F.when(~none & (F.col("extra") == F.col("size")), 1).otherwise(0)
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    times = F.concat(F.array_repeat(F.lit(0).cast("long"), full.cast("int")), F.when(part, F.array(F.col("extra"))).otherwise(F.array().cast("array<long>")))
    rows = rows.select("row", F.explode(times).alias("cut"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), 0), 1, F.greatest(F.col("cut"), F.lit(1)).cast("int")), " ")
    cut = F.col("cut") > 0
    fix = {"text": F.when(cut, head).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        fix["n_chars"] = F.when(cut, F.length(head).cast("long")).otherwise(F.col("row.n_chars"))
    return rows.select(*[fix.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
