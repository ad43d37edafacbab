"""Search: full text, quotes, vectors, their blend, commands."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.columns import words_of
from lectern.operators.index import GramIndex
from lectern.operators.vectors import usual_length
from lectern.sources.scratch import scratch


def top_k(rows: DataFrame, k: int, score: str = "score", key: str = "query_id", tie: str = "document_id") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


#: Up to this many distinct terms of queries go along as constants; more are joined. The result is the same.
MAX_TERMS = 2000


def fulltext_search(docs: DataFrame, queries: DataFrame, k: int | None = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, document_id, score, rank by BM25 over (document_id, text) and (query_id, text); all that match without ``k``.

    Only the queries' own terms are kept of a text's words before they become rows.
    """
    words = docs.select("document_id", words_of(F.col("text")).alias("w"))
    whole = words.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("avg_len"))  # one row
    asked = queries.select("query_id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))
    terms = asked.select("term").distinct()
    some = [r["term"] for r in terms.limit(MAX_TERMS + 1).collect()]
    kept = F.filter("w", lambda x: x.isin(some)) if len(some) <= MAX_TERMS else F.col("w")
    rows = words.select("document_id", F.size("w").alias("len"), F.explode(kept).alias("term"))
    if len(some) > MAX_TERMS:
        rows = rows.join(terms, "term", "left_semi")
    tf = rows.groupBy("term", "document_id", "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = asked.join(tf, "term").join(df, "term").join(F.broadcast(whole))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    got = rows.groupBy("query_id", "document_id").agg(F.round(F.sum(part), 6).alias("score"))
    return top_k(got, k) if k else got


def quote_search(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """query_id, document_id, pos: quotes of any length found in documents letter for letter, inside words too, by an index of character runs made for the call.

    Keep a ``GramIndex`` where more than one search goes to the same documents.
    """
    spark = docs.sparkSession
    return GramIndex(spark, scratch(spark, "grams")).append(docs).find(quotes, docs)


def search_in_document(blocks: DataFrame, document_id: int, needle: str) -> DataFrame:
    """document_id, page_index, block_index, pos: every occurrence in one paper, whatever the case, none overlapping."""
    low = needle.lower()
    rows = blocks.where(F.col("document_id") == document_id).where(F.contains(F.lower("text"), F.lit(low)))
    parts = F.split(F.lower("text"), F.lit(r"\Q" + low.replace(r"\E", r"\E\\E\Q") + r"\E"), -1)
    ends = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(1 - len(low))) + len(low) + F.length(p))))
    return rows.select("document_id", "page_index", "block_index", F.explode(ends).alias("pos"))


GROUP_ROWS = 1 << 16  # vectors that a task of the exact search holds
TILE = "g long, kind int, ids array<long>, x binary"


def vector_search(embeddings: DataFrame, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """query_id, document_id, score, rank: exact cosine top k of (document_id, embedding) for a stated query set (query_id, embedding); all scores without ``k``.

    Null vectors and those of another length than most take no part, nor do queries of another length. Vectors are dealt to groups that a task holds; batches of queries go to every group and stream by, as matrix
    products, and a task keeps its own k best of each query.
    """
    spark = embeddings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, dim = embeddings.count(), usual_length(embeddings)
    groups = max(-(-n // GROUP_ROWS), min(parts, -(-n // 256)), 1)

    def tiles(kind: int, rows: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                row = (0, kind, batch.column(0).to_numpy(), x.tobytes())
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["g", "kind", "ids", "x"])

        return run

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            if row["g"] != at:
                at, held = row["g"], []
            ids = np.array(row["ids"])
            x = np.frombuffer(row["x"]).reshape(len(ids), -1)
            if row["kind"] == 0:
                held.append((ids, x, np.linalg.norm(x, axis=1)))
                continue
            size = np.linalg.norm(x, axis=1)
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for d_ids, d, d_size in held:
                both = size[:, None] * d_size[None]
                s = np.where(both > 0, np.round(x @ d.T / np.where(both > 0, both, 1), 6), -np.inf)
                cut = np.sort(s, axis=1)[:, -min(k, s.shape[1])] if k else np.full(len(s), -np.inf)
                i, j = np.nonzero((s >= cut[:, None]) & np.isfinite(s))
                best = tuple(np.concatenate(c) for c in zip(best, (i, d_ids[j], s[i, j]), strict=True))
                if k:
                    order = np.lexsort((best[1], -best[2], best[0]))
                    i = best[0][order]
                    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
                    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
                    best = tuple(c[order][rank < k] for c in best)
            yield pa.record_batch([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "document_id", "score"])

    rows = embeddings.where(F.size("embedding") == dim).select(F.col("document_id").cast("long").alias("document_id"), "embedding")
    asked = queries.where(F.size("embedding") == dim).select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    mine = rows.mapInArrow(tiles(0, 256), TILE).withColumn("g", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(groups)))
    every = asked.mapInArrow(tiles(1, 256), TILE).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    cols = ["g", "kind", "ids", "x"]
    got = mine.select(*cols).union(every.select(*cols)).repartition(groups, "g").sortWithinPartitions("g", "kind").mapInArrow(scan, "query_id long, document_id long, score double")
    return top_k(got, k) if k else got


Lister = Callable[[DataFrame, int], DataFrame]


def hybrid_search(queries: DataFrame, lists: dict[str, Lister], of_pairs: dict[str, Callable[[DataFrame], DataFrame]], context: Callable[[DataFrame], DataFrame], weights: dict[str, float], k: int = 10, depth: int = 256, grow: int = 8) -> DataFrame:
    """query_id, document_id, every part of the score, score, rank: the ``k`` best of a weighted sum of parts, by a threshold over their sorted lists.

    ``lists`` gives for some parts the first ``depth`` rows (query_id, document_id, score), best first, of the queries it is handed. The parts in ``of_pairs`` make a document a
    candidate and are known there for stated pairs (query_id, document_id) too; text and vector scores are divided by their query's largest. All others are 0/1 columns of ``context``.
    A round takes the lists' first rows, scores all documents in them fully, and closes each query whose ``k``-th score is above what a document in none of them can reach: the weighted
    sum of the lists' last values (nothing where a list has ended, the whole weight for a part without list). The rest goes on ``grow`` times as deep. No weight is negative.
    """
    spark = queries.sparkSession

    def aside(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    scaled = [c for c in of_pairs if c in ("text", "vector")]
    left, tops, before = queries.select("query_id").distinct(), [], None
    open_lists = list(lists)
    while True:
        rows = None
        for name in open_lists:
            part = lists[name](left, depth).select("query_id", "document_id", F.lit(name).alias("part"), F.col("score").cast("double").alias("score"))
            rows = part if rows is None else rows.union(part)
        if before is not None:  # lists that have ended for every query left are as they were
            ended = before.where(~F.col("part").isin(open_lists)).join(left, "query_id", "left_semi")
            rows = ended if rows is None else rows.union(ended)
        rows = aside(rows, "lists")
        its = lambda name, c: F.when(F.col("part") == name, c)
        ends = rows.groupBy("query_id").agg(*[f(its(n, c)).alias(f"{n}_{a}") for n in lists for f, c, a in ((F.count, F.col("score"), "n"), (F.min, F.col("score"), "last"), (F.max, F.col("score"), "most"))])
        ends = aside(ends, "ends")
        pairs = rows.select("query_id", "document_id").distinct()
        values = rows.where(F.col("part").isin(*of_pairs))
        for name, known in of_pairs.items():
            cut = ends.where(F.col(f"{name}_n") >= depth).select("query_id")
            missing = pairs.join(cut, "query_id", "left_semi").join(rows.where(F.col("part") == name), ["query_id", "document_id"], "left_anti")
            values = values.union(known(missing).select("query_id", "document_id", F.lit(name), F.col("score").cast("double")))
        found = values.groupBy("query_id", "document_id").agg(*[F.max(its(n, F.col("score"))).alias(n) for n in of_pairs])
        found = found.join(ends, "query_id")
        for name in scaled:
            found = found.withColumn(name, F.try_divide(F.col(name), F.col(f"{name}_most")))
        found = found.select("query_id", "document_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in of_pairs])
        found = found.join(context(found.select("query_id", "document_id")), ["query_id", "document_id"], "left")
        parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in weights]
        score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
        best = aside(top_k(found.select("query_id", "document_id", *parts).withColumn("score", F.round(score, 6)), k), "best")

        def next_of(name: str) -> Column:
            last = F.col(f"{name}_last")
            if name in scaled:  # where even the best is not above 0, dividing by it turns the order: to the list's end then
                last = F.when(F.col(f"{name}_most") > 0, last / F.col(f"{name}_most")).otherwise(1e12)
            return F.when(F.col(f"{name}_n") < depth, 0.0).otherwise(F.greatest(last, F.lit(0.0)))

        bound = sum((next_of(c) * w if c in lists else F.lit(float(w)) for c, w in weights.items()), F.lit(0.0))
        ended = [F.col(f"{n}_n") < depth for n in of_pairs]
        state = ends.withColumn("bound", bound).withColumn("ended", reduce(Column.__and__, ended))
        kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        state = state.join(kth, "query_id", "left")
        # Scores are rounded to six places, so a bound gives way by as much.
        still = state.where(~F.col("ended") & (F.col("kth").isNull() | (F.col("bound") + 1e-6 >= F.col("kth")))).select("query_id")
        still = aside(still, "left")
        if still.isEmpty():
            tops.append(best)
            break
        tops.append(best.join(still, "query_id", "left_anti"))
        more = state.join(still, "query_id", "left_semi").agg(*[F.max((F.col(f"{n}_n") >= depth).cast("int")).alias(n) for n in lists]).first()
        open_lists = [n for n in lists if more[n]]
        left, depth, before = still, depth * grow, rows
    out = reduce(DataFrame.unionByName, tops)
    return out.select("query_id", "document_id", *[F.round(c, 6).alias(c) for c in weights], "score", "rank")


def filter_commands(items: DataFrame, needle: str) -> DataFrame:
    """Items whose search text has every token of ``needle``, whatever the case."""
    out = items
    for t in re.split(r"\s+", needle.strip().lower()):
        out = out.where(F.contains(F.lower("search_text"), F.lit(t)))
    return out
