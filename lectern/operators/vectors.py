"""Approximate vector search: an inverted file of product codes, exact at the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.udfs import cosine_batch
from lectern.operators.index import Stored

SAMPLE = 8192  # vectors that the lists and codes are fitted on, at most; every vector is indexed
MAX_LISTS = 4096
PIECE = 4  # components of a code's byte
GROUP_ROWS = 1 << 18  # codes that a task holds


def usual_length(rows: DataFrame) -> int:
    """The length that most vectors have; others cannot be compared with them."""
    most = rows.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return most["d"] if most else 0


def means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """``k`` centres (fewer, if there are fewer rows) by repeated assignment and averaging."""
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        at = nearest_centre(rows, centres)
        n = np.bincount(at, minlength=len(centres))
        for j in range(rows.shape[1]):
            total = np.bincount(at, rows[:, j], len(centres))
            centres[n > 0, j] = total[n > 0] / n[n > 0]
    return centres


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T * 2 - (centres**2).sum(1)).argmax(1) if len(centres) else np.zeros(len(rows), np.int64)


def directions(array: pa.Array, dim: int) -> np.ndarray:
    x = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class VectorIndex(Stored):
    """Cosine neighbours by lists of codes. A vector's direction goes to the list of its nearest centre, and what is left over to one byte for each four components.

    A search reads the codes of a share of the lists, adds up table values, takes the ``rerank`` best of each query, and measures these alone exactly.
    Defined results: null vectors, those without length or of another number of components than most take no part; documents that repeat an id count as one, the nearest.
    """

    SCHEMAS = {"docs": "n long", "codes": "list int, document_id long, code binary"}

    def __init__(self, spark: SparkSession, path: str, sample: DataFrame, lists: int | None = None, seed: int = 42):
        super().__init__(spark, path)
        rng = np.random.default_rng(seed)
        self.dim = usual_length(sample)
        rows = self.usable(sample)
        n = rows.count()
        some = np.array([r["embedding"] for r in rows.select("embedding").orderBy(F.xxhash64("document_id"), "document_id").limit(SAMPLE).collect()], np.float64).reshape(-1, max(self.dim, 1))
        some = some / np.linalg.norm(some, axis=1, keepdims=True)
        self.centres = means(some, lists or min(MAX_LISTS, max(1, int(np.sqrt(n)))), rng)
        rest = some - self.centres[nearest_centre(some, self.centres)] if len(some) else some
        self.cuts = list(range(0, self.dim, PIECE))
        self.books = [means(rest[:, a : a + PIECE], 256, rng, 5) for a in self.cuts] if len(some) else []

    def usable(self, rows: DataFrame) -> DataFrame:
        v = F.transform("embedding", lambda x: x.cast("double"))
        sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
        return rows.where((F.size("embedding") == self.dim) & (F.size("embedding") > 0)).where(sound)

    def append(self, embeddings: DataFrame) -> VectorIndex:
        """Add (document_id, embedding) as one more segment, coded as the index was fitted."""
        dim, centres, books, cuts = self.dim, self.centres, self.books, self.cuts

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
                x = directions(batch.column(1), dim)
                at = nearest_centre(x, centres)
                rest = x - centres[at]
                codes = np.stack([nearest_centre(rest[:, a : a + PIECE], b) for a, b in zip(cuts, books, strict=True)], axis=1).astype(np.uint8)
                yield pa.record_batch([pa.array(at.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "document_id", "code"])

        rows = self.usable(embeddings).select(F.col("document_id").cast("long").alias("document_id"), "embedding").where("document_id is not null")
        coded = self.put_aside(rows.mapInArrow(code, self.SCHEMAS["codes"]))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.write(coded.repartitionByRange(parts, "list", F.xxhash64("document_id")).sortWithinPartitions("list"), "codes")
        self.write(coded.agg(F.count(F.lit(1)).alias("n")), "docs")
        self.segments += 1
        return self

    def candidates(self, queries: DataFrame, rerank: int, probe: float) -> DataFrame:
        """query_id, document_id: the ``rerank`` best by codes in the share ``probe`` of the lists, those with the nearest centres."""
        dim, centres, books, cuts = self.dim, self.centres, self.books, self.cuts
        lists = max(1, int(np.ceil(probe * len(centres))))
        n = self.read("docs").agg(F.sum("n").alias("n")).first()["n"] or 0
        groups = max(1, -(-n // GROUP_ROWS), min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 4096)))
        cols = "g int, kind int, list int, ids array<long>, x binary"
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        message = lambda *row: pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["g", "kind", "list", "ids", "x"])

        def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Stretches of codes of one list and group."""
            for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
                g, at = batch.column(3).to_numpy(), batch.column(0).to_numpy()
                for both in np.unique(np.stack([g, at], axis=1), axis=0):
                    rows = np.flatnonzero((g == both[0]) & (at == both[1]))
                    yield message(int(both[0]), 0, int(both[1]), batch.column(1).to_numpy()[rows], b"".join(batch.column(2).take(pa.array(rows)).to_pylist()))

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, 128) for b in batches for i in range(0, b.num_rows, 128)):
                yield message(0, 1, 0, batch.column(0).to_numpy(), directions(batch.column(1), dim).tobytes())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []
            for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                if row["g"] != at:
                    at, held = row["g"], []
                ids = np.array(row["ids"], np.int64)
                if row["kind"] == 0:
                    held.append((row["list"], ids, np.frombuffer(row["x"], np.uint8).reshape(len(ids), -1)))
                    continue
                x = np.frombuffer(row["x"]).reshape(len(ids), dim)
                near = x @ centres.T
                floor = np.partition(near, len(centres) - lists, axis=1)[:, len(centres) - lists]
                tables = [x[:, a : a + PIECE] @ b.T for a, b in zip(cuts, books, strict=True)]
                best_s, best_d = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
                for number, docs, codes in held:
                    which = np.flatnonzero(near[:, number] >= floor)
                    if not len(which):
                        continue
                    s = np.full((len(ids), len(docs)), -np.inf)
                    s[which] = near[which, number, None] + sum(t[which][:, codes[:, m]] for m, t in enumerate(tables))
                    best_s, best_d = np.concatenate((best_s, s), axis=1), np.concatenate((best_d, np.broadcast_to(docs, s.shape)), axis=1)
                    if best_s.shape[1] > 4 * rerank + 4096:
                        top = np.argpartition(-best_s, rerank, axis=1)[:, :rerank]
                        best_s, best_d = np.take_along_axis(best_s, top, 1), np.take_along_axis(best_d, top, 1)
                if best_s.shape[1] > rerank:
                    top = np.argpartition(-best_s, rerank, axis=1)[:, :rerank]
                    best_s, best_d = np.take_along_axis(best_s, top, 1), np.take_along_axis(best_d, top, 1)
                q, j = np.nonzero(np.isfinite(best_s))
                yield pa.record_batch([pa.array(ids[q]), pa.array(best_d[q, j]), pa.array(best_s[q, j])], names=["query_id", "document_id", "near"])

        rows = self.read("codes").withColumn("g", F.pmod(F.xxhash64("list", F.pmod(F.xxhash64("document_id"), F.lit(-(-groups // len(centres)) if len(centres) else 1))), F.lit(groups)).cast("int"))
        mine = rows.select("list", "document_id", "code", "g").mapInArrow(tiles, cols)
        every = self.usable(queries).select(F.col("query_id").cast("long").alias("query_id"), "embedding").mapInArrow(asked, cols)
        every = every.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("g", "kind", "list", "ids", "x")
        found = mine.union(every).repartition(groups, "g").sortWithinPartitions("g", "kind").mapInArrow(scan, "query_id long, document_id long, near double")
        nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "document_id"))
        return found.withColumn("nth", nth).where(F.col("nth") <= rerank).select("query_id", "document_id")

    def search(self, queries: DataFrame, embeddings: DataFrame, k: int = 10, rerank: int = 100, probe: float = 0.65) -> DataFrame:
        """query_id, document_id, score, rank: cosine top ``k`` of (query_id, embedding) among the candidates, measured on ``embeddings``.

        On directions spread evenly in 64 dimensions a share of 0.65 of the lists is what a recall of 0.9 takes, at 2,000 rows as at 50,000; where vectors cluster a few lists do.
        """
        if not self.segments or not len(self.centres):
            return self.spark.createDataFrame([], "query_id long, document_id long, score double, rank int")
        pairs = self.candidates(queries, rerank, probe).distinct()
        a = self.usable(queries).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("a"))
        b = self.usable(embeddings).select(F.col("document_id").cast("long").alias("document_id"), F.col("embedding").alias("b"))
        scored = pairs.join(b, "document_id").join(a, "query_id").select("query_id", "document_id", F.round(cosine_batch("a", "b"), 6).alias("score"))
        best = scored.groupBy("query_id", "document_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "document_id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k)
