"""Stored indexes over texts: terms with block maxima for ranked search, character grams for search inside words.

Both number documents densely per task and take ``CHUNK`` consecutive ones as a chunk, so a block of postings is (key, chunk) whatever the key's frequency: no
key is ever one group. Tables are folders of Parquet, bucketed by key; a search reads the buckets and keys that it asks for. ``append`` adds
documents as one more segment and reads nothing of the others. A chunk lies in one task, which makes its blocks whole; they are shuffled once, to be written by bucket, with
a row for the chunk's documents among them (key null, bucket -1), so that numbers are given once and nothing else is put aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.columns import words_of
from lectern.sources.scratch import scratch

CHUNK = 64
BUCKETS = 64
#: Up to this many distinct keys of a search go along as constants, which prune buckets and row groups; more are joined. The result is the same.
MAX_KEYS = 2000


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class Stored:
    """Tables below a folder, a folder of its own for each segment. A segment counts once its documents are written, which comes last; an append that ends before is
    written over by the next."""

    SCHEMAS: dict[str, str] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.segments = spark, path, 0
        last = self.table("docs").agg(F.max("segment").alias("s")).first()["s"]
        self.segments = 0 if last is None else last + 1

    def table(self, name: str) -> DataFrame:
        schema = f"{self.SCHEMAS[name]}, segment int"
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.table(name).where(F.col("segment") < self.segments).drop("segment")

    def write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/segment={self.segments}")

    def write_buckets(self, rows: DataFrame, name: str, key: str) -> None:
        """Rows by bucket and key; Spark cuts a bucket over tasks where it is more than one should write."""
        bucket = F.when(F.col(key).isNull(), -1).otherwise(bucket_of(F.col(key)))
        placed = rows.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", key, "chunk")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/segment={self.segments}")

    def written(self, name: str) -> tuple[DataFrame, DataFrame]:
        """Of the segment that is being written: the rows of keys, and those of documents."""
        new = self.table(name).where(F.col("segment") == self.segments)
        return new.where("bucket >= 0"), new.where("bucket = -1")

    def numbered(self, docs: DataFrame) -> DataFrame:
        """document_id, text, doc_no: numbers are the segment's, the task's and the row's in the task (at most 2**20 tasks and 2**28 rows in each)."""
        at = F.monotonically_increasing_id()
        number = F.lit(self.segments << 48).cast("long") + F.shiftleft(F.shiftright(at, 33), 28) + at.bitwiseAND(F.lit((1 << 28) - 1))
        return docs.select(F.col("document_id").cast("long").alias("document_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("doc_no", number)

    def put_aside(self, rows: DataFrame) -> DataFrame:
        """What several tables of a segment are made of, written once."""
        path = scratch(self.spark, "segment")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def of_keys(self, names: tuple[str, ...], key: str, wanted: DataFrame) -> list[DataFrame]:
        """Rows of bucketed tables whose key is in ``wanted`` (one column, distinct)."""
        some = [r[0] for r in wanted.limit(MAX_KEYS + 1).collect()]
        if len(some) > MAX_KEYS:
            return [self.read(n).join(wanted.withColumn("bucket", bucket_of(F.col(key))), ["bucket", key], "left_semi") for n in names]
        own = F.col(key).isin(some) if some else F.lit(False)
        if 0 < len(some) < BUCKETS:  # more keys are in nearly all buckets
            kept = self.spark.createDataFrame([(k,) for k in some], wanted.schema).select(bucket_of(F.col(key)).alias("b")).distinct()
            own &= F.col("bucket").isin([r["b"] for r in kept.collect()])
        return [self.read(n).where(own) for n in names]


def chunk_of(doc_no: Column) -> Column:
    return F.shiftright(doc_no, CHUNK.bit_length() - 1)


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each chunk, by a first column of consecutive doc_no."""
    at, held = None, []
    for batch in batches:
        chunk = batch.column(0).to_numpy() // CHUNK
        cuts = np.concatenate(([0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(chunk)])) if len(chunk) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if chunk[i] != at and held:
                yield at, pa.Table.from_batches(held)
                held = []
            at = int(chunk[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield at, pa.Table.from_batches(held)


def lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """``values`` cut at ``ends``, as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, kind))


class TextIndex(Stored):
    """Postings of terms. A block has its chunk's documents with counts and lengths, and for its maximum the largest count and the smallest length.

    Defined results: a null text has no terms but counts as a document; documents that repeat an id are scored on their own and the best stands for the id.
    """

    SCHEMAS = {
        "docs": "document_id long, doc_no long, len int",
        "terms": "term string, df long, bucket int",
        "postings": "term string, chunk long, docs array<long>, tfs array<int>, lens array<int>, n int, max_tf int, min_len int, ids array<long>, bucket int",
    }

    def append(self, docs: DataFrame) -> TextIndex:
        """Add documents (document_id, text) as one more segment."""
        words = self.numbered(docs).select("doc_no", "document_id", words_of(F.col("text")).alias("w"))
        columns = self.SCHEMAS["postings"].removesuffix(", bucket int")
        names = [c.split()[0] for c in columns.split(", ")]

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, rows in by_chunk(batches):
                rows = rows.combine_chunks()
                no, w = rows.column(0).to_numpy(), rows.column(2).combine_chunks()
                size = w.value_lengths().to_numpy()
                every = w.flatten().cast(pa.string()).dictionary_encode()
                # One number for each term and document; equal ones are counted.
                key, tf = np.unique(every.indices.to_numpy().astype(np.int64) * len(no) + np.repeat(np.arange(len(no)), size), return_counts=True)
                term, doc = key // len(no), key % len(no)
                whole = [len(no)]
                made = [pa.nulls(1, pa.string()), pa.array([chunk]), lists(whole, no, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), lists(whole, size, pa.int32()), pa.array(whole, pa.int32()), *[pa.nulls(1, pa.int32())] * 2, lists(whole, rows.column(1).combine_chunks(), pa.int64())]
                yield pa.record_batch(made, names=names)
                if len(key):
                    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
                    ends = np.append(first[1:], len(term))
                    made = [every.dictionary.take(pa.array(term[first])), pa.array(np.full(len(first), chunk)), lists(ends, no[doc], pa.int64()), lists(ends, tf, pa.int32()), lists(ends, size[doc], pa.int32())]
                    made += [pa.array(c, pa.int32()) for c in (ends - first, np.maximum.reduceat(tf, first), np.minimum.reduceat(size[doc], first))]
                    yield pa.record_batch([*made, pa.nulls(len(first), pa.list_(pa.int64()))], names=names)

        self.write_buckets(words.mapInArrow(blocks, columns), "postings", "term")
        terms, of_docs = self.written("postings")
        self.write(terms.groupBy("term", "bucket").agg(F.sum("n").alias("df")).select("term", "df", "bucket"), "terms")
        self.write(of_docs.select(F.explode(F.arrays_zip("ids", "docs", "lens")).alias("d")).select(F.col("d.ids").alias("document_id"), F.col("d.docs").alias("doc_no"), F.col("d.lens").alias("len")), "docs")
        self.segments += 1
        return self

    def size(self) -> tuple[int, float]:
        """Documents and their mean length, known until the next append."""
        if self.known[0] != self.segments:
            row = self.read("docs").agg(F.count("*").alias("n"), F.avg("len").alias("a")).first()
            self.known = (self.segments, row["n"], float(row["a"] or 1.0))
        return self.known[1:]

    known: tuple = (-1, 0, 1.0)

    def term_stats(self) -> DataFrame:
        """term, df, blocks, max_tf over the whole index."""
        return self.read("postings").where("bucket >= 0").groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("blocks"), F.max("max_tf").alias("max_tf"))

    def chunks(self, queries: DataFrame, k1: float, b: float, pairs: DataFrame | None = None) -> DataFrame:
        """query_id, chunk, bound (the most that a document of the chunk can get), parts (idf, docs, tfs, lens of each of the query's terms) and a, the mean length;
        with ``pairs`` (query_id, chunk, wanted) of these chunks alone, and of the documents in ``wanted``. The queries' blocks are read once."""
        asked = queries.select("query_id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))
        terms = asked.select("term").distinct()
        n, mean = self.size()
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        df, rows = self.of_keys(("terms", "postings"), "term", terms)
        df = df.groupBy("term").agg(F.sum("df").alias("df"))
        rows = rows.join(asked.join(df.select("term", idf.alias("idf")), "term"), "term")
        if pairs is not None:
            kept = F.filter(F.arrays_zip("docs", "tfs", "lens"), lambda p: F.array_contains(F.col("wanted"), p["docs"]))
            rows = rows.join(pairs, ["query_id", "chunk"]).withColumn("p", kept).withColumns({c: F.col(f"p.{c}") for c in ("docs", "tfs", "lens")})
        top = F.col("idf") * F.col("max_tf") * (k1 + 1) / (F.col("max_tf") + k1 * (1 - b + b * F.col("min_len") / mean))
        one = F.collect_list(F.struct("idf", "docs", "tfs", "lens"))  # of one chunk, a query's terms
        return rows.groupBy("query_id", "chunk").agg(F.sum(top).alias("bound"), one.alias("parts")).withColumn("a", F.lit(mean))

    def scored(self, chunks: DataFrame, k1: float, b: float) -> DataFrame:
        """query_id, doc_no, exact: the scores of all documents of the chunks."""
        rows = chunks.select("query_id", "a", F.explode("parts").alias("t"))
        rows = rows.select("query_id", "a", "t.idf", F.explode(F.arrays_zip("t.docs", "t.tfs", "t.lens")).alias("p"))
        rows = rows.select("query_id", "a", "idf", F.col("p.docs").alias("doc_no"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("a")))
        return rows.groupBy("query_id", "doc_no").agg(F.sum(part).alias("exact"))

    def named(self, scores: DataFrame) -> DataFrame:
        ids = scores.join(self.read("docs").select("document_id", "doc_no"), "doc_no")
        return ids.groupBy("query_id", "document_id").agg(F.round(F.max("exact"), 6).alias("score"))

    def search(self, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, seeds: int = 4) -> DataFrame:
        """query_id, document_id, score, rank: the ``k`` best by BM25 of (query_id, text).

        Of each query the chunks with the highest bounds (sums of block maxima) are scored first, ``seeds`` of them and what ``k`` documents need; their ``k``-th score is a floor, and of the other
        chunks only those whose bound reaches it are scored. Scores are rounded after the choice, so bounds give way by as much.
        """
        n = max(seeds, 2 * -(-k // CHUNK))
        order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "chunk"))  # over chunks, not documents
        chunks = self.put_aside(self.chunks(queries, k1, b).withColumn("nth", order))
        nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("exact"), "doc_no"))
        first = self.put_aside(self.scored(chunks.where(F.col("nth") <= n), k1, b))
        floor = first.withColumn("place", nth).where(F.col("place") == k).select("query_id", F.col("exact").alias("floor"))
        rest = chunks.where(F.col("nth") > n).join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-6))
        # What is below the floor by more than the rounding cannot come in.
        found = first.unionByName(self.scored(rest, k1, b)).join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("exact") >= F.col("floor") - 1e-6)).drop("floor")
        every = self.named(found)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "document_id"))
        return every.withColumn("rank", rank).where(F.col("rank") <= k)

    def scores(self, queries: DataFrame, pairs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """query_id, document_id, score of stated pairs; none for a pair without a common term."""
        at = pairs.select("query_id", "document_id").join(self.read("docs").select("document_id", "doc_no"), "document_id").select("query_id", "doc_no", chunk_of(F.col("doc_no")).alias("chunk"))
        wanted = at.groupBy("query_id", "chunk").agg(F.collect_set("doc_no").alias("wanted"))  # of one chunk
        return self.named(self.scored(self.chunks(queries, k1, b, wanted), k1, b))


def gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Every run of ``n`` (1 to 3) code points as one number; runs of different length differ."""
    size = max(0, len(codes) - n + 1)
    key = np.zeros(size, np.int64)
    for i in range(n):
        key = key << 21 | (codes[i : i + size].astype(np.int64) + 1)
    return key


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class GramIndex(Stored):
    """Which documents have which runs of one to three characters: a bit per document of a chunk.

    A quote of any length, inside words too, is looked up by its rarest runs, whose bits are put together chunk by chunk; ``contains`` decides. So there is neither a product nor a scan of
    texts that cannot match. Defined results: null and empty quotes are not found; a null text has no runs; documents that repeat an id each count.
    """

    SCHEMAS = {"docs": "document_id long, doc_no long", "grams": "gram long, chunk long, bits long, ids array<long>, bucket int", "stats": "gram long, df long"}
    RAREST = 4

    def append(self, docs: DataFrame) -> GramIndex:
        """Add documents (document_id, text) as one more segment."""
        rows = self.numbered(docs)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for at, part in by_chunk(b.slice(i, CHUNK) for b in batches for i in range(0, b.num_rows, CHUNK)):
                keys = []
                for bit, text in enumerate(part.column(2).to_pylist()):
                    codes = codes_of(text)
                    own = np.unique(np.concatenate([gram_keys(codes, n) for n in (1, 2, 3)]))
                    keys.append(np.stack([own, np.full(len(own), bit)], axis=1))
                gram, bit = np.concatenate(keys).T
                order = np.argsort(gram, kind="stable")
                gram, bit = gram[order], bit[order]
                first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
                bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), bit.astype(np.uint64)), first) if len(first) else np.zeros(0, np.uint64)
                yield pa.record_batch([pa.array([None], pa.int64()), pa.array([at]), pa.array([0]), lists([part.num_rows], part.column(1).combine_chunks(), pa.int64())], names=["gram", "chunk", "bits", "ids"])
                yield pa.record_batch([pa.array(gram[first]), pa.array(np.full(len(first), at)), pa.array(bits.view(np.int64)), pa.nulls(len(first), pa.list_(pa.int64()))], names=["gram", "chunk", "bits", "ids"])

        self.write_buckets(rows.select("doc_no", "document_id", "text").mapInArrow(blocks, "gram long, chunk long, bits long, ids array<long>"), "grams", "gram")
        grams, of_docs = self.written("grams")
        self.write(grams.groupBy("gram").agg(F.sum(F.bit_count("bits")).cast("long").alias("df")), "stats")
        numbers = of_docs.select("chunk", F.posexplode("ids").alias("i", "document_id"))
        self.write(numbers.select("document_id", (F.col("chunk") * CHUNK + F.col("i")).alias("doc_no")), "docs")
        self.segments += 1
        return self

    def gram_stats(self, n: int) -> DataFrame:
        """gram (text), df of the runs of ``n`` characters."""
        code = lambda i: F.shiftright(F.col("gram"), 21 * i).bitwiseAND(F.lit((1 << 21) - 1)) - 1
        of_size = F.shiftright("gram", 21 * (n - 1)) > 0
        rows = self.read("stats").where(of_size if n == 3 else of_size & (F.shiftright("gram", 21 * n) == 0))
        each = [F.decode(F.unhex(F.lpad(F.hex(code(i)), 8, "0")), "UTF-32") for i in range(n - 1, -1, -1)]
        return rows.groupBy(F.concat(*each).alias("gram")).agg(F.sum("df").alias("df"))

    def keyed(self, quotes: DataFrame) -> DataFrame:
        """query_id, quote, gram: the distinct runs of each quote, of three characters or of all where it is shorter."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
                own = [np.unique(gram_keys(codes_of(q), min(3, len(q)))) for q in batch.column(1).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.record_batch([*batch.take(row).columns, pa.array(np.concatenate(own))], names=["query_id", "quote", "gram"])

        asked = quotes.where("quote is not null and quote <> ''").select(F.col("query_id").cast("long").alias("query_id"), "quote")
        return asked.mapInArrow(run, "query_id long, quote string, gram long")

    def candidates(self, quotes: DataFrame) -> DataFrame:
        """query_id, quote, document_id: documents that have the rarest runs of a quote, each of them."""
        keyed = self.keyed(quotes)
        df = self.read("stats").groupBy("gram").agg(F.sum("df").alias("df"))
        nth = F.row_number().over(W.partitionBy("query_id", "quote").orderBy("df", "gram"))
        rare = keyed.join(df, "gram", "left").withColumn("nth", nth).where(F.col("nth") <= self.RAREST)
        rare = rare.withColumn("n", F.count("*").over(W.partitionBy("query_id", "quote")))
        (rows,) = self.of_keys(("grams",), "gram", rare.select("gram").distinct())
        both = rare.join(rows.select("gram", "chunk", "bits"), "gram").groupBy("query_id", "quote", "chunk", "n").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("have"))
        both = both.where("have = n and bits <> 0")
        bit = F.explode(F.sequence(F.lit(0), F.lit(CHUNK - 1)))
        each = both.select("query_id", "quote", "chunk", "bits", bit.alias("i")).where(F.expr("shiftrightunsigned(bits, i) & 1") == 1)
        return each.select("query_id", "quote", (F.col("chunk") * CHUNK + F.col("i")).alias("doc_no")).join(self.read("docs"), "doc_no").select("query_id", "quote", "document_id")

    def find(self, quotes: DataFrame, docs: DataFrame) -> DataFrame:
        """query_id, document_id, pos: first place of each quote (query_id, quote) in each of ``docs`` (document_id, text) that has it."""
        got = self.put_aside(self.candidates(quotes).distinct()).join(docs.select("document_id", "text"), "document_id")
        return got.where(F.contains("text", "quote")).select("query_id", "document_id", F.instr("text", F.col("quote")).alias("pos"))
