"""A Katz back-off language model of any order (three words by default), fitted and applied in Spark.

Model. Counts up to ``K`` are discounted by Good-Turing, per order; larger counts are kept. An n-gram seen in training has its discounted
relative frequency; an unseen one has the probability of its last n - 1 words times the back-off weight of its history, which is the
mass that discounting freed over the lower-order mass of the words not seen after it, so every history sums to one exactly
(all unknown words together are one class, with the unigram mass that discounting freed). A history without a discounted
follower, and every hot one, counts one follower more than it had, which is never seen. A history not seen at all
has weight one. Texts start with as many start marks as the order asks for.

Jobs. (1) Documents are read in batches of bounded size; a batch is stored as a token stream of local numbers, and its words' hashes and counts.
(2) Batch vocabularies are dealt by hash range, added up, and answered: each batch gets the corpus counts and a number of each of its words.
(3) Order by order, each batch evaluates the orders below (recursively, per distinct n-gram) and deals its distinct n-grams to tables partitioned by history, once
each with training count, occurrences and the count of their last n - 1 words. An n-gram's history is the number of an n-gram of the order below. A history that occurs once in
the whole corpus has one follower, which its batch knows, so it is dealt to no table. A history above a tenth of a table is hot: it is spread by word
over as many parts as its count asks for. (4) A table's task adds up its n-grams and answers each batch: counts, numbers, and, for histories with unseen
followers there, the sums that their back-off weights need. Sums of hot histories are added up in Spark and joined to the batches that ask for them.
(5) With the answers of all orders each batch adds up its documents.
Batches and answers are staged in buckets by batch, so that each step joins a batch with its answers where they lie: no shuffle, no second copy on disk.
Only single rows of sums (counts of counts, sizes) reach the driver. One n-gram's row is dealt once per batch, not once per occurrence. Staged tables and shuffles
go as soon as the step that reads them is done.

Defined results: a null text counts as empty, which is its end token alone; a null id is trained on and scored; equal rows each count
and each get a row; without training rows every probability is one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import as_bytes, chunks, partitions, remainder, shared_dir, tidied, unstage

K = 5
END = 1  # the hash of the end token
BATCH_BYTES = 9 << 19  # of text
TABLE_TOKENS = 1_300_000
BUCKET_BATCHES = 8  # batches of one bucket of a staged table, about
SPAN = 28  # bits of a number below its table's
KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)


def freeze(*arrays: np.ndarray) -> bytes:
    """Non-negative integer arrays as compressed bytes, each in its smallest type and by byte planes."""
    parts = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = next(i for i, t in enumerate(KINDS) if top <= np.iinfo(t).max)
        raw = np.ascontiguousarray(a.astype(KINDS[kind])).view(np.uint8).reshape(-1, 1 << kind).T.tobytes()
        parts += [bytes([kind]), len(a).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def thaw(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        size = n << kind
        planes = np.frombuffer(raw, np.uint8, size, at + 9).reshape(1 << kind, n)
        out.append(np.ascontiguousarray(planes.T).view(KINDS[kind]).ravel().astype(np.int64 if kind < 3 else np.uint64))
        at += 9 + size
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for counts r = 0..K from the numbers of types n[r] with count r, r up to K + 1; one half off where Good-Turing is not defined."""
    d = np.array([1.0, *((r - 0.5) / r for r in range(1, K + 1))])
    if (n[1 : K + 2] > 0).all():
        a = (K + 1) * n[K + 1] / n[1]
        good = np.array([((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if a < 1 else -1.0 for r in range(1, K + 1)])
        if ((good > 0) & (good < 1)).all():
            d[1:] = good
    return d


@dataclass(frozen=True)
class Unigrams:
    """Discounted word probabilities as a function of the training count; count 0 is the class of unknown words."""

    total: int
    types: int
    d: np.ndarray
    unknown: float
    scale: float

    @staticmethod
    def of(total: int, types: int, n: np.ndarray) -> Unigrams:
        d = discounts(n)
        free = float(sum(r * n[r] * (1 - d[r]) for r in range(1, K + 1)))
        if not total:
            return Unigrams(0, 0, d, 1.0, 1.0)
        if free > 0:
            return Unigrams(total, types, d, free / total, 1.0)
        return Unigrams(total, types, d, 0.5 / (total + 0.5), total / (total + 0.5))

    def p(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= K, self.d[np.minimum(c, K)], 1.0)
        return np.where(c > 0, self.scale * d * c / max(self.total, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.types + 1)))


def encode(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged tables of batches: (batch, doc_ids, held, data, n_train, n_train_docs, n_docs, n_tokens) and (batch, data, n_types)."""

    def shaped(rows: list[tuple]) -> list[dict]:
        ids, held, texts = zip(*rows, strict=True)
        raw = pa.array(texts, pa.large_binary())
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.Array.from_buffers(pa.large_string(), len(raw), raw.buffers())))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.large_binary()).to_pylist()
        # The end token takes the place of the empty string, which the split gives at the borders of texts.
        hashes = np.array([*(END if w == b"" else xxhash.xxh64_intdigest(w) for w in distinct), END], np.uint64)
        types, rank = np.unique(hashes, return_inverse=True)
        code = words.indices.to_numpy()
        real = np.array([w != b"" for w in distinct] or [False])[code] if len(code) else np.zeros(0, bool)
        upto = np.concatenate(([0], np.cumsum(real)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        n = np.diff(upto)
        sizes = n + 1
        tokens = np.full(int(sizes.sum()), rank[-1])
        tokens[np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)] = rank[:-1][code[real]] if len(code) else 0
        train = np.repeat(~np.array(held), sizes)
        seen, every = np.bincount(tokens[train], minlength=len(types)), np.bincount(tokens, minlength=len(types))
        used = np.cumsum(every > 0) - 1  # an empty string alone leaves no type
        keep = every > 0
        often = np.argsort(-every[keep], kind="stable")  # small numbers for frequent words take less room
        place = np.empty(len(often), np.int64)
        place[often] = np.arange(len(often))
        one = {"part": "tokens", "doc_ids": list(ids), "held": list(held), "data": freeze(sizes, place[used[tokens]], often), "n_train": int(train.sum()), "n_train_docs": int((~np.array(held)).sum()), "n_docs": len(ids), "n_tokens": len(tokens), "n_types": 0}
        return [one, {**one, "part": "words", "doc_ids": [], "held": [], "data": freeze(types[keep], seen[keep], every[keep]), "n_types": int(keep.sum())}]

    numbers = ("n_train", "n_train_docs", "n_docs", "n_tokens", "n_types", "batch")
    schema = pa.schema([("part", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("data", pa.binary()), *((c, pa.int64()) for c in numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for i in range(0, b.num_rows, 256) for s in [b.slice(i, 256)] for r in zip(s.column(0).to_pylist(), s.column(2).to_pylist(), as_bytes(s.column(1)), strict=True))
        for k, some in enumerate(chunks(rows, lambda r: len(r[2]) + 8, BATCH_BYTES)):
            yield pa.RecordBatch.from_pylist([{**r, "batch": (TaskContext.get().partitionId() << 33) + k} for r in shaped(some)], schema)
            pa.default_memory_pool().release_unused()

    held = F.coalesce(remainder(F.col("doc_id").cast("long"), 5) == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held"))
    path = f"{shared_dir(docs.sparkSession)}/encoded-{uuid.uuid4().hex}"
    found = rows.mapInArrow(run, "part string, doc_ids array<long>, held array<boolean>, data binary, " + ", ".join(f"{c} long" for c in numbers))
    with tidied(docs.sparkSession):
        found.write.partitionBy("part").option("compression", "none").parquet(path)
    out = []
    for part in ("tokens", "words"):
        one = docs.sparkSession.read.schema(found.drop("part").schema).parquet(f"{path}/part={part}") if not found_none(docs, path, part) else docs.sparkSession.createDataFrame([], found.drop("part").schema)
        one.staged_at = f"{path}/part={part}"
        out.append(one)
    return out[0], out[1]


def stage_by_batch(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """A staged table in buckets by batch; rows without a batch go by their own bucket's number, below zero."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    if "bucket" in df.columns:
        df = df.withColumn("batch", F.coalesce("batch", F.lit(-1) - F.col("bucket")))
    with tidied(spark):
        df.repartition(buckets, "batch").write.bucketBy(buckets, "batch").options(path=path, compression="none").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # of the catalog's entry only: the files are read by path until they are unstaged
    out.staged_at = path
    return out


def found_none(docs: DataFrame, path: str, part: str) -> bool:
    """Whether nothing was written for ``part``, as for an empty table."""
    jvm = docs.sparkSession.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
    return not at.getFileSystem(docs.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(at)


ANSWER = "kind string, level int, batch long, bucket int, data binary, h long, v array<double>"


def rows_of(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.float64()))
    cols = list(zip(*found, strict=True)) or [[]] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "level", "batch", "bucket", "data", "h", "v"])


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Consecutive rows of equal ``key``."""
    held: list[dict] = []
    for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
        if held and held[0][key] != row[key]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def by_bucket(rows: DataFrame, function, schema: str, tables: int) -> DataFrame:
    """``function`` over all rows of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in grouped(batches, "bucket"):
            yield function(some)

    parts = max(partitions(rows.sparkSession), tables // 4)
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "batch").mapInArrow(run, schema)


def count_words(words: DataFrame, tables: int) -> DataFrame:
    """ANSWER rows of level 1: to each batch its words' counts and numbers in the bucket; and ``stat`` rows: types, known types, numbers of types by count."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(b << 64) // tables for b in range(1, tables)], np.uint64)
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            hashes, seen, every = thaw(row["data"])
            hashes = hashes.astype(np.uint64)
            cut = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
            yield rows_of([("words", 1, row["batch"], b, freeze(hashes[x:y], seen[x:y], every[x:y]), None, None) for b, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if x < y])

    def answer(rows: list[dict]) -> pa.RecordBatch:
        parts = [thaw(r["data"]) for r in rows]
        types, number = np.unique(np.concatenate([p[0].astype(np.uint64) for p in parts]), return_inverse=True)
        seen, every = (np.bincount(number, np.concatenate([p[k] for p in parts])).astype(np.int64) for k in (1, 2))
        n = np.bincount(np.minimum(seen, K + 2), minlength=K + 3)
        out, at, bucket = [("stat", 1, None, rows[0]["bucket"], None, None, [float(x) for x in (len(types), (seen > 0).sum(), *n)])], 0, rows[0]["bucket"]
        for r, p in zip(rows, parts, strict=True):
            some = number[at : at + len(p[0])]
            at += len(p[0])
            out.append(("answer", 1, r["batch"], bucket, freeze(seen[some], every[some], np.diff(some, prepend=0)), None, None))
        return rows_of(out)

    return by_bucket(words.mapInArrow(deal, ANSWER), answer, ANSWER, tables)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)


def backoff(hc: np.ndarray, low: np.ndarray, mass: np.ndarray, extra: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Back-off weights from counts of histories, their followers with counts 1..K, lower-order mass of their followers, and never-seen followers."""
    free = ((1 - d[1:, None]) * np.arange(1, K + 1)[:, None] * low).sum(0) + extra
    return np.where(hc > 0, free / np.maximum(hc + extra, 1) / np.maximum(1 - mass, 1e-300), 1.0)


class Batch:
    """The distinct n-grams of a batch's texts, order by order. Grams are numbered from 1; 0 is all start marks."""

    def __init__(self, row: dict, uni: Unigrams, docs: int, train_docs: int):
        self.sizes, place, often = thaw(row["data"])
        self.tokens = often[place]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~np.array(row["held"]), self.sizes)
        self.uni, self.level, self.d = uni, 1, {}
        seen, every, number = self.joined(row["answers"], 1)
        self.known, self.docs, self.train_docs = seen, docs, train_docs
        self.word_number = number
        self.gram = self.tokens + 1
        self.put(seen, every, number + 1, np.zeros(len(seen), np.int64), uni.p(seen))

    @staticmethod
    def joined(answers: list[dict], level: int) -> list[np.ndarray]:
        parts = [(thaw(a["data"]), a["bucket"]) for a in sorted((a for a in answers if a["level"] == level and a["bucket"] >= 0), key=lambda a: a["bucket"])]
        if not parts:
            return [np.zeros(0, np.int64)] * 3
        return [*(np.concatenate([p[k] for p, _ in parts]).astype(np.int64) for k in (0, 1)), np.concatenate([np.cumsum(p[2].astype(np.int64)) + (b << SPAN) for p, b in parts])]

    def put(self, count, every, number, base, prob) -> None:
        """Set what is known of each gram: training count, occurrences (above one as two, say), number, history's count with what is added, probability."""
        first = lambda x, v: np.concatenate(([v], x))
        self.count, self.every, self.number = first(count, self.train_docs), first(every, self.docs), first(number, 0)
        self.base, self.prob = first(base, 0), first(prob, 1.0)

    def climb(self, tables: int, hot_count: int) -> None:
        """Go on to the next order's grams, and the order in which they are dealt out."""
        n_types = max(len(self.word_number), 1)
        history = np.concatenate(([0], self.gram[:-1])) if len(self.gram) else self.gram
        history[self.starts] = 0
        key = history * n_types + self.tokens
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        self.next = np.empty(len(key), np.int64)
        self.next[order] = np.cumsum(new) - 1
        self.suffix = self.gram[order[new]]
        self.hist, word = key[new] // n_types, key[new] % n_types
        n = len(self.hist)
        self.trained, self.occur = (np.bincount(self.next, w, minlength=n).astype(np.int64) for w in (self.train, None))
        self.hc = self.count[self.hist]
        self.hot = self.hc > hot_count
        self.level += 1
        at = np.flatnonzero(self.every[self.hist] > 1)
        h, w = self.number[self.hist[at]], self.word_number[word[at]]
        part = (mixed(w) % (self.hc[at] // (max(hot_count, 8) // 8) + 1).astype(np.uint64)).astype(np.int64)
        table = (mixed(np.where(self.hot[at], h * 1_000_003 + part, h)) % np.uint64(tables)).astype(np.int64)
        small = int(h.max(initial=0)).bit_length() + tables.bit_length() < 62
        order = np.argsort(table << int(h.max(initial=0)).bit_length() | h, kind="stable") if small else np.lexsort((h, table))
        self.sent, self.h, self.w, table = at[order], h[order], w[order], table[order]
        self.bounds = np.searchsorted(table, np.arange(tables + 1))
        change = np.concatenate(([True], (self.h[1:] != self.h[:-1]) | (table[1:] != table[:-1])))[: len(at)]
        self.heads = np.flatnonzero(change)  # the first of each history in a table
        self.of = np.cumsum(change) - 1

    def fragments(self, batch: int) -> list[tuple]:
        """Rows for the tables, and one of the numbers of grams by count that go to none."""
        alone = np.bincount(np.minimum(np.delete(self.trained, self.sent), K + 2), minlength=K + 3)
        out = [("stat", self.level, batch, None, None, None, [float(x) for x in alone])]
        edges = np.searchsorted(self.heads, self.bounds).tolist()
        for b, (x, y) in enumerate(zip(self.bounds.tolist(), self.bounds[1:].tolist(), strict=False)):
            if x < y:
                heads, some = self.heads[edges[b] : edges[b + 1]], self.sent[x:y]
                first = self.sent[heads]
                learned = np.logical_or.reduceat(self.trained[some] > 0, heads - x)
                data = freeze(np.diff(self.h[heads], prepend=0), np.diff(np.append(heads, y)), np.where(learned, self.base[self.suffix[first]], 0), self.hot[first], self.w[x:y], np.where(self.trained[some] > 0, self.count[self.suffix[some]], 0), self.trained[some], self.occur[some])
                out.append(("grams", self.level, batch, b, data, None, None))
        return out

    def settle(self, answers: list[dict], d: np.ndarray) -> None:
        """Take in the tables' answers for this order: counts, numbers and probabilities of its grams."""
        n, heads = len(self.hist), self.sent[self.heads]
        count, every, number = self.trained.copy(), self.occur.copy(), np.zeros(n, np.int64)
        discounted, weight = np.ones(len(heads), bool), np.ones(len(heads))
        mine = {a["bucket"]: a["data"] for a in answers if a["level"] == self.level and a["bucket"] >= 0}
        edges = np.searchsorted(self.heads, self.bounds).tolist()
        for b, (x, y) in enumerate(zip(self.bounds.tolist(), self.bounds[1:].tolist(), strict=False)):
            if x == y:
                continue
            size = int.from_bytes(mine[b][:8], "little")
            mass = np.frombuffer(mine[b], np.float64, size, 8)
            more, c, step, low_any, *low = thaw(mine[b][8 + 8 * size :])
            # What occurs once in the corpus occurs here; the table has nothing to say of it.
            some = self.sent[x:y][bits(more, y - x)]
            count[some], every[some] = c, 2
            if len(step):
                number[some] = np.cumsum(step.astype(np.int64)) + (b << SPAN) + 1
            mine_heads = slice(edges[b], edges[b + 1])
            low_any = bits(low_any, edges[b + 1] - edges[b])
            discounted[mine_heads] = low_any
            need = np.logical_or.reduceat(count[self.sent[x:y]] == 0, self.heads[mine_heads] - x) & ~self.hot[heads[mine_heads]]
            at = edges[b] + np.flatnonzero(need)
            weight[at] = backoff(self.hc[heads[at]], np.array(low).reshape(K, -1), mass, (~low_any[need]).astype(float), d)
        hot = {a["h"]: np.array(a["v"]) for a in answers if a["level"] == self.level and a["bucket"] < 0}
        for i in np.flatnonzero(self.hot[heads]):
            v = hot.get(int(self.h[self.heads[i]]))
            if v is not None:
                weight[i] = backoff(self.hc[heads[i : i + 1]], v[:K, None], v[K:], np.ones(1), d)[0]
        extra, back = np.zeros(n, np.int64), np.ones(n)
        extra[self.sent] = (self.hot[self.sent] | ~discounted[self.of]).astype(np.int64)
        back[self.sent] = weight[self.of]
        base = np.where(self.hc > 0, self.hc + extra, 0)
        kept = np.where(count <= K, d[np.minimum(count, K)], 1.0) * count / np.maximum(base, 1)
        prob = np.where(count > 0, kept, back * self.prob[self.suffix])
        self.gram = self.next + 1
        self.put(count, every, number, base, prob)
        for name in ("next", "suffix", "hist", "trained", "occur", "hc", "hot", "sent", "h", "w", "bounds", "heads", "of"):
            delattr(self, name)


def bits(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed.astype(np.uint8), count=n).astype(bool)


def add_table(rows: list[dict], level: int, uni: Unigrams, d: np.ndarray, numbers: bool) -> pa.RecordBatch:
    """ANSWER rows of one table: ``answer`` to each batch; ``stat``: numbers of grams by count; ``hot``: a hot history's sums here; ``ask``: batches that need them.

    An answer has, for each gram dealt, whether it occurs more than once, and of those that do the count and, with ``numbers``, the number.
    """
    bucket = rows[0]["bucket"]
    cols: list[list] = [[] for _ in range(7)]
    lens, sizes = [], []
    for r in rows:
        step, n, base, hot, w, low, trained, occur = thaw(r.pop("data"))
        for col, v in zip(cols, (np.cumsum(step.astype(np.int64)), base, hot, w, low, trained, occur), strict=True):
            col.append(v.astype(np.int64))
        lens.append(n.astype(np.int64))
        sizes.append(len(w))
    h, based, hot, w, low, trained, occur = (np.concatenate(cols.pop(0)) for _ in range(7))
    n = np.concatenate(lens)
    H, first, at = np.unique(h, return_index=True, return_inverse=True)
    hot, base = hot[first] > 0, np.zeros(len(H), np.int64)
    np.maximum.at(base, at, based)  # a batch that did not learn from a history says zero
    at = np.repeat(at, n)
    wide = int(w.max()).bit_length()
    order = np.argsort(at << wide | w) if wide + len(H).bit_length() < 63 else np.lexsort((w, at))
    new = np.concatenate(([True], (np.diff(at[order]) != 0) | (np.diff(w[order]) != 0)))
    kind = np.empty(len(w), np.int64)
    kind[order] = np.cumsum(new) - 1
    one = order[new]
    of, found = at[one], low > 0
    known = np.zeros(len(one), np.int64)
    known[kind[found]] = low[found]
    low = known
    count, every = (np.bincount(kind, c, minlength=len(one)).astype(np.int64) for c in (trained, occur))
    del order, new, trained, occur, w
    below = uni.p(low) if level == 2 else np.where(low <= K, d[np.minimum(low, K)], 1.0) * low / np.maximum(base[of], 1)
    mass = np.bincount(of, np.where(count > 0, below, 0.0), minlength=len(H))
    lows = np.array([np.bincount(of, count == r, minlength=len(H)) for r in range(1, K + 1)])
    any_low = lows.sum(0) > 0
    any_low[hot] = False
    out = [("stat", level, None, bucket, None, None, [float(x) for x in np.bincount(np.minimum(count, K + 2), minlength=K + 3)])]
    out += [("hot", level, None, bucket, None, int(H[i]), [*lows[:, i].tolist(), float(mass[i])]) for i in np.flatnonzero(hot)]
    heads = np.concatenate(([0], np.cumsum(n)))[:-1]
    grams, histories = np.cumsum([0, *sizes]), np.cumsum([0, *map(len, lens)])
    for k, r in enumerate(rows):
        some, mine = kind[grams[k] : grams[k + 1]], heads[histories[k] : histories[k + 1]]
        i = at[mine]
        need = np.logical_or.reduceat(count[some] == 0, mine - grams[k])
        ask = need & hot[i]
        need &= ~hot[i]
        data, more = mass[i[need]], every[some] > 1
        step = np.diff(some[more], prepend=0) if numbers else np.zeros(0, np.int64)
        out.append(("answer", level, r["batch"], bucket, len(data).to_bytes(8, "little") + data.tobytes() + freeze(np.packbits(more), count[some[more]], step, np.packbits(any_low[i]), *lows[:, i[need]].astype(np.int64)), None, None))
        out += [("ask", level, r["batch"], bucket, None, int(H[j]), None) for j in i[ask]]
    return rows_of(out)


def score_documents(docs: DataFrame, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``."""
    tokens, words = encode(docs)
    size = tokens.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_train", "n_train_docs", "n_docs", "n_tokens")]).first()
    train, train_docs, n_docs, n_tokens = map(int, size)
    types = int(words.agg(F.sum("n_types")).first()[0] or 0)
    buckets = max(partitions(docs.sparkSession), -(-tokens.count() // BUCKET_BATCHES))
    answered = [stage_by_batch(count_words(words, max(1, -(-types // TABLE_TOKENS))), "words", buckets)]
    unstage(words)
    loose, tokens = tokens, stage_by_batch(tokens.select("batch", "doc_ids", "held", "data"), "tokens", buckets)
    unstage(loose)
    sums = stats(answered[0], K + 5)
    uni = Unigrams.of(train, int(sums[1]), sums[2:].astype(np.int64))
    tables, hot_count, ds = max(1, -(-n_tokens // TABLE_TOKENS)), max(1000, TABLE_TOKENS // 10), []

    def climbed(row: dict) -> Batch:
        """The batch with all orders settled that have been answered."""
        batch = Batch(row, uni, n_docs, train_docs)
        for d in ds:
            batch.climb(tables, hot_count)
            batch.settle(row["answers"], d)
        return batch

    def with_answers() -> DataFrame:
        out, lists = tokens, [f"answers_{k}" for k in range(len(answered))]
        for a, name in zip(answered, lists, strict=True):
            of_batch = a.where("kind = 'answer'").groupBy("batch").agg(F.collect_list(F.struct("level", "bucket", "data", "h", "v")).alias(name))
            out = out.join(of_batch, "batch", "left")
        return out.select(*tokens.columns, F.flatten(F.array_compact(F.array(*lists))).alias("answers"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            yield {**row, "answers": row["answers"] or []}

    for level in range(2, order + 1):

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in each(batches):
                batch = climbed(row)
                batch.climb(tables, hot_count)
                yield rows_of(batch.fragments(row["batch"]))

        dealt = with_answers().mapInArrow(spread, ANSWER)
        # Rows that go to no table pass through a bucket of their own.
        found = add_or_pass(dealt, level, uni, ds[-1] if ds else np.ones(K + 1), tables, level < order)
        table = stage_by_batch(found, "answers", buckets)
        d = discounts(stats(table, K + 3))
        hot = table.where("kind = 'hot'").groupBy("h").agg(F.array(*[F.sum(F.col("v")[r]) for r in range(K + 1)]).alias("v"))
        asked = table.where("kind = 'ask'").select("batch", "h").distinct().join(hot, "h")
        asked = asked.select(F.lit("answer").alias("kind"), F.lit(level).alias("level"), "batch", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("data"), "h", "v")
        answered += [table, stage_by_batch(asked, "hot", buckets)]
        ds.append(d)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            batch = climbed(row)
            known = batch.known[batch.tokens]
            add = lambda x, b=batch: np.add.reduceat(x, b.starts)
            numbers = (batch.sizes, add((known > 0).astype(np.int64)), np.full(len(batch.sizes), train), add(uni.base(known)), add(np.log10(batch.prob[batch.gram])))
            cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), *(pa.array(x, t) for x, t in zip(numbers, (*[pa.int64()] * 3, *[pa.float64()] * 2), strict=True))]
            yield pa.record_batch(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_answers().mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def stats(table: DataFrame, n: int) -> np.ndarray:
    row = table.where("kind = 'stat'").agg(*[F.sum(F.col("v")[r]) for r in range(n)]).first()
    return np.array([x or 0.0 for x in row])


def add_or_pass(dealt: DataFrame, level: int, uni: Unigrams, d: np.ndarray, tables: int, numbers: bool) -> DataFrame:
    """``add_table`` of the grams; rows without a bucket are spread and pass as they are."""
    none = F.coalesce("bucket", F.lit(-1) - F.pmod(F.xxhash64("batch"), F.lit(64)).cast("int"))
    rows = dealt.withColumn("bucket", none.cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in grouped(batches, "bucket"):
            if some[0]["bucket"] < 0:
                yield rows_of([tuple(r.values()) for r in some])
            else:
                yield add_table(some, level, uni, d, numbers)

    parts = max(partitions(dealt.sparkSession), tables // 4)
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "batch").mapInArrow(run, ANSWER)
