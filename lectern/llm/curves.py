"""Nearest neighbours by shifted space-filling curves, certified by an exact pass.

Vectors are projected to a few dimensions, differently for each of several curves, shifted, and given a Hilbert key (and below it
a few bits of a hash of the id, so that equal vectors spread). A sample's keys cut each curve into cells; a row goes to its cell and, as
context, to each cell that it is within a window of. A task sorts a cell, slides over it in blocks, and compares each query of the cell with the blocks around
it. So a window reaches over the borders of cells and tasks, and what it finds does not depend on the number of partitions.
Windows of all curves merge per query and give a bound: the distance of its k-th neighbour so far. The blocks of the first curve are kept as an index with the
ball that holds each; a second pass deals them out in groups, streams the queries by in batches, and compares a query with every block whose ball reaches into its bound.
So the answer is exact: where vectors cluster few blocks are read, where they do not (uniform directions in 64 dimensions, where
no window of fixed size finds nine in ten) nearly all are. ``certify=False`` stops after the windows.

The fit (mean and spread of projections, borders of cells) is made on at most ``SAMPLE`` vectors; every row is indexed.

Defined results: vectors that are null, zero, or hold null or non-finite components, have a null id, or another length than
most, take no part; equal vectors are neighbours at distance 0; ties go to the smaller id; of rows that repeat an id the
nearest counts once, however many there are; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._common import partitions, stage

SAMPLE = 4096
AXES, BITS, TIE_BITS = 6, 8, 15
CELL_BLOCKS = 8  # blocks of a cell, about
GROUP_BYTES = 32 << 20  # of index blocks that one task of the certifying pass holds
QUERIES_AT_ONCE = 256


def hilbert_keys(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n, axes) with ``bits`` bits per axis."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level, from the top
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def matrix(array: pa.Array) -> np.ndarray:
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else np.zeros((0, 1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row, squares added in the order of the components."""
    return np.sqrt(np.add.accumulate((a - b) ** 2, axis=1)[:, -1]) if len(a) else np.zeros(0)


def clean_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array of doubles): the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    finite: Column = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda c: c != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


class Best:
    """The k nearest of each query of a batch, from pairs given block by block."""

    def __init__(self, n: int, k: int, bound: np.ndarray):
        self.k, self.bound = k, bound
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        self.held.append((q, ids, d))
        self.n += len(q)
        if self.n > 200_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, ids, d = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((d, ids, q))
        q, ids, d = q[order], ids[order], d[order]
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])))  # the nearest row of each id
        q, ids, d = q[new], ids[new], d[new]
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        first = np.concatenate(([True], q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        full = rank == self.k - 1
        self.bound[q[full]] = np.minimum(self.bound[q[full]], d[full])
        keep = rank < self.k
        self.held, self.n = [(q[keep], ids[keep], d[keep])], int(keep.sum())
        return self.held[0]


def compare(best: Best, which: np.ndarray, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
    """Offer the rows ``x`` to the queries ``which``: a fast product picks the pairs that may count, which are then measured exactly."""
    a = q[which]
    xx = (x**2).sum(1)
    fast = (a**2).sum(1)[:, None] + xx[None] - 2 * a @ x.T
    slack = 1e-9 * (1 + xx.max() + (a**2).sum(1))
    limit = best.bound[which]
    if np.isinf(limit).any() and len(ids) > best.k and len(np.unique(ids)) == len(ids):  # no bound yet: the block's own k-th, the query itself aside
        limit = np.minimum(limit, np.sqrt(np.maximum(np.partition(fast, best.k, axis=1)[:, best.k], 0) + slack))
    i, j = np.nonzero(fast <= (limit**2 + slack)[:, None])
    other = q_ids[which][i] != ids[j]
    i, j = i[other], j[other]
    for s in range(0, len(i), 1 << 16):
        a_, b_ = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        best.add(which[a_], ids[b_], distances(a[a_], x[b_]))


def context(sample: np.ndarray, key: np.ndarray, cells: int, gaps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each key (sorted ``sample`` keys cut into ``cells``), and first and last cell within ``gaps`` of the sample's gaps."""
    at = np.searchsorted(sample, key, "right")
    cell = lambda i: np.minimum(np.clip(i, 0, len(sample)) * cells // max(len(sample), 1), cells - 1)
    return cell(at), cell(at - gaps), cell(at + gaps)


def nearest(rows: DataFrame, is_query: Column, k: int = 10, curves: int = 4, block: int = 1024, around: int = 1, certify: bool = True, seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row for which ``is_query`` (a condition on vec_id) holds, itself aside."""
    table = stage(clean_vectors(rows), "vectors")
    spark = table.sparkSession
    n_rows = table.count()
    sample = table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    ids, sample = np.array([r["vec_id"] for r in sample], np.int64), np.array([r["v"] for r in sample])
    dim = sample.shape[1] if len(sample) else 1
    rng = np.random.default_rng(seed)
    axes = min(AXES, dim)
    maps = [np.linalg.qr(rng.normal(size=(dim, axes)))[0] for _ in range(curves)]
    shifts = rng.random((curves, axes))
    seen = [sample.reshape(-1, dim) @ m for m in maps]
    fits = [(y.mean(0) if len(y) else np.zeros(axes), y.std(0) + 1e-12 if len(y) else np.ones(axes)) for y in seen]

    def keys_of(c: int, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        y = (x @ maps[c] - fits[c][0]) / fits[c][1]
        unit = 1 / (1 + np.exp(-1.7 * np.clip(y, -20, 20)))
        cell = np.minimum((unit + shifts[c]) / 2 * (1 << BITS), (1 << BITS) - 1)
        tie = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
        return hilbert_keys(cell) << TIE_BITS | tie

    sorted_keys = [np.sort(keys_of(c, ids, sample.reshape(-1, dim))) for c in range(curves)]
    cells = max(1, min(n_rows // (CELL_BLOCKS * block), len(sample) // 8))
    gaps = int(np.ceil((around + 1) * block * len(sample) / max(n_rows, 1) * 1.25)) + 8

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            for c in range(curves):
                key = keys_of(c, ids, x)
                own, low, high = context(sorted_keys[c], key, cells, gaps)
                n = high - low + 1
                row = np.repeat(np.arange(len(key)), n)
                cell = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                some = batch.take(pa.array(row))
                yield pa.record_batch([pa.array(cell * curves + c), pa.array(key[row]), *some.columns, pa.array(cell == own[row])], names=["cell", "key", "vec_id", "v", "q", "home"])

    marked = table.select("vec_id", "v", is_query.alias("q"))
    dealt = marked.mapInArrow(keyed, "cell long, key long, vec_id long, v array<double>, q boolean, home boolean")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """cell, ids, vectors, query flags (of queries at home there) of consecutive rows of one cell."""
        held: list[tuple] = []
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            at, ids, x = batch.column(0).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3))
            q, home = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in (4, 5))
            bounds = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in pairwise(bounds):
                if held and held[0][0] != at[a]:
                    yield merged(held)
                    held = []
                held.append((int(at[a]), ids[a:b], x[a:b], (q & home)[a:b]))
                while sum(len(h[1]) for h in held) >= block:
                    c, i, v, f = merged(held)
                    yield c, i[:block], v[:block], f[:block]
                    held = [(c, i[block:], v[block:], f[block:])] if len(i) > block else []
        if held:
            yield merged(held)

    def merged(held: list[tuple]) -> tuple:
        return held[0][0], *(np.concatenate([h[k] for h in held]) for k in (1, 2, 3))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line: list[tuple] = []  # blocks of one cell, the newest last

        def meet(at: int) -> pa.RecordBatch:
            _, ids, x, f = line[at]
            best = Best(int(f.sum()), k, np.full(int(f.sum()), np.inf))
            for _, i, v, _ in line[max(0, at - around) : at + around + 1]:
                compare(best, np.arange(len(best.bound)), ids[f], x[f], i, v)
            q, found, d = best.cut()
            return pa.record_batch([pa.array(ids[f][q]), pa.array(found), pa.array(d)], names=["query_id", "vec_id", "score"])

        for b in chain(blocks(batches), [None]):
            if b is None or (line and line[0][0] != b[0]):
                for at in range(max(0, len(line) - around), len(line)):
                    if line[at][3].any():
                        yield meet(at)
                line = []
            if b is not None:
                line.append(b)
                if len(line) > around and line[-1 - around][3].any():
                    yield meet(len(line) - 1 - around)
                del line[: max(0, len(line) - 2 * around - 1)]

    parts = max(partitions(spark), curves * cells // 8)
    near = dealt.repartition(parts, "cell").sortWithinPartitions("cell", "key", "vec_id").mapInArrow(windows, PAIR)
    found = stage(near, "windows")
    if certify:
        first = dealt.where(f"home and cell % {curves} = 0").repartition(parts, "cell").sortWithinPartitions("cell", "key", "vec_id")
        found = found.unionByName(certified(marked, first, found, k, dim, n_rows, block, blocks))
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


PAIR = "query_id long, vec_id long, score double"
TILE = "g long, kind int, ids array<long>, x binary, mid binary, radius double"


def certified(marked: DataFrame, first_curve: DataFrame, found: DataFrame, k: int, dim: int, n_rows: int, block: int, blocks) -> DataFrame:
    """query_id, vec_id, score: for each query the nearest of every index block that its bound reaches.

    Index blocks are dealt to groups that one task holds, as many as their bytes ask for; batches of queries go to every group and stream by.
    """
    spark = marked.sparkSession
    groups = max(-(-n_rows * dim * 8 // GROUP_BYTES), min(partitions(spark), -(-n_rows // block)), 1)

    def tile(kind: int, ids: np.ndarray, x: np.ndarray, mid: np.ndarray, radius: float, g: int) -> pa.RecordBatch:
        row = (g, kind, ids, x.tobytes(), mid.tobytes(), radius)
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.float64())
        return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["g", "kind", "ids", "x", "mid", "radius"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, x, _ in blocks(batches):
            mid = x.mean(0)
            yield tile(0, ids, x, mid, float(np.linalg.norm(x - mid, axis=1).max()), xxhash.xxh64_intdigest(ids[:1].tobytes()) % groups)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, QUERIES_AT_ONCE) for b in batches for i in range(0, b.num_rows, QUERIES_AT_ONCE)):
            bound = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            yield tile(1, batch.column(0).to_numpy(), matrix(batch.column(1)), np.where(np.isnan(bound), np.inf, bound), 0.0, 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tiles = None, []
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            if row["g"] != at:
                at, tiles = row["g"], []
            ids, x, mid = np.array(row["ids"]), np.frombuffer(row["x"]).reshape(-1, dim), np.frombuffer(row["mid"])
            if row["kind"] == 0:
                tiles.append((ids, x, mid, row["radius"]))
                continue
            best = Best(len(ids), k, mid.copy())
            for t_ids, t_x, t_mid, radius in tiles:
                low = np.linalg.norm(x - t_mid, axis=1) - radius
                which = np.flatnonzero(low <= best.bound * (1 + 1e-9) + 1e-9)
                if len(which):
                    compare(best, which, ids, x, t_ids, t_x)
            q, near, d = best.cut()
            yield pa.record_batch([pa.array(ids[q]), pa.array(near), pa.array(d)], names=["query_id", "vec_id", "score"])

    each = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    bound = each.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("score"))).where(F.col("n") == k).select("query_id", F.col("score").alias("bound"))
    queries = marked.where("q").select(F.col("vec_id").alias("query_id"), "v").join(bound, "query_id", "left").select("query_id", "v", "bound")
    batches = stage(queries.mapInArrow(packed, TILE), "queries")
    every = batches.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).select("g", "kind", "ids", "x", "mid", "radius")
    tiles = stage(first_curve.mapInArrow(index, TILE), "index")
    return tiles.union(every).repartition(groups, "g").sortWithinPartitions("g", "kind").mapInArrow(scan, PAIR)
