"""Hard negatives from an R-tree packed by sort-tile-recursive, searched best first.

Vectors become whole numbers. Rows are tiled by label and then by slices of the three coordinates that vary most (borders from at most ``SAMPLE`` rows;
every row is indexed); range partitions over (label, tile, a hash of the id) make groups of even size, however many rows are equal. A
task packs its rows: within a block each coordinate in turn is sorted and cut, down to leaves of ``LEAF`` rows, and boxes are
kept of leaves, blocks and the group. From a box the inner product with an anchor lies in an interval, coordinate by coordinate.

A query (anchor, windows of scores) first visits the group with the highest upper end; with the k-th best of each
window so found it goes to every other group whose box reaches into a window and not strictly below its k-th. In a group a queue yields leaves by
upper end, until none can count. Positives are one window over the anchor's own label, negatives one window per positive over the others.
Anchors are dealt to groups in shares of ``SHARE``, to each of which the group's blocks are copied; a task holds one group.

Where vectors do not cluster (directions spread evenly in 64 dimensions) boxes reach far and most leaves are compared: anchors times rows, in blocks.

Defined results: rows with a null id, label or vector, with null or non-finite components, without components or of another length than most take no part; rows that repeat an id
are one, that of the smallest label and vector; ties go to the smaller id; an anchor without others of its label has no rows, nor has a positive without negatives in its window (any with a score below
zero); components whose scores might pass 2^53 are held at what does not; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._common import partitions, stage

SAMPLE = 4096
LEAF = 128  # rows of a leaf
BLOCK = 8192  # rows packed at once
AXES = 3
GROUP_BYTES = 32 << 20  # of a group's vectors while a task searches it
BOX_BYTES = 64 << 20  # of all groups' boxes, which every task has
SHARE = 1 << 16  # anchors that one task compares with a group
BATCH = 1024
FAR = 1 << 60


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", label: Column | str = "label", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, v (array of long: floor of ``scale`` times each component): the rows that take part, one for each id."""
    v = F.col(embedding).cast("array<double>")
    label = F.col(label) if isinstance(label, str) else label
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null and size(v) > 0").where(F.coalesce(finite, F.lit(False)))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most["d"] if most else 1
    limit = int(np.sqrt(2**53 / dim)) - 1
    held = lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(x * scale)))
    rows = rows.where(F.size("v") == dim).select("vec_id", F.struct("label", F.transform("v", held).cast("array<long>").alias("v")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def matrix(array: pa.Array, dim: int) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def tile_cuts(sample: np.ndarray, axes: list[int], tiles: int) -> list[list[np.ndarray]]:
    """For each axis, per slice of the axes before it, the borders of its slices."""
    each = max(1, int(np.ceil(tiles ** (1 / max(1, len(axes))))))
    parts, out = [sample], []
    for a in axes:
        borders = [np.quantile(p[:, a], np.arange(1, each) / each) if len(p) else np.zeros(each - 1) for p in parts]
        out.append(borders)
        parts = [p[np.searchsorted(b, p[:, a], "right") == s] for p, b in zip(parts, borders, strict=True) for s in range(each)]
    return out


def tile_of(x: np.ndarray, axes: list[int], cuts: list[list[np.ndarray]]) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for a, borders in zip(axes, cuts, strict=True):
        each, into = len(borders[0]) + 1, np.zeros(len(x), np.int64)
        for part in np.unique(out):
            at = out == part
            into[at] = np.searchsorted(borders[part], x[at, a], "right")
        out = out * each + into
    return out


def packed_order(x: np.ndarray, rows: np.ndarray, axes: list[int], leaf: int) -> np.ndarray:
    """``rows`` ordered so that every ``leaf`` of them are a leaf: sorted by one axis, cut into slices of whole leaves, each sorted by the next."""
    rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
    leaves = -(-len(rows) // leaf)
    if len(axes) == 1 or leaves <= 1:
        return rows
    slices = int(np.ceil(leaves ** (1 / len(axes))))
    width = -(-leaves // slices) * leaf
    return np.concatenate([packed_order(x, rows[i : i + width], axes[1:], leaf) for i in range(0, len(rows), width)])


def leaf_starts(labels: np.ndarray) -> np.ndarray:
    """First rows of leaves: a leaf has one label and at most ``LEAF`` rows."""
    cuts = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1])))
    return np.concatenate([np.arange(a, b, LEAF) for a, b in pairwise([*cuts.tolist(), len(labels)])])


MESSAGE = "g long, share int, kind int, n int, ids binary, labels binary, x binary, extra binary"
NAMES = ["g", "share", "kind", "n", "ids", "labels", "x", "extra"]
KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def message(*row) -> pa.RecordBatch:
    values = [v.tobytes() if isinstance(v, np.ndarray) else v for v in row]
    return pa.record_batch([pa.array([v], t) for v, t in zip(values, KINDS, strict=True)], names=NAMES)


class Block:
    """Leaves of one block with their boxes (smallest and largest of each coordinate), labels and smallest ids."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, boxes: np.ndarray):
        self.ids, self.x = ids, x.astype(np.float64)
        self.starts = leaf_starts(labels)
        self.ends = np.append(self.starts[1:], len(ids))
        self.low, self.high = boxes.astype(np.float64)
        self.least, self.label = np.minimum.reduceat(ids, self.starts), labels[self.starts]

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper end of the leaves' inner products."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return self.low @ up + self.high @ down, self.high @ up + self.low @ down


class Tops:
    """The k best (score, then smaller id) of each window of a query, and what it takes to come in."""

    def __init__(self, windows: np.ndarray, k: int):
        self.low, self.high, self.score, self.id = windows.T.copy()
        self.k, self.found = k, [[] for _ in windows]

    def open_to(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which boxes reach into a window and not strictly below its k-th."""
        at, top = high[:, None], self.score
        into = (at >= self.low) & (low[:, None] <= self.high) & ((at > top) | (at == top) & (least[:, None] <= self.id))
        return into.any(1)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = (scores >= self.low[:, None]) & (scores <= self.high[:, None]) & ((scores > self.score[:, None]) | (scores == self.score[:, None]) & (ids <= self.id[:, None]))
        for w in np.flatnonzero(fits.any(1)):
            at = np.flatnonzero(fits[w])
            at = at[np.lexsort((ids[at], -scores[at]))[: self.k]]
            best = sorted([*self.found[w], *zip((-scores[at]).tolist(), ids[at].tolist(), strict=True)])[: self.k]
            self.found[w] = best
            if len(best) == self.k and (-best[-1][0], -best[-1][1]) > (self.score[w], -self.id[w]):
                self.score[w], self.id[w] = -best[-1][0], best[-1][1]


def search_group(blocks: list[Block], own: int, label: int, q: np.ndarray, tops: Tops, same: bool) -> None:
    """Best-first: each block offers its next leaf by upper end; the queue ends when no leaf left can count."""
    queue, offers = [], []
    for block in blocks:
        low, high = block.reach(q)
        may = (block.label == label) if same else (block.label != label)
        may &= tops.open_to(low, high, block.least)
        order = np.flatnonzero(may)
        order = order[np.lexsort((block.least[order], -high[order]))]
        offers.append((block, order, low, high))
        if len(order):
            heapq.heappush(queue, (-high[order[0]], int(block.least[order[0]]), len(offers) - 1, 0))
    while queue:
        high, _, b, at = heapq.heappop(queue)
        if -high < np.maximum(tops.low, tops.score).min():
            return
        block, order, lows, highs = offers[b]
        leaf = order[at]
        if at + 1 < len(order):
            after = order[at + 1]
            heapq.heappush(queue, (-highs[after], int(block.least[after]), b, at + 1))
        if tops.open_to(lows[leaf : leaf + 1], highs[leaf : leaf + 1], block.least[leaf : leaf + 1])[0]:
            s = slice(block.starts[leaf], block.ends[leaf])
            others = block.ids[s] != own
            tops.add((block.x[s] @ q)[others].astype(np.int64), block.ids[s][others])


class Tree:
    """The staged index: blocks by group, and every group's box."""

    def __init__(self, table: DataFrame):
        self.table = table
        size = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.greatest(F.abs(F.array_min("v")), F.abs(F.array_max("v")))).alias("most")).first()
        self.n, self.dim, most = size["n"], size["dim"] or 1, size["most"] or 0
        self.kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
        spark = table.sparkSession
        wanted = max(-(-self.n * self.dim * 8 // GROUP_BYTES), min(partitions(spark), -(-self.n // 2048)), 1)
        self.groups = min(wanted, max(1, BOX_BYTES // (16 * self.dim)))
        self.index = stage(self.packed(), "rtree", "uncompressed")
        boxes = self.index.where("kind = 1").orderBy("g").collect()
        box = np.stack([np.frombuffer(b["extra"], self.kind).reshape(2, -1) for b in boxes]).astype(np.float64) if boxes else np.zeros((0, 2, self.dim))
        self.low, self.high = box[:, 0], box[:, 1]
        self.g = np.array([b["g"] for b in boxes], np.int64)
        self.least = np.array([np.frombuffer(b["ids"], np.int64)[0] for b in boxes], np.int64)
        self.label_low, self.label_high = np.array([np.frombuffer(b["labels"], np.int64) for b in boxes], np.int64).reshape(-1, 2).T

    def packed(self) -> DataFrame:
        dim, kind = self.dim, self.kind
        sample = np.array([r["v"] for r in self.table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()], np.int64).reshape(-1, dim)
        axes = np.argsort(-(sample.var(0) if len(sample) else np.zeros(dim)), kind="stable")[:AXES].tolist()
        cuts = tile_cuts(sample, axes, max(1, min(self.n // BLOCK, len(sample) // 8)))

        def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
                x = matrix(batch.column(2), dim)
                rows = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                yield pa.record_batch([batch.column(0), batch.column(1), rows, pa.array(tile_of(x, axes, cuts))], names=["vec_id", "label", "x", "tile"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            g, roots = None, []

            def block() -> pa.RecordBatch:
                ids, labels, x = (np.concatenate(c) for c in zip(*held, strict=True))
                by_id = np.argsort(ids, kind="stable")
                spread = np.argsort(-x.astype(np.float64).var(0), kind="stable")[:AXES].tolist()
                order = np.concatenate([packed_order(x, by_id[labels[by_id] == v], spread, LEAF) for v in np.unique(labels)])
                ids, labels, x = ids[order], labels[order], x[order]
                starts = leaf_starts(labels)
                boxes = np.stack([np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)])
                roots.append((ids.min(), labels.min(), labels.max(), boxes[0].min(0), boxes[1].max(0)))
                return message(g, 0, 0, len(ids), ids, labels, x, boxes)

            for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
                g = batch.column(3)[0].as_py()
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(-1, dim)
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), x))
                if sum(len(h[0]) for h in held) >= BLOCK:
                    yield block()
                    held = []
            if held:
                yield block()
            if roots:
                ids, low_label, high_label, low, high = zip(*roots, strict=True)
                box = np.stack([np.min(low, 0), np.max(high, 0)])
                yield message(g, 0, 1, 0, np.array([min(ids)]), np.array([min(low_label), max(high_label)]), b"", box)

        rows = self.table.select("vec_id", "label", "v").mapInArrow(tiled, "vec_id long, label long, x binary, tile long").withColumn("h", F.xxhash64("vec_id"))
        dealt = rows.repartitionByRange(self.groups, "label", "tile", "h").sortWithinPartitions("label", "tile", "h")
        return dealt.select("vec_id", "label", "x", F.spark_partition_id().cast("long").alias("g")).mapInArrow(pack, MESSAGE)

    def route(self, queries: DataFrame, shares: int, same: bool, first: bool) -> DataFrame:
        """Messages of queries (vec_id, label, v, windows): to the best group of each, or to all others that its windows reach."""
        dim, kind, n, low, high, least, g = self.dim, self.kind, len(self.g), self.low, self.high, self.least, self.g
        label_low, label_high = self.label_low, self.label_high

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
                ids, labels, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), dim)
                flat = batch.column(3).to_pylist()
                most = max(len(w) for w in flat)
                windows = np.array([[*w, *[(FAR, -FAR, FAR, -FAR)] * (most - len(w))] for w in flat], np.int64)
                up, down = np.maximum(x, 0).astype(np.float64), np.minimum(x, 0).astype(np.float64)
                tops, bottoms = up @ high.T + down @ low.T, up @ low.T + down @ high.T
                mine = (label_low <= labels[:, None]) & (labels[:, None] <= label_high)
                may = mine if same else ~mine | (label_low != label_high)
                best = np.where(may, tops, -np.inf).argmax(1) if n else np.zeros(len(ids), np.int64)
                for at in range(n):
                    if first:
                        some = np.flatnonzero((best == at) & may[:, at])
                    else:
                        t, b = tops[:, at, None], bottoms[:, at, None]
                        into = (t >= windows[:, :, 0]) & (b <= windows[:, :, 1]) & ((t > windows[:, :, 2]) | (t == windows[:, :, 2]) & (least[at] <= windows[:, :, 3]))
                        some = np.flatnonzero(into.any(1) & (best != at) & may[:, at])
                    share = ids[some] // 100 % shares if shares > 1 else np.zeros(len(some), np.int64)
                    for s in np.unique(share):
                        one = some[share == s]
                        yield message(int(g[at]), int(s), 2, len(one), ids[one], labels[one], x[one].astype(kind), windows[one])

        return queries.select("vec_id", "label", "v", "windows").mapInArrow(run, MESSAGE)

    def scan(self, messages: DataFrame, shares: int, k: int, same: bool) -> DataFrame:
        """anchor_id, window, vec_id, score: the best of each query's windows in each group that it came to."""
        dim, kind = self.dim, self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, blocks = None, []
            for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                if (row["g"], row["share"]) != at:
                    at, blocks = (row["g"], row["share"]), []
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                x = np.frombuffer(row["x"], kind).reshape(-1, dim)
                if row["kind"] == 0:
                    blocks.append(Block(ids, labels, x, np.frombuffer(row["extra"], kind).reshape(2, -1, dim)))
                    continue
                windows = np.frombuffer(row["extra"], np.int64).reshape(len(ids), -1, 4)
                out: list[tuple] = []
                for q in range(len(ids)):
                    tops = Tops(windows[q], k)
                    search_group(blocks, int(ids[q]), int(labels[q]), x[q].astype(np.float64), tops, same)
                    out += [(int(ids[q]), w, i, -s) for w, found in enumerate(tops.found) for s, i in found]
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor_id", "window", "vec_id", "score"])

        blocks = self.index.where("kind = 0").drop("share").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select(*NAMES)
        wanted = messages.select("g", "share").distinct()
        blocks = blocks.join(wanted, ["g", "share"], "left_semi").select(*NAMES)
        tasks = max(1, min(self.groups * shares, 20 * partitions(self.table.sparkSession)))
        return blocks.union(messages).repartition(tasks, "g", "share").sortWithinPartitions("g", "share", "kind").mapInArrow(run, "anchor_id long, window int, vec_id long, score long")

    def search(self, queries: DataFrame, n_queries: int, k: int, same: bool) -> DataFrame:
        """anchor_id, window, rank, vec_id, score: the ``k`` best rows in each window (low, high) of ``queries`` (vec_id, label, v, bounds)."""
        shares = max(1, -(-n_queries // SHARE))
        ranked = F.row_number().over(W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
        none = F.struct(F.lit(-FAR).alias("score"), F.lit(FAR).alias("id"))

        def with_windows(rows: DataFrame, best: Column) -> DataFrame:
            each = F.transform("bounds", lambda b, i: F.array(b["low"], b["high"], best(i)["score"], best(i)["id"]))
            return rows.select("vec_id", "label", "v", each.alias("windows"))

        messages = stage(self.route(with_windows(queries, lambda i: none), shares, same, True), "first-visits")
        found = stage(self.scan(messages, shares, k, same), "first-found")
        last = found.withColumn("rank", ranked).where(F.col("rank") == k).groupBy("anchor_id")
        last = last.agg(F.map_from_entries(F.collect_list(F.struct("window", F.struct("score", F.col("vec_id").alias("id"))))).alias("kth"))
        bounded = queries.join(last.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left")
        bounded = with_windows(bounded, lambda i: F.coalesce(F.try_element_at("kth", i), none))
        messages = stage(self.route(bounded, shares, same, False), "visits")
        every = found.unionByName(self.scan(messages, shares, k, same))
        return every.withColumn("rank", ranked).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (a condition on vec_id) and each of its best ``positives`` rows of the same label
    the best ``negatives`` rows of other labels that score from ``low`` to ``high`` per cent of the positive."""
    table = stage(whole_vectors(rows, label=label), "whole-vectors")
    tree = Tree(table)
    anchors = table.where(is_anchor)
    n = anchors.count()
    bound = lambda a, b: F.struct(a.cast("long").alias("low"), b.cast("long").alias("high"))
    wide = anchors.withColumn("bounds", F.array(bound(F.lit(-FAR), F.lit(FAR))))
    best = stage(tree.search(wide, n, positives, True).select("anchor_id", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least, most = F.expr(f"-((-{low} * positive_score) div 100) + IF((-{low} * positive_score) % 100 < 0, 1, 0)"), F.expr(f"({high} * positive_score) div 100 - IF(({high} * positive_score) % 100 < 0, 1, 0)")
    asked = best.withColumn("b", bound(least, most)).where("b.low <= b.high")
    asked = asked.withColumn("window", F.row_number().over(W.partitionBy("anchor_id").orderBy("nth")) - 1)
    windows = asked.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "b"))), lambda x: x["b"]).alias("bounds"))
    found = tree.search(anchors.join(windows, "vec_id"), n, negatives, False).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    return found.join(asked, ["anchor_id", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
