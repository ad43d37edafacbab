"""Exact duplicates found by Patricia tries that hold whole byte strings.

Two rounds of tries. In the first, each task over the input inserts its texts into one compressed radix trie of
bounded size; a full trie spills its heaviest subtree as rows: one per distinct text, with the owner and the members
seen so far. Copies within a task thus meet before any shuffle, so a text that a third of all rows share crosses the
network once per spill. In the second round the spilled texts are dealt out by length and content hash, sorted,
and each (length, hash) run is inserted into a trie of its own, whose terminals store the owner of each full string.
Only (representative, owner, size) leaves that round; members are joined to it by representative.

Defined results: a null text counts as empty; a null id never owns a text while a non-null one has it; of rows that
repeat both id and text one is the owner; an empty table gives an empty result; other columns are not read, and ``keep_rows``
keeps them whatever their names. A task holds its trie, ``SLICE`` bytes on their way out and ``ROWS`` rows on their way in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._common import as_bytes, stage

LOCAL = "size int, h long, text binary, sha string, owner long, n long, ids array<long>, raws array<long>"
OWNERS = "rep long, keep_rep long, keep_id long, group_size long"
SLICE, RUN, ROWS = 4 << 20, 10_000, 256  # bytes of a batch that leaves a task, members of a row, rows taken in at once


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    __slots__ = ("label", "next", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.next, self.value = label, {}, value


class PatriciaTrie:
    """Compressed radix trie over bytes. ``slot(key)`` gives the key's terminal value, made by ``new`` if missing."""

    def __init__(self, new):
        self.root, self.new, self.weight = Node(b""), new, {}

    def slot(self, key: bytes):
        node, at = self.root, 0
        first = key[:1]
        while True:
            if at == len(key):
                if node.value is None:
                    node.value = self.new()
                    self.weight[first] = self.weight.get(first, 0) + 300
                return node.value
            child = node.next.get(key[at])
            if child is None:
                child = node.next[key[at]] = Node(key[at:], self.new())
                self.weight[first] = self.weight.get(first, 0) + len(key) - at + 700
                return child.value
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            k = common(child.label, key, at)
            upper = Node(child.label[:k])
            child.label = child.label[k:]
            upper.next[child.label[0]] = child
            node.next[key[at]] = upper
            node, at = upper, at + k

    def items(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            text = prefix + node.label
            if node.value is not None:
                yield text, node.value
            stack += [(child, text) for child in node.next.values()]

    def spill(self) -> Iterator[tuple[bytes, object]]:
        """Take out the heaviest subtree below the root."""
        first = max(self.weight, key=self.weight.get)
        del self.weight[first]
        if not first:
            value, self.root.value = self.root.value, None
            yield b"", value
        else:
            yield from self.items(self.root.next.pop(first[0]))


class Members:
    """Ids and text hashes of the rows that share a text."""

    __slots__ = ("ids", "raws")

    def __init__(self):
        self.ids, self.raws = [], []


def _rows(found: Iterator[tuple[bytes, Members]]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``SLICE`` bytes; a row holds at most ``RUN`` members, the owner of a text's rows first in its own."""
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["size", "h", "text", "sha", "owner", "n", "ids", "raws"]
    cols: list[list] = [[] for _ in kinds]
    held = 0
    for text, m in found:
        key = (len(text), xxhash.xxh64_intdigest(text) - 2**63, text, hashlib.sha256(text).hexdigest())
        for at in range(0, len(m.ids), RUN):
            ids, raws = m.ids[at : at + RUN], m.raws[at : at + RUN]
            k = max(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
            ids[0], ids[k], raws[0], raws[k] = ids[k], ids[0], raws[k], raws[0]
            for c, v in zip(cols, (*key, ids[0], len(ids), ids, raws), strict=True):
                c.append(v)
            held += len(text) + 16 * len(ids) + 200
            if held >= SLICE:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
                cols, held = [[] for _ in kinds], 0
    if held:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _local(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(Members)
        members = 0

        def out(found: Iterator[tuple[bytes, Members]]) -> Iterator[tuple[bytes, Members]]:
            nonlocal members
            for text, m in found:
                members -= len(m.ids)
                yield text, m

        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                m = trie.slot(text.lower())
                m.ids.append(doc_id)
                m.raws.append(xxhash.xxh64_intdigest(text, 42) - (1 << 64) * (xxhash.xxh64_intdigest(text, 42) >> 63))
                members += 1
                while sum(trie.weight.values()) + 96 * members > limit and trie.weight:
                    yield from _rows(out(trie.spill()))
        yield from _rows(trie.items())

    return run


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, trie = None, None
    out: list[tuple] = []

    def close():
        for _, reps in trie.items():
            best = max(reps, key=lambda r: (r[1] is not None, r[1] or 0, -r[0]))
            n = sum(r[2] for r in reps)
            out.extend((r[0], best[0], best[1], n) for r in reps)

    def flush():
        cols = list(zip(*out, strict=True)) or [[]] * 4
        out.clear()
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["rep", "keep_rep", "keep_id", "group_size"])

    for batch in batches:
        size, h, rep, owner, n = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
        for key, text, row in zip(zip(size, h, strict=True), batch.column(2).to_pylist(), zip(rep, owner, n, strict=True), strict=True):
            if key != at:
                if trie:
                    close()
                at, trie = key, PatriciaTrie(list)
            trie.slot(text).append(row)
        if len(out) > 50_000:
            yield flush()
    if trie:
        close()
    yield flush()


def exact_groups(docs: DataFrame, trie_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the text with A-Z lower-cased), raw_hash: one row per row of ``docs``.

    Of equal texts the row with the largest id stays. ``raw_hash`` is Spark's xxhash64 of the text as it is, by which
    a row is found again. ``trie_bytes`` bounds each task's trie; what goes beyond it is spilled by subtree.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    local = stage(rows.mapInArrow(_local(trie_bytes), LOCAL).withColumn("rep", F.monotonically_increasing_id()), "tries", "snappy")
    owners = (
        local.select("size", "h", "text", "rep", "owner", "n")
        .repartition("size", "h")
        .sortWithinPartitions("size", "h")
        .mapInArrow(_owners, OWNERS)
    )
    members = local.select("rep", "sha", F.posexplode(F.arrays_zip("ids", "raws")).alias("k", "m"))
    return members.join(owners, "rep").select(
        F.col("m.ids").alias("doc_id"),
        "keep_id",
        "group_size",
        ((F.col("rep") == F.col("keep_rep")) & (F.col("k") == 0)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("m.raws").alias("raw_hash"),
    )


def keep_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the (doc_id, raw_hash) of ``rows``; of those that repeat both the first by all their columns."""
    key = (F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"))
    found = docs.select(*key, F.struct(*docs.columns).alias("row"))
    want = rows.select(F.col("doc_id").alias("want_id"), F.col("raw_hash").alias("want_raw"))
    out = found.join(want, F.col("id").eqNullSafe(F.col("want_id")) & (F.col("raw") == F.col("want_raw")), "left_semi")
    if docs.select(*key).groupBy("id", "raw").count().where("count > 1").limit(1).count():
        place = F.row_number().over(W.partitionBy("id", "raw").orderBy(F.to_json("row")))  # only a task's first go to the shuffle
        out = out.withColumn("place", place).where("place = 1")
    return out.select("row.*")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    return keep_rows(docs, exact_groups(docs).where("kept"))
