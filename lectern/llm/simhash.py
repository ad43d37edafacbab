"""SimHash fingerprints linked at a small Hamming distance through a Gray-order hierarchical index.

Distinct fingerprints only are indexed: copies share one. Two fingerprints within ``k`` bits agree on at least one of
``k + 1`` blocks of bits, so each fingerprint is dealt to ``k + 1`` groups that share one masked bit pattern, which is
the root of that group's index. A group above ``limit`` rows is dealt again by blocks of its remaining bits, so no group
of a few hot patterns lands in one task whole. Within a group fingerprints are sorted by Gray rank; every node above
them keeps the bits its members share (mask and pattern). The search goes down pairs of nodes: differences in bits that
both sides share accumulate to a lower bound that drops a whole pair of groups, and an upper bound that accepts one whole.
A group sends out a spanning forest of its links, never all pairs. Components are found by large-star / small-star.

That is exact for few bits, which only near-identical texts are within. ``drop_near_copies`` reaches down to a given similarity of shingle sets:
it takes 128 bits, groups by masks drawn at random (as many as the recall asks for), searches each group by the same tree, and confirms
links on the whole texts. A first pass over a forest of each group joins most of what belongs together; a second one compares all that a mask
brings together and that is still apart, in groups of any size, so no link depends on a group's size or on a forest's choice. It compares sketches
that bound the similarity from above, in the groups' own tasks, so that only pairs which may be links leave them.

Defined results: a null or blank text has fingerprint zero and is linked like any other; null ids are kept and never
are a component's id unless all of it is null; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import as_bytes, partitions, stage, unstage
from lectern.llm.exact_dedup import keep_rows

U64 = np.uint64


def fingerprint(text: bytes, words: int = 4) -> int:
    """Majority bits of XXH64 (seed 42) over all runs of ``words`` words; A-Z are lower-cased."""
    w = text.lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) <= words:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], U64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), raw_hash (Spark's xxhash64 of the text): one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in as_bytes(batch.column(1))], U64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp, pa.int64()), batch.column(2)], names=["doc_id", "fp", "raw_hash"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("raw_hash")).mapInArrow(run, "doc_id long, fp long, raw_hash long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the binary reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U64(s))
    return x


class Index:
    """Trees over the codes of groups: rows in Gray order, and above them nodes of ``fan`` with the bits that their members share.

    ``x`` has one row of one or more 64-bit words per code; groups are ordered by the Gray rank of the first word. With ``label``, pairs of
    nodes that hold one and the same label are left out.
    """

    def __init__(self, group: np.ndarray, x: np.ndarray, fan: int = 4, label: np.ndarray | None = None):
        self.order = np.lexsort((gray_rank(x[:, 0]), group))
        g, v = group[self.order], x[self.order]
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        heads, counts = starts, np.diff(np.append(starts, len(v)))
        self.levels = [(np.arange(len(v)), np.arange(len(v)) + 1, v, v, None)]  # first row, end, AND, OR, first child
        self.labels = None if label is None else [(label[self.order],) * 2]  # least and largest
        while counts.max() > 1:
            up = -(-counts // fan)
            step = np.arange(up.sum()) - np.repeat(np.cumsum(up) - up, up)
            child = np.repeat(heads, up) + step * fan
            low, high, a, o, _ = self.levels[-1]
            last = np.append(child[1:], len(low)) - 1
            self.levels.append((low[child], high[last], np.bitwise_and.reduceat(a, child), np.bitwise_or.reduceat(o, child), np.append(child, len(low))))
            if self.labels:
                least, most = self.labels[-1]
                self.labels.append((np.minimum.reduceat(least, child), np.maximum.reduceat(most, child)))
            heads, counts = np.cumsum(up) - up, up

    def near(self, k: int, most: int = 1 << 19) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
        """Down pairs of nodes: (False, rows, rows, distances) of pairs within ``k`` bits, or (True, nodes, nodes, level) where all of both nodes are.

        Whether to go on below such a pair of nodes is sent back: by default not.
        """
        root = np.arange(len(self.levels[-1][0]))
        stack = [(len(self.levels) - 1, root, root)]
        while stack:
            depth, a, b = stack.pop()
            if len(a) > most:
                stack += [(depth, a[i : i + most], b[i : i + most]) for i in range(0, len(a), most)]
                continue
            _, _, both, any_, child = self.levels[depth]
            shared = ~(both[a] ^ any_[a]) & ~(both[b] ^ any_[b])
            differ = (both[a] ^ both[b]) & shared
            far = np.bitwise_count(differ).sum(1)  # the lower bound: differences in shared bits
            ok = far <= k
            if self.labels:
                low, high = self.labels[depth]
                ok &= (low[a] != high[b]) | (high[a] != low[b])
            if depth == 0:
                yield False, a[ok], b[ok], far[ok]
                continue
            whole = ok & (np.bitwise_count(differ | ~shared).sum(1) <= k)  # even if all other bits differed
            if whole.any() and not (yield True, a[whole], b[whole], depth):
                ok &= ~whole
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            ca, cb = child[a + 1] - child[a], child[b + 1] - child[b]
            n = ca * cb
            pair = np.repeat(np.arange(len(a)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            na, nb = child[a][pair] + at // cb[pair], child[b][pair] + at % cb[pair]
            stack.append((depth - 1, na[na <= nb], nb[na <= nb]))


def group_links(group: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """For each row the smallest row index of its group that it is linked to within ``k`` bits, over chains of links."""
    index = Index(group, x[:, None])
    label = np.arange(len(x))
    for whole, a, b, depth in index.near(k):
        if not whole:
            join(label, a, b)
            continue
        low, high = index.levels[depth][:2]
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            rows = np.concatenate((np.arange(low[i], high[i]), np.arange(low[j], high[j])))
            join(label, rows, np.full(len(rows), low[i]))
    out = np.empty(len(x), np.int64)
    out[index.order] = index.order[label]
    return out


def every_pair(index: Index, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, rows and distances of all pairs within ``k`` bits, block by block."""
    walk = index.near(k)
    step = next(walk, None)
    while step is not None:
        if not step[0]:
            keep = step[1] != step[2]
            yield tuple(c[keep] for c in step[1:])
        try:
            step = walk.send(True)
        except StopIteration:
            step = None


def group_forest(group: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that form, in each group, a smallest spanning forest of its links within ``k`` bits."""
    index = Index(group, x)
    found = list(every_pair(index, k))  # the forest is chosen by distance
    a, b, d = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((b, a, d))
    a, b = a[order], b[order]
    label, out = np.arange(len(x)), [np.zeros(0, np.int64)]
    at = np.arange(len(a))
    while True:  # each component takes its nearest link out, all at once
        at = at[label[a[at]] != label[b[at]]]
        if not len(at):
            break
        best = np.full(len(x), len(a))
        np.minimum.at(best, label[a[at]], at)
        np.minimum.at(best, label[b[at]], at)
        taken = np.unique(best[best < len(a)])
        join(label, a[taken], b[taken])
        out.append(taken)
    taken = np.concatenate(out)
    return index.order[a[taken]], index.order[b[taken]]


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of ``a`` and ``b`` pairwise; ``label`` keeps the smallest row of each class."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            deeper = label[label]
            if (deeper == label).all():
                break
            label[:] = deeper


def block_masks(bits: int, blocks: int) -> list[int]:
    """Split the set bits of ``bits`` into ``blocks`` masks of nearly equal size."""
    at = [i for i in range(64) if bits >> i & 1]
    cut = [round(len(at) * i / blocks) for i in range(blocks + 1)]
    return [sum(1 << i for i in at[cut[b] : cut[b + 1]]) for b in range(blocks)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def index_groups(fps: DataFrame, k: int, limit: int, depth: int = 3) -> DataFrame:
    """level, path, bits, fp: every fingerprint in the groups of its masked patterns, groups above ``limit`` dealt again.

    ``path`` numbers the blocks chosen so far and ``bits`` holds the fingerprint under all their masks. At the last
    level a group stays whole at any size; its members then agree on about half of all bits.
    """
    key = ["path", "bits"]
    used = block_masks((1 << 64) - 1, k + 1)  # by path: the bits fixed
    rows = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in used])).alias(*key))
    out = None
    for level in range(depth):
        hot = None
        if level < depth - 1:
            hot = stage(rows.groupBy(*key).count().where(F.col("count") > limit).select(*key), "hot")
            hot = None if hot.isEmpty() else hot
        here = (rows if hot is None else rows.join(hot, key, "left_anti")).select(F.lit(level).alias("level"), *key, "fp")
        out = here if out is None else out.unionByName(here)
        if hot is None:
            return out
        used = [m | fixed for fixed in used for m in block_masks(~fixed & ((1 << 64) - 1), k + 1)]
        masks = F.array(*[F.lit(signed(m)) for m in used])
        below = rows.join(hot, key, "left_semi").select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda b: F.col("path") * (k + 1) + b)).alias("path"))
        rows = below.select("fp", "path", F.col("fp").bitwiseAND(masks[F.col("path")]).alias("bits"))
    return out


def spanning_links(groups: DataFrame, k: int, rows_at_once: int = 1 << 15) -> DataFrame:
    """u, v: links that join the same fingerprints as all links within ``k`` bits do."""

    def changes(*key: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([c[1:] != c[:-1] for c in key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            level, path, bits, fp = (np.concatenate(c) for c in zip(*parts, strict=True))
            new = np.concatenate(([True], changes(level, path, bits)))
            to = group_links(np.cumsum(new), fp.view(U64), k)
            at = np.flatnonzero(to != np.arange(len(fp)))
            return pa.record_batch([pa.array(fp[at]), pa.array(fp[to[at]])], names=["u", "v"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(cols[0]):
                continue
            held.append(cols)
            if sum(len(c[0]) for c in held) < rows_at_once:
                continue
            cols = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            new = np.flatnonzero(changes(*cols[:3]))
            cut = new[-1] + 1 if len(new) else 0  # the last group may go on
            if cut:
                yield found([tuple(c[:cut] for c in cols)])
            held = [tuple(c[cut:] for c in cols)]
        if held:
            yield found(held)

    dealt = groups.repartition("level", "path", "bits").sortWithinPartitions("level", "path", "bits")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of ``links`` (u, v) reaches, by large-star and small-star rounds."""
    edges, before = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        old, edges = edges, stage(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        unstage(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = now


def near_groups(docs: DataFrame, words: int = 4, k: int = 4, limit: int = 4096) -> DataFrame:
    """doc_id, fingerprint, component_id, fp, root (the component's smallest fingerprint), raw_hash: one row per row of ``docs``."""
    table = stage(fingerprints(docs, words), "fingerprints")
    distinct = stage(table.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(spanning_links(index_groups(distinct.select("fp"), k, limit), k))
    named = stage(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "named")
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = named.join(ids, "root").select(F.col("fp").alias("__fp"), "root", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return table.join(by_fp, table["fp"] == by_fp["__fp"]).select("doc_id", digits.alias("fingerprint"), "component_id", "fp", "root", "raw_hash")


# Near copies by similarity: fingerprints of 128 bits, masks drawn at random, links confirmed on the texts.


def shingles(text: bytes, words: int) -> list[bytes]:
    """All runs of ``words`` words, A-Z lower-cased; the whole sequence if it is shorter, none if it is empty."""
    w = text.lower().split()
    line = b" ".join(w)
    if len(w) <= words:
        return [line] if w else []
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [line[a:b] for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def wide_fingerprint(text: bytes, words: int) -> bytes:
    """Majority bits of the 128-bit XXH3 over all shingles, repeats included."""
    every = shingles(text, words)
    total = np.zeros(128, np.int64)
    for i in range(0, len(every), 1 << 14):
        part = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in every[i : i + (1 << 14)]]), np.uint8)
        total += np.unpackbits(part.reshape(-1, 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(every), bitorder="little").tobytes()


def similar(a: set[bytes], b: set[bytes]) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def sketch(text: bytes, words: int) -> bytes:
    """The parity of the number of shingles at each of some bits, four or more for each shingle of the set, 256 at least, a power of two.

    What two sets share falls out when their sketches are XORed, so the bits left are at most as many as the shingles in which the sets differ. A sketch of half
    the bits is the XOR of the halves.
    """
    every = [xxhash.xxh3_64_intdigest(x) for x in set(shingles(text, words))]
    bits = 1 << max(8, (4 * len(every) - 1).bit_length())
    return np.packbits(np.bincount(np.array(every, U64).astype(np.int64) & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def may_link(sketches: np.ndarray, size: np.ndarray, u: np.ndarray, v: np.ndarray, similarity: float, at_once: int = 1 << 21) -> np.ndarray:
    """Which pairs of rows may have that similarity: sets of sizes a and b have it if they differ in (a + b) (1 - similarity) / (1 + similarity) shingles at most; by ``sketch`` no pair that has it is lost."""
    out = np.zeros(len(u), bool)
    width = np.array([len(x) // 8 for x in sketches])
    most = (size[u] + size[v]) * ((1 - similarity) / (1 + similarity)) + 1e-6
    narrow = np.minimum(width[u], width[v])
    for w in np.unique(narrow):
        here = np.flatnonzero(narrow == w)
        ends, place = np.unique(np.concatenate((u[here], v[here])), return_inverse=True)
        x = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[i], U64).reshape(-1, w)) for i in ends])
        step = max(1, at_once // int(w))
        for i in range(0, len(here), step):
            some = slice(i, i + step)
            differ = np.bitwise_count(x[place[: len(here)][some]] ^ x[place[len(here) :][some]]).sum(1, dtype=np.int64)
            out[here[some]] = differ <= most[here[some]]
    return out


def masks_for(n: int, differ: float, recall: float) -> tuple[int, int]:
    """Bits of a mask and number of masks for ``n`` fingerprints: about 64 fingerprints share a pattern (fewer in small tables), and two whose bits differ
    with probability ``differ`` share one of their patterns with probability ``recall``. More rows get longer and more masks without an end, so recall does not fall: at a similarity
    of 0.8 some 130 masks for 10^7 rows, 350 for 10^9, 1840 for 10^12, each a row of 36 bytes to be dealt."""
    bits = max(12, min(40, int(np.ceil(np.log2(max(n, 64) / 64)))))
    return bits, int(np.ceil(np.log(1 - recall) / np.log1p(-((1 - differ) ** bits))))


def masked(nodes: DataFrame, n: int, differ: float, recall: float, seed: int = 42) -> tuple[DataFrame, int, int]:
    """The ``nodes`` (node, hi, lo and others) once for each mask, with mask and key; how many low bits of a key are not the mask's; within how many bits a pair is near.

    A key is the bits under the mask, and below them the Gray rank of some other bits.
    """
    bits, n_masks = masks_for(n, differ, recall)
    k = int(128 * differ + 3 * np.sqrt(128 * differ * (1 - differ)))
    rng = np.random.default_rng(seed)
    places = [rng.permutation(128)[:55] for _ in range(n_masks)]
    rest = 55 - bits
    names = nodes.columns
    hi, lo = names.index("hi"), names.index("lo")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in (hi, lo)], axis=1) if batch.num_rows else np.zeros((0, 2), np.int64)
            each = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
            for m, at in enumerate(places):
                code = np.ascontiguousarray(np.packbits(np.pad(each[:, at], ((0, 0), (9, 0))), axis=1)).view(">u8").ravel().astype(U64)
                low = code & U64((1 << rest) - 1)
                key = (code ^ low) | gray_rank(low)
                yield pa.record_batch([pa.array(np.full(len(key), m, np.int32)), pa.array(key.view(np.int64)), *batch.columns], names=["mask", "key", *names])

    return nodes.mapInArrow(keys, "mask int, key long, " + ", ".join(f"{c} {t}" for c, t in nodes.dtypes).replace("bigint", "long")), rest, k


def candidate_links(nodes: DataFrame, n: int, differ: float, recall: float, chunk: int = 1024, rows_at_once: int = 4096) -> DataFrame:
    """u, v: links between near ``nodes`` (node, hi, lo), a smallest spanning forest for each group of each mask: a first choice, which ``links_apart`` completes.

    Range partitions split groups of any size;
    a task goes over a group above ``chunk`` rows along its Gray order in stretches that overlap by half, so that a row meets ``chunk`` / 2 others on either side at least; the order differs from mask to mask.
    """
    rows, rest, k = masked(nodes.select("node", "hi", "lo"), n, differ, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def heads(mask: np.ndarray, key: np.ndarray) -> np.ndarray:
            """Where another group begins."""
            group = key >> rest
            return np.flatnonzero((mask[1:] != mask[:-1]) | (group[1:] != group[:-1])) + 1

        def found(mask: np.ndarray, key: np.ndarray, node: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            head = np.concatenate(([0], heads(mask, key)))
            size = np.diff(head, append=len(key))
            in_group = np.arange(len(key)) - np.repeat(head, size)
            size = np.repeat(size, size)
            for which, shift in ((size > 1, 0), (size > chunk, chunk // 2)):
                if which.any():
                    first = np.concatenate(([True], (in_group[which][1:] + shift) % chunk == 0)) | (in_group[which] == 0)
                    u, v = group_forest(np.cumsum(first), x[which], k)
                    pair = np.sort(np.stack([node[which][u], node[which][v]]), axis=0)
                    yield pa.record_batch([pa.array(pair[1]), pa.array(pair[0])], names=["u", "v"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in (b.slice(i, rows_at_once) for b in batches for i in range(0, b.num_rows, rows_at_once)):
            mask, key, node, hi, lo = (c.to_numpy() for c in batch.columns)
            held.append((mask, key, node, np.stack([hi, lo], axis=1).view(U64)))
            if sum(len(c[0]) for c in held) < rows_at_once:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            new = heads(*cols[:2])
            cut = new[-1] if len(new) else len(cols[0])  # the last group may go on; one that fills the block goes on from its last stretch
            yield from found(*(c[:cut] for c in cols))
            held = [tuple(c[cut if len(new) else cut - chunk :] for c in cols)]
        if held and len(held[0][0]):
            yield from found(*(np.concatenate(c) for c in zip(*held, strict=True)))

    dealt = rows.repartitionByRange(partitions(nodes.sparkSession), "mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def links_apart(nodes: DataFrame, n: int, differ: float, recall: float, similarity: float = 0.0, chunk: int = 4096, ends_only: bool = False) -> DataFrame:
    """u, v: all pairs of near ``nodes`` (node, hi, lo, size, root, and sketch if there is one) that share a mask's pattern, have different roots, and sizes of sets and sketches that ``similarity`` allows.

    With ``ends_only`` node: the ends of these pairs. So nodes without a pair need no sketch, and pairs that sketches rule out are never rows.

    A group above ``chunk`` rows is cut into parts by a hash, and every two of its parts meet in a task of their own; so each pair of a group is compared, whatever the group's size, and no task holds
    more than about two parts. Groups that are one component by now, as those of a text's many copies, are left out.
    """
    names = ["node", "hi", "lo", "size", "root", *(["sketch"] if "sketch" in nodes.columns else [])]
    rows, rest, k = masked(nodes.select(*names), n, differ, recall)
    group = ["mask", "key"]
    rows = rows.withColumn("key", F.shiftright("key", rest))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("apart"))
    hot = stage(sizes.where(F.col("n") > chunk).select(*group, F.ceil(F.col("n") / chunk).alias("parts"), "apart"), "hot")
    cols = ["mask", "key", "a", "b", "part", *names]
    zero = F.lit(0).cast("long")
    if hot.isEmpty():
        dealt = rows.select(*group, zero.alias("a"), zero.alias("b"), zero.alias("part"), *cols[5:])
    else:
        dealt = rows.join(hot, group, "left_anti").select(*group, zero.alias("a"), zero.alias("b"), zero.alias("part"), *cols[5:])
        cut = rows.join(hot.where("apart"), group).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        cut = cut.withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))
        dealt = dealt.unionByName(cut.select(*group, F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", *cols[5:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            mask, key, a, b, part, node, hi, lo, size, root, *sketches = (np.concatenate(c) for c in zip(*parts, strict=True))
            index = Index(np.cumsum(heads([mask, key, a, b])), np.stack([hi, lo], axis=1).view(U64), label=root)
            ends = np.zeros(len(node), bool)
            for u, v, _ in every_pair(index, k):
                u, v = index.order[u], index.order[v]
                new = (a[u] == b[u]) | (part[u] != part[v])  # pairs within a part meet in its own task
                new &= np.minimum(size[u], size[v]) + 1e-6 >= similarity * np.maximum(size[u], size[v])  # the most that sets of these sizes can share
                u, v = u[new], v[new]
                if sketches:
                    ok = may_link(sketches[0], size, u, v, similarity)
                    u, v = u[ok], v[ok]
                if ends_only:
                    ends[u] = ends[v] = True
                    continue
                pair = np.sort(np.stack([node[u], node[v]]), axis=0)
                yield pa.record_batch([pa.array(pair[1]), pa.array(pair[0])], names=["u", "v"])
            if ends_only:
                yield pa.record_batch([pa.array(np.unique(node[ends]))], names=["node"])

        def heads(key: list[np.ndarray]) -> np.ndarray:
            return np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in key])))

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(c[0]) for c in held) < 2 * chunk:
                continue
            every = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = np.flatnonzero(heads(every[:4]))[-1]  # the last group may go on
            if cut:
                yield from found([[c[:cut] for c in every]])
            held = [[c[cut:] for c in every]]
        if held:
            yield from found(held)

    by = ["mask", "key", "a", "b"]
    return dealt.select(*cols).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "node long" if ends_only else "u long, v long").distinct()


def confirmed(links: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``links`` (u, v) whose texts (node, text) have that similarity of their sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, set()
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            ok = []
            for u, a, b in zip(batch.column(0).to_pylist(), as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
                if u != at:
                    at, mine = u, set(shingles(a, words))
                ok.append(similar(mine, set(shingles(b, words))) >= similarity)
            yield pa.record_batch(batch.columns[:2], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    end = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text"))
    return links.join(end("v"), "v").join(end("u"), "u").select("u", "v", "u_text", "v_text").mapInArrow(run, "u long, v long")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """``docs`` with one row of each component of near copies, that of the smallest id, all columns kept.

    Two documents are linked if their sets of ``words``-word shingles have at least ``similarity`` (Jaccard) and a mask of the index brings them together,
    which it does for pairs at that similarity with about the probability ``recall``, and for nearer ones more often. Links are confirmed on the whole texts: first those of
    forests, then every other pair that a mask brings together, that these leave apart and whose sketches do not rule it out. Texts with equal 128-bit fingerprints are taken as linked.
    """
    text = F.coalesce("text", F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            texts = as_bytes(batch.column(1))
            x = np.frombuffer(b"".join([wide_fingerprint(t, words) for t in texts]), np.int64).reshape(-1, 2)
            size = pa.array([len(set(shingles(t, words))) for t in texts], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(2), *map(pa.array, x.T.copy()), size], names=["doc_id", "raw_hash", "hi", "lo", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("raw_hash"))
    prints = rows.mapInArrow(run, "doc_id long, raw_hash long, hi long, lo long, size long")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw_hash", "size")).alias("m")
    nodes = stage(prints.groupBy("hi", "lo").agg(least).withColumn("node", F.monotonically_increasing_id()), "nodes")
    differ = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    n = nodes.count()

    def texts_of(ends: DataFrame) -> DataFrame:
        wanted = nodes.join(ends, "node").select("node", F.col("m.doc_id").alias("w_id"), F.col("m.raw_hash").alias("w_raw"))
        texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["w_id"]) & (rows["raw_hash"] == wanted["w_raw"])).select("node", "text")
        return stage(texts.dropDuplicates(["node"]), "texts")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            yield pa.record_batch([batch.column(0), pa.array([sketch(t, words) for t in as_bytes(batch.column(1))], pa.binary())], names=["node", "sketch"])

    links = stage(candidate_links(nodes, n, differ, recall), "links")
    texts = texts_of(links.select(F.col("u").alias("node")).union(links.select("v")).distinct())
    good = stage(confirmed(links, texts, words, similarity), "confirmed")
    unstage(texts)
    roots = components(good)
    rooted = stage(nodes.join(roots, "node", "left").select("node", "hi", "lo", F.col("m.size").alias("size"), F.coalesce("root", "node").alias("root")), "rooted")
    ends = stage(links_apart(rooted, n, differ, recall, similarity, ends_only=True), "ends")
    if not ends.isEmpty():
        texts = texts_of(ends)
        sketched = stage(rooted.join(texts.mapInArrow(drawn, "node long, sketch binary"), "node"), "sketched")
        more = stage(links_apart(sketched, n, differ, recall, similarity).join(links, ["u", "v"], "left_anti"), "more-links")
        if not more.isEmpty():
            roots = components(good.union(stage(confirmed(more, texts, words, similarity), "confirmed")))
        unstage(texts, sketched)
    best = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("m").alias("m"))
    return keep_rows(docs, best.select("m.doc_id", "m.raw_hash"))
