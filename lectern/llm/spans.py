"""Substring dedup over sliding spans of sentences.

A text is cut into sentences, and also after each word that has the smallest hash of some ``WINDOW`` words in a row, over
sentence ends too, whatever the sentences' lengths. So a passage set into other text is cut alike wherever it stands: its
windows are the same in each copy, and 4 x ``WINDOW`` words in a row hold three common pieces. From each piece ("sentence"
below) on, the shortest run of at least ``run`` pieces with ``words`` words is hashed. Hashes are counted over the whole corpus (added up within tasks first); each
hash's first place, by document id and position, is its owner. Every other place is found by joining the runs to the
repeated hashes, written as a table before, so that Spark splits a hot hash's rows in the join, and the sentences that such a run covers are cut out.

Words, windows and runs of many texts are hashed at once: sums of powers over bytes give the hash of every word, and sums over words that of
every run (64 bits each, both odd-base polynomials over random bytes, mixed at the end).

Defined results: a null text counts as empty; a text with fewer sentences or words than a run stays; a run repeated in
its own document goes too; a row is known by the hash of its id and text, so rows without an id, and rows that share one, are documents of
their own; null ids come last in order; of rows equal in id and text one stays and the others lose what repeats (one per task stays where Spark splits a
hot one); an empty table gives an empty result; long texts are cut whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import as_bytes, chunks, stage

SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
STOP = np.isin(np.arange(256), list(b".!?"))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WINDOW = 12
BLOCK = 1 << 20  # bytes whose words are hashed at once
CHUNK = 1 << 20  # bytes of texts that are cut at once
NO_ID = 2**63 - 1
# A random number for each byte, the same for both cases of A-Z.
BYTES = np.random.default_rng(42).integers(1, 2**64, 256, np.uint64)
BYTES[65:91] = BYTES[97:123]


class Powers:
    """Powers of ``BASE`` and of its inverse modulo 2^64, as many as have been asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, b, np.uint64))), dtype=np.uint64) for b in (BASE, INVERSE))
        return cls.up[:n], cls.down[:n]


def mixed(h: np.ndarray, extra: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9) + extra.astype(np.uint64)
    return h ^ (h >> np.uint64(32))


def stretches(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each stretch of ``values``, whatever is before it."""
    up, down = Powers.of(len(values) + 1)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return (upto[end] - upto[begin]) * down[begin]


def word_hashes(raw: np.ndarray, where: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word from ``where`` to ``ends``, A-Z lower-cased."""
    out, a = np.empty(len(where), np.uint64), 0
    while a < len(where):
        b = int(np.searchsorted(ends, where[a] + BLOCK, "right"))
        if b == a:  # a word longer than a block
            out[a] = xxhash.xxh64_intdigest(raw[where[a] : ends[a]].tobytes().lower())
            b = a + 1
        else:
            base = where[a]
            out[a:b] = stretches(BYTES[raw[base : ends[b - 1]]], where[a:b] - base, ends[a:b] - base)
        a = b
    return mixed(out, ends - where)


def cuts(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The words (of texts ``of``, one behind the other) after which a cut is: the first smallest hash of every ``WINDOW`` of a text in a row."""
    n = len(hashes)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    least = (hashes >> np.uint64(33)).astype(np.int64) << 31 | np.arange(n)
    span = 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = (least & ((1 << 31) - 1))[of[: n - WINDOW + 1] == of[WINDOW - 1 :]]
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


class Pieces:
    """The sentences of some texts: ``first[d]`` to ``first[d + 1]`` are those of text d, each from byte ``starts`` of its text on.

    ``begin`` has run starts (numbers of sentences), ``last`` the sentence after each run, ``hash`` the run's hash.
    """

    def __init__(self, texts: list[bytes], run: int, words: int):
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        offset = np.cumsum(sizes) - sizes
        space = np.concatenate(([True], SPACE[raw], [True]))
        where, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        of = np.searchsorted(offset, where, "right") - 1
        hashes = word_hashes(raw, where, ends)
        lines = np.searchsorted(np.flatnonzero(raw == 10), where)
        new = np.ones(len(where) + 1, bool)
        if len(where):
            new[1:-1] = STOP[raw[ends[:-1] - 1]] | (lines[1:] > lines[:-1]) | (of[1:] != of[:-1])
            new[cuts(hashes, of) + 1] = True
        at = np.flatnonzero(new[:-1])
        self.first = np.searchsorted(of[at], np.arange(len(texts) + 1))
        self.starts = where[at] - offset[of[at]]
        # White space before the first word belongs to the first piece.
        self.starts[self.first[:-1][self.first[:-1] < self.first[1:]]] = 0
        bounds = np.append(at, len(where))
        last = np.maximum(np.searchsorted(bounds, at + words), np.arange(len(at)) + run)
        ok = last <= self.first[1:][of[at]]
        self.begin, self.last = np.flatnonzero(ok), last[ok]
        self.of = of[at]
        self.hash = mixed(stretches(hashes, bounds[self.begin], bounds[self.last]), self.last - self.begin).view(np.int64)


def dedup_spans(docs: DataFrame, run: int = 3, words: int = 20) -> DataFrame:
    """doc_id, text (without repeated spans), n_sentences, removed_sentences, removed_chars: one row per row of ``docs``."""
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(NO_ID)).alias("id"), F.xxhash64(doc_id, text).alias("key"))

    def sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            at = 0
            for some in chunks(iter(as_bytes(batch.column(column))), len, CHUNK):
                yield batch.slice(at, len(some)), some
                at += len(some)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, 2):
            p = Pieces(texts, run, words)
            of = p.of[p.begin]
            ids, keys = (batch.column(k).to_numpy()[of] for k in (0, 1))
            yield pa.record_batch([pa.array(p.hash), pa.array(ids), pa.array(keys), pa.array((p.begin - p.first[of]).astype(np.int32))], names=["h", "id", "key", "i"])

    places = stage(rows.select("id", "key", "text").mapInArrow(emit, "h long, id long, key long, i int"), "runs")  # read twice, cut and hashed once
    owners = places.groupBy("h").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("h", "first_id")
    # As a table, the repeated hashes are shuffled for the join alone, so that Spark can split a hot hash's rows there.
    found = stage(places.join(stage(owners, "repeated-spans"), "h"), "repeated-places")
    first = stage(found.where("id = first_id").groupBy("h").agg(F.min("key").alias("first_key")), "owners")
    again = found.join(first, "h").select("key", "i", "h", ((F.col("id") == F.col("first_id")) & (F.col("key") == F.col("first_key"))).alias("own"))
    again = again.groupBy(F.col("key").alias("r_key")).agg(F.collect_set(F.struct("i", "h", "own")).alias("again"))

    def gone(p: Pieces, batch: pa.RecordBatch, copies: np.ndarray) -> np.ndarray:
        """Which sentences a repeated run covers; the owner's first place of a hash stays, but in a copy of the row before."""
        lists = batch.column(3)
        entries = lists.flatten()
        i, h, own = (entries.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        n = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(len(n)), np.where(np.array(lists.is_valid()), n, 0))
        at = p.first[doc] + i
        order = np.lexsort((at, h, doc))
        doc, h, own, at = doc[order], h[order], own[order].astype(bool), at[order]
        head = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(doc) else np.zeros(0, bool)
        cut = ~(own & head) | copies[doc]
        cover = np.zeros(len(p.starts) + 1, np.int64)
        k = np.searchsorted(p.begin, at[cut])
        np.add.at(cover, at[cut], 1)
        np.add.at(cover, p.last[k], -1)
        return np.cumsum(cover)[:-1] > 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch, texts in sliced(batches, 2):
            keys = batch.column(1).to_numpy()
            copies = keys == np.concatenate(([keys[0] if before is None else before], keys[:-1]))
            copies[0] &= before is not None
            before = keys[-1]
            p = Pieces(texts, run, words)
            lost = gone(p, batch, copies)
            sizes = np.diff(p.first)
            removed = np.diff(np.concatenate(([0], np.cumsum(lost)))[p.first])
            chars = np.zeros(len(texts), np.int64)
            for d in np.flatnonzero(removed).tolist():
                text, a, b = texts[d], p.first[d], p.first[d + 1]
                bounds = [*p.starts[a:b].tolist(), len(text)]
                texts[d] = b"".join(text[x:y] for x, y, g in zip(bounds, bounds[1:], lost[a:b].tolist(), strict=False) if not g)
                chars[d] = len(text.decode()) - len(texts[d].decode())
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), *map(pa.array, (sizes, removed, chars))], names=["doc_id", "text", "n_sentences", "removed_sentences", "removed_chars"])

    both = rows.hint("merge").join(again, F.col("key") == F.col("r_key"), "left").select("doc_id", "key", "text", "again")
    return both.mapInArrow(cut, "doc_id long, text string, n_sentences long, removed_sentences long, removed_chars long")
