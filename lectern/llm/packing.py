"""Packing token sequences by first-fit decreasing, with a tournament tree over bin capacities.

Documents are dealt to random groups by a seeded hash of their row number; each group is tokenised and packed by itself in one
task of about ``task_groups`` groups, in one pass over its texts, so the only shuffle is that of the texts. A document is first cut into full
sequences; the rest of each, in decreasing order, goes to the first bin with room, which the tree finds in a number of
steps logarithmic in the bins. The emptiest bins are then cut up to fill gaps of others, so that about one sequence
of a group is left short. A group that grows beyond ``group_tokens`` is packed in parts.

Defined results: a null text counts as empty and is one piece of the end id alone; a null id is kept; equal rows are
packed as they come, each of its own; an empty table gives an empty result; a text of any length is cut, never dropped.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm._common import as_bytes, chunks, partitions

END_ID = 1
TAIL = ".,!?;:*&%$#|"  # never part of a token that begins with a letter, and no apostrophe
# Latin and Cyrillic letters that composing and lower-casing leave letters; without U+0130, whose lower case ends in a mark.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏЀ-ҁҊ-ԯ"
ALL_LETTERS = "".join(re.findall(f"[{LETTERS}]", "".join(map(chr, range(0x530)))))
SEGMENT = 2 << 20  # bytes of text encoded at once

# What a tokenizer file must say for its texts to be encoded word by word.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def spread(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one behind the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def strings(texts: list[bytes]) -> pa.Array:
    raw = pa.array(texts, pa.large_binary())
    return pa.Array.from_buffers(pa.large_string(), len(raw), raw.buffers())


def segments(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``SEGMENT`` bytes, cut after ASCII white space."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = re.compile(rb"[\x20\x09-\x0D]").search(text, at + SEGMENT)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


class Encoder:
    """Token ids of texts. Where the file splits words as ``BY_WORDS`` says, no token crosses ASCII white space, and a word of
    ``LETTERS`` with stops behind it is the ids of both parts, so each distinct part is encoded once and kept in a
    table of about ``limit`` parts; all other words are encoded as they are. Any other file encodes whole texts.
    """

    def __init__(self, path: str, limit: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        # Added tokens with white space in or stripped around them could reach over words.
        added = all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"])) for t in file["added_tokens"])
        self.by_words = added and file["post_processor"] is None and all(file[k] == v for k, v in BY_WORDS.items()) and file["model"].get("end_of_word_suffix") == "</w>"
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def single(self, parts: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(parts), 5000):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(parts[at : at + 5000], add_special_tokens=False)]
        return out

    def add(self, letters: list[str], others: list[str]) -> None:
        """Put parts into the table; those of letters alone are encoded as one text, whose word ends are known by their tokens."""
        flat, sizes = [self.flat], [self.size]
        for at in range(0, len(letters), 5000):
            some = letters[at : at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                found = self.single(some)
                ids, ends = np.array([i for x in found for i in x], np.int32), np.cumsum([len(x) for x in found])
            flat.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        found = self.single(others)
        flat.append(np.array([i for x in found for i in x], np.int32))
        sizes.append(np.array([len(x) for x in found], np.int64))
        self.slot.update(zip(letters + others, range(len(self.slot), len(self.slot) + len(letters) + len(others)), strict=True))
        self.flat, self.size = np.concatenate(flat), np.concatenate(sizes)

    def parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the two parts of each word; the second is often the empty one."""
        cores = pc.ascii_rtrim(words, characters=TAIL)
        plain = pc.match_substring_regex(cores, f"^[{LETTERS}]+$")
        keys = pc.if_else(plain, pc.ascii_lower(cores), words)
        tails = pc.if_else(plain, pc.utf8_ltrim(words, characters=ALL_LETTERS), "")
        both = pa.concat_arrays([keys, tails]).dictionary_encode()
        distinct = both.dictionary.to_pylist()
        missing = [w for w in distinct if w not in self.slot]
        is_letters = re.compile(f"[{LETTERS}]+").fullmatch
        self.add([w for w in missing if is_letters(w)], [w for w in missing if not is_letters(w)])
        slots = np.fromiter(map(self.slot.__getitem__, distinct), np.int64, len(distinct))[both.indices.to_numpy()]
        return slots[: len(words)], slots[len(words) :]

    def streams(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_words:
            return [np.array(x, np.int32) for x in self.single([t.decode("utf-8", "replace") for t in texts])]
        if len(self.slot) > self.limit:
            self.clear()
        split = pc.ascii_split_whitespace(strings(texts))
        words = split.flatten().dictionary_encode()
        first, second = self.parts(words.dictionary)
        begin = np.cumsum(self.size) - self.size
        n1, n2 = self.size[first], self.size[second]
        where = np.empty(2 * len(first), np.int64)
        where[::2], where[1::2] = first, second
        flat = spread(self.flat, begin[where], self.size[where])
        size = n1 + n2
        code = words.indices.to_numpy()
        each = size[code]
        stream = spread(flat, (np.cumsum(size) - size)[code], each)
        upto = np.concatenate(([0], np.cumsum(each)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [stream[a:b] for a, b in pairwise(upto.tolist())]

    def documents(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        end = np.array([END_ID], np.int32)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        pieces = ((d, s) for d, t in enumerate(texts) for s in (segments(t) if self.by_words else (t,)))
        for some in chunks(pieces, lambda p: len(p[1]), SEGMENT):
            for (d, _), ids in zip(some, self.streams([s for _, s in some]), strict=True):
                out[d].append(ids)
        return [np.concatenate((*ids, end)) for ids in out]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Tournament:
    """Complete binary tree of room left; every node holds the larger of its two."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [room] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first bin with that much room."""
        node = 1
        while node < self.leaves:
            node = 2 * node if self.room[2 * node] >= size else 2 * node + 1
        return node - self.leaves

    def take(self, bin_: int, size: int) -> None:
        node = bin_ + self.leaves
        self.room[node] -= size
        while node > 1:
            node //= 2
            self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])


def pack(sizes: list[int], room: int, least: int = 16) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every document once; gaps under ``least`` stay."""
    full = [[(d, s, room)] for d, n in enumerate(sizes) for s in range(0, n - room + 1, room)]
    rest = sorted(((n % room, d) for d, n in enumerate(sizes) if n % room), key=lambda x: (-x[0], x[1]))
    tree, bins = Tournament(len(rest), room), []
    for n, d in rest:
        b = tree.first(n)
        tree.take(b, n)
        if b == len(bins):
            bins.append([])
        bins[b].append((d, sizes[d] - n, n))
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    fill = [sum(p[2] for p in b) for b in bins]
    gaps = sum(room - f for f in fill if room - f >= least)
    at = 0
    while len(bins) > 1 and fill[-1] <= gaps - (room - fill[-1] if room - fill[-1] >= least else 0):
        loose, n = bins.pop(), fill.pop()
        gaps -= (room - n if room - n >= least else 0) + n
        while loose:
            while at < len(bins) and room - fill[at] < least:
                at += 1
            if at == len(bins):  # crumbs are left: they are a sequence again
                bins.append(loose)
                fill.append(sum(p[2] for p in loose))
                return full + bins
            d, s, k = loose.pop()
            part = min(k, room - fill[at])
            bins[at].append((d, s, part))
            fill[at] += part
            if part < k:
                loose.append((d, s + part, k - part))
    return full + bins


# A sequence's number is its group's, its part's in the group (14 bits) and its own in the part (22 bits, more than the longest text fills).
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed_pieces(docs: DataFrame, tokenizer: str | None = None, room: int = 2048, group_docs: int = 1024, group_tokens: int = 8_000_000, task_groups: int = 32, seed: int = 42, with_ids: bool = False) -> DataFrame:
    """One row per piece; with ``with_ids`` also its token ids. ``tokenizer`` is the path of a tokenizer file."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    groups = max(1, -(-rows.count() // group_docs))
    # Dealt by the number of the row, so that neither equal rows nor rows without an id make a large group.
    rows = rows.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups)))

    def packed(g: int, part: int, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        tokens = encoder(path).documents(texts)
        cols: list[list] = [[] for _ in range(8)]
        for k, pieces in enumerate(pack([len(t) for t in tokens], room)):
            offset = 0
            for d, s, n in pieces:
                piece = tokens[d][s : s + n]
                for c, v in zip(cols, (ids[d], s, n, zlib.crc32(piece.astype("<u4").tobytes()), len(tokens[d]), (g << 36) + (part << 22) + k, offset), strict=False):
                    c.append(v)
                if with_ids:
                    cols[7].append(piece.tolist())
                offset += n
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
        if with_ids:
            names, arrays = [*names, "ids"], [*arrays, pa.array(cols[7], pa.list_(pa.int32()))]
        return pa.record_batch(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, ids, texts, size = None, 0, [], [], 0
        for batch in batches:
            for doc_id, text, g in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if ids and (g != at or size + len(text) > group_tokens):
                    yield packed(at, part, ids, texts)
                    part, ids, texts, size = part + 1, [], [], 0
                if g != at:
                    at, part = g, 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)  # a token has a byte at least
        if ids:
            yield packed(at, part, ids, texts)

    tasks = max(partitions(docs.sparkSession), groups // task_groups)
    dealt = rows.repartition(tasks, "g").sortWithinPartitions("g", "doc_id", "text")
    return dealt.select("doc_id", "text", "g").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
