"""Token ids on disk as one wavelet matrix per shard.

Documents are range-partitioned by id, so a task holds a run of the global order; it encodes its texts and closes a shard
whenever about ``shard_tokens`` ids are gathered. A shard is one self-contained file (a binary value of a Parquet row, written through
Spark's committer, so that any store and a lost executor are no matter): bit-planes of the ids, highest bit first, each plane stably
partitioned by the one before it, in blocks that are compressed by themselves, with a directory of block sizes and of the ones
before each block. So access, rank (how often an id occurs before a place) and select (where its k-th occurrence is) read a block or two per plane and
never the whole file; ``token_counts`` and ``occurrences`` answer both over all shards.
What is counted over the whole corpus is small: one row per task gives where its first shard starts.

Defined results: a null text counts as empty and is the end id alone; ids ascend with null first; rows that repeat an id stand by
a hash of their texts, then by text, so a run of any length under one id is split between tasks; rows equal in both are of one content, so their order shows nowhere; an empty table gives
no shard and an empty result; a text is never cut, so a shard of one long text is as large as it asks for; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm._common import chunks, partitions, shared_dir, stage
from lectern.llm.packing import ALL_LETTERS, LETTERS, TAIL, spread, strings

END_ID = 2
MAGIC = b"LWM1"
HEAD = struct.Struct("<4sQBI")  # magic, ids, planes, bits of a block
BLOCK_BITS = 1 << 16
SEGMENT = 8 << 20  # bytes of text encoded at once
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"

# What a tokenizer file must say for its texts to be encoded by the pieces between single spaces.
BY_PIECES = {"normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}


class PieceEncoder:
    """Token ids of texts. Where the file says ``BY_PIECES``, no token crosses a single space between two other characters
    but takes it at its front, a single line end is a token, and letters end before stops; so each distinct piece is encoded once and kept in a table of about ``limit``
    pieces. Pieces with more white space at an end (runs of spaces) are glued to their neighbours first. Any other file encodes whole texts.
    """

    def __init__(self, path: str, limit: int = 1_200_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or re.search(r"\s", t["content"]) or re.fullmatch(f"[{LETTERS}]*[{re.escape(TAIL)}]*", t["content"])) for t in file["added_tokens"])
        self.by_pieces = added and all(file[k] == v for k, v in BY_PIECES.items()) and file["model"]["type"] == "BPE" and not file["model"].get("ignore_merges")
        self.vocabulary = self.tokenizer.get_vocab_size()
        ends = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = ends[0] if len(ends) == 1 else None
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {"": 0}
        self.size, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def single(self, texts: list[str]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), 5000):
            yield from (np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts[at : at + 5000], add_special_tokens=False))

    def lines(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of keys without line ends or white space at their ends (but for one space in front), encoded as the lines of one text."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(keys)], add_special_tokens=False)[0].ids, np.int32)
        cuts = np.flatnonzero(ids == self.newline)
        if len(cuts) == len(keys) - 1:
            return np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1
        found = list(self.single(keys))
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def slots(self, keys: list[str], ragged: bool = False) -> np.ndarray:
        """Places of the keys in the table, which takes the new ones."""
        missing = [k for k in dict.fromkeys(keys) if k not in self.slot]
        flat, size = [self.flat], [self.size]
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            if ragged or self.newline is None:
                found = list(self.single(some))
                flat += found
                size.append(np.array([len(x) for x in found], np.int64))
            else:
                ids, n = self.lines(some)
                flat.append(ids)
                size.append(n)
        if missing:
            self.slot.update(zip(missing, range(len(self.slot), len(self.slot) + len(missing)), strict=True))
            self.flat, self.size = np.concatenate(flat), np.concatenate(size)
        return np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))

    def streams(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_pieces:
            return list(self.single([t.decode("utf-8", "replace") for t in texts]))
        if len(self.slot) > self.limit:
            self.clear()
        # A line end is a piece's first character; a piece without one had a space in front of it.
        split = pc.split_pattern(pc.replace_substring(strings(texts), "\n", " \n"), " ")
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        pieces = split.flatten().dictionary_encode()
        code, words = pieces.indices.to_numpy(), pieces.dictionary
        line = pc.starts_with(words, "\n")
        bodies = pc.if_else(line, pc.utf8_slice_codeunits(words, 1), words)
        ragged = pc.match_substring_regex(bodies, f"^{SPACE}|{SPACE}$|^$").to_numpy(zero_copy_only=False)[code]
        first = np.zeros(len(code), bool)
        first[offsets[:-1]] = True
        starts = np.flatnonzero(first | ~(ragged | np.concatenate(([False], ragged[:-1]))))
        sizes = np.diff(starts, append=len(code))
        plain = (sizes == 1) & ~first[starts]

        used = np.unique(code[starts[plain]])
        some, ends_line = bodies.take(pa.array(used)), line.take(pa.array(used))
        cores = pc.ascii_rtrim(some, characters=TAIL)
        letters = pc.match_substring_regex(cores, f"^[{LETTERS}]+$")
        heads = pc.if_else(letters, cores, some)
        heads = pc.if_else(ends_line, heads, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), heads, pa.scalar(" ", pa.large_string())))
        tails = pc.if_else(letters, pc.utf8_ltrim(some, characters=ALL_LETTERS), "")
        unit = np.zeros((len(starts), 3), np.int64)  # a line end, the piece's body, stops behind it
        each = np.zeros((len(words), 3), np.int64)
        each[used, 0] = np.where(ends_line.to_numpy(zero_copy_only=False), self.slots(["\n"], True)[0], 0)
        each[used, 1] = self.slots(listed(heads))
        tails = tails.dictionary_encode()
        each[used, 2] = self.slots(listed(tails.dictionary))[tails.indices.to_numpy()]
        unit[plain] = each[code[starts[plain]]]
        odd = np.flatnonzero(~plain)
        own = listed(words.take(pa.array(code[spread(np.arange(len(code)), starts[odd], sizes[odd])])))
        keys, at = [], 0
        for n, head in zip(sizes[odd].tolist(), first[starts[odd]].tolist(), strict=True):
            text = "".join(p if p[:1] == "\n" else f" {p}" for p in own[at : at + n])
            keys.append(text[1:] if head and own[at][:1] != "\n" else text)
            at += n
        unit[odd, 1] = self.slots(keys, True)

        where = unit.reshape(-1)
        where = where[where > 0]
        stream = spread(self.flat, (np.cumsum(self.size) - self.size)[where], self.size[where])
        upto = np.concatenate(([0], np.cumsum(self.size[unit].sum(1))))[np.searchsorted(starts, offsets)]
        return [stream[a:b] for a, b in pairwise(upto.tolist())]

    def documents(self, texts: list[bytes], end: int) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts = ((d, s) for d, t in enumerate(texts) for s in (segments(t) if self.by_pieces else (t,)))
        for some in chunks(parts, lambda p: len(p[1]), SEGMENT):
            for (d, _), ids in zip(some, self.streams([s for _, s in some]), strict=True):
                out[d].append(ids)
        for ids in out:
            yield np.concatenate((*ids, np.array([end], np.int32)))


def segments(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``SEGMENT`` bytes, cut before a single space between two ASCII characters."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = re.compile(rb"[!-~](?= [!-~])").search(text, at + SEGMENT)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def listed(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def mask(bits: np.ndarray, n: int) -> pa.Array:
    return pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(bits)])


def build(ids: np.ndarray, planes: int) -> bytes:
    """The file of a wavelet matrix over ``ids``, each below 2 to the power of ``planes``."""
    kind, n = (np.uint16 if planes <= 16 else np.uint32), len(ids)
    x, squeeze = ids.astype(kind), zstandard.ZstdCompressor(level=3).compress
    zeros, sizes, before, bodies = [], [], [], []
    for k in range(planes - 1, -1, -1):
        bits = np.packbits((x >> kind(k) & kind(1)).astype(np.uint8), bitorder="little")
        ones = 0
        for at in range(0, len(bits), BLOCK_BITS // 8):
            block = bits[at : at + BLOCK_BITS // 8].tobytes()
            small = squeeze(block)
            bodies.append(small if len(small) < len(block) else block)
            sizes.append(len(bodies[-1]))
            before.append(ones)
            ones += int(np.bitwise_count(np.frombuffer(block, np.uint8)).sum(dtype=np.int64))
        zeros.append(n - ones)
        a = pa.array(x)
        x = np.concatenate((a.filter(mask(~bits, n)).to_numpy(), a.filter(mask(bits, n)).to_numpy())) if n else x
    return b"".join((HEAD.pack(MAGIC, n, planes, BLOCK_BITS), np.array(zeros, "<u8").tobytes(), np.array(sizes, "<u4").tobytes(), np.array(before, "<u8").tobytes(), *bodies))


class WaveletMatrix:
    """Reads the file that ``build`` wrote."""

    def __init__(self, file: bytes):
        magic, self.n, self.planes, self.block = HEAD.unpack_from(file)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.file, at = file, HEAD.size
        self.blocks = -(-self.n // self.block)
        total = self.planes * self.blocks
        self.zeros = np.frombuffer(file, "<u8", self.planes, at).astype(np.int64)
        at += 8 * self.planes
        self.sizes = np.frombuffer(file, "<u4", total, at).astype(np.int64).reshape(self.planes, -1)
        at += 4 * total
        self.before = np.frombuffer(file, "<u8", total, at).astype(np.int64).reshape(self.planes, -1)
        self.begin = (np.cumsum(self.sizes) - self.sizes.reshape(-1)).reshape(self.planes, -1) + at + 8 * total
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def raw(self, plane: int, block: int) -> bytes:
        a, size = int(self.begin[plane, block]), int(self.sizes[plane, block])
        whole = -(-min(self.block, self.n - block * self.block) // 8)
        body = self.file[a : a + size]
        return body if size == whole else zstandard.ZstdDecompressor().decompress(body, max_output_size=whole)

    def bits(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self.held:
            if len(self.held) > 64:
                self.held.clear()
            self.held[plane, block] = np.unpackbits(np.frombuffer(self.raw(plane, block), np.uint8), bitorder="little", count=min(self.block, self.n - block * self.block))
        return self.held[plane, block]

    def rank_one(self, plane: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        if at >= self.n:
            return self.n - int(self.zeros[plane])
        block, rest = divmod(at, self.block)
        return int(self.before[plane, block]) + int(self.bits(plane, block)[:rest].sum(dtype=np.int64))

    def select_bit(self, plane: int, one: int, k: int) -> int:
        """The place of the bit ``one`` (0 or 1) that has ``k`` of its kind before it."""
        before = self.before[plane] if one else np.arange(self.blocks) * self.block - self.before[plane]
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * self.block + int(np.flatnonzero(self.bits(plane, block) == one)[k - int(before[block])])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for p in range(self.planes):
            bit = int(self.bits(p, at // self.block)[at % self.block])
            ones = self.rank_one(p, at)
            at = int(self.zeros[p]) + ones if bit else at - ones
            token = token << 1 | bit
        return token

    def span(self, token: int, upto: int) -> tuple[int, int]:
        """First place and number, in the order below the last plane, of the id's occurrences before ``upto``."""
        low, high = 0, min(upto, self.n)
        if token < 0 or token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            a, b = self.rank_one(p, low), self.rank_one(p, high)
            low, high = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.planes - 1 - p) & 1 else (low - a, high - b)
        return low, high - low

    def rank(self, token: int, upto: int | None = None) -> int:
        """How often the id occurs before a place; by default in all."""
        return self.span(token, self.n if upto is None else upto)[1]

    def select(self, token: int, k: int) -> int:
        """The place of the id's occurrence that has ``k`` others before it."""
        low, n = self.span(token, self.n)
        if not 0 <= k < n:
            raise IndexError(k)
        at = low + k
        for p in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - p) & 1
            at = self.select_bit(p, one, at - int(self.zeros[p]) if one else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids, from the last plane up."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        out, base = np.zeros(self.n, kind), pa.array(np.zeros(self.n, kind))
        for k in range(self.planes if self.n else 0):
            plane = self.planes - 1 - k
            bits, z = np.frombuffer(b"".join(self.raw(plane, b) for b in range(self.blocks)), np.uint8), int(self.zeros[plane])
            out[z:] |= kind(1 << k)
            both = pc.replace_with_mask(base, mask(~bits, self.n), pa.array(out[:z]))
            out = pc.replace_with_mask(both, mask(bits, self.n), pa.array(out[z:])).to_numpy().copy()
        return out


SHARD = "part int, seq int, n_tokens long, doc_ids array<long>, sizes array<long>, file binary"


def write_shards(docs: DataFrame, tokenizer: str | None = None, end: int = END_ID, shard_tokens: int = 1 << 20) -> DataFrame:
    """Encode, write and index ``docs``: the staged table of shards (part, seq, n_tokens, doc_ids, sizes, file), which ascend by (part, seq)."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, planes = encoder(path), max(encoder(path).vocabulary - 1, end).bit_length()
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        n = part = seq = 0

        def shard() -> pa.RecordBatch:
            row = (part, seq, n, ids, [len(h) for h in held], build(np.concatenate(held), planes))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["part", "seq", "n_tokens", "doc_ids", "sizes", "file"])

        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            part = batch.column(2)[0].as_py()
            texts = pc.cast(batch.column(1), pa.large_binary())
            at = 0
            for some in chunks(iter(range(batch.num_rows)), lambda i: len(texts[i].as_buffer()), SEGMENT):
                for tokens in code.documents([texts[i].as_py() for i in some], end):
                    held.append(tokens)
                    ids.append(batch.column(0)[at].as_py())
                    n, at = n + len(tokens), at + 1
                    if n >= shard_tokens:
                        yield shard()
                        held, ids, n, seq = [], [], 0, seq + 1
        if held:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("salt", F.rand(7))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), F.asc_nulls_first("doc_id"), "h", "salt").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "text")
    return stage(dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, SHARD), "token-shards", "uncompressed")


def placed(shards: DataFrame) -> DataFrame:
    """The shards with ``first``, the number of ids before each; what is broadcast has one row per task that wrote some."""
    tasks = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    tasks = tasks.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    own = shards.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    own = own.select("part", "seq", (F.sum("n").over(W.partitionBy("part").orderBy("seq")) - F.col("n")).alias("inner"))
    at = own.join(F.broadcast(tasks), "part").groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("seq", (F.col("base") + F.col("inner")).alias("first")))).alias("firsts"))
    return shards.join(F.broadcast(at), "part").select("*", F.col("firsts")[F.col("seq")].alias("first")).drop("firsts")


def read_documents(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (with ``with_ids`` also ids) of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            first, ids, sizes, file = (batch.column(c)[0].as_py() for c in range(4))
            tokens = WaveletMatrix(file).tokens().astype("<u4")
            ends = np.cumsum(sizes)
            starts = ends - sizes
            cuts = list(zip(starts.tolist(), ends.tolist(), strict=True))
            crc = [zlib.crc32(tokens[a:b]) for a, b in cuts]
            arrays = [pa.array(ids, pa.int64()), pa.array(first + starts), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array([tokens[a:b].astype(np.int32) for a, b in cuts], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.record_batch(arrays, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return placed(shards).select("first", "doc_ids", "sizes", "file").mapInArrow(run, schema)


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: how often each of a few ids occurs in all, by rank in each file."""
    tokens = list(dict.fromkeys(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in (b.column(0)[i].as_py() for b in batches for i in range(b.num_rows)):
            found = WaveletMatrix(file)
            yield pa.record_batch([pa.array(tokens, pa.int64()), pa.array([found.rank(t) for t in tokens], pa.int64())], names=["token", "n"])

    return shards.select("file").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, place: every place in the corpus of each of a few (rare) ids, by select in each file."""
    tokens = list(dict.fromkeys(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                first, found = b.column(0)[i].as_py(), WaveletMatrix(b.column(1)[i].as_py())
                for t in tokens:
                    for at in range(0, n := found.rank(t), 4096):
                        places = [first + found.select(t, k) for k in range(at, min(n, at + 4096))]
                        yield pa.record_batch([pa.array([t] * len(places), pa.int64()), pa.array(places, pa.int64())], names=["token", "place"])

    return placed(shards).select("first", "file").mapInArrow(run, "token long, place long")


def token_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` written as shards below the session's shared folder and read back: doc_id, start, n_tokens, ids_crc32."""
    shared_dir(docs.sparkSession)
    return read_documents(write_shards(docs, **options))
