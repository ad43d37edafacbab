"""Chat formatting in windows of a token budget.

Turns of a conversation are laid end to end; prefix sums of their tokens choose spans of whole turns, each as long as the
budget allows beside the system turn and a limited history, both repeated from before. Assistant turns are targets:
a loss mask covers their text where it is new, and not where it is repeated.

A turn is ``### Role: text </turn>`` and a line feed; in role and text, backslash, number sign, less-than sign and (in roles)
colon get a backslash, so no text can look like a mark and reading back gives every turn as it was.

Rows are dealt by conversation and sorted by turn; a task reads them as a stream and holds one window and its history, never a
conversation, so memory does not grow with a hot conversation.

Defined results: null texts and roles count as empty; a null conversation is one of its own; turns go by (turn, role, text), nulls
first, so that ties and repeated rows are all kept, in a fixed order; a turn over the budget is a window of its own, flagged
``over``; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
WINDOW = "conv_id long, window long, text string, n_tokens long, n_repeated long, loss array<struct<start:long,end:long>>, over boolean"


def escape(text: str, marks: str = "\\#<") -> str:
    for c in marks:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn as formatted, and where its text starts in it."""
    head = f"### {escape(role, chr(92) + '#<:')}: "
    return f"{head}{escape(text)} </turn>\n", len(head)


def parse_turns(window: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted window."""
    out, at = [], 0
    while at < len(window):
        m = TURN.match(window, at)
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("turns", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Windows:
    """Windows of one conversation, from turns given one by one."""

    def __init__(self, budget: int, history: int):
        self.budget, self.limit = budget, history
        self.system = None  # the system turn, once met
        self.past: list[tuple] = []  # turns that the next window may repeat
        self.new: list[tuple] = []
        self.sums = [0]  # prefix sums of tokens of the new turns
        self.count = 0

    def repeated(self) -> list[tuple]:
        """System turn and history before the new turns."""
        kept, total = [], 0
        for turn in reversed(self.past):
            if total + turn[4] > self.limit:
                break
            kept.append(turn)
            total += turn[4]
        kept.reverse()
        if self.system is not None and all(t is not self.system for t in kept):
            kept.insert(0, self.system)
        return kept

    def add(self, turn: tuple) -> Iterator[tuple]:
        """turn: role, formatted, text start, text end, tokens. Gives the window that it closes, if any."""
        room = self.budget - sum(t[4] for t in self.head) if self.new else 0
        if self.new and self.sums[-1] + turn[4] > room:
            yield self.close()
        if not self.new:
            self.head = self.repeated()
            room = self.budget - turn[4]
            while self.head and sum(t[4] for t in self.head) > room:  # what is repeated gives way, oldest first, the system turn last
                self.head.pop(1 if len(self.head) > 1 and self.head[0] is self.system else 0)
        self.new.append(turn)
        self.sums.append(self.sums[-1] + turn[4])
        if turn[0] == "system" and self.system is None:
            self.system = turn

    def close(self) -> tuple:
        at, loss, parts = 0, [], []
        for k, (role, text, a, b, _) in enumerate(self.head + self.new):
            if role == "assistant" and k >= len(self.head):
                loss.append({"start": at + a, "end": at + b})
            parts.append(text)
            at += len(text)
        tokens = sum(t[4] for t in self.head) + self.sums[-1]
        row = (self.count, "".join(parts), tokens, len(self.head), loss, tokens > self.budget)
        past, total = [], 0
        for turn in reversed(self.past + self.new):
            past.append(turn)
            total += turn[4]
            if total > self.limit:
                break
        self.past, self.new, self.sums, self.count = past[::-1], [], [0], self.count + 1
        return row


def windows(conversations: DataFrame, budget: int = 1024, history: int = 256, tokenizer: str | None = None) -> DataFrame:
    """conv_id, window (from 0), text, n_tokens, n_repeated (turns at its head that an earlier window has), loss (spans of code points), over."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in WINDOW.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_()]
        flush = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)
        at, open_, out = (), None, []
        for batch in batches:
            ids, roles, texts = (batch.column(k).to_pylist() for k in range(3))
            shaped = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            sizes = map(len, encoding(path).encode_ordinary_batch([s for s, _ in shaped], num_threads=1))
            for conv, role, (text, a), n in zip(ids, roles, shaped, sizes, strict=True):
                if (conv,) != at:
                    if open_:
                        out.append((*at, *open_.close()))
                    at, open_ = (conv,), Windows(budget, history)
                out += [(conv, *w) for w in open_.add((role, text, a, len(text) - len(" </turn>\n"), n))]
            yield flush(out)
            out = []
        if open_:
            yield flush([(*at, *open_.close())])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, WINDOW)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows: digests of what the windows say, read from them alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
        at, out, state = (), [], None
        done = lambda: out.append({"conv_id": at[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4], "n_windows": state[5]})
        for batch in batches:
            for row in batch.to_pylist():
                if (row["conv_id"],) != at:
                    if state:
                        done()
                    at, state = (row["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse_turns(row["text"])[row["n_repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    text = unescape(row["text"][span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(row["text"])
                state[5] += 1
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
        if state:
            done()
            yield pa.RecordBatch.from_pylist(out, schema)

    dealt = formatted.select("conv_id", "window", "text", "n_repeated", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
