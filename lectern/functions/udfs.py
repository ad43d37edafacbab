"""Vectorised helpers for what built-in functions cannot say."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOUND = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("is_unique", T.BooleanType())])


def end_distances(text: str, quote: str) -> list[int]:
    """Edit distance of ``quote`` to the nearest window of ``text`` that ends at each character.

    Myers' bit vectors: one column of the distance table is two integers with a bit per character of the quote.
    """
    m = len(quote)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(quote):
        where[c] = where.get(c, 0) | 1 << i
    up, down, d = full, 0, m
    out = []
    for c in text:
        eq = where.get(c, 0)
        x = eq | down
        zero = (((x & up) + up) ^ up) | x
        more, less = down | ~(zero | up), up & zero
        if more & top:
            d += 1
        elif less & top:
            d -= 1
        more, less = more << 1, less << 1
        up, down = (less | ~(zero | more)) & full, more & zero & full
        out.append(d)
    return out


def end_distances_many(texts: list[str], quotes: list[str]) -> np.ndarray:
    """``end_distances`` of many pairs at once, one row each; quotes have 1 to 63 characters. Ends beyond a text are 32767."""
    sizes = np.array([len(t) for t in texts])
    m = np.array([len(q) for q in quotes])
    chars, code = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    inside = np.arange(sizes.max(initial=0)) < sizes[:, None]
    at = np.full(inside.shape, len(chars))
    at[inside] = code
    distinct = {q: i for i, q in enumerate(dict.fromkeys(quotes))}
    of = np.array([distinct[q] for q in quotes])
    length = np.array([len(q) for q in distinct])
    letters = np.frombuffer("".join(distinct).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.searchsorted(chars, letters)
    known = (place < len(chars)) & (chars[np.minimum(place, len(chars) - 1)] == letters)
    bit = np.uint64(1) << (np.arange(len(letters)) - np.repeat(np.cumsum(length) - length, length)).astype(np.uint64)
    where = np.zeros((len(distinct), len(chars) + 1), np.uint64)
    np.bitwise_or.at(where, (np.repeat(np.arange(len(distinct)), length)[known], place[known]), bit[known])
    one = np.uint64(1)
    full, top = (one << m.astype(np.uint64)) - one, one << (m - 1).astype(np.uint64)
    up, down, d = full.copy(), np.zeros_like(full), m.astype(np.int16)
    out = np.full(inside.shape, 32767, np.int16)
    for j in range(inside.shape[1]):
        x = where[of, at[:, j]] | down
        zero = (((x & up) + up) ^ up) | x
        more, less = down | ~(zero | up), up & zero
        d = d + ((more & top) != 0) - ((less & top) != 0)
        more, less = more << one, less << one
        up, down = (less | ~(zero | more)) & full, more & zero & full
        out[:, j] = np.where(inside[:, j], d, 32767)
    return out


def stretches(text: str, quote: str, edits: int) -> list[tuple[int, int]]:
    """Stretches of ``text``, apart from each other, of which each window within ``edits`` of ``quote`` lies in one.

    Of ``edits`` + 1 pieces of the quote one at least is left as it is, so a window lies around a place of a piece.
    """
    m = len(quote)
    if edits >= m:
        return [(0, len(text))]
    around = set()
    for i in range(edits + 1):
        a, b = i * m // (edits + 1), (i + 1) * m // (edits + 1)
        piece, at = quote[a:b], -1
        while (at := text.find(piece, at + 1)) >= 0:
            around.add(at - a)
    out: list[tuple[int, int]] = []
    for start in sorted(around):
        low, high = max(0, start - edits), min(len(text), start + m + edits)
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of distances the least one, and the first and last column that has it."""
    d = distances.min(1)
    same = distances == d[:, None]
    return d, same.argmax(1), distances.shape[1] - 1 - same[:, ::-1].argmax(1)


def grouped(tried: list[tuple], rows: int = 2048, cells: int = 4 << 20) -> Iterator[list[tuple]]:
    """Pairs in order of their stretches' lengths, as many at once as a table of ``cells`` has room for."""
    at = 0
    while at < len(tried):
        n = rows
        while n > 1 and n * len(tried[min(at + n, len(tried)) - 1][2]) > cells:
            n //= 2
        yield tried[at : at + n]
        at += n


NO_WINDOW = {"pos": None, "similarity": None, "is_unique": False}


def best_window(text: str | None, quote: str | None, least: float = 0.0) -> dict:
    """1-based start of the first window of ``text`` nearest to ``quote``, its similarity, and whether all windows as near start within a quote's length.

    Where no window has a similarity of ``least`` there is neither place nor similarity; an empty text or quote has similarity 0.
    """
    return best_windows([text], [quote], [least])[0]


def best_windows(texts: list, quotes: list, least: list[float]) -> list[dict]:
    """``best_window`` of many pairs; only stretches around pieces of the quotes are measured, those with quotes of up to 63 characters together."""
    out = [dict(NO_WINDOW) for _ in texts]
    tried = []
    for i, (t, q, x) in enumerate(zip(texts, quotes, least, strict=True)):
        if not t or not q:
            out[i]["similarity"] = 0.0 if x <= 0 else None
        else:
            tried += [(i, low, t[low:high][::-1], q[::-1]) for low, high in stretches(t, q, int((1 - x) * len(q) + 1e-9))]
    short = sorted((x for x in tried if len(x[3]) < 64), key=lambda x: len(x[2]))
    groups = [[x] for x in tried if len(x[3]) >= 64] + list(grouped(short))
    best: dict[int, tuple[int, int, int]] = {}
    for some in groups:
        rows = end_distances_many([x[2] for x in some], [x[3] for x in some]) if len(some[0][3]) < 64 else np.array([end_distances(*some[0][2:])])
        d, low, high = nearest(rows)
        sizes, allowed = np.array([len(x[3]) for x in some]), np.array([least[x[0]] for x in some])
        for k in np.flatnonzero(1 - d / sizes >= allowed).tolist():
            # A reversed stretch's ends are the windows' starts, counted from 1.
            i, start, text = some[k][:3]
            now = int(d[k]), start + len(text) - int(high[k]), start + len(text) - int(low[k])
            if i in best and best[i][0] <= now[0]:
                now = (now[0], min(now[1], best[i][1]), max(now[2], best[i][2])) if best[i][0] == now[0] else best[i]
            best[i] = now
    for i, (d, first, last) in best.items():
        m = len(quotes[i])
        out[i] = {"pos": first, "similarity": 1 - d / m, "is_unique": last - first < m}
    return out


@F.pandas_udf(FOUND)
def fuzzy_locate(text: pd.Series, quote: pd.Series, least: pd.Series) -> pd.DataFrame:
    """``best_window`` over columns."""
    rows = best_windows(text.tolist(), quote.tolist(), least.tolist())
    return pd.DataFrame(rows, columns=["pos", "similarity", "is_unique"]).astype({"pos": "Int32"})


@F.pandas_udf(T.DoubleType())
def cosine_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine similarity of arrays of equal length; null for zero vectors."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = np.stack(a.to_list()).astype(np.float64), np.stack(b.to_list()).astype(np.float64)
    size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    return pd.Series(np.where(size > 0, (x * y).sum(1) / np.where(size > 0, size, 1), np.nan)).replace(np.nan, None).astype("float64")
