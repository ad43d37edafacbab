"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Per document a short vector of log-transformed ratios is measured. Per class, counts, sums and sums of outer products
are added up in Spark over all training rows, so the fit sees every label and its size on the driver is fixed
(classes x features x features). Class covariances shrink to the pooled one and to a multiple of the identity; their
Cholesky factors are computed once and sent with the task. A score is the logistic of the difference of the classes'
log densities (half squared Mahalanobis distance and half log determinant) plus log priors.

Defined results: a null text counts as empty and is scored like any text; a null label is no label; a document with
both labels counts for both; without any label the score is 0.5, with one class only it is that class; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import as_bytes, remainder, stage


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


LETTERS = _class(bytes(range(65, 91)) + bytes(range(97, 123)))
UPPER, DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
HIGH = np.concatenate((np.zeros(128), np.ones(128)))
SPACE, STOPS, BANGS, BARS = _class(b" \t\r\n\x0b\x0c"), _class(b".,;:?"), _class(b"!"), _class(b"|")
ODD = _class(b"#$%&*@^_=~<>{}[]\\/+")
N_FEATURES = 14
EPS = 1e-3


def distinct_pieces(text: bytes) -> int:
    """How many distinct pieces of 8 bytes the whole text is cut into, a shorter last one included."""
    whole = len(text) // 8
    return len(np.unique(np.frombuffer(text, np.uint64, whole))) + (len(text) > 8 * whole)


def measure(text: bytes) -> list[float]:
    """The document's statistics, log-transformed."""
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    w = len(words)
    lines = text.split(b"\n")
    share = lambda kind, of: float(hist @ kind) / max(of, 1)
    ink = n - float(hist @ SPACE)
    log = lambda x: float(np.log(x + EPS))
    return [
        float(np.log1p(w)),
        log(ink / max(w, 1)),
        log(share(UPPER, hist @ LETTERS)),
        log(share(DIGIT, ink)),
        log(share(HIGH, ink)),
        log(share(STOPS, w)),
        log(share(BANGS, w)),
        log(share(BARS, w)),
        log(share(ODD, w)),
        log(len(set(words)) / max(w, 1)),
        log(sum(a == b for a, b in pairwise(words)) / max(w, 1)),
        log(len(set(lines)) / max(len(lines), 1)),
        log(len(lines) / max(w, 1)),
        log(distinct_pieces(text) / max(n / 8, 1)),
    ]


def measure_all(texts: list[bytes]) -> np.ndarray:
    return np.array([measure(t or b"") for t in texts], np.float64).reshape(-1, N_FEATURES)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measure_all(as_bytes(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and the log terms that do not depend on the document."""

    means: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.means, self.whiten, self.offset, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def moments(rows: DataFrame) -> DataFrame:
    """label, n, s, ss: per class the count, sum and sum of outer products of x, added within tasks before the shuffle."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = np.zeros(2), np.zeros((2, N_FEATURES)), np.zeros((2, N_FEATURES, N_FEATURES))
        for f in frames:
            for c in (0, 1):
                x = f.loc[f["label"] == c, "x"]
                if len(x):
                    x = np.stack(x.to_list())
                    n[c] += len(x)
                    s[c] += x.sum(0)
                    ss[c] += x.T @ x
        for c in (0, 1):
            yield pd.DataFrame({"label": c, "k": np.arange(1 + N_FEATURES + N_FEATURES**2), "v": np.concatenate(([n[c]], s[c], ss[c].ravel()))})

    return rows.select("label", "x").mapInPandas(part, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v"))


def fit(rows: DataFrame, pooled: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Fit on rows of (label, x). ``pooled``: weight of the pooled covariance; ``ridge``: of the scaled identity."""
    got = {(r["label"], r["k"]): r["v"] for r in moments(rows).collect()}  # 2 x (1 + d + d^2) numbers
    size = 1 + N_FEATURES + N_FEATURES**2
    sums = [np.array([got.get((c, k), 0.0) for k in range(size)]) for c in (0, 1)]
    n = np.array([s[0] for s in sums])
    if (n < 2).any():
        return Discriminant(np.zeros(0), np.zeros(0), np.zeros(0), 0.5 if (n == 0).all() else float(np.argmax(n)))
    means = np.array([s[1 : 1 + N_FEATURES] / s[0] for s in sums])
    covs = [s[1 + N_FEATURES :].reshape(N_FEATURES, N_FEATURES) / s[0] - np.outer(m, m) for s, m in zip(sums, means, strict=True)]
    pool = sum(c * k for c, k in zip(covs, n / n.sum(), strict=True))
    whiten, offset = [], []
    for c, k in zip(covs, n, strict=True):
        c = (1 - pooled) * c + pooled * pool
        c = (1 - ridge) * c + ridge * max(np.trace(pool) / N_FEATURES, 1e-9) * np.eye(N_FEATURES)
        factor = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(factor))
        offset.append(np.log(k / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(offset))


def training_rows(table: DataFrame, labels: DataFrame) -> DataFrame:
    """label, x for the labelled rows that may be learnt from: those whose crc32(doc_id as text) mod 4 is not 2."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)").where(remainder(F.col("doc_id"), 4) != 2).distinct()
    return table.join(marks, "doc_id").select("label", "x")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    table = stage(features(docs), "features")
    model = fit(training_rows(table, labels))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_list())) if len(x) else [], dtype="float64")

    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    out = table.select("doc_id", held.alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns kept."""
    model = fit(training_rows(stage(features(docs), "features"), labels))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(measure_all([t.encode() for t in text])), dtype="float64")

    return docs.where(score(F.coalesce("text", F.lit(""))) >= threshold)
