"""Bounded samples of labelled documents, and hashed terms of texts: what the trained operators share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMS_KEPT = 400_000


def held_out(id_col: str = "doc_id"):
    """True for the documents whose labels are never learned from. A null id is not held out, and has no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """At most ``max_rows`` labelled documents (``text``, ``label``), those with the smallest hash of their id.

    Held-out documents never come in. Rows without id, text or label are left out, and so are ids whose labels
    contradict each other; repeated labels count once. Ids are chosen before any text is read, so what is sent is bounded
    by ``max_rows`` ids and their texts.
    """
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .filter("label = most")
        .select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.filter(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id").select("text", "label")


class TermTable:
    """Hash codes of tokens, kept in a table of bounded size so that a token is looked at once per process."""

    def __init__(self, code: Callable[[object], int]):
        self.code, self.known = code, {}

    def __call__(self, tokens: Iterable) -> np.ndarray:
        tokens = list(tokens)
        try:
            return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            out = np.empty(len(tokens), np.int64)
            for i, token in enumerate(tokens):
                code = self.known.get(token)
                if code is None:
                    code = self.code(token)
                    if len(self.known) < TERMS_KEPT:
                        self.known[token] = code
                out[i] = code
            return out


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def accuracy(scores: np.ndarray, labels: np.ndarray, threshold: float) -> tuple[float, float]:
    """Share of right decisions, and the area under the curve, with ties counted half."""
    order = np.argsort(scores, kind="stable")
    values, start, n = np.unique(scores[order], return_index=True, return_counts=True)
    ranks = np.empty(len(scores))
    ranks[order] = np.repeat(start + (n + 1) / 2, n)
    pos = labels == 1
    p, q = pos.sum(), (~pos).sum()
    area = (ranks[pos].sum() - p * (p + 1) / 2) / max(1, p * q)
    return float(((scores >= threshold) == pos).mean()), float(area)
