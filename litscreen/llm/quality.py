"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.llm.common import give_back, keyed_text, map_texts
from litscreen.llm.labelled import TermTable, crc, held_out, training_sample

MAX_LABELLED = 6_000
DIMENSIONS = 64
NEIGHBOURS = 25
LEAST_DOCUMENTS = 3  # a term of fewer sample documents is no part of the space
MAX_TERMS = 60_000
SHARPNESS = 4  # similarity counts to this power

RUNS = [(re.compile(r"[^\W\d_a-zß-ÿ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0")]
REPEAT = re.compile(r"(.)\1+", re.S)


def shape(token: str) -> str:
    """Letters by case, digits as one sign, and other signs themselves, runs taken as one: ``THE!!`` gives ``A!``."""
    for pattern, sign in RUNS:
        token = pattern.sub(sign, token)
    return REPEAT.sub(r"\1", token)[:12]


def code(token: str) -> int:
    """A word and its shape in one number: 31 bits each."""
    word = crc(b"w" + token.lower().encode("utf-8", "surrogatepass")) >> 1
    return word << 31 | crc(b"s" + shape(token).encode("utf-8", "surrogatepass")) >> 1


def terms(table: TermTable, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a text, words and shapes, and how often each occurs."""
    codes = table((text or "").split())
    words, n = np.unique(codes >> 31, return_counts=True)
    shapes, m = np.unique(codes & 0x7FFFFFFF, return_counts=True)
    return np.concatenate([words, shapes | 1 << 31]), np.concatenate([n, m])


@dataclass
class Model:
    """Sent to every task; at most ``MAX_TERMS`` x ``DIMENSIONS`` and ``MAX_LABELLED`` x ``DIMENSIONS`` numbers."""

    known: np.ndarray  # sorted term codes
    weights: np.ndarray  # inverse document frequency of each
    space: np.ndarray  # term x dimension
    points: np.ndarray  # labelled documents, unit length
    labels: np.ndarray
    prior: float

    def place(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Documents in the space, with unit length, or zero if they hold no known term."""
        out = np.zeros((len(documents), self.space.shape[1]), np.float32)
        for i, (ids, counts) in enumerate(documents):
            at, values = weigh(self.known, self.weights, ids, counts)
            if len(at):
                out[i] = values @ self.space[at]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-12)

    def score(self, placed: np.ndarray, k: int = NEIGHBOURS, block: int = 128) -> np.ndarray:
        """Exact cosine products with every labelled point, block by block; the k nearest vote by similarity."""
        out = np.full(len(placed), self.prior)
        if not len(self.labels):
            return out
        k = min(k, len(self.labels))
        for start in range(0, len(placed), block):
            part = placed[start : start + block]
            cosine = part @ self.points.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            votes = np.clip(np.take_along_axis(cosine, near, 1), 0, None) ** SHARPNESS
            total = votes.sum(1)
            share = (votes * self.labels[near]).sum(1) + 0.01 * self.prior
            out[start : start + block] = np.where(total > 0, share / (total + 0.01), self.prior)
        return out


def weigh(known: np.ndarray, weights: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the known terms and their dampened, weighted counts; words and shapes have unit length each."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    at = np.searchsorted(known, ids)
    at[at == len(known)] = 0
    there = known[at] == ids
    at = at[there]
    values = (1 + np.log(counts[there])) * weights[at]
    is_shape = ids[there] >> 31 == 1
    for part in (is_shape, ~is_shape):
        length = np.sqrt((values[part] ** 2).sum())
        if length:
            values[part] /= length
    return at, values.astype(np.float32)


def fit(sample: list[tuple[np.ndarray, np.ndarray, int]], dimensions: int = DIMENSIONS, seed: int = 7) -> Model:
    """Latent space of the sample by a randomised singular value decomposition, and the sample's own places in it."""
    labels = np.array([s[2] for s in sample], np.float32)
    prior = float(labels.mean()) if len(labels) else 0.5
    ids, df = np.unique(np.concatenate([s[0] for s in sample]), return_counts=True) if sample else (np.zeros(0, np.int64),) * 2
    keep = df >= min(LEAST_DOCUMENTS, max(1, len(sample)))
    ids, df = ids[keep].astype(np.int64), df[keep]
    if len(ids) > MAX_TERMS:
        common = np.sort(np.argsort(-df, kind="stable")[:MAX_TERMS])
        ids, df = ids[common], df[common]
    weights = np.log((1 + len(sample)) / (1 + df)) + 1e-3
    rows = [(at.astype(np.int32), v) for at, v in (weigh(ids, weights, s[0], s[1]) for s in sample)]
    d = max(1, min(dimensions, len(sample), len(ids)))
    width = min(d + 8, max(1, len(ids)))
    space = np.random.default_rng(seed).standard_normal((len(ids), width)).astype(np.float32)

    def times(x: np.ndarray) -> np.ndarray:
        return np.stack([v @ x[at] for at, v in rows]) if rows else np.zeros((0, x.shape[1]), np.float32)

    def back(y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), y.shape[1]), np.float32)
        for (at, v), r in zip(rows, y, strict=True):
            out[at] += v[:, None] * r
        return out

    if len(ids) and rows:
        for _ in range(2):
            q, _ = np.linalg.qr(times(space))
            space = back(q)
        _, _, right = np.linalg.svd(space.T, full_matrices=False)
        space = np.ascontiguousarray(right.T[:, :d])
    model = Model(ids, weights.astype(np.float32), space[:, :d], np.zeros((0, d), np.float32), labels, prior)
    model.points = model.place([(s[0], s[1]) for s in sample]) if sample else model.points
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    max_labelled: int = MAX_LABELLED,
    dimensions: int = DIMENSIONS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Learn from at most ``max_labelled`` labelled documents, none of them held out. Terms are counted in the tasks.

    A document's terms and counts reach the driver as bytes, 32 bits each: as arrays of numbers each would be an object there.
    """
    sample = training_sample(docs, labels, label, max_labelled, id_col, text_col)

    def make() -> Callable[[list[str | None]], dict[str, list]]:
        table = TermTable(code)

        def work(batch: list[str | None]) -> dict[str, list]:
            found = [terms(table, text) for text in batch]
            return {"ids": [f[0].astype(np.uint32).tobytes() for f in found], "counts": [f[1].astype(np.uint32).tobytes() for f in found]}

        return work

    counted = map_texts(sample, "text", "ids binary, counts binary", make)
    rows = [(np.frombuffer(r["ids"], np.uint32), np.frombuffer(r["counts"], np.uint32), r["label"]) for r in counted.toLocalIterator()]
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0][:50].tolist()))  # the order of tasks plays no part
    model = fit(rows, dimensions)
    del rows
    give_back()
    return model


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace the text by ``score``, from 0 to 1, higher where label 1 is likelier; every other column is kept.

    Each text is read whole, where it is; nothing is shuffled. A null or empty text, or one that shares no term with the
    sample, scores the share of label 1 in the sample (0.5 without one). Null ids stay, repeated rows give repeated
    results, an empty table gives no rows, and an older column named ``score`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[str | None]], dict[str, list]]:
        table, fitted = TermTable(code), sent.value

        def work(batch: list[str | None]) -> dict[str, list]:
            return {"score": fitted.score(fitted.place([terms(table, text) for text in batch]))}

        return work

    kept = docs.drop("score").withColumn(text_col, F.col(text_col).cast("string"))
    return map_texts(kept, text_col, "score double", make)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    model = train(docs, labels, **options)
    scored = score_quality(keyed_text(docs), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
