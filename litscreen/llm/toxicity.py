"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.llm.common import keyed_text, map_texts
from litscreen.llm.decontaminate import words_of
from litscreen.llm.labelled import TERMS_KEPT, crc, held_out, training_sample

MAX_LABELLED = 6_000
MAX_TERMS = 2_048
COMMON, SURE = 128, 2.5  # of them by document count; least score of the others, in standard deviations
FACTORS = 8
STEMS = (4, 5, 6, 7)  # a word's first bytes count as terms too, so that forms of a word that no label has seen tell
OFTEN = (1, 2, 4)  # a term that occurs at least so often is a term of its own


class Terms:
    """Distinct hashed terms of a text: words, A-Z lower-cased, and their beginnings, each with how often it is there.

    ``only`` leaves out what a model doesn't know. The codes of a word are kept while the table has room.
    """

    def __init__(self, only: np.ndarray | None = None):
        self.only = None if only is None else set(only.tolist())
        self.known: dict[bytes, tuple[int, ...]] = {}

    def codes(self, word: bytes) -> tuple[int, ...]:
        got = (crc(word), *(crc(word[:k] + b"-") for k in STEMS))
        if self.only is not None:
            got = tuple(c for c in got if any(often(c, k) in self.only for k in OFTEN))
        if len(self.known) < TERMS_KEPT:
            self.known[word] = got
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        totals: dict[int, int] = {}
        known = self.known.get
        for word, n in Counter(words_of(text)).items():
            codes = known(word)
            for code in self.codes(word) if codes is None else codes:
                totals[code] = totals.get(code, 0) + n
        found = {often(code, k) for code, total in totals.items() for k in OFTEN if total >= k}
        return np.array(sorted(found), np.uint32)


def often(code: int, k: int) -> int:
    return code * (2 * k + 1) & 0xFFFFFFFF


@dataclass
class Machine:
    """bias + sum of weights + sum over pairs of terms of the product of their factors; at most ``MAX_TERMS`` terms."""

    known: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def columns(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.known, ids)
        at[at == len(self.known)] = 0
        return at[self.known[at] == ids]

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(documents))
        for i, ids in enumerate(documents):
            at = self.columns(ids)
            v = self.factors[at]
            pairs = 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
            out[i] = self.bias + self.weights[at].sum() + pairs
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def choose_terms(sample: list[tuple[np.ndarray, int]], most: int = MAX_TERMS) -> np.ndarray:
    """The terms that tell the labels apart most surely, and a few of the commonest, for pairs with them."""
    if not sample:
        return np.zeros(0, np.uint32)
    ids, at = np.unique(np.concatenate([s[0] for s in sample]), return_inverse=True)
    labels = np.repeat([s[1] for s in sample], [len(s[0]) for s in sample])
    df = np.bincount(at, minlength=len(ids))
    positive = np.bincount(at, weights=labels, minlength=len(ids))
    rate = float(np.mean([s[1] for s in sample]))
    z = np.abs(positive - df * rate) / np.sqrt(df * rate * (1 - rate) + 0.5)
    z[df < 3] = 0
    telling = np.argsort(-z, kind="stable")[: most - COMMON]
    telling = telling[z[telling] >= SURE]
    common = np.argsort(-df, kind="stable")[:COMMON]
    return ids[np.unique(np.concatenate([telling, common]))]


def fit(
    sample: list[tuple[np.ndarray, int]], factors: int = FACTORS, epochs: int = 30, rate: float = 0.05, decay: float = 2e-4,
    seed: int = 11, most: int = MAX_TERMS,
) -> Machine:
    """Logistic loss by adaptive gradient steps over shuffled blocks of documents; both labels weigh alike in all."""
    known = choose_terms(sample, most)
    n = len(known)
    rng = np.random.default_rng(seed)
    labels = np.array([s[1] for s in sample], np.float64)
    share = labels.mean() if len(labels) else 0.0
    machine = Machine(known, np.zeros(n), rng.normal(0, 0.01, (n, factors)), 0.0)
    if not len(labels) or share in (0.0, 1.0):
        machine.bias = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
        machine.factors[:] = 0
        return machine
    columns = [machine.columns(s[0]) for s in sample]
    weight = np.where(labels == 1, min(10.0, 0.5 / share), 0.5 / (1 - share))
    w, v, b = machine.weights, machine.factors, float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(n, 1e-6), np.full((n, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), 256):
            some = order[start : start + 256]
            x = np.zeros((len(some), n))
            for i, j in enumerate(some):
                x[i, columns[j]] = 1
            s = x @ v
            total = b + x @ w + 0.5 * ((s**2).sum(1) - x @ (v**2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels[some]) * weight[some] / len(some)
            dw = x.T @ error + decay * w
            dv = x.T @ (error[:, None] * s) - v * (x.T @ error)[:, None] + decay * v
            db = error.sum()
            gw += dw**2
            gv += dv**2
            gb += db**2
            w -= rate * dw / np.sqrt(gw)
            v -= 0.2 * rate * dv / np.sqrt(gv)
            b -= rate * db / np.sqrt(gb)
    machine.bias = float(b)
    return machine


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED, id_col: str = "doc_id",
    text_col: str = "text",
) -> Machine:
    """Learn from at most ``max_labelled`` labelled documents, none of them held out. Terms are hashed in the tasks."""
    sample = training_sample(docs, labels, label, max_labelled, id_col, text_col)

    def make() -> Callable[[list[str | None]], dict[str, list]]:
        terms = Terms()
        return lambda batch: {"ids": [terms(text) for text in batch]}

    counted = map_texts(sample, "text", "ids array<long>", make)
    rows = [(np.array(r["ids"], np.uint32), r["label"]) for r in counted.toLocalIterator()]
    rows.sort(key=lambda r: (r[1], len(r[0]), r[0][:50].tolist()))  # the order of tasks plays no part
    return fit(rows)


def score_toxicity(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """Replace the text by ``score``, from 0 to 1, higher where label 1 is likelier; every other column is kept.

    Each text is read whole, where it is; nothing is shuffled. A null or empty text scores by the bias alone. Null ids
    stay, repeated rows give repeated results, an empty table gives no rows, and an older column named ``score`` is
    replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def make() -> Callable[[list[str | None]], dict[str, list]]:
        fitted = sent.value
        terms = Terms(fitted.known)
        return lambda batch: {"score": fitted.score([terms(text) for text in batch])}

    kept = docs.drop("score").withColumn(text_col, F.col(text_col).cast("string"))
    return map_texts(kept, text_col, "score double", make)


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    machine = train(docs, labels, **options)
    scored = score_toxicity(keyed_text(docs), machine)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
