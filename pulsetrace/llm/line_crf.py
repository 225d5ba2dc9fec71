"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are its own, its neighbours' (the line before and after) and the chain's
transitions; forward-backward gives every line's marginal, and the document's score is the length-weighted mean
of the good marginals, mapped to the probability of label 1 by a logistic curve.

Fitting. Labels are per document, so line labels are found in two steps: a line model is fitted to the labels of
the documents, then only the lines of bad documents that it finds bad (the worst one at least) stay bad, and the
chain is fitted to that by full-batch gradient steps with momentum. The sample is bounded by documented
parameters; scoring covers every line of every text, in Arrow batches.

Defined cases. Null or empty text: one empty line, scored like any other. Null doc_id: hashed as the empty text.
Labels that are null, repeated or without a document are passed over or counted as often as they occur; without
both kinds of label every document scores the share of good ones (0.5 without any). Repeated rows: each its own.
Empty table: empty result. Columns other than doc_id and text are never inputs.
"""

from __future__ import annotations

import math
import operator
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetrace.llm.common import named, text_of
from pulsetrace.session import materialise


@dataclass(frozen=True)
class Fit:
    """``docs_per_class`` and ``max_lines`` bound the sample that the model is fitted on: so many documents of each
    label, by hash of the id, from those with no more lines and characters than that; of an id that several documents
    share, one text. Nothing else is bounded."""

    docs_per_class: int = 1500
    max_lines: int = 400
    max_chars: int = 100_000
    steps: int = 250
    rate: float = 0.3
    ridge: float = 1e-3
    threshold: float = 0.7


UPPER, DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
MARKS, BARS, SHOUTS = b"#*$%&<>{}[]\\^~=_", b"|", b"!?"
FEATURES = 13


def features(line: bytes, seen: bool) -> tuple[float, ...]:
    """What one line looks like; shares of its bytes or words."""
    size, words = len(line), line.split()
    count = len(words)
    if not count:
        return (1.0, 1.0, *(0.0,) * (FEATURES - 2))
    share = lambda chars: (size - len(line.translate(None, chars))) / size
    repeats = sum(map(operator.eq, words, words[1:]))
    return (1.0, 0.0, math.log1p(count) / 4, 5 * share(MARKS), 5 * share(BARS), 5 * share(SHOUTS), 3 * share(UPPER),
            3 * share(DIGITS), repeats / count, 1 - len(set(words)) / count, size / count / 10, float(seen),
            float(words[-1][-1:] in b".!?:;"))


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and lengths (bytes, 1 at least) of a text's lines."""
    rows, lengths, seen = [], [], set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        rows.append(features(line, line in seen))
        lengths.append(max(1, len(line)))
        seen.add(line)
    return np.array(rows), np.array(lengths, float)


def with_neighbours(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after in the same text, zero beyond its ends."""
    ends = np.cumsum(sizes)
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    before[ends - sizes], after[ends - 1] = 0, 0
    return np.hstack([rows, before, after])


class Chains:
    """Texts of different length side by side, longest first, for sweeps over all of them at once."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.first = (np.cumsum(sizes) - sizes)[self.order]
        steps = int(sizes.max(initial=0))
        self.active = np.searchsorted(-self.sizes, -np.arange(1, steps + 1), side="right")

    def sweep(self, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Line marginals (n, 2), summed pair marginals (2, 2) and the log partition of all chains."""
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        for t, n in enumerate(self.active):
            at = self.first[:n] + t
            alpha[at] = emit[at] if t == 0 else emit[at] + np.logaddexp(
                alpha[at - 1][:, :1] + trans[0], alpha[at - 1][:, 1:] + trans[1])
        last = self.first + self.sizes - 1
        for t in range(len(self.active) - 2, -1, -1):
            at = self.first[: self.active[t + 1]] + t
            ahead = emit[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(trans[:, 0] + ahead[:, :1], trans[:, 1] + ahead[:, 1:])
        total = np.logaddexp(alpha[last, 0], alpha[last, 1])
        logz = np.empty(len(emit))
        inner = np.ones(len(emit), bool)
        inner[last] = False
        logz[np.concatenate([np.arange(f, f + s) for f, s in zip(self.first, self.sizes)])] = np.repeat(total, self.sizes)
        marginal = np.exp(alpha + beta - logz[:, None])
        here = np.flatnonzero(inner)
        both = np.exp(alpha[here][:, :, None] + trans + (emit + beta)[here + 1][:, None, :] - logz[here][:, None, None])
        return marginal, both.sum(axis=0), float(total.sum())


@dataclass
class Model:
    weights: np.ndarray  # of "bad", for a line's features and its neighbours'
    trans: np.ndarray
    slope: float
    offset: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 of each text."""
        parts = [lines_of(t) for t in texts]
        sizes = np.array([len(lengths) for _, lengths in parts])
        if not len(sizes):
            return np.empty(0)
        good = self.good(np.vstack([r for r, _ in parts]), np.concatenate([x for _, x in parts]), sizes)
        return sigmoid(self.slope * logit(good) + self.offset)

    def good(self, rows: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' good marginals of each text."""
        bad = with_neighbours(rows, sizes) @ self.weights
        marginal, _, _ = Chains(sizes).sweep(np.stack([np.zeros_like(bad), bad], axis=1), self.trans)
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(marginal[:, 0] * lengths, starts) / np.add.reduceat(lengths, starts)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fit: Fit) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(25):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + fit.ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + fit.ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], labels: np.ndarray, fit: Fit = Fit()) -> Model:
    """The chain and its curve from whole texts and their labels (1 good, 0 bad)."""
    share = float(labels.mean()) if len(labels) else 0.5
    flat = Model(np.zeros(3 * FEATURES), np.zeros((2, 2)), 0.0, float(logit(np.array(share))))
    if share in (0.0, 1.0) or not len(labels):
        return flat
    parts = [lines_of(t) for t in texts]
    sizes = np.array([len(x) for _, x in parts])
    rows, lengths = np.vstack([r for r, _ in parts]), np.concatenate([x for _, x in parts])
    x = with_neighbours(rows, sizes)
    doc_bad = np.repeat(1 - labels, sizes)
    starts = np.cumsum(sizes) - sizes
    p = sigmoid(x @ logistic(x, doc_bad, lengths, fit))
    worst = np.repeat(np.maximum.reduceat(p, starts), sizes)
    bad = (doc_bad == 1) & ((p > 0.5) | (p == worst))
    chains, inner = Chains(sizes), np.ones(len(x), bool)
    inner[starts + sizes - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (bad[at].astype(int), bad[at + 1].astype(int)), 1)
    model = Model(logistic(x, bad.astype(float), np.ones(len(x)), fit), np.zeros((2, 2)), 1.0, 0.0)
    pace_w, pace_t, n = np.zeros_like(model.weights), np.zeros((2, 2)), len(x)
    for _ in range(fit.steps):
        emit = x @ model.weights
        marginal, both, _ = chains.sweep(np.stack([np.zeros_like(emit), emit], axis=1), model.trans)
        pace_w = 0.9 * pace_w - fit.rate * (x.T @ (marginal[:, 1] - bad) / n + fit.ridge * model.weights)
        pace_t = 0.9 * pace_t - fit.rate * ((both - seen) / n + fit.ridge * model.trans)
        model.weights = model.weights + pace_w
        model.trans = model.trans + pace_t
    good = logit(model.good(rows, lengths, sizes))
    curve = logistic(np.stack([good, np.ones_like(good)], axis=1), labels.astype(float), np.ones(len(good)), fit)
    model.slope, model.offset = float(curve[0]), float(curve[1])
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, fit: Fit) -> tuple[list[str], np.ndarray]:
    """Texts and labels to learn from, at most 2 * docs_per_class, ordered by id."""
    texts = docs.select(named("doc_id").cast("long").alias("id"), text_of().alias("text")).where(
        (F.size(F.split("text", "\n")) <= fit.max_lines) & (F.char_length("text") <= fit.max_chars)).withColumn(
        "mark", F.xxhash64("text"))
    # One text of each id, known by its hash, before anything is limited.
    usable = texts.groupBy("id").agg(F.min("mark").alias("mark"))
    known = labels.select(named("doc_id").cast("long").alias("id"), named("quality").cast("int").alias("label")).where(
        ~held_out(F.col("id")) & F.col("id").isNotNull()).join(usable, "id")
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(fit.docs_per_class)
        chosen = part if chosen is None else chosen.union(part)
    # Bounded by the limits above, so it fits beside any task.
    chosen = materialise(chosen)
    picked = texts.join(F.broadcast(chosen.select("id", "mark").distinct()), ["id", "mark"]).groupBy("id").agg(F.min("text").alias("text"))
    rows = picked.join(chosen, "id").select("id", "text", "label").collect()
    rows.sort(key=lambda r: (r.id, r.text))
    return [r.text for r in rows], np.array([r.label for r in rows])


def score(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(*sample(docs, labels, fit), fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist()), pa.float64())],
                                                 names=["doc_id", "score"])

    scored = docs.select(named("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= fit.threshold).cast("int").alias("predicted"))
