"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's potential is linear in its own features and those of its two neighbours; one
2 x 2 matrix scores neighbouring labels. Forward-backward gives each line's probability of being good; their mean,
weighted by the lines' lengths, is calibrated to the probability that the document's label is 1.

Only documents are labelled, so the field is fitted to lines in two steps: a logistic regression of the document's label
on its lines' features; then each line of a bad document is bad where that regression says so (the worst line at least),
each line of a good document is good, and the field is fitted to these by maximum likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marlspike.llm.common import flat, held_out, labelled_sample, lowered, slices, sums, words

#: At most so many labelled documents are gathered to fit the field.
SAMPLE = 4000
THRESHOLD = 0.3
#: Fitting cuts a document into chains of so many lines; scoring never does.
FIT_LINES = 64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|<>=~^_@\\/[]{}+`")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?'\"()-")] = True
OWN = 17


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, features) of every line, rows in order. A row has one line at least; an empty line has length 0."""
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    last = np.diff(row, append=len(offsets)) > 0
    end = np.where(last, offsets[row + 1], np.append(start[1:], 0) - 1)
    low, capital = lowered(data)
    letter = ((low >= 97) & (low <= 122)) | (data >= 0xC3)
    length = (end - start).astype(np.float64)
    some = np.maximum(length, 1)
    _, w_start, w_end, h = words(data, offsets, low)
    line = np.searchsorted(start, w_start, side="right") - 1
    n_words = np.bincount(line, minlength=len(row)).astype(np.float64)
    again = np.zeros(len(h))
    if len(h):
        again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, again, len(row))
    # a line's hash: its words' hashes, each turned by its place
    with np.errstate(over="ignore"):
        place = np.arange(len(h)) - np.searchsorted(line, line, side="left")
        turned = h * (2 * place + 1).astype(np.uint64)
    whole = np.zeros(len(row), np.uint64)
    np.add.at(whole, line, turned)
    _, inverse, count = np.unique(np.stack([row.astype(np.uint64), whole], 1), axis=0, return_inverse=True, return_counts=True) if len(row) else (None, np.zeros(0, int), np.zeros(0, int))
    copies = (count[inverse.ravel()] > 1) & (n_words > 0) if len(row) else np.zeros(0)
    letters = np.maximum(sums(letter, start, end), 1)
    full = length > 0
    tail = np.where(full, data[np.maximum(end - 1, 0)] if len(data) else 0, 0)
    head = np.where(full, capital[np.minimum(start, max(len(data) - 1, 0))] if len(data) else 0, 0)
    symbol, bang, bar = sums(_SYMBOL[data], start, end), sums(data == 33, start, end), sums(data == 124, start, end)
    some_words = np.maximum(n_words, 1)
    x = np.stack(
        [
            np.log1p(length) / 6,
            symbol / some * 4,
            np.minimum(bang / some_words, 2),
            np.minimum(bar / some_words, 2),
            sums(capital, start, end) / letters,
            sums((data >= 48) & (data <= 57), start, end) / some * 4,
            sums(_STOP[data], start, end) / some * 8,
            np.bincount(line, w_end - w_start, len(row)) / some_words / 10,
            np.log1p(n_words) / 5,
            repeats / some_words,
            copies,
            np.isin(tail, list(b".!?")),
            head,
            np.minimum(symbol / some_words, 3),
            sums(data >= 0x80, start, end) / some,
            sums(data <= 32, start, end) / some,
            ~full,
        ],
        1,
    ).astype(np.float64)
    before, after = np.zeros_like(x), np.zeros_like(x)
    inner = row[1:] == row[:-1]
    before[1:][inner] = x[:-1][inner]
    after[:-1][inner] = x[1:][inner]
    edges = np.ones((len(row), 2))
    edges[1:, 0] -= inner
    edges[:-1, 1] -= inner
    return row, length, np.concatenate([x, before, after, edges, np.ones((len(row), 1))], 1)


def marginals(node: np.ndarray, begin: np.ndarray, count: np.ndarray, pair: np.ndarray, fit: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(probability of good for each line, expected label pairs) by forward-backward over chains begin[i]:begin[i]+count[i].

    node: log-odds of good of each line. pair: log scores of (label, next label). All chains advance together, a line at a time."""
    e = np.stack([1 / (1 + np.exp(np.clip(node, -50, 50))), 1 / (1 + np.exp(-np.clip(node, -50, 50)))], 1) + 1e-12
    a = np.exp(pair)
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    alive = len(count) - np.searchsorted(count[::-1], np.arange(1, count[0] + 1 if len(count) else 1))
    forward, back = np.empty_like(e), np.ones_like(e)
    for t, k in enumerate(alive):
        at = begin[:k] + t
        v = e[at] if t == 0 else (forward[at - 1] @ a) * e[at]
        forward[at] = v / v.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        v = e[at + 1] * back[at + 1]
        if fit:
            joint = forward[at][:, :, None] * a[None] * v[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        v = v @ a.T
        back[at] = v / v.sum(1, keepdims=True)
    p = forward * back
    return p[:, 1] / p.sum(1), pairs


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Field:
    """A fitted field, its calibration, and the score of a document without any text."""

    node: np.ndarray
    pair: np.ndarray
    slope: float
    shift: float

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each row."""
        if len(offsets) < 2:
            return np.zeros(0)
        row, length, x = line_features(data, offsets)
        begin = np.searchsorted(row, np.arange(len(offsets) - 1))
        good, _ = marginals(x @ self.node, begin, np.diff(begin, append=len(row)), self.pair)
        return 1 / (1 + np.exp(-np.clip(self.slope * self._logit(row, length, good, len(offsets) - 1) + self.shift, -30, 30)))

    @staticmethod
    def _logit(row: np.ndarray, length: np.ndarray, good: np.ndarray, n: int) -> np.ndarray:
        weight = np.maximum(length, 1e-3)
        q = np.clip(np.bincount(row, weight * good, n) / np.bincount(row, weight, n), 1e-4, 1 - 1e-4)
        return np.log(q / (1 - q))


def fit(table: pa.Table, steps: int = 80) -> Field:
    """A field fitted to (text, y). Without both labels in the table every document scores the share of label 1."""
    y = table.column("y").to_numpy().astype(np.float64)
    width = OWN * 3 + 3
    if not len(y) or y.min() == y.max():
        rate = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Field(np.zeros(width), np.zeros((2, 2)), 0.0, float(np.log(rate / (1 - rate))))
    parts = []
    for begin in range(0, len(y), 250):  # so that what stands beside the texts stays small
        r, n, f = line_features(*flat(table.column("text").slice(begin, 250)))
        parts.append((r + begin, n, f))
    row, length, x = (np.concatenate(c) for c in zip(*parts, strict=True))
    weight = np.maximum(length, 1) / np.maximum(np.bincount(row, np.maximum(length, 1))[row], 1)
    first = _logistic(x, y[row], weight, 1.0)
    good = x @ first
    label = np.ones(len(row))
    bad = y[row] == 0
    label[bad & (good < 0)] = 0
    order = np.lexsort((good, row))
    worst = order[np.searchsorted(row[order], np.arange(len(y)))]
    label[worst[y == 0]] = 0
    begin = np.searchsorted(row, np.arange(len(y)))
    within = np.arange(len(row)) - begin[row]
    cut = np.flatnonzero(within % FIT_LINES == 0)
    count = np.diff(cut, append=len(row))
    joined = np.ones(len(row), bool)
    joined[cut] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(joined)
    np.add.at(seen, (label[at - 1].astype(int), label[at].astype(int)), 1)
    node, pair = first.copy(), np.zeros((2, 2))
    theta, m, v = np.concatenate([node, pair.ravel()]), 0.0, 0.0
    for i in range(1, steps + 1):
        p, pairs = marginals(x @ theta[:width], cut, count, theta[width:].reshape(2, 2), fit=True)
        g = np.concatenate([x.T @ (label - p), (seen - pairs).ravel()]) / len(row) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    node, pair = theta[:width], theta[width:].reshape(2, 2)
    good, _ = marginals(x @ node, begin, np.diff(begin, append=len(row)), pair)
    z = Field._logit(row, length, good, len(y))
    slope, shift = _logistic(np.stack([z, np.ones(len(z))], 1), y, np.ones(len(y)), 1e-3)
    return Field(node, pair, float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted on at most `sample` labelled documents outside the held-out fifth."""
    return fit(labelled_sample(docs, labels, "quality", sample))


def score(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, held_out, score, predicted. A null text counts as empty; both have a score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(field.documents(*flat(part.column(1))))], ["key", "score"])

    kind = docs.schema[key].dataType
    scored = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, StructType([StructField("key", kind), StructField("score", DoubleType())]))
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, field: Field, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(field.documents(*flat(part.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
