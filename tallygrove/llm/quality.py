"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is a node with the labels bad and good. A node's potential is linear in the features of the line
and of its two neighbours, an edge's in the pair of labels. Labels are given for documents only, so training lines carry their
document's label, also those of a mixed document, and within a document the chain sees no change of label: the edge weights say
how strongly neighbours agree. A document's score is the mean of its lines' forward-backward marginals of good, weighted by the
lines' lengths.

The model is fitted on the driver on at most ``max_docs`` labelled documents of at most ``max_chars`` characters each, taken in
the order of a hash of their ids: both bounds hold whatever the tables' size. Scoring runs over whole texts, batch by batch.

Defined cases: null and empty texts score the training share of good documents; labels that are null or name no document
are passed over; of contradicting labels of a document the majority counts, good on a tie; without labels of both kinds the
score is that share (0.5 without any); of rows that repeat a labelled id the fit reads the smallest text; repeated rows are scored each; lang, source and all other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.llm import vec

#: Most labelled documents that the fit collects.
MAX_DOCS = 2000
#: Characters of the longest document that the fit reads; longer ones are only scored.
MAX_CHARS = 50_000
#: Lowest score of a document that counts as good.
THRESHOLD = 0.7
NAMES = ("chars", "words", "upper", "exclaim", "bars", "marks", "digits", "twice", "distinct", "pairs", "mean_word", "short", "repeated", "closed", "blank")
_MARKS, _DIGITS = "#$%&*<>{}[]=+~^@\\_", "0123456789"


def line_features(lines: list[str]) -> list[tuple]:
    """The features of each line of one document, as NAMES has them."""
    seen = Counter(lines)
    out = []
    for line in lines:
        words = line.split()
        n, chars = len(words), len(line)
        if not n:
            out.append((np.log1p(chars), 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 1))
            continue
        lengths = list(map(len, words))
        count = line.count
        pairs = len(set(zip(words, words[1:], strict=False)))
        out.append((
            np.log1p(chars), np.log1p(n), sum(map(str.isupper, words)) / n, min(count("!") / n, 3), min(count("|") / n, 3), min(sum(map(count, _MARKS)) / n, 4), sum(map(count, _DIGITS)) / chars,
            sum(map(eq, words, words[1:])) / n, len(set(words)) / n, pairs / max(1, n - 1), min(np.log1p(sum(lengths) / n), 5), sum(map((4).__gt__, lengths)) / n, seen[line] > 1, words[-1][-1] in ".!?", 0,
        ))
    return out


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, each line's length, each text's number of lines."""
    rows: list[tuple] = []
    weight: list[int] = []
    counts = []
    for text in texts:
        lines = text.split("\n")
        rows += line_features(lines)
        weight += map(len, lines)
        counts.append(len(lines))
    return np.array(rows, dtype=float).reshape(-1, len(NAMES)), np.array(weight, dtype=float), np.array(counts)


def _with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, the line before's and the next one's; zeros and a mark beyond a document's ends; a constant."""
    first = np.zeros(len(x), bool)
    first[np.cumsum(counts) - counts] = True
    last = np.zeros(len(x), bool)
    last[np.cumsum(counts) - 1] = True
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first] = 0
    after[last] = 0
    return np.hstack([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))])


def forward_backward(logit: np.ndarray, length: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """logit: documents by lines, that of good; length: lines of each. The marginals of good, and the expected label pairs."""
    n, steps = logit.shape
    good = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    node = np.stack([1 - good, good], 2)
    psi = np.exp(edge)
    ahead, back = np.empty((n, steps, 2)), np.ones((n, steps, 2))
    ahead[:, 0] = node[:, 0]
    for t in range(1, steps):
        a = ahead[:, t - 1] @ psi * node[:, t]
        ahead[:, t] = a / a.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        b = (node[:, t + 1] * back[:, t + 1]) @ psi.T
        back[:, t] = np.where((t + 1 < length)[:, None], b / b.sum(1, keepdims=True), 1)
    marginal = ahead * back
    marginal = marginal[:, :, 1] / marginal.sum(2)
    pairs = np.zeros((2, 2))
    if steps > 1:
        both = ahead[:, :-1, :, None] * psi * (node * back)[:, 1:, None, :]
        both /= both.sum((2, 3), keepdims=True)
        pairs = (both * (np.arange(1, steps) < length[:, None])[:, :, None, None]).sum((0, 1))
    return marginal, pairs


def _groups(counts: np.ndarray, most: int = 200_000) -> Iterator[np.ndarray]:
    """Documents of similar numbers of lines, so that little is padded."""
    order = np.argsort(counts, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and counts[order[end]] <= max(4, 1.5 * counts[order[at]]) and (end - at + 1) * counts[order[end]] <= most:
            end += 1
        yield order[at:end]
        at = end


def _padded(rows: np.ndarray, start: np.ndarray, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The place of each document's each line, the last one's again beyond its end."""
    steps = int(counts[own].max())
    return start[own][:, None] + np.minimum(np.arange(steps), counts[own][:, None] - 1)


class LineCrf:
    """weights: of the features with neighbours; edge: of label pairs; prior: share of good documents."""

    def __init__(self, weights: np.ndarray | None, edge: np.ndarray | None, mean: np.ndarray | None, scale: np.ndarray | None, prior: float):
        self.weights, self.edge, self.mean, self.scale, self.prior = weights, edge, mean, scale, prior

    @classmethod
    def fit(cls, texts: list[str], good: list[bool], rounds: int = 150, ridge: float = 1e-3) -> LineCrf:
        prior = float(np.mean(good)) if good else 0.5
        if not good or not 0 < prior < 1:
            return cls(None, None, None, None, prior)
        x, _, counts = _features(texts)
        mean, scale = x.mean(0), x.std(0)
        scale[scale == 0] = 1
        x = _with_neighbours((x - mean) / scale, counts)
        label = np.array(good, float)
        start = np.cumsum(counts) - counts
        groups = [(own, _padded(x, start, counts, own)) for own in _groups(counts)]
        inside = [np.arange(p.shape[1]) < counts[own][:, None] for own, p in groups]
        w, edge = np.zeros(x.shape[1]), np.zeros((2, 2))
        # Documents weigh the same, whatever their length.
        per_doc = 1 / counts
        params = np.zeros(len(w) + 4)
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, rounds + 1):
            w, edge = params[:-4], params[-4:].reshape(2, 2)
            logit = x @ w
            residual = np.zeros(len(x))
            d_edge = np.zeros((2, 2))
            for (own, places), mask in zip(groups, inside, strict=True):
                marginal, pairs = forward_backward(logit[places], counts[own], edge)
                got = (label[own][:, None] - marginal) * per_doc[own][:, None]
                residual[places[mask]] = got[mask]
                steps = (counts[own] - 1).sum()
                ones = ((counts[own] - 1) * label[own]).sum()
                d_edge += (np.array([[steps - ones, 0], [0, ones]]) - pairs) / max(1, counts[own].mean())
            grad = np.concatenate([x.T @ residual, d_edge.ravel()]) / len(counts) - ridge * params
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            params = params + 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(params[:-4], params[-4:].reshape(2, 2), mean, scale, prior)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.weights is None or not texts:
            return out
        x, weight, counts = _features(texts)
        logit = _with_neighbours((x - self.mean) / self.scale, counts) @ self.weights
        start = np.cumsum(counts) - counts
        for own in _groups(counts):
            places = _padded(x, start, counts, own)
            marginal, _ = forward_backward(logit[places], counts[own], self.edge)
            share = weight[places] * (np.arange(places.shape[1]) < counts[own][:, None])
            total = share.sum(1)
            out[own] = np.where(total > 0, (share * marginal).sum(1) / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def held_out(key: str = "doc_id") -> F.Column:
    """Whether the row's label is kept from the fit: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> LineCrf:
    known = labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("_good"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # at most max_docs narrow rows, so safe to broadcast
    read = docs.where(F.char_length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = read.groupBy("doc_id", "_good").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    return LineCrf.fit(rows["text"].tolist(), rows["_good"].tolist())


def _scored(model: LineCrf, texts: pa.Array) -> np.ndarray:
    return model.score([x or "" for x in texts.to_pylist()])


def score(docs: DataFrame, model: LineCrf) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.parts(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scored(model, batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.select("doc_id").schema[0], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, model: LineCrf, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.parts(batches, at):
            yield batch.filter(pa.array(_scored(model, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def auc(score: pd.Series, label: pd.Series) -> float:
    """Chance that a good one scores above a bad one; a tie counts half."""
    rank = score.rank()
    n, good = len(label), int(label.sum())
    return float((rank[label == 1].sum() - good * (good + 1) / 2) / max(1, good * (n - good)))
