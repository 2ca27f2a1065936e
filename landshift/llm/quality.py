"""Text quality by pairwise ranking (Bradley-Terry).

A document is described by how its text looks, not by its vocabulary: frequencies of
three-byte shapes over eight classes of bytes, repeated words and lines, lengths. Every
preference pair (a better and a worse labelled document) is an observation that the better
one wins with probability ``sigmoid(score(better) - score(worse))``; the scores are linear in
the description and learned by logistic loss on differences. The cut between the classes is
the quantile of the labelled scores that equals the share of worse documents.

Scores are made comparable by a logistic curve through the cut: a document at the cut gets
``AT_CUT``, and the steepness is fitted to the labels.

Every labelled document is learned from, in pair with every one of the other class. The descriptions are a
stage table; a step adds up, in Spark, how the scores of a class are spread, and then each document's pull and
curvature against the spread of the other class. The driver sees these sums, whose size does not depend on the corpus.

Defined results: null and empty texts are described by zeros and scored like any other;
repeated rows get equal scores; without labels of both classes every score is 0.5; an empty
table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.llm import words
from landshift.llm.labelled import labelled_texts
from landshift.session import materialize

STEPS = 12
DECAY = 1e-3
REACH, BINS = 32.0, 512  # scores are spread over bins between -REACH and REACH while learning
FINE = 4096  # bins that find the cut
AT_CUT = 0.3
CLASSES = 8
SHAPES = CLASSES**3
FEATURES = SHAPES + 6

KIND = np.zeros(256, dtype=np.int64)  # 0: letters, also those beyond ASCII
KIND[ord("A") : ord("Z") + 1] = 1
KIND[ord("0") : ord("9") + 1] = 2
KIND[[9, 11, 12, 13, 32]] = 3
KIND[10] = 4
KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 7
KIND[[ord(c) for c in ".,;:'\"-()"]] = 5
KIND[[ord(c) for c in "!?"]] = 6
LINES = np.zeros(256, dtype=bool)
LINES[10] = True


@dataclass
class Ranking:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    steep: float
    shift: float


def distinct_share(found: words.Words) -> np.ndarray:
    """Share of a row's pieces that differ from each other; 1 where there are none."""
    code = words.codes(found.data, found.starts, found.ends)
    rows = found.rows()
    order = np.lexsort((code, rows))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (np.diff(rows[order]) != 0) | (code[order][1:] != code[order][:-1])
    n = found.counts
    return np.where(n > 0, np.bincount(rows[order], fresh, len(n)) / np.maximum(n, 1), 1.0)


def describe(column: pa.Array) -> np.ndarray:
    """Features of every text, one row each."""
    data, bounds = words.text_bytes(column)
    size = int(bounds[-1])
    rows = np.repeat(np.arange(len(column)), np.diff(bounds))
    kind = KIND[data[:size]]
    out = np.zeros((len(column), FEATURES), dtype=np.float32)
    if size > 2:
        whole = rows[2:] == rows[:-2]
        shape = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        counts = np.bincount(rows[2:][whole] * SHAPES + shape[whole], minlength=len(column) * SHAPES)
        share = counts.reshape(-1, SHAPES) / np.maximum(np.diff(bounds) - 2, 1)[:, None]
        out[:, :SHAPES] = np.sqrt(share)
    found = words.split_words(column)
    lines = words.split_words(column, breaks=LINES)
    length = found.ends - found.starts
    n = np.maximum(found.counts, 1)
    owner = found.rows()
    out[:, SHAPES] = distinct_share(found)
    out[:, SHAPES + 1] = distinct_share(lines)
    out[:, SHAPES + 2] = np.log1p(found.counts)
    out[:, SHAPES + 3] = np.log1p(lines.counts)
    out[:, SHAPES + 4] = np.log1p(np.bincount(owner, length, len(column)) / n)
    out[:, SHAPES + 5] = np.bincount(owner, length <= 3, len(column)) / n
    return out


Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray], tuple[int, int]], np.ndarray]


def _scaled(features: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((features - mean) / spread, -6, 6)


def _sigmoid(gap: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(gap, -30, 30)))


def _bins(value: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    return np.clip((value - low) / (high - low) * bins, 0, bins - 1).astype(np.int64)


def _moments(features: np.ndarray, better: np.ndarray) -> np.ndarray:
    rows = features.astype(np.float64)
    counts = np.zeros(FEATURES)
    counts[:2] = len(better), better.sum()
    return np.stack([counts, rows.sum(axis=0), (rows * rows).sum(axis=0)])


def _weights(total: Total, mean: np.ndarray, spread: np.ndarray, pairs: float) -> np.ndarray:
    """Newton steps on the mean loss over all pairs, with twice the curvature of the rows as bound for that of pairs."""
    middle = -REACH + (np.arange(BINS) + 0.5) * 2 * REACH / BINS
    win = _sigmoid(middle[:, None] - middle[None, :])
    weight = np.zeros(FEATURES)
    for _ in range(STEPS):
        now = weight

        def spread_of(features: np.ndarray, better: np.ndarray) -> np.ndarray:
            at = _bins(_scaled(features, mean, spread) @ now, -REACH, REACH, BINS)
            return np.stack([np.bincount(at[better == c], minlength=BINS).astype(float) for c in (False, True)])

        worse_at, better_at = total(spread_of, (2, BINS))
        # A worse row is pulled down by the chance that it wins against better ones, a better row up by its losses.
        pull = np.stack([win @ better_at, -(win.T @ worse_at)]) / pairs
        bend = np.stack([(win * (1 - win)) @ better_at, (win * (1 - win)) @ worse_at]) / pairs

        def push(features: np.ndarray, better: np.ndarray) -> np.ndarray:
            rows = _scaled(features, mean, spread)
            at = _bins(rows @ now, -REACH, REACH, BINS)
            side = better.astype(np.int64)
            curve = (rows * bend[side, at][:, None]).T @ rows
            return np.column_stack([curve, pull[side, at] @ rows])

        sums = total(push, (FEATURES, FEATURES + 1))
        step = np.linalg.solve(2 * sums[:, :-1] + DECAY * np.eye(FEATURES), sums[:, -1] + DECAY * now)
        weight = now - step
        if np.abs(step).max() < 1e-3:
            break
    return weight


def _cut(total: Total, model: Ranking, count: int, worse: int) -> tuple[float, np.ndarray]:
    """The score with ``worse`` rows below it, and the spread of both classes: counts and sums per bin."""
    reach = 6 * np.abs(model.weight).sum() + 1e-9
    low, high, below, first = -reach, reach, 0.0, None
    for _ in range(4):
        start, end = low, high

        def spread_of(features: np.ndarray, better: np.ndarray) -> np.ndarray:
            value = _scaled(features, model.mean, model.spread) @ model.weight
            inside = (value >= start) & (value < end)
            at, side = _bins(value[inside], start, end, FINE), better[inside]
            parts = [np.bincount(at[side == c], w, FINE) for c in (False, True) for w in (None, value[inside][side == c])]
            return np.stack(parts).astype(float)

        found = total(spread_of, (4, FINE))
        first = found if first is None else first
        upto = below + np.cumsum(found[0] + found[2])
        at = min(int(np.searchsorted(upto, worse / count * (count - 1), side="right")), FINE - 1)
        below = upto[at - 1] if at else below
        low, high = start + (end - start) * at / FINE, start + (end - start) * (at + 1) / FINE
    return (low + high) / 2, first


def _learn(total: Total) -> Ranking:
    counts, sums, squares = total(_moments, (3, FEATURES))
    count, good = int(counts[0]), int(counts[1])
    if not good or good == count:
        return Ranking(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 0.0)
    mean = sums / count
    spread = np.sqrt(np.maximum(squares / count - mean * mean, 0))
    spread = np.where(spread > 1e-4, spread, np.inf)  # a constant feature says nothing
    model = Ranking(mean, spread, _weights(total, mean, spread, float(good) * (count - good)), 1.0, 0.0)
    cut, seen = _cut(total, model, count, count - good)
    number = np.concatenate([seen[0], seen[2]])
    value = np.concatenate([seen[1], seen[3]]) / np.maximum(number, 1) - cut
    better = np.repeat([0.0, 1.0], FINE)
    steep, offset = 1.0, np.log(AT_CUT / (1 - AT_CUT))
    for _ in range(200):  # one parameter: Newton steps on the logistic loss
        p = _sigmoid(steep * value + offset)
        slope = (number * (p - better) * value).sum() / count + 1e-3 * steep
        bend = (number * p * (1 - p) * value**2).sum() / count + 1e-3
        steep = max(steep - np.clip(slope / bend, -0.5, 0.5), 1e-3)
    return Ranking(mean, spread, model.weight, steep, offset - steep * cut)


def fit(features: np.ndarray, labels: np.ndarray, pairs: int | None = None) -> Ranking:
    """Learn from rows in memory. All pairs of a better and a worse row count; ``pairs`` is left for older callers."""
    return _learn(lambda of, shape: of(features, labels > 0) if len(labels) else np.zeros(shape))


def rank(features: np.ndarray, model: Ranking) -> np.ndarray:
    """Scores between 0 and 1."""
    return _sigmoid(model.steep * (_scaled(features, model.mean, model.spread) @ model.weight) + model.shift)


def _totals(described: DataFrame) -> Total:
    """Sums over all rows of a stage table: per task first, then per row of the sum."""

    def total(of: Callable, shape: tuple[int, int]) -> np.ndarray:
        def reduce(batches):
            found = np.zeros(shape)
            for batch in batches:
                rows = batch.column("features").flatten().to_numpy().reshape(-1, FEATURES)
                found += of(rows, batch.column("label").to_numpy() > 0)
            bounds = np.arange(shape[0] + 1, dtype=np.int32) * shape[1]
            task = np.full(shape[0], TaskContext.get().partitionId(), dtype=np.int32)
            values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), pa.array(task), values], ["at", "task", "values"])

        def add(parts: pa.Table) -> pa.Table:
            parts = parts.sort_by("task")  # sums do not depend on the order of arrival
            added = parts.column("values").combine_chunks().flatten().to_numpy().reshape(-1, shape[1]).sum(axis=0)
            return pa.table({"at": parts.column("at")[:1], "values": pa.array([added])})

        parts = described.mapInArrow(reduce, "at int, task int, values array<double>")
        rows = parts.groupBy("at").applyInArrow(add, "at int, values array<double>").toArrow()
        out = np.zeros(shape)
        for at, values in zip(rows.column("at").to_pylist(), rows.column("values")):
            out[at] = values.values.to_numpy()
        return out

    return total


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking:
    """Fit on every labelled document."""
    texts = labelled_texts(docs, labels, label)

    def reduce(batches):
        for part in words.slices(batches):
            rows = describe(part.column("text"))
            bounds = np.arange(len(rows) + 1, dtype=np.int32) * FEATURES
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("label"), lists], ["label", "features"])

    return _learn(_totals(materialize(texts.mapInArrow(reduce, "label int, features array<float>"), f"described-{label}")))


def with_score(docs: DataFrame, model: Ranking, name: str = "score") -> DataFrame:
    """The documents with their score; a column of that name is replaced."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = words.slices([pa.RecordBatch.from_arrays([texts], ["text"])])
        return pa.array(np.concatenate([np.zeros(0), *[rank(describe(p.column("text")), model) for p in parts]]))

    return docs.withColumn(name, score("text"))
