"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased runs of bytes between white space and ASCII punctuation,
and their beginnings (``PREFIXES`` bytes), since inflected insults share a stem; each is
hashed to 32 bits and graded by how often it occurs (once, twice, four, eight times). A term for
the text's length stands beside them. Training counts, for every graded term, the labelled
documents of either class that hold it, and keeps at most ``MAX_TERMS`` telling ones (a
log-likelihood ratio test); all others say nothing, however long a text is. The machine
gives each kept term a weight and a vector; inner products of vectors are learned weights of
pairs, so two terms can mean together what neither means alone.

Counting and scoring are Spark jobs over whole texts. The fit sees a bounded sample
(``SAMPLE`` documents, ``MAX_TERMS`` terms), so it runs on the driver at any corpus size.

Defined results: null and empty texts get the score of a document without terms;
repeated rows get equal scores; without any labelled row every score is the prior 0.25;
an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.llm import words
from landshift.llm.labelled import labelled_sample

SAMPLE = 20_000
MAX_TERMS = 4_096
MIN_GAIN = 15.1  # one chance in ten thousand under independence
FACTORS = 8
PREFIXES = (3, 4, 5, 6, 8)
GRADES = np.array([0, 0x5BD1E995, 0x27D4EB2F, 0x165667B1], dtype=np.int64)  # grade g: at least 2**g times
LENGTHS = 20  # length terms: the number of pieces, in powers of two
LOW = (1 << 16) - 1
SPLIT = words.WHITE.copy()
SPLIT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


@dataclass
class Machine:
    """Kept terms in ascending order; weight and vector of each, then of the lengths and of the bias."""

    terms: np.ndarray
    weight: np.ndarray
    vector: np.ndarray


def counted(column: pa.Array, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, ungraded term, times) and the number of pieces per row.

    ``near`` flags the low bits of terms that are looked for; others are skipped early.
    """
    found = words.split_words(column, lower=True, breaks=SPLIT)
    rows, length = found.rows(), found.ends - found.starts
    pairs = []
    for cut in (None, *PREFIXES):
        long = slice(None) if cut is None else length > cut
        starts, owner = found.starts[long], rows[long]
        ends = found.ends[long] if cut is None else starts + cut
        term = (words.codes(found.data, starts, ends, cut or 0) >> np.uint64(32)).astype(np.int64)
        if near is not None:
            hit = near[term & LOW]
            term, owner = term[hit], owner[hit]
        pairs.append(owner * (1 << 32) + term)
    pairs, times = np.unique(np.concatenate(pairs), return_counts=True)
    return pairs >> 32, pairs & 0xFFFFFFFF, times, found.counts


def graded_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, graded term) of a column of texts."""
    rows, term, times, _ = counted(column)
    held = [times >= 1 << g for g in range(len(GRADES))]
    return np.concatenate([rows[h] for h in held]), np.concatenate([term[h] ^ x for h, x in zip(held, GRADES)])


def near_flags(terms: np.ndarray) -> np.ndarray:
    near = np.zeros(LOW + 1, dtype=bool)
    for x in GRADES:
        near[(terms ^ x) & LOW] = True
    return near


def kept_terms(column: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of kept terms, with the length and the bias as the last two of each row."""
    rows, term, times, pieces = counted(column, near_flags(terms))
    every = np.arange(len(column))
    width = len(terms) + LENGTHS + 1
    size = np.minimum(np.log2(np.maximum(pieces, 1)).astype(np.int64), LENGTHS - 1)
    pairs = [every * width + len(terms) + size, every * width + width - 1]
    if len(terms):
        for g, x in enumerate(GRADES):
            looked, owner = (term ^ x)[times >= 1 << g], rows[times >= 1 << g]
            place = np.minimum(np.searchsorted(terms, looked), len(terms) - 1)
            hit = terms[place] == looked
            pairs.append(owner[hit] * width + place[hit])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // width, pairs % width


def raw_scores(rows: np.ndarray, index: np.ndarray, machine: Machine) -> tuple[np.ndarray, np.ndarray]:
    """Value of the machine per row and the sum of its vectors; every row has at least one term."""
    opens = np.flatnonzero(np.diff(rows, prepend=-1))
    vector = machine.vector[index]
    total = np.add.reduceat(vector, opens, axis=0)
    square = np.add.reduceat(vector * vector, opens, axis=0)
    value = np.add.reduceat(machine.weight[index], opens) + 0.5 * (total * total - square).sum(axis=1)
    return value, total


def fit(
    terms: np.ndarray, documents: list[np.ndarray], labels: np.ndarray, epochs: int = 15, batch: int = 256,
    rate: float = 0.2, decay: float = 1e-4, seed: int = 7,
) -> Machine:
    """Logistic loss by adaptive gradient steps; ``documents`` hold indices with the bias last."""
    draw = np.random.default_rng(seed)
    n = len(terms) + LENGTHS + 1
    machine = Machine(terms, np.zeros(n), draw.normal(0, 0.05, (n, FACTORS)))
    machine.vector[-1] = 0
    share = (labels.sum() + 0.5) / (len(labels) + 2)
    machine.weight[-1] = np.log(share / (1 - share))
    if not len(terms):
        return machine
    seen_w, seen_v = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6)
    for _ in range(epochs):
        order = draw.permutation(len(documents))
        for start in range(0, len(order), batch):
            chosen = order[start : start + batch]
            index = np.concatenate([documents[i] for i in chosen])
            rows = np.repeat(np.arange(len(chosen)), [len(documents[i]) for i in chosen])
            value, total = raw_scores(rows, index, machine)
            slope = ((1 / (1 + np.exp(-np.clip(value, -30, 30)))) - labels[chosen]) / len(chosen)
            each = slope[rows]
            by_w = np.bincount(index, each, n) + decay * machine.weight
            pulls = each[:, None] * (total[rows] - machine.vector[index])
            by_v = np.stack([np.bincount(index, pulls[:, f], n) for f in range(FACTORS)], axis=1) + decay * machine.vector
            by_v[-1] = 0
            seen_w += by_w * by_w
            seen_v += by_v * by_v
            machine.weight -= rate * by_w / np.sqrt(seen_w)
            machine.vector -= rate * by_v / np.sqrt(seen_v)
    return machine


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents."""
    texts = labelled_sample(docs, labels, label, sample)

    def count(batches):
        for part in words.slices(batches):
            rows, term = graded_terms(part.column("text"))
            positive = part.column("label").to_numpy(zero_copy_only=False)[rows] > 0
            present, place = np.unique(term, return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(present), pa.array(np.bincount(place, positive, len(present)).astype(np.int64)),
                pa.array(np.bincount(place, ~positive, len(present)).astype(np.int64)),
            ], ["term", "yes", "no"])

    sizes = texts.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    yes, no = sizes[0], sizes[1]
    counts = texts.mapInArrow(count, "term bigint, yes bigint, no bigint").groupBy("term").agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no")
    )
    both = F.col("yes") + F.col("no")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    gain = 2 * (
        part(F.col("yes"), both * yes / max(yes + no, 1)) + part(F.col("no"), both * no / max(yes + no, 1))
        + part(yes - F.col("yes"), (yes + no - both) * yes / max(yes + no, 1))
        + part(no - F.col("no"), (yes + no - both) * no / max(yes + no, 1))
    )
    top = counts.withColumn("gain", gain).where(f"gain >= {MIN_GAIN}").orderBy(F.desc("gain"), "term").limit(MAX_TERMS)
    terms = np.array(sorted(r.term for r in top.select("term").collect()), dtype=np.int64)

    def reduce(batches):
        for part in words.slices(batches):
            rows, index = kept_terms(part.column("text"), terms)
            bounds = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(index.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("label"), lists], ["label", "terms"])

    seen = texts.mapInArrow(reduce, "label int, terms array<int>").toArrow()
    documents = [np.asarray(v) for v in seen.column("terms").to_pylist()]
    order = sorted(range(len(documents)), key=lambda i: (len(documents[i]), documents[i].tobytes(), seen.column("label")[i].as_py()))
    values = np.array(seen.column("label").to_pylist(), dtype=np.float64) > 0
    return fit(terms, [documents[i] for i in order], values[order].astype(np.float64))


def with_score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """The documents with their probability of being toxic; a column of that name is replaced."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for part in words.slices([pa.RecordBatch.from_arrays([texts], ["text"])]):
            value, _ = raw_scores(*kept_terms(part.column("text"), machine.terms), machine)
            out.append(1 / (1 + np.exp(-np.clip(value, -30, 30))))
        return pa.array(np.concatenate(out))

    return docs.withColumn(name, score("text"))
