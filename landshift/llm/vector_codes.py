"""Vector code compression: product codes in whole numbers, with distances along a trie of parts.

A component x counts as floor(``SCALE`` * x). Vectors are cut into ``PARTS`` equal consecutive parts
(unequal by at most one where the length is no multiple), and every part position has a
codebook of at most ``ENTRIES`` entries. The codebooks begin as the parts of the smallest ids; a
round gives each part to its nearest entry (ties to the lower index) and moves every entry to
the floored mean of its parts. After ``ROUNDS`` rounds parts are given out once more.

Rounds run over distinct parts with their counts. Distinct parts are kept in lexicographic order,
which is the order of a depth-first walk through the trie of their components. The walk carries the
distance of each entry to the path so far: a component that many parts begin with is compared
with the entries once, and a leaf takes the least sum as its entry and adds its components, times its
count, to that entry's sums. The walk takes ``LEAVES`` leaves at a time, level by level, and hands
the path of its last leaf on to the next ones, so its memory is bounded.

Spark holds the distinct parts as a sorted stage table; a round is a map over it, and what returns
to the driver is one row per part position and entry. The size of all codebooks is
``ENTRIES`` times the length of a vector, whatever the table holds. Vectors of another length
have codebooks of their own. Codes of the vectors come from a walk through the parts of each slice
of rows, so nothing is joined back.

Defined results: vectors that are null or hold null or non-finite components are dropped; zero
vectors are ordinary; empty vectors have the error 0; rows with a null id are kept and start codebooks
only where other ids do not suffice; repeated rows count as often as they occur, and equal ids start
codebooks in the order of their vectors; components beyond a bound that keeps a vector's
distances within a long (2**25 or more after scaling, for up to 256 components a part) count as that
bound; sums beyond a long are that long; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landshift.operators.skew import attach_group_values
from landshift.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LEAVES = 1 << 15
ROWS = 4_096  # vectors of a slice
OFFSET = 1 << 30
LONGEST = 2**63 - 1

Codebooks = dict[tuple[int, int], np.ndarray]  # (length of vectors, position) -> entries x components


def cuts(length: int, parts: int) -> list[int]:
    return [k * length // parts for k in range(parts + 1)]


def largest(length: int, parts: int) -> int:
    """Bound of whole components: ``parts`` squared distances of a part add up within a long."""
    width = max(-(-length // parts), 1) * parts
    return 1 << int((62 - log2(width)) / 2 - 1)


def whole(vector: Column) -> Column:
    """Not null, and only finite components."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def scaled(batch: pa.RecordBatch, scale: int, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, whole components) for each length of vectors in the batch."""
    column = batch.column("vector")
    sizes = np.asarray(column.value_lengths())
    for length in np.unique(sizes):
        rows = np.flatnonzero(sizes == length)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        bound = largest(int(length), parts)
        with np.errstate(over="ignore"):
            values = np.clip(np.floor(flat * scale), -bound, bound)
        yield int(length), rows, values.astype(np.int64).reshape(len(rows), int(length))


def _packed(values: np.ndarray) -> pa.Array:
    """Rows of whole numbers as binary strings that sort like the numbers."""
    data = (values + OFFSET).astype(">u4").tobytes()
    bounds = np.arange(len(values) + 1, dtype=np.int64) * (4 * values.shape[1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).cast(pa.binary())


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    data = b"".join(column.to_pylist()) if width else b""
    return np.frombuffer(data, dtype=">u4").astype(np.int64).reshape(len(column), width) - OFFSET


def parts_of(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """(place, length, position, part) of every row of (place, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for length, rows, values in scaled(batch, scale, parts):
                edge = cuts(length, parts)
                for position in range(parts):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("place").take(pa.array(rows)), pa.array(np.full(len(rows), length, np.int32)),
                         pa.array(np.full(len(rows), position, np.int32)), _packed(values[:, edge[position] : edge[position + 1]])],
                        ["place", "length", "position", "part"],
                    )

    return vectors.mapInArrow(run, "place int, length int, position int, part binary")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


class Walk:
    """Depth-first walk over sorted distinct parts of one position, ``LEAVES`` at a time."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        width = entries.shape[1]
        self.path = np.zeros(width, dtype=np.int64)
        self.sums = np.zeros((width + 1, len(entries)), dtype=np.int64)  # by depth, along the last path
        self.begun = False
        self.nodes = 0

    def visit(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of each leaf."""
        n, width = leaves.shape
        before = np.concatenate([self.path[None, :], leaves[:-1]])
        same = np.logical_and.accumulate(leaves == before, axis=1)
        if not self.begun:
            same[0] = False
        kept = np.broadcast_to(self.sums[0], (1, len(self.entries)))
        node = np.zeros(n, dtype=np.int64)  # node 0 of a level is the one of the path handed on
        last = [self.sums[0]]
        for depth in range(width):
            opens = np.flatnonzero(~same[:, depth])
            parent = node[opens]
            step = leaves[opens, depth, None] - self.entries[None, :, depth]
            new = kept[parent] + step * step
            kept = np.concatenate([self.sums[depth + 1][None, :], new])
            node = np.cumsum(~same[:, depth])
            last.append(kept[node[-1]])
            self.nodes += len(opens)
        self.sums = np.stack(last)
        self.path, self.begun = leaves[-1], True
        least = kept.argmin(axis=1)  # the first of equal ones
        return least[node], kept[np.arange(len(kept)), least][node]


def _runs(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[tuple[pa.RecordBatch, Walk, np.ndarray]]:
    """Stretches of one position in sorted batches, with the walk that goes on through them."""
    walk, at = None, None
    for big in batches:
        for start in range(0, big.num_rows, LEAVES):
            batch = big.slice(start, LEAVES)
            length, position = (np.asarray(batch.column(c)) for c in ("length", "position"))
            edges = np.flatnonzero(np.concatenate([[True], (length[1:] != length[:-1]) | (position[1:] != position[:-1]), [True]]))
            for low, high in zip(edges[:-1], edges[1:]):
                key = (int(length[low]), int(position[low]))
                if key != at:
                    walk, at = Walk(books[key]), key
                part = batch.slice(low, high - low)
                yield part, walk, _unpacked(part.column("part"), walk.entries.shape[1])


def sums_of(books: Codebooks):
    """Count and component sums of each entry, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for part, walk, leaves in _runs(batches, books):
            key = (part.column("length")[0].as_py(), part.column("position")[0].as_py())
            counts, sums = held.setdefault(key, (np.zeros(len(walk.entries), np.int64), np.zeros(walk.entries.shape, np.int64)))
            entry, _ = walk.visit(leaves)
            weight = np.asarray(part.column("copies"))
            np.add.at(counts, entry, weight)
            np.add.at(sums, entry, leaves * weight[:, None])
        rows = [(*key, e, int(counts[e]), sums[e].tolist()) for key, (counts, sums) in held.items() for e in np.flatnonzero(counts)]
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["length", "position", "entry", "copies", "sums"])

    return run


def coded(books: Codebooks, parts: int, scale: int):
    """Code and error of each vector: its parts are walked in the sorted order of their slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for length, rows, values in scaled(batch, scale, parts):
                edge, code, error = cuts(length, parts), np.zeros((len(rows), parts), np.int32), np.zeros(len(rows), np.int64)
                for position in range(parts):
                    leaves, own = np.unique(values[:, edge[position] : edge[position + 1]], axis=0, return_inverse=True)
                    entry, distance = Walk(books[length, position]).visit(leaves)
                    code[:, position] = entry[own.ravel()]
                    error += distance[own.ravel()]
                bounds = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * parts)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(pa.array(rows)) for c in ("vec_id", "label")], pa.array(np.full(len(rows), length, np.int32)),
                     pa.ListArray.from_arrays(bounds, pa.array(code.ravel())), pa.array(error)],
                    ["vec_id", "label", "length", "code", "error"],
                )

    return run


def first_entries(vectors: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """Codebooks of the smallest ids, for each length of vectors: at most ``entries`` rows of a length."""
    order = Window.partitionBy(F.size("vector")).orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    first = vectors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries).select("place", "vector")
    books: dict[tuple[int, int], list] = {}
    for row in parts_of(first, parts, scale).orderBy("place").collect():
        books.setdefault((row.length, row.position), []).append(bytes(row.part))
    out = {}
    for (length, position), held in books.items():
        edge = cuts(length, parts)
        out[length, position] = _unpacked(pa.array(held, pa.binary()), edge[position + 1] - edge[position])
    return out


def moved(books: Codebooks, distinct: DataFrame) -> Codebooks:
    """Codebooks after a round: the floored mean of each entry's parts; entries without parts stay."""
    partial = distinct.mapInArrow(sums_of(books), "length int, position int, entry int, copies bigint, sums array<bigint>")
    at = partial.select("length", "position", "entry", "copies", F.posexplode("sums").alias("component", "value"))
    total = at.groupBy("length", "position", "entry", "component").agg(F.sum("value").alias("value"), F.sum("copies").alias("copies"))
    new = {key: entries.copy() for key, entries in books.items()}
    for row in total.collect():
        new[row.length, row.position][row.entry, row.component] = row.value // row.copies
    return new


def digest(books: Codebooks, length: int, parts: int = PARTS) -> str:
    """SHA-256 of all whole components by part, entry and place, joined by commas."""
    numbers = np.concatenate([books[length, p].ravel() for p in range(parts)])
    return hashlib.sha256(",".join(map(str, numbers.tolist())).encode()).hexdigest()


def train(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codebooks:
    """Codebooks of (vec_id, vector) rows."""
    keys = ["length", "position", "part"]
    rows = parts_of(vectors.select(F.lit(0).alias("place"), "vector"), parts, scale)
    distinct = materialize(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).repartitionByRange(*keys).sortWithinPartitions(*keys), "distinct-parts"
    )
    books = first_entries(vectors, parts, entries, scale)
    for _ in range(rounds):
        books = moved(books, distinct)
    return books


def compress(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """Rows (vec_id, label, length, code array<int>, error) of the kept vectors, and the codebooks."""
    kept = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label")).where(whole(F.col("vector")))
    books = train(kept.select("vec_id", "vector"), parts, entries, rounds, scale)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, length int, code array<int>, error bigint"
    return kept.mapInArrow(coded(books, parts, scale), schema), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds the error summed over equal labels, nulls together; a label may hold most rows."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    stored = materialize(codes.withColumn("label_key", key), "vector-codes")
    errors = {"label_error": (F.sum, F.col("error").cast("decimal(38,0)"))}
    total = attach_group_values(stored, ["label_key"], ["vec_id", "error"], errors).drop("label_key")
    return total.withColumn("label_error", F.least("label_error", F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint"))
