"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors (``SAMPLE``) is linked by its nearest neighbours, and the graph is cut
into balanced parts: recursive median splits along the main direction of each part, then
sweeps that move a vertex to the part of most of its neighbours while no part outgrows its
share. A small network learns to tell, from a vector, in which parts its neighbours
are. It places every row of the table in one part and sends a query to its most probable
parts; how many is chosen on the sample, as the least that finds ``TARGET`` of true neighbours.

Ranking is exact within the parts searched: parts are cut into blocks of vectors, queries
into blocks too, and a task multiplies one block by another and returns each query's best.
Block sizes are bounded, so no part, however many copies it holds, meets in one task.

Nearness is the inner product in double precision; ties go to the smaller vec_id. Defined
results: vectors that are null, zero, hold nulls or non-finite values, or have another length than
most of the sample take no part; rows with a null vec_id take none either; a repeated row
is a candidate as often as it occurs, and its query runs once; an empty table gives an
empty result. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8_192
PARTS = 32
TARGET = 0.95
GRAPH = 10  # neighbours per vertex
SLACK = 1.1  # of a part's share
HIDDEN = 128
VECTOR_BLOCK, QUERY_BLOCK = 8_192, 1_024


@dataclass
class Router:
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.second_bias)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.first + self.first_bias, 0) @ self.second + self.second_bias


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest inner products of every row with other rows."""
    out = np.empty((len(x), k), dtype=np.int64)
    for start in range(0, len(x), 1024):
        score = x[start : start + 1024] @ x.T
        score[np.arange(len(score)), np.arange(start, start + len(score))] = -np.inf
        out[start : start + 1024] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def split_evenly(x: np.ndarray, parts: int) -> np.ndarray:
    """First partition: recursive halves along the main direction."""
    part = np.zeros(len(x), dtype=np.int64)

    def halve(rows: np.ndarray, low: int, count: int) -> None:
        if count == 1:
            part[rows] = low
            return
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ direction, kind="stable")]
        left = count // 2
        middle = len(rows) * left // count
        halve(order[:middle], low, left)
        halve(order[middle:], low + left, count - left)

    halve(np.arange(len(x)), 0, parts)
    return part


def balanced_parts(x: np.ndarray, links: np.ndarray, parts: int, sweeps: int = 20) -> np.ndarray:
    """Parts of nearly equal size with few links between them."""
    part = split_evenly(x, parts)
    n = len(x)
    most = int(np.ceil(SLACK * n / parts))
    both = np.concatenate([np.stack([np.repeat(np.arange(n), links.shape[1]), links.ravel()], 1),
                           np.stack([links.ravel(), np.repeat(np.arange(n), links.shape[1])], 1)])
    for _ in range(sweeps):
        held = np.bincount(both[:, 0] * parts + part[both[:, 1]], minlength=n * parts).reshape(n, parts)
        best = held.argmax(axis=1)
        gain = held[np.arange(n), best] - held[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[best[v]] < most:
                size[part[v]] -= 1
                size[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


def fit(x: np.ndarray, parts: int = PARTS, target: float = TARGET, wanted: int = 20, seed: int = 7, epochs: int = 40) -> Router:
    """Partition the sample's graph, learn the router, and choose how many parts a query visits."""
    n, width = x.shape
    parts = max(min(parts, n // 64), 1)
    draw = np.random.default_rng(seed)
    scale = 1 / (np.sqrt((x * x).sum(axis=1).mean()) + 1e-12)
    router = Router(draw.normal(0, np.sqrt(2 / width), (width, HIDDEN)) * 4 * scale, np.zeros(HIDDEN),
                    draw.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts), 1)
    if parts == 1:
        return router
    links = nearest(x, GRAPH)
    part = balanced_parts(x, links, parts)
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.repeat(np.arange(n), GRAPH), part[links].ravel()), 0.5 / GRAPH)
    goal[np.arange(n), part] += 0.5
    values = [router.first, router.first_bias, router.second, router.second_bias]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        order = draw.permutation(n)
        for start in range(0, n, 256):
            rows = order[start : start + 256]
            hidden = np.maximum(x[rows] @ router.first + router.first_bias, 0)
            score = hidden @ router.second + router.second_bias
            chance = np.exp(score - score.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            miss = (chance - goal[rows]) / len(rows)
            back = (miss @ router.second.T) * (hidden > 0)
            slopes = [x[rows].T @ back, back.sum(axis=0), hidden.T @ miss, miss.sum(axis=0)]
            step += 1
            for v, s, a, b in zip(values, slopes, first, second):
                a += 0.1 * (s - a)
                b += 0.001 * (s * s - b)
                v -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    # Recall on the sample, with the parts as rows will be placed.
    order = np.argsort(-router.scores(x), axis=1)
    home = order[:, 0]
    true = nearest(x, min(wanted, n - 1))
    place = np.argsort(order, axis=1)  # rank of each part for each query
    needed = place[np.arange(n)[:, None], home[true]] + 1
    recall = [(needed <= probes).mean() for probes in range(1, parts + 1)]
    router.probes = int(np.argmax(np.array(recall) >= target)) + 1
    return router


def usable(vector: Column, length: int | None = None) -> Column:
    """No null, no zero vector, only finite components."""
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & whole & F.exists(vector, lambda v: v != 0) & (
        F.lit(True) if length is None else F.size(vector) == length
    )


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def placed(router: Router, probes: int):
    """vec_id, embedding -> one row for each of the ``probes`` best parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-router.scores(matrix(batch.column("embedding"))), axis=1, kind="stable")[:, :probes]
            rows = np.repeat(np.arange(batch.num_rows), order.shape[1])
            columns = [batch.column(c).take(pa.array(rows)) for c in ("vec_id", "embedding")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(order.ravel().astype(np.int32))], ["vec_id", "embedding", "part"])

    return run


def best_of_block(wanted: int):
    """The nearest vectors of a block for every query of a block."""

    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and vectors.num_rows:
            q, v = (matrix(t.column("embedding").combine_chunks()) for t in (queries, vectors))
            asked, ids = queries.column("vec_id").to_numpy(), vectors.column("vec_id").to_numpy()
            for start in range(0, len(q), 128):
                score = q[start : start + 128] @ v.T
                score[asked[start : start + 128, None] == ids[None, :]] = -np.inf
                for row, own in enumerate(score):
                    least = np.partition(own, -wanted)[-wanted] if len(own) > wanted else -np.inf
                    near = np.flatnonzero((own >= least - 1e-9 * max(abs(least), 1)) & (own > -np.inf)) if np.isfinite(least) else np.flatnonzero(own > -np.inf)
                    exact = (v[near] * q[start + row]).sum(axis=1)  # equal vectors get equal sums
                    order = np.lexsort((ids[near], -exact))[:wanted]
                    out.append((np.full(len(order), asked[start + row]), ids[near][order], exact[order]))
        columns = [np.concatenate([o[k] for o in out]) for k in range(3)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    return run


def search(vectors: DataFrame, queries: DataFrame, wanted: int = 20, parts: int = PARTS, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """The ``wanted`` nearest rows found for every query: query_id, rank, vec_id, score."""
    good = lambda table, n=None: table.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), n))
    learned = good(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().column("embedding").to_pylist()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not learned:
        return vectors.sparkSession.createDataFrame([], schema)
    lengths = np.bincount([len(v) for v in learned])
    length = int(lengths.argmax())
    router = fit(np.array([v for v in learned if len(v) == length], dtype=np.float64), parts, target, wanted)
    kind = "vec_id bigint, embedding " + vectors.schema["embedding"].dataType.simpleString() + ", part int"
    index = good(vectors, length).mapInArrow(placed(router, 1), kind)
    asked = good(queries, length).dropDuplicates(["vec_id"]).mapInArrow(placed(router, router.probes), kind)
    # Blocks per part from counts: at most ``parts`` rows return.
    counts = lambda t, size: {r["part"]: -(-r["count"] // size) for r in t.groupBy("part").count().collect()}
    cut = lambda blocks, name: F.element_at(F.lit([blocks.get(p, 1) for p in range(router.parts)]), F.col("part") + 1)
    v_blocks, q_blocks = counts(index, VECTOR_BLOCK), counts(asked, QUERY_BLOCK)
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    v = index.withColumn("v_block", spread(cut(v_blocks, "v"), 1)).withColumn("q_block", each(cut(q_blocks, "q")))
    q = asked.withColumn("q_block", spread(cut(q_blocks, "q"), 2)).withColumn("v_block", each(cut(v_blocks, "v")))
    keys = ["part", "v_block", "q_block"]
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(
        best_of_block(wanted), "query_id bigint, vec_id bigint, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")
