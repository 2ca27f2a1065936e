"""Near-duplicate documents: SuperMinHash signatures, banding, verification, grouping.

A document is the set of its distinct shingles (``WIDTH`` lower-cased words; a shorter
document is one shingle). Its signature has ``SLOTS`` slots. Each shingle visits all slots
in an order of its own (a Fisher-Yates shuffle drawn from the shingle's hash) and offers slot
k the value "rank of the visit plus a fraction"; a slot keeps the least offer. The ranks of
one shingle are a permutation, hence correlated, which lowers the variance of the share of
equal slots as an estimate of the Jaccard similarity. Visits go on, rank by rank, only
until no slot of the document can still fall, so long documents stop after few ranks.

Slots are kept as bytes. ``ROWS`` bytes make a band's key; documents that share a key
meet. A pair at similarity 0.85 misses every band with a probability of 5e-7, one at 0.8 of 5e-5.

* Documents with equal sets form a class first; one representative stands for it, so copies
  are never compared, however many there are.
* Round one: every representative meets its most similar earlier neighbour in a block
  of its bucket. Candidates are confirmed on full sets and grouped.
* Round two: in buckets that still hold several groups, all members outside the bucket's
  largest group meet all members, block against block, unless they are grouped already.
  Pairs whose signatures agree too little (more than four standard deviations below the
  threshold) are passed over, and so are pairs whose ``SKETCH`` least shingle hashes, which
  for shorter documents are all of them, do. No cap leaves out a link between groups.
* Links are grouped by union-find inside partitions and star contraction across them.

Defined results: null or empty texts have no shingle and are linked with nothing; rows that
share a doc_id are one document, linked if any of its texts is; rows with a null doc_id
are linked with nothing and stay; an empty table gives an empty result. Only ``doc_id`` and
``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.llm import words
from landshift.operators.components import resolve_stars
from landshift.session import materialize

WIDTH = 5
ROWS = 5
BANDS = 25
SLOTS = ROWS * BANDS
PERCENT = 85  # of the union that two linked sets share
BLOCK = 512
SKETCH = 256
LIKELY = 0.05  # below the threshold, estimates are still worth a check in round one


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle) of a column of texts, ordered by row."""
    found = words.split_words(column, lower=True)
    code = words.codes(found.data, found.starts, found.ends)
    counts, rows = found.counts, found.rows()
    all_runs = words.runs(code, WIDTH)
    whole = np.flatnonzero(np.arange(len(all_runs)) + WIDTH <= found.first[1:][rows[: len(all_runs)]])
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    single = np.zeros(len(short), dtype=np.uint64)
    for j in range(WIDTH - 1):
        held = counts[short] > j
        single[held] = words.mix(single[held] + code[found.first[short[held]] + j] + np.uint64(1))
    value = np.concatenate([all_runs[whole], single])
    owner = np.concatenate([rows[whole], short])
    _, index = np.unique(value + words.mix(owner.astype(np.uint64)), return_index=True)
    index = index[np.argsort(owner[index], kind="stable")]
    return owner[index], value[index]


def super_min_hash(rows: np.ndarray, values: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures of ``n`` rows from their distinct (row, value), as (n, slots) integers."""
    none = np.iinfo(np.int64).max
    least = np.full(n * slots, none)
    visited: list[np.ndarray] = []  # the slot position drawn at each earlier rank
    for rank in range(slots):
        draw = words.mix(values + np.uint64((rank * 0xA24BAED4963EE407 + 1) & 0xFFFFFFFFFFFFFFFF))
        place = rank + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        slot = place.copy()
        for earlier in range(rank - 1, -1, -1):  # undo the swaps of the shuffle
            slot[slot == visited[earlier]] = earlier
        offer = (rank << 32) | (draw >> np.uint64(32)).astype(np.int64)
        np.minimum.at(least, rows * slots + slot, offer)
        worst = least.reshape(n, slots).max(axis=1)
        live = worst[rows] >= (rank + 1) << 32
        if not live.any():
            break
        visited.append(place)
        if not live.all():
            rows, values, visited = rows[live], values[live], [v[live] for v in visited]
    return least.reshape(n, slots)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> set size, digest of the set, band keys and slot bytes."""
    for part in words.slices(batches):
        n = part.num_rows
        rows, values = shingles(part.column("text"))
        size = np.bincount(rows, minlength=n)
        bounds = np.concatenate([[0], np.cumsum(size)])
        full = size > 0
        digests = np.zeros((2, n), dtype=np.uint64)
        for k in range(2):
            sums = np.add.reduceat(words.mix(values ^ np.uint64(0x9E3779B9 * (k + 1))), bounds[:-1][full]) if full.any() else []
            digests[k, full] = sums
        marks = (words.mix(super_min_hash(rows, values, n).astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)
        keys = np.zeros((n, BANDS), dtype=np.int64)
        for j in range(ROWS):
            keys = (keys << 8) | marks[:, j::ROWS]
        keys |= np.arange(BANDS, dtype=np.int64) << (8 * ROWS)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SLOTS), n, [None, pa.py_buffer(marks.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(size), *[pa.array(d.view(np.int64)) for d in digests], lists, flat.cast(pa.binary())],
            ["doc_id", "n_shingles", "d1", "d2", "keys", "marks"],
        )


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by ``key``, as tables with the bounds of their groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows - 1, dtype=bool)
        for k in key:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            same &= column[1:] == column[:-1]
        starts = np.flatnonzero(~same) + 1
        if held and not all(held[-1].column(k)[-1] == batch.column(k)[0] for k in key):
            yield _bounded(held, key)
            held = []
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield _bounded([*held, batch.slice(0, last)], key)
            held = []
        held.append(batch.slice(last))
    if held:
        yield _bounded(held, key)


def _bounded(parts: list[pa.RecordBatch], key: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(parts).combine_chunks()
    change = np.zeros(table.num_rows - 1, dtype=bool)
    for k in key:
        column = table.column(k).to_numpy()
        change |= column[1:] != column[:-1]
    return table, np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])


def _marks(table: pa.Table) -> np.ndarray:
    data, bounds = words.text_bytes(table.column("marks").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
    return data[: int(bounds[-1])].reshape(-1, SLOTS)


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, text -> the least hashes of the shingles, in order, as 16-bit prefixes."""
    for part in words.slices(batches):
        rows, values = shingles(part.column("text"))
        hashes = words.mix(values ^ np.uint64(0x5851F42D4C957F2D))
        order = np.lexsort((hashes, rows))
        size = np.bincount(rows, minlength=part.num_rows)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
        least = (hashes[order] >> np.uint64(48)).astype("<u2")[place < SKETCH]
        bounds = np.concatenate([[0], np.cumsum(np.minimum(size, SKETCH))]).astype(np.int32) * 2
        flat = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(least.tobytes())])
        yield pa.RecordBatch.from_arrays([part.column("rep"), flat], ["rep", "sketch"])


def may_link(i: np.ndarray, j: np.ndarray, values: np.ndarray, bounds: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sketches of rows i[p] and j[p] allow a link. Below ``limit`` both hold all their hashes."""
    out = np.zeros(len(i), dtype=bool)
    last = np.where(size > SKETCH, values[np.maximum(bounds[1:] - 1, 0)].astype(np.int64), 1 << 16)
    for start in range(0, len(i), 4096):
        a, b = i[start : start + 4096], j[start : start + 4096]
        limit = np.minimum(last[a], last[b])
        sides = []
        for rows in (a, b):
            count = np.diff(bounds)[rows]
            pair = np.repeat(np.arange(len(rows)), count)
            value = values[np.arange(count.sum()) + np.repeat(bounds[rows] - np.cumsum(count) + count, count)].astype(np.int64)
            below = value < limit[pair]
            sides.append((pair[below], pair[below] << 16 | value[below]))
        (pair, one), (other, two) = sides
        if not len(one) or not len(two):
            continue
        same = two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one
        common = np.bincount(pair[same], minlength=len(a))
        union = np.bincount(pair, minlength=len(a)) + np.bincount(other, minlength=len(a)) - common
        needed = np.where(limit < 1 << 16, passed_over(percent, np.maximum(union, 1)), percent / 100)
        out[start : start + 4096] = common >= needed * union - 1e-9
    return out


def agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal slots of every left row with every right row."""
    out = np.empty((len(left), len(right)), dtype=np.float32)
    for i, row in enumerate(left):
        out[i] = (right == row).sum(axis=1)
    return out / SLOTS


def similar_sizes(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(left, right) * 100 >= np.maximum(left, right) * percent


def passed_over(percent: int, slots: np.ndarray | int) -> np.ndarray:
    """Estimates below this, four standard deviations under the threshold, are passed over."""
    p = percent / 100
    return p - 4 * (p * (1 - p) / slots) ** 0.5


def nearest_earlier(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Round one: per block, each member with its most similar earlier member."""
    for table, bounds in _groups(batches, ["key", "block"]):
        rep, size, marks = table.column("rep").to_numpy(), table.column("n_shingles").to_numpy(), _marks(table)
        starts, width, likely = bounds[:-1], np.diff(bounds), percent / 100 - LIKELY
        pairs = starts[width == 2]
        alike = ((marks[pairs] == marks[pairs + 1]).mean(axis=1) >= likely) & similar_sizes(size[pairs], size[pairs + 1], percent)
        a, b = [rep[pairs[alike]]], [rep[pairs[alike] + 1]]
        for start, stop in zip(starts[width > 2], bounds[1:][width > 2]):
            share = agreement(marks[start:stop], marks[start:stop])
            share = np.tril(np.where(similar_sizes(size[start:stop, None], size[None, start:stop], percent), share, 0), -1)
            best = share.argmax(axis=1)
            good = share[np.arange(stop - start), best] >= likely
            a.append(rep[start:stop][good])
            b.append(rep[start + best[good]])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def across_groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Round two: members outside the largest group with members of other groups, in their first common band."""
    for table, bounds in _groups(batches, ["key", "block", "other"]):
        rep, size, group = (table.column(c).to_numpy() for c in ("rep", "n_shingles", "component"))
        asks, largest = table.column("asks").to_numpy(zero_copy_only=False), table.column("largest").to_numpy()
        band = table.column("key").to_numpy() >> (8 * ROWS)
        marks = _marks(table)
        data, cuts = words.text_bytes(table.column("sketch").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
        least, cuts = data[: int(cuts[-1])].view("<u2"), cuts // 2
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for start, stop in zip(bounds[:-1], bounds[1:]):
            rows = np.arange(start, stop)
            left, right = rows[asks[start:stop]], rows[~asks[start:stop]]
            if not len(left) or not len(right):
                continue
            share = agreement(marks[left], marks[right])
            wanted = (
                (share >= passed_over(percent, SLOTS)) & (group[left][:, None] != group[right][None, :])
                & similar_sizes(size[left][:, None], size[right][None, :], percent)
                & ((group[right] == largest[start])[None, :] | (rep[left][:, None] < rep[right][None, :]))
            )
            i, j = np.nonzero(wanted)
            i, j = left[i], right[j]
            common = (marks[i] == marks[j]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            i, j = i[common == band[start]], j[common == band[start]]
            good = may_link(i, j, least, cuts, size, percent)
            a.append(rep[i[good]])
            b.append(rep[j[good]])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the threshold."""
    for part in words.slices(batches, "text_a", words.SLICE_BYTES // 2):
        one, two = shingles(part.column("text_a")), shingles(part.column("text_b"))
        n = part.num_rows
        tagged = [values + words.mix(rows.astype(np.uint64)) for rows, values in (one, two)]
        common = np.isin(tagged[0], tagged[1], assume_unique=True)
        shared = np.bincount(one[0][common], minlength=n)
        union = np.bincount(one[0], minlength=n) + np.bincount(two[0], minlength=n) - shared
        linked = (shared * 100 >= union * percent) & (shared > 0)
        yield part.select(["a", "b"]).filter(pa.array(linked))


def joined_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a partition: every node with the least node of its set."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        if len(parent) > 1_000_000:  # bounded memory; the rest is the contraction's work
            yield _stars(parent, root)
            parent.clear()
    yield _stars(parent, root)


def _stars(parent: dict[int, int], root) -> pa.RecordBatch:
    edges = [(x, r) for x in parent if (r := root(x)) != x]
    return pa.RecordBatch.from_arrays(
        [pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["big", "small"]
    )


def components(links: DataFrame) -> DataFrame:
    """(rep, component) of all linked representatives but the least of each component."""
    edges = links.select("a", "b").mapInArrow(joined_locally, "big bigint, small bigint").distinct()
    stars = resolve_stars(edges.select(F.lit(0).cast("bigint").alias("aoi_id"), F.lit(0).alias("k"), "big", "small"))
    return stars.select(F.col("big").alias("rep"), F.col("small").alias("component"))


def confirmed(candidates: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b) that the full sets link."""
    pairs = candidates.distinct()
    sides = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").join(
        texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b"
    )
    return sides.select("a", "b", "text_a", "text_b").mapInArrow(partial(confirm, percent=percent), "a bigint, b bigint").distinct()


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    signed = materialize(
        docs.where("doc_id is not null").mapInArrow(
            sign, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>, marks binary"
        ),
        "near-dup-signatures",
    )
    same = ["d1", "d2", "n_shingles"]
    classes = materialize(
        signed.where("n_shingles > 0").groupBy(*same).agg(
            F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("marks").alias("marks")
        ),
        "near-dup-classes",
    )
    banded = classes.select("rep", F.explode("keys").alias("key"))
    crowded = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # These sides grow with the data, so they are never broadcast.
    shared = materialize(banded.join(crowded.hint("merge"), "key"), "near-dup-shared")
    members = shared.select("rep").distinct().hint("merge")
    marked = materialize(
        classes.select("rep", "n_shingles", "marks").join(members, "rep", "left_semi"), "near-dup-members"
    )
    texts = materialize(
        docs.withColumnRenamed("doc_id", "rep").join(members, "rep", "left_semi"), "near-dup-texts"
    )

    blocked = shared.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    met = blocked.select("rep", "key", "block").join(marked.hint("merge"), "rep").repartition("key", "block").sortWithinPartitions("key", "block", "rep")
    first = materialize(
        confirmed(met.mapInArrow(partial(nearest_earlier, percent=percent), "a bigint, b bigint"), texts, percent), "near-dup-links"
    )

    known = materialize(
        shared.join(components(first), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "near-dup-known"
    )
    sizes = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    split = materialize(sizes.groupBy("key").agg(
        F.sum("size").alias("total"), F.max("size").alias("most"),
        F.max_by("component", F.struct("size", "component")).alias("largest"), F.count(F.lit(1)).alias("groups"),
    ).where("groups > 1").drop("groups"), "near-dup-split")
    open_ = known.join(split.hint("merge"), "key")  # both sides are plain tables, so a hot key can be split
    pieces = lambda n: F.ceil(n / BLOCK).cast("int")
    asking, asked = pieces(F.col("total") - F.col("most")), pieces(F.col("total"))
    spread = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keep = ["rep", "key", "component", "largest"]
    asks = open_.where("component <> largest").select(
        *keep, F.lit(True).alias("asks"), spread(asking, 1).alias("block"), each(asked).alias("other")
    )
    answers = open_.select(*keep, F.lit(False).alias("asks"), each(asking).alias("block"), spread(asked, 2).alias("other"))
    sketches = materialize(
        texts.join(open_.select("rep").distinct().hint("merge"), "rep", "left_semi").mapInArrow(sketch, "rep bigint, sketch binary"),
        "near-dup-sketches",
    )
    crossed = asks.unionByName(answers).join(marked.hint("merge"), "rep").join(sketches.hint("merge"), "rep").repartition("key", "block", "other").sortWithinPartitions("key", "block", "other", "rep")
    second = confirmed(crossed.mapInArrow(partial(across_groups, percent=percent), "a bigint, b bigint"), texts, percent)
    links = materialize(first.unionByName(second), "near-dup-all-links")

    named = classes.select(*same, "rep").join(components(links), "rep", "left").select(
        *same, F.coalesce("component", "rep").alias("component")
    )
    component = F.coalesce("component", "doc_id")
    rows = signed.select("doc_id", *same).join(named, same, "left").select("doc_id", "n_shingles", component.alias("component_id"))
    unnamed = docs.where("doc_id is null").mapInArrow(
        sign, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>, marks binary"
    ).select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    return rows.unionByName(unnamed).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All columns of the documents; of each group only the document with the least id stays."""
    gone = materialize(grouped(docs, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "near-dup-gone")
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
