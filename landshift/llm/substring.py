"""Removal of long passages that an earlier document holds, by difference-cover anchors.

A window is ``WINDOW`` consecutive words. A word goes if it is covered by a window whose
words also start somewhere in a document with a smaller id, judged on the input.

A difference cover of period P is a set of residues whose differences reach every residue.
Only runs of ``WINDOW - P + 1`` words at cover positions (position modulo P in the cover) are
hashed: six of 31 positions. Two occurrences of one window, wherever they start, then share
an aligned anchor: for some shift below P both positions are cover positions.

* Anchors are reduced to one row for each slice of the input before they are shuffled (the
  least place of the slice), so an anchor that a third of all documents hold costs
  one row for each slice. Every anchor learns its head, the least (document, place) of it.
* Around its anchors a document is compared with their heads, segment by segment
  (``SEGMENT`` words and the margins a window needs), which extends the match.
* A window that its anchor's head does not hold may still occur in another earlier document.
  Then its first holder is in the same position: the anchor there has the same head, which
  does not hold the window. So only such windows, also those at further places of the head's
  own document, are hashed whole (128 bits) and meet their least document in an aggregate that
  combines before the shuffle.

Defined results: a null or empty text has no words and loses none; documents shorter than a
window lose none; rows with a null doc_id neither lose words nor make others lose any; rows
that share a doc_id are expected to share their text; if not, places found in one are removed
from each as far as they exist; an empty table gives an empty result. Only ``doc_id`` and
``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landshift.llm import words
from landshift.session import materialize

WINDOW = 50
PERIOD = 31
SEGMENT = 1024


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A least set of residues, with 0, whose differences are all residues."""
    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
        size += 1


def anchors(batch: pa.RecordBatch, window: int, period: int, cover: tuple[int, ...]):
    """Hash, row and position of every anchor of documents that hold a window."""
    found = words.split_words(batch.column("text"))
    width = window - period + 1
    rows, counts = found.rows(), found.counts
    place = np.arange(len(rows)) - found.first[:-1][rows]
    flags = np.zeros(period, dtype=bool)
    flags[list(cover)] = True
    at = np.flatnonzero(flags[place % period] & (place + width <= counts[rows]) & (counts[rows] >= window))
    code = words.codes(found.data, found.starts, found.ends)
    return words.runs(code, width)[at] if len(at) else np.zeros(0, np.uint64), rows[at], place[at]


def anchor_rows(window: int, period: int, first: bool):
    """Per slice and hash the least place (``first``), or else all places after it."""
    cover = difference_cover(period)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            hashes, rows, place = anchors(part, window, period, cover)
            doc = part.column("doc_id").to_numpy(zero_copy_only=False)[rows]
            order = np.lexsort((place, doc, hashes))
            hashes, doc, place = hashes[order], doc[order], place[order]
            opens = np.ones(len(hashes), dtype=bool)
            opens[1:] = hashes[1:] != hashes[:-1]
            group = np.cumsum(opens) - 1
            size = np.bincount(group, minlength=int(opens.sum()))
            last = doc[np.cumsum(size) - 1] if len(doc) else doc
            take = opens if first else ~opens
            columns = [pa.array(hashes[take].view(np.int64)), pa.array(doc[take]), pa.array(place[take].astype(np.int32))]
            if first:
                columns += [pa.array(size > 1), pa.array(last)]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "doc_id", "place", "followed", "last_id"][: len(columns)])

    return run


def suspects(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """Places of anchors that several documents hold, other than the head: doc_id, place, head, head_place."""
    schema = "hash bigint, doc_id bigint, place int"
    same = Window.partitionBy("hash")
    seen = docs.mapInArrow(anchor_rows(window, period, True), f"{schema}, followed boolean, last_id bigint").select(
        "*", F.min("doc_id").over(same).alias("head"), F.max("last_id").over(same).alias("last"),
        F.min_by("place", F.struct("doc_id", "place")).over(same).alias("head_place"),
    )
    shared = materialize(seen.where("last > head").drop("last", "last_id"), "passage-anchors")
    heads = shared.where("followed").groupBy("hash").agg(F.min("head").alias("head"), F.min("head_place").alias("head_place"))
    followers = docs.mapInArrow(anchor_rows(window, period, False), schema).join(heads, "hash")
    columns = ["doc_id", "place", "head", "head_place"]
    return shared.select(*columns).unionByName(followers.select(*columns)).where("doc_id > head or place <> head_place")


def _segment(found: words.Words, row: int, number: int, window: int, period: int, segment: int) -> tuple[int, bytes]:
    """First word and bytes of a segment with the margins that its anchors' windows need."""
    begin, end = found.first[row], found.first[row + 1]
    low = max(number * segment - period + 1, 0)
    high = min((number + 1) * segment + window, end - begin)
    if high <= low:
        return low, b""
    return low, found.data[found.starts[begin + low] : found.ends[begin + high - 1]].tobytes()


def cut_heads(window: int, period: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            found = words.split_words(part.column("text"))
            out: list[tuple] = []
            for row, (doc, wanted) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("segments").to_pylist())):
                out += [(doc, number, _segment(found, row, number, window, period, segment)[1]) for number in wanted]
            head, number, text = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(head, pa.int64()), pa.array(number, pa.int32()), pa.array(text, pa.binary())],
                ["head", "head_segment", "head_text"],
            )

    return run


def cut_pairs(window: int, period: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            found = words.split_words(part.column("text"))
            out: list[tuple] = []
            for row, (doc, pairs) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("pairs").to_pylist())):
                for pair in pairs:
                    low, text = _segment(found, row, pair["segment"], window, period, segment)
                    places = [p - low for p in pair["places"]]
                    out.append((doc, pair["head"], pair["head_segment"], low, places, text))
            doc, head, number, low, places, text = zip(*out) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(head, pa.int64()), pa.array(number, pa.int32()), pa.array(low, pa.int32()),
                 pa.array(places, pa.list_(pa.int32())), pa.array(text, pa.binary())],
                ["doc_id", "head", "head_segment", "low", "places", "text"],
            )

    return run


def _windows(column: pa.Array, window: int):
    """Row, position and two hashes of every window of a column of texts."""
    found = words.split_words(column.cast(pa.large_binary()).view(pa.large_string()))
    rows = found.rows()
    place = np.arange(len(rows)) - found.first[:-1][rows]
    at = np.flatnonzero(place + window <= found.counts[rows])
    both = [words.runs(words.codes(found.data, found.starts, found.ends, seed), window) for seed in (0, 1)]
    return rows[at], place[at], [h[at] if len(at) else np.zeros(0, np.uint64) for h in both]


def extend(window: int, period: int):
    """Spans that the head holds too (no hashes), and windows around anchors that it does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, "text", words.SLICE_BYTES // 2):
            doc, low = part.column("doc_id").to_numpy(), part.column("low").to_numpy()
            rows, place, own = _windows(part.column("text"), window)
            head_rows, _, theirs = _windows(part.column("head_text"), window)
            # Windows that hold one of the anchors shared with this head.
            lists = part.column("places")
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            anchor = lists.flatten().to_numpy()
            width = int(place.max()) + period + 2 if len(place) else 1
            reach = np.bincount(owner * width + np.minimum(anchor + 1, width - 1), minlength=part.num_rows * width)
            reach -= np.bincount(owner * width + np.clip(anchor - period + 1, 0, width - 1), minlength=part.num_rows * width)
            near = -np.cumsum(reach)[rows * width + place] > 0
            salt = words.mix(np.arange(part.num_rows, dtype=np.uint64))
            held = near.copy()
            for mine, other in zip(own, theirs):
                held[near] &= np.isin(mine[near] + salt[rows[near]], other + salt[head_rows])
            smaller = part.column("head").to_numpy()[rows] < doc[rows]
            r, p = rows[held & smaller], place[held & smaller]
            opens = np.ones(len(r), dtype=bool)
            opens[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
            closes = np.append(opens[1:], True)[: len(r)]
            rest = near & ~held
            start = np.concatenate([(low[r] + p)[opens], (low[rows] + place)[rest]])
            stop = np.concatenate([(low[r] + p)[closes], (low[rows] + place)[rest]]) + window
            empty = np.zeros(int(opens.sum()), dtype=np.int64)
            known = np.concatenate([empty + 1, np.zeros(int(rest.sum()), dtype=np.int64)]) > 0
            hashes = [pa.array(np.concatenate([empty, h[rest].view(np.int64)]), mask=known) for h in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([doc[r][opens], doc[rows[rest]]])), pa.array(start.astype(np.int32)),
                 pa.array(stop.astype(np.int32)), *hashes],
                ["doc_id", "start", "stop", "h1", "h2"],
            )

    return run


def repeated_spans(
    docs: DataFrame, window: int = WINDOW, period: int = PERIOD, segment: int = SEGMENT
) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): (doc_id, start, stop) of words that go, possibly overlapping, and the texts they are in."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    found = materialize(suspects(docs, window, period), "passage-suspects")
    number = lambda c: F.floor(F.col(c) / segment).cast("int")
    pairs = found.groupBy(
        "doc_id", number("place").alias("segment"), "head", number("head_place").alias("head_segment")
    ).agg(F.collect_list("place").alias("places"))
    by_doc = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("segment", "head", "head_segment", "places")).alias("pairs"))
    by_head = found.select(F.col("head").alias("doc_id"), number("head_place").alias("n")).distinct().groupBy("doc_id").agg(
        F.collect_list("n").alias("segments")
    )
    wanted = by_doc.join(by_head, "doc_id", "full")
    texts = materialize(docs.join(wanted, "doc_id"), "passage-texts")
    heads = texts.where("segments is not null").select("doc_id", "text", "segments").mapInArrow(
        cut_heads(window, period, segment), "head bigint, head_segment int, head_text binary"
    )
    sides = texts.where("pairs is not null").select("doc_id", "text", "pairs").mapInArrow(
        cut_pairs(window, period, segment), "doc_id bigint, head bigint, head_segment int, low int, places array<int>, text binary"
    ).join(heads, ["head", "head_segment"])
    extended = materialize(
        sides.select("doc_id", "head", "low", "places", "text", "head_text").mapInArrow(
            extend(window, period), "doc_id bigint, start int, stop int, h1 bigint, h2 bigint"
        ),
        "passage-extended",
    )
    rest = extended.where("h1 is not null")
    least = rest.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last")
    again = rest.join(least, ["h1", "h2"]).where("doc_id > least")
    columns = ["doc_id", "start", "stop"]
    spans = extended.where("h1 is null").select(*columns).unionByName(again.select(*columns))
    return spans, texts.where("pairs is not null").select("doc_id", "text")


def _clean(text: str | None, spans: list[dict]) -> tuple[int, int, bytes]:
    parts = (text or "").encode().split()
    gone = np.zeros(len(parts) + 1, dtype=np.int32)
    for span in spans:
        gone[min(span["start"], len(parts))] += 1
        gone[min(span["stop"], len(parts))] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    return len(parts), int(gone.sum()), b" ".join([p for p, g in zip(parts, gone) if not g] if gone.any() else parts)


def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text[, spans] -> counts and the kept words, joined by one space, with their digest."""
    for part in words.slices(batches):
        spans = part.column("spans").to_pylist() if "spans" in part.schema.names else [[]] * part.num_rows
        rows = [_clean(t, s or []) for t, s in zip(part.column("text").to_pylist(), spans)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()), pa.array([r[2].decode() for r in rows], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


CLEANED = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def without_repeats(
    docs: DataFrame, texts: bool = True, window: int = WINDOW, period: int = PERIOD, segment: int = SEGMENT
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Documents that lose nothing are told by their own text in the scan; only the texts of
    documents with suspect anchors were shuffled.
    """
    spans, held = repeated_spans(docs, window, period, segment)
    by_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else [])]
    changed = materialize(held.join(by_doc, "doc_id").mapInArrow(cleaned, CLEANED).select(*columns).distinct(), "passage-changed")
    ids = changed.select("doc_id").distinct()
    same = docs.select("doc_id", "text").mapInArrow(cleaned, CLEANED).select(*columns)
    if texts:
        return same.join(ids, "doc_id", "left_anti").unionByName(changed)
    new = changed.select(*[F.col(c).alias(f"new_{c}") for c in columns])
    return same.join(new, (F.col("doc_id") == F.col("new_doc_id")) & (F.col("n_words") == F.col("new_n_words")), "left").select(
        "doc_id", "n_words", *[F.coalesce(f"new_{c}", c).alias(c) for c in columns[2:]]
    )
